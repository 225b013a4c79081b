"""Bucket sets as real bitmaps: one bit a bucket, tested by an expression instead of a join.

A bitmap table holds ``(number, bits)``: piece ``number`` (from 1) has the 32,768 buckets from
``32768 * (number - 1)`` on, as Spark's bitmap aggregates lay them out. 999,917 buckets take 31 rows of
4 KB, 125 KB in all, whatever the data. Pieces made by several runs or parts are merged by OR.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIECE_BITS = 32768
PIECE_BYTES = PIECE_BITS // 8
WORDS = PIECE_BYTES // 8


def bitmap_table(buckets: DataFrame, bucket: str = "bucket") -> DataFrame:
    """``(number, bits)`` of the buckets (>= 0) in a column; each task sends one piece per number at most."""
    place = F.col(bucket).cast("bigint") + 1  # Spark's pieces count values from 1
    return buckets.groupBy(F.bitmap_bucket_number(place).alias("number")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))


def merge_bitmaps(*tables: DataFrame) -> DataFrame:
    """One bitmap table with the buckets of all."""
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t)
    return every.groupBy("number").agg(F.bitmap_or_agg("bits").alias("bits"))


def bitmap_words(bitmap: DataFrame, num_buckets: int) -> Column:
    """The whole bitmap as one array of 64-bit words, an uncorrelated scalar subquery.

    Its size is fixed by ``num_buckets``; the row is computed once and handed to every task that tests.
    """
    pieces = bitmap.agg(F.map_from_entries(F.collect_list(F.struct("number", "bits"))).alias("m"))
    zeros = F.unhex(F.lit("00" * PIECE_BYTES))
    every = F.transform(F.sequence(F.lit(1).cast("bigint"), F.lit(max(1, -(-num_buckets // PIECE_BITS))).cast("bigint")),
                        lambda k: F.coalesce(F.element_at("m", k), zeros))
    words = F.flatten(F.transform(every, lambda b: F.transform(
        F.sequence(F.lit(0), F.lit(WORDS - 1)),
        lambda i: F.conv(F.hex(F.substring(b, i * 8 + 1, F.lit(8))), 16, -10).cast("bigint"))))
    return pieces.select(words.alias("words")).scalar()


def in_bitmap(words: Column, bucket: Column) -> Column:
    """Whether the bit of ``bucket`` (0 <= bucket < num_buckets) is set in ``bitmap_words``."""
    word = F.get(words, F.shiftright(bucket, 6).cast("int"))
    # a word is big-endian: its first byte has the buckets 0 to 7 of the 64, the lowest bit first
    byte, bit = F.shiftright(bucket, 3).bitwiseAND(F.lit(7)), bucket.bitwiseAND(F.lit(7))
    shift = ((F.lit(7) - byte) * 8 + bit).cast("int")
    return F.call_function("shiftright", word, shift).bitwiseAND(F.lit(1).cast("bigint")) == 1
