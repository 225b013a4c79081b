"""Helpers shared by the corpus operators: shared scratch tables, table loading, digests."""

from __future__ import annotations

from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.session import scratch_path
from basketry.session import ship_package as ship  # noqa: F401

#: Rows handled at a time inside one Arrow batch, so Python's copies of a batch stay small.
SLICE_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given parquet tables, by the reader (any store Spark can read)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in shared scratch and read it back.

    Cuts lineage: later jobs read files that outlive any executor instead of recomputing.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Inside, a finished job's shuffle files are deleted at once instead of when the driver collects
    garbage. For jobs that write a table, as nothing reads their shuffles again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def discard(df: DataFrame) -> None:
    """Delete the files of a table in shared scratch that nothing reads any more."""
    files = df.inputFiles()
    if files:
        jvm = df.sparkSession.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(files[0])).getParent()
        folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def id_bucket(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def texts_of(column) -> list[bytes]:
    """An Arrow string column as UTF-8 bytes; null gives None."""
    return column.cast(pa.large_binary()).to_pylist()


def slices(batches, rows: int = SLICE_ROWS):
    """The incoming Arrow batches in pieces of at most ``rows`` rows."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def with_rest(docs: DataFrame) -> DataFrame:
    """(doc_id, text, rest): all other columns, whatever their names, as one struct."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*(rest or [F.lit(0).alias("none")])).alias("rest"))


def restored(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` again, in their order, from doc_id, text and rest."""
    return df.select(*[F.col(c) if c in ("doc_id", "text") else F.col("rest").getField(c).alias(c)
                       for c in docs.columns])
