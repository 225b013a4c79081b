"""Phrase collocations by multikey three-way quicksort of suffix pointers.

A suffix is the run of words from one place of a piece on; only its first ``DEPTH`` words matter. Counting
goes in two passes over the texts:

* Words are counted for each language. A phrase with an infrequent word is infrequent, so suffixes
  are cut at the first one. Which words are frequent reaches the tasks as a bitmap of fixed size over
  word numbers; a word that shares its bit only costs work.
* Each block of texts turns its suffixes into word numbers, merges equal ones, and sends them, packed, to
  the group that their leading two words name. A group holds every suffix with those leading words, so
  it sorts them by three-way partitioning, word by word: the part equal to the pivot is a phrase, its
  weight the phrase's count, and goes on with the next word; parts below ``min_count`` are left. All
  open parts of a depth are partitioned in the same numpy step.

Hot leading words don't make a hot group. Each block names the pairs and triples of words with a share of
1 / HOT of its places when it counts its words; one with twice that share of all places is named in some
block, and at most HOT have that share of what the blocks name (a proven bound, so the list is broadcast).
Suffixes that start with a hot pair are routed by three words, with a hot triple by all four; the counts of
the shorter phrases then come in parts, which Spark adds up.

Word numbers are 64-bit digests. A Spark aggregate over all distinct words makes sure that no frequent
word shares its number with another word; if one did, the next seed is taken.
"""

from __future__ import annotations

from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.common import staged
from basketry.llm.words import LOWER, byte_table, chunks, coded, runs, string_array, text_bytes

DEPTH = 4
MIN_COUNT = 30
TOP = 2000
#: 100 * f(longer) >= SHARE * f(phrase): the phrase only occurs as part of the longer one.
SHARE = 80
#: Leading words with at least this share (1 / HOT) of all places are routed deeper.
HOT = 1024
#: Bits of the bitmap of frequent words, in powers of two (2^26 bits: 8 MB).
BITMAP_POWER = 26
#: Word occurrences a group of routed suffixes holds on average.
GROUP_WORDS = 2_000_000
#: Suffixes a task gathers before it sends them: the more, the fewer words are named twice.
SEND_SUFFIXES = 2_000_000
#: Piece ends, then word ends; everything else belongs to a word.
CLASSES = byte_table(".,;:!?\n\x0b\x0c\r", 2) + byte_table(" \t", 1)
NO_WORD = -1


def language() -> Column:
    return F.coalesce(F.col("lang").cast("string"), F.lit("und"))


def _words(batch, seed: int):
    """Words of a block: (codes, distinct words, their numbers, piece of each word, text of each word)."""
    data, offsets = text_bytes(batch.column("text"))
    data = LOWER[data]
    kind = CLASSES[data]
    starts, ends = runs(kind == 0, offsets)
    codes, distinct = coded(string_array(data[kind == 0], ends - starts))
    numbers = np.array([xxhash.xxh3_64_intdigest(w, seed) for w in distinct.cast(pa.large_binary()).to_pylist()],
                       np.uint64).view(np.int64)
    row = np.searchsorted(offsets, starts, "right") - 1
    piece = np.cumsum(kind == 2)[starts] + row if len(starts) else row
    return codes, distinct, numbers, piece, row


def _languages(column) -> tuple[np.ndarray, list]:
    codes, names = coded(column)
    return codes, names.to_pylist()


def mix(state: np.ndarray, more: np.ndarray) -> np.ndarray:
    state = (state ^ more) * np.uint64(0x9E3779B97F4A7C15)
    return state ^ (state >> np.uint64(32))


def _paths(names: list, lang: np.ndarray, numbers: np.ndarray, columns: list) -> list:
    """Digests of (language, leading words) for 1, 2, ... words: what routes a suffix."""
    state = np.array([xxhash.xxh3_64_intdigest(x.encode()) for x in names], np.uint64)[lang]
    signed = np.concatenate([numbers, [0]]).view(np.uint64)
    out = []
    for codes in columns:
        state = mix(state, signed[codes])
        out.append(state)
    return out


def _hot_paths(codes, numbers, piece, lang, names, hot: int):
    """(digest, n) of the pairs and triples of words with at least 1 / hot of the block's places."""
    often = (np.bincount(codes, minlength=len(numbers)) * hot >= len(codes))[codes]
    here = np.flatnonzero(often)
    for k in (1, 2):
        here = here[here + k < len(codes)]
        here = here[often[here + k] & (piece[here + k] == piece[here])]
        path = _paths(names, lang[here], numbers, [codes[here + i] for i in range(k + 1)])[-1]
        found, n = np.unique(path, return_counts=True)
        much = n * hot >= len(codes)
        yield found[much].view(np.int64), n[much]
        here = here[np.isin(path, found[much])]


def word_counts(docs: DataFrame, seed: int = 0, hot: int = HOT) -> DataFrame:
    """(lang, word, number, n) of all words of (lang, text); rows without a word are leading words that
    are hot in some block, ``number`` being their digest."""
    def count(batches):
        for batch in chunks(batches):
            codes, distinct, numbers, piece, row = _words(batch, seed)
            if not len(codes):
                continue
            lang_of, names = _languages(batch.column("lang"))
            lang_of = lang_of[row]
            found, n = np.unique(lang_of * len(distinct) + codes, return_counts=True)
            lang, word = np.divmod(found, len(distinct))
            text = distinct.take(pa.array(word)).cast(pa.string())
            yield _word_rows(pa.array(names, pa.string()).take(pa.array(lang)), text, numbers[word], n)
            for path, n in _hot_paths(codes, numbers, piece, lang_of, names, hot):
                none = pa.nulls(len(path), pa.string())
                yield _word_rows(none, none, path, n)

    parts = docs.mapInArrow(count, "lang string, word string, number long, n long")
    return parts.groupBy("lang", "word", "number").agg(F.sum("n").alias("n"))


def _word_rows(lang, word, number, n):
    return pa.RecordBatch.from_arrays([lang, word, pa.array(number), pa.array(n)], ["lang", "word", "number", "n"])


def numbered_words(docs: DataFrame, min_count: int, hot: int, tries: int = 8) -> tuple[DataFrame, int]:
    """``word_counts`` as a table, with a seed for which each frequent word's number is its own."""
    for seed in range(tries):
        words = staged(word_counts(docs, seed, hot), "words")
        shared = words.filter("word IS NOT NULL").groupBy("number").agg(
            F.min("word").alias("one"), F.max("word").alias("other"), F.max("n").alias("n"))
        if shared.filter((F.col("one") != F.col("other")) & (F.col("n") >= min_count)).isEmpty():
            return words, seed
    raise ValueError(f"frequent words share numbers under {tries} seeds")


def bitmap_of(numbers: DataFrame, power: int) -> np.ndarray:
    """The bits of ``numbers.number``, by their lowest ``power`` bits; one bounded table of bytes."""
    bit = F.col("number").bitwiseAND(F.lit((1 << power) - 1))
    rows = numbers.groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()
    out = np.zeros((((1 << power) >> 15) + 2) * 4096, np.uint8)  # whole buckets of 32768 bits
    for row in rows:
        part = np.frombuffer(row["bits"], np.uint8)
        out[row["bucket"] * 4096:row["bucket"] * 4096 + len(part)] = part
    return out


def in_bitmap(bits: np.ndarray, numbers: np.ndarray, power: int) -> np.ndarray:
    value = numbers & ((1 << power) - 1)
    # buckets count from 1 and hold the values 32768 * (bucket - 1) + 1 to 32768 * bucket
    bucket = np.where(value > 0, 1 + (value - 1) // 32768, 0)
    place = np.where(value > 0, (value - 1) % 32768, 0)
    at = bucket * 4096 + place // 8
    return (bits[at] >> (place % 8).astype(np.uint8)) & 1 == 1


def suffixes(codes: np.ndarray, piece: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, place): the codes of the first DEPTH words of each suffix that starts with two frequent
    words of one piece, cut before the first infrequent one, and where it starts."""
    ok = frequent[codes] if len(codes) else np.zeros(0, bool)
    n = len(codes)
    out = np.full((n, DEPTH), NO_WORD, np.int32)
    alive = ok.copy()
    out[alive, 0] = codes[alive]
    for k in range(1, DEPTH):
        alive[max(0, n - k):] = False
        here = np.flatnonzero(alive)
        alive[here] = ok[here + k] & (piece[here + k] == piece[here])
        here = here[alive[here]]
        out[here, k] = codes[here + k]
    place = np.flatnonzero(out[:, 1] != NO_WORD)
    return out[place], place


def merged(rows: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal rows once, with the sum of their weights; the values are at least -1."""
    if not len(rows):
        return rows, weights
    base = int(rows[:, 1:].max()) + 2  # two columns fit one integer
    key = rows[:, 0].astype(np.int64)
    keys = []
    for k in range(1, rows.shape[1]):
        key = key * base + rows[:, k] + 1
        if k % 2 == 0:
            keys.append(key)
            key = np.zeros(len(rows), np.int64)
    keys.append(key)
    order = np.lexsort(keys[::-1])
    first = np.ones(len(rows), bool)
    first[1:] = False
    for key in keys:
        key = key[order]
        first[1:] |= key[1:] != key[:-1]
    at = np.flatnonzero(first)
    return rows[order[at]], np.add.reduceat(weights[order], at)


def _block(batch, seed, bits, power):
    """(rows, weights, numbers, names) of a block: each distinct suffix as its language's code and DEPTH codes
    of words, how often it occurs, and what the codes stand for."""
    codes, distinct, numbers, piece, row = _words(batch, seed)
    lang_of, names = _languages(batch.column("lang"))
    rows, place = suffixes(codes, piece, in_bitmap(bits, numbers, power))
    used = np.flatnonzero(np.bincount(rows.ravel() + 1, minlength=len(numbers) + 1)[1:])
    lookup = np.full(len(numbers) + 1, NO_WORD, np.int32)  # the last place stands for no word
    lookup[used] = np.arange(len(used))
    rows = np.column_stack([lang_of[row[place]].astype(np.int32), lookup[rows]])
    return *merged(rows, np.ones(len(rows), np.int64)), numbers[used], names


def _squeezed(column: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(column), codec="zstd", asbytes=True)


def _packed(blocks: list, hot_paths, groups):
    """The suffixes of some blocks for each group: group, lang, numbers of the words used, codes column by
    column, weights, depths of their routes, how many."""
    names = sorted({x for *_, n in blocks for x in n})
    numbers, place = np.unique(np.concatenate([x for _, _, x, _ in blocks]), return_inverse=True)
    place = np.split(place.astype(np.int32), np.cumsum([len(x) for _, _, x, _ in blocks])[:-1])
    for (rows, _, _, own), to in zip(blocks, place, strict=True):
        rows[:, 0] = np.array([names.index(x) for x in own], np.int32)[rows[:, 0]] if len(rows) else rows[:, 0]
        rows[:, 1:] = np.append(to, np.int32(NO_WORD))[rows[:, 1:]]
    key, weights = np.concatenate([x[0] for x in blocks]), np.concatenate([x[1] for x in blocks])
    blocks.clear()
    key, weights = merged(key, weights)
    if not len(key):
        return
    paths = _paths(names, key[:, 0], numbers, [key[:, k] for k in range(1, DEPTH + 1)])
    depth = 2 + np.isin(paths[1], hot_paths).astype(np.uint8)
    depth += (depth == 3) & np.isin(paths[2], hot_paths)
    group = np.choose(depth - 2, paths[1:]) % np.uint64(groups)
    del paths
    order = np.argsort(group * np.uint64(len(names)) + key[:, 0].astype(np.uint64), kind="stable")
    key, weights, group, depth = key[order], weights[order], group[order].astype(np.int64), depth[order]
    cut = np.flatnonzero((np.diff(group) != 0) | (np.diff(key[:, 0]) != 0)) + 1
    lookup = np.full(len(numbers) + 1, NO_WORD, np.int32)
    for lo, hi in zip([0, *cut], [*cut, len(key)], strict=True):
        some = key[lo:hi, 1:]
        used = np.unique(some)
        used = used[used != NO_WORD]
        lookup[used] = np.arange(len(used))
        width = np.int16 if len(used) < 1 << 15 else np.int32
        weight = weights[lo:hi]
        # numbers ascend: their differences have leading zeros
        steps = np.diff(numbers[used], prepend=np.int64(0)).view(np.uint8).reshape(-1, 8)
        yield (int(group[lo]), names[key[lo, 0]], _squeezed(steps.T), _squeezed(lookup[some].astype(width).T),
               _squeezed(weight), _squeezed(depth[lo:hi]), hi - lo, np.dtype(width).itemsize, len(used))


SENT = "group long, lang string, numbers binary, codes binary, weights binary, depths binary, m long, width int, used int"


def routed(docs: DataFrame, seed: int, bits: np.ndarray, power: int, hot: np.ndarray, groups: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((bits, hot))

    def send(batches):
        bits, hot = shared.value
        kinds = (pa.int64(), pa.string(), *[pa.binary()] * 4, pa.int64(), pa.int32(), pa.int32())
        held = []

        def sent():
            rows = _packed(held, hot, groups)
            while part := list(islice(rows, 256)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*part, strict=True), kinds, strict=True)],
                    ["group", "lang", "numbers", "codes", "weights", "depths", "m", "width", "used"])

        for batch in chunks(batches):
            held.append(_block(batch, seed, bits, power))
            if sum(len(x[0]) for x in held) >= SEND_SUFFIXES:
                yield from sent()
                held = []
        if held:
            yield from sent()

    return docs.mapInArrow(send, SENT)


def unpacked(table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list]:
    """(rows, weights, depths, numbers, languages) of a group's packed suffixes: each row is the code of
    its language and DEPTH codes of words; ``numbers`` are the codes' word numbers, in their order."""
    cells = table.to_pydict()
    names = sorted(set(cells["lang"]))
    own = [np.cumsum(np.ascontiguousarray(np.frombuffer(pa.decompress(x, 8 * n, "zstd"), np.uint8).reshape(8, n).T).view(np.int64).ravel())
           for x, n in zip(cells["numbers"], cells["used"], strict=True)]
    numbers, place = np.unique(np.concatenate(own), return_inverse=True)
    place = np.split(place.astype(np.int32), np.cumsum([len(x) for x in own])[:-1])
    total = sum(cells["m"])
    rows, weights, depths = np.empty((total, 1 + DEPTH), np.int32), np.empty(total, np.int64), np.empty(total, np.uint8)
    at = 0
    for i, m in enumerate(cells["m"]):
        width = cells["width"][i]
        codes = np.frombuffer(pa.decompress(cells["codes"][i], m * DEPTH * width, "zstd"), f"<i{width}").reshape(DEPTH, m).T
        rows[at:at + m, 0] = names.index(cells["lang"][i])
        rows[at:at + m, 1:] = np.append(place[i], np.int32(NO_WORD))[codes]  # the last place: no word
        weights[at:at + m] = np.frombuffer(pa.decompress(cells["weights"][i], m * 8, "zstd"), np.int64)
        depths[at:at + m] = np.frombuffer(pa.decompress(cells["depths"][i], m, "zstd"), np.uint8)
        at += m
    return rows, weights, depths, numbers, names


def three_way(rows: np.ndarray, weights: np.ndarray, min_weight: int):
    """Multikey three-way quicksort of the pointers to ``rows`` down to their last column.

    Yields (depth, pointers, counts): one pointer to each distinct beginning of ``depth`` columns whose
    weight reaches ``min_weight``, and that weight. All parts of the same depth take their step at once:
    a pivot splits each into less, equal and greater; the equal part is complete and goes one column
    deeper, the others go on while they are heavy enough. Negative values end a row.
    """
    pointer = np.arange(len(rows), dtype=np.int32)
    part = np.zeros(len(rows), np.int32)
    for column in range(rows.shape[1]):
        value = rows[pointer, column]
        ends = value >= 0
        pointer, part, value = pointer[ends], part[ends], value[ends]
        done_pointer, done_part, parts = [], [], 0
        while len(pointer):
            # pointers of a part lie together; drop light parts, number the others from 0
            first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            size = np.diff(np.append(first, len(part)))
            heavy = np.add.reduceat(weights[pointer], first) >= min_weight
            keep = np.repeat(heavy, size)
            pointer, value, size = pointer[keep], value[keep], size[heavy]
            if not len(pointer):
                break
            part = np.repeat(np.arange(len(size), dtype=np.int32), size)
            first = np.cumsum(size) - size
            # the middle of three of the part's values splits it
            some = value[np.stack([first, first + size // 2, first + size - 1])]
            pivot = np.sort(some, axis=0)[1][part]
            side = 1 + (value > pivot).astype(np.int8) - (value < pivot).astype(np.int8)
            same = side == 1
            done_pointer.append(pointer[same])
            done_part.append(part[same] + parts)
            parts += len(size)
            # less before greater within each part
            less, more = side == 0, side == 2
            below, above = part[less], part[more]
            n_below = np.cumsum(np.bincount(below, minlength=len(size)))
            n_above = np.cumsum(np.bincount(above, minlength=len(size)))
            to_below = np.arange(len(below)) + np.append(0, n_above)[below]
            to_above = np.arange(len(above)) + n_below[above]
            moved = np.empty((3, len(below) + len(above)), np.int32)
            moved[:, to_below] = pointer[less], value[less], 2 * below
            moved[:, to_above] = pointer[more], value[more], 2 * above + 1
            pointer, value, part = moved
        if not done_pointer:
            return
        pointer, part = np.concatenate(done_pointer), np.concatenate(done_part)
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        counts = np.add.reduceat(weights[pointer], first)
        heavy = counts >= min_weight
        keep = np.repeat(heavy, np.diff(np.append(first, len(part))))
        if column:
            yield column, pointer[first][heavy], counts[heavy]
        pointer, part = pointer[keep], part[keep]


PHRASES = "lang string, phrase array<long>, n long"


def _group_phrases(min_count: int):
    def run(table):
        rows, weights, depths, numbers, names = unpacked(table)
        # routes of different depths never share the words that route them
        rows[:, 0] = rows[:, 0] * (DEPTH + 1) + depths
        found = []
        for length, pointers, counts in three_way(rows, weights, min_count):
            whole = depths[pointers] <= length  # the group holds all suffixes with this beginning
            if length >= 2 and whole.any():
                found.append((rows[pointers[whole], :1 + length], counts[whole]))
        for length in range(2, DEPTH):  # shorter beginnings of deeper routes: in parts
            some = (depths > length) & (rows[:, length] >= 0)
            if some.any():
                found.append(merged(rows[some, :1 + length], weights[some]))
        if not found:
            return pa.table([pa.array([], pa.string()), pa.array([], pa.list_(pa.int64())), pa.array([], pa.int64())],
                            ["lang", "phrase", "n"])
        lang = np.concatenate([x[:, 0] for x, _ in found]) // (DEPTH + 1)
        sizes = np.concatenate([np.full(len(x), x.shape[1] - 1, np.int32) for x, _ in found])
        phrases = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(
            np.concatenate([numbers[x[:, 1:]].ravel() for x, _ in found])))
        return pa.table([pa.array(names, pa.string()).take(pa.array(lang)), phrases,
                         pa.array(np.concatenate([c for _, c in found]))], ["lang", "phrase", "n"])
    return run


def phrase_counts(docs: DataFrame, min_count: int = MIN_COUNT, power: int = BITMAP_POWER, hot: int = HOT,
                  group_words: int = GROUP_WORDS) -> tuple[DataFrame, DataFrame]:
    """(words, phrases): (lang, word, number, n) of all words, and (lang, phrase, n) of the phrases of 2 to
    DEPTH words, as arrays of word numbers, that occur ``min_count`` times or more in (lang, text)."""
    counted, seed = numbered_words(docs, min_count, hot)
    words = counted.filter("word IS NOT NULL")
    total = words.agg(F.sum("n")).first()[0] or 0
    paths = counted.filter("word IS NULL").filter(F.col("n") * hot >= total)  # at most hot pairs and triples
    paths = np.array([r[0] for r in paths.select("number").collect()], np.int64).view(np.uint64)
    bits = bitmap_of(words.filter(F.col("n") >= min_count), power)
    sent = routed(docs, seed, bits, power, paths, max(1, total // group_words))
    parts = sent.groupBy("group").applyInArrow(_group_phrases(min_count), PHRASES)
    phrases = parts.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)
    return words, staged(phrases, "phrases")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, share: int = SHARE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases of 2 to DEPTH words.

    ``a`` occurrences; cutting after k words gives l and r occurrences of both parts and the score
    floor(2000000 * a / (l + r)); the cut of least score counts, ties to the smallest k. Phrases that occur
    at least ``share`` % as often inside a longer candidate are left out. Ordered by score, then a (both
    descending), then phrase; rank counts from 1. A null lang is ``und``; null and empty texts hold no words;
    repeated rows count as often as they occur; an empty table gives no rows. Other columns are not read.
    """
    texts = docs.select(language().alias("lang"), "text")
    words, phrases = phrase_counts(texts, min_count)
    exact = "decimal(38,0)"
    # longest count of a longer candidate around each phrase
    size = F.size("phrase")
    inner = phrases.filter(size > 2).select("lang", "n", F.explode(F.flatten(F.transform(
        F.sequence(F.lit(2), size - 1), lambda k: F.transform(
            F.sequence(F.lit(1), size - k + 1), lambda i: F.slice("phrase", i, k))))).alias("phrase"))
    around = inner.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    kept = phrases.join(around, ["lang", "phrase"], "left").filter(
        F.col("longer").isNull() | (F.col("longer").cast(exact) * 100 < F.col("n").cast(exact) * share)).drop("longer")
    # both parts of every cut
    counts = phrases.unionByName(words.filter(F.col("n") >= min_count).select("lang", F.array("number").alias("phrase"), "n"))
    cuts = kept.select("lang", "phrase", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    parts = cuts.select("lang", F.col("phrase").alias("whole"), "a", "k", F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.slice("phrase", F.lit(1), F.col("k")).alias("phrase")),
        F.struct(F.lit(1).alias("side"), F.slice("phrase", F.col("k") + 1, size - F.col("k")).alias("phrase")))).alias("x"))
    found = parts.select("lang", "whole", "a", "k", "x.*").join(counts, ["lang", "phrase"])
    both = found.groupBy("lang", "whole", "a", "k").agg(
        F.max(F.when(F.col("side") == 0, F.col("n"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("n"))).alias("r"))
    score = F.expr("CAST(CAST(2000000 AS DECIMAL(10,0)) * CAST(a AS DECIMAL(20,0)) "
                   "div (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0))) AS BIGINT)")
    scored = both.withColumn("score", score).groupBy("lang", "whole", "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("b")).select("lang", "whole", "a", "b.l", "b.r", "b.score")
    # rank without the words first: only ties at the last place come along
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    near = staged(scored.withColumn("place", F.rank().over(best)).filter(F.col("place") <= top).drop("place"), "best")
    spelt = words.filter(F.col("n") >= min_count).select("lang", "number", "word")
    named = near.select("lang", "whole", F.posexplode("whole").alias("i", "number")).join(spelt, ["lang", "number"])
    named = named.groupBy("lang", "whole").agg(F.array_sort(F.collect_list(F.struct("i", "word"))).alias("w")).select(
        "lang", "whole", F.array_join(F.transform("w", lambda x: x["word"]), " ").alias("phrase"))
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    out = near.join(named, ["lang", "whole"])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase")))
    out = out.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= top)
    return out.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The same rows as plain SQL over word positions.
PHRASES_SQL = r"""
WITH piece AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS p, x FROM (
    SELECT lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                        '[.,;:!?\x0A-\x0D]')) AS x FROM documents)),
listed AS (SELECT lang, regexp_extract_all(x, '[^\x20\x09]+') AS ws FROM piece),
spans AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM listed),
f AS (SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase, count(*) AS f
      FROM spans, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE i + m - 1 <= len(ws) GROUP BY 1, 2, 3),
cand AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE m > 1 AND f >= 30),
inside AS (SELECT lang, array_to_string(ws[i:i + k - 1], ' ') AS phrase, max(a) AS longer FROM (
    SELECT lang, ws, m, a, k, unnest(range(1, CAST(m - k + 2 AS BIGINT))) AS i
    FROM (SELECT lang, ws, m, a, unnest(range(2, CAST(m AS BIGINT))) AS k FROM cand)) GROUP BY 1, 2),
kept AS (SELECT c.* FROM cand c LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a),
cuts AS (SELECT lang, m, phrase, a, k, array_to_string(ws[1:k], ' ') AS x, array_to_string(ws[k + 1:m], ' ') AS y
         FROM (SELECT *, unnest(range(1, CAST(m AS BIGINT))) AS k FROM kept)),
scored AS (SELECT c.lang, c.m, c.phrase, c.a, k, fl.f AS l, fr.f AS r,
           CAST(CAST(2000000 AS HUGEINT) * c.a // (fl.f + fr.f) AS BIGINT) AS score FROM cuts c
           JOIN f fl ON fl.lang = c.lang AND fl.m = c.k AND fl.phrase = c.x
           JOIN f fr ON fr.lang = c.lang AND fr.m = c.m - c.k AND fr.phrase = c.y),
one AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, m, phrase ORDER BY score, k) = 1),
total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM one)
JOIN total USING (lang) WHERE rank <= 2000
"""
