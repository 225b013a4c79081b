"""Spelling variants by a dictionary of trie-node pairs.

Words are maximal runs of letters; their occurrences are counted in the tasks that read the texts and
summed by Spark. The distinct words that are long and frequent enough form a forward trie (nodes:
beginnings) and a reversed trie (nodes: endings). The alphabet is fixed, so nodes number themselves: a
node is the base-91 number of its path, exact for paths of up to nine letters; deeper ones mix the
parent's number with the letter and carry the top bit. A word then has two kinds of integer pairs:

* skipped: (node before place i, node after the letter at i), for each letter;
* inserted: (node before place i, node from place i on), for each gap.

Two words with an equal skipped pair differ in that one letter; a skipped pair that equals an inserted
pair tells that the first word has just that letter more. So exact neighbours come out of two equi-joins
on integers. A group of equal pairs holds at most one word for each letter of the alphabet and one
for the gap, whatever the data, so no key is hot. Deep nodes might share a number by chance, therefore
words that meet are compared before they count.

A run of one letter gives the same shorter word whichever of its letters goes; only its last letter counts
as the deleted one, so every neighbour is found exactly once.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import staged
from basketry.llm.words import LOWER, chunks, runs, string_array, text_bytes

MIN_LENGTH, MIN_COUNT = 6, 5
#: A form has at least so many times the occurrences of its variant.
FORM_FACTOR = 5
#: A run whose checksum this divides loses one code point before it is counted; 0 turns that off.
TYPO_MOD = 199
#: Letters of the alphabet: a-z and the 64 code points from U+00C0; with 0 for none, digits of base 91.
BASE, EXACT_DEPTH = 91, 9
TOP = np.uint64(1 << 63)
#: Runs longer than this are checksummed one by one.
SHORT = 64


def crc_steps() -> np.ndarray:
    """What each byte does to a crc32 state (reflected polynomial EDB88320)."""
    state = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        state = np.where(state & 1, (state >> 1) ^ np.uint32(0xEDB88320), state >> 1)
    return state


STEPS = crc_steps()


def checksums(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of each run, carried on from the checksum ``before`` it; all runs a byte at a time."""
    state = before ^ np.uint32(0xFFFFFFFF)
    order = np.argsort(-np.minimum(lengths, SHORT + 1), kind="stable")
    size = lengths[order]
    for k in range(int(min(size[0], SHORT)) if len(size) else 0):
        now = order[:np.searchsorted(-size, -k, "left")]
        state[now] = STEPS[(state[now] ^ data[starts[now] + k]) & 0xFF] ^ (state[now] >> 8)
    state ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(lengths > SHORT):
        state[i] = zlib.crc32(data[starts[i]:starts[i] + lengths[i]].tobytes(), int(before[i]))
    return state


def _count_chunk(batch, typo_mod: int, min_length: int) -> pa.RecordBatch:
    data, offsets = text_bytes(batch.column("text"))
    data = LOWER[data]
    lead = data == 0xC3
    letter = (data >= 97) & (data <= 122) | lead
    letter[1:] |= lead[:-1]
    starts, ends = runs(letter, offsets)
    lengths = ends - starts
    points = lengths - np.diff(np.concatenate([[0], np.cumsum(lead)])[np.stack([starts, ends])], axis=0)[0]
    changed = []
    keep = points >= min_length
    if typo_mod:
        ids = batch.column("doc_id").cast(pa.string()).fill_null("").to_pylist()
        seed = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
        doc = np.searchsorted(offsets, starts, "right") - 1
        marks = checksums(data, starts, lengths, seed[doc])
        hit = np.flatnonzero((marks % typo_mod == 0) & (points > min_length))
        keep &= marks % typo_mod != 0
        for i in hit:
            word = data[starts[i]:ends[i]].tobytes().decode()
            at = int(marks[i]) % len(word)
            changed.append(word[:at] + word[at + 1:])
    kept = np.repeat(keep, lengths)
    found = string_array(data[letter][kept], lengths[keep])
    if changed:
        found = pa.concat_arrays([found, pa.array(changed, pa.large_string())])
    counts = found.value_counts()
    return pa.RecordBatch.from_arrays([counts.field("values").cast(pa.string()), counts.field("counts")], ["word", "n"])


def word_counts(docs: DataFrame, typo_mod: int = TYPO_MOD, min_length: int = MIN_LENGTH,
                min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): words of at least ``min_length`` code points and ``min_count`` occurrences in all texts.

    A null text has no words. With ``typo_mod``, a run whose crc32 of ``<doc_id>:<run>`` it divides loses
    its code point number checksum modulo length; a null id is written as nothing.
    """
    def count(batches):
        for batch in chunks(batches):
            yield _count_chunk(batch, typo_mod, min_length)

    parts = docs.select("doc_id", "text").mapInArrow(count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def letter_codes(points: np.ndarray) -> np.ndarray:
    """Digits of base 91 for the alphabet's code points."""
    return np.where(points < 128, points - 96, points - 0xC0 + 27).astype(np.uint64)


def nodes(letters: np.ndarray) -> np.ndarray:
    """Numbers of the nodes on the paths of equally long words: a row of letter codes each gives the
    nodes of depth 0 to its length."""
    words, length = letters.shape
    out = np.zeros((words, length + 1), np.uint64)
    for i in range(length):
        step = out[:, i] * np.uint64(BASE) + letters[:, i]
        if i >= EXACT_DEPTH:
            step = (step ^ (step >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            step = (step ^ (step >> np.uint64(32))) | TOP
        out[:, i + 1] = step
    return out


def _pairs(batches):
    """Integer pairs of (id, word, n): before, after, skipped, last (of its run of one letter), id, n."""
    for batch in batches:
        words, ids, n = batch.column("word"), np.asarray(batch.column("id")), np.asarray(batch.column("n"))
        lengths = np.asarray(pc.utf8_length(words))
        for length in np.unique(lengths):
            every = np.flatnonzero(lengths == length)
            room = max(1, (1 << 19) // int(length + 1))
            for at in range(0, len(every), room):
                some = every[at:at + room]
                text = "".join(words.take(pa.array(some)).to_pylist())
                points = np.frombuffer(text.encode("utf-32-le"), np.uint32).reshape(len(some), length)
                letters = letter_codes(points.astype(np.int64))
                fore, back = nodes(letters), nodes(letters[:, ::-1])[:, ::-1]
                last = np.ones(letters.shape, bool)
                last[:, :-1] = letters[:, :-1] != letters[:, 1:]
                for before, after, skipped in ((fore[:, :-1], back[:, 1:], True), (fore, back, False)):
                    who = np.repeat(some, before.shape[1])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x) for x in (before.ravel().view(np.int64), after.ravel().view(np.int64),
                                               np.full(len(who), skipped), last.ravel() if skipped else np.zeros(len(who), bool),
                                               ids[who], n[who])],
                        ["before", "after", "skipped", "last", "id", "n"])


def node_pairs(words: DataFrame) -> DataFrame:
    """(before, after, skipped, last, id, n): the integer pairs of every word of (id, word, n)."""
    return words.select("id", "word", "n").mapInArrow(
        _pairs, "before long, after long, skipped boolean, last boolean, id long, n long")


def neighbours(words: DataFrame) -> DataFrame:
    """(id, other, other_n): the words of (id, word, n) that differ by one inserted, deleted or replaced
    letter, each pair in both directions and once. Words that met by deep nodes are compared first."""
    pairs = staged(node_pairs(words), "node_pairs")
    skipped = pairs.filter("skipped")
    key = ["before", "after"]

    def renamed(df):
        return df.select(*key, F.col("id").alias("other"), F.col("n").alias("other_n"))

    replaced = skipped.select(*key, "id", "n").join(renamed(skipped), key).filter("id < other")
    longer = skipped.filter("last").select(*key, "id", "n").join(renamed(pairs.filter("NOT skipped")), key)
    met = staged(replaced.unionByName(longer), "met")
    deep = (F.col("before") < 0) | (F.col("after") < 0)
    spelt = words.select("id", "word")
    equal = met.filter(deep).join(spelt, "id").join(spelt.toDF("other", "other_word"), "other").filter(
        F.levenshtein("word", "other_word", 1) == 1)
    both = F.explode(F.array(
        F.struct("id", "other", "other_n"),
        F.struct(F.col("other").alias("id"), F.col("id").alias("other"), F.col("n").alias("other_n"))))
    return met.filter(~deep).select("id", "n", "other", "other_n").unionByName(
        equal.select("id", "n", "other", "other_n")).select(both.alias("x")).select("x.*")


def roots(forms: DataFrame) -> DataFrame:
    """(id, root) for each (id, form): the end of the chain of forms, by pointer doubling.

    Occurrences grow along a chain by ``FORM_FACTOR`` a step at least, so it has an end, and a few
    doublings reach it. Each is a written table; only whether a pointer moved reaches the driver.
    """
    steps = staged(forms.select("id", F.col("form").alias("root")), "forms")
    while True:
        ahead = steps.select(F.col("id").alias("root"), F.col("root").alias("further"))
        steps = staged(steps.join(ahead, "root", "left").select(
            "id", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "forms")
        if steps.filter("moved").isEmpty():
            return steps.select("id", "root")
        steps = steps.select("id", "root")


def variants(docs: DataFrame, typo_mod: int = TYPO_MOD, min_length: int = MIN_LENGTH,
             min_count: int = MIN_COUNT, factor: int = FORM_FACTOR) -> DataFrame:
    """word, form, root, n, n_near, form_n of every long and frequent word of ``docs``.

    ``form`` is the near word of largest n (ties: the smallest in code-point order) if it has ``factor``
    times the word's occurrences, else null; ``root`` is where forms of forms lead, the word itself
    without a form. Repeated rows count as often as they occur; null and empty texts add nothing; an
    empty table, or one without frequent words, gives no rows. Other columns are not read.
    """
    counted = staged(word_counts(docs, typo_mod, min_length, min_count), "counted")
    # numbers that rise in code-point order; the table is written, so they never change
    words = staged(counted.repartitionByRange("word").sortWithinPartitions("word").select(
        F.monotonically_increasing_id().alias("id"), "word", "n"), "words")
    near = neighbours(words).groupBy("id").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    best = staged(words.select("id", "n").join(near, "id").select(
        "id", "n_near", F.when(-F.col("best.less") >= factor * F.col("n"), F.col("best.other")).alias("form"),
        (-F.col("best.less")).alias("form_n")), "best")
    forms = best.filter("form IS NOT NULL").select("id", "form", "form_n")
    spelt = words.select("id", "word")
    forms = forms.join(roots(forms), "id").join(spelt.toDF("form", "form_word"), "form").join(
        spelt.toDF("root", "root_word"), "root").select("id", F.col("form_word").alias("form"), "form_n",
                                                        F.col("root_word").alias("root"))
    return words.join(best.select("id", "n_near"), "id", "left").join(forms, "id", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


#: The same rows as plain SQL. DuckDB has no crc32, so it is written out: a table of byte steps,
#: folded over the bytes of ``<doc_id>:<run>``.
VARIANTS_SQL = r"""
WITH tab AS (SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(CAST(x AS BIGINT), range(8)),
               lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps),
occ AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS k
        FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents)
        GROUP BY 1, 2),
hexed AS (SELECT run, k, hex(encode(concat(doc_id, ':', run))) AS x FROM occ WHERE length(run) >= 6),
crc AS (SELECT run, k, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
            list_transform(range(0, length(x), 2), lambda i: CAST(
              (position(substr(x, CAST(i + 1 AS INT), 1) IN '0123456789ABCDEF') - 1) * 16
              + position(substr(x, CAST(i + 2 AS INT), 1) IN '0123456789ABCDEF') - 1 AS BIGINT))),
            lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM hexed, tab),
made AS (SELECT CASE WHEN h % 199 = 0 THEN concat(substr(run, 1, CAST(h % length(run) AS INT)),
            substr(run, CAST(h % length(run) AS INT) + 2)) ELSE run END AS word, k FROM crc),
w AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM made WHERE length(word) >= 6 GROUP BY 1 HAVING sum(k) >= 5),
cut AS (SELECT word, n, i, concat(substr(word, 1, CAST(i AS INT)), substr(word, CAST(i AS INT) + 2)) AS rest
        FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
near AS (SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
         UNION SELECT a.word, w.word, w.n FROM cut a JOIN w ON a.rest = w.word
         UNION SELECT w.word, a.word, a.n FROM cut a JOIN w ON a.rest = w.word),
best AS (SELECT word, other, other_n, count(*) OVER (PARTITION BY word) AS n_near,
         row_number() OVER (PARTITION BY word ORDER BY other_n DESC, encode(other)) AS r FROM near),
v AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * w.n THEN other END AS form,
      CASE WHEN other_n >= 5 * w.n THEN other_n END AS form_n FROM w LEFT JOIN best ON best.word = w.word AND r = 1),
chain AS (WITH RECURSIVE c AS (SELECT word, form AS root, 1 AS d FROM v WHERE form IS NOT NULL
          UNION ALL SELECT c.word, v.form, d + 1 FROM c JOIN v ON v.word = c.root WHERE v.form IS NOT NULL)
          SELECT word, arg_max(root, d) AS root FROM c GROUP BY 1)
SELECT v.word, v.form, coalesce(chain.root, v.word) AS root, v.n, v.n_near, v.form_n FROM v LEFT JOIN chain ON chain.word = v.word
"""
