"""Benchmark decontamination with a generalised suffix automaton of the test items.

Items are normalised to words (A-Z lower-cased, words ``WORD``) and inserted, one after the other
from the root, into one automaton over words. A training text streams through it; the longest match
ending at each word is tracked. A match of at least ``window`` words holds a window of an item
whose last word is here; a short item (fewer words than a window) must be matched whole. Words that
no item uses reset the match, so only runs of item words long enough to hold a window are walked.

Items come in blocks of at most ``block_words`` words, one automaton each, so what is sent to the
executors has a fixed bound; a benchmark of more blocks passes the documents once a block and adds
up the spans. No document is shuffled.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import restored, slices, staged, texts_of, with_rest

#: Words of the lower-cased text, as bytes: runs of digits, letters and non-ASCII characters.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: bytes | None) -> list[bytes]:
    """Normalised words; bytes.lower() changes A-Z alone. Null has none."""
    return WORD.findall(text.lower()) if text else []


class ItemAutomaton:
    """Generalised suffix automaton of test items over word numbers."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = 13):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.trans: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.whole: dict[int, set[str]] = {}    # state -> short items that it spells
        self.ends: dict[int, set[str]] = {}     # state -> items with a window ending here
        items = [(i, w) for i, w in items if w]
        self.shortest = min((min(len(w), window) for _, w in items), default=0)
        marks: list[tuple[int, str]] = []
        for name, words in items:
            last = 0
            for n, w in enumerate(words, 1):
                last = self._extend(last, self.vocab.setdefault(w, len(self.vocab) + 1))
                if n >= window:
                    marks.append((last, name))
            if len(words) < window:
                self.whole.setdefault(last, set()).add(name)
        for state, name in marks:
            self.ends.setdefault(self._window_state(state), set()).add(name)
        # the nearest state on the way of suffix links that spells a short item
        self.short_link = [-1] * len(self.trans)
        for s in sorted(range(1, len(self.trans)), key=self.length.__getitem__):
            up = self.link[s]
            self.short_link[s] = up if up in self.whole else self.short_link[up]

    def _extend(self, last: int, c: int) -> int:
        trans, link, length = self.trans, self.link, self.length
        if c in trans[last]:
            q = trans[last][c]
            return q if length[q] == length[last] + 1 else self._split(last, c, q)
        cur = len(trans)
        trans.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in trans[p]:
            trans[p][c] = cur
            p = link[p]
        if p >= 0:
            q = trans[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, c, q)
        return cur

    def _split(self, p: int, c: int, q: int) -> int:
        """A copy of state q for the strings that end at p's next word alone."""
        trans, link = self.trans, self.link
        clone = len(trans)
        trans.append(dict(trans[q]))
        link.append(link[q])
        self.length.append(self.length[p] + 1)
        while p >= 0 and trans[p].get(c) == q:
            trans[p][c] = clone
            p = link[p]
        link[q] = clone
        return clone

    def _window_state(self, state: int) -> int:
        """The state that holds the last ``window`` words of what ``state`` spells."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def spans(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit spans [first, end) of word positions, merged, and the names of the items found."""
        if not self.shortest or len(words) < self.shortest:
            return [], set()
        number = self.vocab.get
        ids = [number(w, 0) for w in words]
        known = np.array(ids, dtype=bool)
        edge = np.flatnonzero(np.diff(np.concatenate([[False], known, [False]])))
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        trans, link, length, window = self.trans, self.link, self.length, self.window
        for begin, end in edge.reshape(-1, 2).tolist():
            if end - begin < self.shortest:
                continue
            state, match = 0, 0
            for i in range(begin, end):
                c = ids[i]
                while c not in trans[state] and state:
                    state = link[state]
                    match = length[state]
                state = trans[state].get(c, 0)
                match = match + 1 if state else 0
                if match < self.shortest:
                    continue
                longest = 0
                if match >= window:
                    found |= self.ends[self._window_state(state)]
                    longest = window
                s = state if state in self.whole and match >= length[state] else self.short_link[state]
                while s >= 0:
                    found |= self.whole[s]
                    longest = max(longest, length[s])
                    s = self.short_link[s]
                if longest:
                    first = i + 1 - longest
                    while spans and spans[-1][1] >= first:
                        first = min(first, spans.pop()[0])
                    spans.append((first, i + 1))
        return spans, found


def item_blocks(items: DataFrame, block_words: int):
    """Lists of (item_id, words) of at most ``block_words`` words, or of one item."""
    block, size = [], 0
    for row in items.select(F.col("item_id").cast("string"), F.col("text")).toLocalIterator():
        words = words_of(row["text"].encode() if row["text"] is not None else None)
        if block and size + len(words) > block_words:
            yield block
            block, size = [], 0
        block.append((str(row["item_id"]), words))
        size += len(words)
    yield block


_HITS = "array<struct<first:int,end:int>>"


def find_spans(docs: DataFrame, items: DataFrame, window: int = 13,
               block_words: int = 500_000) -> DataFrame:
    """Add n_words, hits (merged spans of word positions) and item_ids to ``docs``, whose further
    columns, if any, are in a struct ``rest``.

    Every row is kept, repeated rows and null ids too. Null or empty text has no words and no hits;
    an empty benchmark hits nothing. Items with the same text are all found; items without words are
    never found.
    """
    carry = [c for c in ("doc_id", "text", "rest") if c in docs.columns]
    out = docs.select(*carry, F.lit(0).cast("long").alias("n_words"),
                      F.array().cast(_HITS).alias("hits"),
                      F.array().cast("array<string>").alias("item_ids"))
    for k, block in enumerate(item_blocks(items, block_words)):
        model = docs.sparkSession.sparkContext.broadcast(ItemAutomaton(block, window))
        if k:
            out = staged(out, "decontam-block")

        def run(batches, model=model):
            automaton = model.value
            for part in slices(batches):
                counts, spans, names = [], [], []
                before = part.column("hits").to_pylist()
                for text, hits, ids in zip(texts_of(part.column("text")), before,
                                           part.column("item_ids").to_pylist(), strict=True):
                    words = words_of(text)
                    new, found = automaton.spans(words)
                    counts.append(len(words))
                    old = [(h["first"], h["end"]) for h in hits]
                    spans.append([{"first": a, "end": b} for a, b in merged(old + new)])
                    names.append(sorted({*ids, *found}))
                yield pa.RecordBatch.from_arrays(
                    [*map(part.column, carry), pa.array(counts, pa.int64()),
                     pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))),
                     pa.array(names, pa.list_(pa.string()))],
                    names=[*carry, "n_words", "hits", "item_ids"])

        out = out.mapInArrow(run, out.schema)
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def n_hit(hits: Column) -> Column:
    return F.aggregate(hits, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])


def contaminated(hit: Column, words: Column) -> Column:
    return (hit > 0) & (20 * hit >= words)


def report(docs: DataFrame, items: DataFrame, window: int = 13) -> DataFrame:
    """Per row of ``docs``: n_words, n_hit, n_items, items_sha256 and the verdict ``contaminated``
    (at least one word of twenty is hit)."""
    found = find_spans(docs.select("doc_id", "text"), items, window).select("doc_id", "n_words", n_hit(F.col("hits")).alias("n_hit"),
                                                   "hits", "item_ids")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids").cast("binary"), 256).alias("items_sha256"),
        contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
        "hits")


def cut_spans(text: str | None, spans: list[tuple[int, int]], min_words: int = 13) -> str | None:
    """``text`` without the hit spans of at least ``min_words`` words, from first to last word."""
    if text is None:
        return None
    raw = text.encode("utf-8")
    at = [m.span() for m in WORD.finditer(raw.lower())]
    out, done = [], 0
    for a, b in spans:
        if b - a >= min_words:
            out.append(raw[done:at[a][0]])
            done = at[b - 1][1]
    return b"".join([*out, raw[done:]]).decode("utf-8")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 13, max_share: float = 0.05) -> DataFrame:
    """(doc_id, text, hits, dropped, clean_text): drop a document whose hit share reaches
    ``max_share`` (clean_text null), else remove its hit spans of at least a window."""
    found = find_spans(docs.select("doc_id", "text"), items, window).drop("item_ids")
    share = n_hit(F.col("hits"))
    dropped = (share > 0) & (share >= F.col("n_words") * max_share)
    cut = F.udf(lambda t, s: cut_spans(t, [(x["first"], x["end"]) for x in s], window), "string")
    found = found.withColumn("dropped", dropped)
    return found.select("doc_id", "text", "hits", "dropped",
                        F.when(F.col("dropped"), None).when(F.size("hits") == 0, F.col("text"))
                        .otherwise(cut("text", "hits")).alias("clean_text"))


def uncontaminated(docs: DataFrame, items: DataFrame, window: int = 13) -> DataFrame:
    """The rows of ``docs``, all columns, of which less than one word of twenty is hit."""
    found = find_spans(with_rest(docs), items, window)
    return restored(found.filter(~contaminated(n_hit(F.col("hits")), F.col("n_words"))), docs)


#: DuckDB SQL for ``op2_decontaminate``: every window as an array of words, joined by equality.
REPORT_SQL = r"""
WITH d AS (SELECT doc_id, rowid_ AS r, w FROM (SELECT doc_id, row_number() OVER () AS rowid_,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents)),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, len(w) AS n, w, least(13, len(w)) AS k FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, list_slice(w, i, i + k - 1) AS x
        FROM (SELECT *, unnest(range(1, CAST(n - k + 2 AS BIGINT))) AS i FROM bw)),
ks AS (SELECT DISTINCT k FROM win),
dw AS (SELECT r, k, i, list_slice(w, i, i + k - 1) AS x
       FROM (SELECT r, w, k, unnest(range(1, CAST(len(w) - k + 2 AS BIGINT))) AS i FROM d, ks WHERE len(w) >= k)),
hit AS (SELECT dw.r, dw.i, dw.k, win.item_id FROM dw JOIN win ON dw.x = win.x AND dw.k = win.k),
pos AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hit) GROUP BY r),
its AS (SELECT r, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS s
        FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(pos.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(its.n, 0) AS BIGINT) AS n_items, sha256(coalesce(its.s, '')) AS items_sha256,
       coalesce(pos.n, 0) > 0 AND 20 * coalesce(pos.n, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
"""
