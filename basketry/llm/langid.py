"""Language ID by cross-parsing entropy.

A suffix automaton of labelled text is built per language. A text is parsed greedily into the
longest phrases that occur in that language's labelled text (Ziv-Merhav cross parsing); a language
that fits needs few, long phrases. Phrases are normalised to bits a character:
``phrases * log2(labelled characters) / characters``. The language needing fewest wins.

The automata become one dense transition table in which a missing transition leads to the state of
the restarted phrase, flagged, so a parse is one table lookup a character. Texts are cut into
pieces of ``PIECE`` characters that are parsed side by side with numpy, all languages at once; a
piece begins a phrase anew, which adds less than one phrase a piece to every language alike.

Only the automata are fitted on a bounded sample (``train_chars`` characters in total, at most
``docs_per_lang`` labelled documents a language and ``chars_per_doc`` characters of each); every
document is classified by its whole text.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketry.llm.common import id_bucket, restored, slices, with_rest

PIECE = 256
#: Letters that have a symbol of their own; of larger alphabets the rare letters have two.
DIRECT = 250
FLAG = 1 << 30
UNDETERMINED = "und"


def labelled_sample(docs: DataFrame, use: Column, docs_per_lang: int = 64,
                    chars_per_doc: int = 4000) -> DataFrame:
    """(lang, rank, text): the labelled texts with the smallest id hash, a bounded number a language."""
    order = Window.partitionBy("lang").orderBy("h", "doc_id", "text")
    return (docs.filter(use & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
            .select("lang", "doc_id", F.substring("text", 1, chars_per_doc).alias("text"),
                    F.xxhash64("doc_id").alias("h"))
            .withColumn("rank", F.row_number().over(order))
            .filter(F.col("rank") <= docs_per_lang)
            .select("lang", "rank", "text"))


def suffix_automaton(codes) -> tuple[list[dict], list[int], list[int]]:
    """Transitions, suffix links and longest lengths of the automaton of one code sequence."""
    trans, link, length = [{}], [-1], [0]
    last = 0
    for c in codes:
        cur = len(trans)
        trans.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in trans[p]:
            trans[p][c] = cur
            p = link[p]
        if p >= 0:
            q = trans[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(trans)
                trans.append(dict(trans[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and trans[p].get(c) == q:
                    trans[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return trans, link, length


def symbols_of(letters: list[str], direct: int = DIRECT) -> tuple[dict[str, tuple[int, ...]], int]:
    """Symbols of each letter, most frequent letters first, and the number of all symbols.

    Up to ``direct`` letters have a symbol each. Of more, as in large scripts, the rare ones have two, a
    first and a second digit, so no two letters share a code while the table stays narrow. Symbol 0 is what
    stands between words, the last one any letter not listed.
    """
    digits, single = 0, len(letters)
    if single > direct:
        digits = next((d for d in range(2, direct // 2 + 1) if direct - 2 * d + d * d >= len(letters)),
                      math.isqrt(len(letters)) + 1)
        single = max(0, direct - 2 * digits)
    out = {c: (i + 1,) for i, c in enumerate(letters[:single])}
    for i, c in enumerate(letters[single:]):
        out[c] = (single + 1 + i // digits, single + 1 + digits + i % digits)
    return out, single + 2 * digits + 2


class CrossParser:
    """Dense tables of the languages' automata, and the parse of many texts at once."""

    def __init__(self, samples: dict[str, list[str]], train_chars: int):
        self.langs = sorted(samples)
        each = max(1, train_chars // max(1, len(self.langs)))
        seen = Counter(c for texts in samples.values() for t in texts for c in t.lower() if c.isalpha())
        self.classes, self.width = symbols_of([c for c, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))])
        tables, roots, self.log_len, base = [], [], [], 0
        for lang in self.langs:
            codes: list[int] = []
            for t in samples[lang]:
                codes += [-1, *self._codes_of(t)]                 # -1 joins texts, never asked for
                if len(codes) >= each:
                    break
            codes = codes[:each]
            trans, _, _ = suffix_automaton(codes)
            # the row of state s begins at base + s * width; a missing entry restarts the phrase
            restart = np.full(self.width, base | FLAG, np.int64)
            for c, to in trans[0].items():
                if c >= 0:
                    restart[c] = (base + to * self.width) | FLAG
            rows = np.tile(restart, (len(trans), 1))
            for s, out in enumerate(trans):
                for c, to in out.items():
                    if c >= 0:
                        rows[s, c] = base + to * self.width
            # the root's own row: a phrase begins, so every step from it is flagged
            rows[0] = restart
            tables.append(rows.astype(np.int32).ravel())
            roots.append(base)
            self.log_len.append(math.log2(max(2, len(codes))))
            base += rows.size
        self.table = np.concatenate(tables) if tables else np.zeros(0, np.int32)
        self.roots = np.array(roots, np.int32)
        if self.table.size >= FLAG:
            raise ValueError("train_chars is too large for the transition table")

    def _codes_of(self, text: str) -> list[int]:
        out, last = [], 0
        for c in text.lower():
            codes = self.classes.get(c, (self.width - 1,)) if c.isalpha() else (0,)
            if codes[0] or last:
                out.extend(codes)
            last = codes[0]
        return out

    def lookup(self) -> np.ndarray:
        """First and second symbol of every code point, 0 for none; built once in a worker."""
        if not hasattr(self, "_lookup"):
            alpha = np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000)
            table = np.zeros((2, 0x110000), np.uint16)
            table[0] = np.where(alpha, self.width - 1, 0)
            for c, k in self.classes.items():
                table[:len(k), ord(c)] = k
            self._lookup = table
        return self._lookup

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_lookup"}

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Characters of each normalised text, and phrases by language and text."""
        low = [t.lower() for t in texts]
        sizes = np.fromiter(map(len, low), np.int64, len(low))
        points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = self.lookup()[0][points]
        owner = np.repeat(np.arange(len(low)), sizes)
        keep = codes != 0
        if keep.size:
            keep[1:] |= (codes[:-1] != 0) & (owner[1:] == owner[:-1])
        codes, owner = codes[keep], owner[keep]
        n_chars = n_codes = np.bincount(owner, minlength=len(low))
        second = self.lookup()[1][points[keep]]
        if second.any():
            at = np.cumsum(1 + (second > 0)) - 1 - (second > 0)
            wide = np.zeros(len(codes) + np.count_nonzero(second), codes.dtype)
            wide[at] = codes
            wide[at[second > 0] + 1] = second[second > 0]
            codes, owner = wide, np.repeat(owner, 1 + (second > 0))
            n_codes = np.bincount(owner, minlength=len(low))
        starts = np.concatenate([[0], np.cumsum(n_codes)[:-1]])
        pieces = -(-n_codes // PIECE)
        of = np.repeat(np.arange(len(low)), pieces)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = starts[of] + nth * PIECE
        size = np.minimum(n_codes[of] - nth * PIECE, PIECE)
        order = np.argsort(-size, kind="stable")
        begin, size, of = begin[order], size[order], of[order]
        found = np.zeros((len(self.langs), len(of)), np.int32)
        state = np.repeat(self.roots[:, None], len(of), axis=1)
        active = np.searchsorted(-size, -np.arange(PIECE), side="left")  # pieces longer than t
        for t in range(int(size[0]) if len(size) else 0):
            m = active[t]
            step = self.table.take(state[:, :m] + codes[begin[:m] + t])
            found[:, :m] += step >> 30
            state[:, :m] = step & (FLAG - 1)
        total = np.zeros((len(self.langs), len(low)), np.int64)
        for k in range(len(self.langs)):
            total[k] = np.bincount(of, weights=found[k], minlength=len(low)).astype(np.int64)
        return n_chars, total


def fit(sample: DataFrame, train_chars: int = 160_000) -> CrossParser:
    """Build the automata from the bounded sample (it is at most ``docs_per_lang`` rows a language)."""
    by_lang: dict[str, list[str]] = {}
    for row in sample.orderBy("lang", "rank").toLocalIterator():
        by_lang.setdefault(row["lang"], []).append(row["text"])
    return CrossParser(by_lang, train_chars)


def classify(docs: DataFrame, parser: CrossParser) -> DataFrame:
    """Add lang_pred, score and bits_per_char to every row of ``docs``, duplicates included.

    ``docs`` has text, and other columns that are carried. Null text, text without a letter, or no labelled
    language gives ``und`` with score 0. The score is the runner-up's share of the two fewest
    phrase counts, 0.5 (a tie, taken by the first language in order) to 1.
    """
    model = docs.sparkSession.sparkContext.broadcast(parser)  # bounded by train_chars
    def run(batches):
        cp = model.value
        bits = np.array(cp.log_len)[:, None]
        for part in slices(batches):
            texts = [t or "" for t in part.column("text").to_pylist()]
            n_chars, found = cp.phrases(texts)
            alpha = cp.lookup()[0]
            if cp.langs:
                cost = found * bits
                best = cost.argmin(axis=0)
                first = cost.min(axis=0)
                second = (np.partition(cost, 1, axis=0)[1] if len(cp.langs) > 1 else first + bits[0])
            else:
                best = first = second = np.zeros(len(texts), int)
            langs, scores, rates = [], [], []
            for k, text in enumerate(texts):
                if not cp.langs or not n_chars[k] or not any(map(alpha.__getitem__, map(ord, text))):
                    langs.append(UNDETERMINED)
                    scores.append(0.0)
                    rates.append(None)
                else:
                    langs.append(cp.langs[best[k]])
                    scores.append(float(second[k] / max(first[k] + second[k], 1e-9)))
                    rates.append(float(first[k] / n_chars[k]))
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()),
                 pa.array(rates, pa.float64())],
                names=[*part.schema.names, "lang_pred", "score", "bits_per_char"])

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType()), T.StructField("bits_per_char", T.DoubleType())])
    return docs.mapInArrow(run, schema)


def learn(docs: DataFrame, train_chars: int) -> tuple[CrossParser, Column]:
    """The parser learned from labelled rows outside the held-out quarter, and the held-out test."""
    held = id_bucket(F.col("doc_id"), 4) == 2
    return fit(labelled_sample(docs.select("doc_id", "text", "lang"), ~held), train_chars), held


def identify(docs: DataFrame, train_chars: int = 160_000) -> DataFrame:
    """Learn from rows with a label outside the held-out quarter and classify all rows of ``docs``."""
    parser, held = learn(docs, train_chars)
    return classify(docs.select("doc_id", held.alias("held_out"), "text"), parser).drop("text")


def determined(docs: DataFrame, train_chars: int = 160_000) -> DataFrame:
    """The rows of ``docs``, all columns, whose language can be told; texts without a letter go. Where no
    row is labelled, nothing can be learnt, and all texts with a letter stay."""
    parser, _ = learn(docs, train_chars)
    if not parser.langs:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    return restored(classify(with_rest(docs), parser).filter(F.col("lang_pred") != UNDETERMINED), docs)
