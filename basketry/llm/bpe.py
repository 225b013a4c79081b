"""Byte-level BPE encoding and decoding with contiguous rank arrays.

A text is split at the special token, then by the vocabulary's pattern into short words. The words
of a batch that were not seen lately are encoded together: one array row a word holds the parts
between its boundaries, a second the rank of each adjacent pair. Again and again the least rank of
each row is found by a scan (the first of equal ones), its boundary deleted, and the two
neighbouring ranks refreshed, until no row has a mergeable pair. Numpy does each step for all words
of about one length at once. Words longer than ``LONG`` bytes keep their pairs in a heap instead,
so a long run stays n log n.

Vocabulary and merges are read from a public tokenizer file, given by path; nothing is trained.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from basketry.llm.common import slices

#: Fixed value: the split pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG = 64
#: Words kept in a worker's memory; beyond it the memory starts anew.
CACHE_WORDS = 300_000
#: New words encoded together, so the arrays stay small.
BLOCK_WORDS = 8192
#: Before a special token among the words; the pattern never joins a letter and a NUL in one word.
MARK = "\0a"
NONE = np.int32(2**31 - 1)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies, by rule: printable Latin-1
    stands for itself, the rest follow in order from code point 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Bpe:
    """Encoder and decoder of one byte-level vocabulary file."""

    def __init__(self, spec: dict):
        letters = byte_letters()
        model = spec["model"]
        to_bytes = lambda s: bytes(letters[c] for c in s)
        ids = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        size = max([*ids.values(), *self.special.values()]) + 1
        self.piece = [b""] * size
        for s, i in ids.items():
            if s not in self.special:
                self.piece[i] = to_bytes(s)
        for s, i in self.special.items():
            self.piece[i] = s.encode()
        self.byte_id = np.zeros(256, np.int32)
        for c, b in letters.items():
            self.byte_id[b] = ids[c]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([ids[a] for a, _ in merges], np.int64)
        right = np.array([ids[b] for _, b in merges], np.int64)
        self.merged = np.array([ids[a + b] for a, b in merges], np.int32)
        self.pairs = {}
        for rank, key in enumerate((left << 20 | right).tolist()):
            self.pairs.setdefault(key, rank)
        self._build_table(left, right)
        self.split = regex.compile(PATTERN)
        # no token is learnt here, only remembered: word -> its ids as little-endian bytes
        self.cache: dict[str, bytes] = {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("cache", "split")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.split, self.cache = regex.compile(PATTERN), {}

    def _build_table(self, left, right) -> None:
        """Pair -> rank by two-choice (cuckoo) hashing, so that a lookup is two reads."""
        bits = max(8, int(np.ceil(np.log2(max(1, len(left)) * 2.5))))
        self.shift = np.uint64(64 - bits)
        for seed in range(1, 200):
            self.mult = [np.uint64((0x9E3779B97F4A7C15 * (2 * seed + 1)) % 2**64),
                         np.uint64((0xC2B2AE3D27D4EB4F * (2 * seed + 1)) % 2**64)]
            keys = (left.astype(np.uint64) << np.uint64(20)) | right.astype(np.uint64)
            spots = [((keys * m) >> self.shift).astype(np.int64).tolist() for m in self.mult]
            where: list[dict[int, int]] = [{}, {}]
            if all(self._place(where, spots, rank) for rank in self.pairs.values()):
                break
        self.slot_key = np.full((2, 1 << bits), 2**63, np.uint64)
        self.slot_rank = np.full((2, 1 << bits), NONE, np.int32)
        for t in (0, 1):
            for at, rank in where[t].items():
                self.slot_key[t, at] = keys[rank]
                self.slot_rank[t, at] = rank

    @staticmethod
    def _place(where, spots, rank) -> bool:
        t = 0
        for _ in range(500):
            at = spots[t][rank]
            rank, where[t][at] = where[t].get(at), rank
            if rank is None:
                return True
            t = 1 - t
        return False

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of adjacent parts, NONE where no merge exists."""
        key = (left.astype(np.uint64) << np.uint64(20)) | right.astype(np.uint64)
        out = np.full(key.shape, NONE, np.int32)
        for t in (0, 1):
            at = (key * self.mult[t]) >> self.shift
            hit = self.slot_key[t][at] == key
            out[hit] = self.slot_rank[t][at[hit]]
        return out

    def encode_block(self, raw: list[bytes]) -> list[bytes]:
        """Ids of short words (at most LONG bytes each) of similar lengths, merged side by side."""
        n = len(raw)
        size = np.fromiter(map(len, raw), np.int64, n)
        width = int(size.max())
        parts = np.zeros((n, width + 1), np.int32)
        inside = np.arange(width + 1)[None, :] < size[:, None]
        parts[inside] = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        rank = np.full((n, width + 1), NONE, np.int32)
        pair = inside[:, 1:]
        rank[:, :-1][pair] = self.ranks(parts[:, :-1][pair], parts[:, 1:][pair])
        done = [b""] * n
        row = np.arange(n)                       # the words still being merged
        while len(row):
            at = rank.argmin(axis=1)
            line = np.arange(len(row))
            least = rank[line, at]
            over = least == NONE
            if over.any():
                held = np.arange(parts.shape[1])[None, :] < size[over][:, None]
                flat, to = parts[over][held].astype("<u4").tobytes(), 0
                for k, count in zip(row[over].tolist(), size[over].tolist(), strict=True):
                    done[k] = flat[to:to + 4 * count]
                    to += 4 * count
                go = ~over
                row, parts, rank, size, at, least = row[go], parts[go], rank[go], size[go], at[go], least[go]
                if not len(row):
                    break
                most = int(size.max()) + 1
                parts, rank = np.ascontiguousarray(parts[:, :most]), np.ascontiguousarray(rank[:, :most])
                line = np.arange(len(row))
            # delete the boundary behind part ``at``: what follows moves one place to the left
            move = np.arange(parts.shape[1] - 1)[None, :] > at[:, None]
            parts[:, :-1] = np.where(move, parts[:, 1:], parts[:, :-1])
            rank[:, :-1] = np.where(move, rank[:, 1:], rank[:, :-1])
            parts[line, at] = self.merged[least]
            size -= 1
            has = at + 1 < size
            new = np.full(len(row), NONE, np.int32)
            new[has] = self.ranks(parts[line[has], at[has]], parts[line[has], at[has] + 1])
            rank[line, at] = new
            has = at > 0
            rank[line[has], at[has] - 1] = self.ranks(parts[line[has], at[has] - 1], parts[line[has], at[has]])
        return done

    def encode_long(self, raw: bytes) -> bytes:
        """The same merges for one long word, pairs kept in a heap by (rank, place)."""
        part = self.byte_id[np.frombuffer(raw, np.uint8)].tolist()
        n = len(part)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        rank_of = self.pairs.get
        heap = [(r, i, part[i], part[i + 1]) for i in range(n - 1)
                if (r := rank_of(part[i] << 20 | part[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if part[i] != a or j < 0 or part[j] != b:
                continue                          # one of the parts has been merged meanwhile
            part[i], part[j] = int(self.merged[r]), -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (r := rank_of(part[x] << 20 | part[y])) is not None:
                    heapq.heappush(heap, (r, x, part[x], part[y]))
        return np.array([p for p in part if p >= 0], "<u4").tobytes()

    def learn(self, words: set[str]) -> None:
        """Encode the words that are not remembered, those of similar lengths together."""
        new = [(len(raw), w, raw) for w in words.difference(self.cache) for raw in (w.encode("utf-8"),)]
        new.sort(key=lambda x: x[0])
        for _, w, raw in (x for x in new if x[0] > LONG):
            self.cache[w] = self.encode_long(raw)
        short = [x for x in new if x[0] <= LONG]
        for k in range(0, len(short), BLOCK_WORDS):
            block = short[k:k + BLOCK_WORDS]
            for x, ids in zip(block, self.encode_block([raw for _, _, raw in block]), strict=True):
                self.cache[x[1]] = ids

    def words(self, text: str) -> list[str]:
        """Short words of a text; a special token comes out marked by MARK."""
        if not any(s in text for s in self.special):
            return self.split.findall(text)
        out: list[str] = []
        for k, piece in enumerate(regex.split("(" + "|".join(map(regex.escape, self.special)) + ")", text)):
            out += [MARK + piece] if k % 2 else self.split.findall(piece)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.words(t) for t in texts]
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        for s, i in self.special.items():
            self.cache[MARK + s] = np.array([i], "<u4").tobytes()
        self.learn(set(chain.from_iterable(split)))
        ids = self.cache.__getitem__
        return [b"".join(map(ids, words)) for words in split]

    def decode(self, ids: bytes) -> str:
        """Text of the ids, special tokens included; bytes that aren't UTF-8 become U+FFFD."""
        piece = self.piece
        return b"".join([piece[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


def load(path: str) -> Bpe:
    """Read a byte-level ``tokenizer.json`` of the driver's machine."""
    with open(path, encoding="utf-8") as f:
        return Bpe(json.load(f))


def round_trip(docs: DataFrame, bpe: Bpe, keep_ids: bool = False) -> DataFrame:
    """Encode each whole text, decode the ids, and return digests of both (and the ids if asked).

    Every row is kept. Null text counts as empty: no ids. Columns other than doc_id and text are
    not read.
    """
    model = docs.sparkSession.sparkContext.broadcast(bpe)  # one vocabulary file
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        bpe = model.value
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for part in slices(batches):
            ids = bpe.encode([t or "" for t in part.column("text").to_pylist()])
            columns = [part.column("doc_id"), pa.array([len(i) // 4 for i in ids], pa.int64()),
                       pa.array([sha(i) for i in ids], pa.string()),
                       pa.array([sha(bpe.decode(i).encode("utf-8")) for i in ids], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                ends = np.cumsum([0, *(len(i) // 4 for i in ids)])
                columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()),
                                                        pa.array(np.frombuffer(b"".join(ids), "<i4"))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(run, schema + (", ids array<int>" if keep_ids else ""))
