"""Exact substring dedup with suffix arrays built by two-stage sorting.

A byte is removed if a 50-byte string over it also starts in a document with a smaller id. Equal
50-byte windows have to meet in one place without shuffling a suffix for every byte:

1. Documents are packed into blocks of about ``BLOCK`` bytes, one row a block, in a table bucketed by
   block, so later joins with it move the other side alone.
2. Every window has one anchor, the 20-byte string of least hash inside it; equal windows have equal
   anchors. Each block sends its distinct anchors' hashes; those met in another block, or in two
   documents of one block, are marked. Anything else can't hold a repeat.
3. The bytes of the windows around a marked anchor go to the anchor's group, one copy for each block
   and distinct string: copies within a block are pre-aggregated, so a passage in a third of all
   documents costs one string a block. An anchor with more strings than a group should hold (a common
   phrase with other text around it) is split: each of its windows goes, alone, to the group of the
   hash of its 50 bytes, where all windows equal to it go too.
4. A group sorts its window suffixes in two stages: suffixes that don't exceed their successor are
   sorted directly; the rest are induced by one scan over the buckets by first byte, each bucket's
   sorted suffixes placing those before them. Adjacent common prefixes of 50 bytes then give the
   classes of equal windows, and those of a document that isn't the class's smallest are removed.
5. The verdicts go back to the blocks, which cut the bytes.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import staged, texts_of
from basketry.session import scratch_path

SPAN, ANCHOR = 50, 20
BLOCK = 2 << 20
#: Bytes of text for each anchor group, about.
GROUP = 4 << 20
PART = 1 << 17
#: Distinct strings of an anchor in a block from which they are counted one by one.
MANY = 4
_P = 0x9E3779B97F4A7C15
_PLACE = np.uint64((1 << 20) - 1)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_P, n, 1 << 64))


def anchor_hashes(x: np.ndarray) -> np.ndarray:
    """Hash of the 20-byte string at every place of ``x`` (the last 19 places have none)."""
    h1 = x.astype(np.uint64) + np.uint64(1)
    h2 = h1[:-1] * _power(1) + h1[1:]
    h4 = h2[:-2] * _power(2) + h2[2:]
    h8 = h4[:-4] * _power(4) + h4[4:]
    h16 = h8[:-8] * _power(8) + h8[8:]
    return _mixed(h16[:len(x) - ANCHOR + 1] * _power(4) + h4[16:])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def anchor_runs(x: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Windows of a block grouped by anchor: (first window, windows, text number, anchor hash).

    ``starts`` and ``ends`` bound the texts inside ``x``; windows never cross texts.
    """
    first, place = run_heads(x, starts, ends)
    return runs_from(x, starts, ends, first, place)


def run_heads(x: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first window, place of the anchor) of each run of windows that share one."""
    out = [[], []]
    width = SPAN - ANCHOR + 1
    last = np.full(len(x), -1, np.int64)   # last window start of the text at each place, or -1
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        if b - a >= SPAN:
            last[a:b] = b - SPAN
    number = np.repeat(np.arange(len(starts)), ends - starts)
    for a in range(0, max(0, len(x) - SPAN + 1), PART):
        piece = x[a:a + PART + SPAN - 1]
        h = anchor_hashes(piece)
        m = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
        for step in (1, 2, 4, 8):
            m = np.minimum(m[:-step], m[step:])
        m = np.minimum(m[:len(h) - width + 1], m[15:15 + len(h) - width + 1])  # 16 + 15 places
        window = np.arange(a, a + len(m))
        good = np.flatnonzero(window <= last[a:a + len(m)])
        if not len(good):
            continue
        place = (m[good] & _PLACE).astype(np.int64)
        of = number[a + good]
        new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (of[1:] != of[:-1])]))
        out[0].append(good[new] + a)
        out[1].append(place[new] + a)
    if not out[0]:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in out)


def runs_from(x, starts, ends, first, place):
    """(first window, windows, text number, anchor hash) from a block's run heads: a run goes on to the
    next one or to its text's last window, and only the anchors themselves are hashed."""
    text = np.searchsorted(starts, first, "right") - 1
    behind = np.append(first[1:], len(x))
    count = np.minimum(behind, ends[text] - SPAN + 1) - first if len(first) else first
    h = np.zeros(len(first), np.uint64)
    for k in range(ANCHOR):
        h = h * _power(1) + x[place + k] + np.uint64(1)
    return first, count, text, _mixed(h)


class Block:
    """Texts of one block row, in the order of their ids; those without an id come last."""

    def __init__(self, row: dict):
        self.raw = zlib.decompress(row["raw"])
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.named = np.frombuffer(row["named"], np.uint8).astype(bool)
        size = np.frombuffer(row["sizes"], np.int64)
        self.ends = np.cumsum(size)
        self.starts = self.ends - size
        self.x = np.frombuffer(self.raw, np.uint8)
        starts, ends = self.starts[self.named], self.ends[self.named]
        if "heads" in row:  # found when the block was packed
            first = np.flatnonzero(np.unpackbits(np.frombuffer(row["heads"], np.uint8), count=len(self.x)))
            place = first + np.frombuffer(row["anchors"], np.uint8)
            self.runs = runs_from(self.x, starts, ends, first, place)
        else:
            self.runs = anchor_runs(self.x, starts, ends)

    def keys(self, groups: int):
        """By group: (group, sorted distinct hashes, whether two texts of the block have them)."""
        _, _, text, h = self.runs
        order = np.lexsort((text, h))
        h, text = h[order], text[order]
        new = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
        several = np.zeros(int(new.sum()), bool)
        place = np.cumsum(new) - 1
        if len(h):
            several[place[1:][(~new[1:]) & (text[1:] != text[:-1])]] = True
        h = h[new]
        group = group_of(h, groups)
        order = np.argsort(group, kind="stable")
        cut = np.flatnonzero(np.diff(group[order])) + 1
        return [(int(group[i[0]]), h[i], several[i]) for i in np.split(order, cut) if len(i)]

    def many(self) -> dict[int, int]:
        """Distinct strings around each anchor that has ``MANY`` or more."""
        first, count, _, h = self.runs
        order = np.argsort(h, kind="stable")
        new = np.concatenate([[True], np.diff(h[order]) != 0]) if len(h) else np.zeros(0, bool)
        edge, out = np.flatnonzero(new), {}
        for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(h)], strict=False):
            if b - a >= MANY:
                n = len({self.raw[first[k]:first[k] + count[k] + SPAN - 1] for k in order[a:b]})
                if n >= MANY:
                    out[int(h[order[a]])] = n
        return out

    def snippets(self, groups: int, marks: list):
        """Marked runs, those of split anchors by window: (first window, windows, string number, owner) of each, and the distinct
        strings as (bytes, windows, id of the first text, anchor group)."""
        first, count, text, h = self.runs
        of = [(keys, m) for (g, keys, _) in self.keys(groups) if (m := marks.get(g)) is not None]
        marked = [keys[np.unpackbits(np.frombuffer(m, np.uint8), count=len(keys)).astype(bool)] for keys, m in of]
        split = [keys[np.unpackbits(np.frombuffer(m, np.uint8)[(len(keys) + 7) // 8:], count=len(keys)).astype(bool)]
                 for keys, m in of if len(m) > (len(keys) + 7) // 8]
        marked = np.sort(np.concatenate(marked)) if marked else np.zeros(0, np.uint64)
        if not len(marked):
            return (first[:0], count[:0], first[:0], first[:0]), []
        at = np.minimum(np.searchsorted(marked, h), len(marked) - 1)
        keep = marked[at] == h
        first, count, text, h = first[keep], count[keep], text[keep], h[keep]
        alone = np.isin(h, np.concatenate(split)) if split else np.zeros(len(h), bool)
        if alone.any():
            n = np.where(alone, count, 1)
            within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            first, text, h = np.repeat(first, n) + within, np.repeat(text, n), np.repeat(h, n)
            count, alone = np.repeat(np.where(alone, 1, count), n), np.repeat(alone, n)
        known: dict[bytes, int] = {}
        strings, which = [], np.zeros(len(first), np.int64)
        ids = self.ids[self.named]
        group = group_of(h, groups)
        raw = self.raw
        for k, (a, n, t) in enumerate(zip(first.tolist(), count.tolist(), text.tolist(), strict=True)):
            s = raw[a:a + n + SPAN - 1]
            j = known.setdefault(s, len(strings))
            if j == len(strings):
                g = xxhash.xxh3_64_intdigest(s) % groups if alone[k] else int(group[k])
                strings.append((s, n, int(ids[t]), g))
            which[k] = j
        return (first, count, which, ids[text]), strings


def group_of(h: np.ndarray, groups: int) -> np.ndarray:
    return ((h >> np.uint64(24)) % np.uint64(groups)).astype(np.int64)


def by_words(places: np.ndarray, word: np.ndarray) -> np.ndarray:
    """``places`` in the order of the 56 bytes from each, eight at a time: only ties look at the next."""
    key = word[places]
    order = np.argsort(key)
    key, places = key[order], places[order]
    new = np.ones(len(places), bool)
    new[1:] = key[1:] != key[:-1]
    for d in (8, 16, 24, 32, 40, 48):
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        key = word[places[at] + d]
        order = np.argsort(key)
        step = np.ones(len(at), np.int64)
        step[1:] = key[order[1:]] != key[order[:-1]]
        rank = np.empty(len(at), np.int64)
        rank[order] = np.cumsum(step)
        key = np.cumsum(new[at]) * (len(at) + 1) + rank  # tie first, then the next eight bytes
        order = np.argsort(key)
        key = key[order]
        places[at] = places[at][order]
        new[at[1:]] |= key[1:] != key[:-1]
    return places


def two_stage_order(x: np.ndarray, wanted: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Places of ``wanted`` (ascending) in the order of their suffixes, to 50 bytes.

    Stage one sorts the suffixes whose first byte doesn't exceed the next. A suffix whose first byte
    exceeds the next starts behind its successor, whose bucket comes earlier: stage two scans the
    buckets in order and places the predecessors. ``wanted`` must hold the successor of each place
    of the second kind. ``word[i]`` holds the eight bytes from i, big-endian.
    """
    head, nxt = x[wanted], x[wanted + 1]
    direct = wanted[head <= nxt]
    direct = by_words(direct, word)
    induced = np.zeros(len(x) + 1, bool)
    induced[wanted[head > nxt]] = True
    split = np.searchsorted(x[direct], np.arange(257))
    buckets: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in range(256):
        bucket = np.concatenate([*buckets[c], direct[split[c]:split[c + 1]]])
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[induced[before]]
        if len(before):
            byte = x[before]
            order = np.argsort(byte, kind="stable")
            before, byte = before[order], byte[order]
            cut = np.flatnonzero(np.diff(byte)) + 1
            for part in np.split(before, cut):
                buckets[x[part[0]]].append(part)
    return np.concatenate(out) if out else wanted


def eight_bytes(x: np.ndarray) -> np.ndarray:
    word = np.zeros(len(x), np.uint64)
    for d in range(8):
        word[:len(x) - d] |= x[d:].astype(np.uint64) << np.uint64(56 - 8 * d)
    return word


def repeated_windows(strings: list[bytes], counts: np.ndarray, ids: np.ndarray) -> list[np.ndarray]:
    """For each string, which of its first ``counts`` windows also occur with a smaller id."""
    size = np.fromiter(map(len, strings), np.int64, len(strings))
    gone = windows_gone(np.frombuffer(b"".join(strings), np.uint8), size, counts, ids)
    return np.split(gone, np.cumsum(counts)[:-1]) if len(strings) else []


def windows_gone(raw: np.ndarray, size: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The same for strings of the given sizes, one behind the other; all their windows in that order."""
    # 255 is in no UTF-8 text: behind each string, it makes the string's last byte a direct place
    x = np.full(len(raw) + len(size) + 64, 255, np.uint8)
    x[len(raw) + len(size):] = 0
    x[np.arange(len(raw)) + np.repeat(np.arange(len(size)), size)] = raw
    starts = np.cumsum(size + 1) - size - 1
    ends = starts + size
    # sorted: the windows, and the places behind the last one up to a direct one
    step = x[:-1] > x[1:]
    direct_at = np.flatnonzero(~step)
    last = np.minimum(direct_at[np.searchsorted(direct_at, starts + counts - 1)], ends - 1)
    n = last - starts + 1
    wanted = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts, n)
    owner = np.repeat(np.arange(len(size)), n)
    word = eight_bytes(x)
    order = two_stage_order(x, wanted, word)
    place = np.zeros(len(x), np.int64)
    place[wanted] = np.arange(len(wanted))
    line = place[order]
    real = order - starts[owner[line]] < counts[owner[line]]
    order, line = order[real], line[real]
    same = np.ones(max(0, len(order) - 1), bool)     # common prefix with the next is 50 bytes
    for d in (0, 8, 16, 24, 32, 40, 42):
        at = np.flatnonzero(same)
        same[at] = word[order[at] + d] == word[order[at + 1] + d]
    head = np.flatnonzero(np.concatenate([[True], ~same])) if len(order) else np.zeros(0, np.int64)
    mine = ids[owner[line]]
    least = np.minimum.reduceat(mine, head) if len(head) else mine
    flags = np.zeros(len(x), bool)
    flags[order] = mine > np.repeat(least, np.diff(np.append(head, len(order))))
    return flags[np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))]


_BLOCK = "raw binary, ids binary, named binary, sizes binary, heads binary, anchors binary"


def pack(docs: DataFrame, block_bytes: int) -> DataFrame:
    """Block rows of consecutive texts, sorted by id within a block. Null text is empty."""
    def run(batches):
        now, size = [], 0

        def row():
            now.sort(key=lambda r: (r[0] is None, r[0] or 0))
            raw = b"".join(t for _, t in now)
            x = np.frombuffer(raw, np.uint8)
            ends = np.cumsum([len(t) for i, t in now if i is not None], dtype=np.int64)  # rows without an id lie behind
            first, place = run_heads(x, np.append(0, ends)[:-1], ends)
            heads = np.zeros(len(x), bool)
            heads[first] = True
            return pa.RecordBatch.from_arrays(
                [pa.array([zlib.compress(raw, 1)], pa.binary()),
                 pa.array([np.array([i or 0 for i, _ in now], np.int64).tobytes()], pa.binary()),
                 pa.array([np.array([i is not None for i, _ in now], np.uint8).tobytes()], pa.binary()),
                 pa.array([np.array([len(t) for _, t in now], np.int64).tobytes()], pa.binary()),
                 pa.array([np.packbits(heads).tobytes()], pa.binary()),
                 pa.array([(place - first).astype(np.uint8).tobytes()], pa.binary())],
                names=["raw", "ids", "named", "sizes", "heads", "anchors"])

        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                for i, t in zip(part.column("doc_id").to_pylist(), texts_of(part.column("text")), strict=True):
                    now.append((i, t or b""))
                    size += len(t or b"") + 1
                    if size >= block_bytes:
                        yield row()
                        now, size = [], 0
        if now:
            yield row()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _BLOCK)


def bucketed(blocks: DataFrame, n: int) -> tuple[DataFrame, str]:
    """Write the blocks, numbered, as a table bucketed by block in shared scratch."""
    spark = blocks.sparkSession
    name = f"suffix_blocks_{uuid.uuid4().hex[:12]}"
    blocks.withColumn("block", F.monotonically_increasing_id()).write.option(
        "path", scratch_path(spark, name)).option("compression", "uncompressed").bucketBy(n, "block").saveAsTable(name)
    return spark.table(name), name


def _rows(batches, columns):
    for batch in batches:
        for k in range(batch.num_rows):
            yield {c: batch.column(c)[k].as_py() for c in columns}


_PACKED = ("block", "raw", "ids", "named", "sizes", "heads", "anchors")


def _send_keys(groups):
    def run(batches):
        for row in _rows(batches, _PACKED):
            block = Block(row)
            keys, many = block.keys(groups), block.many()
            wide = np.sort(np.fromiter(many, np.uint64, len(many)))

            def counted(h, wide=wide, many=many):
                k = np.flatnonzero(np.isin(h, wide))
                return np.array([(i, many[int(h[i])]) for i in k.tolist()], np.int64).tobytes()
            for a in range(0, len(keys), 64):
                some = keys[a:a + 64]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["block"]] * len(some), pa.int64()), pa.array([g for g, _, _ in some], pa.int32()),
                     pa.array([_short(h) for _, h, _ in some], pa.binary()),
                     pa.array([np.packbits(s).tobytes() for _, _, s in some], pa.binary()),
                     pa.array([counted(h) for _, h, _ in some], pa.binary())],
                    names=["block", "g", "keys", "several", "many"])
    return run


def _short(h: np.ndarray) -> bytes:
    """Six bytes of each hash; a chance meeting only marks an anchor in vain."""
    return h.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _mark_keys(table: pa.Table, limit: int) -> pa.Table:
    """Bitmap, for each block's keys of a group, of those that another text has too; behind it, if
    there are any, one of those with more than ``limit`` strings in all blocks, by the counts sent and
    ``MANY - 1`` for a block that sent none."""
    blobs = [np.frombuffer(b, np.uint8).reshape(-1, 6) for b in table.column("keys").to_pylist()]
    wide = np.zeros((sum(map(len, blobs)), 8), np.uint8)
    wide[:, :6] = np.concatenate(blobs)
    _, where, times = np.unique(wide.view(np.uint64).ravel(), return_inverse=True, return_counts=True)
    shared, at, out = times[where] > 1, 0, []
    strings = times * (MANY - 1)
    for blob, many in zip(blobs, table.column("many").to_pylist(), strict=True):
        k, n = np.frombuffer(many, np.int64).reshape(-1, 2).T
        np.add.at(strings, where[at + k], n)
        at += len(blob)
    split, at = (strings > limit)[where], 0
    for blob, several in zip(blobs, table.column("several").to_pylist(), strict=True):
        n = len(blob)
        local = np.unpackbits(np.frombuffer(several, np.uint8), count=n).astype(bool)
        hot = split[at:at + n]
        out.append(np.packbits(shared[at:at + n] | local).tobytes() + (np.packbits(hot).tobytes() if hot.any() else b""))
        at += n
    return pa.Table.from_arrays([table.column("block"), table.column("g"), pa.array(out, pa.binary())],
                                names=["block", "g", "mark"])


def _marks(row) -> dict:
    return {m["g"]: m["mark"] for m in row["marks"] or ()}


def _send_strings(groups):
    def run(batches):
        for row in _rows(batches, (*_PACKED, "marks")):
            _, strings = Block(row).snippets(groups, _marks(row))
            count, ids, group = (np.fromiter((x[i] for x in strings), np.int64, len(strings)) for i in (1, 2, 3))
            order = np.argsort(group, kind="stable")
            cut = np.flatnonzero(np.diff(group[order])) + 1
            todo = np.split(order, cut) if len(order) else []
            for a in range(0, len(todo), 64):
                some = todo[a:a + 64]
                packed = lambda column, kind: pa.array([column[ks].astype(kind).tobytes() for ks in some], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["block"]] * len(some), pa.int64()), pa.array([int(group[ks[0]]) for ks in some], pa.int32()),
                     pa.array([ks.astype(np.int32).tobytes() for ks in some], pa.binary()),
                     packed(count, np.int32), packed(ids, np.int64),
                     pa.array([b"".join([strings[k][0] for k in ks.tolist()]) for ks in some], pa.binary())],
                    names=["block", "g", "which", "counts", "ids", "bytes"])
    return run


def _gone_of(raw: bytes, counts: np.ndarray, ids: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """``windows_gone`` with equal strings sorted once: all windows of one whose equal has a smaller id
    are gone, and the least id decides for the others."""
    size = counts + SPAN - 1
    known: dict[bytes, int] = {}
    which, at = np.empty(len(counts), np.int64), 0
    for k, n in enumerate(size.tolist()):
        which[k] = known.setdefault(raw[at:at + n], len(known))
        at += n
    least = np.full(len(known), np.iinfo(np.int64).max)
    np.minimum.at(least, which, ids)
    one = np.fromiter(map(len, known), np.int64, len(known))
    single = windows_gone(np.frombuffer(b"".join(known), np.uint8), one, one - SPAN + 1, least)
    first = np.cumsum(one - SPAN + 1) - (one - SPAN + 1)
    place = np.repeat(first[which] - begin, counts) + np.arange(int(counts.sum()))
    return single[place] | np.repeat(ids > least[which], counts)


def _judge(table: pa.Table) -> pa.Table:
    """Verdicts of one group: strings with repeated windows, as (which, bits), by block."""
    cells = {c: table.column(c).to_pylist() for c in ("block", "which", "counts", "ids", "bytes")}
    which = [np.frombuffer(w, np.int32) for w in cells["which"]]
    counts = np.frombuffer(b"".join(cells["counts"]), np.int32).astype(np.int64)
    begin = np.cumsum(counts) - counts
    gone = _gone_of(b"".join(cells["bytes"]), counts, np.frombuffer(b"".join(cells["ids"]), np.int64), begin)
    del cells["bytes"]
    hit = np.logical_or.reduceat(gone, begin) if len(counts) else np.zeros(0, bool)
    # the bits of each string fill whole bytes
    wide = (counts + 7) // 8
    bits = np.zeros(8 * int(wide.sum()), bool)
    bits[np.repeat(8 * (np.cumsum(wide) - wide) - begin, counts) + np.arange(len(gone))] = gone
    packed, edge = np.packbits(bits), np.append(0, np.cumsum(wide))
    blocks, out_which, out_bits, at = [], [], [], 0
    for block, some in zip(cells["block"], which, strict=True):
        end = at + len(some)
        if hit[at:end].any():
            blocks.append(block)
            out_which.append(some[hit[at:end]].tobytes())
            out_bits.append(packed[edge[at]:edge[end]][np.repeat(hit[at:end], wide[at:end])].tobytes())
        at = end
    return pa.Table.from_arrays([pa.array(blocks, pa.int64()), pa.array(out_which, pa.binary()),
                                 pa.array(out_bits, pa.binary())], names=["block", "which", "bits"])


def _cut(groups, keep_text: bool):
    def run(batches):
        for row in _rows(batches, (*_PACKED, "marks", "verdicts")):
            block = Block(row)
            (first, count, which, ids), strings = block.snippets(groups, _marks(row))
            bits = {}
            for v in row["verdicts"] or ():
                at = 0
                for k in np.frombuffer(v["which"], np.int32).tolist():
                    n = strings[k][1]
                    size = (n + 7) // 8
                    bits[k] = np.unpackbits(np.frombuffer(v["bits"][at:at + size], np.uint8), count=n).astype(bool)
                    at += size
            owner = np.fromiter((s[2] for s in strings), np.int64, len(strings))
            copies = ids > owner[which] if len(strings) else np.zeros(0, bool)  # a smaller id of this block has it
            edges = np.bincount(first[copies], minlength=len(block.x) + 1)
            edges -= np.bincount((first + count)[copies], minlength=len(block.x) + 1)
            gone = np.cumsum(edges)                      # windows removed, by start
            for k in np.flatnonzero(~copies).tolist() if bits else ():
                if (b := bits.get(int(which[k]))) is not None:
                    gone[first[k]:first[k] + count[k]] |= b
            total = np.concatenate([[0], np.cumsum(gone[:-1])])
            low = np.maximum(np.arange(1, len(block.x) + 1) - SPAN, 0)
            covered = total[1:] - total[low] > 0
            out = [[], [], [], [], []]
            for a, b, i, named in zip(block.starts.tolist(), block.ends.tolist(), block.ids.tolist(),
                                      block.named.tolist(), strict=True):
                c = covered[a:b]
                kept = block.x[a:b][~c].tobytes() if c.any() else block.raw[a:b]
                edge = int(c[0]) + int(np.count_nonzero(c[1:] & ~c[:-1])) if b > a else 0
                for column, value in zip(out, (i if named else None, b - a, b - a - len(kept), edge,
                                               kept if keep_text else hashlib.sha256(kept).hexdigest()), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in out[:4]] + [pa.array(out[4], pa.binary() if keep_text else pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept" if keep_text else "kept_sha256"])
    return run


def dedup_substrings(docs: DataFrame, keep_text: bool = False, block_bytes: int = BLOCK,
                     group_bytes: int = GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 (or the ``kept`` bytes) of every row.

    Rows with equal ids don't remove each other; a row without an id neither removes nor loses
    anything. Null text is empty; a text under 50 bytes stays whole. Bytes, not characters, are cut,
    so ``kept`` may end within a character.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-size // group_bytes))
    buckets = max(1, min(-(-size // (8 * block_bytes)), 20_000))
    blocks, name = bucketed(pack(docs, block_bytes), buckets)
    keys = blocks.mapInArrow(_send_keys(groups), "block long, g int, keys binary, several binary, many binary")
    limit = group_bytes // (2 * SPAN)

    def mark(table: pa.Table) -> pa.Table:
        return _mark_keys(table, limit)

    marks = staged(keys.groupBy("g").applyInArrow(mark, "block long, g int, mark binary"), "marks")
    by_block = marks.groupBy("block").agg(F.collect_list(F.struct("g", "mark")).alias("marks"))
    sent = blocks.join(by_block, "block").mapInArrow(
        _send_strings(groups), "block long, g int, which binary, counts binary, ids binary, bytes binary")
    verdicts = staged(sent.groupBy("g").applyInArrow(_judge, "block long, which binary, bits binary"), "verdicts")
    judged = verdicts.groupBy("block").agg(F.collect_list(F.struct("which", "bits")).alias("verdicts"))
    last = ("kept binary" if keep_text else "kept_sha256 string")
    return blocks.join(by_block, "block", "left").join(judged, "block", "left").mapInArrow(
        _cut(groups, keep_text), f"doc_id long, n_bytes long, n_removed long, n_spans long, {last}")


#: DuckDB SQL for ``op6_substring_dedup``: every 50-byte window by a 64-bit hash of its hex text.
WINDOW_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(hex(encode(text)), '') AS h FROM documents),
w AS (SELECT doc_id, r, s, hash(substr(h, CAST(2 * s + 1 AS BIGINT), 100)) AS x
      FROM (SELECT *, unnest(range(0, length(h) // 2 - 49)) AS s FROM d WHERE length(h) >= 100)),
f AS (SELECT x, min(doc_id) AS first FROM w GROUP BY x HAVING count(*) > 1),
g AS (SELECT r, s FROM w JOIN f USING (x) WHERE doc_id > first),
b AS (SELECT r, s, max(s) OVER (PARTITION BY r ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM g),
i AS (SELECT r, s, sum(CASE WHEN p IS NULL OR s > p + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY s) AS k FROM b),
sp AS (SELECT r, k, min(s) AS a, max(s) + 50 AS e FROM i GROUP BY r, k),
o AS (SELECT r, k, a, e, lag(e, 1, 0) OVER (PARTITION BY r ORDER BY k) AS q FROM sp),
t AS (SELECT r, count(*) AS n, sum(e - a) AS m, max(e) AS z FROM sp GROUP BY r),
kept AS (SELECT o.r, string_agg(substr(h, CAST(2 * q + 1 AS BIGINT), CAST(2 * (a - q) AS BIGINT)), '' ORDER BY k) AS x
         FROM o JOIN d USING (r) GROUP BY o.r)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(t.m, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(t.n, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN t.r IS NULL THEN h ELSE kept.x || substr(h, CAST(2 * z + 1 AS BIGINT)) END)) AS kept_sha256
FROM d LEFT JOIN t USING (r) LEFT JOIN kept USING (r)
"""
