"""MinHash near-duplicates with tensored banding.

Two collections of ``side`` band values are made, each from ``rows`` minhashes; a table's key is a
pair, one value of either collection. ``side ** 2`` tables so cost ``2 * side * rows`` minhashes
instead of ``side ** 2 * 2 * rows``. Two sets of similarity s meet in some table with probability
``(1 - (1 - s**rows) ** side) ** 2``: 0.9996 at 0.8 with the defaults, and more above.

The nodes are distinct shingle sets, named by a 64-bit digest, so copies cost nothing after the
first pass. Sets that share a key are candidates; a link is confirmed on the full sets. No bucket is
expanded into all pairs: its sets are compared with one of them, confirmed links are joined into
components, and only buckets that still hold several components go on, compared with their most
typical set, the one whose shingles most others have. What then still differs is compared if it
passes an exact prefix filter: similar sets have a common shingle among their rarest, with enough
shingles behind it. So no candidate pair of different components that could be similar stays
unchecked, and a large group of copies costs its size, not its square.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.common import slices, staged, texts_of
from basketry.llm.components import components

ROWS, SIDE = 3, 12
#: Entries (key, set) that one reducing group holds, about.
GROUP_ENTRIES = 400_000
#: Ids broadcast to pick the candidates' texts, at most; beyond it the join is shuffled.
BROADCAST_IDS = 1_000_000
#: Words whose hash a worker remembers.
CACHE_WORDS = 400_000

_K1, _K2, _K3 = (np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit permutation (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _K2
    x = (x ^ (x >> np.uint64(27))) * _K3
    return x ^ (x >> np.uint64(31))


class WordHash(dict):
    """64-bit hash of a word, remembered."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: bytes | None, hashes: WordHash, width: int = 2) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes. A-Z are lower-cased and words are runs of anything but
    ASCII white space; fewer words than ``width`` form one shingle, no word none."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    if len(hashes) > CACHE_WORDS:
        hashes.clear()
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(width, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        out = mix(out * _K1 + h[k:len(h) - width + 1 + k])
    return np.unique(out)


def set_digest(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63


class Bander:
    """Band values of sets, and the tensored keys."""

    def __init__(self, rows: int = ROWS, side: int = SIDE, seed: int = 1):
        draw = np.random.default_rng(seed)
        n = 2 * rows * side
        self.rows, self.side = rows, side
        self.mult = draw.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.add = draw.integers(0, 2**63, n, dtype=np.uint64)

    def minhashes(self, s: np.ndarray) -> np.ndarray:
        low = np.full(len(self.mult), 2**64 - 1, np.uint64)
        for k in range(0, len(s), 4096):
            part = s[None, k:k + 4096] * self.mult[:, None] + self.add[:, None]
            np.minimum(low, part.min(axis=1), out=low)
        return low

    def keys(self, low: np.ndarray) -> np.ndarray:
        """side ** 2 keys for each line of minhashes."""
        n = len(low)
        bands = low.reshape(n, 2 * self.side, self.rows)
        value = np.zeros((n, 2 * self.side), np.uint64)
        for k in range(self.rows):
            value = mix(value * _K1 + bands[:, :, k])
        a, b = value[:, :self.side], value[:, self.side:]
        place = np.arange(self.side**2, dtype=np.uint64).reshape(self.side, self.side)
        return mix(a[:, :, None] * _K2 + b[:, None, :] * _K3 + place[None]).reshape(n, -1)


_PASS = "doc_id long, n_shingles long, sid long, p int, keys binary, sids binary, sizes binary"


def _sketch(docs: DataFrame, groups: int, bander: Bander, width: int) -> DataFrame:
    """One row a document (doc_id, n_shingles, sid), and rows of band entries.

    Entries of a batch go out as arrays for each of ``groups`` key ranges. Sets of one batch that
    share a key are pre-aggregated: only the first goes to the key's group, the batch's members are
    sent under p = -1, known to be shared. So a key gets one entry a batch at most, however common.
    """
    def run(batches):
        hashes = WordHash()
        for batch in batches:
            ids, sizes, sids, lows, seen = [], [], [], [], {}
            for part in slices([batch]):
                for text in texts_of(part.column("text")):
                    s = shingle_set(text, hashes, width)
                    sid = set_digest(s) if len(s) else None
                    sizes.append(len(s))
                    sids.append(sid)
                    if len(s) and sid not in seen:
                        seen[sid] = len(s)
                        lows.append(bander.minhashes(s))
            ids = batch.column("doc_id")
            n = len(sizes)
            none = pa.nulls(n, pa.binary())
            yield pa.RecordBatch.from_arrays(
                [ids.cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(sids, pa.int64()),
                 pa.nulls(n, pa.int32()), none, none, none], schema=SCHEMA)
            if not seen:
                continue
            names = np.fromiter(seen, np.int64, len(seen))
            counts = np.fromiter(seen.values(), np.int64, len(seen))
            keys = bander.keys(np.array(lows)).ravel()
            owner = np.repeat(np.arange(len(names)), bander.side**2)
            order = np.argsort(keys, kind="stable")
            keys, owner = keys[order], owner[order]
            head = np.concatenate([[True], keys[1:] != keys[:-1]])
            shared = ~head
            shared[:-1] |= ~head[1:]
            group = ((keys[head] >> np.uint64(40)) % np.uint64(groups)).astype(np.int64)
            first = np.flatnonzero(head)[np.argsort(group, kind="stable")]
            group = np.sort(group)
            cut = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            rows = [(int(group[a]), first[a:b]) for a, b in zip(cut, [*cut[1:], len(first)], strict=True)]
            if shared.any():
                rows.append((-1, np.flatnonzero(shared)))
            k = len(rows)
            none = pa.nulls(k, pa.int64())
            for a in range(0, k, 64):
                some = rows[a:a + 64]
                none = pa.nulls(len(some), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [none, none, none, pa.array([p for p, _ in some], pa.int32()),
                     pa.array([keys[x].tobytes() for _, x in some], pa.binary()),
                     pa.array([names[owner[x]].tobytes() for _, x in some], pa.binary()),
                     pa.array([counts[owner[x]].astype("<u4").tobytes() for _, x in some], pa.binary())],
                    schema=SCHEMA)

    SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("sid", pa.int64()),
                        ("p", pa.int32()), ("keys", pa.binary()), ("sids", pa.binary()),
                        ("sizes", pa.binary())])
    return docs.select("doc_id", "text").mapInArrow(run, _PASS)


_MEMBER = pa.schema([("key", pa.int64()), ("sid", pa.int64()), ("n", pa.int32())])


def _entries(table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    join = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
    return join("keys", np.int64), join("sids", np.int64), join("sizes", "<u4").astype(np.int32)


def _shared_keys(table: pa.Table) -> pa.Table:
    """Members of the keys that two or more sets of a group have."""
    keys, sids, sizes = _entries(table)
    order = np.lexsort((sids, keys))
    keys, sids, sizes = keys[order], sids[order], sizes[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (sids[1:] != sids[:-1])
    keys, sids, sizes = keys[new], sids[new], sizes[new]
    same = keys[1:] == keys[:-1]
    keep = np.zeros(len(keys), bool)
    keep[1:] |= same
    keep[:-1] |= same
    return pa.Table.from_arrays([pa.array(keys[keep]), pa.array(sids[keep]), pa.array(sizes[keep])],
                                schema=_MEMBER)


def _open_members(batches):
    for batch in batches:
        for part in slices([batch], 16):
            keys, sids, sizes = _entries(part)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sids), pa.array(sizes)],
                                             schema=_MEMBER)


def _enough(common, sizes, percent: int):
    """Whether ``common`` shingles can make two sets of ``sizes`` together similar at all."""
    return (100 + percent) * common >= percent * sizes


def _still_open(members: DataFrame, comp: DataFrame) -> DataFrame:
    """Members of the keys that hold several components, with their component c."""
    known = members.join(comp.withColumnRenamed("node", "sid"), "sid", "left").select(
        *members.columns, F.coalesce("component", "sid").alias("c"))
    mixed = known.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi")
    return known.join(mixed.select("key"), "key", "left_semi")


def _pairs(near: DataFrame) -> DataFrame:
    return near.select(F.least("sid", "sid2").alias("a"), F.greatest("sid", "sid2").alias("b")).distinct()


def _weighed(sets: DataFrame, sids: DataFrame) -> DataFrame:
    """(sid, n, x, df): each shingle of the sets ``sids``, and in how many of them it is."""
    each = sets.join(sids, "sid", "left_semi").select("sid", F.size("shingles").alias("n"), F.explode("shingles").alias("x"))
    return each.join(each.groupBy("x").agg(F.count("*").alias("df")), "x").select("sid", "n", "x", "df")


def _by_prefix(words: DataFrame, percent: int) -> DataFrame:
    """Pairs (sid, sid2) of different components c that could be similar, by prefix filtering.

    Shingles are ordered rarest first. Similar sets have their first common shingle in the first
    100 - percent of a hundred of both, and it leaves enough shingles behind it in both. For each
    shingle, only the sets outside its most frequent component look for partners.
    """
    order = Window.partitionBy("sid").orderBy("df", "x")
    head = words.withColumn("i", F.row_number().over(order) - 1).filter(
        100 * F.col("i") <= (100 - percent) * F.col("n")).select("x", "sid", "n", "i", "c")
    head = staged(head, "prefixes")
    most = head.groupBy("x", "c").count().groupBy("x").agg(F.max_by("c", F.struct("count", "c")).alias("most"),
                                                           F.count("*").alias("several")).filter("several > 1")
    ask = head.join(most, "x").filter("c <> most").drop("most", "several")
    other = head.select("x", *[F.col(k).alias(f"{k}2") for k in ("sid", "n", "i", "c")])
    return ask.join(other, "x").filter((F.col("c") != F.col("c2")) & _enough(
        F.least(F.col("n") - F.col("i"), F.col("n2") - F.col("i2")), F.col("n") + F.col("n2"), percent))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are at least ``percent`` similar."""
    left = sets.select(F.col("sid").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("sid").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").select(
        "a", "b", (F.size("sa") + F.size("sb")).alias("n"),
        F.size(F.array_intersect("sa", "sb")).alias("common"))
    return both.filter(100 * F.col("common") >= percent * (F.col("n") - F.col("common"))).select("a", "b")


def _member_sets(docs: DataFrame, first: DataFrame, width: int) -> DataFrame:
    """(sid, shingles) of the sets named in ``first`` (doc_id, sid), from their documents' texts."""
    if first.count() <= BROADCAST_IDS:
        first = F.broadcast(first)
    picked = docs.select("doc_id", "text").join(first, "doc_id")

    def run(batches):
        hashes = WordHash()
        for part in slices(batches):
            sets = [shingle_set(t, hashes, width) for t in texts_of(part.column("text"))]
            good = [set_digest(s) == sid for s, sid in
                    zip(sets, part.column("sid").to_pylist(), strict=True)]  # rows that share an id
            yield pa.RecordBatch.from_arrays(
                [part.column("sid").filter(pa.array(good)),
                 pa.array([s.view(np.int64) for s, ok in zip(sets, good, strict=True) if ok],
                          pa.list_(pa.int64()))], names=["sid", "shingles"])

    return picked.select("sid", "text").mapInArrow(run, "sid long, shingles array<long>").dropDuplicates(["sid"])


def _bare_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(sid, shingles) of the sets ``wanted`` (sid) that only rows without an id have: no key leads to
    their texts, so the sets of all such rows are made again and met by sid."""
    def run(batches):
        hashes = WordHash()
        for part in slices(batches):
            sets = [s for t in texts_of(part.column("text")) if len(s := shingle_set(t, hashes, width))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([set_digest(s) for s in sets], pa.int64()),
                 pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["sid", "shingles"])

    return docs.select("text").mapInArrow(run, "sid long, shingles array<long>").join(
        wanted, "sid", "left_semi").dropDuplicates(["sid"])


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, rows: int = ROWS,
                    side: int = SIDE, seed: int = 1) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (integer doc_id, text).

    Rows whose sets of ``width``-word shingles are at least ``percent`` similar are linked;
    component_id is the smallest doc_id reachable, kept says that it is the row's own. Null or empty
    text has no shingle and is linked with nothing. Repeated rows get the same answer, so an id that
    occurs twice is kept twice. A null id is reached last: its row takes another member's id, and
    stays, with a null component, only where all ids are null.
    """
    bander = Bander(rows, side, seed)
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    groups = max(1, docs.count() * side**2 // GROUP_ENTRIES)
    first_pass = staged(_sketch(docs, groups, bander, width), "sketch")
    row = first_pass.filter("p IS NULL").select("doc_id", "n_shingles", "sid")
    entries = first_pass.select("p", "keys", "sids", "sizes")
    met = entries.filter("p >= 0").groupBy("p").applyInArrow(_shared_keys, "key long, sid long, n int")
    local = entries.filter("p = -1").select("keys", "sids", "sizes").mapInArrow(
        _open_members, "key long, sid long, n int")
    members = staged(met.union(local), "members")

    comp = None
    if not members.isEmpty():
        # first, each bucket against one of its sets
        lead = members.groupBy("key").agg(F.min(F.struct(
            F.xxhash64("sid").alias("h"), F.col("sid").alias("sid2"), F.col("n").alias("n2"))).alias("lead"))
        near = members.join(lead.select("key", "lead.*"), "key").filter(
            (F.col("sid") != F.col("sid2")) & _enough(F.least("n", "n2"), F.col("n") + F.col("n2"), percent))
        used = members.select("sid").distinct()
        first = row.filter("doc_id IS NOT NULL").join(used, "sid", "left_semi").groupBy("sid").agg(
            F.min("doc_id").alias("doc_id"))
        first = staged(first, "first")
        sets = _member_sets(docs, first, width)
        bare = docs.filter("doc_id IS NULL")
        if not bare.isEmpty():
            sets = sets.unionByName(_bare_sets(bare, used.join(first, "sid", "left_anti"), width))
        sets = staged(sets, "sets")
        links = staged(_confirmed(_pairs(near), sets, percent), "links0")
        comp = components(links)
        # then the open buckets against their most typical set
        open_ = staged(_still_open(members.distinct(), comp), "open")
        words = staged(_weighed(sets, open_.select("sid").distinct()), "shingles")
        typical = words.groupBy("sid").agg(F.avg("df").alias("typical"))
        open_ = open_.join(typical, "sid")
        lead = open_.groupBy("key").agg(F.max(F.struct(
            "typical", F.col("sid").alias("sid2"), F.col("n").alias("n2"), F.col("c").alias("c2"))).alias("lead"))
        near = open_.join(lead.select("key", F.col("lead.sid2"), F.col("lead.n2"), F.col("lead.c2")), "key").filter(
            (F.col("c") != F.col("c2")) & _enough(F.least("n", "n2"), F.col("n") + F.col("n2"), percent))
        links = staged(links.union(_confirmed(_pairs(near), sets, percent)), "links1")
        comp = components(links)
        # and what still differs, by the shingles that similar sets must share
        left = _still_open(open_.select("key", "sid", "n"), comp).select("sid", "c").distinct()
        more = _confirmed(_pairs(_by_prefix(words.join(left, "sid"), percent)), sets, percent)
        comp = components(staged(links.union(more), "links2"))
    if comp is None:
        comp = spark.createDataFrame([], "node long, component long")
    where = row.join(comp.withColumnRenamed("node", "sid"), "sid", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "sid").alias("c"))
    least = where.filter("c IS NOT NULL").groupBy("c").agg(F.min("doc_id").alias("least"))
    return where.join(least, "c", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id")).select(
        "doc_id", "n_shingles", "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, that stay: one document of each near-duplicate component,
    the one of the smallest id, and one of rows that repeat an id and its text. Rows without an id
    stay unless they are near a row with one."""
    stay = staged(near_duplicates(docs, width, percent).filter("kept").select(
        F.col("doc_id").alias("stay")).distinct(), "stay")
    # one shuffle of the texts, by doc_id, serves the join and the repeated rows
    named = docs.filter("doc_id IS NOT NULL").join(stay, F.col("doc_id") == F.col("stay"), "left_semi")
    bare = docs.filter("doc_id IS NULL").join(
        stay.filter("stay IS NULL"), F.col("doc_id").eqNullSafe(F.col("stay")), "left_semi")
    return named.dropDuplicates(["doc_id", "text"]).union(bare.dropDuplicates(["text"]))


#: DuckDB SQL for ``op9_near_duplicates``: links counted over shared shingles, then reachability.
COMPONENT_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, x FROM (
       SELECT doc_id, unnest(CASE WHEN len(w) = 1 THEN [w[1]]
              ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS x
       FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x
           AND a.doc_id < b.doc_id GROUP BY ALL),
link AS MATERIALIZED (SELECT a, b FROM common JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id
         WHERE 100 * c >= 80 * (na.n + nb.n - c)),
step AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id, doc_id AS r FROM d UNION SELECT step.b, reach.r FROM reach JOIN step ON step.a = reach.doc_id
          WHERE reach.r < step.b),
comp AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN comp USING (doc_id) LEFT JOIN n USING (doc_id)
"""
