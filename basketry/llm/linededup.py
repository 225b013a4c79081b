"""Substring dedup by hashing lines, and the sentences of longer lines.

Every line with a visible character is a unit, however short, in any script. Of lines with several
sentences, those of ``MIN_POINTS`` code points or more are units too.

Every unit is normalised (A-Z lower-cased, white space collapsed) and digested with its place in
the original text. Digests are grouped globally; the earliest occurrence, by (doc_id, start), stays
and every later one is a removed span, in code points of the original text.

The global grouping is an aggregate, combined map-side, and only digests seen twice or more are
joined back. A unit that a third of all documents share is one partial row a task in the aggregate,
and in the join a skewed key that adaptive execution splits.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import slices, staged

SPACE = re.compile(r"[\x20\x09-\x0D]+")
UPPER = {c: c + 32 for c in range(65, 91)}
#: Sentences of fewer code points are no units of their own: short ones repeat by chance.
MIN_POINTS = 16
#: A sentence ends behind a full stop, question or exclamation mark and before a space (which belongs to
#: none), or behind a full-width one.
STOP = re.compile(r"(?<=[.?!]) |(?<=[\u3002\uff1f\uff01])")


def units_of(text: str, min_points: int = MIN_POINTS) -> list[tuple[int, int, str]]:
    """(start, end, normalised text) of each line, and of each longer sentence of a line with several."""
    out, at = [], 0
    for line in text.split("\n"):
        norm = SPACE.sub(" ", line.translate(UPPER)).strip(" ")
        if norm:
            out.append((at, at + len(line), norm))
            begin = 0
            stops = [m.span() for m in STOP.finditer(line)]
            for end, then in [*stops, (len(line), 0)] if stops else ():
                piece = SPACE.sub(" ", line[begin:end].translate(UPPER)).strip(" ")
                if len(piece) >= min_points:
                    out.append((at + begin, at + end, piece))
                begin = then
        at += len(line) + 1
    return out


def unit_table(docs: DataFrame, min_points: int = MIN_POINTS) -> DataFrame:
    """(doc_id, start, end, digest) of every unit; digest is 128 bits."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        digest = xxhash.xxh3_128_digest
        for part in slices(batches):
            rows, starts, ends, digests = [], [], [], []
            for k, text in enumerate(part.column("text").to_pylist()):
                for a, b, norm in units_of(text, min_points) if text else ():
                    rows.append(k)
                    starts.append(a)
                    ends.append(b)
                    digests.append(digest(norm.encode("utf-8", "surrogatepass")))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(starts, pa.int32()),
                 pa.array(ends, pa.int32()), pa.array(digests, pa.binary())],
                names=["doc_id", "start", "end", "digest"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start int, end int, digest binary")


def repeated_units(docs: DataFrame, min_points: int = MIN_POINTS) -> tuple[DataFrame, DataFrame]:
    """All units, and the spans (doc_id, start, end) to remove.

    Rows that share an id are one document with the units of all. A null id ranks last. Equal places (repeated rows) are
    the same occurrence.
    """
    units = staged(unit_table(docs, min_points), "units")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "start")
    first = units.groupBy("digest").agg(F.min(rank).alias("first"), F.max(rank).alias("last")).filter(
        "first <> last").select("digest", "first")
    return units, units.withColumn("rank", rank).join(first, "digest").filter("rank <> first").select(
        "doc_id", "start", "end").distinct()


def dedup_report(docs: DataFrame, min_points: int = MIN_POINTS) -> DataFrame:
    """Per row of ``docs``: n_units, n_removed (units) and spans, ``start:end`` comma-joined by start
    and end. Null or empty text has no units."""
    units, gone = repeated_units(docs, min_points)
    counts = units.select("doc_id", "start", "end").groupBy("doc_id").agg(F.count("*").alias("n_units"))
    by_doc = gone.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("s"))
    ids = docs.select(F.col("doc_id").alias("id"))
    counts, by_doc = counts.withColumnRenamed("doc_id", "a"), by_doc.withColumnRenamed("doc_id", "b")
    return ids.join(counts, F.col("id").eqNullSafe(F.col("a")), "left").join(
        by_doc, F.col("id").eqNullSafe(F.col("b")), "left").select(
        F.col("id").alias("doc_id"), F.coalesce("n_units", F.lit(0)).cast("long").alias("n_units"),
        F.coalesce(F.size("s"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["start"], x["end"])), ","),
                   F.lit("")).alias("spans"))


def cut(text: str | None, spans) -> str | None:
    """``text`` without the spans, which may overlap; line breaks stay."""
    if not text or not spans:
        return text
    out, done = [], 0
    for s in sorted((x["start"], x["end"]) for x in spans):
        if s[0] > done:
            out.append(text[done:s[0]])
        done = max(done, s[1])
    return "".join([*out, text[done:]])


def dedup_lines(docs: DataFrame, min_points: int = MIN_POINTS) -> DataFrame:
    """(doc_id, text, spans): each text without its repeated units, the removed spans kept beside it."""
    _, gone = repeated_units(docs, min_points)
    by_doc = gone.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    by_doc = by_doc.withColumnRenamed("doc_id", "b")
    joined = docs.select("doc_id", "text").join(by_doc, F.col("doc_id").eqNullSafe(F.col("b")), "left")
    return joined.select("doc_id", F.when(F.col("spans").isNull(), F.col("text")).otherwise(
        F.udf(cut, "string")("text", "spans")).alias("text"), "spans")


#: DuckDB SQL for ``op10_line_dedup``.
UNITS_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k
           FROM documents WHERE text <> ''),
lo AS (SELECT doc_id, line, k, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k) - length(line) - 1 AS pos FROM l),
m AS (SELECT *, regexp_replace(regexp_replace(line, '([.?!]) ', '\1' || chr(1), 'g'),
                               '([\x{3002}\x{FF1F}\x{FF01}])', '\1' || chr(2), 'g') AS marked FROM lo),
s AS (SELECT doc_id, k, pos, i, regexp_split_to_array(marked, '[\x01\x02]')[i] AS piece,
             regexp_extract_all(marked, '[\x01\x02]')[i] AS sep
      FROM (SELECT *, unnest(range(1, len(regexp_split_to_array(marked, '[\x01\x02]')) + 1)) AS i FROM m WHERE marked <> line)),
so AS (SELECT doc_id, piece AS x, pos + sum(length(piece) + CASE WHEN sep = chr(1) THEN 1 ELSE 0 END) OVER (
              PARTITION BY doc_id, k ORDER BY i) - length(piece) - CASE WHEN sep = chr(1) THEN 1 ELSE 0 END AS pos FROM s),
u AS (SELECT doc_id, pos AS a, pos + length(line) AS e, line AS x, 1 AS least FROM lo
      UNION ALL SELECT doc_id, pos, pos + length(x), x, 16 FROM so),
n AS (SELECT doc_id, least, CAST(a AS BIGINT) AS a, CAST(e AS BIGINT) AS e,
             trim(regexp_replace(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                 '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS t FROM u),
v AS (SELECT * FROM n WHERE length(t) >= least),
f AS (SELECT *, min((doc_id, a)) OVER (PARTITION BY t) AS first FROM v),
c AS (SELECT doc_id, count(*) AS n FROM v GROUP BY doc_id),
g AS (SELECT doc_id, count(*) AS n, string_agg(a || ':' || e, ',' ORDER BY a, e) AS s
      FROM (SELECT DISTINCT doc_id, a, e FROM f WHERE (doc_id, a) <> first) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_units, CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed,
       coalesce(g.s, '') AS spans
FROM documents d LEFT JOIN c USING (doc_id) LEFT JOIN g USING (doc_id)
"""
