"""URL filters over dated lists: a temporal as-of join, in DataFrame operations only.

A list is a log of dated entries: at ``at``, key (kind, value) was added to or removed from a list.
The log becomes validity intervals, an entry holding from its date to the next entry of the same
list and key. A capture is tried against the entries active when it was fetched: its host, every
parent domain, and host plus first path segment are its keys, and an equi-join on key and time
bucket with the interval test picks the one entry of each list and key that was in force.

Intervals are cut at bucket borders and repeated for ``salts`` salts, captures carry one bucket and
one salt. A host that holds a third of all captures is so spread over buckets and salts, and each
piece compares its captures with the entries of that bucket alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.common import table

#: Seconds of a time bucket.
BUCKET = 86_400
SALTS = 8


def host_of(url: Column) -> Column:
    """Lower-case host: user, port and a trailing dot removed. Null for text that isn't an
    absolute URL with a host."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    host = F.regexp_replace(host, r"\.$", "")
    return F.when(host != "", host)


def path_key(url: Column) -> Column:
    """host/first-segment, null without a path segment."""
    segment = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+/([^/?#]+)", 1)
    return F.when(segment != "", F.concat(host_of(url), F.lit("/"), segment))


def url_keys(url: Column) -> Column:
    """Keys of a URL as ``kind:value``: host, path, and domain for the host and each parent of two
    labels or more. Names longer than DNS allows (253) have no parents."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    parents = F.when((F.length(host) <= 253) & (F.size(labels) >= 2), F.transform(
        F.sequence(F.lit(1), F.size(labels) - 1),
        lambda i: F.concat(F.lit("domain:"), F.array_join(F.slice(labels, i, F.size(labels)), "."))))
    own = F.array(F.concat(F.lit("host:"), host), F.concat(F.lit("path:"), path_key(url)))
    return F.array_compact(F.concat(own, F.coalesce(parents, F.array().cast("array<string>"))))


def list_intervals(entries: DataFrame) -> DataFrame:
    """(list, key, entry_id, valid_from, valid_to) of the times an addition is in force.

    ``entries``: entry_id, list, kind, value, action ('add' or 'remove'), at. Entries with a null
    among these are skipped, equal dates are ordered by entry_id, so the last one holds; repeated
    rows are one entry. valid_to is null while no later entry exists.
    """
    log = entries.select("entry_id", "list", F.concat("kind", F.lit(":"), F.lower("value")).alias("key"),
                         "action", "at").dropna().distinct()
    later = Window.partitionBy("list", "key").orderBy("at", "entry_id", "action")
    held = log.withColumn("valid_to", F.lead("at").over(later)).filter("action = 'add'")
    return held.filter("valid_to IS NULL OR valid_to > at").select(
        "list", "key", "entry_id", F.col("at").alias("valid_from"), "valid_to")


def active_entries(captures: DataFrame, intervals: DataFrame, bucket: int = BUCKET,
                   salts: int = SALTS) -> DataFrame:
    """(row, list, key, entry_id): each entry in force for a capture (row, url, fetched_at)."""
    number = lambda c: F.floor(F.unix_timestamp(c) / bucket)
    asked = captures.filter("url IS NOT NULL AND fetched_at IS NOT NULL").select(
        "row", "fetched_at", F.explode(url_keys(F.col("url"))).alias("key")).select(
        "row", "fetched_at", "key", number(F.col("fetched_at")).alias("bucket"),
        F.pmod("row", F.lit(salts)).alias("salt"))
    # an entry still in force lasts to the last bucket that any capture is in
    last = asked.agg(F.max("bucket")).first()[0]
    cut = intervals.withColumn("b1", F.least(number(F.coalesce("valid_to", "valid_from")), F.lit(last or 0))).withColumn(
        "b1", F.when(F.col("valid_to").isNull(), F.lit(last or 0)).otherwise(F.col("b1"))).withColumn(
        "b0", number(F.col("valid_from"))).filter("b0 <= b1")
    cut = cut.select("list", "key", "entry_id", "valid_from", "valid_to",
                     F.explode(F.sequence("b0", "b1")).alias("bucket")).select(
        "*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"))
    return asked.join(cut, ["key", "bucket", "salt"]).filter(
        (F.col("fetched_at") >= F.col("valid_from"))
        & (F.col("valid_to").isNull() | (F.col("fetched_at") < F.col("valid_to")))).select(
        "row", "list", "key", "entry_id")


def filter_urls(captures: DataFrame, entries: DataFrame, bucket: int = BUCKET, salts: int = SALTS) -> DataFrame:
    """One row for each capture (page_id, url, fetched_at): host, n_block, n_allow, entries, kept.

    A capture is dropped if a ``block`` entry was in force when it was fetched and no ``allow``
    entry was. A null URL, one without a host, or a null date meets no entry and is kept. Repeated
    rows get the same answer.
    """
    captures = captures.select("page_id", "url", "fetched_at").withColumn(
        "row", F.xxhash64("page_id", "url", "fetched_at"))
    met = active_entries(captures.dropDuplicates(["row"]), list_intervals(entries), bucket, salts)
    count = lambda name: F.count(F.when(F.col("list") == name, 1))
    by_row = met.groupBy("row").agg(
        count("block").alias("n_block"), count("allow").alias("n_allow"),
        F.concat_ws(",", F.transform(F.array_sort(F.collect_list("entry_id")), lambda x: x.cast("string"))).alias("entries"))
    return captures.join(by_row, "row", "left").select(
        "page_id", host_of(F.col("url")).alias("host"), "fetched_at",
        F.coalesce("n_block", F.lit(0)).cast("long").alias("n_block"),
        F.coalesce("n_allow", F.lit(0)).cast("long").alias("n_allow"),
        F.coalesce("entries", F.lit("")).alias("entries")).withColumn(
        "kept", (F.col("n_block") == 0) | (F.col("n_allow") > 0))


def captures_of(pages: DataFrame, events: DataFrame) -> DataFrame:
    """Captures of the given tables: page p was fetched when event ``p mod count`` happened."""
    n = max(1, events.count())
    when = events.select("event_id", F.col("ts").cast("timestamp").alias("fetched_at"))
    return pages.select("page_id", "url", F.pmod("page_id", F.lit(n)).alias("event_id")).join(
        when, "event_id", "left").select("page_id", "url", "fetched_at")


def entries_of(pages: DataFrame, events: DataFrame) -> DataFrame:
    """Dated list entries of the given tables: an event of user u is a list change about page u.

    error and click add and remove its host on the block list, signup and purchase its path; a view
    adds (even event_id) or removes (odd) its host's domain on the allow list.
    """
    about = pages.select(F.col("page_id").alias("user_id"), host_of(F.col("url")).alias("host"),
                         path_key(F.col("url")).alias("path"))
    kind = F.when(F.col("event_type").isin("error", "click"), "host").when(
        F.col("event_type").isin("signup", "purchase"), "path").otherwise("domain")
    add = F.col("event_type").isin("error", "signup") | ((F.col("event_type") == "view") & (F.col("event_id") % 2 == 0))
    return events.filter(F.col("event_type").isin("error", "click", "signup", "purchase", "view")).join(
        about, "user_id").select(
        F.col("event_id").alias("entry_id"),
        F.when(F.col("event_type") == "view", "allow").otherwise("block").alias("list"), kind.alias("kind"),
        F.when(kind == "path", F.col("path")).otherwise(F.col("host")).alias("value"),
        F.when(add, "add").otherwise("remove").alias("action"), F.col("ts").cast("timestamp").alias("at"))


def from_tables(spark, sf_dir: str) -> DataFrame:
    pages, events = table(spark, sf_dir, "pages"), table(spark, sf_dir, "events")
    return filter_urls(captures_of(pages, events), entries_of(pages, events)).select(
        "page_id", "host", F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("fetched_at"),
        "n_block", "n_allow", "entries", "kept")


#: DuckDB SQL for ``op1_url_filter``: the newest entry up to the fetch date, found by an as-of join.
URL_SQL = r"""
WITH p AS (SELECT page_id, url, regexp_replace(lower(regexp_extract(url,
             '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)), '\.$', '') AS host,
             regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+/([^/?#]+)', 1) AS seg FROM pages),
c AS (SELECT p.*, e.ts AS fetched_at FROM p LEFT JOIN events e ON e.event_id = p.page_id % (SELECT count(*) FROM events)),
log AS (SELECT event_id AS entry_id, CASE WHEN event_type = 'view' THEN 'allow' ELSE 'block' END AS list,
        lower(CASE WHEN event_type IN ('error', 'click') THEN 'host:' || host
             WHEN event_type IN ('signup', 'purchase') THEN 'path:' || host || '/' || seg
             ELSE 'domain:' || host END) AS key,
        event_type IN ('error', 'signup') OR (event_type = 'view' AND event_id % 2 = 0) AS added, ts AS since
        FROM events JOIN p ON p.page_id = events.user_id
        WHERE host <> '' AND event_type IN ('error', 'click', 'signup', 'purchase', 'view')
          AND NOT (event_type IN ('signup', 'purchase') AND seg = '')),
k AS (SELECT DISTINCT page_id, fetched_at, unnest(list_concat(['host:' || host], CASE WHEN seg <> '' THEN ['path:' || host || '/' || seg] ELSE [] END,
        list_transform(range(1, len(string_split(host, '.'))), lambda i: 'domain:' || array_to_string(list_slice(string_split(host, '.'), i, 99), '.')))) AS key
      FROM c WHERE host <> '' AND fetched_at IS NOT NULL),
kl AS (SELECT k.*, l.list FROM k JOIN (SELECT DISTINCT list, key FROM log) l USING (key)),
latest AS (SELECT kl.page_id, kl.list, arg_max(log.entry_id, (log.since, log.entry_id)) AS entry_id,
                  arg_max(log.added, (log.since, log.entry_id)) AS added
           FROM kl JOIN log ON log.key = kl.key AND log.list = kl.list AND log.since <= kl.fetched_at
           GROUP BY kl.page_id, kl.list, kl.key),
m AS (SELECT page_id, count(*) FILTER (WHERE list = 'block') AS b, count(*) FILTER (WHERE list = 'allow') AS a,
             string_agg(CAST(entry_id AS VARCHAR), ',' ORDER BY entry_id) AS e FROM latest WHERE added GROUP BY page_id)
SELECT c.page_id, nullif(c.host, '') AS host, strftime(c.fetched_at, '%Y-%m-%d %H:%M:%S.%f') AS fetched_at,
       CAST(coalesce(b, 0) AS BIGINT) AS n_block, CAST(coalesce(a, 0) AS BIGINT) AS n_allow, coalesce(e, '') AS entries,
       coalesce(b, 0) = 0 OR coalesce(a, 0) > 0 AS kept
FROM c LEFT JOIN m USING (page_id)
"""
