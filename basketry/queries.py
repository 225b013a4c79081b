"""Registered queries over the test tables, with equivalent DuckDB SQL.

Every query reads the whole tables (``orders lineitem part events pages``)
of a scale-factor folder; nothing is sampled or capped except where the cap
is the operator itself (top-k partners, the 2000-row preview). Queries that
exercise a sink write to a fresh folder under the session's checkpoint
folder and read the files back.

Column names and types of each Spark query equal those of its SQL.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.functions.hashes import (PROBE_MOD, SINGLE_MOD, hash_pair, hash_pair_25, hash_pair_1000,
                                       hash_single_group)
from basketry.operators import baskets as B
from basketry.operators import counting as C
from basketry.operators import recommend as R
from basketry.operators.fpm import fp_growth, transaction_sets
from basketry.operators.pages import extract_unique
from basketry.operators.pairs import (expand_occurrences, group_occurrences, pair_occurrences,
                                      self_join_pair_occurrences)
from basketry.plans.baskets import csv_basket_lines, csv_basket_runs, order_baskets
from basketry.plans.pcy import (pcy_candidates, pcy_candidates_bitmap, pcy_candidates_from_store,
                                pcy_distinct_pairs, pcy_pass)
from basketry.plans.probe import coprime_multiplier, probe_hits, probe_store
from basketry.plans.recommend import respond
from basketry.session import materialized, scratch_path, tasks_of
from basketry.sinks.store import close_store, open_store, save_store
from basketry.sinks.tables import save_bitmap, save_frequent_items
from basketry.sinks.text import write_baskets, write_pairs_text
from basketry.sources.tables import (catalog_from_part, key_to_string, load_tables,
                                     order_lines_from_dir, order_lines_salted, order_lines_sql)
from basketry.sources.text import read_baskets, read_order_csv, read_transactions

# Parameters of the registered queries.
ITEM_SUPPORT = 30        # freq_items
PAIR_SUPPORT = 1         # freq_buckets, frequent_pairs, candidates (shuffle), recs
CANDIDATE_SUPPORT = 2    # pcy_candidates (broadcast) and rec_upsert
FP_MIN_SUPPORT = 0.1
TOP_K = 5
PREVIEW_ROWS = 2000
PROBE_ITEM_SUPPORT = 25
PROBE_BUCKET_SUPPORT = 120
PROBE_MULTIPLIER = 719
PROBE_OFFSET = 13
STORE_BUCKETS = 8        # files a stored table is laid out in
RUN_CHUNK_ROWS = 1000    # small, so that runs cross chunks at any scale


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(d, f"{name}.parquet"))


def _lines(spark, d):
    return order_lines_from_dir(spark, d)


def _baskets(spark, d):
    return B.build_baskets(_lines(spark, d))


def _joined(col):
    return F.array_join(F.transform(col, lambda x: x.cast("string")), " ")


def _recs(spark, d, support=PAIR_SUPPORT):
    return R.recommendations_from_pairs(C.frequent_pairs(_lines(spark, d), support))


# ---------------------------------------------------------------- sources
def q_scan_tables(spark, d):
    return order_lines_sql(spark, d)


def q_order_part_join(spark, d):
    return _lines(spark, d)


def q_order_part_join_salted(spark, d):
    return order_lines_salted(_t(spark, d, "orders"), _t(spark, d, "lineitem"), _t(spark, d, "part"))


def q_key_to_string(spark, d):
    return key_to_string(_lines(spark, d))


def q_basket_parse(spark, d):
    path = write_baskets(_baskets(spark, d), scratch_path(spark, "basket_parse"))
    parsed = read_baskets(spark, path, key_type="bigint")
    return B.as_lines(parsed)


def q_tx_parse(spark, d):
    lines = _lines(spark, d).join(
        _t(spark, d, "part").select(F.col("p_partkey").alias("item"), "p_type"), "item")
    tx = lines.groupBy("order_id").agg(
        F.array_sort(F.collect_list(F.struct("item", "p_type"))).alias("_s"))
    text = tx.select(F.array_join(F.transform("_s", lambda s: s["p_type"]), " ").alias("value"))
    path = scratch_path(spark, "tx_parse")
    text.write.mode("overwrite").text(path)
    return read_transactions(spark, path).select(
        F.array_join(F.array_sort("items"), " ").alias("items"))


def q_csv_scan(spark, d):
    rows = _lines(spark, d).select("order_id", F.lit("x").alias("a"), F.lit("y").alias("b"), "item")
    path = scratch_path(spark, "csv_scan")
    rows.write.mode("overwrite").csv(path)
    out = read_order_csv(spark, path, 0, 3, item_type="bigint")
    return out.select(F.col("order_id").cast("bigint").alias("order_id"), "item")


def q_baskets_csv(spark, d):
    rows = _lines(spark, d).select("order_id", F.lit("x").alias("a"), F.lit("y").alias("b"), "item")
    path = scratch_path(spark, "baskets_csv")
    rows.write.mode("overwrite").csv(path)
    return csv_basket_lines(spark, path, item_type="bigint")


# ---------------------------------------------------------------- baskets
def q_baskets(spark, d):
    b = _baskets(spark, d)
    return b.select("order_id", F.size("items").cast("bigint").alias("n_items"),
                    _joined(F.col("items")).alias("items"))


def q_basket_concat(spark, d):
    return B.basket_concat(_baskets(spark, d))


def q_basket_lines(spark, d):
    return B.basket_lines(_baskets(spark, d))


def q_basket_lines_csv(spark, d):
    return B.basket_lines(_baskets(spark, d), sep=":")


def q_min_basket(spark, d):
    return B.min_basket(_lines(spark, d), 2)


def q_basket_runs(spark, d):
    ev = _t(spark, d, "events")
    rows = B.basket_run_rows(ev, "user_id", "event_type", ["event_id"],
                             [F.floor(F.col("event_id") / RUN_CHUNK_ROWS)], min_items=2)
    return rows.select(F.col("key").alias("user_id"), "run_start", "n_items", "event_id",
                       F.col("item").alias("event_type"))


def q_order_baskets(spark, d):
    path = order_baskets(spark, d, scratch_path(spark, "order_baskets"))
    return spark.read.text(path).withColumnRenamed("value", "line")


# ---------------------------------------------------------------- groups, hashes
def q_item_groups_1(spark, d):
    return B.as_lines(_lines(spark, d))


def q_item_groups_2(spark, d):
    return expand_occurrences(pair_occurrences(_lines(spark, d)))


def _groups(spark, d, k):
    return expand_occurrences(group_occurrences(_lines(spark, d), k),
                              ("order_id", *[f"item{t}" for t in range(1, k + 1)]))


def q_item_groups_k(spark, d):
    return _groups(spark, d, 3)


def q_item_groups_4(spark, d):
    return _groups(spark, d, 4)


def q_basket_self_pairs(spark, d):
    return expand_occurrences(self_join_pair_occurrences(_lines(spark, d)))


def q_hash_single(spark, d):
    b = _baskets(spark, d)
    return b.select("order_id", hash_single_group("items").alias("hash"))


def _distinct_pairs(spark, d):
    return C.frequent_pairs(_lines(spark, d), 0).select("item1", "item2")


def q_hash_pair(spark, d):
    return _distinct_pairs(spark, d).withColumn("hash", hash_pair("item1", "item2"))


def q_hash_pair_25(spark, d):
    return _distinct_pairs(spark, d).withColumn("hash", hash_pair_25("item1", "item2"))


def q_hash_pair_1000(spark, d):
    return _distinct_pairs(spark, d).withColumn("hash", hash_pair_1000("item1", "item2"))


# ---------------------------------------------------------------- counting
def q_bucket_counts(spark, d):
    pairs = C.pair_buckets(self_join_pair_occurrences(_lines(spark, d)))
    return C.bucket_counts(pairs, F.col("bucket"), "n")


def q_freq_items(spark, d):
    return C.frequent_items(_lines(spark, d), ITEM_SUPPORT, item_mod=100000000)


def q_freq_buckets(spark, d):
    return C.frequent_buckets(self_join_pair_occurrences(_lines(spark, d)), PAIR_SUPPORT)


def q_pair_count(spark, d):
    return C.pair_count(_lines(spark, d))


def q_frequent_pairs(spark, d):
    return C.frequent_pairs(_lines(spark, d), PAIR_SUPPORT)


def q_frequent_pairs_distinct(spark, d):
    return C.frequent_pairs(_lines(spark, d), PAIR_SUPPORT, distinct_items=True)


def q_pcy_candidates(spark, d):
    return pcy_candidates(_lines(spark, d), CANDIDATE_SUPPORT, item_mod=SINGLE_MOD,
                          strategy="broadcast")


def q_pcy_candidates_raw(spark, d):
    return pcy_candidates(_lines(spark, d), CANDIDATE_SUPPORT)


def q_pcy_candidates_bitmap(spark, d):
    return pcy_candidates_bitmap(_lines(spark, d), CANDIDATE_SUPPORT)


def q_pcy_candidates_store(spark, d):
    """Filters and basket items saved by one run, opened and joined in place by another."""
    path = save_store(_lines(spark, d), CANDIDATE_SUPPORT, scratch_path(spark, "store"), STORE_BUCKETS)
    close_store(spark, path)  # the next run's catalog knows nothing
    return pcy_candidates_from_store(open_store(spark, path, STORE_BUCKETS))


def q_pcy_candidates_shuffle(spark, d):
    return pcy_candidates(_lines(spark, d), PAIR_SUPPORT, item_mod=SINGLE_MOD,
                          strategy="shuffle")


def q_distinct_keys(spark, d):
    return pcy_distinct_pairs(_lines(spark, d), PAIR_SUPPORT)


def q_pcy_pass_n(spark, d):
    _, bitmap, _ = pcy_pass(_lines(spark, d), 2, PAIR_SUPPORT)
    return bitmap


def q_pcy_pass_frequent(spark, d):
    frequent, _, _ = pcy_pass(_lines(spark, d), 2, PAIR_SUPPORT)
    return frequent


def q_pcy_pass_groups(spark, d):
    _, _, groups = pcy_pass(_lines(spark, d), 1, PAIR_SUPPORT)
    return groups.select("order_id", F.col("group")[0].alias("item1"), F.col("group")[1].alias("item2"))


def q_pcy_pass_3_frequent(spark, d):
    return pcy_pass(_lines(spark, d), 3, 0)[0]


def q_pcy_pass_3_bitmap(spark, d):
    return pcy_pass(_lines(spark, d), 3, PAIR_SUPPORT)[1]


def q_pcy_pass_3_groups(spark, d):
    groups = pcy_pass(_lines(spark, d), 3, PAIR_SUPPORT)[2]
    return groups.select("order_id", *[F.col("group")[t].alias(f"item{t + 1}") for t in range(4)])


def q_csv_basket_runs(spark, d):
    """CSV rows written in order of order and item, so each basket is one run of rows."""
    lines = materialized(_lines(spark, d), "order-lines")
    rows = lines.select("order_id", F.lit("x").alias("a"), F.lit("y").alias("b"), "item")
    path = scratch_path(spark, "csv_runs")
    files = tasks_of(spark, B.WIDE * lines.count())
    rows.repartitionByRange(*files, "order_id").sortWithinPartitions("order_id", "item").write.csv(path)
    runs = csv_basket_runs(spark, path, item_type="bigint")
    return runs.select(F.col("key").cast("bigint").alias("order_id"),
                       F.col("n_items").cast("bigint").alias("n_items"), _joined(F.col("items")).alias("items"))


def q_basket_parse_permissive(spark, d):
    """Every third basket line has no colon and is dropped; every third has a word behind its items: only
    that token goes (SURVEY T16)."""
    lines = B.basket_lines(_baskets(spark, d))
    key = F.split("line", " : ")[0].cast("bigint")
    broken = lines.select(F.when(key % 3 == 1, F.replace("line", F.lit(" : "), F.lit(" ")))
                          .when(key % 3 == 2, F.concat("line", F.lit(" x")))
                          .otherwise(F.col("line")).alias("value"))
    path = scratch_path(spark, "permissive")
    broken.write.text(path)
    return B.as_lines(read_baskets(spark, path, "permissive", key_type="bigint"))


def q_write_baskets_csv(spark, d):
    path = write_baskets(_baskets(spark, d), scratch_path(spark, "baskets_tight"), sep=":", n_files=2)
    return spark.read.text(path).withColumnRenamed("value", "line")


def q_rec_upsert_merge(spark, d):
    """Partners of high support merged into the stored table that an earlier run kept of all."""
    recs = _recs(spark, d)
    path = R.merge_recommendations(recs, scratch_path(spark, "recs"), STORE_BUCKETS)
    R.merge_recommendations(recs.where(F.col("support") > CANDIDATE_SUPPORT), path, STORE_BUCKETS)
    return spark.read.parquet(path).drop("part")


def q_fp_growth(spark, d):
    lines = _lines(spark, d).join(
        _t(spark, d, "part").select(F.col("p_partkey").alias("item"), "p_type"), "item")
    sets = fp_growth(transaction_sets(lines, item="p_type"), FP_MIN_SUPPORT)
    return sets.select(F.array_join(F.array_sort("items"), " ").alias("items"), "freq")


# ---------------------------------------------------------------- sinks
def q_save_freq_items(spark, d):
    path = save_frequent_items(C.frequent_items(_lines(spark, d), ITEM_SUPPORT, 100000000),
                               scratch_path(spark, "freq_items"))
    return spark.read.parquet(path)


def q_save_bitmap(spark, d):
    path = save_bitmap(C.frequent_buckets(self_join_pair_occurrences(_lines(spark, d)),
                                          PAIR_SUPPORT), scratch_path(spark, "bitmap"))
    return spark.read.parquet(path)


def q_write_pairs_text(spark, d):
    pairs = pcy_candidates(_lines(spark, d), 0)
    path = write_pairs_text(pairs, scratch_path(spark, "pairs_text"))
    return spark.read.text(path)


# ---------------------------------------------------------------- recommendations
def q_rec_upsert(spark, d):
    return R.upsert_recommendations(_recs(spark, d, CANDIDATE_SUPPORT))


def q_rec_topk(spark, d):
    return R.top_partners(_recs(spark, d), TOP_K).withColumn("rank", F.col("rank").cast("bigint"))


def q_rec_union(spark, d):
    return R.rec_union(_recs(spark, d))


def _requests(spark, d):
    return _t(spark, d, "lineitem").select(F.col("l_partkey").alias("product_id")).distinct()


def q_rec_lookup(spark, d):
    return R.lookup(_recs(spark, d), _requests(spark, d), TOP_K)


def q_rec_lookup_stored(spark, d):
    path = scratch_path(spark, "partners")
    name = R.save_partners(_recs(spark, d), path, f"basketry_partners_{path[-12:]}", STORE_BUCKETS)
    return R.lookup_stored(spark, name, _requests(spark, d), TOP_K)


def q_rec_enrich(spark, d):
    return respond(_requests(spark, d), _recs(spark, d),
                   catalog_from_part(_t(spark, d, "part")), TOP_K)


def q_recs_preview(spark, d):
    return R.recs_preview(_recs(spark, d, 0), PREVIEW_ROWS)


# ---------------------------------------------------------------- probe, pages
def q_probe_random_pairs(spark, d):
    lines = _lines(spark, d)
    lines = B.shared_items(lines)
    items = C.having_support(C.shared_item_counts(lines), PROBE_ITEM_SUPPORT)
    pairs = self_join_pair_occurrences(lines)
    buckets = C.having_support(
        C.bucket_counts(pairs, hash_pair_1000("item1", "item2"), "n"), PROBE_BUCKET_SUPPORT)
    n = _t(spark, d, "part").count()
    a = coprime_multiplier(n, PROBE_MULTIPLIER)
    return probe_hits(spark, items, buckets, n, a, PROBE_OFFSET)


def q_probe_saved(spark, d):
    """The probe of ``probe_random_pairs`` against a store that an earlier run saved."""
    path = save_store(_lines(spark, d), PROBE_ITEM_SUPPORT, scratch_path(spark, "probe_store"), STORE_BUCKETS,
                      PROBE_MOD, hash_fn=hash_pair_1000, bucket_support=PROBE_BUCKET_SUPPORT)
    n = _t(spark, d, "part").count()
    return probe_store(open_store(spark, path, STORE_BUCKETS, PROBE_MOD), n, coprime_multiplier(n, PROBE_MULTIPLIER),
                       PROBE_OFFSET)


def q_page_extract(spark, d):
    return extract_unique(_t(spark, d, "pages"), "ad")


def q_page_extract_product(spark, d):
    """Text and image from descendants: each page's heading and address as a product card put before the page."""
    pages = _t(spark, d, "pages")
    heading = F.regexp_extract("html", "<h1>([^<]*)</h1>", 1)
    card = F.concat(F.lit('<div class="big product-item"><div><p class="product-description">'), heading,
                    F.lit('</p></div><span><img class="product-item-img" src="'), F.col("url"),
                    F.lit('?a=1&amp;b=2"></span>more</div>'))
    return extract_unique(pages.select("page_id", F.concat(card, "html").alias("html")), "product-item",
                          "product-description", "product-item-img")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name[2:]: fn for name, fn in sorted(globals().items())
    if name.startswith("q_") and callable(fn)
}


# ---------------------------------------------------------------- oracle SQL
_BP = """bp AS (SELECT o_orderkey AS order_id, p_partkey AS item FROM orders
             JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey)"""
_R = """r AS (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY item) AS rn FROM bp)"""
_PAIRS = """pairs AS (SELECT a.order_id, a.item AS item1, b.item AS item2,
             ((2 * a.item + 1) % 999917) * ((2 * b.item + 1) % 999917) % 999917 AS bucket
             FROM r a JOIN r b ON a.order_id = b.order_id AND a.rn < b.rn)"""
_FP = """fp AS (SELECT item1, item2, CAST(count(*) AS BIGINT) AS support FROM pairs
          GROUP BY 1, 2 HAVING count(*) > {s})"""
_RECS = """recs AS (SELECT item1 AS product_id, item2 AS rec_id, support FROM fp
            WHERE item1 <> item2)"""
_DIRS = """dirs AS (SELECT product_id, rec_id, support, 'forward' AS direction FROM recs
            UNION ALL SELECT rec_id, product_id, support, 'backward' FROM recs)"""
_REQ = """req AS (SELECT DISTINCT l_partkey AS product_id FROM lineitem)"""
_TOP = """top AS (SELECT * FROM (SELECT d.*, row_number() OVER (PARTITION BY product_id, direction
             ORDER BY support DESC, rec_id) AS rank FROM dirs d
             WHERE product_id IN (SELECT product_id FROM req)) WHERE rank <= 5)"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def _pairs_sql(*extra: str) -> str:
    return _with(_BP, _R, _PAIRS, *extra)


_BASKET_STR = "string_agg(CAST(item AS VARCHAR), ' ' ORDER BY item)"

ORACLE_SQL: dict[str, str] = {
    "scan_tables": _with(_BP) + "SELECT order_id, item FROM bp",
    "order_part_join": _with(_BP) + "SELECT order_id, item FROM bp",
    "key_to_string": _with(_BP) + (
        "SELECT CAST(order_id AS VARCHAR) AS order_id, CAST(item AS VARCHAR) AS item FROM bp"),
    "basket_parse": _with(_BP) + "SELECT order_id, item FROM bp",
    "tx_parse": (
        "WITH bt AS (SELECT DISTINCT o_orderkey AS oid, p_type FROM orders "
        "JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey) "
        "SELECT string_agg(p_type, ' ' ORDER BY p_type) AS items FROM bt GROUP BY oid"),
    "csv_scan": _with(_BP) + "SELECT order_id, item FROM bp",
    "baskets_csv": _with(_BP) + (
        f"SELECT concat(order_id, ':', {_BASKET_STR}) AS line FROM bp "
        "GROUP BY order_id HAVING count(*) >= 2"),
    "baskets": _with(_BP) + (
        f"SELECT order_id, count(*) AS n_items, {_BASKET_STR} AS items FROM bp GROUP BY order_id"),
    "basket_concat": _with(_BP) + (
        f"SELECT order_id, {_BASKET_STR} AS items FROM bp GROUP BY order_id"),
    "basket_lines": _with(_BP) + (
        f"SELECT concat(order_id, ' : ', {_BASKET_STR}) AS line FROM bp GROUP BY order_id"),
    "basket_lines_csv": _with(_BP) + (
        f"SELECT concat(order_id, ':', {_BASKET_STR}) AS line FROM bp GROUP BY order_id"),
    "order_baskets": _with(_BP) + (
        f"SELECT concat(order_id, ' : ', {_BASKET_STR}) AS line FROM bp GROUP BY order_id"),
    "min_basket": _with(_BP) + (
        "SELECT order_id, item FROM bp QUALIFY count(*) OVER (PARTITION BY order_id) >= 2"),
    "basket_runs": (
        "WITH e AS (SELECT event_id, user_id, event_type, CASE WHEN lag(user_id) OVER "
        "(ORDER BY event_id) IS DISTINCT FROM user_id THEN 1 ELSE 0 END AS brk FROM events), "
        "g AS (SELECT *, sum(brk) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING "
        "AND CURRENT ROW) AS run FROM e) "
        "SELECT user_id, min(event_id) OVER (PARTITION BY run) AS run_start, "
        "count(*) OVER (PARTITION BY run) AS n_items, event_id, event_type FROM g "
        "QUALIFY count(*) OVER (PARTITION BY run) >= 2"),
    "item_groups_1": _with(_BP) + "SELECT order_id, item FROM bp",
    "item_groups_2": _pairs_sql() + "SELECT order_id, item1, item2 FROM pairs",
    "item_groups_k": _with(_BP, _R) + (
        "SELECT a.order_id, a.item AS item1, b.item AS item2, c.item AS item3 FROM r a "
        "JOIN r b ON a.order_id = b.order_id AND b.rn = a.rn + 1 "
        "JOIN r c ON a.order_id = c.order_id AND c.rn > b.rn"),
    "basket_self_pairs": _pairs_sql() + "SELECT order_id, item1, item2 FROM pairs",
    "hash_single": _with(_BP) + (
        "SELECT order_id, CAST(list_reduce(list(item % 100000000 ORDER BY item), "
        "lambda acc, x: (acc * x) % 100000000) AS BIGINT) AS hash FROM bp GROUP BY order_id"),
    "hash_pair": _pairs_sql() + (
        "SELECT DISTINCT item1, item2, "
        "((2 * item1 + 1) % 999917) * ((2 * item2 + 1) % 999917) % 999917 AS hash FROM pairs"),
    "hash_pair_25": _pairs_sql() + (
        "SELECT DISTINCT item1, item2, ((item1 % 25) * (item2 % 25)) % 25 AS hash FROM pairs"),
    "hash_pair_1000": _pairs_sql() + (
        "SELECT DISTINCT item1, item2, ((item1 % 1000) * (item2 % 1000)) % 1000 AS hash "
        "FROM pairs"),
    "bucket_counts": _pairs_sql() + (
        "SELECT bucket, count(*) AS support FROM pairs GROUP BY bucket"),
    "freq_items": _with(_BP) + (
        f"SELECT item % 100000000 AS item, count(*) AS support FROM bp GROUP BY 1 "
        f"HAVING count(*) > {ITEM_SUPPORT}"),
    "save_freq_items": _with(_BP) + (
        f"SELECT item % 100000000 AS item, count(*) AS support FROM bp GROUP BY 1 "
        f"HAVING count(*) > {ITEM_SUPPORT}"),
    "freq_buckets": _pairs_sql() + (
        f"SELECT bucket, count(*) AS support FROM pairs GROUP BY bucket "
        f"HAVING count(*) > {PAIR_SUPPORT}"),
    "save_bitmap": _pairs_sql() + (
        f"SELECT bucket, count(*) AS support FROM pairs GROUP BY bucket "
        f"HAVING count(*) > {PAIR_SUPPORT}"),
    "pair_count": _pairs_sql() + "SELECT count(*) AS pair_count FROM pairs",
    "frequent_pairs": _pairs_sql(_FP.format(s=PAIR_SUPPORT)) + "SELECT * FROM fp",
    "frequent_pairs_distinct": _with(
        "bp0 AS (SELECT DISTINCT o_orderkey AS order_id, p_partkey AS item FROM orders "
        "JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey)") + (
        "SELECT a.item AS item1, b.item AS item2, count(*) AS support FROM bp0 a "
        "JOIN bp0 b ON a.order_id = b.order_id AND a.item < b.item "
        f"GROUP BY 1, 2 HAVING count(*) > {PAIR_SUPPORT}"),
    "pcy_candidates": _pairs_sql(
        f"it AS (SELECT item % 100000000 AS k FROM bp GROUP BY 1 "
        f"HAVING count(*) > {CANDIDATE_SUPPORT})",
        f"bk AS (SELECT bucket FROM pairs GROUP BY 1 HAVING count(*) > {CANDIDATE_SUPPORT})") + (
        "SELECT order_id, item1, item2 FROM pairs WHERE item1 IN (SELECT k FROM it) "
        "AND item2 IN (SELECT k FROM it) AND bucket IN (SELECT bucket FROM bk)"),
    "pcy_candidates_shuffle": _pairs_sql(
        f"it AS (SELECT item % 100000000 AS k FROM bp GROUP BY 1 HAVING count(*) > {PAIR_SUPPORT})",
        f"bk AS (SELECT bucket FROM pairs GROUP BY 1 HAVING count(*) > {PAIR_SUPPORT})") + (
        "SELECT order_id, item1, item2 FROM pairs WHERE item1 IN (SELECT k FROM it) "
        "AND item2 IN (SELECT k FROM it) AND bucket IN (SELECT bucket FROM bk)"),
    "distinct_keys": _pairs_sql(
        f"it AS (SELECT item AS k FROM bp GROUP BY 1 HAVING count(*) > {PAIR_SUPPORT})",
        f"bk AS (SELECT bucket FROM pairs GROUP BY 1 HAVING count(*) > {PAIR_SUPPORT})") + (
        "SELECT DISTINCT item1, item2 FROM pairs WHERE item1 IN (SELECT k FROM it) "
        "AND item2 IN (SELECT k FROM it) AND bucket IN (SELECT bucket FROM bk)"),
    "pcy_pass_n": _with(_BP, _R) + (
        "SELECT ((2 * a.item + 1) % 999917) * ((2 * b.item + 1) % 999917) % 999917 "
        "* ((2 * c.item + 1) % 999917) % 999917 AS bucket, count(*) AS support FROM r a "
        "JOIN r b ON a.order_id = b.order_id AND b.rn = a.rn + 1 "
        "JOIN r c ON a.order_id = c.order_id AND c.rn > b.rn "
        f"GROUP BY 1 HAVING count(*) > {PAIR_SUPPORT}"),
    "write_pairs_text": _pairs_sql() + (
        "SELECT concat('(', item1, ', ', item2, ')') AS value FROM pairs"),
    "rec_upsert": _pairs_sql(_FP.format(s=CANDIDATE_SUPPORT), _RECS) + (
        "SELECT product_id, rec_id, support FROM (SELECT *, row_number() OVER "
        "(PARTITION BY product_id ORDER BY support DESC, rec_id) AS k FROM recs) WHERE k = 1"),
    "rec_topk": _pairs_sql(_FP.format(s=PAIR_SUPPORT), _RECS, _DIRS) + (
        "SELECT * FROM (SELECT d.*, row_number() OVER (PARTITION BY product_id, direction "
        "ORDER BY support DESC, rec_id) AS rank FROM dirs d) WHERE rank <= 5"),
    "rec_union": _pairs_sql(_FP.format(s=PAIR_SUPPORT), _RECS, _DIRS) + (
        "SELECT DISTINCT product_id, rec_id FROM dirs"),
    "rec_lookup": _pairs_sql(_FP.format(s=PAIR_SUPPORT), _RECS, _DIRS, _REQ, _TOP) + (
        "SELECT DISTINCT product_id, rec_id FROM top"),
    "rec_enrich": _pairs_sql(
        _FP.format(s=PAIR_SUPPORT), _RECS, _DIRS, _REQ, _TOP,
        "lk AS (SELECT DISTINCT product_id, rec_id FROM top)",
        "cat AS (SELECT p_partkey AS product_id, p_name AS description, p_brand AS image "
        "FROM part)",
        "pj AS (SELECT lk.product_id, string_agg(CAST(json_object('description', c.description, "
        "'image', c.image) AS VARCHAR), ',' ORDER BY lk.rec_id) AS js FROM lk "
        "JOIN cat c ON c.product_id = lk.rec_id GROUP BY 1)") + (
        "SELECT r.product_id, CASE WHEN c.product_id IS NULL THEN '' ELSE concat('[', "
        "CAST(json_object('description', c.description, 'image', c.image) AS VARCHAR), "
        "coalesce(',' || pj.js, ''), ']') END AS response "
        "FROM req r LEFT JOIN cat c ON c.product_id = r.product_id "
        "LEFT JOIN pj ON pj.product_id = r.product_id"),
    "recs_preview": _pairs_sql(_FP.format(s=0), _RECS) + (
        f"SELECT * FROM recs ORDER BY product_id, rec_id LIMIT {PREVIEW_ROWS}"),
    "fp_growth": (
        "WITH bt AS (SELECT DISTINCT o_orderkey AS oid, p_type AS t FROM orders "
        "JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey), "
        f"th AS (SELECT ceil({FP_MIN_SUPPORT} * count(DISTINCT oid)) AS m FROM bt), "
        "s AS (SELECT t AS items, count(*) AS freq FROM bt GROUP BY 1 "
        "UNION ALL SELECT a.t || ' ' || b.t, count(*) FROM bt a "
        "JOIN bt b ON a.oid = b.oid AND a.t < b.t GROUP BY 1 "
        "UNION ALL SELECT a.t || ' ' || b.t || ' ' || c.t, count(*) FROM bt a "
        "JOIN bt b ON a.oid = b.oid AND a.t < b.t JOIN bt c ON c.oid = a.oid AND b.t < c.t "
        "GROUP BY 1 "
        "UNION ALL SELECT a.t || ' ' || b.t || ' ' || c.t || ' ' || e.t, count(*) FROM bt a "
        "JOIN bt b ON a.oid = b.oid AND a.t < b.t JOIN bt c ON c.oid = a.oid AND b.t < c.t "
        "JOIN bt e ON e.oid = a.oid AND c.t < e.t GROUP BY 1) "
        "SELECT items, freq FROM s WHERE freq >= (SELECT m FROM th)"),
    "probe_random_pairs": _pairs_sql(
        f"it AS (SELECT item FROM bp GROUP BY item HAVING count(*) > {PROBE_ITEM_SUPPORT})",
        "bk AS (SELECT ((item1 % 1000) * (item2 % 1000)) % 1000 AS bucket FROM pairs "
        f"GROUP BY 1 HAVING count(*) > {PROBE_BUCKET_SUPPORT})",
        "n AS (SELECT count(*) AS n FROM part)",
        f"pp AS (SELECT s.i, (s.i * {PROBE_MULTIPLIER} + {PROBE_OFFSET}) % n.n + 1 AS j "
        "FROM n, (SELECT generate_series AS i FROM generate_series(1, "
        "(SELECT count(*) FROM part))) s)") + (
        "SELECT (SELECT n FROM n) AS probes, count(*) AS hits FROM pp "
        "WHERE i IN (SELECT item FROM it) AND j IN (SELECT item FROM it) "
        "AND ((i % 1000) * (j % 1000)) % 1000 IN (SELECT bucket FROM bk)"),
    # by splitting at the tags, with no pattern; entities as the pages use them
    "page_extract": (
        "WITH p AS (SELECT page_id, string_split(html, '<div class=\"ad\">') AS s FROM pages) "
        "SELECT page_id, replace(replace(replace(replace(replace(string_split(s[2], '</div>')[1], "
        "'&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#x27;', ''''), '&amp;', '&') AS description, "
        "CAST(NULL AS VARCHAR) AS image FROM p WHERE len(s) = 2"),
    "page_extract_product": (
        "SELECT page_id, replace(replace(replace(replace(replace(regexp_extract(html, '<h1>([^<]*)</h1>', 1), "
        "'&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#x27;', ''''), '&amp;', '&') AS description, "
        "url || '?a=1&b=2' AS image FROM pages WHERE html IS NOT NULL AND url IS NOT NULL"),
}
ORACLE_SQL["pcy_candidates_raw"] = ORACLE_SQL["pcy_candidates"].replace("item % 100000000 AS k", "item AS k")
ORACLE_SQL["pcy_candidates_store"] = ORACLE_SQL["pcy_candidates_raw"]
ORACLE_SQL["order_part_join_salted"] = ORACLE_SQL["order_part_join"]
ORACLE_SQL["pcy_candidates_bitmap"] = ORACLE_SQL["pcy_candidates_raw"]
ORACLE_SQL["rec_lookup_stored"] = ORACLE_SQL["rec_lookup"]
ORACLE_SQL["probe_saved"] = (
    f"SELECT probes, hits, hits / probes AS hit_rate FROM ({ORACLE_SQL['probe_random_pairs']})")
ORACLE_SQL["write_baskets_csv"] = ORACLE_SQL["basket_lines_csv"]
ORACLE_SQL["csv_basket_runs"] = _with(_BP) + (
    f"SELECT order_id, count(*) AS n_items, {_BASKET_STR} AS items FROM bp GROUP BY order_id "
    "HAVING count(*) >= 2")
ORACLE_SQL["basket_parse_permissive"] = _with(_BP) + "SELECT order_id, item FROM bp WHERE order_id % 3 <> 1"
ORACLE_SQL["pcy_pass_frequent"] = _pairs_sql() + (
    "SELECT (item1 % 100000000) * (item2 % 100000000) % 100000000 AS bucket, count(*) AS support "
    f"FROM pairs GROUP BY 1 HAVING count(*) > {PAIR_SUPPORT}")
ORACLE_SQL["pcy_pass_groups"] = _pairs_sql() + "SELECT order_id, item1, item2 FROM pairs"
_GROUPS_4 = (
    "SELECT a.order_id, a.item AS item1, b.item AS item2, c.item AS item3, e.item AS item4 FROM r a "
    "JOIN r b ON a.order_id = b.order_id AND b.rn = a.rn + 1 "
    "JOIN r c ON a.order_id = c.order_id AND c.rn = a.rn + 2 "
    "JOIN r e ON a.order_id = e.order_id AND e.rn > c.rn")
ORACLE_SQL["item_groups_4"] = ORACLE_SQL["pcy_pass_3_groups"] = _with(_BP, _R) + _GROUPS_4
ORACLE_SQL["pcy_pass_3_frequent"] = _with(_BP, _R) + (
    "SELECT (a.item % 100000000) * (b.item % 100000000) % 100000000 * (c.item % 100000000) % 100000000 "
    "AS bucket, count(*) AS support FROM r a JOIN r b ON a.order_id = b.order_id AND b.rn = a.rn + 1 "
    "JOIN r c ON a.order_id = c.order_id AND c.rn > b.rn GROUP BY 1 HAVING count(*) > 0")
ORACLE_SQL["pcy_pass_3_bitmap"] = _with(_BP, _R, f"g AS ({_GROUPS_4})") + (
    "SELECT ((2 * item1 + 1) % 999917) * ((2 * item2 + 1) % 999917) % 999917 * ((2 * item3 + 1) % 999917) "
    "% 999917 * ((2 * item4 + 1) % 999917) % 999917 AS bucket, count(*) AS support FROM g GROUP BY 1 "
    f"HAVING count(*) > {PAIR_SUPPORT}")
ORACLE_SQL["rec_upsert_merge"] = _pairs_sql(_FP.format(s=PAIR_SUPPORT), _RECS) + (
    "SELECT product_id, rec_id, support FROM (SELECT *, row_number() OVER (PARTITION BY product_id "
    f"ORDER BY support > {CANDIDATE_SUPPORT} DESC, support DESC, rec_id) AS k FROM recs) WHERE k = 1")
