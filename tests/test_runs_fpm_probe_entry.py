import os
import random
from collections import Counter
from itertools import combinations
from math import ceil

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_mod
from basketry.operators.baskets import basket_run_rows, basket_runs
from basketry.operators.fpm import fp_growth
from basketry.plans.baskets import csv_basket_lines, csv_basket_runs
from basketry.plans.probe import coprime_multiplier, probe_hits, probe_pairs
from tests.conftest import SF_SMALL


def _python_runs(rows, min_items):
    runs, cur = [], None
    for seq, key, item in rows:
        if cur is not None and cur[0] == key:
            cur[2].append(item)
        else:
            cur = [key, seq, [item]]
            runs.append(cur)
    return sorted((k, s, len(i), tuple(i)) for k, s, i in runs if len(i) >= min_items)


@pytest.mark.parametrize("chunk", [1, 3, 7, 1000])
def test_runs_two_level_equals_single_pass(spark, chunk):
    rng = random.Random(chunk)
    rows = [(i, rng.choice([1, 1, 2, 3]), f"e{i}") for i in range(200)]
    rows += [(200 + i, 9, f"h{i}") for i in range(25)]  # one long run over many chunks
    df = spark.createDataFrame(rows, "seq BIGINT, key BIGINT, item STRING")
    got = basket_runs(df, "key", "item", ["seq"], [F.floor(F.col("seq") / chunk)], min_items=2)
    got = sorted((r.key, r.run_start, r.n_items, tuple(r.items)) for r in got.collect())
    assert got == _python_runs(rows, 2)
    flat = basket_run_rows(df, "key", "item", ["seq"], [F.floor(F.col("seq") / chunk)], 2)
    regrouped = {}
    for r in flat.orderBy("seq").collect():
        regrouped.setdefault((r.key, r.run_start, r.n_items), []).append(r.item)
    assert sorted(k + (tuple(v),) for k, v in regrouped.items()) == _python_runs(rows, 2)


def test_csv_runs_and_grouped_baskets(spark, tmp_path):
    p = tmp_path / "rows"
    p.mkdir()
    (p / "a.csv").write_text("1,a,b,10\n1,a,b,11\n2,a,b,12\n1,a,b,13\n1,a,b,14\n3,a,b,15\n")
    runs = sorted((r.key, tuple(r.items)) for r in csv_basket_runs(spark, str(p)).collect())
    assert runs == [("1", ("10", "11")), ("1", ("13", "14"))]
    lines = sorted(r.line for r in csv_basket_lines(spark, str(p)).collect())
    assert lines == ["1:10 11 13 14"]


def test_fp_growth_matches_counting(spark):
    rng = random.Random(4)
    tx = [sorted({rng.choice("abcdef") for _ in range(rng.randrange(1, 5))}) for _ in range(80)]
    df = spark.createDataFrame([(t,) for t in tx], "items ARRAY<STRING>")
    got = {tuple(sorted(r.items)): r.freq for r in fp_growth(df, 0.2).collect()}
    need = ceil(0.2 * len(tx))
    c = Counter(s for t in tx for k in range(1, len(t) + 1) for s in combinations(t, k))
    assert got == {s: n for s, n in c.items() if n >= need}


def test_fp_growth_removes_repeated_items(spark):
    df = spark.createDataFrame([(["a", "a", "b"],), (["a"],)], "items ARRAY<STRING>")
    got = {tuple(sorted(r.items)): r.freq for r in fp_growth(df, 0.5).collect()}
    assert got == {("a",): 2, ("b",): 1, ("a", "b"): 1}


def test_probe_pairs_are_permutation_and_hits_match(spark):
    n = 500
    a = coprime_multiplier(n, 719)
    pairs = [(r.i, r.j) for r in probe_pairs(spark, n, a, 13).collect()]
    assert sorted(i for i, _ in pairs) == list(range(1, n + 1))
    assert sorted(j for _, j in pairs) == list(range(1, n + 1))
    items = spark.createDataFrame([(i,) for i in range(1, n + 1, 3)], "item BIGINT")
    buckets = spark.createDataFrame([(b,) for b in range(0, 1000, 7)], "bucket BIGINT")
    row = probe_hits(spark, items, buckets, n, a, 13).first()
    iset, bset = set(range(1, n + 1, 3)), set(range(0, 1000, 7))
    expect = sum(1 for i, j in pairs if i in iset and j in iset and (i * j) % 1000 in bset)
    assert (row.probes, row.hits) == (n, expect)
    with pytest.raises(ValueError):
        probe_pairs(spark, 10, 5)


def test_entry_smoke_and_registry(spark):
    df = entry_mod.entry(spark)
    assert df.columns == ["order_id", "item1", "item2"]
    assert df.count() > 0
    assert set(entry_mod.QUERIES) <= set(entry_mod.queries()) & set(entry_mod.oracle_sql())


@pytest.mark.parametrize("name", ["pcy_candidates", "rec_enrich", "basket_runs", "fp_growth"])
def test_registered_queries_run_small(spark, name):
    assert os.path.isdir(SF_SMALL)
    df = entry_mod.queries()[name](spark, SF_SMALL)
    assert df.count() >= 0


def test_fp_growth_pairs_equal_frequent_pairs_on_distinct_baskets(spark):
    from basketry.operators.counting import frequent_pairs
    from basketry.operators.fpm import transaction_sets
    from basketry.sources.tables import order_lines_from_dir

    lines = order_lines_from_dir(spark, SF_SMALL)
    tx = transaction_sets(lines)
    n = tx.count()
    support = 1                        # strict: count > 1, i.e. freq >= 2
    min_support = 1.5 / n              # ceil(1.5) = 2
    sets = fp_growth(tx, min_support).where(F.size("items") == 2)
    got = sorted((min(r.items), max(r.items), r.freq) for r in sets.collect())
    exact = frequent_pairs(lines, support, distinct_items=True).collect()
    assert got == sorted(tuple(r) for r in exact)
    assert len(got) > 0
