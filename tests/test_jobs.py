import os

from basketry.jobs import run_fpgrowth, run_pcy, run_recommend
from basketry.plans.baskets import order_baskets
from basketry.plans.pcy import pcy_candidates
from basketry.sinks.tables import save_table
from basketry.sources.tables import order_lines_from_dir
from tests.conftest import SF_SMALL


def test_pcy_job_end_to_end(spark, tmp_path):
    text = order_baskets(spark, SF_SMALL, str(tmp_path / "baskets"))
    out = run_pcy(spark, text, str(tmp_path / "out"), 2, strategy="broadcast")
    pairs = sorted(r.value for r in spark.read.text(out["pairs"]).collect())
    expect = pcy_candidates(order_lines_from_dir(spark, SF_SMALL), 2)
    assert pairs == sorted(f"({r.item1}, {r.item2})" for r in expect.collect())
    recs = spark.read.parquet(out["recommendations"])
    assert recs.count() == recs.select("product_id").distinct().count() > 0
    assert spark.read.parquet(out["items"]).count() > 0
    assert spark.read.parquet(out["bitmap"]).count() > 0


def test_fpgrowth_and_recommend_jobs(spark, tmp_path):
    tx = tmp_path / "tx"
    tx.mkdir()
    (tx / "a.txt").write_text("a b c\na b\nb c\na b c\n")
    sets = spark.read.parquet(run_fpgrowth(spark, str(tx), str(tmp_path / "sets"), 0.5))
    got = {tuple(sorted(r.items)): r.freq for r in sets.collect()}
    assert got[("a", "b")] == 3 and got[("b",)] == 4
    recs = save_table(spark.createDataFrame([(1, 2, 3)], "product_id BIGINT, rec_id BIGINT, "
                                            "support BIGINT"), str(tmp_path / "recs"))
    req = save_table(spark.createDataFrame([(1,), (2,)], "product_id BIGINT"),
                     str(tmp_path / "req"))
    cat = save_table(spark.createDataFrame([(1, "x", "x.png"), (2, "y", "y.png")],
                                           "product_id BIGINT, description STRING, image STRING"),
                     str(tmp_path / "cat"))
    out = spark.read.parquet(run_recommend(spark, recs, req, cat, str(tmp_path / "resp")))
    got = {r.product_id: r.response for r in out.collect()}
    assert got[2].startswith('[{"description":"y"') and '"x.png"' in got[2]
    assert os.path.isdir(str(tmp_path / "resp"))
