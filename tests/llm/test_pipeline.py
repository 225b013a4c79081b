import hashlib
import re

import numpy as np

import corpus_pipeline
from basketry.llm import langid
from tests.llm.test_decontam_bpe_langid import brute, reference
from tests.llm.test_dedup import brute_components
from tests.llm.test_native_lm import base_spans

SF = "/root/testdata/sf0.001"


def test_each_stage_on_its_own_input(llm):
    docs = llm.read.parquet(f"{SF}/documents.parquet")
    bench = [tuple(r) for r in llm.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_duplicates", "decontaminate", "personal_data", "encode"]
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        rows = {r["doc_id"]: r["text"] for r in before.collect()}
        after = stage(llm, before, SF).cache()
        got = {r["doc_id"]: r for r in after.collect()}
        if name != "encode":
            assert after.columns == docs.columns
        if name == "language":
            assert set(got) == {i for i, t in rows.items() if re.search(r"[^\W\d_]", t or "")}
        elif name == "near_duplicates":
            want = brute_components(list(rows.items()), 5)
            assert set(map(repr, got)) == {r[0] for r in want if r[3]}
        elif name == "decontaminate":
            hit = {i: brute(t, bench, 13) for i, t in rows.items()}
            assert set(got) == {i for i, (n, h, _) in hit.items() if not (h > 0 and 20 * h >= n)}
        elif name == "personal_data":
            assert set(got) == set(rows)
            assert not any(base_spans(r["text"]) for r in got.values())
        else:
            tok = reference()
            for i, t in rows.items():
                ids = tok.encode(t or "", add_special_tokens=False).ids
                assert got[i]["ids"] == ids
                assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
                assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
        before = after


def test_run_and_odd_rows(llm, odd):
    n = corpus_pipeline.run(llm, SF).count()
    docs = llm.read.parquet(f"{SF}/documents.parquet")
    assert 0 < n < docs.count() and langid.determined(docs).count() <= docs.count()
    out = odd
    for name, stage in corpus_pipeline.STAGES:
        out = stage(llm, out, SF)
        assert name == "encode" or out.columns == odd.columns
    assert out.count() > 0
    empty = odd.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(llm, empty, SF)
    assert empty.count() == 0
