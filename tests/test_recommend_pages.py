import json
import random

from basketry.operators.pages import extract_unique, parse_unique
from basketry.operators.recommend import (lookup, rec_union, recs_preview, top_partners,
                                          upsert_recommendations)
from basketry.plans.recommend import respond
from basketry.sources.seed import seed_recommendations, seed_requests
from basketry.session import ship_package


def test_seed_lookup_backward_direction(spark):
    recs = seed_recommendations(spark)
    got = lookup(recs, spark.createDataFrame([(13417,)], "product_id BIGINT"))
    assert sorted(r.rec_id for r in got.collect()) == [12638, 12646, 12661, 12706, 12731]
    both = lookup(recs, seed_requests(spark))
    got = {}
    for r in both.collect():
        got.setdefault(r.product_id, set()).add(r.rec_id)
    assert got[383150] == {383151, 247267}
    assert got[8031] == {440740}
    assert 243489 not in got  # asked for, but it has no partner


def _recs(spark, rows):
    return spark.createDataFrame(rows, "product_id BIGINT, rec_id BIGINT, support BIGINT")


def test_topk_order_and_limit(spark):
    recs = _recs(spark, [(1, i, s) for i, s in [(2, 5), (3, 9), (4, 5), (5, 1), (6, 5), (7, 5),
                                                 (8, 5)]])
    fwd = top_partners(recs, 3).where("product_id = 1 AND direction = 'forward'")
    assert [r.rec_id for r in fwd.orderBy("rank").collect()] == [3, 2, 4]
    bwd = top_partners(recs, 3).where("direction = 'backward'")
    assert sorted(r.product_id for r in bwd.collect()) == [2, 3, 4, 5, 6, 7, 8]


def test_upsert_one_row_per_product_deterministic(spark):
    recs = _recs(spark, [(1, 9, 2), (1, 3, 2), (1, 5, 1), (2, 4, 1)])
    got = {r.product_id: (r.rec_id, r.support) for r in upsert_recommendations(recs).collect()}
    assert got == {1: (3, 2), 2: (4, 1)}
    old = _recs(spark, [(1, 7, 99), (5, 6, 1)])
    got = {r.product_id: r.rec_id for r in upsert_recommendations(recs, old).collect()}
    assert got == {1: 3, 2: 4, 5: 6}


def test_union_and_preview(spark):
    recs = _recs(spark, [(1, 2, 1), (2, 1, 1), (3, 1, 1)])
    assert sorted(tuple(r) for r in rec_union(recs).collect()) == \
        [(1, 2), (1, 3), (2, 1), (3, 1)]
    assert [r.product_id for r in recs_preview(recs, 2).collect()] == [1, 2]


def test_respond_json_unknown_and_missing_partner(spark):
    recs = _recs(spark, [(1, 2, 3), (1, 3, 2), (4, 1, 1)])
    catalog = spark.createDataFrame([(1, "chair", "c.png"), (2, "desk", "d.png"),
                                     (4, "lamp", "l.png"), (5, "rug", "r.png")],
                                    "product_id BIGINT, description STRING, image STRING")
    requests = spark.createDataFrame([(1,), (3,), (5,), (9,)], "product_id BIGINT")
    out = {r.product_id: r.response for r in respond(requests, recs, catalog).collect()}
    assert json.loads(out[1]) == [{"description": "chair", "image": "c.png"},
                                  {"description": "desk", "image": "d.png"},
                                  {"description": "lamp", "image": "l.png"}]
    assert out[3] == ""  # unknown product
    assert out[9] == ""
    assert json.loads(out[5]) == [{"description": "rug", "image": "r.png"}]


PAGE_ONE = ('<html><div class="product-item big"><span class="product-description">Office '
            '<b>chair</b></span><img class="product-item-img" src="/a.jpg?x=1&amp;y=2"></div>'
            '</html>')
PAGE_TWO = '<div class="product-item">a</div><div class="product-item">b</div>'


def test_parse_unique_nested_markup():
    assert parse_unique(PAGE_ONE, "product-item", "product-description",
                        "product-item-img") == ("Office chair", "/a.jpg?x=1&y=2")
    assert parse_unique(PAGE_TWO, "product-item") is None
    assert parse_unique("<p>none</p>", "product-item") is None


def test_extract_unique(spark):
    ship_package(spark)
    pages = spark.createDataFrame(
        [(1, '<div class="ad">Buy &amp; save</div>'), (2, '<div class="ad">x</div>' * 2),
         (3, "<p>no ad</p>"), (4, '<div id="z" class="top ad">y</div>'),
         (5, '<div class="adx">no</div>'), (6, PAGE_ONE),
         (7, '<div class="ad">flat</div><p><div class="ad">a<b>nested</b></div></p>'),
         (8, "<div class='ad'>quoted</div>"), (9, '<div class="ad">x <b>y</b></div>'),
         (10, '<div class="ad">a&nbsp;&#233;</div>'), (11, None), (12, "")],
        "page_id BIGINT, html STRING")
    got = {r.page_id: r.description for r in extract_unique(pages, "ad").collect()}
    assert got == {1: "Buy & save", 4: "y", 8: "quoted", 9: "x y", 10: "a\u00a0é"}
    nested = extract_unique(pages, "product-item", "product-description", "product-item-img")
    assert [tuple(r) for r in nested.collect()] == [(6, "Office chair", "/a.jpg?x=1&y=2")]


def test_extract_unique_equals_the_parser(spark):
    """Random markup, regular and broken, against the parser page by page."""
    ship_package(spark)
    rng = random.Random(7)
    bits = ['<div class="ad">', '<div class="ad x" id=q>', "<div class='bad'>", "<div>", "</div>", "</div>", "<p>", "</p>",
            "<b>", "</b>", "<br>", "<br/>", '<b class="t">', '<p class="t u">', "</b>", "</p>", '<img class="i" src="/a?x=1&amp;y">',
            '<img class="i">', '<img class="i" src="">', "<img src='/b' class='i'>", "text ", "a &amp; b", "&lt;", "&eacute;", "&copy", "é",
            "<!-- <div class='ad'> -->", "<script>var t='<div class=\"ad\">'</script>", "1 < 2", "a > b", "<DIV CLASS='ad'>",
            '<p title="x class=\'ad\'>">', "<div class=ad>", "</span>", "<span>", "\n"]
    docs = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    docs += ['<div class="ad">' + "".join(rng.choice(bits[10:26]) for _ in range(4)) + "</div>" + rng.choice(bits)
             for _ in range(500)]
    docs.append('<div class="ad">' + "<b>w</b> " * 5000 + "</div>" + "<p a='1'>" * 5000)
    pages = spark.createDataFrame(list(enumerate(docs)), "page_id BIGINT, html STRING").repartition(4)
    for text_class, img_class in ((None, None), ("t", "i")):
        got = {r.page_id: (r.description, r.image)
               for r in extract_unique(pages, "ad", text_class, img_class).collect()}
        want = {i: w for i, d in enumerate(docs) if (w := parse_unique(d, "ad", text_class, img_class)) is not None}
        assert len(want) > 300
        assert [(docs[i][:300], got.get(i), want.get(i)) for i in got | want if got.get(i) != want.get(i)][:5] == []


def test_respond_keeps_null_fields(spark):
    recs = spark.createDataFrame([(1, 2, 5)], "product_id BIGINT, rec_id BIGINT, support BIGINT")
    cat = spark.createDataFrame([(1, "chair", None), (2, None, "l.png")],
                                "product_id BIGINT, description STRING, image STRING")
    req = spark.createDataFrame([(1,)], "product_id BIGINT")
    assert json.loads(respond(req, recs, cat).first().response) == [
        {"description": "chair", "image": None}, {"description": None, "image": "l.png"}]
