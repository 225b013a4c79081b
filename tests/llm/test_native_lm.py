import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from basketry.llm import lm, pii, quality, urlfilter
from tests.llm.conftest import frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def statistics(text):
    text = text or ""
    w = WORD.findall(text)
    win = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    many = Counter(win)
    covered = {k for i, x in enumerate(win) if many[x] > 1 for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def test_statistics_match_brute_force(llm, odd):
    rnd = random.Random(4)
    texts = [" ".join(rnd.choice("abc") for _ in range(rnd.randrange(60))) for _ in range(200)]
    texts += ["a " * 9, "a " * 8, "x\n\n x\nx\n\t\nx", "# $\x0b%|", "é ñ 🙂", "\r\n\r\n"]
    for df in (frame(llm, texts), odd):
        got = quality.text_statistics(df, "doc_id", "text").collect()
        assert len(got) == df.count()
        for r in got:
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == statistics(r["text"])


def test_outliers_go_and_clean_texts_stay(llm, odd, empty):
    docs = llm.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = llm.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.quality(docs).join(labels, "doc_id").filter("NOT base_failed").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1]
    bad = [r["kept"] for r in rows if r["quality"] == 0]
    assert all(good) and sum(bad) <= 0.1 * len(bad)
    got = quality.quality(odd).collect()
    assert len(got) == odd.count() and all(r["kept"] is not None for r in got)
    assert quality.quality(empty).count() == 0


def test_mcd_ignores_outliers(llm):
    rnd = np.random.default_rng(1)
    good = rnd.multivariate_normal([5, -3], [[4, 1.5], [1.5, 1]], 3000)
    bad = rnd.multivariate_normal([40, 30], [[1, 0], [0, 1]], 400)
    rows = [("g", float(a), float(b)) for a, b in np.vstack([good, bad])] + [("same", 1.0, 2.0)] * 50
    est = {r["g"]: r for r in quality.mcd(llm.createDataFrame(rows, "g string, a double, b double"), "g",
                                          ["a", "b"], [0.01, 0.01]).collect()}
    g = est["g"]
    assert abs(g["m_0"] - 5) < 0.3 and abs(g["m_1"] + 3) < 0.2
    assert 0.5 < g["l_0_0"] / 2 < 1.6 and est["same"]["m_0"] == 1.0 and est["same"]["l_0_0"] > 0


def bin_quantile(x, q, width):
    bins, counts = np.unique(np.floor(np.asarray(x) / width), return_counts=True)
    return (bins[np.argmax(np.cumsum(counts) >= len(x) * q)] + 0.5) * width


def factor(c, floors):
    """Lower factor by columns, a rest of variance below the floor raised to it."""
    low, rest = np.zeros_like(c), c.copy()
    for j in range(len(c)):
        rest[j, j] = max(rest[j, j], floors[j]**2)
        low[j:, j] = rest[j:, j] / math.sqrt(rest[j, j])
        rest -= np.outer(low[:, j], low[:, j])
    return low


def distance2(x, m, c, floors):
    return (np.linalg.solve(factor(c, floors), (x - m).T)**2).sum(0)


def plain_mcd(x, floors):
    """Centre and covariance by plain numpy: four starts, three steps, least determinant."""
    m = np.array([bin_quantile(col, 0.5, 1 / 64) for col in x.T])
    s = np.maximum([1.4826 * bin_quantile(np.abs(col - c), 0.5, 1 / 64) for col, c in zip(x.T, m)], floors)
    z = (x - m) / s
    turn = z[(z**2).sum(1) > 0]
    turn = turn / np.sqrt((turn**2).sum(1))[:, None]
    starts = [(first, m, np.diag(s**2)) for first in quality.FIRST]
    if len(turn):
        starts.append((0.75, m, turn.T @ turn / len(turn) * x.shape[1] * np.outer(s, s)))
    ends = []
    for first, m, c in starts:
        for share in (first, 0.75, 0.75):
            d = np.log1p(distance2(x, m, c, floors))
            near = x[d <= bin_quantile(d, share, 1 / 64) + 1 / 128]
            m, c = near.mean(0), np.cov(near.T, bias=True) * quality.CONSISTENCY[0.75]
        ends.append((np.log(np.diag(factor(c, floors))).sum(), m, c))
    return min(ends, key=lambda e: round(e[0], 9))[1:]


def test_verdicts_match_a_plain_version(llm):
    """quality() against Python statistics and numpy estimates of every level, mixed by hand."""
    docs = llm.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source")
    odd_lang = [(-1 - i, f"only {i} " + "few words of a small language " * (1 + i % 3), "xx", None) for i in range(7)]
    docs = docs.unionByName(llm.createDataFrame(odd_lang, docs.schema))
    rows = [(r["doc_id"], (r["lang"], r["source"]), statistics(r["text"])) for r in docs.collect()]
    ok = [(i, g, s) for i, g, s in rows if s[0] >= 20 and 100 * s[4] <= 30 * s[0]]
    levels = lambda g: (g, g[:1], ())
    size = Counter(k for _, g, _ in ok for k in levels(g))
    own = {k: n / (n + quality.SHRINK) for k, n in size.items()}
    middle = {k: bin_quantile([s[1] / s[0] for _, g, s in ok if k in levels(g)], 0.5, 1 / 64) for k in size}

    def mixed_middle(g):
        up = own[g[:1]] * middle[g[:1]] + (1 - own[g[:1]]) * middle[()]
        return own[g] * middle[g] + (1 - own[g]) * up

    raw = np.array([((s[1] / s[0] - mixed_middle(g)) * math.sqrt(s[0]), math.sqrt(s[2] / s[1]), math.sqrt(s[3] / s[0]),
                     math.sqrt(s[4] / s[0])) for _, g, s in ok])
    grid = np.round(raw * quality.GRID) / quality.GRID
    floors = [quality.FLOOR[v] for v in quality.VECTOR]
    est = {k: plain_mcd(grid[[k in levels(g) for _, g, _ in ok]], floors) for k in size}

    def mix(k, up):
        w, off = own[k], est[k][0] - up[0]
        return w * est[k][0] + (1 - w) * up[0], w * est[k][1] + (1 - w) * up[1] + w * (1 - w) * np.outer(off, off)

    got = {r["doc_id"]: r for r in quality.quality(docs).collect()}
    assert len(got) == len(rows)
    for (i, g, _), v in zip(ok, raw):
        m, c = mix(g, mix(g[:1], est[()]))
        d2 = float(distance2(v[None], m, c, floors)[0])
        assert got[i]["distance2"] == pytest.approx(d2, rel=1e-6, abs=1e-9)
        assert got[i]["kept"] == (d2 <= quality.LIMIT)
    judged = {i for i, _, _ in ok}
    assert all(not r["kept"] and r["distance2"] is None for i, r in got.items() if i not in judged)


def test_least_determinant_of_several_starts(llm):
    """A group that median and median deviation start badly: two crossing clouds, one much tighter."""
    rnd = np.random.default_rng(3)
    tight = rnd.multivariate_normal([0, 0], [[9, 8.9], [8.9, 9]], 3000)
    wide = rnd.multivariate_normal([3, -9], [[25, 0], [0, 25]], 900)
    x = np.round(np.vstack([tight, wide]) * quality.GRID) / quality.GRID
    rows = [("g", float(a), float(b)) for a, b in x] + [("far", 1e300, 2.0), ("far", -1e300, 2.0)]
    est = {r["g"]: r for r in quality.mcd(llm.createDataFrame(rows, "g string, a double, b double"), "g",
                                          ["a", "b"], [0.01, 0.01]).collect()}
    m, c = plain_mcd(x, [0.01, 0.01])
    assert [est["g"]["m_0"], est["g"]["m_1"]] == pytest.approx(list(m), rel=1e-6)
    assert [est["g"]["c_0_0"], est["g"]["c_1_0"], est["g"]["c_1_1"]] == pytest.approx([c[0, 0], c[1, 0], c[1, 1]], rel=1e-6)
    assert est["far"]["n"] == 2 and abs(est["far"]["m_0"]) <= quality.LARGEST


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    checks = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
              ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
              ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
              ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15))
    return [f"{k}:{m.start()}:{m.end()}" for k, p, ok in checks for m in re.finditer(p, text or "") if ok(m.group())]


ODD_PII = ["a@b.cd@e.f a@b.c_d@e.f.g x@y x@y. @a.b +1 (2) 3-4 +12345678 +1-2 1.2.3.4.5.6.7.8 999.1.1.1 0000255.1.1.1 1.2.3 4.5.6.7",
           "4111 1111 1111 1111 é🙂 a@b.co 🙂4111-1111-1111-1111-", "1" * 3000, "a" * 20_000, "." * 500 + "1.1.1.1" + "@" * 50,
           "", None, "+" * 100 + "1 2 3 4 5 6 7 8", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0", "a@b.c " * 300]


def test_base_spans_match_plain_patterns(llm, odd, empty):
    rnd = random.Random(3)
    texts = ODD_PII + ["".join(rnd.choice("a1.@+- ()é🙂25_%") for _ in range(300)) for _ in range(300)]
    got = {r["doc_id"]: r for r in pii.personal_data(frame(llm, texts)).collect()}
    for i, t in enumerate(texts):
        want = base_spans(t)
        assert hashlib.sha256(",".join(want).encode()).hexdigest() == got[i]["base_sha256"]
        assert set(want) <= set(got[i]["spans"].split(","))
        for k in pii.BASE:
            assert got[i][f"n_{k}"] == sum(s.startswith(k) for s in want)
    assert pii.personal_data(odd).count() == odd.count()
    assert pii.personal_data(empty).count() == 0 and pii.masked(empty).count() == 0


def test_secrets_are_added_and_masked(llm, odd):
    docs = llm.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    secrets = {f"secret:{m.start(1)}:{m.end(1)}": d for d, t in texts.items()
               for m in re.finditer(r'token = "([0-9a-f]{40})"', t)}
    found = {s: r["doc_id"] for r in pii.personal_data(docs).collect() for s in r["spans"].split(",") if s}
    assert secrets and set(secrets.items()) <= set(found.items())
    masked = pii.masked(docs)
    assert masked.columns == docs.columns and masked.count() == docs.count()
    for r in masked.collect():
        assert not base_spans(r["text"]) or "[" in r["text"]
        if not base_spans(texts[r["doc_id"]]) and "token" not in texts[r["doc_id"]]:
            assert r["text"] == texts[r["doc_id"]] or "[SECRET]" in r["text"]
    same = pii.masked(odd)
    assert same.columns == odd.columns
    key = lambda r: tuple(map(repr, r))
    assert sorted(map(key, same.collect())) == sorted(map(key, odd.collect()))


def test_em_finds_reliable_labelers(llm):
    rnd = random.Random(1)
    rows = Counter()
    for _ in range(4000):
        truth = rnd.random() < 0.4
        votes = [int(rnd.random() < (p if truth else q)) for p, q in ((0.95, 0.05), (0.9, 0.2), (0.85, 0.1), (0.5, 0.5), (0.8, 0.3))]
        rows[("email", *votes)] += 1
    df = llm.createDataFrame([(*k, float(n)) for k, n in rows.items()],
                             "kind string, " + ", ".join(f"{v} int" for v in pii.VOTES) + ", n double")
    prior, right, wrong = pii.reliabilities(df, 30)
    assert abs(prior["email"] - 0.4) < 0.1
    assert abs(right["v_check"] - 0.95) < 0.07 and abs(wrong["v_check"] - 0.05) < 0.07
    assert abs(right["v_border"] - wrong["v_border"]) < 0.15


def test_as_of_join_uses_the_entry_in_force(llm):
    ts = lambda d: f"2024-01-{d:02d} 00:00:00"
    entries = llm.createDataFrame([
        (1, "block", "domain", "Bad.example", "add", ts(2)), (2, "block", "domain", "bad.example", "remove", ts(10)),
        (3, "block", "host", "x.ok.example", "add", ts(5)), (4, "allow", "path", "a.bad.example/good", "add", ts(1)),
        (5, "block", "host", "tie.example", "remove", ts(3)), (6, "block", "host", "tie.example", "add", ts(3)),
        (6, "block", "host", "tie.example", "add", ts(3)), (7, "block", "host", None, "add", ts(3)),
    ], "entry_id long, list string, kind string, value string, action string, at string").selectExpr(
        "* EXCEPT (at)", "cast(at as timestamp) at")
    pages = [(1, "http://A.bad.example/x", ts(1)), (2, "http://a.bad.example/x", ts(2)), (3, "http://u@a.bad.example:80/x", ts(9)),
             (4, "http://a.bad.example/x", ts(10)), (5, "https://a.bad.example/good?q", ts(9)), (6, "http://notbad.example", ts(9)),
             (7, "http://x.ok.example.", ts(20)), (8, "http://ok.example/", ts(20)), (9, None, ts(9)), (10, "nonsense", ts(9)),
             (11, "http://bad.example", None), (12, "http://tie.example", ts(4)), (12, "http://tie.example", ts(4)),
             (13, "http://" + "a." * 300 + "bad.example", ts(9)), (14, "", ts(9))]
    caps = llm.createDataFrame(pages, "page_id long, url string, fetched_at string").selectExpr(
        "page_id", "url", "cast(fetched_at as timestamp) fetched_at", "'x' key", "'y' row", "1 bucket")
    got = urlfilter.filter_urls(caps, entries).collect()
    assert sorted((r["page_id"], r["entries"], r["kept"]) for r in got) == [
        (1, "", True), (2, "1", False), (3, "1", False), (4, "", True), (5, "1,4", True), (6, "", True), (7, "3", False),
        (8, "", True), (9, "", True), (10, "", True), (11, "", True), (12, "6", False), (12, "6", False), (13, "", True), (14, "", True)]
    assert urlfilter.filter_urls(caps.limit(0), entries).count() == 0
    assert urlfilter.filter_urls(caps, entries.limit(0)).filter("kept").count() == len(pages)


def test_lm_scores(llm, odd, empty):
    docs = llm.read.parquet("/root/testdata/sf0.001/documents.parquet").unionByName(
        odd.select("doc_id", "text", "lang", "source").selectExpr("doc_id + 1000000 doc_id", "text", "lang", "source"),
        allowMissingColumns=True)
    rows = docs.select("doc_id", "text").collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    tokens = [(i, WORD.findall((t or "").translate(LOW)) + [""]) for i, t in rows]
    c = Counter(w for i, ws in tokens for w in ws if not held(i))
    n, v = sum(c.values()), len(c)
    want = sorted((repr(i), held(i), len(ws), sum(c[w] > 0 for w in ws),
                   round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 4)) for i, ws in tokens)
    scored = lm.score_documents(docs).collect()
    got = sorted((repr(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], round(r["base_score"], 4)) for r in scored)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert all(g[4] == pytest.approx(w[4], rel=1e-6, abs=1e-3) for g, w in zip(got, want, strict=True))
    assert {r["train_tokens"] for r in scored} == {n}
    text = [r for r in scored if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 1_000_000]
    bits = -sum(r["score"] for r in text) / math.log10(2) / sum(r["n_bytes"] for r in text)
    assert 1 < bits < 3.2 and all(r["score"] < 0 for r in scored)
    assert lm.score_documents(empty).count() == 0


def test_lm_is_a_probability():
    """Over all strings of one symbol and the end, bits of the code tree sum to one."""
    counts = np.ones(257)
    code = lm.Code(counts)
    model = lm.Mixer(code, 16, np.random.default_rng(1).integers(-60, 60, (len(lm.CONTEXTS), 1 << 16)).astype(np.int8))
    first = sum(10 ** lm_first(model, s) for s in range(257))
    assert first == pytest.approx(1.0, rel=1e-5)


def lm_first(model, symbol):
    """log10 probability of one first symbol."""
    sym = np.concatenate([np.full(lm.WORD, lm.PAD), [symbol]]).astype(np.uint32)
    here = np.array([lm.WORD])
    total, zero = np.zeros(1), np.zeros((len(lm.CONTEXTS), 1), np.float32)
    model._block(sym, here, np.zeros(1, np.int64), zero, total, zero.astype(float), np.zeros(1))
    return total[0] / math.log(10)


def test_lm_contexts_keep_their_own_counts(llm):
    """Opinions are the log odds of each context's own counts, however many contexts there are, and
    don't depend on how blocks and ranges are cut."""
    rnd = random.Random(8)
    texts = ["".join(rnd.choice("abcdefgh é") for _ in range(rnd.randrange(1, 200))).encode() for _ in range(60)]
    code = lm.Code(np.bincount(np.frombuffer(b"".join(texts), np.uint8), minlength=257) + 0.0)
    n = Counter()
    sym, at, _ = lm.symbols(texts)
    for i in at.tolist():
        for d in range(code.length[sym[i]]):
            for c in (2, 4):
                n[c, tuple(sym[i - c:i].tolist()), code.node[d, sym[i]], code.bit[d, sym[i]]] += 1
    keys, counts = lm.count_keys(texts, code)
    views, _ = lm.opinions_of(keys, counts, code)
    (_, model, sym, at, _), = lm.answered(texts, code, views)
    for d, (sel, _, _, seen) in enumerate(model._bits(sym, at, *model._contexts(sym, at))):
        for j, i in enumerate(at[sel].tolist()):
            for k, c in ((0, 2), (1, 4)):
                context, node = tuple(sym[i - c:i].tolist()), code.node[d, sym[i]]
                odds = math.log((n[c, context, node, 1] + 0.4) / (n[c, context, node, 0] + 0.4)) * lm.STEP
                assert seen[k][j] == np.clip(np.rint(odds), -127, 127)
    docs = frame(llm, [t.decode() for t in texts])
    whole = {r["doc_id"]: r["score"] for r in lm.score_documents(docs).collect()}
    cut = {r["doc_id"]: r["score"] for r in lm.score_documents(docs, block_bytes=900, range_bytes=700).collect()}
    assert cut == pytest.approx(whole, rel=1e-5) and len(cut) == len(texts)


def test_lm_learns_its_tuning_texts(llm):
    """A held-out copy of a learning text is foretold even if all learning texts are in the tuning sample."""
    rnd = random.Random(9)
    order = llm.range(2000).selectExpr("id", f"pmod(xxhash64(id), {lm.TUNING_SHARE}) = 0 AS tuned").collect()
    held = [r["id"] for r in order if zlib.crc32(str(r["id"]).encode()) % 10 == 0][:2]
    tuned = [r["id"] for r in order if r["tuned"] and zlib.crc32(str(r["id"]).encode()) % 10][:40]
    fresh = lambda: " ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(9)) for _ in range(60))
    texts = [(i, fresh()) for i in tuned]
    rows = [*texts, (held[0], texts[5][1]), (held[1], fresh())]
    bits = {r["doc_id"]: r["bits_per_byte"] for r in lm.score_documents(frame(llm, rows)).collect()}
    assert bits[held[0]] < 0.7 * bits[held[1]]
    docs = frame(llm, rows).selectExpr("doc_id", "text", f"doc_id in ({held[0]}, {held[1]}) AS held_out")
    want = Counter("".join(t for _, t in texts).encode())
    got = lm.symbol_counts(lm.pack(docs, 2000))
    assert got[lm.END] == len(texts) and {s: n for s, n in enumerate(got[:256].tolist()) if n} == want


def test_dotted_secrets_are_candidates(llm):
    token, jwt = "sk-a1B2c3D4e5F6g7H8i9J0k1L2", "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmNHl0w5N"
    texts = [f"the token is {token}. Next", f"bearer {jwt} end", f"host {token}.example", f"mail {token}@x.y"]
    found = pii.candidates(pii.keyed(frame(llm, texts))).filter("kind = 'secret'").join(
        pii.keyed(frame(llm, texts)), "key").collect()
    got = {r["doc_id"]: r["t"][r["start"]:r["end"]] for r in found}
    assert got == {0: token, 1: jwt}
