import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from basketry.llm import phrases, spelling, toxicity
from basketry.llm.words import chunks, runs, text_bytes
from tests.llm.conftest import frame

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string"


# ---------------------------------------------------------------- words
def test_text_bytes_of_slices_and_runs():
    column = pa.array(["ab c", None, "", "é🙂", "c"])
    for at in range(5):
        data, offsets = text_bytes(column.slice(at))
        want = [(x or "").encode() for x in column.slice(at).to_pylist()]
        assert [data[a:b].tobytes() for a, b in zip(offsets, offsets[1:], strict=False)] == want
        starts, ends = runs(data != 32, offsets)
        assert [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)] == [w for x in want for w in x.split()]
    batch = pa.RecordBatch.from_pydict({"text": ["a" * 10, None, "b" * 50, "c", "d"]})
    assert [b.num_rows for b in chunks([batch], most=12)] == [2, 1, 2]


# ---------------------------------------------------------------- spelling
def plain_variants(rows, typo_mod, min_length, min_count, factor):
    seen = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if typo_mod and h % typo_mod == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            seen[run] += 1
    words = {w: n for w, n in seen.items() if len(w) >= min_length and n >= min_count}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    out, form = {}, {}
    for w, n in words.items():
        best = sorted((-words[x], x) for x in words if x != w and near(w, x))
        if best and -best[0][0] >= factor * n:
            form[w] = best[0][1]
        out[w] = (n, len(best))
    result = set()
    for w, (n, count) in out.items():
        root = w
        while root in form:
            root = form[root]
        result.add((w, form.get(w), root, n, count, words[form[w]] if w in form else None))
    return result


def test_variants_match_brute_force(llm):
    rnd = random.Random(8)
    words = ["".join(rnd.choice("abé") for _ in range(rnd.randrange(1, 6))) for _ in range(60)]
    rows = [(i, " ".join(rnd.choice(words[:1 + rnd.randrange(60)]) for _ in range(40))) for i in range(60)]
    rows += [(None, "Abba abBa ÀB àb x÷y"), (7, None), (7, ""), (8, "abab " * 200), (8, "abab " * 200)]
    for parameters in ((3, 2, 2, 2), (0, 1, 1, 3), (7, 3, 5, 5)):
        got = {tuple(r) for r in spelling.variants(frame(llm, rows), *parameters).collect()}
        assert got == plain_variants(rows, *parameters) and got


def test_deep_nodes_and_long_words(llm):
    long = "abcdefghij" * 3_000
    words = [long, long[:-1], long[:5] + "z" + long[6:], "q" + long, long[::-1], "abcdefghijkl", "abcdefghijkm", "abcdefghijk"]
    rows = [(i, " ".join(words)) for i in range(5)]
    got = {r["word"]: r["n_near"] for r in spelling.variants(frame(llm, rows), typo_mod=0).collect()}
    assert [got[w] for w in words] == [3, 1, 1, 1, 0, 2, 2, 2]


def test_chains_of_forms(llm):
    forms = llm.createDataFrame([(i, i + 1) for i in range(11)] + [(20, 11), (30, 31)], "id long, form long")
    got = {r["id"]: r["root"] for r in spelling.roots(forms).collect()}
    assert got == {**{i: 11 for i in range(11)}, 20: 11, 30: 31}


def test_variants_of_odd_rows(llm, odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert {tuple(r) for r in spelling.variants(odd).collect()} == plain_variants(rows, 199, 6, 5, 5)
    assert spelling.variants(empty).count() == 0


def test_checksums_are_crc32():
    texts = [b"", b"a", b"hello", b"x" * 64, b"y" * 65, b"z" * 5000]
    data = np.frombuffer(b"".join(texts), np.uint8)
    lengths = np.array([len(t) for t in texts])
    before = np.array([zlib.crc32(b"%d:" % i) for i in range(len(texts))], np.uint32)
    got = spelling.checksums(data, np.cumsum(lengths) - lengths, lengths, before)
    assert got.tolist() == [zlib.crc32(b"%d:" % i + t) for i, t in enumerate(texts)]


# ---------------------------------------------------------------- phrases
def plain_counts(rows):
    counts = Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOW)):
            words = re.findall("[^ \t]+", piece)
            for i in range(len(words)):
                for m in range(1, 5):
                    if i + m <= len(words):
                        counts[lang or "und", tuple(words[i:i + m])] += 1
    return counts


def plain_phrases(rows, min_count, top, share=80):
    counts = plain_counts(rows)
    total = Counter()
    for (lang, words), n in counts.items():
        if len(words) == 1:
            total[lang] += n
    many = {k: n for k, n in counts.items() if len(k[1]) > 1 and n >= min_count}
    inside = Counter()
    for (lang, words), n in many.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                inside[lang, words[i:i + k]] = max(n, inside[lang, words[i:i + k]])
    out = []
    for (lang, words), a in many.items():
        if (lang, words) in inside and 100 * inside[lang, words] >= share * a:
            continue
        cuts = [(2000000 * a // (counts[lang, words[:k]] + counts[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out.append((lang, " ".join(words), a, counts[lang, words[:k]], counts[lang, words[k:]], total[lang], score))
    out.sort(key=lambda r: (r[0], -r[-1], -r[2], r[1].encode()))
    ranks = Counter()
    result = set()
    for lang, *rest in out:
        ranks[lang] += 1
        if ranks[lang] <= top:
            result.add((lang, ranks[lang], *rest))
    return result


def texts_of(seed, n=120):
    rnd = random.Random(seed)
    vocabulary = ["A", "b", "c'", "d-d", "é", "F", "🙂"]
    rows = []
    for i in range(n):
        text = "".join(rnd.choice(vocabulary[:2 + i % 6]) + rnd.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", " "])
                       for _ in range(rnd.randrange(60)))
        rows.append((i, text, rnd.choice(["x", "y", None, "und"])))
    return rows + [(1, None, "x"), (2, "", None), (3, " .,\n", "x"), (None, "a b a b", "x")] + [(5, "hot hot hot hot b", "y")] * 60


@pytest.mark.parametrize("min_count,top", [(30, 2000), (2, 40), (5, 3)])
def test_collocations_match_brute_force(llm, min_count, top):
    rows = texts_of(min_count)
    docs = llm.createDataFrame(rows, SCHEMA).repartition(4)
    got = {tuple(r) for r in phrases.collocations(docs, min_count, top).collect()}
    assert got == plain_phrases([(lang, t) for _, t, lang in rows], min_count, top) and got


@pytest.mark.parametrize("hot,group_words,power", [(1, 10**9, 26), (8, 300, 4), (10**6, 50, 10)])
def test_routes_and_bitmap_change_no_count(llm, hot, group_words, power):
    """All routes hot, none hot, one group, many groups, a bitmap that lets everything pass."""
    rows = texts_of(3)
    docs = llm.createDataFrame(rows, SCHEMA).repartition(5).selectExpr("coalesce(lang, 'und') AS lang", "text")
    words, found = phrases.phrase_counts(docs, 4, power, hot, group_words)
    spelt = {r["number"]: r["word"] for r in words.collect()}
    got = {(r["lang"], tuple(spelt[x] for x in r["phrase"])): r["n"] for r in found.collect()}
    counts = plain_counts([(lang, t) for _, t, lang in rows])
    assert got == {k: n for k, n in counts.items() if len(k[1]) > 1 and n >= 4}


def test_three_way_partitions_are_counts():
    rnd = np.random.default_rng(2)
    rows = rnd.integers(-1, 5, (4000, 4)).astype(np.int32)
    rows[:, 0] = rnd.integers(0, 3, 4000)
    for i in range(1, 4):  # a row ends at its first -1
        rows[:, i] = np.where(rows[:, i - 1] < 0, -1, rows[:, i])
    weights = rnd.integers(1, 4, 4000)
    for least in (1, 30, 200):
        got = {}
        for depth, pointers, counts in phrases.three_way(rows, weights, least):
            for p, c in zip(pointers, counts, strict=True):
                assert tuple(rows[p][:1 + depth]) not in got
                got[tuple(rows[p][:1 + depth])] = int(c)
        want = Counter()
        for row, w in zip(rows, weights, strict=True):
            for depth in range(1, 4):
                if row[depth] >= 0:
                    want[tuple(row[:1 + depth])] += int(w)
        assert got == {k: n for k, n in want.items() if n >= least}


def test_score_is_exact(llm):
    """Products beyond 64 bits."""
    a = 6 * 10**18
    got = llm.createDataFrame([(a, a, a + 1)], "a long, l long, r long").selectExpr(
        "CAST(CAST(2000000 AS DECIMAL(10,0)) * CAST(a AS DECIMAL(20,0)) div "
        "(CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0))) AS BIGINT) AS s").first()["s"]
    assert got == 2000000 * a // (2 * a + 1)


def test_collocations_of_odd_rows(llm, odd, empty):
    rows = [(r["lang"], r["text"]) for r in odd.collect()]
    assert {tuple(r) for r in phrases.collocations(odd).collect()} == plain_phrases(rows, 30, 2000)
    assert phrases.collocations(empty).count() == 0


def test_sql_of_spelling_and_phrases(llm):
    """The oracle SQL, on the smallest tables."""
    path = "/root/testdata/sf0.001/documents.parquet"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    docs = llm.read.parquet(path)
    for df, sql in ((spelling.variants(docs), spelling.VARIANTS_SQL), (phrases.collocations(docs), phrases.PHRASES_SQL)):
        assert {tuple(r) for r in df.collect()} == set(con.execute(sql).fetchall())


# ---------------------------------------------------------------- toxicity
def small_model(rnd):
    model = toxicity.new_model(rnd)
    return {k: (v * 3).astype(np.float64) for k, v in model.items()} | {
        "word_lean": rnd.normal(size=toxicity.WORD_LEANS), "piece_lean": rnd.normal(size=toxicity.PIECE_LEANS)}


def plain_score(model, text):
    """The network one word at a time."""
    h = toxicity.HIDDEN
    words = re.findall("(?:[a-z]|[^\x00-\x7f])+", (text or "").translate(LOW))
    made = toxicity.Words(words)
    x = np.concatenate([made.leans(model), made.vectors(model)], 1)
    best = None
    for start in range(0, max(1, len(words) + 1 - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE):
        some = x[start:start + toxicity.WINDOW]

        def layer(rows, d):
            state, out = np.zeros(h), []
            for row in rows:
                g = row @ model[f"x_{d}"] + model[f"i_{d}"]
                a = state @ model[f"u_{d}"]
                z, r = (1 / (1 + np.exp(-(g[k * h:k * h + h] + a[k * h:k * h + h]))) for k in (0, 1))
                new = np.tanh(g[2 * h:] + r * (a[2 * h:] + model[f"c_{d}"]))
                state = z * state + (1 - z) * new
                out.append(state)
            return out

        both = np.concatenate([layer(some, "f"), layer(some[::-1], "b")[::-1]], 1)
        energy = np.tanh(both @ model["a"]) @ model["v"]
        weight = np.exp(energy) / np.exp(energy).sum()
        logit = float((weight[:, None] * both).sum(0) @ model["w"] + model["b"][0])
        best = logit if best is None else max(best, logit)
    return 1 / (1 + np.exp(-best))


def test_scores_match_the_plain_network():
    rnd = random.Random(1)
    model = small_model(np.random.default_rng(3))
    texts = [" ".join("".join(rnd.choice("abcé") for _ in range(rnd.randrange(1, 8))) for _ in range(n))
             for n in (0, 1, 5, 30, 31, 32, 33, 47, 48, 49, 100, 200)] + [None, "... 12 !", "y" * 5000]
    got = toxicity.text_scores(model, pa.array(texts, pa.large_string()))
    assert np.allclose(got, [plain_score(model, t) for t in texts], atol=1e-4)


def test_gradients_match_differences():
    rnd = np.random.default_rng(0)
    model = {k: v.astype(np.float64) for k, v in toxicity.new_model(rnd).items()}
    x = rnd.normal(size=(5, 3, 3 * toxicity.HIDDEN))
    mask = np.array([[1, 1, 1], [1, 1, 1], [1, 1, 0], [1, 0, 0], [1, 0, 0]], float)
    wish = np.array([0.3, -0.7, 0.5])

    def loss(m, ahead):
        return float(toxicity.forward(m, ahead, x, mask)[0] @ wish)

    _, saved = toxicity.forward(model, x, x, mask)
    grads, d_ahead, _ = toxicity.backward(model, wish, saved, mask)
    for name in ("u_f", "u_b", "c_f", "c_b", "a", "v", "w"):
        place = tuple(rnd.integers(0, s) for s in model[name].shape)
        up, down = ({**model, name: model[name].copy()} for _ in range(2))
        up[name][place] += 1e-2
        down[name][place] -= 1e-2
        assert abs((loss(up, x) - loss(down, x)) / 2e-2 - grads[name][place]) < 2e-3, name
    moved = x.copy()
    moved[1, 1, 4] += 1e-2
    assert abs((loss(model, moved) - loss(model, x)) / 1e-2 - d_ahead[1, 1, 4]) < 2e-3


def test_held_out_toxicity(llm):
    docs = llm.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = llm.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = toxicity.toxicity(docs, labels).join(labels, "doc_id").join(docs.select("doc_id", "text"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    insulting = [r for r in held if re.search("idiot|moron|clown|scum|worthless|pathetic|loser|trash", r["text"])]
    clean = [r for r in held if r["toxic"] == 0]
    assert insulting and np.mean([r["predicted"] for r in insulting]) >= 0.75
    assert np.mean([r["predicted"] for r in clean]) <= 0.05


def test_toxicity_of_odd_rows(llm, odd, empty):
    labels = llm.createDataFrame([(1, 0), (2, 0), (3, None), (5, 0), (7, 1), (7, 0), (8, 1), (9, 1), (None, 1)],
                                 "doc_id long, toxic int")
    got = toxicity.toxicity(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (3, 4, 5, 9)}) == 1  # no word in any of them
    assert toxicity.toxicity(empty, labels).count() == 0
    none = toxicity.toxicity(odd, labels.filter("toxic = 0")).collect()
    assert len(none) == odd.count() and all(r["predicted"] == 0 for r in none)
