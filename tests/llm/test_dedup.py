import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from basketry.llm import linededup, minhash, suffixdedup
from basketry.llm.components import components
from tests.llm.conftest import frame

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute_components(rows, width):
    sets = [shingles(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    low = defaultdict(lambda: None)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            r = root(i)
            low[r] = d if low[r] is None else min(low[r], d)
    return sorted((repr(d), len(s), repr(low[root(i)]), d == low[root(i)])
                  for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def check_near(df, width):
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    got = minhash.near_duplicates(df, width=width).collect()
    assert sorted((repr(r["doc_id"]), r["n_shingles"], repr(r["component_id"]), r["kept"])
                  for r in got) == brute_components(rows, width)


def near_copies(seed=1, n=60, size=120):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    base = [word() for _ in range(size)]
    texts = []
    for _ in range(n):   # chains: each differs from an earlier text by a few words
        w = list(rnd.choice(texts).split()) if texts and rnd.random() < 0.9 else list(base)
        for _ in range(rnd.randrange(0, 9)):
            w[rnd.randrange(size)] = word()
        texts.append(" ".join(w))
    return texts + [" ".join(word() for _ in range(size)) for _ in range(20)]


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_match_all_pairs(llm, width):
    check_near(frame(llm, near_copies()), width)


def test_near_duplicates_of_odd_rows(llm, odd, empty):
    check_near(odd, 2)
    assert minhash.near_duplicates(empty).count() == 0
    kept = minhash.one_of_each(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 3, 4, 5, 6, 7, 8, 9, 10] and None in ids


def test_tensored_collision_rate():
    rnd = np.random.default_rng(3)
    bander, met = minhash.Bander(), 0
    for _ in range(300):
        common = rnd.integers(0, 2**63, 160, dtype=np.uint64)
        a, b = (np.concatenate([common, rnd.integers(0, 2**63, 20, dtype=np.uint64)]) for _ in range(2))
        keys = bander.keys(np.array([bander.minhashes(a), bander.minhashes(b)]))
        met += bool((keys[0] == keys[1]).any())
    assert met >= 299  # similarity 0.8


def test_components_of_chains_and_stars(llm):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 199), (199, 200)]
    got = {r["node"]: r["component"] for r in components(llm.createDataFrame(links, "x long, y long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 199: 199, 200: 199}


def brute_removed(rows, span=50):
    first = {}
    raw = [(d, (t or "").encode()) for d, t in rows]
    for d, b in raw:
        for i in range(len(b) - span + 1 if d is not None else 0):
            s = b[i:i + span]
            first[s] = min(first.get(s, d), d)
    out = []
    for d, b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - span + 1 if d is not None else 0):
            if first[b[i:i + span]] < d:
                gone[i:i + span] = b"\1" * span
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        n = len(re.findall(b"\1+", bytes(gone)))
        out.append((repr(d), len(b), sum(gone), n, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def check_substrings(df, **sizes):
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    got = suffixdedup.dedup_substrings(df, **sizes).collect()
    assert sorted((repr(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])
                  for r in got) == brute_removed(rows)


def test_substrings_match_brute_force(llm):
    rnd = random.Random(2)
    text = lambda n, a="abcdefgh é": "".join(rnd.choice(a) for _ in range(n))
    shared = [text(rnd.randrange(45, 200)) for _ in range(12)]
    texts = [text(rnd.randrange(0, 200)).join(rnd.choices(shared, k=rnd.randrange(0, 4))) for _ in range(80)]
    texts += ["ab" * 100, "ab" * 90, "a" * 300, "a" * 120, "".join(map(chr, range(120, 32, -1))) * 2,
              "q" + "".join(map(chr, range(120, 32, -1))), None, "", texts[0], shared[0][:49], shared[0][:50]]
    rnd.shuffle(texts)
    check_substrings(frame(llm, texts), block_bytes=2000, group_bytes=500)
    check_substrings(frame(llm, texts, 1))


def test_substrings_of_odd_rows(llm, odd, empty):
    check_substrings(odd.filter("doc_id IS NULL OR doc_id NOT IN (7, 10)"), block_bytes=100)
    got = {r["doc_id"]: r for r in suffixdedup.dedup_substrings(odd, keep_text=True).collect()}
    assert got[7]["n_removed"] == 0 and len(got[10]["kept"]) == 100_000
    assert suffixdedup.dedup_substrings(empty).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("ab", min_size=50, max_size=120).map(str.encode), min_size=1, max_size=6), st.randoms())
def test_two_stage_sort_finds_equal_windows(strings, rnd):
    counts = np.array([rnd.randrange(1, len(s) - 48) for s in strings])
    ids = np.array([rnd.randrange(4) for _ in strings])
    got = suffixdedup.repeated_windows(strings, counts, ids)
    least = {}
    for s, c, i in zip(strings, counts, ids, strict=True):
        for k in range(c):
            least[s[k:k + 50]] = min(least.get(s[k:k + 50], i), i)
    for s, c, i, g in zip(strings, counts, ids, got, strict=True):
        assert g.tolist() == [bool(least[s[k:k + 50]] < i) for k in range(c)]


def test_lines(llm, odd, empty):
    docs = frame(llm, [(5, "One two three four five.\nunique line of this very text\nshort one"),
                       (2, "zero\n ONE  two three four five. \nshort one"),
                       (9, "ab cd. One two three four five. And then something quite new"),
                       (9, "ab cd. One two three four five. And then something quite new"), (None, "One two three four five.")])
    got = {r["doc_id"]: (r["n_units"], r["n_removed"], r["spans"]) for r in linededup.dedup_report(docs).collect()}
    # a line and its only sentence are two units; rows that share an id count together
    assert got == {5: (3, 2, "0:24,55:64"), 2: (4, 0, ""), 9: (6, 1, "7:31"), None: (1, 1, "0:24")}
    text = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(docs).collect()}
    assert text[5] == "\nunique line of this very text\n" and text[None] == ""
    assert text[9] == "ab cd.  And then something quite new"
    assert linededup.dedup_report(odd).count() == odd.count()
    assert linededup.dedup_report(empty).count() == 0


def test_short_lines_and_scripts_without_spaces(llm):
    zh = "\u8fd9\u662f\u4e00\u4e2a\u6ca1\u6709\u7a7a\u683c\u7684\u6bb5\u843d"
    long = zh * 2
    docs = frame(llm, [(1, f"Menu\n{zh}\n  \nIs this the passage that was copied? yes"), (2, f"menu\n{zh}"),
                       (3, f"x\u3002{long}\u3002y other {long}\uff01"),
                       (4, f"before {long}\uff1f\n{long}\u3002 then Is this the passage that was copied? no")])
    got = {r["doc_id"]: r["spans"] for r in linededup.dedup_report(docs).collect()}
    sentence = len(f"before {long}?\n{long}.")
    assert got == {1: "", 2: f"0:4,5:{5 + len(zh)}", 3: "", 4: f"{len('before ' + long) + 2}:{sentence}"}
    assert linededup.units_of("a\n\n \nb. c") == [(0, 1, "a"), (5, 9, "b. c")]


def test_links_through_a_row_without_an_id(llm):
    """1 ~ n ~ 9, where n has no id: all of them are one component."""
    words = [f"w{i}" for i in range(60)]
    first, middle, last = words, words[:54] + [f"m{i}" for i in range(6)], words[:48] + [f"z{i}" for i in range(6)] + [f"m{i}" for i in range(6)]
    rows = [(1, " ".join(first)), (None, " ".join(middle)), (9, " ".join(last)), (20, "quite another text of its own")]
    for bridge in (5, None):
        docs = frame(llm, [(bridge, t) if d is None else (d, t) for d, t in rows])
        want = brute_components([(bridge if d is None else d, t) for d, t in rows], 1)
        got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, width=1).collect()}
        assert got[1] == got[9] == got[bridge] == 1 and got[20] == 20, (bridge, got, want)
    kept = minhash.one_of_each(frame(llm, rows), width=1).collect()
    assert sorted(r["doc_id"] for r in kept) == [1, 20]


def test_strings_around_a_common_phrase_are_spread(llm):
    """A phrase in every text with other text around it doesn't put all its strings in one group."""
    rnd = random.Random(12)
    fresh = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    texts = [fresh(60) + "the phrase all texts have in common" + fresh(60) for _ in range(400)]
    texts += [t[20:130] for t in texts[::40]]
    df = frame(llm, texts)
    x = "".join(texts).encode()
    raw = {"raw": zlib.compress(x), "ids": np.arange(len(texts)).tobytes(), "named": b"\1" * len(texts),
           "sizes": np.array([len(t) for t in texts]).tobytes()}
    block = suffixdedup.Block(raw)
    assert max(block.many().values()) > 300
    keys = block.keys(8)
    many = block.many()
    marks = suffixdedup._mark_keys(pa.table({
        "block": [0] * len(keys), "g": [g for g, _, _ in keys], "keys": [suffixdedup._short(h) for _, h, _ in keys],
        "several": [np.packbits(s).tobytes() for _, _, s in keys],
        "many": [np.array([(i, many[k]) for i, k in enumerate(h.tolist()) if k in many], np.int64).tobytes() for _, h, _ in keys]}), 100)
    _, strings = block.snippets(8, {r["g"]: r["mark"] for r in marks.to_pylist()})
    size = Counter()
    for s, _, _, g in strings:
        size[g] += 1
    assert len(size) == 8 and max(size.values()) < 2 * min(size.values())
    check_substrings(df, block_bytes=4000, group_bytes=2000)
