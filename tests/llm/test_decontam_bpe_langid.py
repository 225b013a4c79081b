import hashlib
import random
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from basketry.llm import bpe, decontam, langid
from basketry.llm.queries import vocabulary_path
from tests.llm.conftest import frame

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def windows(words, k):
    return [tuple(words[i:i + k]) for i in range(len(words) - k + 1)]


def brute(text, items, size):
    words = WORD.findall((text or "").translate(LOW))
    hit, names = set(), set()
    for name, item in items:
        w = WORD.findall((item or "").translate(LOW))
        k = min(size, len(w))
        wanted = set(windows(w, k)) if k else set()
        for i, x in enumerate(windows(words, k) if k else ()):
            if x in wanted:
                hit.update(range(i, i + k))
                names.add(str(name))
    return len(words), len(hit), sorted(names)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abc ", max_size=25), max_size=5), st.text("abcd ", max_size=60))
def test_automaton_matches_brute_force(items, text):
    items = list(enumerate(items))
    automaton = decontam.ItemAutomaton([(str(i), decontam.words_of(t.encode())) for i, t in items], 4)
    spans, found = automaton.spans(decontam.words_of(text.encode()))
    _, n, names = brute(text, items, 4)
    assert (sum(b - a for a, b in spans), sorted(found)) == (n, names)


def test_report_with_blocks_and_odd_rows(llm, odd, empty):
    items = [(0, "lazy dog near the old river"), (1, ""), (2, None), (3, "quite a few words of its own"),
             (11, "x"), (12, "X!"), (13, "brown fox jumps over the lazy dog near the old river bank today the quick")]
    bench = llm.createDataFrame(items, "item_id long, text string")
    for block in (500_000, 8):
        got = decontam.find_spans(odd.select("doc_id", "text"), bench, 13, block).collect()
        assert len(got) == odd.count()
        for r in got:
            n, hit, names = brute(r["text"], items, 13)
            assert (r["n_words"], sum(h["end"] - h["first"] for h in r["hits"]), r["item_ids"]) == (n, hit, names)
    assert decontam.report(empty, bench).count() == 0
    assert decontam.report(odd, bench.limit(0)).filter("n_hit > 0 OR contaminated").count() == 0
    assert decontam.uncontaminated(odd, bench).columns == odd.columns


def test_spans_are_cut(llm):
    bench = frame(llm, ["a b c d e f g h i j k l m n"]).withColumnRenamed("doc_id", "item_id")
    docs = frame(llm, ["start A, b c d e f g h i j k l m! " + "z " * 400, "a b c d e f g h i j k l m", "clean", None])
    got = {r["doc_id"]: r for r in decontam.decontaminate(docs, bench).collect()}
    assert got[0]["clean_text"] == "start ! " + "z " * 400 and not got[0]["dropped"]
    assert got[1]["dropped"] and got[1]["clean_text"] is None
    assert got[2]["clean_text"] == "clean" and got[3]["clean_text"] is None and not got[3]["dropped"]


def reference():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(vocabulary_path())


def test_bpe_equals_the_library():
    tok, own = reference(), bpe.load(vocabulary_path())
    rnd = random.Random(5)
    texts = ["", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", " " * 999, "\n" * 99 + "x", "a" * 3000,
             "ab" * 900 + "=" * 700, "don't we'll 'S\t\t x", "\x00a<|endoftext|>", "\x1c\x1d\x85\xa0 é́ 🙂🏽"]
    texts += ["".join(chr(c) for c in range(k, k + 64) if not 0xD800 <= c < 0xE000) for k in range(0, 0x20000, 64)]
    texts += ["".join(rnd.choice("abcdetho 's\n\té1२Ⅷ½_-") for _ in range(150)) for _ in range(150)]
    for text, ids, ref in zip(texts, own.encode(texts), tok.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == ref.ids
        assert own.decode(ids) == tok.decode(ref.ids, skip_special_tokens=False) == text


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=80))
def test_bpe_round_trip(text):
    own = test_bpe_round_trip.__dict__.setdefault("own", bpe.load(vocabulary_path()))
    assert own.decode(own.encode([text])[0]) == text


def test_bpe_rows(llm, odd, empty):
    own = bpe.load(vocabulary_path())
    tok = reference()
    got = bpe.round_trip(odd, own, keep_ids=True).collect()
    want = sorted((r["doc_id"] or -1, tuple(tok.encode(r["text"] or "", add_special_tokens=False).ids))
                  for r in odd.collect())
    assert sorted((r["doc_id"] or -1, tuple(r["ids"])) for r in got) == want
    for r in got:
        assert r["ids_sha256"] == hashlib.sha256(np.array(r["ids"], "<u4").tobytes()).hexdigest()
    assert bpe.round_trip(empty, own).count() == 0


def phrases(text, corpus):
    """Phrases of greedy longest matching against a set of training texts."""
    n = at = 0
    while at < len(text):
        size = 1
        while at + size < len(text) and any(text[at:at + size + 1] in c for c in corpus):
            size += 1
        n, at = n + 1, at + size
    return n


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab c", min_size=1, max_size=30), min_size=1, max_size=3), st.text("ab cd", max_size=100))
def test_cross_parsing_counts_phrases(train, text):
    squeeze = lambda t: re.sub(" +", " ", t).lstrip(" ")
    parser = langid.CrossParser({"l": train}, 10_000)
    n, found = parser.phrases([text, "", text])
    assert n.tolist() == [len(squeeze(text)), 0, len(squeeze(text))]
    assert found[0][0] == found[0][2] == phrases(squeeze(text), [squeeze(t) for t in train])


def test_language_accuracy_and_odd_rows(llm, odd, empty):
    docs = llm.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert sum(r["lang_pred"] == r["lang"] for r in held) > 0.98 * len(held)
    got = langid.identify(odd).collect()
    assert len(got) == odd.count()
    assert all(0 <= r["score"] <= 1 for r in got)
    und = {r["doc_id"] for r in got if r["lang_pred"] == "und"}
    assert und == {3, 4, 5, 9}
    assert langid.identify(empty).count() == 0
    kept = langid.determined(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 4
    unlabelled = langid.identify(odd.selectExpr("doc_id", "text", "cast(null as string) lang"))
    assert {r["lang_pred"] for r in unlabelled.collect()} == {"und"}


def test_language_of_large_scripts(llm):
    """Languages whose letters are thousands: none is merged with another, whatever its code point."""
    rng = random.Random(5)
    ranges = {"en": (97, 26), "el": (0x3B1, 24), "ru": (0x430, 32), "he": (0x5D0, 27), "th": (0xE01, 44), "am": (0x1200, 70),
              "ja": (0x3041, 83), "zh": (0x4E00, 2500), "ko": (0xAC00, 2500)}
    rows = []
    for n, (lang, (first, size)) in enumerate(ranges.items()):
        words = ["".join(chr(first + min(int(rng.expovariate(6 / size)), size - 1)) for _ in range(rng.randint(2, 6)))
                 for _ in range(400)]
        rows += [(100 * n + k, " ".join(rng.choices(words, k=60)), lang) for k in range(40)]
    docs = llm.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows) and any(r.held_out for r in got.values())
    letters = [chr(0x4E00 + i) for i in range(9000)]
    for many in (250, 251, 3000, 9000):
        codes, width = langid.symbols_of(letters[:many])
        assert len(set(codes.values())) == many and max(map(max, codes.values())) < width - 1
    assert langid.symbols_of(letters[:3000])[1] <= langid.DIRECT + 2


def test_two_symbol_letters_parse_alike():
    """The vector parse of letters of two symbols, against the parse of their codes one by one."""
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice(string) for _ in range(n))
    string = [chr(0x4E00 + i) for i in range(400)] + [" "] * 20
    train = [text(3000)]
    parser = langid.CrossParser({"l": train}, 10_000)
    assert any(len(k) == 2 for k in parser.classes.values())
    known = "\0".join(",".join(map(str, parser._codes_of(t))) for t in train)
    texts = [text(n) for n in (0, 1, 2, 60, 100)] + [train[0][500:600]]
    n_chars, found = parser.phrases(texts)
    for k, t in enumerate(texts):
        codes, phrases, at = parser._codes_of(t), 0, 0
        while at < len(codes):
            size = 1
            while at + size < len(codes) and f",{','.join(map(str, codes[at:at + size + 1]))}," in f",{known},":
                size += 1
            phrases, at = phrases + 1, at + size
        assert found[0][k] == phrases
