"""Personal data by weak-supervision aggregation, in DataFrame operations only.

Candidates are pattern matches: e-mail, IP and card numbers, phones, and long mixed tokens. Those
that pass their kind's check (octets, Luhn, digit counts) are base spans and always stay. Labelers
vote on every candidate: the check (regex labeler), lists of issuers, country codes, reserved
networks and secret prefixes (gazetteer labeler), words before it (context labeler), its borders and
its variety of characters. Votes are 1, 0 or abstain.

Expectation-maximisation over counts of vote patterns estimates each labeler's reliability and each
kind's share of true spans; the posteriors are soft labels on which a logistic classifier over the
candidates' features is trained. Candidates it accepts are added to the base spans.

Patterns are counted by a grouped aggregate of bounded size (votes and features are a few bits), so
training sees every candidate and never a row of text; a grown corpus only grows the counts.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.common import staged

#: Kinds in the order of results.
KINDS = ("email", "ip", "card", "phone", "secret")
BASE = KINDS[:4]
#: Patterns, one per kind. Possessive repeats and starts at the border of a run (or where the last
#: match ended) find the same leftmost matches as the plain forms, in linear time on any text.
PATTERN = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9+/_=@.-])(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z])"
              r"(?:[A-Za-z0-9_-]{12,}+(?:\.[A-Za-z0-9_-]{12,}+){2}|[A-Za-z0-9+/_=-]{20,}+)(?!@|\.[A-Za-z0-9])",
}
#: What a text must contain before its kind's pattern is tried.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+", "secret": None}
#: Gazetteers: fixed lists.
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))"
COUNTRY_CODES = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
RESERVED_NETWORKS = r"^(?:0|10|127|22[4-9]|2[3-5][0-9]|192\.168|169\.254)\."
SECRET_PREFIXES = r"^(?:sk[-_]|ghp_|gho_|AKIA|ASIA|xox[bap]-|eyJ|glpat-)"
TOP_LEVELS = r"\.(?:com|org|net|edu|gov|io|de|fr|es|it|uk|eu|info|biz)$"
#: Context labeler: words that announce a kind, just before the candidate.
ANNOUNCES = {
    "email": r"(?i)(?:e-?mail|mail|contact|write to|an|à)\W*$", "ip": r"(?i)(?:\bip|address|host|server)\W*$",
    "card": r"(?i)(?:card|visa|master|iban|account|konto|carte|tarjeta)\W*$",
    "phone": r"(?i)(?:phone|tel|call|mobile|fax|cell)\W*$",
    "secret": r"(?i)(?:token|secret|key|passw(?:or)?d|bearer|auth)\W*$",
}
VOTES = ("v_check", "v_gazetteer", "v_context", "v_border", "v_variety")
BEFORE, AFTER = 32, 1
ACCEPT = 0.9


def candidate_array(kind: str) -> Column:
    """Matches of one kind in column ``t``: (kind, i, gap, hit, before, after), gap being the code
    points since the last match. Matches and what lies between come from one pattern, so offsets
    are running sums of lengths."""
    pattern, need = PATTERN[kind], NEEDS[kind]
    gaps, hits = F.split("t", pattern, -1), F.regexp_extract_all("t", F.lit(pattern), F.lit(0))
    n = F.size(hits)
    both = F.zip_with(F.slice(gaps, 1, n), hits, lambda g, h: F.struct(g.alias("g"), h.alias("h")))
    found = F.zip_with(both, F.slice(gaps, 2, n), lambda b, rest: F.struct(
        F.lit(kind).alias("kind"), F.length(b["g"]).alias("gap"), b["h"].alias("hit"),
        F.right(b["g"], F.lit(BEFORE)).alias("before"), F.left(rest, F.lit(AFTER)).alias("after")))
    found = F.transform(found, lambda c, i: F.struct(c["kind"].alias("kind"), i.alias("i"), c["gap"].alias("gap"),
                                                     c["hit"].alias("hit"), c["before"].alias("before"),
                                                     c["after"].alias("after")))
    may = F.col("t").contains(need) if need else F.col("t").rlike("[0-9]")
    return F.when(may & F.col("t").rlike(pattern), found)


def luhn(digits: Column) -> Column:
    """Check of a digit string; meant for card lengths."""
    places = F.filter(F.split(F.reverse(digits), ""), lambda d: d != "").cast("array<int>")
    value = F.transform(places, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(value, F.lit(0), lambda a, x: a + x) % 10 == 0


def passes(kind: Column, hit: Column) -> Column:
    """Whether a candidate passes its kind's fixed check; secrets have none."""
    digits = F.regexp_replace(hit, "[^0-9]", "")
    n = F.length(digits)
    octet = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    return (F.when(kind == "email", True)
            .when(kind == "ip", hit.rlike(rf"^{octet}(?:\.{octet}){{3}}$"))
            .when(kind == "card", F.when(n.between(16, 19), luhn(digits)).otherwise(False))
            .when(kind == "phone", n.between(8, 15))
            .otherwise(False))


def votes(c: DataFrame) -> DataFrame:
    """Add the labelers' votes (1, 0, null to abstain) to candidates."""
    kind, hit = F.col("kind"), F.col("hit")
    one = lambda yes: F.when(yes, 1)
    announced = reduce(lambda a, k: a | ((kind == k) & F.col("before").rlike(ANNOUNCES[k])), KINDS, F.lit(False))
    listed = (F.when(kind == "email", F.lower(hit).rlike(TOP_LEVELS))
              .when(kind == "ip", ~hit.rlike(RESERVED_NETWORKS))
              .when(kind == "card", F.regexp_replace(hit, "[^0-9]", "").rlike(ISSUERS))
              .when(kind == "phone", hit.rlike(COUNTRY_CODES)))
    glued = F.col("before").rlike(r"[\p{L}0-9]$") | F.col("after").rlike(r"^[\p{L}0-9]")
    various = F.size(F.array_distinct(F.split(hit, "")))
    hexed = hit.rlike("^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$")
    return c.select(
        "*",
        F.when(kind == "secret", one(hexed)).otherwise(F.col("valid").cast("int")).alias("v_check"),
        F.when(kind == "secret", one(hit.rlike(SECRET_PREFIXES))).otherwise(listed.cast("int")).alias("v_gazetteer"),
        one(announced).alias("v_context"),
        F.when(glued, 0).when(F.col("before").rlike(r"[\"'=:]\s*$"), 1).alias("v_border"),
        F.when(various < 4, 0).when(various >= 10, 1).alias("v_variety"))


def features(c: DataFrame) -> DataFrame:
    """Add 0/1 features of the span and its surroundings."""
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    hit = F.col("hit")
    named = [yes(F.col("kind") == k).alias(f"f_{k}") for k in KINDS]
    named += [yes(F.col("valid")).alias("f_valid"), yes(F.col("v_gazetteer") == 1).alias("f_listed"),
              yes(F.col("v_context") == 1).alias("f_announced"), yes(F.col("v_border") == 0).alias("f_glued"),
              yes(F.col("v_border") == 1).alias("f_quoted"), yes(F.col("v_variety") == 0).alias("f_plain"),
              yes(F.length(hit) >= 32).alias("f_long"), yes(hit.rlike("^[0-9a-f]+$")).alias("f_hex")]
    return c.select("*", *named)


FEATURES = tuple(f"f_{k}" for k in KINDS) + ("f_valid", "f_listed", "f_announced", "f_glued", "f_quoted",
                                               "f_plain", "f_long", "f_hex")


def candidates(docs: DataFrame) -> DataFrame:
    """Every candidate span of (key, t): key, kind, start, end (code points), valid, votes, features."""
    arrays = [F.coalesce(candidate_array(k), F.array().cast(
        "array<struct<kind:string,i:int,gap:int,hit:string,before:string,after:string>>")) for k in KINDS]
    rows = docs.select("key", F.explode(F.concat(*arrays)).alias("c")).select("key", "c.*")
    rows = rows.dropDuplicates(["key", "kind", "i"])
    upto = Window.partitionBy("key", "kind").orderBy("i")
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.length("hit")).over(upto).cast("int")).withColumn(
        "start", F.col("end") - F.length("hit")).withColumn("valid", passes(F.col("kind"), F.col("hit")))
    return features(votes(rows)).select("key", "kind", "start", "end", "valid", *VOTES, *FEATURES)


def posterior(prior: dict[str, float], right: dict[str, float], wrong: dict[str, float]) -> Column:
    """P(true span | votes) with labelers independent given the truth; ``right`` and ``wrong`` are
    P(vote 1) for true and for false spans among those it votes on."""
    def odds(v: str) -> Column:
        vote = F.col(v)
        return F.when(vote == 1, math.log(right[v] / wrong[v])).when(
            vote == 0, math.log((1 - right[v]) / (1 - wrong[v]))).otherwise(0.0)
    start = reduce(lambda a, k: a.when(F.col("kind") == k, math.log(prior[k] / (1 - prior[k]))), KINDS[1:],
                   F.when(F.col("kind") == KINDS[0], math.log(prior[KINDS[0]] / (1 - prior[KINDS[0]]))))
    total = reduce(lambda a, v: a + odds(v), VOTES, start)
    return 1 / (1 + F.exp(-total))


def reliabilities(counts: DataFrame, steps: int = 12):
    """EM on the counts (kind, votes, n): priors by kind and P(vote 1 | true), P(vote 1 | false).

    There are at most five kinds times three votes to the power of five labelers, 1,215 patterns, whatever
    the corpus; their sums are read once, and the steps run over them.
    """
    rows = [(r["kind"], tuple(r[v] for v in VOTES), r["n"]) for r in counts.groupBy("kind", *VOTES).agg(
        F.sum("n").alias("n")).orderBy("kind", *VOTES).collect()]
    prior = dict.fromkeys(KINDS, 0.5)
    right, wrong = dict.fromkeys(VOTES, 0.8), dict.fromkeys(VOTES, 0.3)
    clip = lambda x: min(max(x, 0.01), 0.99)
    for _ in range(steps):
        of_kind = {k: [0.0, 0.0] for k in KINDS}               # weight of true and of false spans
        of_vote = {(v, x): [0.0, 0.0] for v in VOTES for x in (0, 1)}
        for kind, given, n in rows:
            odds = math.log(prior[kind] / (1 - prior[kind]))
            for v, x in zip(VOTES, given, strict=True):
                if x is not None:
                    odds += math.log(right[v] / wrong[v] if x else (1 - right[v]) / (1 - wrong[v]))
            p = 1 / (1 + math.exp(-odds))
            for w, share in enumerate((p * n, (1 - p) * n)):
                of_kind[kind][w] += share
                for v, x in zip(VOTES, given, strict=True):
                    if x is not None:
                        of_vote[v, x][w] += share
        prior = {k: clip((t + 1) / (t + f + 2)) for k, (t, f) in of_kind.items()}
        share = lambda w, v: clip((of_vote[v, 1][w] + 1) / (of_vote[v, 0][w] + of_vote[v, 1][w] + 2))
        right, wrong = {v: share(0, v) for v in VOTES}, {v: share(1, v) for v in VOTES}
    return prior, right, wrong


def train(found: DataFrame) -> tuple[list[float], float] | None:
    """Weights of the span classifier from all candidates of ``found``; None without candidates."""
    counts = staged(found.groupBy("kind", *VOTES, *FEATURES).agg(F.count("*").cast("double").alias("n")), "patterns")
    if counts.isEmpty():
        return None
    p = posterior(*reliabilities(counts))
    soft = counts.select(*FEATURES, (p * F.col("n")).alias("t"), ((1 - p) * F.col("n")).alias("f"))
    soft = soft.select(*FEATURES, F.explode(F.array(
        F.struct(F.lit(1.0).alias("label"), F.col("t").alias("weight")),
        F.struct(F.lit(0.0).alias("label"), F.col("f").alias("weight")))).alias("x")).select(*FEATURES, "x.*")
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(soft.filter("weight > 0"))
    model = LogisticRegression(weightCol="weight", maxIter=25, regParam=0.001, standardization=False).fit(rows)
    return [float(w) for w in model.coefficients], float(model.intercept)


def probability(model) -> Column:
    weights, bias = model
    return 1 / (1 + F.exp(-reduce(lambda a, x: a + x[1] * F.col(x[0]), zip(FEATURES, weights, strict=True), F.lit(bias))))


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, key, t): null text is empty; key names the row by its id and text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.xxhash64("doc_id", text).alias("key"), text.alias("t"))


def spans_of(docs: DataFrame) -> DataFrame:
    """(key, kind, start, end, valid) of the base spans and of those the classifier adds."""
    found = staged(candidates(keyed(docs)), "candidates")
    model = train(found)
    keep = F.col("valid") if model is None else F.col("valid") | (probability(model) >= ACCEPT)
    return found.filter(keep).select("key", "kind", "start", "end", "valid")


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans for every row of ``docs``.

    Spans are ``kind:start:end`` in code points, end exclusive, ordered by kind as in KINDS and then
    by start. Null or empty text has none. Repeated rows get the same answer.
    """
    order = reduce(lambda a, k: a.when(F.col("kind") == k, KINDS.index(k)), KINDS[1:], F.when(F.col("kind") == KINDS[0], 0))
    rows = spans_of(docs).withColumn("s", F.struct(order.alias("o"), "start", "end", "kind", "valid"))
    by_key = rows.groupBy("key").agg(F.array_sort(F.collect_list("s")).alias("s"))
    text = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("s", lambda x: x["valid"])

    def count(kind):
        return F.size(F.filter("s", lambda x: x["valid"] & (x["kind"] == kind))).cast("long").alias(f"n_{kind}")

    by_key = by_key.select("key", text(base).alias("base"), text("s").alias("spans"), *map(count, BASE))
    return keyed(docs).select("doc_id", "key").join(by_key, "key", "left").select(
        "doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(F.coalesce("base", F.lit("")).cast("binary"), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"))


def masked(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind, as ``[EMAIL]``.

    Of overlapping spans the earlier one is replaced whole and the rest of the later one too. A null
    text stays null. All columns are kept, in their order; texts without a span are left alone.
    """
    spans = spans_of(docs)
    before = Window.partitionBy("key").orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("start", F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0)))).filter(F.col("end") > F.col("start"))
    by_key = spans.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("_s"))
    names = [f"_c{i}" for i in range(len(docs.columns))]  # columns may be called anything
    plain = docs.toDF(*names)
    column = lambda c: F.col(names[docs.columns.index(c)])
    text = F.coalesce(column("text"), F.lit(""))
    joined = plain.withColumn("key", F.xxhash64(column("doc_id"), text)).join(by_key, "key", "left")
    ends = F.transform("_s", lambda x: x["end"])
    shifted = F.concat(F.array(F.lit(0)), F.slice(ends, 1, F.size(ends) - 1))
    parts = F.zip_with("_s", shifted, lambda x, done: F.concat(
        F.substring(text, done + 1, x["start"] - done), F.lit("["), F.upper(x["kind"]), F.lit("]")))
    whole = F.concat(F.array_join(parts, ""), F.substring(text, F.array_max(ends) + 1, F.length(text)))
    return joined.select(*[
        (F.when(F.col("_s").isNull(), F.col(n)).otherwise(whole) if c == "text" else F.col(n)).alias(c)
        for n, c in zip(names, docs.columns, strict=True)])
