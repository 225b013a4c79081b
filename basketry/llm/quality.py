"""Quality rules with robust multivariate outliers, in DataFrame operations only.

Fixed rules fail a text that is too short or repeats itself. The rest is judged against its own
language and source: statistics are transformed to a vector of roughly equal spread, a minimum-
covariance-determinant (MCD) estimate of centre and covariance is made per group, and a vector whose
robust Mahalanobis distance exceeds the limit is rejected.

MCD by concentration steps: keep the ``share`` of vectors with the smallest distance, estimate mean
and covariance from those alone, and repeat. A group has four starts (``FIRST`` and signs), and the
end of least determinant is its estimate. Groups of few rows are shrunk towards their language, and
small languages towards all. All of it is grouped sums and histograms, which Spark combines map-side,
and joins with one row a group are salted, so a source that holds a third of all rows is spread over
all tasks. Vectors are rounded to multiples of 1/``GRID`` and summed as whole numbers: results don't
depend on how rows were partitioned.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.common import staged

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
GRID = 1024
#: Names of the vector's parts.
VECTOR = ("v_length", "v_symbols", "v_lines", "v_repeats")
#: Least spread of each part, in its own unit: groups of clean texts have none of some statistics.
FLOOR = {"v_length": 2.0, "v_symbols": 0.05, "v_lines": 0.12, "v_repeats": 0.12}
#: 1 - 1e-5 quantile of chi-square with four degrees of freedom; beyond it a vector is rejected.
LIMIT = 28.47
#: By share kept: factor that makes the covariance of the innermost rows consistent for normal vectors of
#: four parts, share / P(chi2(6) <= share quantile of chi2(4)).
CONSISTENCY = {0.5: 2.05, 0.75: 1.49}
#: Share kept by the first step of each start that begins at median and median deviation. One more
#: start begins at the covariance of the signs (directions from the median).
FIRST = (0.75, 0.5, 1.0)
#: Rows at which a group's own estimate weighs as much as its language's.
SHRINK = 50
SALTS = 16
#: Parts beyond this are cut to it for the estimates. Products of grid numbers then have 48 bits and are
#: summed in halves of 24, which is exact up to 2^39 rows a group.
LARGEST = float(2**14)
HALF = 24


def text_statistics(docs: DataFrame, *carry: str) -> DataFrame:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (long) of every row.

    Words are runs of anything but ASCII white space; null text has none. A line repeats if it holds
    a word and equals an earlier line; a word repeats if one of the ``WINDOW``-word windows over it
    occurs twice or more in the text, the first occurrence included. Windows are compared by 64-bit
    hash inside one text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    step = docs.select(*carry, text.alias("t"), F.filter(F.split(text, SPACE), lambda w: w != "").alias("w"))
    step = step.select(
        *carry, F.size("w").cast("long").alias("n_words"),
        F.length(F.translate("t", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.when(F.size("w") > WINDOW, F.transform(
            F.sequence(F.lit(1), F.size("w") - (WINDOW - 1)),
            lambda i: F.xxhash64(F.slice(F.col("w"), i, F.lit(WINDOW))))).alias("h"))
    step = step.select(
        *carry, "n_words", "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("h")) < F.size("h"),
               F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).alias("s"))
    near = F.zip_with(F.slice("s", 1, F.size("s") - 1), F.slice("s", 2, F.size("s") - 1),
                      lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    places = F.array_sort(F.array_distinct(F.flatten(F.filter(near, lambda p: p.isNotNull()))))
    covered = F.aggregate(
        places, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, i: F.struct((i + WINDOW).alias("end"),
                              (a["n"] + i + WINDOW - F.greatest(i, a["end"])).alias("n")))["n"]
    return step.select(*carry, "n_words", "word_chars", "n_symbols", "n_dup_lines",
                       F.when(F.col("s").isNull(), 0).otherwise(covered).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def joined(rows: DataFrame, small: DataFrame, on: list[str], how: str = "inner", by: list[str] | None = None) -> DataFrame:
    """Join rows with a few rows a key, each key cut into ``SALTS`` parts by the columns ``by`` (all) of ``rows``."""
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    return rows.withColumn("salt_", F.pmod(F.xxhash64(*(by or rows.columns)), F.lit(SALTS))).join(
        small.withColumn("salt_", salts), [*on, "salt_"], how).drop("salt_")


def binned_quantile(df: DataFrame, keys: list[str], value: str, q: float | Column, width: float,
                    weight: Column | None = None) -> DataFrame:
    """(keys, value): the lower ``q`` quantile of a column per group, to a bin of ``width``.

    Rows are counted into bins first, so a group reaches one task as its bins, not its rows.
    ``weight`` counts a row several times; ``q`` may depend on the keys.
    """
    bins = df.groupBy(*keys, F.floor(F.col(value) / width).alias("bin")).agg(
        F.sum(F.lit(1) if weight is None else weight).alias("count"))
    whole = Window.partitionBy(*keys)
    run = bins.withColumn("run", F.sum("count").over(whole.orderBy("bin"))).withColumn(
        "total", F.sum("count").over(whole))
    return run.filter(F.col("run") >= F.col("total") * q).groupBy(*keys).agg(
        ((F.min("bin") + 0.5) * width).alias(value))


def _cholesky(floors: list[float]) -> list[tuple[str, Column]]:
    """Columns l_i_j of the lower factor of c_i_j, given the former ones.

    Where a part's variance, given the parts before it, is below its floor, it is raised to that.
    """
    out, dim = [], len(floors)
    for j in range(dim):
        for i in range(j, dim):
            dot = reduce(lambda a, k: a + F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}"), range(j), F.lit(0.0))
            rest = F.col(f"c_{i}_{j}") - dot
            out.append((f"l_{i}_{j}", F.sqrt(F.greatest(rest, F.lit(floors[i]**2))) if i == j
                        else rest / F.col(f"l_{j}_{j}")))
    return out


def _distance(dim: int) -> Column:
    """Squared Mahalanobis distance by forward substitution; parts x_i, centre m_i, factor l_i_j."""
    solved: list[Column] = []
    for i in range(dim):
        rest = F.col(f"x_{i}") - F.col(f"m_{i}")
        for k in range(i):
            rest = rest - F.col(f"l_{i}_{k}") * solved[k]
        solved.append(rest / F.col(f"l_{i}_{i}"))
    return reduce(lambda a, z: a + z * z, solved, F.lit(0.0))


def _below(dim: int) -> list[tuple[int, int]]:
    """Places of a lower triangle, by row."""
    return [(i, j) for i in range(dim) for j in range(i + 1)]


def _factored(df: DataFrame, carry: list[str], floors: list[float]) -> DataFrame:
    """(carry, m_i, c_i_j, l_i_j): the Cholesky factor beside centre and covariance."""
    dim = len(floors)
    for name, value in _cholesky(floors):
        df = df.withColumn(name, value)
    return df.select(*carry, *[f"m_{i}" for i in range(dim)],
                     *[f"{name}_{i}_{j}" for name in "cl" for i, j in _below(dim)])


def _starts(vectors: DataFrame, key: str, floors: list[float]) -> DataFrame:
    """(key, start, m_i, c_i_j, l_i_j) before the first step.

    Starts that differ in the share of their first step alone begin at median and median deviation,
    the last one at the covariance of directions from the median, scaled by the deviations.
    """
    dim = len(floors)
    long = vectors.select(key, "n", F.posexplode(F.array(*[f"x_{i}" for i in range(dim)])).alias("i", "x"))
    centre = binned_quantile(long, [key, "i"], "x", 0.5, 1 / 64, F.col("n"))
    spread = binned_quantile(joined(long, centre.withColumnRenamed("x", "m"), [key, "i"]).select(
        key, "i", "n", F.abs(F.col("x") - F.col("m")).alias("d")), [key, "i"], "d", 0.5, 1 / 64, F.col("n"))
    part = lambda name, i: F.max(F.when(F.col("i") == i, F.col(name)))
    plain = staged(centre.join(spread, [key, "i"]).groupBy(key).agg(
        *[part("x", i).alias(f"m_{i}") for i in range(dim)],
        *[F.greatest(part("d", i) * 1.4826, F.lit(floors[i])).alias(f"s_{i}") for i in range(dim)]), "mcd_plain")
    z = [(F.col(f"x_{i}") - F.col(f"m_{i}")) / F.col(f"s_{i}") for i in range(dim)]
    seen = joined(vectors, plain, [key]).withColumn("norm", reduce(lambda a, b: a + b * b, z, F.lit(0.0)))
    unit = float(GRID**2)  # products of directions as whole numbers of 21 bits, so their sums are exact
    signs = seen.filter("norm > 0").groupBy(key).agg(F.sum("n").alias("n"), *[
        F.sum(F.round(z[i] * z[j] / F.col("norm") * unit).cast("long") * F.col("n")).cast("double").alias(f"q_{i}_{j}")
        for i, j in _below(dim)])
    same = F.explode(F.sequence(F.lit(0), F.lit(len(FIRST) - 1))).alias("start")
    mean = [f"m_{i}" for i in range(dim)]
    flat = plain.select(key, same, *mean, *[
        (F.col(f"s_{i}") * F.col(f"s_{i}") if i == j else F.lit(0.0)).alias(f"c_{i}_{j}") for i, j in _below(dim)])
    turned = plain.join(signs, key).select(key, F.lit(len(FIRST)).alias("start"), *mean, *[
        (F.col(f"q_{i}_{j}") / F.col("n") / unit * dim * F.col(f"s_{i}") * F.col(f"s_{j}")).alias(f"c_{i}_{j}")
        for i, j in _below(dim)])
    return _factored(flat.unionByName(turned), [key, "start"], floors)


def mcd(vectors: DataFrame, key: str, parts: list[str], floors: list[float], share: float = 0.75,
        steps: int = 3) -> DataFrame:
    """(key, n, m_i, c_i_j, l_i_j): rows, robust centre, covariance and its Cholesky factor per group.

    Every start takes ``steps`` concentration steps; of their ends the one of least determinant counts
    (ties: the first start). ``floors`` are the least standard deviations of the factor, which make a
    group whose vectors lie in a plane, or all agree, regular.
    """
    dim = len(parts)
    xs = [f"x_{i}" for i in range(dim)]
    cut = lambda p: F.greatest(F.least(F.col(p), F.lit(LARGEST)), F.lit(-LARGEST))
    vectors = staged(vectors.groupBy(key, *[(F.round(cut(p) * GRID) / GRID).alias(x) for p, x in zip(parts, xs)])
                     .agg(F.count("*").alias("n")), "mcd_vectors")
    estimate = staged(_starts(vectors, key, floors), "mcd")
    keys = [key, "start"]
    for step in range(steps):
        kept = F.lit(share)
        if step == 0:
            for start, first in enumerate(FIRST):
                kept = F.when(F.col("start") == start, first).otherwise(kept)
        far = joined(vectors, estimate, [key], by=xs).select(*keys, "n", *xs, F.log1p(_distance(dim)).alias("d"))
        limit = binned_quantile(far, keys, "d", kept, 1 / 64, F.col("n")).select(
            *keys, (F.col("d") + 1 / 128).alias("limit"))
        near = joined(far, staged(limit, "mcd_limit"), keys, by=xs).filter("d <= limit")
        # exact sums of grid numbers
        whole = [(F.col(x) * GRID).cast("long") for x in xs]
        total = lambda c: F.sum(c * F.col("n")).cast("double")
        halves = lambda c: total(F.shiftright(c, HALF)) * 2.0**HALF + total(c.bitwiseAND(F.lit(2**HALF - 1)))
        sums = near.groupBy(*keys).agg(
            F.sum("n").alias("n"), *[total(whole[i]).alias(f"s_{i}") for i in range(dim)],
            *[halves(whole[i] * whole[j]).alias(f"q_{i}_{j}") for i, j in _below(dim)])
        means = sums.select(*keys, "n", *[(F.col(f"s_{i}") / F.col("n") / GRID).alias(f"m_{i}") for i in range(dim)],
                            *[f"q_{i}_{j}" for i, j in _below(dim)])
        fit = means.select(*keys, *[f"m_{i}" for i in range(dim)], *[
            ((F.col(f"q_{i}_{j}") / F.col("n") / GRID**2 - F.col(f"m_{i}") * F.col(f"m_{j}"))
             * CONSISTENCY.get(share, 1.0)).alias(f"c_{i}_{j}") for i, j in _below(dim)])
        estimate = staged(_factored(fit, keys, floors), "mcd")
    volume = reduce(lambda a, b: a + b, [F.log(F.col(f"l_{i}_{i}")) for i in range(dim)])
    rest = [c for c in estimate.columns if c not in keys]
    best = estimate.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(volume, F.col("start"))).alias("best"))
    return staged(best.join(vectors.groupBy(key).agg(F.sum("n").alias("n")), key).select(key, "n", "best.*"), "mcd")


def shrunk(levels: DataFrame, estimate: DataFrame, floors: list[float], weight: float) -> DataFrame:
    """(g, m_i, l_i_j) for every row of ``levels`` (g, of_lang, of_all: keys of ``estimate``).

    A group of n rows and its language become one mixture, the group's share n / (n + weight); the
    language was mixed with all rows in the same way. Centre and covariance are the mixture's.
    """
    dim = len(floors)
    cols = [f"m_{i}" for i in range(dim)] + [f"c_{i}_{j}" for i, j in _below(dim)]
    named = lambda p: estimate.select(F.col("key").alias(p), F.col("n").alias(f"n_{p}"),
                                      *[F.col(c).alias(f"{p}_{c}") for c in cols])
    mix = levels.select("g", "of_lang", "of_all").distinct()
    for p in ("g", "of_lang", "of_all"):
        mix = mix.join(named(p), p)
    upper = "of_all"
    for p in ("of_lang", "g"):
        own = F.col(f"n_{p}") / (F.col(f"n_{p}") + weight)
        off = [F.col(f"{p}_m_{i}") - F.col(f"{upper}_m_{i}") for i in range(dim)]
        mixed = {c: own * F.col(f"{p}_{c}") + (1 - own) * F.col(f"{upper}_{c}") for c in cols}
        mixed |= {f"c_{i}_{j}": mixed[f"c_{i}_{j}"] + own * (1 - own) * off[i] * off[j] for i, j in _below(dim)}
        mix = mix.withColumns({f"{p}_{c}": value for c, value in mixed.items()})
        upper = p
    mix = _factored(mix.select("g", *[F.col(f"g_{c}").alias(c) for c in cols]), ["g"], floors)
    return mix.drop(*[c for c in cols if c.startswith("c_")])


def centred(stats: DataFrame, weight: float) -> DataFrame:
    """(g, middle): typical mean word length of every group, shrunk as its estimate is."""
    key = F.explode(F.array("g", "of_lang", "of_all")).alias("key")
    sizes = stats.groupBy("g", "of_lang", "of_all").count()
    rows = sizes.select(key, "count").groupBy("key").agg(F.sum("count").alias("n"))
    level = staged(binned_quantile(stats.select(key, "mean_length"), ["key"], "mean_length", 0.5, 1 / 64).join(
        rows, "key"), "middle")
    out = sizes.drop("count")
    for p in ("g", "of_lang", "of_all"):
        out = out.join(level.select(F.col("key").alias(p), F.col("mean_length").alias(f"m_{p}"), F.col("n").alias(f"n_{p}")), p)
    mixed = F.col("m_of_all")
    for p in ("of_lang", "g"):
        own = F.col(f"n_{p}") / (F.col(f"n_{p}") + weight)
        mixed = own * F.col(f"m_{p}") + (1 - own) * mixed
    return staged(out.select("g", mixed.alias("middle")), "middle")


def vectors_of(docs: DataFrame, weight: float = SHRINK) -> DataFrame:
    """(doc_id, statistics, base_failed, g, of_lang, of_all, ``VECTOR``) of every row of ``docs``.

    g names language and source, of_lang the language, of_all all rows; null is a value of its own.
    """
    docs = docs.select("doc_id", "text", "lang", "source")
    stats = staged(text_statistics(docs, "doc_id", "lang", "source"), "statistics").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"),
        F.to_json(F.array(F.col("lang").cast("string"), F.col("source").cast("string"))).alias("g"),
        F.to_json(F.array(F.col("lang").cast("string"))).alias("of_lang"), F.lit("[]").alias("of_all"),
        F.try_divide("word_chars", "n_words").alias("mean_length"))
    middle = centred(stats.filter(~F.col("base_failed")), weight)
    share = lambda c, of: F.sqrt(F.try_divide(c, of))
    return staged(joined(stats, middle, ["g"], "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "g", "of_lang", "of_all", ((F.col("mean_length") - F.col("middle")) * F.sqrt("n_words")).alias("v_length"),
        share("n_symbols", "word_chars").alias("v_symbols"), share("n_dup_lines", "n_words").alias("v_lines"),
        share("n_repeat_words", "n_words").alias("v_repeats")), "vectors")


def quality(docs: DataFrame, weight: float = SHRINK, limit: float = LIMIT) -> DataFrame:
    """doc_id, the text statistics, base_failed, distance2 and kept, for every row of ``docs``.

    Groups are (lang, source); null is a group of its own. Every group has its own estimate, mixed
    with its language's, which counts as ``weight`` rows; languages are mixed with all rows likewise.
    Rows that fail the fixed rules have no distance and aren't kept. Repeated rows count each time;
    a null id is carried as it is.
    """
    stats = vectors_of(docs, weight)
    good = stats.filter(~F.col("base_failed"))
    floors = [FLOOR[v] for v in VECTOR]
    estimate = mcd(good.select(F.explode(F.array("g", "of_lang", "of_all")).alias("key"), *VECTOR), "key",
                   list(VECTOR), floors)
    judged = joined(stats, staged(shrunk(good, estimate, floors, weight), "estimates"), ["g"], "left")
    for i, v in enumerate(VECTOR):
        judged = judged.withColumnRenamed(v, f"x_{i}")
    judged = judged.withColumn("distance2", F.when(~F.col("base_failed"), _distance(len(VECTOR))))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "distance2",
                         (~F.col("base_failed") & (F.col("distance2") <= limit)).alias("kept"))
