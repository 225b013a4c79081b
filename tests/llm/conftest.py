import pytest
from pyspark.sql import types as T

from basketry.llm.common import ship

#: Texts that every operator has to take: null, empty, blank, ties, copies, very long, odd characters.
ODD = [
    (1, "The quick brown fox jumps over the lazy dog near the old river bank today.", "en", "a"),
    (2, "The quick brown fox jumps over the lazy dog near the old river bank today.", "en", "a"),
    (3, None, "en", "a"), (4, "", None, None), (5, " \t\n\x0b ", "en", None), (6, "x", "de", "b"),
    (7, "word " * 30_000, "en", "a"), (8, "é🙂 ñ\n\né🙂 ñ", "es", "b"), (8, "é🙂 ñ\n\né🙂 ñ", "es", "b"),
    (None, "a row without an id but with quite a few words of its own", "en", "a"),
    (9, "1234 5678 !!! ###", "en", "a"), (10, "y" * 100_000, None, "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def llm(spark):
    ship(spark)
    return spark


@pytest.fixture(scope="session")
def odd(llm):
    """Odd rows with further columns whose names the operators use themselves."""
    extra = "key string, rest string, hits int, kept string, score string, n_words string, g int, w string, t string, sid string"
    rows = [(*r, "k", "r", 1, "no", "s", "n", 2, "w", "t", "i") for r in ODD]
    return llm.createDataFrame(rows, f"{SCHEMA}, {extra}").repartition(3)


@pytest.fixture(scope="session")
def empty(llm):
    return llm.createDataFrame([], SCHEMA)


def frame(spark, texts, parts=3):
    """documents of a list of texts, or of (doc_id, text) pairs."""
    rows = [(t if isinstance(t, tuple) else (i, t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, T.StructType([T.StructField("doc_id", T.LongType()),
                                                     T.StructField("text", T.StringType())])).repartition(parts)
