"""Registered queries of the corpus operators, over the whole given tables, and their DuckDB SQL."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from basketry.llm import (bpe, decontam, langid, linededup, lm, minhash, phrases, pii, quality, spelling, suffixdedup,
                          toxicity, urlfilter)
from basketry.llm.common import ship, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; its operator's Python part goes to the executors first."""
    def register(fn):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(spark, sf_dir)
        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = sql
        return run
    return register


@query("op1_url_filter", urlfilter.URL_SQL)
def op1_url_filter(spark, sf_dir):
    """Every page against the dated block and allow lists active when it was fetched."""
    return urlfilter.from_tables(spark, sf_dir)


@query("op2_decontaminate", decontam.REPORT_SQL)
def op2_decontaminate(spark, sf_dir):
    """Contamination report of every document against all benchmark items, window 13."""
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def vocabulary_path() -> str:
    """Where the public byte-level vocabulary lies; its place is a parameter of ``bpe.load``."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op3_bpe")
def op3_bpe(spark, sf_dir):
    """Byte-level BPE of every document and back."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), bpe.load(vocabulary_path()))


@query("op4_lm_score")
def op4_lm_score(spark, sf_dir):
    """Context-mixing and unigram scores of every document."""
    return lm.score_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


@query("op5_quality")
def op5_quality(spark, sf_dir):
    """Fixed quality rules and robust outliers per language and source over all documents."""
    return quality.quality(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op6_substring_dedup", suffixdedup.WINDOW_SQL)
def op6_substring_dedup(spark, sf_dir):
    """Bytes of all documents that 50-byte strings of smaller documents cover."""
    return suffixdedup.dedup_substrings(table(spark, sf_dir, "documents"))


@query("op7_language")
def op7_language(spark, sf_dir):
    """Cross-parsing language of every document."""
    return langid.identify(table(spark, sf_dir, "documents")).select(
        "doc_id", "held_out", "lang_pred", "score")


@query("op9_near_duplicates", minhash.COMPONENT_SQL)
def op9_near_duplicates(spark, sf_dir):
    """Near-duplicate components of all documents, 2-word shingles, similarity 0.8."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


@query("op10_line_dedup", linededup.UNITS_SQL)
def op10_line_dedup(spark, sf_dir):
    """Repeated lines and sentences of all documents, earliest occurrence kept."""
    return linededup.dedup_report(table(spark, sf_dir, "documents"))


@query("op11_toxicity")
def op11_toxicity(spark, sf_dir):
    """Toxicity score of every document, learnt from the labelled rows outside the held-out fifth."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op12_spelling_variants", spelling.VARIANTS_SQL)
def op12_spelling_variants(spark, sf_dir):
    """Near words, forms and roots of the frequent long words of all documents."""
    return spelling.variants(table(spark, sf_dir, "documents"))


@query("op13_phrases", phrases.PHRASES_SQL)
def op13_phrases(spark, sf_dir):
    """Each language's best collocations of two to four words over all documents."""
    return phrases.collocations(table(spark, sf_dir, "documents"))


@query("op8_personal_data")
def op8_personal_data(spark, sf_dir):
    """Personal data of all documents: base spans and those the trained classifier adds."""
    return pii.personal_data(table(spark, sf_dir, "documents"))


@query("pipeline")
def pipeline(spark, sf_dir):
    """The corpus pipeline of the repository's top folder over documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
