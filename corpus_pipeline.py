"""The corpus pipeline: quality, near duplicates, decontamination, mixing, token files. ``STAGES`` in order.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept, and returns a DataFrame that is written as
Parquet and reread as the next one's input. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomspark.llm import decontam, jaccard, mixing, quality, tokens
from loomspark.llm.common import load, materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go (operator 8)."""
    return quality.keep_good(docs.select(*COLUMNS), load(spark, sf_dir, "labels"))


def duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates by n-gram Jaccard one document stays (operator 6)."""
    return jaccard.keep_one(docs.select(*COLUMNS))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that hold nothing else go (operator 1)."""
    return decontam.cut(docs.select(*COLUMNS), load(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated to the target mix of sources and shuffled (operator 5)."""
    return mixing.mix(docs.select(*COLUMNS)).select(*COLUMNS)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files are written and read back (operator 3)."""
    import public_tokenizers

    return tokens.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", duplicates_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("tokens", tokens_stage),
]

#: The classifier and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    out = load(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, out, sf_dir)
        if k + 1 < len(STAGES):
            out = materialize(out, f"pipeline-{name}")
    return out
