"""The corpus pipeline: quality, near copies, secrets, mix, tokens. Each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from newsloom.llm import bpe, mixing, ngram_join, quality, queries, secrets
from newsloom.llm.common import read_table, written

#: No SQL: stages hold trained models and a tokenizer. tests/llm compares what each stage keeps and changes with plain versions.
ORACLE_SQL = None

THRESHOLD = 0.3


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine scores below the threshold go."""
    return quality.keep_good(docs, queries.quality_model(spark, sf_dir), THRESHOLD)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked at a similarity of 0.8 over five-word shingles the first stays."""
    return ngram_join.keep_first(docs, ngram_join.JoinOptions(words=5, percent=80, counted=13))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the forest takes for a secret is replaced in the text; n_chars follows."""
    clean = secrets.redact(docs, secrets.trained_on(docs))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them (not at all, once or twice)."""
    return mixing.mix(docs, queries.MIX, queries.domain_of(F.col("source")))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and the ids of each text."""
    encoded = bpe.encode_with(docs, queries.WORD_BPE, ["doc_id", "lang", "source"])
    return encoded.withColumn("n_tokens", F.size("ids"))


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("secret scans", redact_secrets),
    ("mixing", mix_sources),
    ("BPE", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is a written table that the next one reads."""
    docs = read_table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = written(docs, f"stage-{number}")
    return docs
