"""The registered queries of this package. Each takes (spark, sf_dir) and reads whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from newsloom.llm import ann, bpe, chat, lexical, mixing, ngram_join, quality, rollups, secrets, token_files, topk, warc, whitening
from newsloom.llm.common import read_table, work_folder, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: Files of public tokenizers; they are read where the work runs and never copied.
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def registered(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def domain_of(source: Column) -> Column:
    """Sources by number in four domains; the tables have no domain of their own."""
    return F.concat(F.lit("domain"), (F.regexp_extract(F.coalesce(source, F.lit("")), r"(\d{1,9})", 1).try_cast("int") % 4).cast("string"))


#: Weights by level: one domain counts twice, English counts three times; sources share alike.
MIX = mixing.MixOptions(weights={"domain": {"domain1": 2.0}, "lang": {"en": 3.0}}, share=1.0, max_epochs=2)


def quality_model(spark: SparkSession, sf_dir: str) -> quality.FMModel:
    return quality.train(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels").where(~held_out()))


@registered
def op1_secret_scans(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    found = secrets.scan(docs, secrets.trained_on(docs))
    return found.select("doc_id", "start", F.length("value").alias("length"), F.sha2("value", 256).alias("value_sha256"), "score", "is_secret")


@registered
def op2_quality_classifier(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return quality.score(docs, quality_model(spark, sf_dir)).select("doc_id", held_out().alias("held_out"), "score", "predicted")


@registered
def op3_warc_packages(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages")
    manifest = warc.write_packages(pages, warc.package_folder(spark))
    return warc.read_packages(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@registered
def op4_ngram_jaccard_join(spark, sf_dir):
    return ngram_join.jaccard_components(read_table(spark, sf_dir, "documents"))


@registered
def op5_bpe_round_trip(spark, sf_dir):
    return bpe.round_trip_digests(read_table(spark, sf_dir, "documents"), WORD_BPE)


@registered
def op6_chat_role_repair(spark, sf_dir):
    found = chat.repaired(read_table(spark, sf_dir, "conversations"))
    return found.select("conv_id", "turn", "role", "action", "inserted_before", "inserted_after", F.sha2("rendered", 256).alias("rendered_sha256"))


@registered
def op7_exact_top_k(spark, sf_dir):
    return topk.exact_top_k(read_table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


@registered
def op8_source_mixing(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    counted = docs.select("doc_id", domain_of(F.col("source")).alias("domain"), "lang", "source", mixing.word_tokens(F.col("text")).alias("n_tokens"))
    return mixing.choose(counted, MIX)


@registered
def op9_nearest_neighbours(spark, sf_dir):
    return ann.nearest(read_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def word_count(text: Column) -> Column:
    return mixing.word_tokens(text)


def mark_count(text: Column) -> Column:
    """Runs of ASCII letters and digits, runs of other characters that are not blank."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]+")).cast("long")


@registered
def op10_token_counts(spark, sf_dir):
    """All documents come in by one batch per tokenizer version; a batch revises, one deletes, and one is sent again.

    The revision counts English documents by letters and marks in the first version too; the
    deletion takes out documents that state no text or fewer than 3 words.
    """
    docs = read_table(spark, sf_dir, "documents")
    counted = docs.select("source", "lang", word_count(F.col("text")).alias("words"), mark_count(F.col("text")).alias("marks"))
    counted = written(counted, "counts")  # texts are split once for all batches
    rollup = rollups.Rollup(spark, work_folder(spark, "rollup"))
    words, marks = F.col("words"), F.col("marks")
    load = rollups.changes("insert", counted, "words-1", words).unionByName(rollups.changes("insert", counted, "marks-1", marks))
    english = counted.where(F.col("lang") == "en")
    short = counted.where(F.col("words") < 3)
    shown = F.when(F.col("lang") == "en", marks).otherwise(words)
    rollup.apply("load", load)
    rollup.apply("revise", rollups.changes("revise", english, "words-1", marks, words))
    rollup.compact()
    rollup.apply("delete", rollups.changes("delete", short, "words-1", shown).unionByName(rollups.changes("delete", short, "marks-1", marks)))
    rollup.apply("load", load)
    return rollup.totals()


@registered
def op11_token_files(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    manifest = token_files.write_tokens(docs, work_folder(spark, "token-files"), BYTE_BPE)
    stored = token_files.read_documents(token_files.locate_documents(manifest, docs.schema["doc_id"].dataType.simpleString()))
    return stored.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@registered
def op12_lexical_search(spark, sf_dir):
    return lexical.ranked_search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@registered
def op13_whitening(spark, sf_dir):
    return whitening.whiten(read_table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))
