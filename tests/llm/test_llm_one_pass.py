"""Texts pass the pattern of candidates once, and their tokens are counted once."""

import random
import re

from pyspark.sql import functions as F

from newsloom.llm import mixing, secrets


def test_candidates_are_cut_out_by_one_pass(spark, monkeypatch):
    rng = random.Random(8)
    parts = ["token", "=", ": ", ":", "=>", " ", "  ", "\t", "\n", '"', "'", "`", "abc123", "x" * 16, "$0\\", "a/b-c.d_e+f=" * 2, "é", ";", "==", "password", secrets.CUT, "api_key = ", "auth:=", "Zz9!Zz9!", "> `", "\x0b"]
    texts = [None, "", "a" * 40, f"token={secrets.CUT}abcdefgh {secrets.CUT}", *("".join(rng.choices(parts[:20] if i % 2 else parts, k=rng.randrange(1, 25))) for i in range(600))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    options = secrets.ScanOptions()
    # The pattern without the shortcut, in two passes.
    old = secrets._pattern(options).replace(r"(?<=[:=>\s\"'`])", "", 1)
    assert old != secrets._pattern(options)
    whole = F.coalesce("text", F.lit(""))
    found, between = secrets._items(F.col("pieces"))
    cut = docs.select("text", secrets._pieces(F.col("text"), options).alias("pieces")).select("text", found.alias("found"), between.alias("between"))
    rows = cut.select("found", "between", F.regexp_extract_all(whole, F.lit(old), F.lit(0)).alias("f"), F.split(whole, old, -1).alias("b")).collect()
    assert all(r["found"] == r["f"] and r["between"] == r["b"] for r in rows) and sum(len(r["f"]) for r in rows) > 300
    calls, replace, extract = [], F.regexp_replace, F.regexp_extract_all
    monkeypatch.setattr(F, "regexp_replace", lambda *a: calls.append(1) or replace(*a))
    plan = secrets.candidates(docs, options)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"regexp_replace\(", plan)) == len(calls) == 1


def test_tokens_of_a_mix_are_counted_once(spark, monkeypatch):
    rows = [(i, f"word {'more ' * (i % 7)}", f"source{i % 5}", "en" if i % 3 else "de") for i in range(60)] + [(7, None, "source1", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    options = mixing.MixOptions(weights={"lang": {"en": 3.0}}, share=0.7, max_epochs=2)
    domain = F.substring("source", 7, 1)
    counted = docs.withColumn("domain", domain).withColumn("n_tokens", mixing.word_tokens(F.col("text")))
    stated = sorted(r["doc_id"] for r in mixing.choose(counted, options).collect() for _ in range(r["copies"]))
    tables, written = [], mixing.written
    monkeypatch.setattr(mixing, "written", lambda df, purpose: tables.append((purpose, df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all("))) or written(df, purpose))
    mixed = mixing.mix(docs, options, domain)
    assert sorted(r["doc_id"] for r in mixed.collect()) == stated and mixed.columns == docs.columns
    assert sum(n for _, n in tables) == 1 and "regexp_extract_all(" not in mixed._jdf.queryExecution().optimizedPlan().toString()
