"""Token counts as delta-maintained rollups.

A change batch holds signed changes of documents: an insert adds its count, a delete takes it away,
a revision takes the old count away and adds the new one. A batch is reduced to additive totals by
source, language and tokenizer version and stored under its id. The stored batches add up to the
totals, so nothing that was counted before is read again.

Commits are idempotent: a batch is written to a folder of its own and becomes valid when its commit
file appears in one rename; a batch id that is committed is not counted again, and what a lost run
left behind is ignored. `compact` folds all committed batches into one base in the same way, and
keeps their ids.

Defined results: a null count is 0 tokens of one document; null source, language or version are
groups of their own; changes with a null or unknown kind are refused (the batch raises); repeated
change rows count as often as they occur; groups that are back at no documents and no tokens
vanish; an empty batch commits and changes nothing; without any batch the totals are empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

GROUP = ("source", "lang", "tokenizer")
TOTALS = "source string, lang string, tokenizer string, documents bigint, tokens bigint"


def changes(kind: str, docs: DataFrame, tokenizer: str, tokens: Column, old_tokens: Column | None = None) -> DataFrame:
    """Change rows of documents: kind is insert, delete or revise (which needs the old count)."""
    old = F.lit(None).cast("long") if old_tokens is None else old_tokens.cast("long")
    return docs.select(F.lit(kind).alias("kind"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.lit(tokenizer).alias("tokenizer"), tokens.cast("long").alias("tokens"), old.alias("old_tokens"))


def delta(batch: DataFrame) -> DataFrame:
    """Signed totals of a change batch, summed per task before the shuffle."""
    kind, new, old = F.col("kind"), F.coalesce("tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
    refused = F.raise_error(F.concat(F.lit("unknown kind of change: "), F.coalesce(kind, F.lit("null"))))
    documents = F.when(kind == "insert", 1).when(kind == "delete", -1).when(kind == "revise", 0).otherwise(refused.cast("int"))
    tokens = F.when(kind == "insert", new).when(kind == "delete", -new).when(kind == "revise", new - old)
    signed = batch.select(*GROUP, documents.cast("long").alias("documents"), tokens.alias("tokens"))
    return signed.groupBy(*GROUP).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))


class Rollup:
    """The rollup stored under a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.folder).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _names(self, kind: str) -> list[str]:
        place = self._path(f"{self.folder}/{kind}")
        return sorted(s.getPath().getName() for s in self._files.listStatus(place)) if self._files.exists(place) else []

    def _state(self) -> tuple[str | None, dict[str, str]]:
        """The base's folder, and batch id -> folder of the batches since."""
        base, covered = None, set()
        if names := self._names("base-commits"):
            base = max(names, key=lambda n: int(n.split(".")[0])).split(".", 1)[1]
            covered = {r[0] for r in self.spark.read.schema("batch string").json(f"{self.folder}/bases/{base}/covers").collect()}
        batches = dict(n.rsplit(".", 1) for n in self._names("commits"))
        return base, {b: f for b, f in batches.items() if b not in covered}

    def committed(self, batch_id: str) -> bool:
        return any(n.rsplit(".", 1)[0] == batch_id for n in self._names("commits"))

    def _publish(self, place: str) -> None:
        """A marker is made beside its place and renamed, which either happens or does not."""
        draft = self._path(f"{self.folder}/drafts/{uuid.uuid4().hex}")
        self._files.mkdirs(draft.getParent())
        self._files.create(draft).close()
        self._files.mkdirs(self._path(place).getParent())
        if not self._files.rename(draft, self._path(place)):
            raise RuntimeError(f"could not commit {place}")

    def apply(self, batch_id: str, batch: DataFrame) -> bool:
        """Adds a batch; False, and no work, where its id is already committed. Batch ids are file names.

        One writer per rollup at a time, as for any table without a lock.
        """
        if "/" in batch_id or not batch_id:
            raise ValueError("a batch id must be a plain name")
        if self.committed(batch_id):
            return False
        run = uuid.uuid4().hex
        delta(batch).write.parquet(f"{self.folder}/batches/{run}")
        self._publish(f"{self.folder}/commits/{batch_id}.{run}")
        return True

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, documents, tokens."""
        base, batches = self._state()
        places = [f"{self.folder}/batches/{f}" for f in batches.values()] + ([f"{self.folder}/bases/{base}/totals"] if base else [])
        if not places:
            return self.spark.createDataFrame([], TOTALS)
        parts = self.spark.read.schema(TOTALS).parquet(*places)
        sums = parts.groupBy(*GROUP).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        return sums.where((F.col("documents") != 0) | (F.col("tokens") != 0))

    def compact(self) -> None:
        """Folds the committed batches into a new base; their ids stay committed."""
        _, batches = self._state()
        if not batches:
            return
        run = uuid.uuid4().hex
        self.totals().write.parquet(f"{self.folder}/bases/{run}/totals")
        everything = [(n.rsplit(".", 1)[0],) for n in self._names("commits")]
        self.spark.createDataFrame(everything, "batch string").coalesce(1).write.json(f"{self.folder}/bases/{run}/covers")
        number = 1 + max([int(n.split(".")[0]) for n in self._names("base-commits")], default=0)
        self._publish(f"{self.folder}/base-commits/{number}.{run}")
