"""Defaults of the news flow, and where durable scratch data goes."""

from __future__ import annotations

import re
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class IngestOptions:
    dedup_ttl_s: int = 172_800
    max_links_per_page: int = 30
    link_domain: str = "finance.yahoo.com"
    link_path_token: str = "/news/"
    robots_rule: str = "disallow: /quote/"


@dataclass(frozen=True)
class CleanOptions:
    require_english: bool = True
    min_body_bytes: int = 200


@dataclass(frozen=True)
class ResolveOptions:
    min_score: float = 2.0
    max_tickers: int = 5
    fuzzy_cutoff: float = 85.0
    entity_chars: int = 3000


@dataclass(frozen=True)
class ScoreOptions:
    model_chars: int = 2000
    enable_rules: bool = True


@dataclass(frozen=True)
class SinkOptions:
    feed_rows: int = 50
    feed_ttl_s: int = 604_800
    archive_rows_per_file: int = 500
    archive_idle_s: int = 60


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for durable intermediate data, deleted when the application ends.

    A cluster names its shared folder in `spark.checkpoint.dir` (or sets the context's checkpoint
    directory). Without one only a purely local session gets a temporary folder; a cluster raises,
    since each machine would write to its own disk.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="newsloom-")
    folder = f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(path)
    return folder


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The same rows, computed once and read from a durable table from here on."""
    folder = work_folder(df.sparkSession, purpose)
    df.write.parquet(folder)
    back = df.sparkSession.read.schema(df.schema).parquet(folder)
    back.work_folder = folder
    return back


def discard(*tables: DataFrame) -> None:
    """Deletes tables of `written` after their last reader; nothing that still has to run may read them."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.work_folder)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Has the driver's JVM collect what nothing refers to any more: Spark then removes the shuffle
    files of finished work, which otherwise stay for half an hour or more."""
    spark._jvm.System.gc()
