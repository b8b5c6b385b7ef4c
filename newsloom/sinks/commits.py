"""Micro-batches into partitioned Parquet folders, once each.

A batch is written to a staging folder and its files are then moved under the table, named after the
batch. The list of targets is stored before the first move, so the repetition of a batch that broke
off removes what it had moved; a marker is set after the last move, so the repetition of a finished
batch does nothing. Readers see an ordinary partitioned folder: names that begin with an underscore
are no data.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession

# Files are moved or deleted in runs of this many, so many runs at a time.
RUN = 64
RUNS_AT_A_TIME = 16


class Folder:
    """File operations below one folder of any file system that Spark knows."""

    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        self._spark, self._jvm, self._made = spark, spark._jvm, set()
        # Each dot of a class name is a call to the JVM, so the class is looked up once.
        self._class = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path("").getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _path(self, name: str):
        return self._class(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self._files.exists(self._path(name))

    def delete(self, name: str) -> None:
        self._files.delete(self._path(name), True)

    def names(self, name: str = "") -> list[str]:
        """What lies directly in a folder; nothing if there is none."""
        if not self.exists(name):
            return []
        return sorted(s.getPath().getName() for s in self._files.listStatus(self._path(name)))

    def data_files(self, name: str) -> list[str]:
        """Parquet files below a folder, by their path inside it; Spark lists them, and the names come in one call."""
        start = len(self._files.makeQualified(self._path(name)).toString()) + 1
        files = self._spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
        return sorted(r["path"][start:] for r in files.load(self._path(name).toString()).select("path").collect())

    def move(self, source: str, target: str) -> None:
        folder = target.rpartition("/")[0]
        if folder not in self._made:
            self._files.mkdirs(self._path(folder))
            self._made.add(folder)
        if not self._files.rename(self._path(source), self._path(target)):
            raise RuntimeError(f"could not move {source} to {target} in {self.root}")

    def move_all(self, sources: list[str], targets: list[str]) -> None:
        self._dealt(lambda i: self.move(sources[i], targets[i]), len(sources))

    def delete_all(self, names: list[str]) -> None:
        self._dealt(lambda i: self.delete(names[i]), len(names))

    @staticmethod
    def _dealt(work: Callable[[int], None], count: int) -> None:
        """work(0) to work(count - 1), in runs of consecutive numbers, many runs at a time."""

        def run(first: int) -> None:
            for i in range(first, min(first + RUN, count)):
                work(i)

        with ThreadPoolExecutor(RUNS_AT_A_TIME) as pool:
            for _done in pool.map(run, range(0, count, RUN)):
                pass

    def store(self, name: str, lines: list[str]) -> None:
        """A small text file that is there as a whole or not at all."""
        draft = f"{name}.draft"
        self._files.mkdirs(self._path(name).getParent())
        out = self._files.create(self._path(draft), True)
        try:
            out.write("\n".join(lines).encode())
        finally:
            out.close()
        self.delete(name)
        self.move(draft, name)

    def lines(self, name: str) -> list[str]:
        size = self._files.getFileStatus(self._path(name)).getLen()
        data = self._files.open(self._path(name))
        try:
            text = bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(data)).decode() if size else ""
        finally:
            data.close()
        return [line for line in text.split("\n") if line]


def commit_batch(spark: SparkSession, root: str, name: str, write: Callable[[str], None]) -> bool:
    """Adds what `write(folder)` writes to the table at `root`; False, and no work, if `name` is committed.

    One writer per name at a time, as a streaming query is.
    """
    folder = Folder(spark, root)
    marker, pending, staging = f"_commits/{name}", f"_pending/{name}", f"_staging/{name}"
    if folder.exists(marker):
        return False
    if folder.exists(pending):
        folder.delete_all(folder.lines(pending))
    folder.delete(staging)
    write(f"{folder.root}/{staging}")
    files = folder.data_files(staging)
    targets = [f"{f.rpartition('/')[0]}/{name}-{i:05d}.parquet".lstrip("/") for i, f in enumerate(files)]
    folder.store(pending, targets)
    folder.move_all([f"{staging}/{file}" for file in files], targets)
    folder.store(marker, [])
    folder.delete(pending)
    folder.delete(staging)
    return True
