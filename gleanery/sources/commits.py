"""Which attempts at writing a batch count.

Every attempt writes a folder of its own. It counts from the moment a commit file for it is there: an empty
file whose name says all, so that making it is one step that happens or does not. The commit
with the highest number is the batch. Readers list the commits once and read those folders, hence the old batch or the
new one and never a part of either, whatever happens to the driver or the executors.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.types import StructType

# Begins with "_", so that Spark does not take it for data.
COMMITS = "_commits"


@dataclass(frozen=True)
class Attempt:
    root: str
    writer: str
    batch_id: int
    name: str

    @property
    def path(self) -> str:
        return f"{self.root}/writer=w-{self.writer}/batch_id={self.batch_id}/attempt={self.name}"


def new_attempt(root: str, batch_id: int, writer: str) -> Attempt:
    if "," in writer or "/" in writer:
        raise ValueError(f"the name of a writer has no comma and no slash: {writer!r}")
    # The letter keeps the name from being read as a number.
    return Attempt(root.rstrip("/"), writer, int(batch_id), f"a{uuid.uuid4().hex}")


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, at = _folder(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []


def _all(spark: SparkSession, root: str) -> list[tuple[int, Attempt]]:
    found = []
    for name in _names(spark, f"{root}/{COMMITS}"):
        parts = name.split(",")
        if len(parts) == 4:
            writer, batch_id, number, attempt = parts
            found.append((int(number), Attempt(root, writer, int(batch_id), attempt)))
    return found


def committed(spark: SparkSession, root: str) -> list[Attempt]:
    """The attempt that counts of each batch of each writer: as many as there are batches."""
    best: dict[tuple[str, int], tuple[int, str, Attempt]] = {}
    for number, a in _all(spark, root.rstrip("/")):
        # Two drivers that commit one batch at a time: all readers choose the same one.
        ranked = (number, a.name, a)
        key = (a.writer, a.batch_id)
        if key not in best or ranked[:2] > best[key][:2]:
            best[key] = ranked
    return [a for _, _, a in sorted(best.values(), key=lambda r: (r[2].writer, r[2].batch_id))]


def commit(spark: SparkSession, attempt: Attempt) -> None:
    """Makes the attempt the one that counts."""
    earlier = [n for n, a in _all(spark, attempt.root) if (a.writer, a.batch_id) == (attempt.writer, attempt.batch_id)]
    number = max(earlier, default=0) + 1
    fs, folder = _folder(spark, f"{attempt.root}/{COMMITS}")
    fs.mkdirs(folder)
    name = f"{attempt.writer},{attempt.batch_id},{number},{attempt.name}"
    fs.createNewFile(spark._jvm.org.apache.hadoop.fs.Path(folder, name))


def abort(spark: SparkSession, attempt: Attempt) -> None:
    """Removes what an attempt wrote. What an abort does not get to is never read, and goes with `vacuum`."""
    fs, at = _folder(spark, attempt.path)
    fs.delete(at, True)


def vacuum(spark: SparkSession, root: str, older_than_seconds: float = 7 * 86400) -> int:
    """Removes attempts that do not count and were last touched so long ago, and their commits; returns how many.
    Readers that began before that long ago, and writers that take that long, are not safe."""
    root = root.rstrip("/")
    keep = set(committed(spark, root))
    until = (time.time() - older_than_seconds) * 1000
    removed = 0
    for writer in _names(spark, root):
        if not writer.startswith("writer=w-"):
            continue
        for batch in _names(spark, f"{root}/{writer}"):
            fs, folder = _folder(spark, f"{root}/{writer}/{batch}")
            for status in fs.listStatus(folder):
                name = status.getPath().getName().removeprefix("attempt=")
                attempt = Attempt(root, writer.removeprefix("writer=w-"), int(batch.removeprefix("batch_id=")), name)
                if attempt not in keep and status.getModificationTime() < until:
                    for number, a in _all(spark, root):
                        if a == attempt:
                            old = f"{root}/{COMMITS}/{a.writer},{a.batch_id},{number},{a.name}"
                            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(old), False)
                    removed += fs.delete(status.getPath(), True)
    return removed


class ParquetStore:
    """A store for the registry that writes Parquet and commits it: `write`, then `commit` or `abort`."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def write(self, items, batch_id: int) -> Attempt:
        attempt = new_attempt(self.root, batch_id, "store")
        items.write.parquet(attempt.path)
        return attempt

    def commit(self, attempt: Attempt) -> None:
        commit(self.spark, attempt)

    def abort(self, attempt: Attempt) -> None:
        abort(self.spark, attempt)

    def read(self, schema: StructType | str | None = None):
        from .tables import read_batches

        return read_batches(self.spark, self.root, schema)
