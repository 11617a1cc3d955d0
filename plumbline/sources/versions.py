"""A5: a store of readings by fingerprint that batches and streams write to: numbered changes, compacted versions, one pointer.

    <path>/change/batch=N   the rows of batch N; the same batch written again replaces its folder
    <path>/version/v=N      all rows as of change N, one a fingerprint
    <path>/CURRENT          the number of the version that holds, replaced by an atomic rename

Readers take the current version and the changes after it, so they never see half a write: a folder counts once its
_SUCCESS file is there, a version once CURRENT names it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Files:
    """The few calls to the folder's file system that a pointer needs."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.root = self.jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.root.getFileSystem(self.conf)

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.root, name)

    def numbers(self, kind: str, prefix: str) -> list[int]:
        """The numbered folders of a kind that were written to their end."""
        if not self.fs.exists(self.at(kind)):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self.at(kind))]
        return sorted(int(n[len(prefix) :]) for n in names if n.startswith(prefix) and self.fs.exists(self.at(f"{kind}/{n}/_SUCCESS")))

    def current(self) -> int | None:
        if not self.fs.exists(self.at("CURRENT")):
            return None
        stream = self.fs.open(self.at("CURRENT"))
        try:
            return int(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def point(self, number: int) -> None:
        new = self.at(f"CURRENT-{uuid.uuid4().hex}")
        stream = self.fs.create(new)
        stream.write(bytearray(str(number).encode()))
        stream.close()
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        array = self.jvm.java.lang.reflect.Array.newInstance(rename.OVERWRITE.getClass(), 1)
        array[0] = rename.OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.root.toUri(), self.conf).rename(new, self.at("CURRENT"), array)


def newest(rows: DataFrame) -> DataFrame:
    """One row a fingerprint: that of the latest batch, and in a batch of the latest ``saved_at``; rows combine before the shuffle."""
    names = [n for n in rows.columns if n not in ("fingerprint", "batch")]
    best = F.max_by(F.struct(*names), F.struct("batch", "saved_at"))
    return rows.groupBy("fingerprint").agg(best.alias("r"), F.max("batch").alias("batch")).select("fingerprint", *[F.col("r")[n].alias(n) for n in names], "batch")


def write_change(rows: DataFrame, path: str, batch: int | None = None) -> int:
    """Rows (fingerprint, saved_at, ...) as change ``batch``, the next free number without one; the number is returned."""
    if batch is None:
        seen = Files(rows.sparkSession, path)
        batch = max([-1, *seen.numbers("change", "batch="), *seen.numbers("version", "v=")]) + 1
    newest(rows.withColumn("batch", F.lit(batch).cast("long"))).write.mode("overwrite").parquet(f"{path}/change/batch={batch}")
    return batch


def store_sink(path: str, every: int = 20) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that upserts a stream's readings, and compacts the store after every so many batches."""

    def keep(batch: DataFrame, number: int) -> None:
        write_change(batch, path, number)
        if number % every == every - 1:
            compact(batch.sparkSession, path)

    return keep


def pending(spark: SparkSession, path: str) -> tuple[int | None, list[int], DataFrame | None]:
    files = Files(spark, path)
    version = files.current()
    changes = [n for n in files.numbers("change", "batch=") if version is None or n > version]
    folders = ([f"{path}/version/v={version}"] if version is not None else []) + [f"{path}/change/batch={n}" for n in changes]
    return version, changes, spark.read.option("mergeSchema", True).parquet(*folders) if folders else None


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The store as it is now: one row a fingerprint. A store without a write has no schema and can't be read."""
    _, _, rows = pending(spark, path)
    if rows is None:
        raise FileNotFoundError(f"nothing stored below {path}")
    return newest(rows).drop("batch")


def compact(spark: SparkSession, path: str) -> int | None:
    """Write all rows as one version and point to it; the number of the version, None if there was nothing to do.

    Readers that hold the older version go on reading its files, which vacuum() takes away later. A compaction that
    dies leaves a version that nothing points to, which the next one replaces.
    """
    _, changes, rows = pending(spark, path)
    if not changes:
        return None
    newest(rows).write.mode("overwrite").parquet(f"{path}/version/v={changes[-1]}")
    Files(spark, path).point(changes[-1])
    return changes[-1]


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Delete the changes and versions that the current version has replaced; the folders' names are returned."""
    files = Files(spark, path)
    version = files.current()
    if version is None:
        return []
    old = [f"change/batch={n}" for n in files.numbers("change", "batch=") if n <= version] + [f"version/v={n}" for n in files.numbers("version", "v=") if n < version]
    for name in old:
        files.fs.delete(files.at(name), True)
    return old
