"""Incremental cell counts: contacts that arrive in files are added to cells with Structured Streaming.

A cell's count is a keyed sum, so no watermark is needed; what is built on cells stays
batch. Each batch's sums are written as a table of additions under the batch's number, so
a repeated batch replaces itself. When the additions have grown to a share of the cells
they are merged into a new version of these: so each cell is rewritten a few times in all,
however many batches there are, and reading takes about one row for each cell. A version
states the last batch that is in it; batches up to that one are never added again.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from contactspark.operators import matrix

#: Additions, as a share of the cells' bytes, that are merged.
SHARE = 0.25


def _numbered(spark: SparkSession, folder: str, name: str, complete: bool = False) -> list[int]:
    """The numbers of tables ``name``=n below a folder, in order; ``complete``: of those whose writing ended."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    found = [m for s in files.listStatus(path) if (m := re.fullmatch(f"{name}=([0-9]+)", s.getPath().getName()))]
    return sorted(int(m[1]) for m in found if not complete or files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{m[0]}/_SUCCESS")))


def _bytes(spark: SparkSession, folders: list[str]) -> int:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return sum(path(f).getFileSystem(conf).getContentSummary(path(f)).getLength() for f in folders)


def _remove(spark: SparkSession, folders: list[str]) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for f in folders:
        path(f).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path(f), True)


def _state(spark: SparkSession, folder: str) -> tuple[int, list[int]]:
    """The last whole version of the cells (-1 where there is none), and the batches of additions after it."""
    versions = _numbered(spark, f"{folder}/cells", "version", complete=True)
    version = versions[-1] if versions else -1
    return version, [n for n in _numbered(spark, f"{folder}/additions", "batch", complete=True) if n > version]


def _sum(spark: SparkSession, folder: str, version: int, batches: list[int]) -> DataFrame:
    paths = [f"{folder}/cells/version={version}"] * (version >= 0) + [f"{folder}/additions/batch={n}" for n in batches]
    read = spark.read.parquet(*paths)
    if not batches:
        return read
    return read.groupBy(*matrix.CELL).agg(F.sum("count").alias("count"), F.sum("pos_count").alias("pos_count"))


def merge(spark: SparkSession, folder: str) -> None:
    """A new version of the cells with all additions in it. The version before stays, with its later additions, for those who still read it; what is older goes."""
    version, batches = _state(spark, folder)
    if not batches:
        return
    _sum(spark, folder, version, batches).write.mode("overwrite").parquet(f"{folder}/cells/version={batches[-1]}")
    _remove(spark, [f"{folder}/cells/version={v}" for v in _numbered(spark, f"{folder}/cells", "version") if v < version])
    _remove(spark, [f"{folder}/additions/batch={n}" for n in _numbered(spark, f"{folder}/additions", "batch") if n <= version])


def add(batch: DataFrame, number: int, folder: str, to_contacts: Callable[[DataFrame], DataFrame], bin_size: int, share: float = SHARE) -> None:
    """Takes in a batch of the stream. A batch that is in the cells already, or is repeated, changes nothing."""
    spark = batch.sparkSession
    version, _ = _state(spark, folder)
    if number <= version:
        return
    matrix.cells(to_contacts(batch), bin_size).write.mode("overwrite").parquet(f"{folder}/additions/batch={number}")
    version, batches = _state(spark, folder)
    held = _bytes(spark, [f"{folder}/cells/version={version}"]) if version >= 0 else 0
    if _bytes(spark, [f"{folder}/additions/batch={n}" for n in batches]) >= share * held:
        merge(spark, folder)


def start(spark: SparkSession, source: DataFrame, folder: str, to_contacts: Callable[[DataFrame], DataFrame], bin_size: int, once: bool = False) -> StreamingQuery:
    """Follows ``source`` (a streaming frame); additions go to ``folder``/additions, cells to ``folder``/cells, progress to ``folder``/progress."""
    writer = source.writeStream.foreachBatch(lambda batch, number: add(batch, number, folder, to_contacts, bin_size)).option("checkpointLocation", f"{folder}/progress")
    return (writer.trigger(availableNow=True) if once else writer).start()


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The cells so far."""
    return _sum(spark, folder, *_state(spark, folder))


def run_once(spark: SparkSession, path: str, pattern: str, folder: str, to_contacts: Callable[[DataFrame], DataFrame], bin_size: int, files_together: int = 8) -> DataFrame:
    """Takes in the Parquet files in ``path`` of these names that weren't taken in before, so many to a batch, and gives the cells."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(path).schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_together).parquet(path)
    start(spark, source, folder, to_contacts, bin_size, once=True).awaitTermination()
    return current(spark, folder)
