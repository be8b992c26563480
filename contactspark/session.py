"""Making the package known to Python workers, and the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
#: Most bytes of a batch that goes to a Python worker; Spark's own limit is eight times that, for each task at once.
BATCH_BYTES = 8 << 20
_BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application, so that their Python workers can import it; bounds the batches they get where nobody has."""
    sc = spark.sparkContext
    if not sc.getConf().contains(_BATCHES):
        spark.conf.set(_BATCHES, str(BATCH_BYTES))
    if sc.applicationId in _shipped:
        return
    top = Path(__file__).parent
    target = Path(tempfile.mkdtemp(prefix="contactspark-")) / "contactspark.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*")):
            if p.is_file() and p.suffix in (".py", ".json"):
                z.write(p, p.relative_to(top.parent))
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local master gets a temporary one; on a cluster that is an error, as its machines share no such folder."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="contactspark-")
        sc.setCheckpointDir(folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in this application's part of the shared folder; ``clean`` removes all of them."""
    return f"{shared_dir(spark)}/contactspark-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4()}"


def clean(spark: SparkSession) -> None:
    """Removes what this application kept in the shared folder. Frames that read it can't be used any more."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/contactspark-{sc.applicationId}")
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def keep(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as a table, which later steps read. It stays there until ``clean``."""
    path = fresh_path(df.sparkSession, "table")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
