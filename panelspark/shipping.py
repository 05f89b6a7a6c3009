"""What tasks and drivers share: this package's own code, and a folder for tables."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession

_shipped: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that tasks can import it wherever they start."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="panelspark-")) / "panelspark_code.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master may go without: it gets a folder of its own."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = "file://" + tempfile.mkdtemp(prefix="panelspark-shared-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def saved(df: DataFrame, purpose: str) -> DataFrame:
    """df as a table in the shared folder: computed once, and read again whatever executors are lost."""
    path = f"{shared_dir(df.sparkSession)}/{purpose}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a task where `dealt` deals.
ROWS = 500_000


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """A saved table's rows, dealt by keys to as many tasks as their number needs, so that a task's memory doesn't grow with
    the table. Without keys, evenly. The session's number of partitions is the least."""
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // ROWS))
    return df.repartition(tasks, *keys)


def dealt_if_large(df: DataFrame, *keys: str | Column) -> DataFrame:
    """As dealt, if the session's number of partitions would hold more than ROWS rows each, else df as it is. A grouping by all keys
    that follows needs no other shuffle, and its tasks' maps don't grow with the table."""
    tasks = -(-df.count() // ROWS)
    return df.repartition(tasks, *keys) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df
