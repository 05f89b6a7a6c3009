"""What every operator here needs: shared scratch tables, and names that no column has."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..shipping import shared_dir, ship_code

__all__ = ["Scratch", "fresh", "ship_code"]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of df has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


class Scratch:
    """Parquet tables in the shared folder. They cut lineage and survive the loss of an executor."""

    def __init__(self, spark: SparkSession, purpose: str):
        ship_code(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{purpose}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.option("compression", "zstd").options(**options).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def save_bucketed(self, df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
        """A table bucketed and sorted by key. Its name leaves the catalog at once; the files stay."""
        path, table = f"{self.root}/{name}", f"panelspark_{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(table)
        saved = self.spark.table(table)
        self.spark.sql(f"DROP TABLE {table}")
        return saved

    def folder(self, name: str) -> None:
        """Make a folder for files that tasks write themselves."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)

    def drop(self, name: str) -> None:
        """Remove a table that no later plan reads."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
