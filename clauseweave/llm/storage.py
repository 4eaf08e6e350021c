"""Tables in the shared folder that are removed once nothing reads them."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from clauseweave.session import shared_folder, storing


class Workspace:
    """A folder of intermediate tables under the shared folder; ``close`` deletes those still there."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = f"{shared_folder(spark)}/work-{uuid.uuid4().hex}"
        self.tables: list[str] = []
        self.count = 0

    def _next(self) -> str:
        self.count += 1
        return f"{self.path}/{self.count}"

    def store(self, df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
        """Stored; what was shuffled for it leaves the disk. ``by`` names columns whose values get folders of their own."""
        path = self._next()
        with storing(self.spark):
            df.write.partitionBy(*by).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def bucketed(self, df: DataFrame, key: str) -> DataFrame:
        """Stored by the hash of ``key``: joins on it move only their other side."""
        name = f"work_{uuid.uuid4().hex}"
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        with storing(self.spark):
            df.write.bucketBy(buckets, key).option("path", self._next()).saveAsTable(name)
        self.tables.append(name)
        return self.spark.table(name)

    def remove(self, path: str) -> None:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(hadoop, True)

    def drop(self, df: DataFrame) -> None:
        """Delete one stored table."""
        for file in df.inputFiles()[:1]:
            self.remove(re.sub(r"(/[^/]*=[^/]*)*/[^/]*$", "", file))

    def close(self) -> None:
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.remove(self.path)

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()
