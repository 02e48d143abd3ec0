"""A table of generated texts by key, appended to in one write for many entries and looked up by bucket."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Parts of the table by key; a look-up of one key reads one of them.
BUCKETS = 64
SCHEMA = "key string, value string, write string, bucket int"


class CacheTable:
    """``key, value`` under ``path``, in folders ``write=<name>/bucket=<number>``.

    Every append is one folder, so writers don't disturb each other. Where a key was written more than
    once the least value counts, so it doesn't matter which of two writers came first, nor whether a
    reader sees a folder and the one it was compacted into.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _files(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return path, path(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def writes(self) -> list[str]:
        """Names of the folders that are complete."""
        path, files = self._files()
        if not files.exists(path(self.path)):
            return []
        names = [s.getPath().getName() for s in files.listStatus(path(self.path))]
        return sorted(n for n in names if n.startswith("write=") and files.exists(path(f"{self.path}/{n}/_SUCCESS")))

    def bucket(self, key: str):
        return F.pmod(F.crc32(key), F.lit(self.buckets)).cast("int")

    def table(self) -> DataFrame:
        """All entries, each key once."""
        return self._rows().groupBy("key").agg(F.min("value").alias("value"))

    def _rows(self, folders: list[str] | None = None) -> DataFrame:
        names = self.writes() if folders is None else folders
        if not names:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).option("basePath", self.path).parquet(*[f"{self.path}/{n}" for n in names])

    def lookup(self, key: str) -> str | None:
        """One key's value; only its bucket's files are read."""
        number = self.spark.range(1).select(self.bucket(F.lit(key))).first()[0]
        return self._rows().filter((F.col("bucket") == number) & (F.col("key") == key)).agg(F.min("value")).first()[0]

    def attach(self, asked: DataFrame, key: str = "key", value: str = "held") -> DataFrame:
        """``asked`` with the value of each row's key, null where there is none."""
        found = self.table().select(F.col("key").alias(key), F.col("value").alias(value))
        return asked.join(found, key, "left")

    def append(self, entries: DataFrame) -> None:
        """Write ``key, value`` of many entries in one job, a file or a few per bucket."""
        rows = entries.select("key", "value").filter("key IS NOT NULL AND value IS NOT NULL").groupBy("key").agg(F.min("value").alias("value"))
        self._write(rows, "a")

    def _write(self, rows: DataFrame, kind: str) -> None:
        folder = f"{self.path}/write={kind}{time.time_ns():020}-{uuid.uuid4().hex[:8]}"
        parted = rows.withColumn("bucket", self.bucket("key"))
        parted.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(folder)

    def compact(self) -> int:
        """Put all complete folders into one; how many there were. Readers may go on meanwhile."""
        before = self.writes()
        if len(before) < 2:
            return len(before)
        self._write(self._rows(before).groupBy("key").agg(F.min("value").alias("value")), "c")
        path, files = self._files()
        for name in before:
            files.delete(path(f"{self.path}/{name}"), True)
        return len(before)
