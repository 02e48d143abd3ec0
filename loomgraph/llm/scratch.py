"""Tables written to the folder that all executors share, to cut lineage where executors may be lost."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

SETTING = "spark.checkpoint.dir"
#: Batches of whole texts by bytes, not by rows alone, so that a task's memory doesn't follow their length.
BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": "4m", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.parquet.columnarReaderBatchSize": "512"}
#: Bytes that a Parquet writer holds before it writes them out; where the folder is on a local or mounted
#: file system, no checksum file beside each file, as that doubles their number.
WRITING = {"compression": "snappy", "parquet.block.size": str(8 << 20), "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def small_batches(spark: SparkSession) -> None:
    """Apply :data:`BATCHES` where the session has no setting of its own."""
    own = spark.conf.getAll
    for key, value in BATCHES.items():
        if key not in own:
            spark.conf.set(key, value)


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where none is set, as in local tests."""
    root = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{SETTING} must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="loomgraph-")
        spark.conf.set(SETTING, root)
    return root.rstrip("/")


class Scratch:
    """Intermediate tables of one operator call, each removable as soon as nothing reads it."""

    def __init__(self, spark: SparkSession, name: str):
        small_batches(spark)
        self.spark = spark
        self.base = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, table: str) -> str:
        return f"{self.base}/{table}"

    def keep(self, df: DataFrame, table: str, partition_by: str | None = None) -> DataFrame:
        """Write ``df`` and return it reread: later stages recompute nothing that lies before it."""
        writer = df.write.mode("overwrite").options(**WRITING)
        if partition_by:
            writer = writer.partitionBy(partition_by)
        writer.parquet(self.path(table))
        return self.open(table, df)

    def open(self, table: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(table))

    def drop(self, *tables: str) -> None:
        for table in tables:
            self._delete(self.path(table))

    def _delete(self, where: str) -> None:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(where)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def even_keys(spark: SparkSession, n: int) -> list[int]:
    """Numbers that ``repartition(n, key)`` deals one to each partition."""
    rows = spark.range(n * 30).select(F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("p"), "id").groupBy("p").agg(F.min("id")).collect()
    found = dict(rows)
    return [found.get(p, p) for p in range(n)]
