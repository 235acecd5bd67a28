"""Written tables between the steps of a job, in the folder that all executors share."""

from __future__ import annotations

import gc
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir


class Scratch:
    """A folder of tables that cut lineage: a lost executor costs a reread, not a recomputation of what led there."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
        self._n = 0

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df and returns the written table."""
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._quern_path = path
        return out

    def bucketed(self, df: DataFrame, key: str, name: str) -> DataFrame:
        """As table, in buckets of `key` as many as tasks: joins and groups on it read the table without a shuffle. Tasks write a file for each bucket that they have rows of."""
        path, table = self.path(name), f"quern_{uuid.uuid4().hex}"
        df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(width(self.spark), key).saveAsTable(table)
        out = self.spark.table(table)
        out._quern_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables of this folder that no later step reads, and lets Spark clear the shuffles of steps that nothing refers to any more."""
        gc.collect()  # plans that Python still holds keep their shuffles
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._quern_path)
            path.getFileSystem(conf).delete(path, True)
        jvm.System.gc()


#: Rows of one key that a step of add_up puts together, and its steps: enough for 16 million tasks.
FAN_IN, LEVELS = 64, 4


def add_up(rows: DataFrame, key: str, blobs: dict) -> DataFrame:
    """Sums of number arrays, kept as bytes in the columns `blobs` (with their types), by `key` (a long), of which each task sends one row: those of FAN_IN neighbouring tasks first, then
    FAN_IN of these sums, and so on, so that what one task reads does not grow with their number."""
    schema = f"{key} long, salt int, " + ", ".join(f"{c} binary" for c in blobs)

    def add(table: pa.Table) -> pa.Table:
        sums = {}
        for c, kind in blobs.items():
            sums[c] = np.zeros(len(table[c][0].as_buffer()) // np.dtype(kind).itemsize, kind)
            for x in table[c]:
                sums[c] += np.frombuffer(x.as_buffer(), kind)
        return pa.Table.from_pylist([{key: table[key][0].as_py(), "salt": table["salt"][0].as_py()} | {c: x.tobytes() for c, x in sums.items()}], schema=pa.schema([(key, pa.int64()), ("salt", pa.int32()), *((c, pa.binary()) for c in blobs)]))

    some = rows.withColumn("salt", F.spark_partition_id()).select(key, "salt", *blobs)
    for level in range(LEVELS):
        some = some.withColumn("salt", F.floor(F.col("salt") / FAN_IN).cast("int") if level < LEVELS - 1 else F.lit(0)).groupBy(key, "salt").applyInArrow(add, schema)
    return some.drop("salt")


def width(spark: SparkSession) -> int:
    """Number of tasks that a step is dealt to."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
