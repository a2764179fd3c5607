"""Cutting lineage into storage every executor shares.

A lost executor must not lose results, so nothing here keeps blocks on one
machine: iterative operators checkpoint, and expensive stages that are read
more than once are written as Parquet, both into the folder the cluster names
in ``spark.checkpoint.dir``. Only where that is unset and everything runs on one
machine (tests, a laptop) a temporary folder is used; a cluster without it is refused.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session; sets one of its own only if none is set."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    held = sc.getCheckpointDir()
    if held is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="tamarisk-")
        sc.setCheckpointDir(own)
        held = sc.getCheckpointDir()
    return held


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: for the small tables of an iteration."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is gone; its folder is the cluster's to clear
        pass


def folder(spark: SparkSession, name: str = "table") -> str:
    """A new path in the shared folder; what is written there is deleted when the process ends."""
    path = f"{shared_dir(spark).rstrip('/')}/tamarisk-{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """The table written as Parquet into the shared folder, and read from there.

    Each call writes a folder of its own; it is deleted when the process ends.
    """
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, keys: list[str], start: int = 0, out: str = "n") -> DataFrame:
    """Adds numbers from ``start`` on in the order of the keys, the same whenever it is run
    (equal keys in any order), without sorting all rows in one task: range partitions
    are numbered apart, and begin where the ones before them end."""
    ranged = written(df.repartitionByRange(*keys).withColumn("_p", F.spark_partition_id()), "numbered")
    sizes = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))  # a row a partition
    before = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_b"))
    place = F.row_number().over(Window.partitionBy("_p").orderBy(*keys))
    return ranged.join(before, "_p").withColumn(out, (F.col("_b") + place + F.lit(start - 1)).cast("long")).drop("_p", "_b")
