"""Incremental ingest: a stream of document rows merged into a stored table.

Each micro-batch is one upsert of the hash buckets it touches and one new version
of the table, which appears at once or not at all. The batch's number is written with
the version, so a batch that is replayed after a failure changes nothing: with the
stream's own checkpoint that makes the table exactly-once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tamarisk.operators.store import VersionedTable, upsert_documents
from tamarisk.plans.materialise import written


def documents_table(spark: SparkSession, path: str, buckets: int = 16) -> VersionedTable:
    return VersionedTable(spark, path, ("source", "ext_id"), buckets)


def merge_batch(spark: SparkSession, path: str, batch: DataFrame, epoch: int, arrival: str, buckets: int = 16) -> bool:
    """The stored documents with a batch merged in; False if it was merged before. ``epoch`` numbers
    the batches; only the buckets the batch touches are read and written."""
    table = documents_table(spark, path, buckets)
    last = table.manifest()
    if last is not None and last["mark"] is not None and last["mark"] >= epoch:
        return False
    touched = table.touched(batch)
    if not touched:
        return False
    stored = table.read(touched)
    stored = spark.createDataFrame([], batch.schema) if stored is None else stored
    top = 0 if last is None else last["facts"]["top"]
    merged = written(upsert_documents(stored, batch.drop("doc_id"), arrival, top), "ingest")
    table.commit(merged, touched, epoch, {"top": max(top, merged.agg(F.max("doc_id")).first()[0] or 0)})
    return True


def in_order(spark: SparkSession, folder: str) -> int:
    """Gives the part files of a folder times in the order of their names, so that a stream takes
    them in that order. Returns how many there are."""
    mk = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = mk(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = sorted((f.getPath() for f in fs.listStatus(mk(folder)) if f.getPath().getName().startswith("part-")), key=lambda p: p.getName())
    for n, f in enumerate(files):
        fs.setTimes(f, 1_700_000_000_000 + 1000 * n, -1)
    return len(files)


def ingest_stream(spark: SparkSession, folder: str, schema: StructType, table: str, checkpoint: str, arrival: str = "ingested_at",
                  glob: str | None = None, files_per_trigger: int = 8) -> StreamingQuery:
    """Starts a stream over Parquet files of ``folder`` that ends when all are read."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return (
        reader.parquet(folder).writeStream.foreachBatch(lambda df, n: merge_batch(spark, table, df, n, arrival))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and mean value per window and type; works on streams (late rows are dropped by
    the watermark) and on tables alike."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value")).select(F.col("w.start").alias("start"), "event_type", "n", "mean_value")
