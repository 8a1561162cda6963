"""Streams of documents: stateless processing, duplicates dropped, idempotent batches, running counts."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import new_documents, tables
from ..plans.process import process

SCHEMA = "doc_id long, user_id long, text string, ts timestamp"


def _blank():
    return F.trim(F.coalesce(F.col("text"), F.lit(""))) == ""


def read_stream(spark: SparkSession, folder: str, schema: str = SCHEMA) -> DataFrame:
    """Documents as they arrive, with the hash of their text; rows without text are kept for ingest() to reject."""
    return spark.readStream.schema(schema).parquet(folder).withColumn("file_hash", F.sha2(F.coalesce("text", F.lit("")), 256))


def without_repeats(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """One document for each (user_id, file_hash) within the delay: state is bounded, what comes later may pass again."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["user_id", "file_hash"])


def stored(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    """A stored table of committed batches: those whose documents, which are written last, are there. None before the first one."""
    try:
        done = spark.read.parquet(f"{folder}/documents")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return None
    return done if name == "documents" else spark.read.parquet(f"{folder}/{name}").join(done.select("batch").distinct(), "batch", "left_semi")


def store_batch(batch: DataFrame, number: int, folder: str) -> None:
    """Writes a batch's rows under its number, over whatever an earlier try has left; documents come last and commit it.

    A retry thus writes the same rows again, and what is stored in other batches is never stored twice.
    """
    spark = batch.sparkSession
    before = stored(spark, folder, "documents")
    others = before.where(F.col("batch") != number) if before is not None else None
    batch.where(_blank()).select("doc_id", "user_id", F.lit("no text").alias("error")).write.mode("overwrite").parquet(f"{folder}/rejected/batch={number}")
    parts = tables(process(new_documents(batch.where(~_blank()), others)))
    for name in [*(n for n in parts if n != "documents"), "documents"]:
        parts[name].write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")


def ingest(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Processes what has arrived and stores it batch by batch; what is stored for a user is never stored again."""
    return stream.writeStream.foreachBatch(lambda batch, number: store_batch(batch, number, folder)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_counts(stream: DataFrame, by: str, width: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Counts in windows of time; rows later than the delay are dropped."""
    return stream.withWatermark("ts", delay).groupBy(F.window("ts", width), by).agg(F.count("*").alias("n"))
