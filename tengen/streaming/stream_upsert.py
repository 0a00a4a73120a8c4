"""Continuous event upsert: landed versions stream into a log, a view resolves it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import work_dir


def resolve(versions: DataFrame) -> DataFrame:
    """The latest version of each event, by update time, then sequence.

    A maximum is associative, so the same step serves a micro-batch, the log and a compaction.
    """
    value = F.struct(*[c for c in versions.columns if c != "event_id"])
    return versions.groupBy("event_id").agg(F.max_by(value, F.struct("updated_at", "ingest_seq")).alias("v")) \
        .select("event_id", "v.*")


def start(stream: DataFrame, log_path: str, checkpoint: str):
    """Append each collapsed micro-batch to the log.

    A batch's cost depends on the batch only: nothing stored is rewritten. Its
    folder is named by the batch id, so a retried batch replaces itself.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        resolve(batch).write.mode("overwrite").parquet(f"{log_path}/batch={batch_id}")
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint) \
        .trigger(availableNow=True).start()


def current(spark, log_path: str, schema) -> DataFrame:
    log = spark.read.schema(schema).option("basePath", log_path).parquet(log_path)
    return resolve(log.drop("batch"))


def compact(spark, log_path: str, target: str, schema) -> None:
    """Write the resolved log as the first batch of a new log; later batches go there."""
    current(spark, log_path, schema).write.mode("errorifexists").parquet(f"{target}/batch=-1")


def run_fixture(fx, files_per_trigger: int | None = None, compacted: bool = False) -> DataFrame:
    spark = fx.spark
    root = f"{work_dir(spark)}/{spark.sparkContext.applicationId}/stream/{uuid.uuid4().hex[:12]}"
    rows = fx.event_updates.drop("event_key")
    for seq in (1, 2, 3):
        rows.filter(F.col("ingest_seq") == seq).write.mode("append").parquet(f"{root}/landing")
    reader = spark.readStream.schema(rows.schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    start(reader.parquet(f"{root}/landing"), f"{root}/log", f"{root}/checkpoint").awaitTermination()
    if compacted:
        compact(spark, f"{root}/log", f"{root}/log2", rows.schema)
    return current(spark, f"{root}/log2" if compacted else f"{root}/log", rows.schema).drop("ingest_seq")
