"""Streaming forms: incremental landing, log routing, versioned appends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from starloom.operators.logs import route_logs
from starloom.operators.versioned import latest_versions, number_changes
from starloom.sources.ingest import stamp_load
from starloom.sources.readers import string_columns


def incremental_ingest(spark: SparkSession, source: str, schema: T.StructType, target: str, checkpoint: str,
                       stamp: str, fmt: str = "parquet") -> StreamingQuery:
    """Land only the files that arrived since the last run, then stop.

    The checkpoint remembers the files, so a re-run after a failure neither repeats nor misses any.
    """
    arriving = spark.readStream.format(fmt).schema(schema).load(source)
    landed = stamp_load(string_columns(arriving), stamp)
    return (
        landed.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def routed_stream(logs: DataFrame, key: str, ttl: str = "7 days") -> DataFrame:
    """Log stream without repeated deliveries (same key within the retention time), routed by phase.

    The watermark bounds the state: keys older than ``ttl`` leave it.
    """
    unique = logs.withWatermark("timestamp", ttl).dropDuplicatesWithinWatermark([key])
    return route_logs(unique)


def stream_logs(logs: DataFrame, key: str, target: str, checkpoint: str, ttl: str = "7 days") -> StreamingQuery:
    dated = routed_stream(logs, key, ttl).withColumn("log_date", F.to_date("timestamp"))
    return (
        dated.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .partitionBy("target_table", "log_date")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def stream_versions(changes: DataFrame, keys: list[str], table: str, checkpoint: str) -> StreamingQuery:
    """Append every micro-batch of changes to a versioned Parquet folder, numbered above what is there.

    Each batch goes to its own ``batch=<n>`` folder, so a repeated batch replaces itself. The newest version of every
    key is kept in one of two slots in turn: a batch reads the slot of the batch before it, never the history.
    """

    def slot(batch_id: int) -> str:
        return f"{table}/_latest/slot={batch_id % 2}"

    def append(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch_id == 0:
            stored = batch.select(*keys, F.lit(0).cast("bigint").alias("version")).limit(0)
        else:
            stored = spark.read.parquet(slot(batch_id - 1))
        folder = f"{table}/batch={batch_id}"
        number_changes(stored, batch, keys).write.mode("overwrite").parquet(folder)
        fresh = spark.read.schema(stored.schema).parquet(folder)
        latest_versions(stored.unionByName(fresh), keys, "version").write.mode("overwrite").parquet(slot(batch_id))

    return (
        changes.writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
