"""Structured Streaming forms of the incremental operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkwarden.operators.rules import R
from sparkwarden.operators.scan import scan_rules


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def stream_sync(stream: DataFrame, path: str, keys: Sequence[str], order: str, checkpoint: str,
                available_now: bool = True) -> StreamingQuery:
    """Incremental upsert as a change log: every micro-batch adds its latest rows per key.

    A batch costs as much as it holds, however large the table is.  It writes to a folder named
    after its id, so a batch that runs again after a failure replaces its own output.  Readers use
    :func:`current_rows`; :func:`compact` folds the log from time to time.
    """
    def apply(batch: DataFrame, batch_id: int) -> None:
        rest = [c for c in batch.columns if c not in keys and c != order]
        latest = batch.groupBy(*keys).agg(F.max_by(F.struct(order, *rest), F.struct(order, *rest)).alias("r"))
        latest.select(*keys, "r.*").write.mode("overwrite").parquet(f"{path}/batch={batch_id:010d}")

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def current_rows(spark: SparkSession, path: str, schema, keys: Sequence[str], order: str) -> DataFrame:
    """State of a change log: per key the row of the largest order value; of equal ones that of the latest batch."""
    log = spark.read.schema(schema).option("basePath", path).parquet(path)
    rest = [c for c in log.columns if c not in keys and c not in (order, "batch")]
    newest = log.groupBy(*keys).agg(F.max_by(F.struct(order, *rest), F.struct(order, "batch", *rest)).alias("r"))
    return newest.select(*keys, "r.*")


def compact(spark: SparkSession, path: str, schema, keys: Sequence[str], order: str, into: str) -> None:
    """Write the state of a log as the first batch of a new log."""
    current_rows(spark, path, schema, keys, order).write.mode("overwrite").parquet(f"{into}/batch=0000000000")


def stream_rule_scan(files: DataFrame, rules: Sequence[R] | None = None, keys: Sequence[str] = ("repo", "file_path")) -> DataFrame:
    """The rule scan is stateless, so arriving files go through the same plan."""
    return scan_rules(files, rules, keys)


def stream_progress(progress: DataFrame, key: str = "scan_id", order: str = "ts", *columns: str) -> DataFrame:
    """Latest state per key, for update or complete output; the row of the largest order value counts whole."""
    return progress.groupBy(key).agg(
        F.max_by(F.struct(*columns), F.struct(order, *columns)).alias("s"), F.max(order).alias(order)).select(
        key, order, "s.*")


def stream_progress_fields(progress: DataFrame, key: str = "scan_id", order: str = "ts", *columns: str) -> DataFrame:
    """State per key merged field by field: an update that leaves a field null keeps its last known value.

    Each field is the value of the largest order value that has one (of equal ones the largest value), so the state does not depend on how
    updates fall into batches, and late ones only fill what nothing newer has told.
    """
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(order, c))).alias(c) for c in columns]
    return progress.groupBy(key).agg(F.max(order).alias(order), *last)


def finished(states: DataFrame, status: str = "status") -> DataFrame:
    return states.filter(F.col(status).isin("done", "error"))


def _event_time(df: DataFrame, ts: str) -> DataFrame:
    """Watermarks need an instant; a wall-clock column is read in the session's time zone."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")) if dict(df.dtypes)[ts] == "timestamp_ntz" else df


def stream_trend(events: DataFrame, ts: str = "ts", every: str = "1 day", late: str = "1 hour", *by: str) -> DataFrame:
    """Counts per tumbling window; windows close once the watermark passes them."""
    timed = _event_time(events, ts)
    timed = timed.withWatermark(ts, late) if events.isStreaming else timed
    return timed.groupBy(F.window(ts, every).alias("w"), *by).agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("window_start"), *by, "n")


def stream_dedup_results(results: DataFrame, key: str = "cache_key", ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """First result of every content key; keys are forgotten once the watermark passes them."""
    return _event_time(results, ts).withWatermark(ts, late).dropDuplicatesWithinWatermark([key])
