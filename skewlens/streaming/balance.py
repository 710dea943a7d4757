"""Class balance and feature transforms on unbounded input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skewlens.operators.encode import assemble
from skewlens.operators.sampling import UNIFORM_LIMIT


def window_counts(
    stream: DataFrame, ts: str, label: str, width: str, slide: str | None = None, watermark: str = "1 hour"
) -> DataFrame:
    """Rows per event-time window and class. State older than the watermark is dropped.

    Times without a zone are taken as UTC, so the session's zone has to be UTC: in a zone
    with daylight saving days would shift.
    """
    zone = stream.sparkSession.conf.get("spark.sql.session.timeZone")
    if stream.schema[ts].dataType.typeName() == "timestamp_ntz" and zone not in ("UTC", "Etc/UTC", "GMT", "Z"):
        raise ValueError(f"times without a zone need the session zone UTC, not {zone}")
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    return (
        timed.groupBy(window.alias("w"), label)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), label, "n")
    )


def running_counts(stream: DataFrame, label: str) -> DataFrame:
    """Rows per class since the start; the state is one counter per class."""
    return stream.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def write_updates(counts: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Start a query that writes the counts changed by each micro-batch to
    ``path/batch=<id>``. A replayed batch overwrites its own folder, so a restart
    neither loses nor repeats an update. For streams without an end, ``write_rows`` on
    window counts writes every window once, when it is closed, and keeps no history."""

    def upsert(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        counts.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(upsert)
        .start()
    )


def write_state(counts: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Start a query that writes all counters after each micro-batch, for states as small as
    one counter per class. Two folders take turns, so the newest full state is always there
    and no history grows; a replayed batch overwrites its own folder."""

    def replace(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("batch", F.lit(batch_id).cast("long"))
        rows.write.mode("overwrite").parquet(f"{path}/turn={batch_id % 2}")

    return (
        counts.writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(replace)
        .start()
    )


def current_state(spark: SparkSession, path: str) -> DataFrame:
    """The newest full state."""
    rows = spark.read.option("basePath", path).parquet(path)
    newest = rows.agg(F.max("batch")).scalar()
    return rows.where(F.col("batch") == newest).drop("batch", "turn")


def current_counts(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Latest value of every key over all updates written so far."""
    updates = spark.read.option("basePath", path).parquet(path)
    return updates.groupBy(*keys).agg(F.max_by("n", "batch").alias("n"))


def apply_features(stream: DataFrame, params: DataFrame, vocab: DataFrame, out: str = "features") -> DataFrame:
    """Fitted standardisation and one-hot encoding on a stream: stateless, no join."""
    return assemble(stream, params, vocab, out)


def write_rows(rows: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Append rows that will not change any more: transformed records, closed windows."""
    return (
        rows.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def balance_alert(counts: DataFrame, keys: list[str], num_classes: int, limit: float = UNIFORM_LIMIT) -> DataFrame:
    """Chi-square of each window's class counts against a uniform split.

    With k classes and N rows, sum((n - N/k)^2 / (N/k)) = k/N * sum(n^2) - N, so absent
    classes need no rows of their own.
    """
    sums = counts.groupBy(*keys).agg(
        F.sum("n").alias("n_rows"), F.sum(F.col("n").cast("double") * F.col("n")).alias("_sq")
    )
    return sums.select(
        *keys,
        "n_rows",
        (F.col("_sq") * num_classes / F.col("n_rows") - F.col("n_rows")).alias("chi_square"),
    ).withColumn("alert", F.col("chi_square") >= limit)
