"""Balance alert as a stateful operator: one verdict per event-time window, when it closes."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from skewlens.operators.sampling import UNIFORM_LIMIT

ALERT_SCHEMA = "window_start timestamp, window_end timestamp, n_rows long, chi_square double, alert boolean"
#: State store with the key prefixes and timers that the operator needs.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession):
    """The session with :data:`STATE_STORE` for queries started inside, then as it was."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, STATE_STORE)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def _chi_square(counts: list[int], num_classes: int) -> tuple[int, float]:
    n = sum(counts)
    return n, sum(c * c for c in counts) * num_classes / n - n


class _Windows(StatefulProcessor):
    """Counts by class of one window; a timer at the window's end gives the verdict."""

    def __init__(self, num_classes: int, limit: float):
        self.num_classes, self.limit = num_classes, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        key = T.StructType([T.StructField("label", T.StringType())])
        value = T.StructType([T.StructField("n", T.LongType())])
        self.counts = handle.getMapState("counts", key, value)
        self.end = handle.getValueState("end", T.StructType([T.StructField("ms", T.LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            end = int(part["end_ms"].iloc[0])
            if end <= timerValues.getCurrentWatermarkInMs():
                continue  # the window is closed and its verdict given: late rows change nothing
            if not self.end.exists():
                self.end.update((end,))
                self.handle.registerTimer(end)
            for label, n in part.groupby("label")["n"].sum().items():
                held = self.counts.getValue((label,)) if self.counts.containsKey((label,)) else None
                self.counts.updateValue((label,), (int(n) + (held[0] if held else 0),))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        counts = [int(v[0]) for _, v in self.counts.iterator()]
        if counts:
            end = int(self.end.get()[0])
            n, chi = _chi_square(counts, self.num_classes)
            yield pd.DataFrame(
                {
                    "window_start": [pd.Timestamp(int(key[0]), unit="ms")],
                    "window_end": [pd.Timestamp(end, unit="ms")],
                    "n_rows": [n],
                    "chi_square": [float(chi)],
                    "alert": [bool(chi >= self.limit)],
                }
            )
        self.counts.clear()
        self.end.clear()

    def close(self) -> None:
        pass


def _partial_counts(stream: DataFrame) -> DataFrame:
    """Counts by window and label within each task of a micro-batch, so that a crowded
    window sends a row per class and task to its state, not its rows."""

    def count(batches):
        held: dict = {}
        for batch in batches:
            for start, end, label, ts in zip(*(batch.column(c).to_pylist() for c in ("start_ms", "end_ms", "label", "ts"))):
                n, last = held.get((start, end, label), (0, ts))
                held[start, end, label] = (n + 1, max(last, ts))
        if held:
            keys, values = list(held), list(held.values())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in keys], pa.int64()),
                    pa.array([k[1] for k in keys], pa.int64()),
                    pa.array([k[2] for k in keys], pa.string()),
                    pa.array([v[0] for v in values], pa.int64()),
                    pa.array([v[1] for v in values], pa.timestamp("us", "UTC")),
                ],
                ["start_ms", "end_ms", "label", "n", "ts"],
            )

    return stream.mapInArrow(count, "start_ms long, end_ms long, label string, n long, ts timestamp")


def window_alerts(
    stream: DataFrame,
    ts: str,
    label: str,
    width: str,
    num_classes: int,
    slide: str | None = None,
    watermark: str = "1 hour",
    limit: float = UNIFORM_LIMIT,
) -> DataFrame:
    """``(window_start, window_end, n_rows, chi_square, alert)``, one row per window, once the
    watermark has passed its end; its state is dropped then. Late rows do not reopen a
    window, and a restart from the checkpoint repeats no verdict. Rows without a time or a
    label are left out.

    The chi-square is that of the class counts against a uniform split of ``num_classes``.
    Needs ``spark.sql.streaming.stateStore.providerClass`` set to :data:`STATE_STORE`.
    """
    window = F.window(F.col(ts).cast("timestamp"), width, slide) if slide else F.window(F.col(ts).cast("timestamp"), width)
    rows = stream.where(F.col(ts).isNotNull() & F.col(label).isNotNull()).select(
        window.alias("w"), F.col(label).cast("string").alias("label"), F.col(ts).cast("timestamp").alias("ts")
    )
    rows = rows.select(
        F.unix_millis("w.start").alias("start_ms"), F.unix_millis("w.end").alias("end_ms"), "label", "ts"
    )
    counts = _partial_counts(rows).withWatermark("ts", watermark)
    return counts.groupBy("start_ms").transformWithStateInPandas(
        statefulProcessor=_Windows(num_classes, limit),
        outputStructType=T.StructType.fromDDL(ALERT_SCHEMA),
        outputMode="append",
        timeMode="EventTime",
    )
