"""Streaming queries over the events and items files, run to completion."""

from pyspark.sql import functions as F

from skewlens.catalog.encoding import ITEM_KEY, NUMERIC
from skewlens.catalog.registry import query, table
from skewlens.operators import encode
from skewlens.session import fresh_path
from skewlens.streaming import alerts, balance


def file_stream(spark, sf_dir, name):
    """The table's file as a stream with its declared schema."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def _run(spark, counts, keys):
    path, checkpoint = fresh_path(spark, "stream"), fresh_path(spark, "stream-state")
    balance.write_updates(counts, path, checkpoint).awaitTermination()
    return balance.current_counts(spark, path, keys)


def _windows(spark, sf_dir, width, slide=None):
    counts = balance.window_counts(file_stream(spark, sf_dir, "events"), "ts", "event_type", width, slide)
    return _run(spark, counts, ["window_start", "window_end", "event_type"])


def _naive(df):
    return df.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")).withColumn(
        "window_end", F.col("window_end").cast("timestamp_ntz")
    )


@query("""
    SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, event_type,
           count(*) AS n FROM events GROUP BY 1, 2, 3
""")
def stream_distribution(spark, sf_dir):
    """Class counts per day."""
    return _naive(_windows(spark, sf_dir, "1 day"))


@query("""
    WITH s AS (SELECT event_type, unnest([time_bucket(INTERVAL '12 hours', ts, TIMESTAMP '2024-01-01'),
               time_bucket(INTERVAL '12 hours', ts, TIMESTAMP '2024-01-01') - INTERVAL 12 HOUR]) AS window_start FROM events)
    SELECT window_start, window_start + INTERVAL 1 DAY AS window_end, event_type, count(*) AS n FROM s GROUP BY 1, 2, 3
""")
def stream_sliding_distribution(spark, sf_dir):
    """Class counts per day, advancing by half a day."""
    return _naive(_windows(spark, sf_dir, "1 day", "12 hours"))


@query("""
    SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, event_type,
           count(*) AS n FROM events
    WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY 1, 2, 3
""")
def stream_closed_windows(spark, sf_dir):
    """Class counts per day, each written once when the watermark has passed the day."""
    counts = balance.window_counts(file_stream(spark, sf_dir, "events"), "ts", "event_type", "1 day")
    path, checkpoint = fresh_path(spark, "closed"), fresh_path(spark, "closed-state")
    balance.write_rows(counts, path, checkpoint).awaitTermination()
    return _naive(spark.read.schema(counts.schema).parquet(path))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_running_counts(spark, sf_dir):
    path, checkpoint = fresh_path(spark, "running"), fresh_path(spark, "running-state")
    counts = balance.running_counts(file_stream(spark, sf_dir, "events"), "event_type")
    balance.write_state(counts, path, checkpoint).awaitTermination()
    return balance.current_state(spark, path)


@query("""
    WITH c AS (SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2),
    s AS (SELECT window_start, sum(n)::BIGINT AS n_rows, sum(n * n) * 5::DOUBLE / sum(n) - sum(n) AS chi FROM c GROUP BY 1)
    SELECT window_start, n_rows, round(chi, 6) AS chi_square, chi >= 10 AS alert FROM s
""")
def stream_balance_alert(spark, sf_dir):
    """Chi-square of each day's counts against a uniform split over five classes."""
    counts = _naive(_windows(spark, sf_dir, "1 day"))
    return balance.balance_alert(counts, ["window_start"], 5).withColumn(
        "chi_square", F.round("chi_square", 6)
    )


@query("""
    WITH c AS (SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2),
    s AS (SELECT window_start, sum(n)::BIGINT AS n_rows, sum(n * n) * 5::DOUBLE / sum(n) - sum(n) AS chi FROM c GROUP BY 1)
    SELECT window_start, window_start + INTERVAL 1 DAY AS window_end, n_rows, round(chi, 6) AS chi_square, chi >= 10 AS alert FROM s
    WHERE window_start + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR
""")
def stream_window_alerts(spark, sf_dir):
    """One verdict per day, given once when the day is closed, by state and timers."""
    found = alerts.window_alerts(file_stream(spark, sf_dir, "events"), "ts", "event_type", "1 day", 5)
    path, checkpoint = fresh_path(spark, "alerts"), fresh_path(spark, "alerts-state")
    with alerts.state_store(spark):
        balance.write_rows(found, path, checkpoint).awaitTermination()
    out = _naive(spark.read.schema(found.schema).parquet(path))
    return out.withColumn("chi_square", F.round("chi_square", 6))


@query(
    "WITH s AS (SELECT "
    + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in NUMERIC)
    + f" FROM lineitem) SELECT {', '.join(ITEM_KEY)}, "
    + "round("
    + " + ".join(f"{i + 1} * ({c} - m_{c}) / s_{c}" for i, c in enumerate(NUMERIC))
    + " + 5 * (l_returnflag = 'A')::INT + 6 * (l_returnflag = 'N')::INT + 7 * (l_returnflag = 'R')::INT, 5)"
    + " + 0::DOUBLE AS checksum FROM lineitem, s"
)
def stream_features(spark, sf_dir):
    """Transforms fitted on the table, applied to its rows as a stream."""
    items = table(spark, sf_dir, "lineitem")
    params, vocab = encode.fit_scaler(items, NUMERIC), encode.fit_onehot(items, ["l_returnflag"])
    stream = balance.apply_features(file_stream(spark, sf_dir, "lineitem"), params, vocab)
    path, checkpoint = fresh_path(spark, "features"), fresh_path(spark, "features-state")
    balance.write_rows(stream.select(*ITEM_KEY, "features"), path, checkpoint).awaitTermination()
    back = spark.read.parquet(path)
    weighted = F.transform("features", lambda v, i: (i + 1) * v)
    total = F.aggregate(weighted, F.lit(0.0), lambda s, v: s + v)
    return back.select(*ITEM_KEY, F.round(total, 5).alias("checksum"))
