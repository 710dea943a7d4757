"""Training-history and loss queries; events stand in for a step log."""

from pyspark.sql import functions as F

from skewlens.catalog.neighbors import vectors
from skewlens.catalog.registry import query, table
from skewlens.functions.vectors import sigmoid
from skewlens.operators import history
from skewlens.session import fresh_path
from skewlens.sources import results

LOG_SQL = """
    log AS (SELECT 'run' || (user_id % 4) AS run_id, event_type AS metric,
                   date_diff('day', TIMESTAMP '2024-01-01', ts)::INT AS epoch, hour(ts)::INT AS step, value,
                   1 + user_id % 7 AS n_rows FROM events),
    ep AS (SELECT run_id, metric, epoch, avg(value) AS loss FROM log GROUP BY 1, 2, 3)
"""


def step_log(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.select(
        F.concat(F.lit("run"), F.col("user_id") % 4).alias("run_id"),
        F.col("event_type").alias("metric"),
        F.date_diff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).alias("epoch"),
        F.hour("ts").alias("step"),
        "value",
        (1 + F.col("user_id") % 7).alias("n_rows"),
    )


def _rounded(df):
    # Means of two-decimal values often end exactly on a five at six digits, where the two
    # engines round differently; eight digits keep clear of that.
    return df.withColumn("loss", F.round("loss", 8))


@query(f"WITH {LOG_SQL} SELECT run_id, metric, epoch, round(loss, 8) AS loss FROM ep")
def epoch_losses(spark, sf_dir):
    return _rounded(history.epoch_means(step_log(spark, sf_dir)))


@query(f"WITH {LOG_SQL} SELECT run_id, metric, epoch, round(sum(value) / sum(n_rows), 8) AS loss FROM log GROUP BY 1, 2, 3")
def epoch_losses_per_row(spark, sf_dir):
    return _rounded(history.epoch_means(step_log(spark, sf_dir), per="row"))


@query(f"""
    WITH {LOG_SQL}, s AS (SELECT run_id, metric, epoch, step, avg(value) AS v FROM log GROUP BY 1, 2, 3, 4)
    SELECT run_id, metric, epoch, round(avg(v), 8) AS loss FROM s GROUP BY 1, 2, 3
""")
def epoch_losses_inner(spark, sf_dir):
    return _rounded(history.epoch_means_inner(step_log(spark, sf_dir)))


@query(f"WITH {LOG_SQL} SELECT run_id, metric, max(epoch) AS epoch, round(arg_max(loss, epoch), 8) AS loss FROM ep GROUP BY 1, 2")
def final_losses(spark, sf_dir):
    return _rounded(history.final_values(history.epoch_means(step_log(spark, sf_dir))))


@query(f"WITH {LOG_SQL} SELECT run_id, metric, epoch, round(loss, 8) AS loss FROM ep WHERE (epoch + 1) % 10 = 0")
def report_epochs(spark, sf_dir):
    return _rounded(history.report_epochs(history.epoch_means(step_log(spark, sf_dir))))


@query(f"""
    WITH {LOG_SQL}, d AS (SELECT run_id, epoch, max(CASE WHEN metric = 'view' THEN loss END) AS v,
                          count(DISTINCT metric) AS k FROM ep GROUP BY 1, 2),
    l AS (SELECT run_id, max(epoch) AS epoch FROM d GROUP BY 1)
    SELECT l.run_id, 'log' AS kind, l.epoch, d.k::VARCHAR AS n_metrics, round(v, 6) AS view_loss
    FROM l JOIN d ON l.run_id = d.run_id AND l.epoch = d.epoch
""")
def run_registry(spark, sf_dir):
    """Per-epoch states of every run appended to the registry in two writes; the latest
    state of each run is read back."""
    epochs = history.epoch_means(step_log(spark, sf_dir))
    states = epochs.groupBy("run_id", "epoch").agg(
        F.map_from_entries(F.collect_list(F.struct("metric", "loss"))).alias("losses")
    )
    runs = states.select(
        "run_id",
        F.lit("log").alias("kind"),
        "epoch",
        F.create_map(F.lit("n_metrics"), F.size("losses").cast("string")).alias("params"),
        "losses",
    )
    path = fresh_path(spark, "runs")
    results.append_runs(runs.where("epoch < 15"), path)
    results.append_runs(runs.where("epoch >= 15"), path)
    latest = results.latest_runs(spark.read.parquet(path))
    return latest.select(
        "run_id",
        "kind",
        "epoch",
        F.col("params")["n_metrics"].alias("n_metrics"),
        F.round(F.try_element_at("losses", F.lit("view")), 6).alias("view_loss"),
    )


@query("""
    WITH e AS (SELECT embedding[1:32]::DOUBLE[] AS a, embedding[33:64]::DOUBLE[] AS b FROM embeddings),
    t AS (SELECT list_sum(list_transform(range(32), lambda i: (a[i + 1] - b[i + 1]) * (a[i + 1] - b[i + 1]))) AS r,
                 -0.5::DOUBLE * list_sum(list_transform(range(32), lambda i: 1 + b[i + 1] - a[i + 1] * a[i + 1] - exp(b[i + 1]))) AS k
          FROM e)
    SELECT count(*) AS n_rows, round(sum(r), 4) AS recon_loss, round(sum(k), 4) AS kl_loss,
           round(sum(r) + 4 * sum(k), 4) AS total_loss FROM t
""")
def elbo_terms(spark, sf_dir):
    """The halves of each vector as data / reconstruction and as mu / log-variance."""
    rows = vectors(spark, sf_dir).select(
        F.slice("features", 1, 32).alias("a"), F.slice("features", 33, 32).alias("b")
    )
    out = history.elbo(rows, "a", "b", "a", "b", beta=4.0)
    return out.select("n_rows", *[F.round(c, 4).alias(c) for c in ("recon_loss", "kl_loss", "total_loss")])


@query("""
    WITH p AS (SELECT 1 / (1 + exp(-embedding[1]::DOUBLE)) AS p, (label >= 5)::INT AS t FROM embeddings)
    SELECT round(avg(-(t * greatest(ln(p), -100) + (1 - t) * greatest(ln(1 - p), -100))), 6) AS bce FROM p
""")
def binary_cross_entropy(spark, sf_dir):
    rows = vectors(spark, sf_dir).select(
        sigmoid(F.col("features")[0]).alias("p"), (F.col("label") >= 5).cast("int").alias("t")
    )
    return history.bce(rows, "p", "t").select(F.round("bce", 6).alias("bce"))


@query("""
    WITH e AS (SELECT label, embedding[1:32]::DOUBLE[] AS a, embedding[33:64]::DOUBLE[] AS b, embedding[1:10]::DOUBLE[] AS g FROM embeddings),
    t AS (SELECT list_sum(list_transform(range(32), lambda i: (a[i + 1] - b[i + 1]) * (a[i + 1] - b[i + 1]))) / 32 AS m,
                 ln(list_sum(list_transform(g, lambda x: exp(x - list_max(g))))) + list_max(g) - g[label + 1] AS c FROM e)
    SELECT round(avg(m), 6) AS recon_loss, round(avg(c), 6) AS class_loss, round(avg(m) + 0.1::DOUBLE * avg(c), 6) AS total_loss FROM t
""")
def reconstruction_and_class_loss(spark, sf_dir):
    rows = vectors(spark, sf_dir).select(
        "label",
        F.slice("features", 1, 32).alias("a"),
        F.slice("features", 33, 32).alias("b"),
        F.slice("features", 1, 10).alias("g"),
    )
    out = history.reconstruction_and_class_loss(rows, "a", "b", "g", "label")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])
