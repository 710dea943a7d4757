"""Metric queries: confusion, reports, verdicts, comparisons, result records."""

from pyspark.sql import functions as F

from skewlens.catalog.registry import query, table
from skewlens.functions.verdicts import percent
from skewlens.operators import metrics
from skewlens.session import fresh_path
from skewlens.sources import results

# Orders classed by status (F, O, P -> 0, 1, 2) against two rules; class 3 has no rows.
CLASSES = [0, 1, 2, 3]
PRED_SQL = """
    t AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS tr, o_totalprice AS p,
                 o_orderpriority AS pr FROM orders),
    pred AS (SELECT 'price' AS model, o_orderkey, tr AS "true",
                    CASE WHEN p < 100000 THEN 0 WHEN p < 200000 THEN 1 WHEN p < 400000 THEN 2 ELSE 3 END AS pred FROM t
             UNION ALL
             SELECT 'priority', o_orderkey, tr,
                    CASE WHEN pr IN ('1-URGENT', '2-HIGH') THEN 0 WHEN pr = '3-MEDIUM' THEN 1 ELSE tr END FROM t),
    k AS (SELECT unnest(range(4))::INT AS c),
    cells AS (SELECT m.model, a.c AS "true", b.c AS pred, coalesce(n, 0) AS n
              FROM (SELECT DISTINCT model FROM pred) m, k a, k b
              LEFT JOIN (SELECT model AS gm, "true" AS gt, pred AS gp, count(*) AS n FROM pred GROUP BY 1, 2, 3) g
              ON g.gm = m.model AND g.gt = a.c AND g.gp = b.c),
    per AS (SELECT model, "true", sum(n)::BIGINT AS support,
                   sum(CASE WHEN "true" = pred THEN n ELSE 0 END)::BIGINT AS correct,
                   coalesce(sum(CASE WHEN "true" = pred THEN n ELSE 0 END) / nullif(sum(n), 0)::DOUBLE, 0) AS accuracy
            FROM cells GROUP BY 1, 2)
"""


def predictions(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    status, price, priority = F.col("o_orderstatus"), F.col("o_totalprice"), F.col("o_orderpriority")
    true = F.when(status == "F", 0).when(status == "O", 1).otherwise(2)
    by_price = F.when(price < 100000, 0).when(price < 200000, 1).when(price < 400000, 2).otherwise(3)
    by_priority = F.when(priority.isin("1-URGENT", "2-HIGH"), 0).when(priority == "3-MEDIUM", 1).otherwise(true)
    both = F.array(
        F.struct(F.lit("price").alias("model"), by_price.alias("pred")),
        F.struct(F.lit("priority").alias("model"), by_priority.alias("pred")),
    )
    return orders.select("o_orderkey", true.alias("true"), F.explode(both).alias("x")).select(
        "o_orderkey", "true", "x.model", "x.pred"
    )


def cells(spark, sf_dir):
    return metrics.confusion(predictions(spark, sf_dir), CLASSES, by=["model"])


def scores(spark, sf_dir):
    return metrics.per_class(cells(spark, sf_dir), ["model"])


@query(f'WITH {PRED_SQL} SELECT model, "true", pred, n FROM cells')
def confusion_cells(spark, sf_dir):
    return cells(spark, sf_dir)


@query(f"""
    WITH {PRED_SQL} SELECT model, "true", {', '.join(f"sum(CASE WHEN pred = {c} THEN n END)::BIGINT AS p{c}" for c in CLASSES)}
    FROM cells GROUP BY 1, 2
""")
def confusion_matrix(spark, sf_dir):
    wide = metrics.confusion_matrix(cells(spark, sf_dir), CLASSES, ["model"])
    return wide.select("model", "true", *[F.col(str(c)).alias(f"p{c}") for c in CLASSES])


@query(f'WITH {PRED_SQL} SELECT model, "true", support, correct, round(accuracy, 6) AS accuracy, round(accuracy * 100, 3) AS pct FROM per')
def per_class_accuracy(spark, sf_dir):
    out = scores(spark, sf_dir)
    return out.withColumn("pct", percent("accuracy", 3)).withColumn("accuracy", F.round("accuracy", 6))


@query(f"""
    WITH {PRED_SQL} SELECT model, round(avg(accuracy), 6) AS macro, round(sum(correct) / sum(support)::DOUBLE, 6) AS overall,
    sum(support)::BIGINT AS n_rows FROM per GROUP BY 1
""")
def macro_and_overall(spark, sf_dir):
    out = metrics.macro(scores(spark, sf_dir), ["model"])
    return out.withColumn("macro", F.round("macro", 6)).withColumn("overall", F.round("overall", 6))


@query(f"""
    WITH {PRED_SQL},
    r AS (SELECT model, "true" AS c, sum(n) AS t FROM cells GROUP BY 1, 2),
    q AS (SELECT model, pred AS c, sum(n) AS p, sum(CASE WHEN pred = "true" THEN n ELSE 0 END) AS tp FROM cells GROUP BY 1, 2),
    s AS (SELECT model, c, t, coalesce(tp / nullif(p, 0)::DOUBLE, 0) AS pre, coalesce(tp / nullif(t, 0)::DOUBLE, 0) AS rec,
                 coalesce(2 * tp / nullif(t + p, 0)::DOUBLE, 0) AS f1, tp FROM r JOIN q USING (model, c)),
    o AS (SELECT model, c::VARCHAR AS label, pre, rec, f1, t FROM s
          UNION ALL SELECT model, 'accuracy', NULL, NULL, sum(tp) / sum(t)::DOUBLE, sum(t) FROM s GROUP BY 1
          UNION ALL SELECT model, 'macro avg', avg(pre), avg(rec), avg(f1), sum(t) FROM s GROUP BY 1
          UNION ALL SELECT model, 'weighted avg', sum(pre * t) / sum(t), sum(rec * t) / sum(t), sum(f1 * t) / sum(t), sum(t)
          FROM s GROUP BY 1)
    SELECT model, label, round(pre, 6) AS precision, round(rec, 6) AS recall, round(f1, 6) AS f1, t::BIGINT AS support FROM o
""")
def classification_report(spark, sf_dir):
    out = metrics.report(cells(spark, sf_dir), ["model"])
    for c in ("precision", "recall", "f1"):
        out = out.withColumn(c, F.round(c, 6))
    return out


@query(f"""
    WITH {PRED_SQL}, r AS (SELECT model, "true" AS label, sum(n) AS a FROM cells GROUP BY 1, 2),
    q AS (SELECT model, pred AS label, sum(n) AS b FROM cells GROUP BY 1, 2)
    SELECT model, label, a::BIGINT AS n_true, b::BIGINT AS n_pred FROM r JOIN q USING (model, label)
""")
def true_and_predicted_counts(spark, sf_dir):
    return metrics.marginals(cells(spark, sf_dir), ["model"])


@query(f"""
    WITH {PRED_SQL} SELECT model, "true", round(accuracy, 6) AS accuracy,
    CASE WHEN accuracy >= 0.8 THEN 'PASS' ELSE 'FAIL' END AS verdict,
    round(CASE WHEN accuracy < 0.8 THEN 0.8::DOUBLE - accuracy END, 6) AS gap FROM per
""")
def verdicts(spark, sf_dir):
    judged = metrics.with_verdict(scores(spark, sf_dir), "accuracy")
    return judged.select(
        "model", "true", F.round("accuracy", 6).alias("accuracy"), "verdict", F.round("gap", 6).alias("gap")
    )


@query(f"""
    WITH {PRED_SQL} SELECT a."true", round(a.accuracy, 6) AS accuracy_a, round(b.accuracy, 6) AS accuracy_b,
    round(b.accuracy - a.accuracy, 6) + 0::DOUBLE AS delta
    FROM per a JOIN per b ON a."true" = b."true" AND a.model = 'price' AND b.model = 'priority'
""")
def model_comparison(spark, sf_dir):
    out = metrics.compare_models(scores(spark, sf_dir), "model", "price", "priority")
    for c in ("accuracy_a", "accuracy_b", "delta"):
        out = out.withColumn(c, F.round(c, 6))
    return out


COUNTS_SQL = 'cnt AS (SELECT CASE o_orderstatus WHEN \'F\' THEN 0 WHEN \'O\' THEN 1 ELSE 2 END AS "true", count(*) AS n FROM orders GROUP BY 1)'


def class_sizes(spark, sf_dir):
    return predictions(spark, sf_dir).where("model = 'price'").groupBy("true").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
    WITH {PRED_SQL}, {COUNTS_SQL}
    SELECT p.model, "true", n AS n_train, round(accuracy, 6) AS accuracy FROM per p JOIN cnt USING ("true")
    WHERE n < (SELECT max(n) FROM cnt)
""")
def critical_classes(spark, sf_dir):
    """Accuracy of the classes smaller than the largest one."""
    sizes = class_sizes(spark, sf_dir)
    largest = sizes.agg(F.max("n")).head()[0] or 0
    out = metrics.critical_classes(scores(spark, sf_dir), sizes, largest)
    return out.select("model", "true", "n_train", F.round("accuracy", 6).alias("accuracy"))


@query(f"""
    WITH {PRED_SQL}, {COUNTS_SQL}, j AS (SELECT accuracy, n, (SELECT max(n) FROM cnt) AS cut FROM per JOIN cnt USING ("true"))
    SELECT CASE WHEN n >= cut THEN 'at_or_above' ELSE 'below' END AS size, count(*) AS n_classes,
           round(min(accuracy), 6) AS min_accuracy, round(max(accuracy), 6) AS max_accuracy, round(avg(accuracy), 6) AS avg_accuracy
    FROM j GROUP BY 1
""")
def size_versus_accuracy(spark, sf_dir):
    sizes = class_sizes(spark, sf_dir)
    largest = sizes.agg(F.max("n")).head()[0] or 0
    out = metrics.size_versus_accuracy(scores(spark, sf_dir), sizes, largest)
    for c in ("min_accuracy", "max_accuracy", "avg_accuracy"):
        out = out.withColumn(c, F.round(c, 6))
    return out


@query(f"""
    WITH {PRED_SQL}, h AS (SELECT model, avg(("true" = pred)::INT) AS a FROM pred GROUP BY 1)
    SELECT round(max(CASE WHEN model = 'price' THEN a END), 6) AS acc_real,
           round(max(CASE WHEN model = 'priority' THEN a END), 6) AS acc_generated,
           round(max(CASE WHEN model = 'price' THEN a END) - max(CASE WHEN model = 'priority' THEN a END), 6) AS difference FROM h
""")
def real_versus_generated(spark, sf_dir):
    tagged = predictions(spark, sf_dir).withColumn(
        "source", F.when(F.col("model") == "price", "real").otherwise("generated")
    )
    out = metrics.real_versus_generated(tagged)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query(f"""
    WITH {PRED_SQL}, a AS (SELECT model, avg(accuracy) AS macro, string_agg(round(accuracy, 4)::VARCHAR, ',' ORDER BY "true") AS acc
                           FROM per GROUP BY 1),
    m AS (SELECT model, string_agg(n::VARCHAR, ',' ORDER BY "true", pred) AS mat FROM cells GROUP BY 1)
    SELECT model, 'test' AS fit_on, round(macro, 6) AS macro_avg, acc AS per_class_acc, '0,1,2,3' AS class_names, mat AS confusion_matrix
    FROM a JOIN m USING (model)
""")
def evaluation_records(spark, sf_dir):
    """Evaluation tables appended, one model a second time, and read back as one nested
    record for each model."""
    path = fresh_path(spark, "eval")
    every = cells(spark, sf_dir)
    for mine in (every, every.where(F.col("model") == "price")):
        classes = metrics.per_class(mine, ["model"])
        results.write_eval(path, "test", metrics.macro(classes, ["model"]), classes, mine)
    record = results.eval_record(
        results.read_eval(spark, path, "per_class"), results.read_eval(spark, path, "confusion"), ["model", "fit_on"]
    )
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return record.select(
        "model",
        "fit_on",
        F.round("macro_avg", 6).alias("macro_avg"),
        text(F.transform("per_class_acc", lambda x: F.round(x, 4))).alias("per_class_acc"),
        text("class_names").alias("class_names"),
        text(F.flatten("confusion_matrix")).alias("confusion_matrix"),
    )
