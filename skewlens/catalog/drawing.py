"""Sampling queries: splits, batches, label draws, resampling."""

from pyspark.sql import functions as F

from skewlens.catalog.encoding import ITEM_KEY
from skewlens.catalog.registry import query, sql_split, sql_uniform, table
from skewlens.operators import profile, sampling
from skewlens.operators.ordering import first_batches, hash_ordinals, minibatches

ITEM_KEY_SQL = " || ':' || ".join(ITEM_KEY)


def doc_classes(spark, sf_dir):
    return table(spark, sf_dir, "labels").select(
        "doc_id", (F.col("quality") * 2 + F.col("toxic")).alias("class")
    )


@query(f"WITH {sql_split('labels', 'doc_id', 'quality * 2 + toxic', 'doc_id')} SELECT doc_id, label AS class, split FROM assigned")
def stratified_split(spark, sf_dir):
    return sampling.stratified_split(doc_classes(spark, sf_dir), ["doc_id"], "class")


@query(f"WITH {sql_split('labels', 'doc_id', 'quality * 2 + toxic', 'doc_id')} SELECT label AS class, n, quota FROM quo")
def split_quotas(spark, sf_dir):
    counts = doc_classes(spark, sf_dir).groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    return sampling.split_quotas(counts, "class")


@query(f"""
    WITH {sql_split('lineitem', ITEM_KEY_SQL, 'l_returnflag', 'l_orderkey')}
    SELECT label AS l_returnflag, split, count(*) AS n, sum(l_orderkey)::BIGINT AS key_sum FROM assigned GROUP BY 1, 2
""")
def stratified_split_large(spark, sf_dir):
    """The split of the largest table, stated per class and split."""
    items = table(spark, sf_dir, "lineitem").select(*ITEM_KEY, "l_returnflag")
    return (
        sampling.stratified_split(items, ITEM_KEY, "l_returnflag")
        .groupBy("l_returnflag", "split")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("key_sum"))
    )


@query("SELECT event_id, row_number() OVER (ORDER BY md5('42:order:' || event_id)) - 1 AS pos FROM events")
def shuffled_order(spark, sf_dir):
    return hash_ordinals(table(spark, sf_dir, "events").select("event_id"), ["event_id"])


@query(f"""
    WITH o AS (SELECT l_orderkey, row_number() OVER (ORDER BY md5('42:epoch0:' || {ITEM_KEY_SQL})) - 1 AS p FROM lineitem)
    SELECT p // 256 AS batch_id, count(*) AS n, sum(l_orderkey)::BIGINT AS key_sum FROM o GROUP BY 1
""")
def minibatch_sizes(spark, sf_dir):
    """Batches of 256 of one shuffled pass; the last is short."""
    items = table(spark, sf_dir, "lineitem").select(*ITEM_KEY)
    return (
        minibatches(items, ITEM_KEY)
        .groupBy("batch_id")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("key_sum"))
    )


@query(f"""
    WITH o AS (SELECT l_returnflag, row_number() OVER (ORDER BY md5('42:epoch0:' || {ITEM_KEY_SQL})) - 1 AS p FROM lineitem)
    SELECT l_returnflag, count(*) AS n, round(count(*) * 100::DOUBLE / sum(count(*)) OVER (), 6) AS pct
    FROM o WHERE p < 101 * 256 GROUP BY 1
""")
def natural_batches(spark, sf_dir):
    """Class shares met in the first batches of a shuffled pass (stop index 100, so 101
    batches)."""
    items = table(spark, sf_dir, "lineitem").select(*ITEM_KEY, "l_returnflag")
    return profile.class_distribution(first_batches(items, ITEM_KEY), "l_returnflag", digits=6)


@query(f"""
    SELECT floor({sql_uniform('label', 'o_orderkey')} * 5)::INT AS label_idx, count(*) AS n,
           sum(o_orderkey)::BIGINT AS key_sum FROM orders GROUP BY 1
""")
def uniform_labels(spark, sf_dir):
    drawn = sampling.uniform_labels(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], 5)
    return drawn.groupBy("label_idx").agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("key_sum")
    )


@query(f"""
    WITH d AS (SELECT unnest(range(5)) AS k),
    c AS (SELECT floor({sql_uniform('label', 'o_orderkey')} * 5)::INT AS k, count(*) AS n FROM orders GROUP BY 1),
    a AS (SELECT d.k, coalesce(n, 0) AS n FROM d LEFT JOIN c USING (k)),
    e AS (SELECT *, sum(n) OVER () / 5::DOUBLE AS e FROM a)
    SELECT count(*) AS n_classes, sum(n)::BIGINT AS n_rows, max(e) AS expected,
           round(sum((n - e) * (n - e) / e), 6) AS chi_square, count(*) - 1 AS dof,
           sum((n - e) * (n - e) / e) < 10 AS is_uniform FROM e
""")
def chi_square_balance(spark, sf_dir):
    drawn = sampling.uniform_labels(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], 5)
    classes = spark.range(5).select(F.col("id").cast("int").alias("label_idx"))
    counts = profile.class_counts(drawn, "label_idx", classes)
    return sampling.chi_square_uniform(counts).withColumn("chi_square", F.round("chi_square", 6))


@query(f"""
    WITH r AS (SELECT doc_id, quality * 2 + toxic AS class,
               row_number() OVER (PARTITION BY quality * 2 + toxic ORDER BY md5('42:resample:' || doc_id)) - 1 AS p FROM labels),
    c AS (SELECT class, count(*) AS n, row_number() OVER (ORDER BY class) AS k FROM r GROUP BY class),
    d AS (SELECT unnest(range((SELECT count(*) FROM labels))) AS draw_id),
    u AS (SELECT draw_id, least(floor({sql_uniform('class', 'draw_id')} * (SELECT count(*) FROM c)) + 1,
                 (SELECT count(*) FROM c)) AS k, {sql_uniform('row', 'draw_id')} AS u FROM d)
    SELECT u.draw_id, c.class, r.doc_id FROM u JOIN c ON u.k = c.k
    JOIN r ON r.class = c.class AND r.p = floor(u.u * c.n)
""")
def weighted_resample(spark, sf_dir):
    """As many draws as rows, weight one over the class size."""
    rows = doc_classes(spark, sf_dir)
    return sampling.weighted_resample(rows, ["doc_id"], "class", rows.count())
