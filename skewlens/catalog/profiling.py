"""Profiling queries: distributions, missing cells, summaries, histograms."""

from pyspark.sql import functions as F

from skewlens.catalog.registry import query, table
from skewlens.functions.vectors import as_doubles
from skewlens.operators import encode, profile
from skewlens.session import local_table

EVENT_CATEGORY = {"view": "browse", "click": "browse", "signup": "convert", "purchase": "convert"}
CATEGORY_SQL = (
    "CASE event_type WHEN 'view' THEN 'browse' WHEN 'click' THEN 'browse' "
    "WHEN 'signup' THEN 'convert' WHEN 'purchase' THEN 'convert' END"
)


def event_dim(spark):
    return local_table(spark, list(EVENT_CATEGORY.items()), "event_type string, category string")


@query(f"""
    WITH c AS (SELECT {CATEGORY_SQL} AS category, count(*) AS n FROM events GROUP BY 1)
    SELECT category, n, round(n * 100::DOUBLE / sum(n) OVER (), 2) AS pct,
           round(max(n) OVER () / (min(n) OVER ())::DOUBLE, 6) AS imbalance_ratio
    FROM c WHERE category IS NOT NULL
""")
def class_distribution(spark, sf_dir):
    """Label -> category lookup, counts, percentages and imbalance ratio."""
    mapped = profile.map_category(table(spark, sf_dir, "events"), "event_type", event_dim(spark))
    ratio = profile.imbalance_ratio(mapped, "category").select(F.round("ratio", 6)).scalar()
    return profile.class_distribution(mapped, "category").withColumn("imbalance_ratio", ratio)


@query(f"SELECT event_id, {CATEGORY_SQL} AS category FROM events")
def mapped_category(spark, sf_dir):
    """The lookup row by row, from a map literal."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    return profile.map_category_literal(events, "event_type", EVENT_CATEGORY).select("event_id", "category")


@query("SELECT DISTINCT event_type FROM events WHERE event_type NOT IN ('view','click','signup','purchase')")
def unmapped_labels(spark, sf_dir):
    return profile.unmapped(table(spark, sf_dir, "events"), "event_type", event_dim(spark))


@query("""
    SELECT 'lineitem' AS table_name, count(*) AS n_rows, 11 AS n_cols FROM lineitem
    UNION ALL SELECT 'orders', count(*), 6 FROM orders
    UNION ALL SELECT 'documents', count(*), 5 FROM documents
    UNION ALL SELECT 'embeddings', count(*), 3 FROM embeddings
""")
def table_shape(spark, sf_dir):
    names = ["lineitem", "orders", "documents", "embeddings"]
    shapes = [profile.table_shape(table(spark, sf_dir, n), n) for n in names]
    out = shapes[0]
    for s in shapes[1:]:
        out = out.unionByName(s)
    return out


@query("""
    SELECT (sum((d.doc_id IS NULL)::INT + (text IS NULL)::INT + (lang IS NULL)::INT + (source IS NULL)::INT
           + (n_chars IS NULL)::INT + (quality IS NULL)::INT + (toxic IS NULL)::INT))::BIGINT AS n_missing
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
""")
def missing_total(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return profile.missing_total(joined)


@query("""
    SELECT 'l_quantity' AS feature, 0 AS position, 'numerical' AS role, count(DISTINCT l_quantity) AS n_unique FROM lineitem
    UNION ALL SELECT 'l_extendedprice', 1, 'numerical', count(DISTINCT l_extendedprice) FROM lineitem
    UNION ALL SELECT 'l_discount', 2, 'numerical', count(DISTINCT l_discount) FROM lineitem
    UNION ALL SELECT 'l_tax', 3, 'numerical', count(DISTINCT l_tax) FROM lineitem
    UNION ALL SELECT 'l_returnflag', 4, 'categorical', count(DISTINCT l_returnflag) FROM lineitem
    UNION ALL SELECT 'l_linestatus', 5, 'categorical', count(DISTINCT l_linestatus) FROM lineitem
""")
def feature_roles(spark, sf_dir):
    """Feature columns by role with their distinct counts."""
    items = table(spark, sf_dir, "lineitem")
    excluded = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate"]
    roles = profile.column_roles(items, ["l_returnflag", "l_linestatus"], excluded)
    cols = [c for c in items.columns if c not in excluded]
    return roles.join(profile.distinct_count(items, cols), "feature")


ODD_SQL = """
    v AS (SELECT CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'NaN'::DOUBLE WHEN 2 THEN -0.0::DOUBLE WHEN 3 THEN 0.0::DOUBLE
                 ELSE round(value::DOUBLE, 1) END AS x FROM events)
"""


def odd_values(spark, sf_dir):
    """A column with nulls, NaN and both zeros, from the values of the events."""
    kind = F.col("event_id") % 7
    x = F.when(kind == 1, F.lit(float("nan"))).when(kind == 2, F.lit(-0.0)).when(kind == 3, F.lit(0.0))
    x = F.when(kind != 0, x.otherwise(F.round(F.col("value").cast("double"), 1)))
    return table(spark, sf_dir, "events").select(x.alias("x"))


@query(f"""
    WITH {ODD_SQL}, p AS (SELECT x + 0::DOUBLE AS x FROM v WHERE x IS NOT NULL AND NOT isnan(x))
    SELECT 'distinct' AS what, count(DISTINCT x)::DOUBLE AS n FROM p UNION ALL SELECT 'missing', count(*) FILTER (WHERE x IS NULL OR isnan(x)) FROM v
    UNION ALL SELECT 'zeros', count(*) FILTER (WHERE x = 0) FROM p UNION ALL SELECT 'mean', round(avg(x), 6) FROM p
    UNION ALL SELECT 'scale', round(stddev_pop(x), 6) FROM p UNION ALL SELECT 'top', max(n) FROM (SELECT count(*) AS n FROM p GROUP BY x)
""")
def odd_value_profile(spark, sf_dir):
    """Null and NaN are no values, and the two zeros are one, in every operator."""
    rows = odd_values(spark, sf_dir)
    counts = profile.value_counts(rows, "x")
    scaler = encode.fit_scaler(rows, ["x"])
    as_row = lambda df, what, n: df.select(F.lit(what).alias("what"), n.cast("double").alias("n"))
    found = [
        as_row(profile.distinct_count(rows, ["x"]), "distinct", F.col("n_unique")),
        as_row(profile.missing_total(rows), "missing", F.col("n_missing")),
        as_row(counts.where("x = 0"), "zeros", F.col("n")),
        as_row(scaler, "mean", F.round("mean", 6)),
        as_row(scaler, "scale", F.round("scale", 6)),
        as_row(profile.top_values(rows, ["x"], 1), "top", F.col("n")),
    ]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


@query("SELECT p_brand, count(*) AS n FROM part WHERE p_brand IS NOT NULL GROUP BY p_brand")
def value_counts(spark, sf_dir):
    return profile.value_counts(table(spark, sf_dir, "part"), "p_brand")


@query(
    " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, {i} AS position, count({c}) AS n, round(avg({c}), 6) AS mean,
        round(stddev_samp({c}), 6) AS std, min({c}) AS min,
        round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50,
        round(quantile_cont({c}, 0.75), 6) AS p75, max({c}) AS max FROM lineitem"""
        for i, c in enumerate(["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    )
)
def describe_numeric(spark, sf_dir):
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    out = profile.describe(table(spark, sf_dir, "lineitem"), cols)
    for c in ("mean", "std", "p25", "p50", "p75"):
        out = out.withColumn(c, F.round(c, 6))
    return out


@query("""
    WITH f AS (SELECT 'p_brand' AS feature, p_brand AS value FROM part
               UNION ALL SELECT 'p_type', p_type FROM part
               UNION ALL SELECT 'p_size', p_size::VARCHAR FROM part),
    c AS (SELECT feature, value, count(*) AS n FROM f WHERE value IS NOT NULL GROUP BY 1, 2),
    r AS (SELECT feature, value, n, row_number() OVER (PARTITION BY feature ORDER BY n DESC, value)::INT AS rank,
                 count(*) OVER (PARTITION BY feature) AS n_unique FROM c)
    SELECT * FROM r WHERE rank <= 5
""")
def top5_per_feature(spark, sf_dir):
    return profile.top_values(table(spark, sf_dir, "part"), ["p_brand", "p_type", "p_size"], 5)


@query("""
    WITH c AS (SELECT o_orderpriority, count(*) FILTER (WHERE o_orderdate < TIMESTAMP '1999-01-01') AS n_train,
                      count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '1999-01-01') AS n_test
               FROM orders GROUP BY 1)
    SELECT o_orderpriority, n_train, n_test,
           round(n_train * 100::DOUBLE / sum(n_train) OVER (), 4) AS pct_train,
           round(n_test * 100::DOUBLE / sum(n_test) OVER (), 4) AS pct_test FROM c
""")
def train_test_distribution(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    cut = F.lit("1999-01-01").cast("timestamp_ntz")
    train, test = orders.where(F.col("o_orderdate") < cut), orders.where(F.col("o_orderdate") >= cut)
    return profile.compare_distributions(train, test, "o_orderpriority", digits=4)


@query("""
    WITH d AS (SELECT unnest(['click','error','purchase','refund','signup','view']) AS event_type),
    c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1)
    SELECT d.event_type, coalesce(n, 0) AS n,
           round(coalesce(n, 0) * 100::DOUBLE / sum(coalesce(n, 0)) OVER (), 6) AS pct
    FROM d LEFT JOIN c ON d.event_type = c.event_type
""")
def class_counts_dense(spark, sf_dir):
    """Counts per known class, among them one the data does not have."""
    names = ["click", "error", "purchase", "refund", "signup", "view"]
    dim = local_table(spark, [(n,) for n in names], "event_type string")
    out = profile.class_counts_percent(table(spark, sf_dir, "events"), "event_type", dim)
    return out.withColumn("pct", F.round("pct", 6))


@query("""
    WITH c AS (SELECT quality * 2 + toxic AS class, count(*) AS n FROM labels GROUP BY 1)
    SELECT max(n) AS n_max, min(n) AS n_min, round(max(n) / min(n)::DOUBLE, 6) AS ratio FROM c
""")
def imbalance_ratio(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").withColumn("class", F.col("quality") * 2 + F.col("toxic"))
    return profile.imbalance_ratio(rows, "class").withColumn("ratio", F.round("ratio", 6))


@query("""
    SELECT role, count(*) AS n, round(1::DOUBLE / count(*), 12) AS weight
    FROM conversations WHERE role IS NOT NULL GROUP BY role
""")
def inverse_class_weights(spark, sf_dir):
    weights = profile.inverse_weights(table(spark, sf_dir, "conversations"), "role")
    return weights.withColumn("weight", F.round("weight", 12))


@query("""
    WITH a AS (SELECT DISTINCT o_custkey::VARCHAR AS value FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'),
    b AS (SELECT DISTINCT o_custkey::VARCHAR AS value FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01')
    SELECT 'o_custkey' AS feature, value, 'train' AS seen_in FROM (SELECT value FROM a EXCEPT SELECT value FROM b)
    UNION ALL
    SELECT 'o_custkey', value, 'test' FROM (SELECT value FROM b EXCEPT SELECT value FROM a)
""")
def vocabulary_difference(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    return profile.vocabulary_difference(
        orders.where(F.col("o_orderdate") < cut), orders.where(F.col("o_orderdate") >= cut), ["o_custkey"]
    )


@query("""
    WITH l AS (SELECT label, unnest(embedding[1:5])::DOUBLE AS value, unnest(range(5))::INT AS feature FROM embeddings)
    SELECT label, feature, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std
    FROM l GROUP BY 1, 2
""")
def sample_stats(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("label", as_doubles("embedding").alias("v"))
    out = profile.class_stats(vectors, "label", "v", 5)
    return out.withColumn("mean", F.round("mean", 6)).withColumn("std", F.round("std", 6))


@query("""
    WITH l AS (SELECT label, unnest(embedding[1:5])::DOUBLE AS v, unnest(range(5))::INT AS feature FROM embeddings),
    m AS (SELECT label, feature, min(v) AS a, max(v) AS b FROM l GROUP BY 1, 2),
    r AS (SELECT label, feature, CASE WHEN a = b THEN a - 0.5 ELSE a END AS lo,
                 CASE WHEN a = b THEN b + 0.5 ELSE b END AS hi FROM m),
    g AS (SELECT l.*, lo, hi, (hi - lo) / 20 AS step,
                 least(floor((v - lo) / (hi - lo) * 20), 19)::INT AS g FROM l JOIN r USING (label, feature)),
    x AS (SELECT label, feature, CASE WHEN v < (CASE WHEN g = 20 THEN hi ELSE lo + g * step END) THEN g - 1
                 WHEN v >= (CASE WHEN g + 1 = 20 THEN hi ELSE lo + (g + 1) * step END) AND g < 19 THEN g + 1
                 ELSE g END AS bin FROM g),
    c AS (SELECT label, feature, bin, count(*) AS n FROM x GROUP BY 1, 2, 3),
    d AS (SELECT r.*, unnest(range(20))::INT AS bin FROM r)
    SELECT label, feature, bin, round(lo + bin * (hi - lo) / 20, 6) AS edge_lo,
           round(CASE WHEN bin = 19 THEN hi ELSE lo + (bin + 1) * (hi - lo) / 20 END, 6) AS edge_hi,
           coalesce(c.n, 0) AS n
    FROM d LEFT JOIN c USING (label, feature, bin)
""")
def sample_histogram(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("label", as_doubles("embedding").alias("v"))
    out = profile.histogram(vectors, "label", "v", 5)
    return out.withColumn("edge_lo", F.round("edge_lo", 6)).withColumn("edge_hi", F.round("edge_hi", 6))
