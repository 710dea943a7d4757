"""Encoding queries: label codes, one-hot, standardisation, vectors, bundles."""

from pyspark.sql import functions as F

from skewlens.catalog.registry import query, sql_split, table
from skewlens.functions.vectors import condition
from skewlens.operators import encode
from skewlens.operators.sampling import stratified_split
from skewlens.plans.prepare import prepare
from skewlens.session import fresh_path, local_table, stage
from skewlens.sources import bundle, records

ITEM_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("""
    SELECT p_partkey, p_type, (dense_rank() OVER (ORDER BY p_type) - 1)::INT AS label_idx, p_type AS decoded FROM part
""")
def label_encode(spark, sf_dir):
    """Sorted label codes and their way back."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    dim = encode.fit_labels(part, "p_type")
    coded = encode.apply_labels(part, dim, "p_type")
    names = dim.withColumnRenamed("p_type", "decoded")
    return encode.decode_labels(coded, names, "decoded").select("p_partkey", "p_type", "label_idx", "decoded")


@query("""
    SELECT o_orderkey, (dense_rank() OVER (ORDER BY o_custkey) - 1)::INT AS label_idx FROM orders
""")
def label_encode_many(spark, sf_dir):
    """Codes of a column with very many labels: sorted in ranges, never in one task."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return encode.apply_labels(orders, encode.fit_labels(orders, "o_custkey"), "o_custkey").select("o_orderkey", "label_idx")


@query("""
    WITH train AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01' AND o_orderpriority <> '5-LOW'),
    vocab AS (SELECT DISTINCT 0 AS f, o_orderpriority AS v FROM train
              UNION ALL SELECT DISTINCT 1, o_orderstatus FROM train)
    SELECT o_orderkey,
           string_agg(CASE WHEN (f = 0 AND v = o_orderpriority) OR (f = 1 AND v = o_orderstatus)
                      THEN '1' ELSE '0' END, '' ORDER BY f, v) AS code
    FROM orders, vocab GROUP BY o_orderkey
""")
def one_hot_train_vocab(spark, sf_dir):
    """Every order encoded with the vocabulary of the training orders, which lack one
    priority."""
    orders = table(spark, sf_dir, "orders")
    train = orders.where(
        (F.col("o_orderdate") < F.lit("2000-01-01").cast("timestamp_ntz")) & (F.col("o_orderpriority") != "5-LOW")
    )
    vocab = encode.fit_onehot(train, ["o_orderpriority", "o_orderstatus"])
    coded = encode.apply_onehot(orders, vocab)
    digits = F.transform("onehot", lambda x: x.cast("int").cast("string"))
    return coded.select("o_orderkey", F.array_join(digits, "").alias("code"))


@query(
    "WITH s AS (SELECT "
    + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in NUMERIC)
    + f" FROM lineitem) SELECT {', '.join(ITEM_KEY)}, "
    + ", ".join(f"round(({c} - m_{c}) / s_{c}, 6) + 0::DOUBLE AS z_{c}" for c in NUMERIC)
    + ", 0::DOUBLE AS z_constant FROM lineitem, s"
)
def standardize(spark, sf_dir):
    """Population-std scaling; a constant column is only centred."""
    items = table(spark, sf_dir, "lineitem").withColumn("constant", F.lit(5.0))
    params = encode.fit_scaler(items, NUMERIC + ["constant"])
    scaled = encode.apply_scaler(items.select(*ITEM_KEY, *NUMERIC, "constant"), params, "_z")
    return scaled.select(
        *ITEM_KEY, *[F.round(f"{c}_z", 6).alias(f"z_{c}") for c in NUMERIC + ["constant"]]
    )


@query(f"SELECT {', '.join(ITEM_KEY)}, {', '.join(f'round({c}, 4) AS {c}' for c in NUMERIC)} FROM lineitem")
def inverse_standardize(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    params = encode.fit_scaler(items, NUMERIC)
    scaled = encode.apply_scaler(items.select(*ITEM_KEY, *NUMERIC), params, "_z").drop(*NUMERIC)
    back = encode.invert_scaler(scaled, params, "_z")
    return back.select(*ITEM_KEY, *[F.round(c, 4).alias(c) for c in NUMERIC])


@query("""
    SELECT o_orderkey, round(o_totalprice, 4) AS o_totalprice FROM orders
""")
def stored_scaler(spark, sf_dir):
    """Scaler parameters written, read back and used to restore the original units."""
    orders = table(spark, sf_dir, "orders")
    params = encode.fit_scaler(orders, ["o_totalprice"])
    scaled = encode.apply_scaler(orders, params, "_z").select("o_orderkey", "o_totalprice_z")
    stored = stage(params, "scaler")
    back = encode.invert_scaler(scaled, stored, "_z")
    return back.select("o_orderkey", F.round("o_totalprice", 4).alias("o_totalprice"))


@query(
    "WITH s AS (SELECT "
    + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in NUMERIC)
    + " FROM lineitem), v AS (SELECT l.*, ["
    + ", ".join(f"({c} - m_{c}) / s_{c}" for c in NUMERIC)
    + """, (l_returnflag = 'A')::INT, (l_returnflag = 'N')::INT, (l_returnflag = 'R')::INT,
    (l_linestatus = 'F')::INT, (l_linestatus = 'O')::INT,
    (l_linestatus = 'F')::INT, (l_linestatus = 'O')::INT]::DOUBLE[] AS x FROM lineitem l, s)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, len(x) AS width,
           round(list_sum(list_transform(range(len(x)), lambda i: (i + 1) * x[i + 1])), 6) + 0::DOUBLE AS checksum
    FROM v"""
)
def feature_vector(spark, sf_dir):
    """Scaled numerics, one-hot block and the class one-hot in one array, stated by its
    width and a position-weighted sum."""
    items = table(spark, sf_dir, "lineitem")
    params = encode.fit_scaler(items, NUMERIC)
    vocab = encode.fit_onehot(items, ["l_returnflag", "l_linestatus"])
    dim = encode.fit_labels(items, "l_linestatus")
    coded = encode.apply_labels(items, dim, "l_linestatus")
    rows = encode.assemble(coded, params, vocab).withColumn("x", condition("features", "label_idx", 2))
    weighted = F.transform("x", lambda v, i: (i + 1) * v)
    total = F.aggregate(weighted, F.lit(0.0), lambda s, v: s + v)
    return rows.select(*ITEM_KEY, F.size("x").cast("long").alias("width"), F.round(total, 6).alias("checksum"))


@query("""
    WITH v AS (SELECT 0 AS f, 'l_returnflag_' || l_returnflag AS name FROM (SELECT DISTINCT l_returnflag FROM lineitem)
               UNION ALL SELECT 1, 'l_linestatus_' || l_linestatus FROM (SELECT DISTINCT l_linestatus FROM lineitem))
    SELECT 0 AS position, 'l_quantity' AS name UNION ALL SELECT 1, 'l_extendedprice'
    UNION ALL SELECT 2, 'l_discount' UNION ALL SELECT 3, 'l_tax'
    UNION ALL SELECT (3 + row_number() OVER (ORDER BY f, name))::INT, name FROM v
""")
def feature_names(spark, sf_dir):
    """Meaning of each vector position."""
    items = table(spark, sf_dir, "lineitem")
    return encode.feature_names(
        encode.fit_scaler(items, NUMERIC), encode.fit_onehot(items, ["l_returnflag", "l_linestatus"])
    )


@query("""
    SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS quantity,
           round(sum(l_extendedprice), 2) AS price FROM lineitem GROUP BY 1
""")
def csv_records(spark, sf_dir):
    """Headerless CSV written and read back with a declared schema."""
    items = table(spark, sf_dir, "lineitem").select(*ITEM_KEY, *NUMERIC, "l_returnflag", "l_linestatus")
    path = fresh_path(spark, "csv")
    records.write_records(items, path)
    back = records.read_records(spark, path, items.schema)
    return back.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum("l_quantity"), 2).alias("quantity"),
        F.round(F.sum("l_extendedprice"), 2).alias("price"),
    )


@query(f"""
    WITH {sql_split("orders", "o_orderkey", "o_orderstatus", "o_orderkey, o_totalprice")},
    s AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS d FROM orders)
    SELECT (dense_rank() OVER (ORDER BY label) - 1)::INT AS label_idx, split, count(*) AS n,
           round(avg((o_totalprice - m) / d), 6) + 0::DOUBLE AS mean_z, sum(o_orderkey)::BIGINT AS key_sum
    FROM assigned, s WHERE split = 'train' GROUP BY label, split
""")
def bundle_train_split(spark, sf_dir):
    """Preprocess, split, write the dataset bundle with its fitted tables, and read only
    the training partition back."""
    orders = table(spark, sf_dir, "orders")
    params = encode.fit_scaler(orders, ["o_totalprice"])
    vocab = encode.fit_onehot(orders, ["o_orderpriority"])
    dim = encode.fit_labels(orders, "o_orderstatus")
    rows = encode.assemble(encode.apply_labels(orders, dim, "o_orderstatus"), params, vocab)
    split = stratified_split(rows.select("o_orderkey", "features", "label_idx"), ["o_orderkey"], "label_idx")
    path = fresh_path(spark, "bundle")
    bundle.write_bundle(split, path, dim, {"scaler": params, "vocabulary": vocab})
    back = bundle.read_bundle(spark, path, ["train"])
    return back.groupBy("label_idx", "split").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(F.col("features")[0]), 6).alias("mean_z"),
        F.sum("o_orderkey").alias("key_sum"),
    )


STATUS = {"F": "finished", "O": "open", "P": "pending"}


@query(f"""
    WITH tr AS (SELECT *, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS idx FROM orders
                WHERE o_orderdate < TIMESTAMP '2000-01-01'),
    {sql_split("tr", "o_orderkey", "idx", "o_orderkey, o_totalprice, o_orderpriority")},
    every AS (SELECT label AS label_idx, split, o_totalprice, o_orderpriority FROM assigned
              UNION ALL SELECT CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, 'test', o_totalprice, o_orderpriority
              FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01'),
    s AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS d FROM tr)
    SELECT label_idx, split, count(*) AS n, round(avg((o_totalprice - m) / d), 6) + 0::DOUBLE AS mean_z,
           sum((o_orderpriority = '1-URGENT')::INT)::BIGINT AS urgent, 6 AS width
    FROM every, s GROUP BY 1, 2
""")
def prepared_orders(spark, sf_dir):
    """Raw orders to split feature vectors: status mapped to a category, later orders as
    the test table, everything fitted on the earlier ones."""
    orders = table(spark, sf_dir, "orders")
    cut = F.lit("2000-01-01").cast("timestamp_ntz")
    dim = local_table(spark, list(STATUS.items()), "o_orderstatus string, category string")
    ready = prepare(
        orders.where(F.col("o_orderdate") < cut),
        orders.where(F.col("o_orderdate") >= cut),
        dim,
        categorical=["o_orderpriority"],
        excluded=["o_orderstatus", "o_custkey", "o_orderdate"],
        key="o_orderkey",
        label="o_orderstatus",
    )
    return ready.rows.groupBy("label_idx", "split").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(F.col("features")[0]), 6).alias("mean_z"),
        F.sum(F.col("features")[1].cast("int")).alias("urgent"),
        F.max(F.size("features")).alias("width"),
    )
