"""Neighbour and augmentation queries over the vectors table."""

from pyspark.sql import functions as F

from skewlens.catalog.registry import query, sql_uniform, table
from skewlens.functions.vectors import as_doubles
from skewlens.operators import profile, smote
from skewlens.operators.neighbors import knn
from skewlens.session import fresh_path, stage
from skewlens.sources import bundle

KNN_SQL = """
    e AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
    p AS (SELECT a.label, a.vec_id, b.vec_id AS neighbor_id, list_distance(a.x, b.x) AS distance
          FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id),
    nn AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbor_id)::INT AS rank FROM p)
"""

KEY = "label || ':' || draw"

SMOTE_SQL = f"""
    {KNN_SQL},
    c AS (SELECT label, count(*) AS n FROM e GROUP BY label),
    t AS (SELECT label, n, 2 * (SELECT max(n) FROM c) AS target FROM c),
    o AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY md5('42:smote:' || vec_id)) - 1 AS p FROM e),
    d AS (SELECT label, n, unnest(range(target - n)) AS draw FROM t),
    u AS (SELECT label, draw, floor({sql_uniform('base', KEY)} * n)::BIGINT AS at_row,
                 floor({sql_uniform('neighbor', KEY)} * 5)::INT + 1 AS rank,
                 {sql_uniform('lambda', KEY)} AS lam FROM d),
    s AS (SELECT u.label, u.draw, o.vec_id AS base_id, nn.neighbor_id, u.lam, b.x AS bx, n.x AS nx
          FROM u JOIN o ON o.label = u.label AND o.p = u.at_row
          JOIN nn ON nn.vec_id = o.vec_id AND nn.rank = u.rank
          JOIN e b ON b.vec_id = o.vec_id JOIN e n ON n.vec_id = nn.neighbor_id)
"""


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", as_doubles("embedding").alias("features")
    )


ITEM_ID = "((l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey) * 100000 + l_suppkey"
ITEM_KEYS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def exceeds_long(lines):
    """Whether an ``ITEM_ID``, or a step on the way to it, may be too large for a long."""
    exact = lambda bound: F.abs(bound.cast("decimal(20,0)"))
    largest = lines.agg(*(F.greatest(exact(F.min(c)), exact(F.max(c))).alias(c) for c in ITEM_KEYS))
    return bool(largest.select(F.expr(ITEM_ID) > 2**63 - 1).head()[0])


@query(f"""
    WITH e AS (SELECT {ITEM_ID} AS id, [min(l_quantity)::DOUBLE, min(l_extendedprice)::DOUBLE / 1000, min(l_discount)::DOUBLE * 100, min(l_tax)::DOUBLE * 100] AS x
               FROM lineitem GROUP BY 1),
    p AS (SELECT a.id, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.x, b.x)) AS rank, list_distance(a.x, b.x) AS distance
          FROM e a JOIN e b ON a.id <> b.id WHERE a.id % 100 = 0)
    SELECT id, rank::INT AS rank, round(distance, 6) AS distance FROM p WHERE rank <= 5
""")
def knn_large_class(spark, sf_dir):
    """Nearest neighbours in one class of all order lines, for every id divisible by 100:
    the class is large enough for cells and blocks. Ids beyond a long are decimals, and
    the search runs on row numbers."""
    low = lambda c: F.min(c).cast("double")
    lines = table(spark, sf_dir, "lineitem")
    wide = exceeds_long(lines)
    if wide:
        lines = lines.withColumn("l_orderkey", F.col("l_orderkey").cast("decimal(20,0)"))
    rows = lines.groupBy(F.expr(ITEM_ID).alias("id")).agg(
        F.array(low("l_quantity"), low("l_extendedprice") / 1000, low("l_discount") * 100, low("l_tax") * 100).alias("x")
    )
    if wide:
        rows = rows.where("id IS NOT NULL").withColumn("number", F.monotonically_increasing_id())
    rows = stage(rows.withColumn("class", F.lit(0)), "order-lines")
    asked = stage(rows.where("id % 100 = 0").drop("x"), "asked")
    near = knn(rows, "number" if wide else "id", "class", "x", k=5, queries=asked)
    if wide:
        near = near.join(asked.select("number", "id"), "number")
    return near.select("id", "rank", F.round("distance", 6).alias("distance"))


def doubled_targets(rows):
    """Every class is raised to twice the largest one."""
    counts = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    largest = counts.agg(F.max("n")).scalar()
    return counts.select("label", (2 * largest).alias("target"))


def checksum(vec):
    weighted = F.transform(vec, lambda v, i: (i + 1) * v)
    return F.round(F.aggregate(weighted, F.lit(0.0), lambda s, v: s + v), 5)


@query(f"WITH {KNN_SQL} SELECT label, vec_id, rank, neighbor_id, round(distance, 5) AS distance FROM nn WHERE rank <= 5")
def knn_within_class(spark, sf_dir):
    near = knn(vectors(spark, sf_dir), "vec_id", "label", "features", k=5)
    return near.withColumn("distance", F.round("distance", 5))


@query("""
    WITH n AS (SELECT count(*) AS rows, count(*) FILTER (WHERE vec_id % 100 = 0) AS asked FROM embeddings)
    SELECT asked AS n_queries, 5 * asked AS n_answers, true AS recall_holds, true AS distances_hold FROM n WHERE rows > 5
""")
def knn_approximate(spark, sf_dir):
    """Approximate neighbours in one class of all vectors, for every id divisible by 100
    against all rows: at least 0.9 of the exact answers are found, with exact distances."""
    rows = stage(vectors(spark, sf_dir).withColumn("class", F.lit(0)), "one-class")
    asked = rows.where("vec_id % 100 = 0")
    keys = ["vec_id", "neighbor_id"]
    exact = knn(rows, "vec_id", "class", "features", k=5, queries=asked).select(*keys, F.col("distance").alias("_exact"))
    found = knn(rows, "vec_id", "class", "features", k=5, queries=asked, recall=0.95, bucket_rows=64)
    both = found.select(*keys, "distance").join(exact, keys, "full")
    hit = F.col("distance").isNotNull() & F.col("_exact").isNotNull()
    return both.agg(
        F.count_distinct("vec_id").alias("n_queries"),
        F.count("distance").alias("n_answers"),
        (F.count_if(hit) >= 0.9 * F.count("_exact")).alias("recall_holds"),
        F.coalesce(F.bool_and(F.when(hit, F.abs(F.col("distance") - F.col("_exact")) < 1e-9)), F.lit(True)).alias("distances_hold"),
    )


@query(f"""
    WITH {SMOTE_SQL}
    SELECT label, draw, base_id, neighbor_id, round(lam, 8) AS lam,
           round(bx[1] + lam * (nx[1] - bx[1]), 5) + 0::DOUBLE AS first,
           round(list_sum(list_transform(range(64), lambda i: (i + 1) * (bx[i + 1] + lam * (nx[i + 1] - bx[i + 1])))), 5)
               + 0::DOUBLE AS checksum
    FROM s
""")
def smote_rows(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    new = smote.synthesize(rows, "vec_id", "label", "features", doubled_targets(rows))
    return new.select(
        "label",
        "draw",
        "base_id",
        "neighbor_id",
        F.round("lambda", 8).alias("lam"),
        F.round(F.col("features")[0], 5).alias("first"),
        checksum("features").alias("checksum"),
    )


@query("""
    WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label)
    SELECT label, n AS n_before, 2 * max(n) OVER () AS n_after, 2 * max(n) OVER () - n AS n_added,
           round(log10(n), 6) AS log10_before, round(log10(2 * max(n) OVER ()), 6) AS log10_after,
           2 * max(n) OVER () AS target FROM c
""")
def smote_summary(spark, sf_dir):
    """Class counts before and after, added rows, target, and log-scaled counts."""
    rows = vectors(spark, sf_dir)
    targets = doubled_targets(rows)
    after = smote.augment(rows, "vec_id", "label", "features", targets)
    out = profile.before_after(rows, after, "label", targets)
    return out.withColumn("log10_before", F.round("log10_before", 6)).withColumn(
        "log10_after", F.round("log10_after", 6)
    )


@query(f"""
    WITH {SMOTE_SQL}
    SELECT label, false AS is_synthetic, count(*) AS n, 0::BIGINT AS base_sum, 0::BIGINT AS neighbor_sum FROM e GROUP BY label
    UNION ALL SELECT label, true, count(*), sum(base_id)::BIGINT, sum(neighbor_id)::BIGINT FROM s GROUP BY label
""")
def augmented_bundle(spark, sf_dir):
    """The augmented training rows written with provenance and read back."""
    rows = vectors(spark, sf_dir)
    full = smote.augment(rows, "vec_id", "label", "features", doubled_targets(rows))
    path = fresh_path(spark, "augmented")
    classes = rows.select("label").distinct()
    bundle.write_bundle(full.withColumn("split", F.lit("train")), path, classes, augmentation="smote")
    back = bundle.read_bundle(spark, path, ["train"])
    return back.groupBy("label", "is_synthetic").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.coalesce("base_id", F.lit(0))).alias("base_sum"),
        F.sum(F.coalesce("neighbor_id", F.lit(0))).alias("neighbor_sum"),
    )
