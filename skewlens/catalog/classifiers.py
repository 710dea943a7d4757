"""Classifier-based evaluation queries. Fitted models have no SQL form; the queries state
what must hold of their results, and what is known of them where a rule made the data."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from skewlens.catalog.generation import GRID, class_grid, latent_rows
from skewlens.catalog.neighbors import vectors
from skewlens.catalog.registry import query, sql_normal, sql_split
from skewlens.functions.vectors import sigmoid
from skewlens.functions.verdicts import TARGET
from skewlens.operators import generate, metrics, scoring
from skewlens.operators.sampling import stratified_split
from skewlens.session import stage

CLASSES = list(range(10))

#: Rows whose class is decided by the signs of two elements, with room around zero: what
#: a fitted model makes of them is known. A model that guesses fails these queries.
ROOM = 0.05
QUADRANTS = list(range(4))


def ruled(rows, *keep):
    """``(keep..., features, quadrant)`` of the rows of ``(x, y)`` away from both axes."""
    x, y = F.col("x"), F.col("y")
    clear = (F.abs(x) > ROOM) & (F.abs(y) > ROOM)
    quadrant = F.when(x > 0, 1).otherwise(0) + F.when(y > 0, 2).otherwise(0)
    return rows.where(clear).select(*keep, F.array(x, y).alias("features"), quadrant.alias("quadrant"))


def ruled_real(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return ruled(rows.select("vec_id", F.col("features")[0].alias("x"), F.col("features")[1].alias("y")), "vec_id")


def ruled_noise(spark, sf_dir):
    z = generate.with_noise(class_grid(spark, sf_dir), 2, ["label", "sample_id"])
    return ruled(z.select(*[(0.2 * F.col("z")[j]).alias(n) for j, n in enumerate("xy")]))


def _signs(x, y):
    return f"(({x}) > 0)::INT + 2 * (({y}) > 0)::INT AS quadrant"


def _clear(x, y):
    return f"abs({x}) > {ROOM} AND abs({y}) > {ROOM}"


_X, _Y = "embedding[1]::DOUBLE", "embedding[2]::DOUBLE"
RULED_SQL = f"ruled AS (SELECT vec_id, {_signs(_X, _Y)} FROM embeddings WHERE {_clear(_X, _Y)})"
NOISE_SQL = f"""
    grid AS (SELECT label, unnest(range(count(*))) AS sample_id FROM embeddings GROUP BY label),
    noise AS (SELECT 0.2 * {sql_normal('noise', GRID + '0')} AS x, 0.2 * {sql_normal('noise', GRID + '1')} AS y FROM grid),
    ruled_noise AS (SELECT {_signs('x', 'y')} FROM noise WHERE {_clear('x', 'y')})
"""


def scored_rows(spark, sf_dir):
    """Real held-out rows and generated rows, scored by one forest fitted on the training
    split."""
    split = stage(stratified_split(vectors(spark, sf_dir), ["vec_id"], "label"), "split")
    train = split.where("split = 'train'")
    real = split.where("split = 'val'").select("label", "features", F.lit("real").alias("source"))
    drawn = latent_rows(spark, sf_dir).select("label", "features", F.lit("generated").alias("source"))
    return stage(scoring.forest_evaluate(train, real.unionByName(drawn), "label", "features", ["source"]), "forest")


def scored_ruled(spark, sf_dir):
    """The same over rows whose class follows from a rule."""
    split = stage(stratified_split(ruled_real(spark, sf_dir), ["vec_id"], "quadrant"), "ruled")
    real = split.where("split = 'val'").select("quadrant", "features", F.lit("ruled").alias("source"))
    drawn = ruled_noise(spark, sf_dir).withColumn("source", F.lit("ruled noise"))
    fit_rows = split.where("split = 'train'")
    return stage(scoring.forest_evaluate(fit_rows, real.unionByName(drawn), "quadrant", "features", ["source"]), "ruled-forest")


SPLIT_SQL = sql_split("embeddings", "vec_id", "label", "vec_id")
RULED_SPLIT_SQL = sql_split("ruled", "vec_id", "quadrant", "vec_id")
SIDES_SQL = f"""
    {SPLIT_SQL}, k AS (SELECT unnest(range(10))::INT AS "true"),
    v AS (SELECT label, count(*) AS n FROM assigned WHERE split = 'val' GROUP BY label),
    sides AS (SELECT 'real' AS source, "true", coalesce(n, 0) AS n FROM k LEFT JOIN v ON label = "true"
              UNION ALL SELECT 'generated', "true", coalesce(n, 0) FROM k
              LEFT JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY label) ON label = "true")
"""
RULED_SIDES_SQL = f"""
    {RULED_SQL}, {NOISE_SQL}, {RULED_SPLIT_SQL}, k AS (SELECT unnest(range(4))::INT AS "true"),
    sides AS (SELECT 'ruled' AS source, "true", count(label) AS n FROM k LEFT JOIN (SELECT * FROM assigned WHERE split = 'val') ON label = "true" GROUP BY 2
              UNION ALL SELECT 'ruled noise', "true", count(quadrant) FROM k LEFT JOIN ruled_noise ON quadrant = "true" GROUP BY 2)
"""


def judged_classes(scored, classes):
    """Per-class accuracy with verdict: every row is judged once, accuracies follow from the
    matrix, verdicts from the accuracies."""
    cells = stage(metrics.confusion(scored, classes, by=["source"]), "cells")
    judged = metrics.with_verdict(metrics.per_class(cells, ["source"]), "accuracy")
    matrix = cells.groupBy("source", "true").agg(
        F.sum("n").alias("matrix_rows"), F.sum(F.when(F.col("true") == F.col("pred"), F.col("n")).otherwise(0)).alias("hits")
    )
    share = F.coalesce(F.try_divide(F.col("hits").cast("double"), F.col("matrix_rows")), F.lit(0.0))
    holds = F.when(F.col("accuracy") >= TARGET, F.col("gap").isNull() & (F.col("verdict") == "PASS")).otherwise(
        (F.col("verdict") == "FAIL") & (F.abs(F.col("gap") + F.col("accuracy") - TARGET) < 1e-9)
    )
    return judged.join(matrix, ["source", "true"]).select(
        "source", "true", "support", "matrix_rows", (F.col("accuracy") == share).alias("accuracy_holds"),
        holds.alias("verdict_holds"), "accuracy",
    )


@query(f"""
    SELECT source, "true", n AS support, n AS matrix_rows, true AS accuracy_holds, true AS verdict_holds, NULL::DOUBLE AS known_accuracy
    FROM (WITH {SIDES_SQL} SELECT * FROM sides)
    UNION ALL SELECT source, "true", n, n, true, true, (n > 0)::INT::DOUBLE FROM (WITH {RULED_SIDES_SQL} SELECT * FROM sides)
""")
def forest_per_class(spark, sf_dir):
    """Per-class accuracy with verdict on held-out real rows and on generated rows, and the
    same where a rule decides the class: there the forest is right on every row."""
    given = judged_classes(scored_rows(spark, sf_dir), CLASSES)
    known = judged_classes(scored_ruled(spark, sf_dir), QUADRANTS).withColumnRenamed("accuracy", "known_accuracy")
    return given.withColumn("known_accuracy", F.lit(None).cast("double")).drop("accuracy").unionByName(known)


@query(f"""
    WITH g AS (WITH {SIDES_SQL} SELECT * FROM sides), r AS (WITH {RULED_SIDES_SQL} SELECT * FROM sides)
    SELECT sum(n) FILTER (WHERE source = 'real')::BIGINT AS n_real, sum(n) FILTER (WHERE source = 'generated')::BIGINT AS n_generated,
           true AS in_range, true AS difference_holds, 1::DOUBLE AS ruled_real, 1::DOUBLE AS ruled_generated, 0::DOUBLE AS ruled_difference FROM g
""")
def forest_real_versus_generated(spark, sf_dir):
    """Accuracy on real rows against accuracy on generated rows; and where a rule decides
    the class of both, so that both are one."""
    scored = scored_rows(spark, sf_dir)
    sizes = scored.agg(
        *[F.count_if(F.col("source") == side).alias(f"n_{side}") for side in ("real", "generated")]
    )
    both = metrics.real_versus_generated(scored).head()
    real, generated = both["acc_real"], both["acc_generated"]
    side = F.when(F.col("source") == "ruled", "real").otherwise("generated")
    known = metrics.real_versus_generated(scored_ruled(spark, sf_dir).withColumn("source", side)).head()
    return sizes.select(
        "*",
        F.lit(0 <= real <= 1 and 0 <= generated <= 1).alias("in_range"),
        F.lit(abs(real - generated - both["difference"]) < 1e-12).alias("difference_holds"),
        F.lit(known["acc_real"]).alias("ruled_real"),
        F.lit(known["acc_generated"]).alias("ruled_generated"),
        F.lit(known["difference"]).alias("ruled_difference"),
    )


def _coded(spark, sf_dir):
    return scoring.reconstruct(vectors(spark, sf_dir), "features", 8, ["vec_id", "label"])


@query("""
    WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(64))::INT AS i FROM embeddings),
    m AS (SELECT i, avg(x) AS mu FROM e GROUP BY 1)
    SELECT label, count(DISTINCT vec_id) AS n, 8 AS width, round(sum((x - mu) * (x - mu)), 4) AS spread, 0::DOUBLE AS plane_error
    FROM e JOIN m USING (i) GROUP BY label
""")
def reconstruct(spark, sf_dir):
    """Latent codes and squared reconstruction errors: what the code keeps of a row's
    distance from the mean, and what it loses, add up to the whole. Rows that lie in a
    plane lose nothing with two directions."""
    kept = F.aggregate(F.transform("latent", lambda z: z * z), F.lit(0.0), lambda s, z: s + z)
    given = _coded(spark, sf_dir).groupBy("label").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.size("latent")).alias("width"),
        F.round(F.sum(kept + F.col("sq_error")), 4).alias("spread"),
    )
    x, y = F.col("features")[0], F.col("features")[1]
    flat = vectors(spark, sf_dir).select("label", F.transform("features", lambda v, i: x * i + y * (64 - i)).alias("features"))
    lost = scoring.reconstruct(flat, "features", 2, ["label"]).groupBy("label").agg(F.round(F.sum("sq_error"), 6).alias("plane_error"))
    return given.join(lost, "label")


@query(f"""
    SELECT 'coded' AS source, split, label, count(*) AS n, true AS in_range, true AS total_holds, NULL::DOUBLE AS known_accuracy
    FROM (WITH {SPLIT_SQL} SELECT * FROM assigned) GROUP BY 2, 3
    UNION ALL SELECT 'ruled', split, label, count(*), true, true, 1::DOUBLE
    FROM (WITH {RULED_SQL}, half AS (SELECT vec_id, quadrant % 2 AS half FROM ruled), {sql_split("half", "vec_id", "half", "vec_id")} SELECT * FROM assigned) GROUP BY 2, 3
""")
def latent_separability(spark, sf_dir):
    """Class read off the latent code, fitted on the training rows and measured on both;
    and off a code whose first element decides the class, where it is always right."""
    total = F.col("recon_loss") + 0.1 * F.col("class_loss")

    def checked(found, source, accuracy):
        return found.select(
            F.lit(source).alias("source"),
            "split",
            F.col("label").cast("int").alias("label"),
            "n",
            (F.col("accuracy").between(0, 1) & (F.col("recon_loss") >= 0) & (F.col("class_loss") >= 0)).alias("in_range"),
            (F.abs(F.col("total_loss") - total) < 1e-9).alias("total_holds"),
            accuracy.cast("double").alias("known_accuracy"),
        )

    found = scoring.latent_separability(_coded(spark, sf_dir), ["vec_id"], "label", "features")
    rows = ruled_real(spark, sf_dir).select(
        "vec_id", (F.col("quadrant") % 2).alias("label"), "features", F.col("features").alias("latent"), F.col("features").alias("recon")
    )
    known = scoring.latent_separability(rows, ["vec_id"], "label", "features")
    return checked(found, "coded", F.lit(None)).unionByName(checked(known, "ruled", F.col("accuracy")))


TWO_SAMPLE_SQL = f"""
    src0 AS (SELECT label, '1:' || vec_id AS key, '1:' || label AS stratum FROM embeddings
             UNION ALL SELECT label, '0:' || label || ':' || unnest(range(n)), '0:' || label
             FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label)),
    {sql_split("src0", "key", "stratum", "key")}
"""


def shifted(rows):
    """Rows moved far away from where they were."""
    return rows.withColumn("features", F.transform("features", lambda x: x + 3.0))


@query(f"""
    WITH {TWO_SAMPLE_SQL}, c AS (SELECT split, split_part(label, ':', 2)::INT AS label, count(*) AS n FROM assigned GROUP BY 1, 2)
    SELECT 'generated' AS source, split, label, n, true AS in_range, NULL::DOUBLE AS known_auc, NULL::DOUBLE AS known_accuracy FROM c
    UNION ALL SELECT 'shifted', split, label, n, true, 1::DOUBLE, 1::DOUBLE FROM c
""")
def two_sample_test(spark, sf_dir):
    """Can real and generated rows of a class be told apart? Measured on held-out rows too.
    Rows that were moved far away always are."""
    real = vectors(spark, sf_dir)
    figures = ("p_real_on_real", "p_real_on_generated", "accuracy", "auc")
    fine = None
    for c in figures:
        here = F.coalesce(F.col(c).between(0, 1), F.lit(True))
        fine = here if fine is None else fine & here
    moved = shifted(real).select("label", F.col("vec_id").alias("sample_id"), "features")
    # named as the generated rows are, so that both splits are the same
    place = F.row_number().over(Window.partitionBy("label").orderBy("sample_id")) - 1
    moved = moved.withColumn("sample_id", place.cast("long"))

    def told(fake, source, auc, accuracy):
        scores = scoring.two_sample_scores(real, fake, ["vec_id"], ["label", "sample_id"], "label", "features", 10)
        return scoring.two_sample_summary(scores, ["split", "label"]).select(
            F.lit(source).alias("source"), "split", F.col("label").cast("int").alias("label"), "n", fine.alias("in_range"),
            F.round(auc.cast("double"), 9).alias("known_auc"), accuracy.cast("double").alias("known_accuracy"),
        )

    none = F.lit(None)
    return told(latent_rows(spark, sf_dir), "generated", none, none).unionByName(
        told(moved, "shifted", F.coalesce("auc", F.lit(1.0)), F.col("accuracy"))
    )


@query("""
    SELECT 'val' AS split, count(*) > 0 AS has_rows, true AS near_half, 1::DOUBLE AS apart_auc FROM embeddings
""")
def two_sample_same(spark, sf_dir):
    """Real rows against real rows: on held-out rows the area under the curve is one half,
    within four standard errors. Against rows moved far away it is one."""
    rows = vectors(spark, sf_dir).withColumn("side", F.pmod(F.xxhash64("vec_id"), F.lit(2)))

    def held_out(fake):
        scores = scoring.two_sample_scores(rows.where("side = 0"), fake, ["vec_id"], ["vec_id"], "label", "features", 10)
        return scoring.two_sample_summary(scores, ["split"]).where("split = 'val'")

    apart = held_out(shifted(rows.where("side = 1"))).select("split", F.round("auc", 9).alias("apart_auc"))
    found = held_out(rows.where("side = 1"))
    return found.join(apart, "split").select(
        "split", (F.col("n") > 0).alias("has_rows"), (F.abs(F.col("auc") - 0.5) <= 4 / F.sqrt(3 * F.col("n"))).alias("near_half"), "apart_auc"
    )


@query("""
    WITH e AS (SELECT label, (embedding[2] > 0)::INT AS t, 1 / (1 + exp(-(embedding[1]::DOUBLE + embedding[2]::DOUBLE))) AS s FROM embeddings),
    g AS (SELECT label, s, sum(t) AS pos, sum(1 - t) AS neg FROM e GROUP BY 1, 2),
    r AS (SELECT *, sum(neg) OVER (PARTITION BY label ORDER BY s) - neg AS below FROM g),
    a AS (SELECT label, sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg))::DOUBLE AS auc FROM r GROUP BY 1),
    m AS (SELECT label, count(*) AS n, avg(s) FILTER (WHERE t = 1) AS pr, avg(s) FILTER (WHERE t = 0) AS pg,
                 avg(((s >= 0.5)::INT = t)::INT) AS acc FROM e GROUP BY 1)
    SELECT label, n, round(pr, 6) AS p_real_on_real, round(pg, 6) AS p_real_on_generated, round(acc, 6) AS accuracy,
           round(auc, 6) AS auc FROM m JOIN a USING (label)
""")
def score_separation(spark, sf_dir):
    """The two-sample summary of a score the table itself carries."""
    scores = vectors(spark, sf_dir).select(
        "label",
        (F.col("features")[1] > 0).cast("int").alias("target"),
        sigmoid(F.col("features")[0] + F.col("features")[1]).alias("p_real"),
    )
    out = scoring.two_sample_summary(scores, ["label"])
    for c in ("p_real_on_real", "p_real_on_generated", "accuracy", "auc"):
        out = out.withColumn(c, F.round(c, 6))
    return out
