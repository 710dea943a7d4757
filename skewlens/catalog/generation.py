"""Generation queries: noise grids, stored networks, vector functions, samplers."""

from pyspark.sql import functions as F

from skewlens.catalog.neighbors import checksum, vectors
from skewlens.catalog.registry import query, sql_normal, sql_uniform, table
from skewlens.functions import vectors as v
from skewlens.operators import encode, generate, metrics, profile
from skewlens.plans.evaluate import measure
from skewlens.session import fresh_path, local_table
from skewlens.sources import generated

GRID = "label || ':' || sample_id || ':' || "


def class_grid(spark, sf_dir):
    """As many samples per class as the class has rows."""
    counts = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return generate.grid(counts, "n").select("label", "sample_id")


@query(f"""
    WITH g AS (SELECT label, unnest(range(count(*))) AS sample_id FROM embeddings GROUP BY label)
    SELECT label, sample_id, {', '.join(f"round({sql_normal('noise', GRID + str(j))}, 6) + 0::DOUBLE AS z{j}" for j in range(4))}
    FROM g
""")
def noise_grid(spark, sf_dir):
    """Class x ordinal grid with keyed normal noise."""
    rows = generate.with_noise(class_grid(spark, sf_dir), 4, ["label", "sample_id"])
    return rows.select("label", "sample_id", *[F.round(F.col("z")[j], 6).alias(f"z{j}") for j in range(4)])


@query(f"""
    WITH a AS (SELECT vec_id, embedding::DOUBLE[] AS x, row_number() OVER (ORDER BY md5('42:real:' || vec_id)) - 1 AS pos FROM embeddings),
    b AS (SELECT vec_id, embedding::DOUBLE[] AS x, row_number() OVER (ORDER BY md5('42:fake:' || vec_id)) - 1 AS pos FROM embeddings),
    p AS (SELECT pos, a.vec_id AS real_id, b.vec_id AS fake_id, {sql_uniform('alpha', 'pos')} AS alpha, a.x AS ax, b.x AS bx
          FROM a JOIN b USING (pos))
    SELECT pos, real_id, fake_id, round(alpha, 8) AS alpha,
           round(list_sum(list_transform(range(64), lambda i: (i + 1) * (bx[i + 1] + alpha * (ax[i + 1] - bx[i + 1])))), 5)
               + 0::DOUBLE AS checksum
    FROM p
""")
def pair_interpolate(spark, sf_dir):
    """Rows paired by shuffled position and blended."""
    rows = vectors(spark, sf_dir)
    out = generate.pair_interpolate(rows, rows, "vec_id", "vec_id", "features")
    return out.select(
        "pos", "real_id", "fake_id", F.round("alpha", 8).alias("alpha"), checksum("features").alias("checksum")
    )


def _rule(layer: int, unit: int, i: int) -> float:
    """Weights of a small network, the same in SQL."""
    return ((unit * 7 + (i + 1) * 13 + layer * 3) % 11 - 5) / 20.0


def _layer_sql(layer: int, units: int, source: str) -> str:
    w = f"((u * 7 + (i + 1) * 13 + {layer * 3}) % 11 - 5) / 20::DOUBLE"
    bias = f"((u * 7 + {layer * 3}) % 11 - 5) / 20::DOUBLE"
    return (
        f"list_transform(range({units}), lambda u: {bias} + "
        f"list_sum(list_transform(range(len({source})), lambda i: {w} * {source}[i + 1])))"
    )


@query(f"""
    WITH e AS (SELECT vec_id, label, list_concat(embedding::DOUBLE[],
               list_transform(range(10), lambda i: CASE WHEN i = label THEN 1::DOUBLE ELSE 0::DOUBLE END)) AS x FROM embeddings),
    h AS (SELECT vec_id, label, list_transform({_layer_sql(0, 8, 'x')},
               lambda t: CASE WHEN t > 0 THEN t ELSE 0.2::DOUBLE * t END) AS h FROM e),
    o AS (SELECT vec_id, label, {_layer_sql(1, 4, 'h')} AS y FROM h)
    SELECT vec_id, label, {', '.join(f'round(y[{j + 1}], 6) + 0::DOUBLE AS y{j}' for j in range(4))} FROM o
""")
def mlp_generate(spark, sf_dir):
    """A stored two-layer network, conditioned on the class, applied to every vector."""
    weights = weights_from_rule(spark, [(74, 8, "leaky_relu", True), (8, 4, "linear", False)])
    out = generate.mlp_forward(vectors(spark, sf_dir), "features", "label", 10, weights, "y")
    return out.select("vec_id", "label", *[F.round(F.col("y")[j], 6).alias(f"y{j}") for j in range(4)])


@query("""
    WITH e AS (SELECT vec_id, embedding[1:32]::DOUBLE[] AS a, embedding[33:64]::DOUBLE[] AS b FROM embeddings)
    SELECT vec_id,
      round(list_sum(list_transform(range(32), lambda i: (i + 1) * (a[i + 1] + exp(0.5::DOUBLE * b[i + 1]) * a[32 - i]))), 5) + 0::DOUBLE AS reparam,
      round(list_sum(list_transform(a, lambda x: greatest(x, 0))), 5) AS relu_sum,
      round(list_sum(list_transform(a, lambda x: CASE WHEN x > 0 THEN x ELSE 0.2::DOUBLE * x END)), 5) + 0::DOUBLE AS leaky_sum,
      round(1 / (1 + exp(-a[1])), 6) AS sigmoid,
      round(sqrt(list_sum(list_transform(a, lambda x: x * x))), 6) AS norm,
      round(pow(sqrt(list_sum(list_transform(a, lambda x: x * x))) - 1, 2), 6) AS penalty,
      round(list_distance(a, b), 6) AS distance
    FROM e
""")
def vector_functions(spark, sf_dir):
    """Element-wise vector functions over the two halves of each vector."""
    rows = vectors(spark, sf_dir).select(
        "vec_id", F.slice("features", 1, 32).alias("a"), F.slice("features", 33, 32).alias("b")
    )
    return rows.select(
        "vec_id",
        checksum(v.reparameterise("a", "b", F.reverse("a"))).alias("reparam"),
        F.round(v.total(v.relu("a")), 5).alias("relu_sum"),
        F.round(v.total(v.leaky_relu("a")), 5).alias("leaky_sum"),
        F.round(v.sigmoid(F.col("a")[0]), 6).alias("sigmoid"),
        F.round(v.l2_norm("a"), 6).alias("norm"),
        F.round(v.unit_norm_penalty("a"), 6).alias("penalty"),
        F.round(v.euclidean("a", "b"), 6).alias("distance"),
    )


def weights_from_rule(spark, shapes, rule=_rule):
    """Weight table from ``rule(layer, unit, input)`` (input -1 is the bias); ``shapes``
    lists (inputs, units, activation, with_label)."""
    rows = [
        (layer, activation, with_label, u, float(rule(layer, u, -1)), [float(rule(layer, u, i)) for i in range(inputs)])
        for layer, (inputs, units, activation, with_label) in enumerate(shapes)
        for u in range(units)
    ]
    return local_table(spark, rows, generate.WEIGHTS_SCHEMA)


#: Keyed noise for every class and ordinal, and a stored network over it.
NETWORK_SQL = f"""
    g AS (SELECT label, unnest(range(count(*))) AS sample_id FROM embeddings GROUP BY label),
    z AS (SELECT label, sample_id, list_concat([{', '.join(sql_normal('noise', GRID + str(j)) for j in range(4))}],
          list_transform(range(10), lambda i: CASE WHEN i = label THEN 1::DOUBLE ELSE 0::DOUBLE END)) AS x FROM g),
    h AS (SELECT label, sample_id, list_transform({_layer_sql(0, 8, 'x')},
          lambda t: CASE WHEN t > 0 THEN t ELSE 0.2::DOUBLE * t END) AS h FROM z),
    y AS (SELECT label, sample_id, {_layer_sql(1, 4, 'h')} AS y FROM h)
"""

GENERATED_SQL = f"""
    WITH {NETWORK_SQL}
    SELECT 'class_' || label AS category, label AS label_idx, count(*) AS n,
           {', '.join(f"round(avg(y[{j + 1}]), 6) + 0::DOUBLE AS mean_{j}" for j in range(4))} FROM y GROUP BY label
"""


def _generated(spark, sf_dir):
    """Class grid, keyed noise and a stored network conditioned on the class."""
    noisy = generate.with_noise(class_grid(spark, sf_dir), 4, ["label", "sample_id"])
    weights = weights_from_rule(spark, [(14, 8, "leaky_relu", True), (8, 4, "linear", False)])
    rows = generate.mlp_forward(noisy, "z", "label", 10, weights)
    return rows.select(
        F.concat(F.lit("class_"), "label").alias("category"), F.col("label").alias("label_idx"), "sample_id", "features"
    )


def _summary(rows):
    return rows.groupBy("category", "label_idx").agg(
        F.count(F.lit(1)).alias("n"), *[F.round(F.avg(F.col("features")[j]), 6).alias(f"mean_{j}") for j in range(4)]
    )


def generated_rows(spark, sf_dir):
    """Generated rows after a round trip through one folder per class."""
    rows = _generated(spark, sf_dir)
    classes = encode.fit_labels(
        table(spark, sf_dir, "embeddings").select(F.concat(F.lit("class_"), "label").alias("category")), "category"
    )
    path = fresh_path(spark, "by-class")
    generated.write_by_class(rows.drop("label_idx"), path)
    return generated.read_by_class(spark, path, classes)


@query(GENERATED_SQL)
def generated_by_class(spark, sf_dir):
    """Generated rows in one folder per class; the code is looked up when reading."""
    return _summary(generated_rows(spark, sf_dir))


@query(GENERATED_SQL)
def generated_flat(spark, sf_dir):
    path = fresh_path(spark, "flat")
    generated.write_flat(_generated(spark, sf_dir), path)
    return _summary(generated.read_flat(spark, path))


@query(f"""
    WITH {NETWORK_SQL}, s AS (SELECT label, {_layer_sql(0, 10, 'y')} AS s FROM y),
    p AS (SELECT label AS "true", (list_position(s, list_max(s)) - 1)::INT AS pred FROM s),
    c AS (SELECT "true", count(*) AS n, avg(("true" = pred)::INT) AS score FROM p GROUP BY 1),
    a AS (SELECT 'class' AS scope, "true"::VARCHAR AS label, n, score FROM c
          UNION ALL SELECT 'macro', 'all', sum(n), sum(score) / 10 FROM c
          UNION ALL SELECT 'accuracy', 'all', count(*), avg(("true" = pred)::INT) FROM p)
    SELECT scope, label, n::BIGINT AS n, round(score, 6) AS score, CASE WHEN score >= 0.2 THEN 'PASS' ELSE 'FAIL' END AS verdict,
           round(CASE WHEN score < 0.2 THEN 0.2::DOUBLE - score END, 6) AS gap FROM a
""")
def evaluate_generated(spark, sf_dir):
    """Generated rows written by class, read back, scored by a stored network and judged:
    accuracy of every class, their macro average and the overall accuracy, with verdicts."""
    rows = generated_rows(spark, sf_dir)
    weights = weights_from_rule(spark, [(4, 10, "linear", False)])
    scores = generate.mlp_forward(rows, "features", "label_idx", 10, weights, "scores")
    pred = (F.array_position("scores", F.array_max("scores")) - 1).cast("int")
    predicted = scores.select(F.lit("network").alias("model"), F.col("label_idx").alias("true"), pred.alias("pred"))
    found = measure(predicted, list(range(10)))
    classes = found.classes.select(
        F.lit("class").alias("scope"), F.col("true").cast("string").alias("label"), F.col("support").alias("n"), F.col("accuracy").alias("score")
    )
    overall = F.explode(
        F.array(*[F.struct(F.lit(s).alias("scope"), F.col(c).alias("score")) for s, c in (("macro", "macro"), ("accuracy", "overall"))])
    )
    whole = found.summary.select("n_rows", overall.alias("o")).select("o.scope", F.lit("all").alias("label"), F.col("n_rows").alias("n"), "o.score")
    judged = metrics.with_verdict(classes.unionByName(whole), "score", 0.2)
    return judged.select("scope", "label", "n", F.round("score", 6).alias("score"), "verdict", F.round("gap", 6).alias("gap"))


@query("""
    WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(64))::INT AS i FROM embeddings),
    m AS (SELECT label, i, avg(x) AS mu, count(*) AS n FROM e GROUP BY 1, 2),
    c AS (SELECT e.vec_id, e.label, e.i, x - mu AS d, n FROM e JOIN m ON e.label = m.label AND e.i = m.i)
    SELECT a.label, a.i, b.i AS j, max(a.n) AS n, round(sum(a.d * b.d) / max(a.n), 8) + 0::DOUBLE AS cov
    FROM c a JOIN c b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY 1, 2, 3
""")
def class_covariance(spark, sf_dir):
    """Per-class population covariance from distributed moments."""
    cov = generate.class_covariances(vectors(spark, sf_dir), "label", "features")
    d = F.size("mean")
    return (
        cov.select("label", "n", d.alias("d"), F.posexplode("scatter").alias("at", "s"))
        .select(
            "label",
            F.floor(F.col("at") / F.col("d")).cast("int").alias("i"),
            (F.col("at") % F.col("d")).alias("j"),
            "n",
            F.round(F.col("s") / F.col("n"), 8).alias("cov"),
        )
        .where("i <= j")
    )


@query("""
    WITH e AS (SELECT l_returnflag AS flag, l_quantity::DOUBLE AS a, l_extendedprice::DOUBLE / 1000 AS b, l_discount::DOUBLE AS c FROM lineitem),
    m AS (SELECT flag, count(*) AS n, covar_pop(a, a) AS aa, covar_pop(a, b) AS ab, covar_pop(a, c) AS ac,
          covar_pop(b, b) AS bb, covar_pop(b, c) AS bc, covar_pop(c, c) AS cc FROM e GROUP BY flag)
    SELECT flag, n, round(aa, 4) AS aa, round(ab, 4) + 0::DOUBLE AS ab, round(ac, 4) + 0::DOUBLE AS ac,
           round(bb, 4) AS bb, round(bc, 4) + 0::DOUBLE AS bc, round(cc, 4) AS cc FROM m
""")
def class_covariance_shifted(spark, sf_dir):
    """Covariances do not suffer from means a hundred million away from zero."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("flag"),
        F.array(F.col("l_quantity") + 1e8, F.col("l_extendedprice") / 1000 + 1e8, F.col("l_discount") + 1e8).alias("v"),
    )
    cov = generate.class_covariances(rows, "flag", "v")
    at = {"aa": 0, "ab": 1, "ac": 2, "bb": 4, "bc": 5, "cc": 8}
    return cov.select("flag", "n", *[F.round(F.col("scatter")[i] / F.col("n"), 4).alias(c) for c, i in at.items()])


def latent_rows(spark, sf_dir):
    """Rows drawn from the fitted class-conditional generator, as many per class as it
    has real rows."""
    rows = vectors(spark, sf_dir)
    model = generate.fit_latent(rows, "label", "features", k=8)
    counts = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n_samples"))
    return generate.sample_latent(model, "label", counts)


@query("""
    SELECT label, count(*) AS n, count(*) AS n_ids, count(*) - 1 AS last_id, 64 AS width FROM embeddings GROUP BY label
""")
def latent_generator(spark, sf_dir):
    """The generator draws as many rows per class as asked, numbered 0, 1, 2, ..."""
    return latent_rows(spark, sf_dir).groupBy("label").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("sample_id").alias("n_ids"),
        F.max("sample_id").alias("last_id"),
        F.max(F.size("features")).alias("width"),
    )


@query("""
    SELECT label, unnest(range(64))::INT AS feature, count(*) AS n, true AS mean_holds, true AS spread_holds FROM embeddings GROUP BY label
""")
def latent_generator_stats(spark, sf_dir):
    """Drawn rows have the moments of the real ones: class means within five standard errors
    of their difference, and a spread between half and twice the real one (small classes
    borrow from all)."""
    stats = lambda rows, tag: profile.class_stats(rows, "label", "features", 64).select(
        "label", "feature", *[F.col(c).alias(f"{tag}_{c}") for c in ("n", "mean", "std")]
    )
    both = stats(vectors(spark, sf_dir), "real").join(stats(latent_rows(spark, sf_dir), "drawn"), ["label", "feature"])
    error = F.sqrt((F.col("real_std") ** 2 + F.col("drawn_std") ** 2) / F.col("real_n"))
    return both.select(
        "label",
        "feature",
        F.col("drawn_n").alias("n"),
        (F.abs(F.col("drawn_mean") - F.col("real_mean")) <= 5 * error).alias("mean_holds"),
        F.col("drawn_std").between(F.col("real_std") / 2, F.col("real_std") * 2).alias("spread_holds"),
    )
