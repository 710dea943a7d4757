"""Class distributions and feature statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skewlens.functions.vectors import first_k
from skewlens.session import local_table, pin, stage

N_BINS = 20


# ---- shape, missing values, column roles -------------------------------------------


def table_shape(df: DataFrame, name: str) -> DataFrame:
    """One row: table name, row count, column count."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(name).alias("table_name"), "n_rows", F.lit(len(df.columns)).alias("n_cols")
    )


def _is_missing(field: T.StructField) -> Column:
    missing = F.col(f"`{field.name}`").isNull()
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        missing = missing | F.isnan(F.col(f"`{field.name}`"))
    return missing


def _present(field: T.StructField) -> Column:
    """The value, null where it is missing; -0.0 counts as 0.0."""
    value = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        value = value + F.lit(0.0).cast(field.dataType)
    return F.when(~_is_missing(field), value)


def missing_total(df: DataFrame) -> DataFrame:
    """Number of null or NaN cells over all columns, counted in one pass."""
    per_row = F.lit(0)
    for field in df.schema.fields:
        per_row = per_row + _is_missing(field).cast("int")
    return df.agg(F.coalesce(F.sum(per_row), F.lit(0)).alias("n_missing"))


def column_roles(df: DataFrame, categorical: list[str], excluded: list[str]) -> DataFrame:
    """(feature, position, role): every column that is not excluded, in schema order."""
    spark = df.sparkSession
    rows = [
        (c, i, "categorical" if c in categorical else "numerical")
        for i, c in enumerate(c for c in df.columns if c not in excluded)
    ]
    return local_table(spark, rows, "feature string, position int, role string")


def numerical_columns(df: DataFrame, categorical: list[str], excluded: list[str]) -> list[str]:
    return [c for c in df.columns if c not in categorical and c not in excluded]


# ---- label mapping ------------------------------------------------------------------


def map_category(df: DataFrame, col: str, dim: DataFrame, out: str = "category") -> DataFrame:
    """Left lookup ``dim(col, out)``; labels without an entry get null."""
    return df.join(dim.select(col, out), col, "left")


def map_category_literal(df: DataFrame, col: str, mapping: dict, out: str = "category") -> DataFrame:
    """Same lookup from a map literal: no join at all for a fixed dictionary."""
    entries = [F.lit(x) for pair in mapping.items() for x in pair]
    return df.withColumn(out, F.try_element_at(F.create_map(*entries), F.col(col)))


def unmapped(df: DataFrame, col: str, dim: DataFrame) -> DataFrame:
    """Distinct labels that ``dim`` does not know (distinct first: the anti join then
    sees one row per label)."""
    return df.select(col).where(F.col(col).isNotNull()).distinct().join(dim.select(col), col, "left_anti")


# ---- counts -------------------------------------------------------------------------


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Counts of the values that are neither null nor NaN, largest first, ties in value order."""
    return (
        df.select(_present(df.schema[col]).alias(col))
        .where(F.col(col).isNotNull())
        .groupBy(col)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), col)
    )


def class_distribution(df: DataFrame, col: str, digits: int = 2) -> DataFrame:
    """Count and percentage of every non-null class."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select(col, "n", F.round(F.col("n") * 100.0 / total, digits).alias("pct"))


def distinct_count(df: DataFrame, cols: list[str], approximate: float | None = None) -> DataFrame:
    """(feature, n_unique): distinct values that are neither null nor NaN, in one pass.

    Values are counted in their own type. With ``approximate`` (a relative standard
    deviation) a sketch per column takes the place of the shuffle of all values.
    """
    values = df.select(*[_present(df.schema[c]).alias(f"c{i}") for i, c in enumerate(cols)])
    if approximate is None:
        one = values.agg(*[F.count_distinct(f"c{i}").alias(f"c{i}") for i in range(len(cols))])
    else:
        one = values.agg(*[F.approx_count_distinct(f"c{i}", approximate).alias(f"c{i}") for i in range(len(cols))])
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"c{i}").alias("n_unique")) for i, c in enumerate(cols)])
    return one.select(F.explode(pairs).alias("p")).select("p.*")


def feature_value_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """(feature, value, n) for all columns of ``cols`` at once; null and NaN are no values."""
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), _present(df.schema[c]).cast("string").alias("value"))
            for c in cols
        ]
    )
    return (
        df.select(F.explode(pairs).alias("p"))
        .select("p.feature", "p.value")
        .where(F.col("value").isNotNull())
        .groupBy("feature", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def top_values(df: DataFrame, cols: list[str], k: int = 5) -> DataFrame:
    """The k most frequent values of each column with the column's distinct count.

    The rank filter is a group limit: each task forwards at most k rows per feature.
    """
    counts = feature_value_counts(df, cols)
    # Counting through n keeps both uses of the counts identical, so one exchange serves both.
    unique = counts.groupBy("feature").agg(F.count_if(F.col("n") > 0).alias("n_unique"))
    order = Window.partitionBy("feature").orderBy(F.desc("n"), "value")
    top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.join(unique, "feature")


def class_counts(df: DataFrame, col: str, classes: DataFrame) -> DataFrame:
    """Counts for every class of ``classes``, zero where the data has none."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
    return classes.join(counts, col, "left").select(
        *classes.columns, F.coalesce("_n", F.lit(0)).alias("n")
    )


def class_counts_percent(df: DataFrame, col: str, classes: DataFrame) -> DataFrame:
    counts = class_counts(df, col, classes)
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("pct", F.try_divide(F.col("n") * 100.0, total))


def imbalance_ratio(df: DataFrame, col: str) -> DataFrame:
    """Largest over smallest class."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(
        F.max("n").alias("n_max"),
        F.min("n").alias("n_min"),
        (F.max("n") / F.min("n")).alias("ratio"),
    )


def compare_distributions(
    left: DataFrame, right: DataFrame, col: str, names: tuple = ("train", "test"), digits: int = 2
) -> DataFrame:
    """Counts and percentages of two tables side by side; a class absent on one side
    counts zero there. Both tables are tagged, stacked and grouped once."""
    a, b = names
    both = left.select(col, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(
        right.select(col, F.lit(0).alias("_a"), F.lit(1).alias("_b"))
    )
    counts = (
        both.where(F.col(col).isNotNull())
        .groupBy(col)
        .agg(F.sum("_a").alias(f"n_{a}"), F.sum("_b").alias(f"n_{b}"))
    )
    sums = counts.agg(F.struct(F.sum(f"n_{a}").alias("a"), F.sum(f"n_{b}").alias("b"))).scalar()
    return counts.select(
        col,
        f"n_{a}",
        f"n_{b}",
        F.round(F.try_divide(F.col(f"n_{a}") * 100.0, sums["a"]), digits).alias(f"pct_{a}"),
        F.round(F.try_divide(F.col(f"n_{b}") * 100.0, sums["b"]), digits).alias(f"pct_{b}"),
    )


def before_after(before: DataFrame, after: DataFrame, col: str, targets: DataFrame | None = None) -> DataFrame:
    """Class counts of two tables, the rows added between them and, for a log-scaled
    chart, the decimal logarithm of the counts."""
    both = before.select(col, F.lit(1).alias("_b"), F.lit(0).alias("_a")).unionByName(
        after.select(col, F.lit(0).alias("_b"), F.lit(1).alias("_a"))
    )
    counts = both.groupBy(col).agg(
        F.sum("_b").alias("n_before"), F.sum("_a").alias("n_after")
    )
    counts = counts.withColumn("n_added", F.col("n_after") - F.col("n_before"))
    for side in ("before", "after"):
        n = F.col(f"n_{side}")
        counts = counts.withColumn(f"log10_{side}", F.when(n > 0, F.log10(n)))
    if targets is not None:
        counts = counts.join(targets.select(col, "target"), col, "left")
    return counts


def inverse_weights(df: DataFrame, col: str) -> DataFrame:
    """(class, n, weight) with weight = 1 / class count."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("weight", F.lit(1.0) / F.col("n"))


# ---- numeric summaries --------------------------------------------------------------


def cleaned(col: str) -> Column:
    """The column as a double, null where it is NaN."""
    value = F.col(col).cast("double")
    return F.when(~F.isnan(value), value)


#: Accuracy of the first bracket around a quantile.
QUANTILE_ACCURACY = 10_000
#: Rows a bracket may hold before it is narrowed again.
BRACKET_ROWS = 2_000_000


def describe(df: DataFrame, cols: list[str], probs: tuple = (0.25, 0.5, 0.75)) -> DataFrame:
    """count, mean, sample std, min, linear-interpolated quantiles, max per column.

    Exact quantiles without gathering a column: a sketch brackets each wanted rank,
    exact counts confirm the bracket (and narrow or widen it where needed), and only
    the values inside it are grouped and ranked.
    """
    values = df.select(*[cleaned(c).alias(c) for c in cols])
    eps = 2.0 / QUANTILE_ACCURACY
    edges = [min(max(p + s * eps, 0.0), 1.0) for p in probs for s in (-1, 1)]
    aggs = []
    for i, c in enumerate(cols):
        aggs += [
            F.count(c).alias(f"n{i}"),
            F.avg(c).alias(f"mean{i}"),
            F.stddev_samp(c).alias(f"std{i}"),
            F.min(c).alias(f"min{i}"),
            F.max(c).alias(f"max{i}"),
            F.percentile_approx(c, edges, QUANTILE_ACCURACY).alias(f"q{i}"),
        ]
    first = values.agg(*aggs).head()
    wanted = []
    for i, c in enumerate(cols):
        n = first[f"n{i}"]
        for j, p in enumerate(probs):
            if n:
                h = p * (n - 1)
                q = first[f"q{i}"]
                wanted.append(
                    dict(col=c, pi=j, lo=int(h), frac=h - int(h), hi=min(int(h) + 1, n - 1),
                         a=q[2 * j], b=q[2 * j + 1], min=first[f"min{i}"], max=first[f"max{i}"])
                )
    _settle_brackets(values, wanted)
    # A bracket of one value needs no ranking: both ranks fall on that value.
    tied = [(w["col"], w["pi"], w["a"]) for w in wanted if w["a"] == w["b"]]
    quantiles = _ranked_quantiles(values, [w for w in wanted if w["a"] != w["b"]], tied, len(probs))

    stats = local_table(
        df.sparkSession,
        [
            (c, i, int(first[f"n{i}"]), first[f"mean{i}"], first[f"std{i}"], first[f"min{i}"], first[f"max{i}"])
            for i, c in enumerate(cols)
        ],
        "feature string, position int, n long, mean double, std double, min double, max double",
    )
    out = stats.join(quantiles, "feature", "left")
    return out.select(
        "feature", "position", "n", "mean", "std", "min",
        *[F.col(f"_q{j}").alias(f"p{round(p * 100):d}") for j, p in enumerate(probs)],
        "max",
    )


def _settle_brackets(values: DataFrame, wanted: list[dict]) -> None:
    """Make every bracket contain its rank and few enough rows."""
    todo = list(wanted)
    while todo:
        aggs = []
        for t, w in enumerate(todo):
            v = F.col(w["col"])
            aggs += [
                F.count_if(v < w["a"]).alias(f"below{t}"),
                F.count_if((v >= w["a"]) & (v <= w["b"])).alias(f"in{t}"),
            ]
        counts = values.agg(*aggs).head()
        again = []
        for t, w in enumerate(todo):
            w["below"], w["inside"] = counts[f"below{t}"], counts[f"in{t}"]
            if w["below"] > w["lo"]:
                w["a"] = w["min"]
                again.append(w)
            elif w["below"] + w["inside"] <= w["hi"]:
                w["b"] = w["max"]
                again.append(w)
            elif w["inside"] > BRACKET_ROWS and w["a"] < w["b"]:
                again.append(w)
        narrow = [w for w in again if w["below"] <= w["lo"] and w["below"] + w["inside"] > w["hi"]]
        if narrow:
            sketches = []
            for t, w in enumerate(narrow):
                v = F.when(F.col(w["col"]).between(w["a"], w["b"]), F.col(w["col"]))
                at = [(w["lo"] - w["below"]) / w["inside"], (w["hi"] - w["below"]) / w["inside"]]
                at = [max(at[0] - 2.0 / QUANTILE_ACCURACY, 0.0), min(at[1] + 2.0 / QUANTILE_ACCURACY, 1.0)]
                sketches.append(F.percentile_approx(v, at, QUANTILE_ACCURACY).alias(f"q{t}"))
            row = values.agg(*sketches).head()
            for t, w in enumerate(narrow):
                a, b = row[f"q{t}"]
                if (a, b) == (w["a"], w["b"]):
                    again.remove(w)
                w["a"], w["b"] = a, b
        todo = again


def _ranked_quantiles(values: DataFrame, wanted: list[dict], tied: list[tuple], n_probs: int) -> DataFrame:
    """``(feature, _q0, _q1, ...)`` from the brackets, plus the values already known."""
    spark = values.sparkSession
    found = local_table(spark, tied, "feature string, pi int, q double")
    if wanted:
        found = found.unionByName(_rank_inside(values, wanted))
    return found.groupBy("feature").agg(
        *[F.max(F.when(F.col("pi") == j, F.col("q"))).alias(f"_q{j}") for j in range(n_probs)]
    )


def _rank_inside(values: DataFrame, wanted: list[dict]) -> DataFrame:
    hits = [
        F.when(
            F.col(w["col"]).between(w["a"], w["b"]),
            F.struct(
                F.lit(w["col"]).alias("feature"),
                F.lit(w["pi"]).alias("pi"),
                F.col(w["col"]).alias("value"),
            ),
        )
        for w in wanted
    ]
    inside = (
        values.where(F.coalesce(*hits).isNotNull())
        .select(F.explode(F.array_compact(F.array(*hits))).alias("h"))
        .groupBy("h.feature", "h.pi", "h.value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    ranks = local_table(
        values.sparkSession,
        [(w["col"], w["pi"], w["below"], w["lo"], w["hi"], w["frac"]) for w in wanted],
        "feature string, pi int, below long, lo long, hi long, frac double",
    )
    running = Window.partitionBy("feature", "pi").orderBy("value")
    placed = inside.withColumn("upto", F.sum("n").over(running)).join(ranks, ["feature", "pi"])
    upto = F.col("below") + F.col("upto")
    from_ = upto - F.col("n")
    holds = lambda rank: (from_ <= F.col(rank)) & (F.col(rank) < upto)
    both = placed.groupBy("feature", "pi").agg(
        F.max(F.when(holds("lo"), F.col("value"))).alias("v_lo"),
        F.max(F.when(holds("hi"), F.col("value"))).alias("v_hi"),
        F.max("frac").alias("frac"),
    )
    return both.select(
        "feature", "pi", (F.col("v_lo") + F.col("frac") * (F.col("v_hi") - F.col("v_lo"))).alias("q")
    )


def class_stats(df: DataFrame, group: str, vec: str, k: int = 5) -> DataFrame:
    """Mean and population std of the first k vector elements per class."""
    return (
        df.select(group, F.posexplode(first_k(vec, k)).alias("feature", "value"))
        .groupBy(group, "feature")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("value").alias("mean"),
            F.stddev_pop("value").alias("std"),
        )
    )


def histogram(df: DataFrame, group: str, vec: str, k: int = 5, bins: int = N_BINS) -> DataFrame:
    """Equal-width histogram of the first k elements per class over their own range.

    The last bin is closed; a constant element gets the range value +- 0.5. A value
    that rounding put on the wrong side of an edge is moved to its bin.
    """
    long = df.select(group, F.posexplode(first_k(vec, k)).alias("feature", "value"))
    ranges = long.groupBy(group, "feature").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    flat = F.col("_lo") == F.col("_hi")
    ranges = pin(
        ranges.select(
            group,
            "feature",
            F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("lo"),
            F.when(flat, F.col("_hi") + 0.5).otherwise(F.col("_hi")).alias("hi"),
        ),
        name="ranges",
    )
    step = (F.col("hi") - F.col("lo")) / bins

    def edge(i: Column) -> Column:
        return F.when(i == bins, F.col("hi")).otherwise(F.col("lo") + i * step)

    guess = F.least(F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
    binned = long.join(ranges, [group, "feature"]).withColumn("_g", guess.cast("int"))
    g = F.col("_g")
    moved = F.when(F.col("value") < edge(g), g - 1).when(
        (F.col("value") >= edge(g + 1)) & (g < bins - 1), g + 1
    ).otherwise(g)
    counts = binned.groupBy(group, "feature", moved.alias("bin")).agg(F.count(F.lit(1)).alias("_n"))
    grid = ranges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    b = F.col("bin")
    return grid.join(counts, [group, "feature", "bin"], "left").select(
        group, "feature", "bin",
        edge(b).alias("edge_lo"), edge(b + 1).alias("edge_hi"),
        F.coalesce("_n", F.lit(0)).alias("n"),
    )


def vocabulary_difference(train: DataFrame, test: DataFrame, cols: list[str]) -> DataFrame:
    """Values seen on one side only: (feature, value, seen_in)."""
    both = feature_value_counts(train, cols).select("feature", "value", F.lit(1).alias("_a"), F.lit(0).alias("_b"))
    both = both.unionByName(
        feature_value_counts(test, cols).select("feature", "value", F.lit(0).alias("_a"), F.lit(1).alias("_b"))
    )
    sides = both.groupBy("feature", "value").agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    return sides.where(F.col("_a") + F.col("_b") == 1).select(
        "feature", "value", F.when(F.col("_a") == 1, "train").otherwise("test").alias("seen_in")
    )


def class_list(df: DataFrame, col: str, limit: int = 1000) -> list | DataFrame:
    """Sorted distinct classes, for outputs that are dense in the classes; beyond ``limit``
    the table of classes instead, for sparse ones."""
    table = stage(df.select(col).where(F.col(col).isNotNull()).distinct(), "classes")
    rows = table.limit(limit + 1).collect()
    return table if len(rows) > limit else sorted(r[0] for r in rows)
