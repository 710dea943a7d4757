"""Classifier metrics from a prediction table; everything derives from one grouped
confusion count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skewlens.functions.verdicts import TARGET, gap_to_target, verdict
from skewlens.session import local_table

#: Classes up to which a confusion matrix lists its empty cells.
MAX_CLASSES = 1000


def confusion(
    pred: DataFrame,
    classes: list | DataFrame,
    true: str = "true",
    predicted: str = "pred",
    by: list[str] | None = None,
    max_classes: int = MAX_CLASSES,
) -> DataFrame:
    """``(by..., true, pred, n)``, one pass over the rows.

    Up to ``max_classes`` classes the matrix is dense, zero cells included. Beyond, or where
    ``classes`` is a table (its first column), it is sparse: counted cells and the diagonal.
    Every class then still has a row, so all figures that derive from the cells are the same.
    """
    by = by or []
    counts = pred.groupBy(*by, F.col(true).alias("true"), F.col(predicted).alias("pred")).agg(
        F.count(F.lit(1)).alias("n")
    )
    kind = pred.schema[true].dataType
    nothing = F.lit(0).cast("long")
    if isinstance(classes, DataFrame) or len(classes) > max_classes:
        if not isinstance(classes, DataFrame):
            classes = local_table(pred.sparkSession, [(c,) for c in classes], f"label {kind.simpleString()}")
        label = F.col(classes.columns[0]).cast(kind)
        listed = classes.where(label.isNotNull()).select(label.alias("true"), label.alias("pred"))
        if by:  # a cell per class and group; groups (models) are few
            groups = counts.groupBy(*by).agg((F.sum("n") * 0).alias("n"))
            groups = groups.agg(F.collect_list(F.struct(*by, "n"))).scalar()
            diagonal = listed.select("true", "pred", F.explode(groups).alias("_g")).select("_g.*", "true", "pred")
            diagonal = diagonal.select(*by, "true", "pred", "n")
        else:
            diagonal = listed.select("true", "pred", nothing.alias("n"))
        return counts.unionByName(diagonal).groupBy(*by, "true", "pred").agg(F.sum("n").alias("n"))
    every = F.array(*[F.lit(c).cast(kind) for c in classes])
    if by:
        # The zero is taken from n, so both uses of the counts stay identical and one pass
        # over the rows serves both.
        groups = counts.groupBy(*by).agg((F.sum("n") * 0).alias("_zero"))
    else:
        groups = pred.sparkSession.range(1).select(nothing.alias("_zero"))
    zero = groups.select(*by, "_zero", F.explode(every).alias("true")).select(
        *by, "true", F.explode(every).alias("pred"), F.col("_zero").alias("n")
    )
    return counts.unionByName(zero).groupBy(*by, "true", "pred").agg(F.sum("n").alias("n"))


def confusion_matrix(cells: DataFrame, classes: list, by: list[str] | None = None) -> DataFrame:
    """One row per true class with a column per predicted class; wants a dense matrix."""
    return cells.groupBy(*(by or []), "true").pivot("pred", classes).agg(F.sum("n"))


def per_class(cells: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Support, hits and accuracy per true class; an empty class scores 0.0."""
    hit = F.when(F.col("true") == F.col("pred"), F.col("n")).otherwise(0)
    out = cells.groupBy(*(by or []), "true").agg(F.sum("n").alias("support"), F.sum(hit).alias("correct"))
    return out.withColumn(
        "accuracy", F.coalesce(F.try_divide(F.col("correct").cast("double"), F.col("support")), F.lit(0.0))
    )


def macro(classes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Macro average (all classes weigh the same) and overall accuracy; without rows 0.0."""
    return classes.groupBy(*(by or [])).agg(
        F.coalesce(F.avg("accuracy"), F.lit(0.0)).alias("macro"),
        F.coalesce(F.try_divide(F.sum("correct").cast("double"), F.sum("support")), F.lit(0.0)).alias("overall"),
        F.coalesce(F.sum("support"), F.lit(0)).alias("n_rows"),
    )


def marginals(cells: DataFrame, by: list[str] | None = None) -> DataFrame:
    """True and predicted count per class."""
    sides = F.array(
        F.struct(F.col("true").alias("label"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p")),
        F.struct(F.col("pred").alias("label"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p")),
    )
    return (
        cells.select(*(by or []), F.explode(sides).alias("s"))
        .groupBy(*(by or []), F.col("s.label").alias("label"))
        .agg(F.sum("s.t").alias("n_true"), F.sum("s.p").alias("n_pred"))
    )


def report(cells: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro and weighted
    averages. A zero denominator gives 0."""
    by = by or []
    zero = F.lit(0).cast("long")
    both = F.when(F.col("true") == F.col("pred"), F.col("n")).otherwise(zero)
    sides = F.array(
        F.struct(F.col("true").alias("label"), F.col("n").alias("t"), zero.alias("p"), both.alias("tp")),
        F.struct(F.col("pred").alias("label"), zero.alias("t"), F.col("n").alias("p"), zero.alias("tp")),
    )
    sums = (
        cells.select(*by, F.explode(sides).alias("s"))
        .groupBy(*by, F.col("s.label").cast("string").alias("label"))
        .agg(F.sum("s.t").alias("support"), F.sum("s.p").alias("predicted"), F.sum("s.tp").alias("tp"))
    )

    def ratio(num, den):
        return F.coalesce(F.try_divide(num.cast("double"), den), F.lit(0.0))

    tp, support, predicted = F.col("tp"), F.col("support"), F.col("predicted")
    classes = sums.select(
        *by,
        "label",
        ratio(tp, predicted).alias("precision"),
        ratio(tp, support).alias("recall"),
        ratio(tp * 2, support + predicted).alias("f1"),
        "support",
        "tp",
    )
    averages = classes.groupBy(*by).agg(
        F.sum("support").alias("total"),
        ratio(F.sum("tp"), F.sum("support")).alias("accuracy"),
        *[F.avg(m).alias(f"macro_{m}") for m in ("precision", "recall", "f1")],
        *[
            ratio(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(f"weighted_{m}")
            for m in ("precision", "recall", "f1")
        ],
    )
    none = F.lit(None).cast("double")
    lines = F.array(
        F.struct(
            F.lit("accuracy").alias("label"), none.alias("precision"), none.alias("recall"),
            F.col("accuracy").alias("f1"), F.col("total").alias("support"),
        ),
        *[
            F.struct(
                F.lit(f"{kind} avg").alias("label"),
                F.col(f"{kind}_precision").alias("precision"),
                F.col(f"{kind}_recall").alias("recall"),
                F.col(f"{kind}_f1").alias("f1"),
                F.col("total").alias("support"),
            )
            for kind in ("macro", "weighted")
        ],
    )
    summary = averages.select(*by, F.explode(lines).alias("l")).select(*by, "l.*")
    return classes.drop("tp").unionByName(summary)


def with_verdict(scores: DataFrame, score: str, target: float = TARGET) -> DataFrame:
    return scores.withColumn("verdict", verdict(score, target)).withColumn("gap", gap_to_target(score, target))


def compare(a: DataFrame, b: DataFrame, on: str = "true", score: str = "accuracy") -> DataFrame:
    """Per-class scores of two models and the change from the first to the second."""
    left = a.select(on, F.col(score).alias(f"{score}_a"))
    right = b.select(on, F.col(score).alias(f"{score}_b"))
    return left.join(right, on).withColumn("delta", F.col(f"{score}_b") - F.col(f"{score}_a"))


def compare_models(scores: DataFrame, model: str, a: str, b: str, on: str = "true", score: str = "accuracy") -> DataFrame:
    """Same comparison when both models' scores are rows of one table: a pivot."""
    wide = scores.groupBy(on).agg(
        F.max(F.when(F.col(model) == a, F.col(score))).alias(f"{score}_a"),
        F.max(F.when(F.col(model) == b, F.col(score))).alias(f"{score}_b"),
    )
    return wide.withColumn("delta", F.col(f"{score}_b") - F.col(f"{score}_a"))


def real_versus_generated(pred: DataFrame, source: str = "source", true: str = "true", predicted: str = "pred") -> DataFrame:
    """Accuracy on real rows, on generated rows, and the difference, from one pass over
    a prediction table tagged 'real' / 'generated'."""
    hit = (F.col(true) == F.col(predicted)).cast("double")
    both = pred.agg(
        F.avg(F.when(F.col(source) == "real", hit)).alias("acc_real"),
        F.avg(F.when(F.col(source) == "generated", hit)).alias("acc_generated"),
    )
    return both.withColumn("difference", F.col("acc_real") - F.col("acc_generated"))


def critical_classes(scores: DataFrame, counts: DataFrame, below: int, label: str = "true") -> DataFrame:
    """Accuracy of the classes with fewer than ``below`` training rows."""
    rare = counts.where(F.col("n") < below).select(F.col(label), F.col("n").alias("n_train"))
    return scores.join(rare, label)


def size_versus_accuracy(scores: DataFrame, counts: DataFrame, cut: int, label: str = "true") -> DataFrame:
    """Accuracy range of the classes at or above, and below, a training-size cut."""
    joined = scores.join(counts.select(label, F.col("n").alias("n_train")), label)
    side = F.when(F.col("n_train") >= cut, "at_or_above").otherwise("below")
    return joined.groupBy(side.alias("size")).agg(
        F.count(F.lit(1)).alias("n_classes"),
        F.min("accuracy").alias("min_accuracy"),
        F.max("accuracy").alias("max_accuracy"),
        F.avg("accuracy").alias("avg_accuracy"),
    )
