"""Mixing sources to target weights by entropy balancing.

Of all document rates that take the target words from every source, the ones nearest to
"each document once" (least relative entropy, measured in words) are exponentially tilted:
``rate = exp(lambda of the source)``. The lambdas solve a convex dual, found by Newton's
iteration over the source totals. Rates are then rounded into whole copies so that the
words taken from a source come out within about one short document of its target.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skewlens.functions.hashing import hash_hex, uniform_of
from skewlens.llm.words import WORD, fresh
from skewlens.operators.ordering import sorted_ordinals
from skewlens.session import pin, stage

#: No document may be taken more often than this.
MOST_COPIES = 3.0
#: Documents of one source and size that are ranked together.
RANK_ROWS = 8192
#: Columns of the result, beside those of the documents.
RESULTS = ("size", "source_size", "target", "copies", "taken")
#: Bytes of (source, size) classes that may be broadcast: CLASS_BYTES each and the source's name.
BROADCAST_BYTES, CLASS_BYTES = 24 << 20, 256


def source_totals(sized: DataFrame) -> DataFrame:
    """``(source, source_size, weight)``; sources in code point order, null last, weigh 1, 2, 3 in turn."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = sorted_ordinals(totals, [F.col("source").asc_nulls_last()], "_rank")
    return ranked.select("source", "source_size", (F.col("_rank") % 3 + 1).cast("double").alias("weight"))


def with_targets(sources: DataFrame, most: float = MOST_COPIES) -> DataFrame:
    """Adds ``target``: all words shared by weight, none above ``most`` times its source.

    Words per weight only rise while capped sources leave the sharing, so the loop ends
    after as many passes over the source totals as it has waves of capped sources.
    """
    cap = most * F.col("source_size")
    level = 0.0
    while True:
        capped = F.col("weight") * level >= cap
        row = sources.agg(
            F.sum("source_size").cast("double"),
            F.sum(F.when(capped, cap).otherwise(0.0)),
            F.sum(F.when(capped & (F.lit(level) > 0), 0.0).otherwise(F.col("weight"))),
        ).head()
        free = (row[0] or 0.0) - (row[1] or 0.0 if level > 0 else 0.0)
        now = max(free, 0.0) / row[2] if row[2] else level
        if now <= level * (1 + 1e-12):
            return sources.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)))
        level = now


def balance(sources: DataFrame, rounds: int = 60, near: float = 1e-12) -> DataFrame:
    """Adds ``lambda``, the solution of the dual: source_size * exp(lambda) = target.

    The dual is the sum of ``size * exp(lambda) - lambda * target`` over the sources. Its
    Hessian is diagonal, so a Newton step is a column expression over a table with one row
    per source, however many there are. Steps are limited to 1, which keeps the iteration
    from overshooting where the tilt is strong. Sources with nothing to take get null.
    """
    state = sources.withColumn(
        "lambda", F.when((F.col("target") > 0) & (F.col("source_size") > 0), F.lit(0.0))
    )
    mass = F.col("source_size") * F.exp("lambda")
    for _ in range(rounds):
        state = pin(state, name="dual")
        worst = state.agg(F.max(F.abs(mass / F.col("target") - 1))).head()[0]
        if worst is None or worst <= near:
            return state
        step = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("target") - mass) / mass))
        state = state.withColumn("lambda", F.col("lambda") + step)
    raise RuntimeError("the dual has not settled")


def _extras(sizes: pd.DataFrame) -> pd.DataFrame:
    """How many documents of each size get one copy more, from the longest down.

    ``owed`` words are carried to the next size. A count is taken only if the shorter
    documents can still even out what it leaves owed or overdrawn.
    """
    sizes = sizes.sort_values("size", ascending=False)
    words = (sizes["size"] * sizes["n"]).astype(float)
    shorter = (words[::-1].cumsum()[::-1] - words).tolist()
    owed, extra = 0.0, []
    for size, n, part, rest in zip(sizes["size"].tolist(), sizes["n"].tolist(), sizes["part"].tolist(), shorter):
        owed += part * size * n
        low = math.ceil((owed - (1 - part) * rest) / size - 1e-9)
        high = math.floor((owed + part * rest) / size + 1e-9)
        count = round(owed / size)
        if low <= high:
            count = min(max(count, low), high)
        extra.append(min(max(count, 0), n) if part > 0 else 0)
        owed -= extra[-1] * size
    return sizes.assign(extra=extra)


def copy_classes(sized: DataFrame, most: float = MOST_COPIES, seed: int = 42) -> DataFrame:
    """``(source, size, source_size, target, copies, cutoff)`` for every size of every source.

    ``sized`` is ``(doc_id, source, size)``. Documents take ``copies``, and one more where
    their digest is at most ``cutoff``. Documents of one source and size are alike to the
    mix, so the rounding works on these classes: at most as many per source as its longest
    document has words. Only classes of which a part is chosen look at their documents, in
    buckets of bounded size.
    """
    classes = stage(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "classes")
    weighed = classes.withColumn("size", F.col("size") * F.col("n"))
    sources = balance(with_targets(stage(source_totals(weighed), "sources"), most))
    rate = F.coalesce(F.least(F.exp("lambda"), F.lit(most)), F.lit(0.0))
    nearest = F.round(rate)
    rate = F.when(F.abs(rate - nearest) < 1e-9, nearest).otherwise(rate)
    rated = sources.select(
        F.col("source").alias("_source"), "source_size", "target", rate.alias("rate")
    )
    classes = classes.join(rated, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    classes = classes.withColumn("copies", F.floor("rate").cast("long")).withColumn("part", F.col("rate") - F.col("copies"))
    columns = "source string, size long, n long, source_size long, target double, copies long, part double"
    rounded = (
        classes.where("size > 0")
        .selectExpr("source", "size", "n", "source_size", "target", "copies", "part")
        .groupBy("source")
        .applyInPandas(_extras, f"{columns}, extra long")
    )
    none = classes.where("size = 0").selectExpr(
        "source", "size", "n", "source_size", "target", "copies", "part", "0L AS extra"
    )
    classes = stage(rounded.unionByName(none), "rounded").withColumn(
        "buckets", F.greatest(F.lit(1), F.ceil(F.col("n") / RANK_ROWS)).cast("long")
    )
    split = classes.where("extra > 0 AND extra < n").select(
        F.struct("source", "size").alias("class"), "extra", "buckets"
    )
    digest = copy_digest(seed)
    open_docs = sized.select(F.struct("source", "size").alias("class"), digest.alias("digest")).join(split, "class")
    open_docs = open_docs.withColumn("bucket", F.floor(uniform_of(F.col("digest")) * F.col("buckets")))
    in_bucket = open_docs.groupBy("class", "bucket").agg(F.count(F.lit(1)).alias("m"))
    running = Window.partitionBy("class").orderBy("bucket")
    ahead = in_bucket.withColumn("ahead", F.sum("m").over(running) - F.col("m")).drop("m")
    placed = open_docs.join(ahead, ["class", "bucket"]).withColumn(
        "place", F.row_number().over(Window.partitionBy("class", "bucket").orderBy("digest"))
    )
    cuts = placed.where(F.col("ahead") + F.col("place") == F.col("extra")).select("class", "digest")
    cutoff = F.when(F.col("extra") >= F.col("n"), F.lit("g")).otherwise(F.coalesce("digest", F.lit("")))
    return (
        classes.withColumn("class", F.struct("source", "size"))
        .join(cuts, "class", "left")
        .select("source", "size", "source_size", "target", "copies", cutoff.alias("cutoff"))
    )


def copy_digest(seed: int = 42) -> Column:
    return hash_hex(seed, "mix", F.col("doc_id"))


def with_copies(docs: DataFrame, most: float = MOST_COPIES, seed: int = 42) -> DataFrame:
    """All columns of ``docs`` with size, source_size, target, copies and taken.

    A null text has no words and is taken as often as its source's rate says, which adds
    none. Rows that repeat a doc_id are taken alike. The choice hangs on a hash of the
    doc_id, so reruns agree. Columns of ``docs`` that clash with a result are replaced. An
    empty table gives an empty table.
    """
    wanted = [c for c in docs.columns if c.lower() not in RESULTS]
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = docs.select(*wanted, size.alias("size"))
    slim = sized.select("doc_id", F.col("source").cast("string").alias("source"), "size")
    classes = stage(copy_classes(stage(slim, "sizes"), most, seed), "copy-classes")
    rows, names = classes.agg(F.count(F.lit(1)), F.sum(F.octet_length("source"))).head()
    small = CLASS_BYTES * rows + (names or 0) <= BROADCAST_BYTES
    kind, base, cutoff = fresh(docs, "_class", "_base", "_cutoff")
    classes = classes.select(
        F.struct("source", "size").alias(kind),
        "source_size",
        "target",
        F.col("copies").alias(base),
        F.col("cutoff").alias(cutoff),
    )
    sized = sized.withColumn(kind, F.struct(F.col("source").cast("string").alias("source"), "size"))
    met = sized.join(F.broadcast(classes) if small else classes, kind)
    more = F.when(copy_digest(seed) <= F.col(cutoff), F.lit(1)).otherwise(F.lit(0))
    copies = (F.col(base) + more).cast("long")
    return met.withColumn("copies", copies).select(
        *wanted, "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken")
    )


def mixed(docs: DataFrame, most: float = MOST_COPIES, seed: int = 42) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as it is taken."""
    times, copy = fresh(docs, "_times", "_copy")
    own = [c for c in docs.columns if c.lower() in RESULTS]
    kept = docs.withColumnsRenamed(dict(zip(own, renamed := fresh(docs, *(f"_own_{c}" for c in own)))))
    taken = with_copies(kept, most, seed).where("copies > 0").withColumnRenamed("copies", times)
    taken = taken.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times).cast("int")))).drop(*RESULTS)
    return taken.withColumnsRenamed(dict(zip(renamed, own))).select(*docs.columns)
