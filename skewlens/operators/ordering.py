"""Exact ranks in keyed-hash order without sorting a class in one task.

A row's place in the shuffled order is the order of its md5 digest. Digests spread
evenly, so a prefix of hex digits splits any class, however large, into buckets of
known size; only bucket counts are accumulated, and rows are sorted bucket by bucket.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skewlens.functions.hashing import hash_hex
from skewlens.session import local_table, pin, stage

#: Hex digits per level: 16**3 = 4096 buckets.
DIGITS = 3
#: Rows a bucket may hold before it is split by further digits.
BUCKET_ROWS = 8192
HEX_LENGTH = 32


def with_digest(df: DataFrame, key: list[str], seed: int, tag: str, out: str = "_hash") -> DataFrame:
    return df.withColumn(out, hash_hex(seed, tag, *key))


def _bucket_counts(df: DataFrame, group: list[str], digest: str, digits: int) -> DataFrame:
    return df.groupBy(*group, F.substring(digest, 1, digits).alias("_bucket")).agg(
        F.count(F.lit(1)).alias("_n")
    )


def hash_cutoffs(
    df: DataFrame, group: list[str], digest: str, quotas: DataFrame, histogram: DataFrame | None = None
) -> DataFrame:
    """Digest of the quota-th row of every group: ``(group..., cutoff, take, tied)``.

    ``quotas`` is ``(group..., quota)`` with quota >= 1. The first ``quota`` rows of the
    group are then those with ``digest < cutoff`` and ``take`` of the ``tied`` rows that
    have the cut-off digest itself (one of one where digests are unique), so a selection is
    a filter and the rows themselves are never moved. Each pass counts buckets (map-side)
    and keeps the one bucket per group that holds the quota; the next pass looks only
    inside it, until it is small enough to be ranked or its digests are all equal.
    """
    digits, parent = DIGITS, None
    rows = df.select(*group, digest)
    state = quotas.select(*group, F.col("quota").cast("long").alias("_left"))
    buckets = histogram if histogram is not None else _bucket_counts(rows, group, digest, digits)
    while True:
        state = _cut_bucket(buckets, group, state, digits, parent)
        largest = state.agg(F.max("_n")).head()[0]
        inside = _join_state(rows, group, state, F.substring(digest, 1, digits))
        if largest is None or largest <= BUCKET_ROWS or digits >= HEX_LENGTH:
            break
        parent, digits = digits, min(digits + DIGITS, HEX_LENGTH)
        buckets = _bucket_counts(inside.select(*group, digest), group, digest, digits)
    place = Window.partitionBy(*group, "_prefix").orderBy(digest)
    steps = inside.groupBy(*group, "_prefix", "_left", digest).agg(F.count(F.lit(1)).alias("_n"))
    before = F.col("_upto") - F.col("_n")
    return pin(
        steps.withColumn("_upto", F.sum("_n").over(place))
        .where((F.col("_upto") >= F.col("_left")) & (before < F.col("_left")))
        .select(*group, F.col(digest).alias("cutoff"), (F.col("_left") - before).alias("take"), F.col("_n").alias("tied")),
        name="cutoffs",
    )


def selected(
    hashed: DataFrame, group: list[str], digest: str, quotas: DataFrame, histogram: DataFrame | None = None, out: str = "_in"
) -> DataFrame:
    """``hashed`` with the boolean ``out``: is the row among the first ``quota`` of its group?

    Rows of equal digest (repeated keys) that straddle a cut-off take the places left in
    an order of their own, by a hash of all columns and of where they stand; equal rows may
    stand for each other. Groups without a quota have no rows selected.
    """
    cuts = hash_cutoffs(hashed, group, digest, quotas, histogram)
    split = cuts.where(F.col("take") < F.col("tied"))
    columns = [F.col(c) for c in hashed.columns]
    if group:
        renamed = cuts.select(*[F.col(g).alias(f"_c_{g}") for g in group], "cutoff", (F.col("take") < F.col("tied")).alias("_split"))
        match = F.lit(True)
        for g in group:
            match = match & F.col(g).eqNullSafe(F.col(f"_c_{g}"))
        placed = hashed.join(renamed, match, "left")
    else:
        cut = cuts.head()
        values = (cut["cutoff"], cut["take"] < cut["tied"]) if cut else (None, None)
        placed = hashed.withColumn("cutoff", F.lit(values[0])).withColumn("_split", F.lit(values[1]).cast("boolean"))
    straddles = F.coalesce(F.col("_split") & (F.col(digest) == F.col("cutoff")), F.lit(False))
    inside = F.coalesce(F.col(digest) <= F.col("cutoff"), F.lit(False))
    plain = placed.where(~straddles).select(*columns, inside.alias(out))
    if split.head() is None:
        return plain
    tied = stage(
        placed.where(straddles)
        .select(*columns)
        .withColumn("_tie", F.md5(F.concat_ws(":", F.xxhash64(*hashed.columns), F.monotonically_increasing_id()))),
        "ties",
    )
    left = split.select(*group, F.col("take").alias("quota"))
    again = selected(tied, group, "_tie", left, None, out).drop("_tie")
    return plain.unionByName(again)


def _join_state(rows: DataFrame, group: list[str], state: DataFrame, prefix: Column) -> DataFrame:
    """Rows of each group whose digest starts with the group's current prefix."""
    renamed = state.select(*[F.col(g).alias(f"_s_{g}") for g in group], "_prefix", "_left")
    match = prefix == F.col("_prefix")
    for g in group:
        match = match & F.col(g).eqNullSafe(F.col(f"_s_{g}"))
    return rows.join(renamed, match).drop(*[f"_s_{g}" for g in group])


def _cut_bucket(
    buckets: DataFrame, group: list[str], state: DataFrame, digits: int, parent: int | None
) -> DataFrame:
    """The bucket of each group in which its remaining quota ends, with the rows still
    to take there."""
    if parent is not None:
        placed = _join_state(buckets, group, state, F.substring("_bucket", 1, parent)).drop("_prefix")
    elif group:
        renamed = state.select(*[F.col(g).alias(f"_s_{g}") for g in group], "_left")
        match = None
        for g in group:
            same = F.col(g).eqNullSafe(F.col(f"_s_{g}"))
            match = same if match is None else match & same
        placed = buckets.join(renamed, match)
    else:
        placed = buckets.withColumn("_left", F.lit(state.head()["_left"]))
    running = Window.partitionBy(*group).orderBy("_bucket")
    before = F.col("_upto") - F.col("_n")
    return pin(
        placed.withColumn("_upto", F.sum("_n").over(running))
        .where((F.col("_upto") >= F.col("_left")) & (before < F.col("_left")))
        .select(*group, F.col("_bucket").alias("_prefix"), (F.col("_left") - before).alias("_left"), "_n"),
        name="cut-buckets",
    )


def _offsets(counts: DataFrame, group: list[str], digits: int) -> DataFrame:
    """Rows ahead of every bucket. Windows span one parent bucket, at most 4096 rows."""
    inner = Window.partitionBy(*group, "_parent").orderBy("_bucket")
    shorter = max(digits - DIGITS, 0)
    counts = counts.withColumn("_parent", F.substring("_bucket", 1, shorter))
    ahead = counts.withColumn("_ahead", F.sum("_n").over(inner) - F.col("_n"))
    if shorter == 0:
        return ahead.drop("_parent", "_n")
    parents = counts.groupBy(*group, "_parent").agg(F.sum("_n").alias("_n"))
    parents = _offsets(parents.withColumnRenamed("_parent", "_bucket"), group, shorter)
    parents = parents.select(
        *[F.col(g).alias(f"_p_{g}") for g in group],
        F.col("_bucket").alias("_p_bucket"),
        F.col("_ahead").alias("_p_ahead"),
    )
    match = F.col("_parent") == F.col("_p_bucket")
    for g in group:
        match = match & F.col(g).eqNullSafe(F.col(f"_p_{g}"))
    return ahead.join(parents, match).select(
        *group, "_bucket", (F.col("_ahead") + F.col("_p_ahead")).alias("_ahead")
    )


def hash_ordinals(
    df: DataFrame,
    key: list[str],
    seed: int = 42,
    tag: str = "order",
    group: list[str] | None = None,
    out: str = "pos",
) -> DataFrame:
    """Position 0, 1, 2, ... of every row in the shuffled order (of its group).

    ``key`` must identify a row. One count per bucket, one shuffle of the rows by
    bucket; the number of prefix digits follows the largest group.
    """
    group = group or []
    hashed = with_digest(df, key, seed, tag)
    top = pin(_bucket_counts(hashed, group, "_hash", DIGITS), name="buckets")
    largest = top.agg(F.max("_n")).head()[0] or 0
    digits = DIGITS
    if largest > BUCKET_ROWS:
        digits = min(DIGITS + math.ceil(math.log(largest / BUCKET_ROWS, 16)), HEX_LENGTH)
    counts = top if digits == DIGITS else _bucket_counts(hashed, group, "_hash", digits)
    # One key for ranking and for the offsets: the rows are shuffled by it once, for both.
    # Structs compare null fields as equal, so null groups keep their rows.
    ahead = _offsets(counts, group, digits)
    ahead = ahead.select(F.struct(*group, "_bucket").alias("_slot"), "_ahead")
    slot = F.struct(*group, F.substring("_hash", 1, digits).alias("_bucket"))
    ranked = hashed.withColumn("_slot", slot).withColumn(
        "_rank", F.row_number().over(Window.partitionBy("_slot").orderBy("_hash"))
    )
    return ranked.join(ahead, "_slot").select(
        *[F.col(c) for c in df.columns],
        (F.col("_ahead") + F.col("_rank") - 1).cast("long").alias(out),
    )


def first_in_order(
    df: DataFrame, key: list[str], n: int, seed: int = 42, tag: str = "order"
) -> DataFrame:
    """The first ``n`` rows of the shuffled order, as a filter on the digest."""
    hashed = with_digest(df, key, seed, tag)
    histogram = pin(_bucket_counts(hashed, [], "_hash", DIGITS), name="buckets")
    available = histogram.agg(F.sum("_n")).head()[0] or 0
    if n >= available:
        return df
    quotas = local_table(df.sparkSession, [(int(n),)], "quota long")
    return selected(hashed, [], "_hash", quotas, histogram).where("_in").select(*df.columns)


def minibatches(
    df: DataFrame,
    key: list[str],
    size: int = 256,
    epoch: int = 0,
    seed: int = 42,
    out: str = "batch_id",
) -> DataFrame:
    """Shuffled pass over the rows in batches of ``size``; the last may be short."""
    ordered = hash_ordinals(df, key, seed, f"epoch{epoch}", out="_pos")
    return ordered.withColumn(out, F.floor(F.col("_pos") / size).cast("long")).withColumn(
        "pos", F.col("_pos") % size
    ).drop("_pos")


def first_batches(
    df: DataFrame,
    key: list[str],
    stop_after: int = 100,
    size: int = 256,
    epoch: int = 0,
    seed: int = 42,
) -> DataFrame:
    """Rows of batches 0..``stop_after`` inclusive: a loop that tests its stop index
    after taking a batch sees ``stop_after + 1`` batches."""
    return first_in_order(df, key, (stop_after + 1) * size, seed, f"epoch{epoch}")


def sorted_ordinals(df: DataFrame, order: list[Column], out: str = "pos") -> DataFrame:
    """Position 0, 1, 2, ... of every row in sorted order, without one task seeing all rows.

    Rows are dealt into ranges and staged; only the row counts of the ranges are added up
    in one window, and each range is sorted by itself. Give rows that sort apart: equal
    rows take their positions in any order.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id())
    ranged = stage(ranged, "ranges")
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    ahead = counts.select(
        "_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_ahead")
    )
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return ranged.withColumn("_place", place).join(ahead, "_range").select(
        *df.columns, (F.col("_ahead") + F.col("_place")).cast("long").alias(out)
    )


def expand_counts(df: DataFrame, n: str, out: str, chunk: int = 100_000) -> DataFrame:
    """Repeat every row ``n`` times with ordinals 0..n-1 in ``out``.

    Rows open into chunks first and the chunks are dealt over the cluster, so one
    large count does not unfold inside a single task.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = df.where(F.col(n) > 0).withColumn(
        "_from", F.explode(F.expr(f"sequence(0L, cast({n} as bigint) - 1, {chunk}L)"))
    )
    return (
        chunks.repartition(parts)
        .withColumn(
            out,
            F.explode(
                F.expr(f"sequence(_from, least(_from + {chunk}L, cast({n} as bigint)) - 1)")
            ),
        )
        .drop("_from")
    )
