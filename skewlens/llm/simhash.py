"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints at most ``distance`` bits apart are linked. The 64 bits are grouped into
partitions of correlated bits; partition i gets its own threshold t_i, and as long as the
thresholds sum to ``distance - partitions + 1`` every link agrees in some partition up to
its t_i. A partition with t_i = -1 is not probed at all. Number of partitions and
thresholds come from dynamic programming over estimated candidate counts: they decide the
cost, never the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skewlens.llm.components import components
from skewlens.session import stage

BITS = 64
#: Fingerprints looked at to choose partitions and thresholds. Any choice gives the same links.
PLAN_ROWS = 20_000
#: Ids that may be broadcast, 17 bytes each.
BROADCAST_IDS = 1_000_000
#: Cost of one probe row relative to one candidate to verify: rows are shuffled.
PROBE_COST = 8.0


def text_fingerprint(text: bytes, shingle: int) -> int:
    words = text.lower().split()  # bytes: A-Z only, and exactly the white space of the contract
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(w) + 1 for w in words], out=starts[1:])
    starts = starts.tolist()
    digest = xxhash.xxh64_intdigest
    total = len(words) - shingle + 1
    ones = np.zeros(BITS, np.int64)
    for at in range(0, total, 1 << 16):
        upto = min(at + (1 << 16), total)
        hashes = [digest(joined[starts[i] : starts[i + shingle] - 1], 42) for i in range(at, upto)]
        raw = np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(raw, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, carry..., fp)``: the signed 64-bit fingerprint of every row's whole text.

    A null or blank text has fingerprint 0; a text shorter than a shingle is one shingle.
    """
    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *carry, F.col("text").cast("string").alias("text"))
    names = ["doc_id", *carry, "fp"]

    def of_batches(batches):
        for batch in batches:
            fps = [text_fingerprint((t or "").encode(), shingle) for t in batch["text"].to_pylist()]
            fps = pa.array(np.array(fps, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:-1]), fps], names)

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema.fields[:-1])
    return wanted.mapInArrow(of_batches, f"{ddl}, fp long")


def correlated_groups(bits: np.ndarray, groups: int) -> list[list[int]]:
    """Split the bit positions into ``groups`` of near-equal size, correlated bits together."""
    if len(bits) > 1:
        spread = bits.std(0)
        spread[spread == 0] = 1
        scaled = (bits - bits.mean(0)) / spread
        near = np.abs(scaled.T @ scaled) / len(bits)
    else:
        near = np.eye(bits.shape[1])
    room = [len(x) for x in np.array_split(np.arange(bits.shape[1]), groups)]
    left, out = set(range(bits.shape[1])), []
    for size in room:
        free = sorted(left)
        inner = near[np.ix_(free, free)] - np.eye(len(free))
        group = [free[int(inner.max(1).argmax())]]
        left.discard(group[0])
        while len(group) < size:
            rest = sorted(left)
            group.append(rest[int(near[np.ix_(rest, group)].sum(1).argmax())])
            left.discard(group[-1])
        out.append(sorted(group))
    return out


def _candidates(values: np.ndarray, group: list[int], radius: int, rows: int) -> float:
    """Estimated candidate pairs of a partition at a radius, for ``rows`` fingerprints."""
    if radius < 0:
        return 0.0
    keys = np.zeros(len(values), np.uint64)
    for k, b in enumerate(group):
        keys |= ((values >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    _, n = np.unique(keys, return_counts=True)
    scale = (rows / max(len(values), 1)) ** 2
    # agreeing pairs seen in the sample, at least what evenly spread values would give
    met = max(float((n.astype(float) ** 2).sum() - len(values)) / 2 * scale, rows**2 / 2 / 2.0 ** len(group))
    ball = 1 + sum(_choose(len(group), r) for r in range(1, radius + 1))
    return met * ball


def _choose(n: int, k: int) -> int:
    from math import comb

    return comb(n, k)


def plan(values: np.ndarray, rows: int, distance: int = 3, most: int = 6) -> list[tuple[list[int], int]]:
    """``[(bit positions, threshold)]`` with the least estimated cost."""
    values = values.astype(np.uint64)
    bits = ((values[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(float)
    best, chosen = None, None
    for m in range(2, most + 1):
        groups = correlated_groups(bits, m)
        need = distance - m + 1
        # cost[s]: least cost of the partitions so far whose thresholds sum to s
        cost: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for group in groups:
            after: dict[int, tuple[float, list[int]]] = {}
            for total, (spent, path) in cost.items():
                for t in range(-1, min(distance, 2) + 1):
                    probes = rows * sum(_choose(len(group), r) for r in range(t + 1)) if t >= 0 else 0.0
                    c = spent + _candidates(values, group, t, rows) + PROBE_COST * (probes + rows * (t >= 0))
                    if total + t not in after or c < after[total + t][0]:
                        after[total + t] = (c, [*path, t])
            cost = after
        if need in cost and (best is None or cost[need][0] < best):
            best, chosen = cost[need][0], list(zip(groups, cost[need][1]))
    return chosen


def _mask(group: list[int]) -> int:
    return int(np.array([sum(1 << b for b in group)], np.uint64).view(np.int64)[0])


def _flips(group: list[int], radius: int) -> list[int]:
    from itertools import combinations

    return [_mask(list(c)) for r in range(radius + 1) for c in combinations(group, r)]


def fingerprint_links(distinct: DataFrame, parts: list[tuple[list[int], int]], distance: int) -> DataFrame:
    """``(x, y, a, b)``: every pair of distinct fingerprints at most ``distance`` bits apart,
    with their ids.

    ``distinct`` is ``(fp, rep)`` with each fingerprint once. A pair is verified in the join
    and kept only at the first partition in which it agrees, so no pair comes twice and no
    other pair leaves the join.
    """
    probed = [(i, g, t) for i, (g, t) in enumerate(parts) if t >= 0]
    fp = F.col("fp")

    def entries(radius_of) -> Column:
        return F.concat(
            *[
                F.array(
                    *[
                        F.struct(F.lit(i).alias("part"), fp.bitwiseAND(_lit(_mask(g))).bitwiseXOR(_lit(x)).alias("key"))
                        for x in _flips(g, radius_of(t))
                    ]
                )
                for i, g, t in probed
            ]
        )

    left = distinct.select(fp.alias("x"), F.col("rep").alias("a"), F.explode(entries(lambda t: t)).alias("e"))
    right = distinct.select(fp.alias("y"), F.col("rep").alias("b"), F.explode(entries(lambda t: 0)).alias("e"))
    left = left.select("x", "a", "e.part", "e.key")
    right = right.select("y", "b", F.col("e.part").alias("part2"), F.col("e.key").alias("key2"))
    differ = F.col("x").bitwiseXOR(F.col("y"))
    match = (
        (F.col("part") == F.col("part2"))
        & (F.col("key") == F.col("key2"))
        & (F.col("x") < F.col("y"))
        & (F.bit_count(differ) <= distance)
    )
    for j, g, t in probed[:-1]:
        match &= (F.col("part") <= j) | (F.bit_count(differ.bitwiseAND(_lit(_mask(g)))) > t)
    return left.join(right, match).select("x", "y", "a", "b")


def _lit(value: int) -> Column:
    return F.lit(value).cast("long")


def _classified(docs: DataFrame, shingle: int, distance: int) -> DataFrame:
    """``(doc_id, text_key, fp, cluster, component_id)`` of every row; ``cluster`` names the
    component by a fingerprint, as two components may share their smallest doc_id. Links and components run over
    fingerprints, so different texts under one doc_id do not link their groups."""
    keyed = docs.select("doc_id", "text", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_key"))
    prints = stage(fingerprints(keyed, shingle, ["text_key"]), "fingerprints")
    distinct = stage(
        prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "distinct-fp"
    )
    usable = distinct.where("rep IS NOT NULL").select("fp", "rep")
    rows = usable.count()
    every = max(1, rows // PLAN_ROWS)
    looked = usable.where(F.pmod(F.xxhash64("fp"), F.lit(every)) == 0).limit(2 * PLAN_ROWS).select("fp").toArrow()
    parts = plan(looked["fp"].to_numpy().view(np.uint64), rows, distance)
    links = fingerprint_links(usable, parts, distance)
    linked = components(links.select(F.col("x").alias("a"), F.col("y").alias("b")))
    least = distinct.join(linked, distinct["fp"] == linked["node"]).groupBy("component").agg(F.min("rep").alias("least"))
    classes = distinct.join(linked, distinct["fp"] == linked["node"], "left").join(least, "component", "left")
    classes = classes.select("fp", F.coalesce("component", "fp").alias("cluster"), F.coalesce("least", "rep").alias("component_id"))
    return prints.join(classes, "fp").select("doc_id", "text_key", "fp", "cluster", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 3) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row of ``docs`` (columns doc_id, text).

    component_id is the smallest doc_id reachable over links. Rows without a doc_id keep
    their fingerprint and take the component of equal fingerprints, but link no others.
    Repeated rows stay; different texts under one doc_id are rows of their own. Equal
    fingerprints are folded before anything is paired, so a group of copies costs one row.
    An empty table gives an empty table.
    """
    return _classified(docs, shingle, distance).select("doc_id", "fp", "component_id")


def hex_digits(fp: str = "fp") -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def one_of_each(docs: DataFrame, shingle: int = 3, distance: int = 3) -> DataFrame:
    """Rows of ``docs`` with one document of each near-duplicate group: the smallest doc_id,
    and where that has several texts of the group, one of them.

    Rows without a doc_id stay. Of rows that repeat a kept one exactly one stays; another text
    under a kept doc_id stays if its own group keeps it. What goes is told by doc_id and a
    hash of the text, broadcast up to ``BROADCAST_IDS`` of them and joined beyond, so the
    texts are shuffled only where there are too many.
    """
    found = _classified(docs, shingle, distance).where("doc_id IS NOT NULL")
    texts = stage(
        found.groupBy("doc_id", "text_key", "fp", "cluster", "component_id").agg(F.count(F.lit(1)).alias("_n")), "texts"
    )
    name = F.struct("doc_id", "fp", "text_key")
    keepers = texts.where(F.col("doc_id") == F.col("component_id")).groupBy("cluster").agg(F.min(name).alias("_k"))
    ids = texts.join(keepers, "cluster", "left").withColumn("_keep", F.coalesce(name == F.col("_k"), F.lit(False)))
    ids = ids.where("NOT _keep OR _n > 1").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "_keep")
    ids = stage(ids, "odd-texts")
    own = docs["doc_id"].cast("long"), F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    at = lambda odd: (own[0] == odd["_id"]) & (own[1] == odd["_key"])
    repeated = ids.where("_keep")
    if ids.count() <= BROADCAST_IDS:
        ids, repeated = F.broadcast(ids), F.broadcast(repeated)
    rest = docs.join(ids, at(ids), "left_anti")
    again = docs.join(repeated, at(repeated), "left_semi")
    place = "_text"
    while place in docs.columns:
        place += "_"
    again = again.withColumn(place, F.struct(*[c.alias(n) for c, n in zip(own, ("doc_id", "text_key"))]))
    return rest.unionByName(again.dropDuplicates([place]).drop(place))
