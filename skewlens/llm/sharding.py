"""Sharding by a hierarchical weighted hash tree, in DataFrame expressions only.

A document descends from region to rack to shard. At every level each child draws
``-ln(u) / weight`` with u a hash of the document and the child, and the smallest draw wins,
so children get documents in proportion to their weights. When a weight rises, documents
move only into the subtree whose weight rose; all others stay where they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skewlens.llm.words import fresh
from skewlens.operators.ordering import hash_ordinals


@dataclass(frozen=True)
class Tree:
    """``weights[region][rack][place]``; shards are numbered in this order."""

    weights: tuple[tuple[tuple[float, ...], ...], ...]

    @staticmethod
    def of(shards: int, per_rack: int = 4, racks: int = 2) -> Tree:
        """``shards`` equal shards. Full racks fill full regions, so that the first shard
        beyond them opens a region of its own and takes documents only into itself."""
        left, regions = shards, []
        while left > 0:
            region = []
            while left > 0 and len(region) < racks:
                region.append((1.0,) * min(per_rack, left))
                left -= len(region[-1])
            regions.append(tuple(region))
        return Tree(tuple(regions))

    def shards(self) -> int:
        return sum(len(rack) for region in self.weights for rack in region)


def _draw(key: Column, weight: Column, *node: Column) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(key, *node), 11)
    uniform = (bits.cast("double") + 0.5) / F.lit(float(2**53))
    return F.when(weight > 0, -F.log(uniform) / weight)


def _descend(key: Column, level: str, weights: Column, widest: int, *parents: Column) -> Column:
    """Index of the child with the smallest draw; children beyond the list draw nothing."""
    draws = [
        F.struct(
            _draw(key, F.get(weights, F.lit(i)), F.lit(level), *parents, F.lit(i)).alias("draw"),
            F.lit(i).alias("child"),
        )
        for i in range(widest)
    ]
    drawn = F.filter(F.array(*draws), lambda d: d["draw"].isNotNull())
    return F.array_min(drawn)["child"]


def _nested(values, kind=float) -> Column:
    if not isinstance(values, (tuple, list)):
        return F.lit(kind(values))
    return F.array(*[_nested(v, kind) for v in values])


def with_shard(docs: DataFrame, tree: Tree, key: str = "doc_id", out: str = "shard") -> DataFrame:
    """Adds the shard as a function of the key and the tree alone: no shuffle, no state."""
    regions = tree.weights
    first, number = [], 0
    for region in regions:
        first.append([])
        for rack in region:
            first[-1].append(number)
            number += len(rack)
    per_region = _nested([sum(map(sum, region)) for region in regions])
    per_rack = _nested([[sum(rack) for rack in region] for region in regions])
    k = F.col(key)
    in_region, in_rack, in_place = fresh(docs, "_region", "_rack", "_place")
    return (
        docs.withColumn(in_region, _descend(k, "region", per_region, len(regions)))
        .withColumn(
            in_rack,
            _descend(
                k, "rack", F.get(per_rack, F.col(in_region)), max(map(len, regions)), F.col(in_region)
            ),
        )
        .withColumn(
            in_place,
            _descend(
                k,
                "shard",
                F.get(F.get(_nested(regions), F.col(in_region)), F.col(in_rack)),
                max(len(rack) for region in regions for rack in region),
                F.col(in_region),
                F.col(in_rack),
            ),
        )
        .withColumn(out, (F.get(F.get(_nested(first, int), F.col(in_region)), F.col(in_rack)) + F.col(in_place)).cast("int"))
        .drop(in_region, in_rack, in_place)
    )


def shard(docs: DataFrame, shards: int = 24, grown: bool = True) -> DataFrame:
    """All columns of ``docs`` with size, text_crc32, law, shard, slot and grown_shard.

    ``slot`` numbers the rows of a shard from 0 without gaps, in hashed order; buckets of
    the order are counted first, so no task holds a whole shard. ``grown_shard`` is the
    shard in the tree with one more. Null texts have size 8 and the checksum of no bytes;
    rows without a doc_id share one shard; rows that repeat a doc_id get slots of their own, in any
    order among themselves. Columns of
    ``docs`` that clash with a result are replaced. An empty table gives an empty table.
    """
    text = F.coalesce("text", F.lit("")).cast("binary")
    placed = with_shard(docs.drop("slot", "grown_shard"), Tree.of(shards))
    placed = placed.withColumn("size", F.octet_length(text).cast("long") + 8).withColumn("text_crc32", F.crc32(text))
    placed = placed.withColumn("law", F.lit("key"))
    if grown:
        placed = with_shard(placed, Tree.of(shards + 1), out="grown_shard")
    else:
        placed = placed.withColumn("grown_shard", F.lit(None).cast("int"))
    own = [c for c in placed.columns if c.startswith("_")]  # the order has names of its own
    kept = fresh(placed, *(f"own{c}" for c in own))
    named = placed.withColumnsRenamed(dict(zip(own, kept)))
    slotted = hash_ordinals(named, ["doc_id"], tag="slot", group=["shard"], out="slot")
    return slotted.withColumnsRenamed(dict(zip(kept, own)))
