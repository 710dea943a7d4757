"""Approximate neighbour search for large classes: random-projection buckets, multi-probe,
exact re-rank.

A table of the index cuts a class along a few orthonormal random directions, each at the
median of the class, so buckets hold about as many rows each. A query looks into its own
bucket and those it would most easily have fallen into: the ones across the nearest cuts.
How many, and in how many tables, is measured on some queries of the class, whose true
neighbours are found by a full search: the cheapest choice that reaches the wanted recall
there. All rows are indexed; distances of all candidates are exact.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skewlens.operators import neighbors as nb
from skewlens.operators.ordering import selected, with_digest
from skewlens.session import pin, stage

#: Rows a bucket should hold.
BUCKET_ROWS = 4096
#: Directions of a table at most, and numbers of tables to choose from.
MOST_CUTS, TABLES = 12, (1, 2, 4, 8)
#: Rows of a class from which its medians are taken, and queries its recall is measured on.
SAMPLE_ROWS, MEASURED = 2000, 128


class Cuts:
    """Directions and cut points of all tables of one class."""

    def __init__(self, sample: np.ndarray, cuts: int, seed: int):
        d = sample.shape[1]
        random = np.random.default_rng(seed)
        self.cuts = min(cuts, d)
        tables = [np.linalg.qr(random.standard_normal((d, self.cuts)))[0] for _ in range(max(TABLES))]
        self.directions = np.stack(tables)  # tables x elements x cuts
        self.at = np.stack([np.median(sample @ t, axis=0) for t in tables])
        self.tables, self.probes = 1, 1
        masks = np.arange(1 << self.cuts)
        self.bits = ((masks[:, None] >> np.arange(self.cuts)) & 1).astype(float)

    def margins(self, x: np.ndarray, table: int) -> np.ndarray:
        return x @ self.directions[table] - self.at[table]

    def codes(self, x: np.ndarray, table: int) -> np.ndarray:
        return ((self.margins(x, table) > 0) << np.arange(self.cuts)).sum(axis=1)

    def probed(self, x: np.ndarray, table: int) -> np.ndarray:
        """Codes of the buckets to visit, nearest first (rows x probes)."""
        margins = self.margins(x, table)
        own = ((margins > 0) << np.arange(self.cuts)).sum(axis=1)
        away = (margins * margins) @ self.bits.T
        if self.probes < away.shape[1]:
            masks = np.argpartition(away, self.probes - 1, axis=1)[:, : self.probes]
        else:
            masks = np.broadcast_to(np.arange(away.shape[1]), away.shape)
        return own[:, None] ^ masks

    def choose(self, queries: np.ndarray, found: np.ndarray, wanted: float) -> float:
        """Set the cheapest tables and probes that meet ``wanted`` of the pairs
        (query, true neighbour); the recall they have."""
        ranks = np.empty((len(queries), max(TABLES)), np.int64)
        for t in range(max(TABLES)):
            margins = self.margins(queries, t)
            own = ((margins > 0) << np.arange(self.cuts)).sum(axis=1)
            flips = own ^ self.codes(found, t)
            for k in range(0, len(queries), 512):
                some = slice(k, k + 512)
                away = (margins[some] ** 2) @ self.bits.T
                mine = away[np.arange(len(away)), flips[some]]
                ranks[some, t] = (away <= mine[:, None]).sum(axis=1)
        best = None
        for tables in TABLES:
            need = np.sort(ranks[:, :tables].min(axis=1))
            probes = int(need[min(len(need) - 1, math.ceil(wanted * len(need)) - 1)]) if len(need) else 1
            if best is None or tables * probes < best[0]:
                best = (tables * probes, tables, probes, float((need <= probes).mean()) if len(need) else 1.0)
        _, self.tables, self.probes, recall = best
        return recall


def _sampled(points: DataFrame, label: str, classes: DataFrame, rows: int, seed: int) -> DataFrame:
    quotas = pin(classes.select(label, F.least("_n", F.lit(rows)).cast("long").alias("quota")), name="sample-quotas")
    some = points.join(quotas.select(label), label)
    hashed = with_digest(some, ["_vid"], seed, "lsh-sample")
    return selected(hashed, [label], "_hash", quotas).where("_in").drop("_in")


def build(points: DataFrame, counts: DataFrame, label: str, need: int, recall: float, bucket_rows: int, seed: int) -> dict:
    """{class: cuts} for the classes of more than two buckets, their probes chosen."""
    large = pin(counts.where(F.col("_n") > 2 * bucket_rows), name="large-classes")
    if large.head() is None:
        return {}
    sample = stage(_sampled(points, label, large, SAMPLE_ROWS, seed), "sample")
    sizes = {r[label]: r["_n"] for r in large.collect()}
    table = sample.select(label, "_hash", "_vid", "_vec").toArrow().combine_chunks()
    vectors, hashes, vids = nb._matrix(table["_vec"]), np.array(table["_hash"].to_pylist()), table["_vid"].to_numpy()
    found, asked = {}, []
    for key, mine in nb.rows_by_class(table[label].combine_chunks()):
        cuts = min(MOST_CUTS, max(1, round(math.log2(sizes[key] / bucket_rows))))
        found[key] = Cuts(vectors[mine], cuts, seed)
        asked += [(key, int(v)) for v in vids[mine[np.argsort(hashes[mine])][:MEASURED]]]
    # true neighbours of the measured queries, by a full search of their classes
    names = points.sparkSession.createDataFrame(asked, T.StructType([points.schema[label], T.StructField("_vid", T.LongType())]))
    whole = points.join(pin(large.select(label)), label).withColumn("_cell", F.lit(0))
    queries = whole.join(names, [label, "_vid"], "left_semi")
    blocks = nb._blocks(queries, whole, label, nb.BLOCK_ROWS)
    true = nb._best(nb._block_search(queries, whole, blocks, label, need), label, need)
    owners = points.select(label, F.explode("_ids").alias("_nid"), F.col("_vec").alias("_nvec"))
    pairs = (
        true.join(owners, [label, "_nid"])
        .join(queries.select(label, "_vid", "_vec"), [label, "_vid"])
        .where(F.col("_dist") > 0)
        .select(label, "_vec", "_nvec")
        .toArrow()
        .combine_chunks()
    )
    if pairs.num_rows:
        left, right = nb._matrix(pairs["_vec"]), nb._matrix(pairs["_nvec"])
        for key, mine in nb.rows_by_class(pairs[label].combine_chunks()):
            found[key].choose(left[mine], right[mine], recall)
    return found


def _routed(rows: DataFrame, label: str, index: dict, probe: bool) -> DataFrame:
    """Rows once for every bucket they stand in (or, with ``probe``, look into) as ``_cell``."""
    schema = T.StructType([f for f in rows.schema.fields if f.name != "_cell"] + [T.StructField("_cell", T.IntegerType())])
    names = [f.name for f in schema.fields]

    def route(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            vectors = nb._matrix(pa.chunked_array([batch.column("_vec")]))
            at, cells = [], []
            for key, mine in nb.rows_by_class(batch.column(label)):
                if key not in index:
                    at.append(mine)
                    cells.append(np.zeros(len(mine), np.int64))
                    continue
                cuts = index[key]
                for t in range(cuts.tables):
                    for k in range(0, len(mine), 1024):
                        some = mine[k : k + 1024]
                        codes = cuts.probed(vectors[some], t) if probe else cuts.codes(vectors[some], t)[:, None]
                        at.append(np.repeat(some, codes.shape[1]))
                        cells.append((codes + (t << cuts.cuts)).ravel())
            take = pa.array(np.concatenate(at))
            columns = [batch.column(n).take(take) for n in names[:-1]]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(np.concatenate(cells).astype(np.int32))], names)

    return rows.mapInArrow(route, schema)


def search(
    queries: DataFrame, points: DataFrame, counts: DataFrame, label: str, need: int, recall: float, bucket_rows: int, block_rows: int, seed: int
) -> DataFrame:
    """``(label, _vid, _nid, _dist)``: candidates of every query with exact distances, the
    nearest of each bucket it looks into; each candidate once."""
    index = build(points, counts, label, need, recall, bucket_rows, seed)
    points = stage(_routed(points, label, index, False), "buckets")
    queries = stage(_routed(queries, label, index, True), "probes")
    blocks = nb._blocks(queries, points, label, block_rows)
    found = nb._block_search(queries, points, blocks, label, need)
    return found.groupBy(label, "_vid", "_nid").agg(F.min("_dist").alias("_dist"))
