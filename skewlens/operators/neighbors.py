"""K nearest neighbours inside each class: exact, or by an index where asked for.

The search never lists the pairs of a class. Identical vectors are folded to one row
(of a group of copies only the k+1 smallest ids can ever be an answer). Large classes
are cut into cells: Voronoi cells around pivot rows, or, where vectors are narrow, the
boxes of a tree of cuts, which a row finds in as many steps as the tree is deep. A query
searches its own cell first, and the distance found there bounds which other cells can
still hold a neighbour. How many
cells stay open is measured on some queries of the class: where vectors do not cluster the
bounds exclude little, and the class is searched as a whole instead. Queries and
candidates meet block by block and only k+1 answers per query leave a block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skewlens.functions.hashing import hash_hex
from skewlens.functions.vectors import as_doubles
from skewlens.operators.ordering import selected, with_digest
from skewlens.session import pin, stage

#: Rows a cell should hold, and how many cells' worth of rows a class needs
#: before cutting it up pays for itself.
CELL_ROWS = 4096
WORTH_CUTTING = 8
#: Rows of either side that meet in one task: at least, and bytes of vectors at most.
BLOCK_ROWS = 4096
BLOCK_BYTES = 64 * 1024 * 1024
#: Queries of a class whose open cells are counted, and the share of open cells beyond
#: which cells do not pay.
PROBED = 512
MAX_OPEN = 0.5
#: Vectors up to this width are cut into boxes, by so many rows a cell.
BOX_WIDTH, BOX_SAMPLE = 8, 8
#: Parts over which the rows of one group of copies are spread, from so many rows on.
COPY_SALTS, COPY_ROWS = 64, 100_000
#: Bytes of pivot vectors a task may be given.
PIVOT_BYTES = 64 * 1024 * 1024
#: Candidate pairs whose exact distance is computed at once.
PAIR_CHUNK = 100_000


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    values = pa.concat_arrays([chunk.flatten() for chunk in column.chunks])
    return values.to_numpy(zero_copy_only=False).reshape(len(column), -1)


def rows_by_class(column: pa.Array):
    """(class, row numbers) for every class of an Arrow column."""
    coded = column.dictionary_encode()
    codes = coded.indices.to_numpy()
    order = np.argsort(codes, kind="stable")
    starts = np.searchsorted(codes[order], np.arange(len(coded.dictionary) + 1))
    for at, key in enumerate(coded.dictionary.to_pylist()):
        yield key, order[starts[at] : starts[at + 1]]


def nearest(queries: np.ndarray, points: np.ndarray, ids: np.ndarray, need: int):
    """Row and point indices and distances of the ``need`` nearest points per query,
    ordered by (query, distance, id)."""
    rows_out, cols_out, dist_out = [], [], []
    pp = np.einsum("ij,ij->i", points, points)
    step = max(1, 4_000_000 // max(len(points), 1))
    for start in range(0, len(queries), step):
        block = queries[start : start + step]
        qq = np.einsum("ij,ij->i", block, block)
        rough = qq[:, None] + pp[None, :] - 2.0 * (block @ points.T)
        if len(points) > need:
            limit = np.partition(rough, need - 1, axis=1)[:, need - 1]
            limit = limit + 2e-9 * (qq + pp.max()) + 1e-12
            r, c = np.nonzero(rough <= limit[:, None])
        else:
            r, c = np.divmod(np.arange(len(block) * len(points)), len(points))
        dist = np.empty(len(r))
        for s in range(0, len(r), PAIR_CHUNK):
            diff = block[r[s : s + PAIR_CHUNK]] - points[c[s : s + PAIR_CHUNK]]
            dist[s : s + PAIR_CHUNK] = np.sqrt(np.einsum("ij,ij->i", diff, diff))
        order = np.lexsort((ids[c], dist, r))
        r, c, dist = r[order], c[order], dist[order]
        first = np.searchsorted(r, r, side="left")
        keep = np.arange(len(r)) - first < need
        rows_out.append(r[keep] + start)
        cols_out.append(c[keep])
        dist_out.append(dist[keep])
    return np.concatenate(rows_out), np.concatenate(cols_out), np.concatenate(dist_out)


def _block_rows(points: DataFrame, counts: DataFrame) -> int:
    """Rows of a block: as few copies of a vector as its bytes and the number of tasks allow."""
    width = points.select(F.size("_vec")).head()
    largest = counts.agg(F.max("_n")).head()[0]
    if width is None or not largest:
        return BLOCK_ROWS
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fit = BLOCK_BYTES // (8 * max(width[0], 1))
    return max(256, min(fit, max(BLOCK_ROWS, -(-largest // parts))))


def _blocks(queries: DataFrame, points: DataFrame, label: str, block_rows: int) -> DataFrame:
    """(label, cell, blocks of points, blocks of queries)."""
    sizes = points.groupBy(label, "_cell").agg(F.count(F.lit(1)).alias("_np"))
    loads = queries.groupBy(label, "_cell").agg(F.count(F.lit(1)).alias("_nq"))
    return pin(
        sizes.join(loads, [label, "_cell"]).select(
            label,
            "_cell",
            F.ceil(F.col("_np") / block_rows).cast("int").alias("_pb"),
            F.ceil(F.col("_nq") / block_rows).cast("int").alias("_qb"),
        ),
        name="blocks",
    )


def _block_search(queries: DataFrame, points: DataFrame, blocks: DataFrame, label: str, need: int) -> DataFrame:
    """Partial answers ``(label, _vid, _nid, _dist)`` of every query against the points
    of the cell it is routed to. Both sides of a crowded cell are cut into blocks."""
    one = F.lit(1)
    left = (
        queries.join(blocks, [label, "_cell"])
        .withColumn("_qsub", F.pmod(F.xxhash64(F.lit("q"), "_vid"), F.col("_qb")).cast("int"))
        .withColumn("_psub", F.explode(F.sequence(F.lit(0), F.col("_pb") - one)))
        .select(label, "_cell", "_qsub", "_psub", "_vid", "_vec")
    )
    right = (
        points.join(blocks, [label, "_cell"])
        .withColumn("_psub", F.pmod(F.xxhash64(F.lit("p"), "_vid"), F.col("_pb")).cast("int"))
        .withColumn("_qsub", F.explode(F.sequence(F.lit(0), F.col("_qb") - one)))
        .select(label, "_cell", "_qsub", "_psub", "_vid", "_ids", "_vec")
        .toDF("p_class", "p_cell", "p_qsub", "p_psub", "p_vid", "p_ids", "p_vec")
    )
    schema = T.StructType(
        [
            T.StructField(label, queries.schema[label].dataType),
            T.StructField("_vid", T.LongType()),
            T.StructField("_nid", T.LongType()),
            T.StructField("_dist", T.DoubleType()),
        ]
    )
    types = [(f.name, f.dataType) for f in schema.fields]

    def search(key, q: pa.Table, p: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_type

        fields = pa.schema([(n, to_arrow_type(t)) for n, t in types])
        if q.num_rows == 0 or p.num_rows == 0:
            return fields.empty_table()
        qid = q.column("_vid").to_numpy()
        firsts = p.column("p_vid").to_numpy()
        r, c, d = nearest(_matrix(q.column("_vec")), _matrix(p.column("p_vec")), firsts, need)
        ids = p.column("p_ids").combine_chunks()
        offsets = ids.offsets.to_numpy()
        times = np.diff(offsets)[c]
        within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        nid = ids.values.to_numpy()[np.repeat(offsets[c], times) + within]
        r, d = np.repeat(r, times), np.repeat(d, times)
        order = np.lexsort((nid, d, r))
        r, d, nid = r[order], d[order], nid[order]
        keep = np.arange(len(r)) - np.searchsorted(r, r, side="left") < need
        r, d, nid = r[keep], d[keep], nid[keep]
        return pa.table(
            [pa.array([key[0].as_py()] * len(r), fields.field(0).type), qid[r], nid.astype("int64"), d],
            schema=fields,
        )

    blocked = left.groupBy(label, "_cell", "_qsub", "_psub")
    return blocked.cogroup(right.groupBy("p_class", "p_cell", "p_qsub", "p_psub")).applyInArrow(search, schema)


class Voronoi:
    """Cells around pivots. ``reach`` is how far a cell's points lie from its pivot."""

    def __init__(self, pivots: np.ndarray):
        self.pivots = pivots
        self.reach = np.full(len(pivots), -np.inf)

    def __len__(self) -> int:
        return len(self.pivots)

    def _distances(self, vectors: np.ndarray, rows: np.ndarray):
        """(row numbers, lower and upper bound of the distance to every pivot) in pieces of
        bounded memory. A matrix product gives the distances, the bounds allow for its error."""
        step = max(1, 4_000_000 // len(self.pivots))
        pp = np.einsum("ij,ij->i", self.pivots, self.pivots)
        for s in range(0, len(rows), step):
            part = rows[s : s + step]
            x = vectors[part]
            sizes = np.einsum("ij,ij->i", x, x)[:, None] + pp
            square = sizes - 2.0 * (x @ self.pivots.T)
            error = 1e-12 * sizes
            yield part, np.sqrt(np.maximum(square - error, 0.0)), np.sqrt(np.maximum(square, 0.0) + error)

    def assign(self, vectors: np.ndarray, rows: np.ndarray):
        """(row numbers, nearest pivot, distance to it)."""
        for part, _, away in self._distances(vectors, rows):
            yield part, away.argmin(axis=1), away.min(axis=1)

    def open_cells(self, vectors, rows, own, theta):
        """(row numbers, other cells that may hold something within ``theta``) piece by piece.

        Two exact bounds: a cell's points lie within its radius of the pivot, and they are
        nearer to their own pivot than to the query's.
        """
        for part, low, high in self._distances(vectors, rows):
            at = np.arange(len(part))
            home = high[at, own[part]]
            bound = np.maximum(low - self.reach[None, :], (low - home[:, None]) / 2)
            open_ = bound <= theta[part][:, None] * (1 + 1e-9) + 1e-9
            open_[at, own[part]] = False
            r, c = np.nonzero(open_ & np.isfinite(self.reach)[None, :])
            yield part[r], c


class Boxes:
    """Leaves of a tree of cuts. ``low`` and ``high`` bound the points below every node."""

    def __init__(self, sample: np.ndarray):
        self.axis, self.cut, self.left, self.right = [], [], [], []
        todo = [(sample, None)]
        while todo:
            rows, parent = todo.pop()
            here = len(self.axis)
            if parent is not None:
                side = self.right if self.left[parent] >= 0 else self.left
                side[parent] = here
            axis, cut = self._cut(rows)
            for column, value in zip((self.axis, self.cut, self.left, self.right), (axis, cut, -1, -1)):
                column.append(value)
            if axis >= 0:
                goes = rows[:, axis] <= cut
                todo += [(rows[~goes], here), (rows[goes], here)]
        self.axis, self.left, self.right = (np.array(c, np.int64) for c in (self.axis, self.left, self.right))
        self.cut = np.array(self.cut, float)
        self.leaves = np.flatnonzero(self.axis < 0)
        self.cell = np.full(len(self.axis), -1, np.int64)
        self.cell[self.leaves] = np.arange(len(self.leaves))
        self.low = np.full((len(self.axis), sample.shape[1]), np.inf)
        self.high = -self.low

    @staticmethod
    def _cut(rows: np.ndarray):
        """Widest axis and the value nearest to its median that divides the rows."""
        if len(rows) <= BOX_SAMPLE:
            return -1, 0.0
        axis = int(np.ptp(rows, axis=0).argmax())
        values = np.sort(rows[:, axis])
        steps = np.flatnonzero(values[:-1] < values[1:])
        if not len(steps):
            return -1, 0.0
        return axis, float(values[steps[np.abs(steps + 1 - len(values) / 2).argmin()]])

    def __len__(self) -> int:
        return len(self.leaves)

    def assign(self, vectors: np.ndarray, rows: np.ndarray):
        at = np.zeros(len(rows), np.int64)
        open_ = np.flatnonzero(self.axis[at] >= 0)
        while len(open_):
            here = at[open_]
            goes = vectors[rows[open_], self.axis[here]] <= self.cut[here]
            at[open_] = np.where(goes, self.left[here], self.right[here])
            open_ = open_[self.axis[at[open_]] >= 0]
        yield rows, self.cell[at], np.zeros(len(rows))

    def bounded(self, cells: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """Take the bounds of the points of every cell that has any."""
        self.low[self.leaves[cells]], self.high[self.leaves[cells]] = low, high
        for node in np.flatnonzero(self.axis >= 0)[::-1]:  # children come after their parent
            both = [self.left[node], self.right[node]]
            self.low[node], self.high[node] = self.low[both].min(axis=0), self.high[both].max(axis=0)

    def open_cells(self, vectors, rows, own, theta):
        """(row numbers, other cells whose box comes within ``theta``) piece by piece: down
        the tree, and only below boxes that are near enough."""
        filled = (self.low <= self.high).all(axis=1) | np.isnan(self.low + self.high).any(axis=1)
        step = max(1, 1_000_000 // len(self))
        for s in range(0, len(rows), step):
            part = rows[s : s + step]
            at = np.zeros(len(part), np.int64)
            while len(part):
                x = vectors[part]
                gap = np.maximum(np.maximum(self.low[at] - x, x - self.high[at]), 0.0)
                bound = np.sqrt(np.einsum("ij,ij->i", gap, gap))
                near = filled[at] & ~(bound > theta[part] * (1 + 1e-9) + 1e-9)
                part, at = part[near], at[near]
                end = self.axis[at] < 0
                cell = self.cell[at[end]]
                other = cell != own[part[end]]
                yield part[end][other], cell[other]
                part, at = part[~end], at[~end]
                part, at = np.concatenate([part, part]), np.concatenate([self.left[at], self.right[at]])


def _choose_cells(points: DataFrame, counts: DataFrame, label: str, cell_rows: int, seed: int):
    """{class: cells} for the classes that are worth cutting into cells. The number of
    cells grows with the class: of boxes as it does, of Voronoi cells up to four times its
    root, where assigning rows to them costs as much as searching them; and as far as the
    rows that they are made from fit their bytes."""
    large = counts.where(F.col("_n") > cell_rows * WORTH_CUTTING)
    if large.head() is None:
        return {}
    width = points.select(F.size("_vec")).head()[0]
    narrow = 0 < width <= BOX_WIDTH
    asked_of = F.ceil(F.col("_n") / cell_rows)
    if narrow:
        asked_of = asked_of * BOX_SAMPLE
    else:
        asked_of = F.least(asked_of, F.greatest(F.ceil(4 * F.sqrt("_n")), F.lit(2 * WORTH_CUTTING)))
    cells = large.select(label, asked_of.alias("_cells"))
    asked = cells.agg(F.sum("_cells")).head()[0]
    share = min(1.0, PIVOT_BYTES / (8.0 * width) / asked)
    cells = cells.withColumn("_cells", F.floor(F.col("_cells") * share)).where(F.col("_cells") > 1)
    # pivots are the rows up to a cut-off digest, so no class is gathered to rank them
    quotas = pin(cells.select(label, F.col("_cells").cast("long").alias("quota")), name="pivot-quotas")
    some = points.join(quotas.select(label), label)
    hashed = with_digest(some, ["_vid"], seed, "pivot").select(label, "_hash", "_vec")
    picked = selected(hashed, [label], "_hash", quotas).where("_in").select(label, "_hash", "_vec").toArrow()
    found: dict = {}
    for key, rank, vec in zip(*(picked.column(i).to_pylist() for i in range(3))):
        found.setdefault(key, []).append((rank, vec))
    kind = Boxes if narrow else Voronoi
    return {key: kind(np.array([v for _, v in sorted(rows)])) for key, rows in found.items()}


def _assign_cells(points: DataFrame, label: str, cells: dict) -> DataFrame:
    """Cell of every row and its distance from a pivot; one cell for classes without cells."""
    if not cells:
        return points.withColumn("_cell", F.lit(0)).withColumn("_pd", F.lit(0.0))
    schema = T.StructType(
        points.schema.fields + [T.StructField("_cell", T.IntegerType()), T.StructField("_pd", T.DoubleType())]
    )

    def assign(batches):
        for batch in batches:
            n = batch.num_rows
            cell, dist = np.zeros(n, "int32"), np.zeros(n)
            if n:
                vectors = _matrix(pa.chunked_array([batch.column("_vec")]))
                for key, mine in rows_by_class(batch.column(label)):
                    if key not in cells:
                        continue
                    for part, at, away in cells[key].assign(vectors, mine):
                        cell[part] = at
                        dist[part] = away
            yield pa.RecordBatch.from_arrays(
                batch.columns + [pa.array(cell), pa.array(dist)], batch.schema.names + ["_cell", "_pd"]
            )

    return points.mapInArrow(assign, schema)


def _bound_cells(celled: DataFrame, label: str, cells: dict) -> None:
    """Where the points of every cell lie."""
    boxed = {key: c.low.shape[1] for key, c in cells.items() if isinstance(c, Boxes)}
    width = max(boxed.values(), default=0)
    sides = [f(F.get("_vec", F.lit(i))).alias(f"{n}{i}") for n, f in (("l", F.min), ("h", F.max)) for i in range(width)]
    found = celled.groupBy(label, "_cell").agg(F.max("_pd").alias("_far"), *sides).toArrow().combine_chunks()
    at, far = found["_cell"].to_numpy(), found["_far"].to_numpy()
    low, high = (np.array([found[f"{n}{i}"].to_numpy() for i in range(width)]).T for n in "lh")
    for key, mine in rows_by_class(found[label].combine_chunks()):
        if key in boxed:
            cells[key].bounded(at[mine], low[mine], high[mine])
        elif key in cells:
            cells[key].reach[at[mine]] = far[mine]


def _pruned(queries: DataFrame, label: str, cells: dict) -> set:
    """Classes of which at most ``MAX_OPEN`` of the other cells stay open, measured on some
    queries. The choice decides the cost, never the answer."""
    order = Window.partitionBy(label).orderBy(hash_hex(0, "probe", "_vid"), "_vid")
    some = queries.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= PROBED)
    some = some.select(label, "_vec", "_cell", "_theta").toArrow().combine_chunks()
    if not some.num_rows:
        return set()
    vectors = _matrix(some["_vec"])
    own, theta = some["_cell"].to_numpy(), some["_theta"].to_numpy()
    found = set()
    for key, mine in rows_by_class(some[label].combine_chunks()):
        if key in cells:
            opened = sum(len(c) for _, c in cells[key].open_cells(vectors, mine, own, theta))
            if opened <= MAX_OPEN * len(mine) * max(len(cells[key]) - 1, 1):
                found.add(key)
    return found


def _route_onward(queries: DataFrame, label: str, cells: dict) -> DataFrame:
    """``(label, _vid, _cell)``: the other cells each query has to visit. Vectors are not
    repeated; the search meets them again by id."""
    fields = [f for f in queries.schema.fields if f.name in (label, "_vid")]
    schema = T.StructType(fields + [T.StructField("_cell", T.IntegerType())])
    names = [f.name for f in fields]

    def route(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            vectors = _matrix(pa.chunked_array([batch.column("_vec")]))
            own = batch.column("_cell").to_numpy()
            theta = batch.column("_theta").to_numpy()
            rows, at = [], []
            for key, mine in rows_by_class(batch.column(label)):
                if key not in cells:
                    continue
                for r, c in cells[key].open_cells(vectors, mine, own, theta):
                    rows.append(r)
                    at.append(c)
            if rows:
                take = pa.array(np.concatenate(rows))
                columns = [batch.column(n).take(take) for n in names]
                columns.append(pa.array(np.concatenate(at).astype("int32")))
                yield pa.RecordBatch.from_arrays(columns, names + ["_cell"])

    return queries.mapInArrow(route, schema)


def _best(partial: DataFrame, label: str, need: int) -> DataFrame:
    order = Window.partitionBy(label, "_vid").orderBy("_dist", "_nid")
    return partial.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= need)


def knn(
    df: DataFrame,
    key: str,
    label: str,
    vec: str,
    k: int = 5,
    queries: DataFrame | None = None,
    cell_rows: int = CELL_ROWS,
    block_rows: int | None = None,
    seed: int = 42,
    with_vectors: bool = False,
    recall: float | None = None,
    bucket_rows: int | None = None,
) -> DataFrame:
    """``(label, key, rank, neighbor_id, distance)``: the k nearest other rows of the
    same class by Euclidean distance, ties by id.

    ``queries(label, key)`` restricts whose neighbours are wanted, never who may be a
    neighbour. ``with_vectors`` adds ``neighbor_vec``. Blocks are as large as their bytes
    allow while every task still gets one, unless ``block_rows`` is given.

    The answer is exact unless ``recall`` asks for an approximate one: classes of more than
    two buckets of ``bucket_rows`` are then searched by :mod:`approximate`, with as many
    probes as find that share of the true neighbours of some of their rows.
    """
    need = k + 1
    rows = df.where(F.col(label).isNotNull()).select(
        label, F.col(key).cast("long").alias("_id"), as_doubles(vec).alias("_vec")
    )
    # the hash comes first, since rows are sorted by it far faster than by their vectors
    copies = Window.partitionBy("_h", label, "_vec").orderBy("_id")
    points = stage(
        rows.withColumn("_h", F.xxhash64("_vec"))
        .withColumn("_r", F.row_number().over(copies))
        .where(F.col("_r") <= need)
        .groupBy("_h", label, "_vec")
        .agg(F.sort_array(F.collect_list("_id")).alias("_ids"))
        .select(label, "_vec", "_ids", F.col("_ids")[0].alias("_vid")),
        "points",
    )
    counts = pin(points.groupBy(label).agg(F.count(F.lit(1)).alias("_n")), name="class-counts")
    if block_rows is None:
        block_rows = _block_rows(points, counts)
    cells = _choose_cells(points, counts, label, cell_rows, seed) if recall is None else {}
    celled = _assign_cells(points, label, cells)
    if cells:
        celled = stage(celled, "cells")

    members = points.select(label, "_vid", F.explode("_ids").alias("_id"))
    if queries is None:
        asked, sought = rows, celled
    else:
        wanted = queries.select(F.col(label).alias("_ql"), F.col(key).cast("long").alias("_qi")).distinct()
        asked = rows.join(wanted, (F.col(label) == F.col("_ql")) & (F.col("_id") == F.col("_qi")), "left_semi")
        # Copies beyond the listed ones need no search, so ids are enough to find the vectors.
        vectors = members.join(
            wanted, (F.col(label) == F.col("_ql")) & (F.col("_id") == F.col("_qi")), "left_semi"
        )
        sought = celled.join(vectors.select(label, "_vid").distinct(), [label, "_vid"], "left_semi")

    if recall is not None:
        from skewlens.operators import approximate

        rows_ = bucket_rows or approximate.BUCKET_ROWS
        found = approximate.search(
            sought.drop("_pd"), celled.drop("_pd"), counts, label, need, recall, rows_, block_rows, seed
        )
    elif not cells and not counts.where(F.col("_n") > block_rows).head():
        one_block = F.lit(1)
        blocks = counts.select(label, F.lit(0).alias("_cell"), one_block.alias("_pb"), one_block.alias("_qb"))
    else:
        blocks = _blocks(sought, celled, label, block_rows)
    if recall is None:
        found = _block_search(sought, celled, blocks, label, need)
    if cells:
        own = stage(_best(found, label, need).select(label, "_vid", "_nid", "_dist"), "own-cell")
        bound = own.groupBy(label, "_vid").agg(
            F.when(F.count(F.lit(1)) == need, F.max("_dist")).otherwise(F.lit(float("inf"))).alias("_theta")
        )
        _bound_cells(celled, label, cells)
        bounded = stage(sought.join(bound, [label, "_vid"]), "bounds")
        pruned = _pruned(bounded, label, cells)
        answers_of = [own]
        if pruned:
            kept = {key_: c for key_, c in cells.items() if key_ in pruned}
            onward = stage(_route_onward(bounded, label, kept), "onward")
            blocks = _blocks(onward, celled, label, block_rows)
            onward = onward.join(sought.select(label, "_vid", "_vec"), [label, "_vid"])
            answers_of.append(_block_search(onward, celled, blocks, label, need))
        whole = [key_ for key_ in cells if key_ not in pruned]
        if whole:
            at_once = lambda rows: rows.where(F.col(label).isin(whole)).withColumn("_cell", F.lit(0))
            blocks = _blocks(at_once(sought), at_once(celled), label, block_rows)
            answers_of[0] = own.where(~F.col(label).isin(whole))
            answers_of.append(_block_search(at_once(sought), at_once(celled), blocks, label, need))
        found = answers_of[0]
        for more in answers_of[1:]:
            found = found.unionByName(more)

    best = _best(found, label, need)
    near = [F.col("_dist"), F.col("_nid")]
    if with_vectors:
        owners = points.select(label, F.explode("_ids").alias("_nid"), F.col("_vec").alias("_nvec"))
        best = best.join(owners, [label, "_nid"])
        near.append(F.col("_nvec"))
    answers = best.groupBy(label, "_vid").agg(F.sort_array(F.collect_list(F.struct(*near))).alias("_near"))
    others = F.slice(F.filter("_near", lambda x: x["_nid"] != F.col("_id")), 1, k)
    result = (
        asked.select(label, "_id")
        .join(members, [label, "_id"])
        .join(answers, [label, "_vid"])
        .select(label, "_id", others.alias("_near"))
    )
    if points.where(F.size("_ids") == need).head() is not None:
        result = result.unionByName(_further_copies(asked, points, members, label, k, with_vectors))
    columns = [
        label,
        F.col("_id").alias(key),
        (F.col("_pos") + 1).alias("rank"),
        F.col("_x._nid").alias("neighbor_id"),
        F.col("_x._dist").alias("distance"),
    ]
    if with_vectors:
        columns.append(F.col("_x._nvec").alias("neighbor_vec"))
    return result.select(label, "_id", F.posexplode("_near").alias("_pos", "_x")).select(*columns)


def _further_copies(
    asked: DataFrame, points: DataFrame, members: DataFrame, label: str, k: int, with_vectors: bool
) -> DataFrame:
    """Answers of the copies beyond the k+1 that ``points`` lists: the first k listed ids,
    at distance zero. A group of copies may hold a large part of the rows: its listed ids
    are repeated per salt, others are not."""
    extra = stage(asked.join(members, [label, "_id"], "left_anti").select(label, "_id", "_vec"), "further-copies")
    crowded = pin(
        extra.groupBy(label, "_vec").count().where(F.col("count") > COPY_ROWS).select(label, "_vec", F.lit(COPY_SALTS).alias("_salts")),
        name="crowded",
    )
    salts = F.coalesce("_salts", F.lit(1))
    extra = extra.join(crowded, [label, "_vec"], "left").withColumn("_salt", F.pmod(F.xxhash64("_id"), salts).cast("int"))
    listed = points.where(F.size("_ids") == k + 1).join(crowded, [label, "_vec"], "left").select(
        label, "_vec", "_ids", F.explode(F.sequence(F.lit(0), salts - 1)).alias("_salt")
    )

    def entry(i):
        fields = [F.lit(0.0).alias("_dist"), i.alias("_nid")]
        return F.struct(*fields, *([F.col("_vec").alias("_nvec")] if with_vectors else []))

    return extra.join(listed, [label, "_vec", "_salt"]).select(
        label, "_id", F.transform(F.slice("_ids", 1, k), entry).alias("_near")
    )
