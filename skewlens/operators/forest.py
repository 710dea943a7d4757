"""Random forest as a table of nodes, grown to pure leaves.

The rows are folded to distinct (vector, label) points with counts. Where they are many,
Spark's learner grows the upper levels of all trees. Then every point finds its leaf in
each tree, and the points of a leaf, drawn with Poisson weights as a bootstrap sample is,
are grown on in one task until no leaf is mixed. Leaves with more points than a task should
hold get further upper levels first. Nothing limits the depth unless asked for.

A fitted forest is a staged table, one row per node: it can be written, read back and
applied in any session. Rows are scored by one vectorised walk per tree; a forest beyond a
byte limit is applied in blocks of trees.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skewlens.functions.vectors import as_doubles
from skewlens.operators.neighbors import _matrix
from skewlens.session import fresh_path, stage

#: Bytes of the points that one task grows a subtree from.
LOCAL_BYTES = 64 * 1024 * 1024
#: Points that are dealt out at once, over all trees.
DEALT_ROWS = 1_000_000_000
#: Levels Spark's learner grows above what the number of points asks for, and at most.
EXTRA_LEVELS, MOST_LEVELS = 3, 16
#: Bytes of nodes a task is given to score with.
FOREST_BYTES = 256 * 1024 * 1024
#: Bytes of one node in the arrays that score.
NODE_BYTES = 64
#: Bytes of running class counts a split search holds.
SEARCH_BYTES = 32 * 1024 * 1024
#: Rows scored at once.
SCORED_ROWS = 4096

#: A leaf has feature -1 and the classes of its rows with their shares.
NODES_SCHEMA = (
    "tree int, node string, feature int, threshold double, left string, right string, "
    "classes array<int>, shares array<double>"
)


@dataclass
class Forest:
    """Nodes of all trees; node ``0`` is a root."""

    nodes: DataFrame
    trees: int

    def write(self, path: str) -> None:
        self.nodes.write.parquet(path)


def read_forest(spark: SparkSession, path: str) -> Forest:
    nodes = spark.read.schema(NODES_SCHEMA).parquet(path)
    return Forest(nodes, (nodes.agg(F.max("tree")).head()[0] or 0) + 1)


# ---- growing in a task ----------------------------------------------------------------


def _best_split(x: np.ndarray, held: np.ndarray, total: np.ndarray, least: int):
    """(gain, column, threshold) of the best split of ``x`` by Gini impurity, or None.

    ``held`` is rows x classes of weights; either side keeps ``least`` of the weight.
    """
    n, classes = held.shape
    best = None
    step = max(1, SEARCH_BYTES // (8 * n * classes))
    for a in range(0, x.shape[1], step):
        part = x[:, a : a + step]
        order = np.argsort(part, axis=0, kind="stable")
        values = np.take_along_axis(part, order, axis=0)
        left = np.cumsum(held[order], axis=0)[:-1]  # rows x columns x classes
        right = total - left
        n_left, n_right = left.sum(axis=2), right.sum(axis=2)
        fine = (values[1:] > values[:-1]) & (n_left >= least) & (n_right >= least)
        if not fine.any():
            continue
        gain = (left * left).sum(axis=2) / np.maximum(n_left, 1e-300)
        gain += (right * right).sum(axis=2) / np.maximum(n_right, 1e-300)
        gain[~fine] = -1.0
        at, column = np.unravel_index(int(gain.argmax()), gain.shape)
        if best is None or gain[at, column] > best[0]:
            low, high = values[at, column], values[at + 1, column]
            middle = low + (high - low) / 2
            best = (gain[at, column], a + int(column), middle if middle < high else low)
    return best


def grow(
    x: np.ndarray, y: np.ndarray, weight: np.ndarray, rng: np.random.Generator, tried: int, least: int, levels: int | None
) -> list[tuple]:
    """Nodes ``(feature, threshold, left, right, classes, shares)`` of one tree, node 0 its
    root. Every split looks at ``tried`` features drawn anew, and at more only where those
    cannot split; a node is a leaf when it is pure, cannot be split, or lies ``levels`` deep.
    """
    names, codes = np.unique(y, return_inverse=True)
    held = np.zeros((len(y), len(names)))
    held[np.arange(len(y)), codes] = weight
    nodes: list = [None]
    todo = [(0, np.arange(len(y)), 0)]
    d = x.shape[1]
    while todo:
        at, rows, level = todo.pop()
        own = held[rows]
        total = own.sum(axis=0)
        present = np.flatnonzero(total)
        found = None
        if len(present) > 1 and (levels is None or level < levels):
            own = own[:, present]
            order = rng.permutation(d)
            for k in range(0, d, tried):
                columns = order[k : k + tried]
                found = _best_split(x[np.ix_(rows, columns)], own, total[present], least)
                if found:
                    break
        if not found:
            weight_ = total[present].sum()
            nodes[at] = (-1, 0.0, -1, -1, names[present].tolist(), (total[present] / weight_).tolist())
            continue
        feature, threshold = int(columns[found[1]]), float(found[2])
        goes = x[rows, feature] <= threshold
        left, right = len(nodes), len(nodes) + 1
        nodes += [None, None]
        nodes[at] = (feature, threshold, left, right, [], [])
        todo += [(left, rows[goes], level + 1), (right, rows[~goes], level + 1)]
    return nodes


# ---- nodes as arrays --------------------------------------------------------------------


#: A tree in one row: nodes point to each other by their place in the arrays, a leaf's
#: classes and shares start at ``first``.
PACKED_SCHEMA = (
    "tree int, root int, feature array<int>, threshold array<double>, left array<int>, right array<int>, "
    "first array<int>, classes array<int>, shares array<double>, names array<string>"
)


def _packed(nodes: DataFrame, named: bool) -> pa.Table:
    """The trees of ``nodes`` as arrays; each is packed in a task of its own. Names are left
    out unless asked for."""
    names = [f.strip().split(" ")[0] for f in PACKED_SCHEMA.split(", ")]

    def pack(key, table):
        table = table.combine_chunks()
        column = lambda c: pa.concat_arrays(table[c].chunks)
        node, classes = column("node"), column("classes")
        place = lambda c: pc.fill_null(pc.index_in(column(c), value_set=node), -1)
        first = np.concatenate([[0], np.cumsum(pc.list_value_length(classes).to_numpy())])
        arrays = [
            column("feature"), column("threshold"), place("left"), place("right"), pa.array(first.astype(np.int32)),
            classes.flatten(), column("shares").flatten(), node if named else node.slice(0, 0),
        ]
        root = pa.array([pc.index(node, "0").as_py()], pa.int32())
        rows = [pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a) for a in arrays]
        return pa.table([pa.array([key[0].as_py()], pa.int32()), root, *rows], names=names)

    packed = nodes.groupBy("tree").applyInArrow(pack, PACKED_SCHEMA)
    return (packed if named else packed.drop("names")).toArrow().combine_chunks()


class Tree:
    """Nodes of a packed tree, for vectorised walks: views of the table, no copies."""

    def __init__(self, table: pa.Table, row: int):
        view = lambda c: table[c][row].values.to_numpy(zero_copy_only=False)
        self.root = table["root"][row].as_py()
        self.feature, self.threshold = view("feature"), view("threshold")
        self.left, self.right, self.first = view("left"), view("right"), view("first")
        self.classes, self.shares = view("classes"), view("shares")
        self.names = view("names") if "names" in table.column_names else None

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Node in which each row of ``x`` ends."""
        at = np.full(len(x), self.root)
        open_ = np.flatnonzero(self.feature[at] >= 0)
        while len(open_):
            here = at[open_]
            goes = x[open_, self.feature[here]] <= self.threshold[here]
            at[open_] = np.where(goes, self.left[here], self.right[here])
            open_ = open_[self.feature[at[open_]] >= 0]
        return at

    def vote(self, x: np.ndarray, votes: np.ndarray) -> None:
        """Add the tree's class shares to ``votes`` (rows x classes)."""
        at = self.leaves(x)
        times = self.first[at + 1] - self.first[at]
        within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        entry = np.repeat(self.first[at], times) + within
        np.add.at(votes, (np.repeat(np.arange(len(x)), times), self.classes[entry]), self.shares[entry])


def _trees(table: pa.Table) -> dict:
    """{number: tree}, by number."""
    numbers = table["tree"].to_numpy()
    return {int(numbers[i]): Tree(table, int(i)) for i in np.argsort(numbers)}


# ---- bootstrap weights --------------------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    """64-bit finalizer: spreads every bit of the input over the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Copies of a point whose draws are made one by one.
SINGLE_DRAWS = 32
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(20)])


def bootstrap(points: np.ndarray, counts: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each point is in the tree's sample: Poisson with its count as the mean, a
    function of (seed, tree, point)."""
    with np.errstate(over="ignore"):
        base = _mix(points.view(np.uint64) + _mix(np.array([seed * 1_000_003 + tree + 1], np.uint64))[0])
        out = np.zeros(len(points), np.int64)
        for k in range(int(min(counts.max(initial=0), SINGLE_DRAWS))):
            some = np.flatnonzero((counts > k) & (counts <= SINGLE_DRAWS))
            if len(some):
                u = (_mix(base[some] + np.uint64(k)) >> np.uint64(11)) * 2.0**-53
                out[some] += np.searchsorted(_POISSON, u, side="right")
    for i in np.flatnonzero(counts > SINGLE_DRAWS):
        out[i] = np.random.Generator(np.random.Philox(key=int(base[i]))).poisson(counts[i])
    return out


# ---- fitting ------------------------------------------------------------------------------


def fold(df: DataFrame, label: str, vec: str) -> DataFrame:
    """``(_y, _x, _n, _p)``: distinct points with their counts and a hash that names each."""
    rows = df.where(F.col(label).isNotNull() & F.col(vec).isNotNull())
    rows = rows.select(F.col(label).cast("int").alias("_y"), as_doubles(vec).alias("_x"))
    return rows.groupBy("_y", "_x").agg(F.count(F.lit(1)).alias("_n")).withColumn("_p", F.xxhash64("_x", "_y"))


def _learned(points: DataFrame, weight: str, trees: int, levels: int, options: dict, prefix: str, first: int) -> DataFrame:
    """Nodes of trees grown by Spark's learner; node ``0`` takes the name ``prefix``."""
    spark = points.sparkSession
    learner = RandomForestClassifier(
        labelCol="_label", featuresCol="_v", weightCol="_w", numTrees=trees, maxDepth=levels,
        featureSubsetStrategy="sqrt", **options,
    )
    rows = points.select(
        F.col("_y").cast("double").alias("_label"), array_to_vector("_x").alias("_v"), F.col(weight).cast("double").alias("_w")
    )
    path = fresh_path(spark, "upper-levels")
    learner.fit(rows).write().save(path)
    saved = spark.read.parquet(f"{path}/data")
    name = lambda c: F.when(c == 0, F.lit(prefix)).otherwise(F.concat(F.lit(f"{prefix}/"), c.cast("string")))
    inner = F.col("leftChild") >= 0
    stats = F.posexplode("impurityStats")
    leaves = saved.select("treeID", "nodeData.*").where(~inner)
    shares = (
        leaves.select("treeID", "id", stats.alias("c", "s"))
        .where("s > 0")
        .groupBy("treeID", "id")
        .agg(F.sort_array(F.collect_list(F.struct("c", "s"))).alias("_s"), F.sum("s").alias("_t"))
    )
    nodes = saved.select("treeID", "nodeData.*").join(shares, ["treeID", "id"], "left")
    none = F.lit(None).cast("string")
    return nodes.select(
        (F.col("treeID") + first).cast("int").alias("tree"),
        name(F.col("id")).alias("node"),
        F.when(inner, F.col("split.featureIndex")).otherwise(-1).cast("int").alias("feature"),
        F.when(inner, F.get("split.leftCategoriesOrThreshold", F.lit(0))).otherwise(0.0).alias("threshold"),
        F.when(inner, name(F.col("leftChild"))).otherwise(none).alias("left"),
        F.when(inner, name(F.col("rightChild"))).otherwise(none).alias("right"),
        F.coalesce(F.transform("_s", lambda s: s["c"].cast("int")), F.array().cast("array<int>")).alias("classes"),
        F.coalesce(F.transform("_s", lambda s: s["s"] / F.col("_t")), F.array().cast("array<double>")).alias("shares"),
    )


def _dealt(points: DataFrame, upper: DataFrame, first: int, upto: int, seed: int, with_points: bool) -> DataFrame:
    """``(tree, leaf, _w[, _y, _x])``: every drawn point at its leaf of each tree."""
    packed = _packed(upper.where(F.col("tree").between(first, upto - 1)), True)
    shared = points.sparkSession.sparkContext.broadcast(packed)
    ddl = "tree int, leaf string, _w long" + (", _y int, _x array<double>" if with_points else "")

    def deal(batches):
        trees = _trees(shared.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(pa.chunked_array([batch.column("_x")]))
            point, n = batch.column("_p").to_numpy(), batch.column("_n").to_numpy()
            for tree, nodes in trees.items():
                weight = bootstrap(point, n, tree, seed)
                rows = np.flatnonzero(weight)
                leaf = nodes.names[nodes.leaves(x[rows])]
                columns = [
                    pa.array(np.full(len(rows), tree, np.int32)),
                    pa.array(leaf, pa.string()),
                    pa.array(weight[rows]),
                ]
                names = ["tree", "leaf", "_w"]
                if with_points:
                    take = pa.array(rows)
                    columns += [batch.column("_y").take(take), batch.column("_x").take(take)]
                    names += ["_y", "_x"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return points.select("_y", "_x", "_n", "_p").mapInArrow(deal, ddl)


def _grown(dealt: DataFrame, width: int, seed: int, least: int, levels: int | None) -> DataFrame:
    """Nodes of the subtrees below all leaves; a subtree's root takes its leaf's name."""
    tried = max(1, math.ceil(math.sqrt(width)))

    def subtree(key, table):
        tree, leaf = key[0].as_py(), key[1].as_py()
        x = _matrix(table["_x"])
        y, weight = table["_y"].to_numpy(), table["_w"].to_numpy().astype(float)
        order = np.lexsort((y, *x.T[:8]))  # one order whatever the partitions
        x = x[order]
        stream = [seed, tree, *leaf.encode()]
        found = grow(x, y[order], weight[order], np.random.default_rng(stream), tried, least, levels)
        name = lambda i: None if i < 0 else leaf if i == 0 else f"{leaf}/{i}"
        column = lambda k: (n[k] for n in found)
        values = [
            (tree for _ in found), map(name, range(len(found))), column(0), column(1), map(name, column(2)), map(name, column(3)), column(4), column(5),
        ]
        types = [pa.int32(), pa.string(), pa.int32(), pa.float64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.float64())]
        names = [f.strip().split(" ")[0] for f in NODES_SCHEMA.split(", ")]
        return pa.table([pa.array(v, t, size=len(found)) for v, t in zip(values, types)], names=names)

    return dealt.groupBy("tree", "leaf").applyInArrow(subtree, NODES_SCHEMA)


def fit(
    df: DataFrame,
    label: str,
    vec: str,
    trees: int = 100,
    depth: int | None = None,
    seed: int = 42,
    min_rows: int = 1,
    local_bytes: int = LOCAL_BYTES,
    max_bins: int = 32,
    memory_mb: int = 512,
) -> Forest:
    """Forest with sqrt(d) features per split, grown until leaves are pure.

    ``depth`` limits the levels (None: none); ``min_rows``: rows a leaf must hold;
    ``local_bytes``: of the points one task grows a subtree from; ``max_bins`` and
    ``memory_mb`` are for the upper levels. Rows with a null label or vector are left out;
    without rows the forest has no nodes and predicts null.
    """
    points = stage(fold(df, label, vec), "points")
    spark = df.sparkSession
    size = points.agg(F.count(F.lit(1)), F.max(F.size("_x"))).head()
    if not size[0]:
        return Forest(spark.createDataFrame([], NODES_SCHEMA), trees)
    n, width = size[0], size[1]
    local_rows = max(2, local_bytes // (8 * (width + 2)))
    options = {"maxBins": max_bins, "minInstancesPerNode": min_rows, "maxMemoryInMB": memory_mb, "seed": seed}
    if n <= local_rows:
        upper = spark.createDataFrame(
            [(t, "0", -1, 0.0, None, None, [], []) for t in range(trees)], NODES_SCHEMA
        )
    else:
        levels = min(MOST_LEVELS, math.ceil(math.log2(n / local_rows)) + EXTRA_LEVELS, depth or MOST_LEVELS)
        upper = stage(_learned(points, "_n", trees, levels, options, "0", 0), "upper-levels")
    at_once = max(1, min(trees, DEALT_ROWS // n))
    parts = []
    for first in range(0, trees, at_once):
        upto = min(first + at_once, trees)
        block = upper.where(F.col("tree").between(first, upto - 1))
        refused: set = set()
        while n > local_rows:  # leaves beyond a task get further levels of their own
            sizes = _dealt(points, block, first, upto, seed, False).groupBy("tree", "leaf").count()
            big = [(r["tree"], r["leaf"]) for r in sizes.where(F.col("count") > local_rows).collect()]
            big = [b for b in big if b not in refused and (depth is None or _level(block, *b) < depth)]
            if not big:
                break
            block = _refitted(points, block, first, upto, seed, big, options, refused, depth)
        dealt = _dealt(points, block, first, upto, seed, True)
        if depth is None:
            below = _grown(dealt, width, seed, min_rows, None)
        else:
            deep = _levels(block)
            below = None
            for level, leaves in sorted(deep.items()):
                some = dealt.join(F.broadcast(spark.createDataFrame(leaves, "tree int, leaf string")), ["tree", "leaf"])
                found = _grown(some, width, seed, min_rows, max(depth - level, 0))
                below = found if below is None else below.unionByName(found)
        below = stage(below, "subtrees")
        # an upper leaf that no drawn point reached keeps the learner's counts
        reached = below.select("tree", "node")
        parts.append(block.join(reached, ["tree", "node"], "left_anti").unionByName(below))
    nodes = parts[0]
    for more in parts[1:]:
        nodes = nodes.unionByName(more)
    return Forest(stage(nodes, "forest"), trees)


def _levels(block: DataFrame) -> dict:
    """{level: [(tree, leaf)]} of the leaves of some upper levels."""
    table = block.toArrow()
    rows = list(zip(*(table[c].to_pylist() for c in ("tree", "node", "left", "right"))))
    children = {(t, n): (a, b) for t, n, a, b in rows}
    found: dict = {}
    for tree in {r[0] for r in rows}:
        todo = [("0", 0)]
        while todo:
            node, level = todo.pop()
            a, b = children[tree, node]
            if a is None:
                found.setdefault(level, []).append((tree, node))
            else:
                todo += [(a, level + 1), (b, level + 1)]
    return found


def _level(block: DataFrame, tree: int, leaf: str) -> int:
    return next(level for level, leaves in _levels(block).items() if (tree, leaf) in leaves)


def _refitted(points, block, first, upto, seed, big, options, refused, depth) -> DataFrame:
    """The upper levels with every leaf of ``big`` replaced by levels of its own."""
    spark = points.sparkSession
    rows = _dealt(points, block, first, upto, seed, True)
    names = spark.createDataFrame(big, "tree int, leaf string")
    rows = stage(rows.join(F.broadcast(names), ["tree", "leaf"]), "large-leaves")
    grown = []
    for tree, leaf in big:
        mine = rows.where((F.col("tree") == tree) & (F.col("leaf") == leaf))
        levels = min(MOST_LEVELS, depth - _level(block, tree, leaf)) if depth else EXTRA_LEVELS + 2
        found = stage(_learned(mine, "_w", 1, levels, {**options, "bootstrap": False}, leaf, tree), "levels")
        if found.count() == 1:  # no split by the learner's thresholds: a task has to take it
            refused.add((tree, leaf))
        else:
            grown.append(found)
    if not grown:
        return block
    more = grown[0]
    for g in grown[1:]:
        more = more.unionByName(g)
    kept = block.join(more.select("tree", "node"), ["tree", "node"], "left_anti")
    return stage(kept.unionByName(more), "upper-levels")


# ---- scoring ------------------------------------------------------------------------------


def predict(
    forest: Forest, df: DataFrame, label: str, vec: str, extra: list[str] | None = None, forest_bytes: int = FOREST_BYTES
) -> DataFrame:
    """``(extra..., true, pred)``: the class with most votes, of equal ones the least. Rows
    without a vector have a null prediction."""
    extra = extra or []
    rows = df.select(*extra, F.col(label).cast("int").alias("true"), as_doubles(vec).alias("_x"))
    sizes = sorted((r["tree"], r["count"]) for r in forest.nodes.groupBy("tree").count().collect())
    last = forest.nodes.select(F.max(F.array_max("classes"))).head()[0]
    if last is None:
        return rows.select(*extra, "true", F.lit(None).cast("int").alias("pred"))
    blocks, held = [[]], 0
    for tree, count in sizes:
        if blocks[-1] and held + count * NODE_BYTES > forest_bytes:
            blocks.append([])
            held = 0
        blocks[-1].append(tree)
        held += count * NODE_BYTES
    for i, some in enumerate(blocks):
        rows = _voted(rows, forest.nodes.where(F.col("tree").between(some[0], some[-1])), last + 1, i == 0)
        if i + 1 < len(blocks):
            rows = stage(rows, "votes")
    top = F.array_max("_votes")
    pred = (F.array_position("_votes", top) - 1).cast("int")
    return rows.select(*extra, "true", F.when(F.col("_x").isNotNull(), pred).alias("pred"))


def _voted(rows: DataFrame, nodes: DataFrame, classes: int, first: bool) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(_packed(nodes, False))
    schema = T.StructType([f for f in rows.schema.fields if f.name != "_votes"] + [T.StructField("_votes", T.ArrayType(T.DoubleType()))])
    names = [f.name for f in schema.fields]

    def score(batches):
        trees = _trees(shared.value)
        for whole in batches:
            for k in range(0, whole.num_rows, SCORED_ROWS):
                batch = whole.slice(k, SCORED_ROWS)
                n = batch.num_rows
                vec = batch.column("_x")
                known = np.flatnonzero(vec.is_valid().to_numpy(zero_copy_only=False))
                votes = np.zeros((n, classes)) if first else _matrix(pa.chunked_array([batch.column("_votes")])).copy()
                if len(known):
                    mine = np.zeros((len(known), classes))
                    x = _matrix(pa.chunked_array([vec.take(pa.array(known))]))
                    for tree in trees.values():
                        tree.vote(x, mine)
                    votes[known] += mine
                offsets = pa.array(np.arange(0, votes.size + 1, classes, dtype=np.int32))
                columns = [batch.column(c) for c in names[:-1]]
                columns.append(pa.ListArray.from_arrays(offsets, pa.array(votes.ravel())))
                yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(score, schema)
