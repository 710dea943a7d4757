import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from skewlens.catalog import ORACLES, QUERIES
from skewlens.catalog.neighbors import ITEM_ID, exceeds_long
from skewlens.operators import neighbors, smote
from skewlens.operators.neighbors import knn
from tests.oracle_check import compare


def frame(spark, ids, labels, x):
    rows = [(int(i), str(c), [float(v) for v in r]) for i, c, r in zip(ids, labels, x)]
    return spark.createDataFrame(rows, "id long, c string, v array<double>")


def brute(ids, labels, x, k):
    out = {}
    for a in range(len(ids)):
        mine = [b for b in range(len(ids)) if b != a and labels[b] == labels[a]]
        d = {b: float(np.sqrt(((x[a] - x[b]) ** 2).sum())) for b in mine}
        near = sorted(mine, key=lambda b: (d[b], ids[b]))[:k]
        for rank, b in enumerate(near, 1):
            out[(int(ids[a]), rank)] = (int(ids[b]), d[b])
    return out


def check(got, want):
    found = {(r["id"], r["rank"]): (r["neighbor_id"], r["distance"]) for r in got}
    assert found.keys() == want.keys()
    for key, (n, d) in want.items():
        assert found[key][0] == n, key
        assert found[key][1] == pytest.approx(d, abs=1e-9)


def clusters(n, dim, seed, copies=True):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim)) * 20
    x = centres[rng.integers(0, 6, n)] + rng.normal(size=(n, dim))
    if copies:
        x[: n // 3] = x[0]
    labels = np.where(rng.random(n) < 0.8, "big", "small")
    ids = rng.permutation(n * 3)[:n]
    return ids, labels, x


def test_parameters_reach_the_cell_path():
    """The small cell sizes used below do cut the classes of these fixtures."""
    _, labels, _ = clusters(500, 5, 3)
    assert (labels == "small").sum() - 500 // 3 < 12 * neighbors.WORTH_CUTTING < (labels == "big").sum() - 500 // 3
    assert (clusters(300, 4, 8, copies=False)[1] == "small").sum() > 5 * neighbors.WORTH_CUTTING


@pytest.mark.parametrize("cell_rows,block_rows", [(4096, 4096), (4096, 40), (12, 4096), (12, 25)])
def test_matches_brute_force(spark, cell_rows, block_rows):
    """One cell, many blocks, many cells, and both; a third of the rows are copies."""
    ids, labels, x = clusters(500, 5, 3)
    df = frame(spark, ids, labels, x)
    got = knn(df, "id", "c", "v", 5, cell_rows=cell_rows, block_rows=block_rows).collect()
    check(got, brute(ids, labels, x, 5))


def test_neighbor_vectors_belong_to_their_ids(spark):
    """Also for the copies beyond those that are listed as candidates."""
    ids, labels, x = clusters(300, 3, 6)
    where = {int(i): [float(t) for t in r] for i, r in zip(ids, x)}
    rows = knn(frame(spark, ids, labels, x), "id", "c", "v", 4, with_vectors=True).collect()
    check(rows, brute(ids, labels, x, 4))
    assert all(r["neighbor_vec"] == where[r["neighbor_id"]] for r in rows)


def test_smote_between_copies(spark):
    ids, labels, x = clusters(300, 3, 6)
    n = int((labels == "big").sum())
    new = smote.synthesize(frame(spark, ids, labels, x), "id", "c", "v", {"big": n + 200}).collect()
    where = {int(i): r for i, r in zip(ids, x)}
    assert len(new) == 200
    for r in new:
        a, b = where[r["base_id"]], where[r["neighbor_id"]]
        assert np.allclose(r["v"], a + r["lambda"] * (b - a))


def test_unclustered_high_dimension(spark):
    """No structure to prune by: every cell is visited, the answer is the same."""
    rng = np.random.default_rng(9)
    ids, x = np.arange(300), rng.normal(size=(300, 24))
    labels = np.array(["a"] * 300)
    got = knn(frame(spark, ids, labels, x), "id", "c", "v", 4, cell_rows=20).collect()
    check(got, brute(ids, labels, x, 4))


def test_query_subset_sees_all_candidates(spark):
    ids, labels, x = clusters(300, 3, 4)
    df = frame(spark, ids, labels, x)
    some = df.where(F.col("id") % 4 == 0).select("c", "id")
    got = knn(df, "id", "c", "v", 3, queries=some, cell_rows=10).collect()
    want = {key: v for key, v in brute(ids, labels, x, 3).items() if key[0] % 4 == 0}
    check(got, want)


def test_small_classes_and_ties(spark):
    a = [0, 1, 3, 6, 10, 15, 21]
    ids = list(range(1, 8)) + list(range(11, 17))
    x = np.array([[v] for v in a] + [[v + 0.4] for v in a[:6]], dtype=float)
    labels = np.array(["A"] * 7 + ["B"] * 6)
    got = knn(frame(spark, ids, labels, x), "id", "c", "v", 2).collect()
    near = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        near.setdefault(r["id"], []).append(r["neighbor_id"])
    assert near[1] == [2, 3] and near[4] == [3, 5]
    assert all(n < 10 for i, ns in near.items() if i < 10 for n in ns)
    lonely = knn(frame(spark, [1, 2], ["p", "q"], np.zeros((2, 2))), "id", "c", "v", 2).collect()
    assert lonely == []


def test_smote_stays_on_segments(spark):
    ids, labels, x = clusters(300, 4, 8, copies=False)
    df = frame(spark, ids, labels, x)
    n_small = int((labels == "small").sum())
    new = smote.synthesize(df, "id", "c", "v", {"small": n_small + 80}, cell_rows=5).collect()
    assert len(new) == 80 and {r["c"] for r in new} == {"small"}
    where = {int(i): r for i, r in zip(ids, x)}
    cls = {int(i): c for i, c in zip(ids, labels)}
    near = brute(ids, labels, x, 5)
    for r in new:
        assert cls[r["base_id"]] == cls[r["neighbor_id"]] == "small"
        assert r["neighbor_id"] in {near[(r["base_id"], k)][0] for k in range(1, 6)}
        assert 0.0 <= r["lambda"] < 1.0
        a, b = where[r["base_id"]], where[r["neighbor_id"]]
        assert np.allclose(r["v"], a + r["lambda"] * (b - a))
    again = smote.synthesize(df.repartition(5), "id", "c", "v", {"small": n_small + 80}).collect()
    assert {(r["draw"], r["base_id"], r["neighbor_id"]) for r in new} == {
        (r["draw"], r["base_id"], r["neighbor_id"]) for r in again
    }


def test_augment_counts_and_errors(spark):
    x = np.arange(30, dtype=float).reshape(-1, 1)
    labels = np.array(["a"] * 20 + ["b"] * 7 + ["tiny"] * 3)
    df = frame(spark, range(30), labels, x)
    full = smote.augment(df, "id", "c", "v", {"a": 20, "b": 19})
    got = {(r["c"], r["is_synthetic"]): r["count"] for r in full.groupBy("c", "is_synthetic").count().collect()}
    assert got == {("a", False): 20, ("b", False): 7, ("b", True): 12, ("tiny", False): 3}
    with pytest.raises(ValueError, match="below"):
        smote.augment(df, "id", "c", "v", {"a": 10})
    with pytest.raises(ValueError, match="more than 5"):
        smote.augment(df, "id", "c", "v", {"tiny": 10})


def test_nothing_to_add(spark):
    """Targets equal to the class sizes give no synthetic rows."""
    df = frame(spark, range(8), ["a"] * 8, np.arange(8.0).reshape(-1, 1))
    assert smote.synthesize(df, "id", "c", "v", {"a": 8}).collect() == []
    assert smote.augment(df, "id", "c", "v", {"a": 8}).count() == 8


def test_exactly_k_rows_is_too_few(spark):
    df = frame(spark, range(5), ["u"] * 5, np.arange(5.0).reshape(-1, 1))
    with pytest.raises(ValueError, match="more than 5"):
        smote.synthesize(df, "id", "c", "v", {"u": 8})


def test_rare_class_multiplied_many_times(spark, monkeypatch):
    """Many draws per row go through salted copies and none is lost."""
    from skewlens.operators import sampling

    monkeypatch.setattr(sampling, "DRAWS_PER_ROW", 10)
    df = frame(spark, range(6), ["u"] * 6, np.arange(6.0).reshape(-1, 1))
    new = smote.synthesize(df, "id", "c", "v", {"u": 1006}).collect()
    assert sorted(r["draw"] for r in new) == list(range(1000))
    assert {r["base_id"] for r in new} == set(range(6))


@pytest.mark.parametrize("dim, prunes", [(64, False), (2, True)])
def test_classes_that_cells_do_not_help_are_searched_whole(spark, dim, prunes, monkeypatch):
    rng = np.random.default_rng(dim)
    x = rng.normal(size=(600, dim)) if not prunes else rng.normal(size=(600, dim)) + rng.integers(0, 9, (600, 1)) * 50
    seen = []
    measured = neighbors._pruned
    monkeypatch.setattr(neighbors, "_pruned", lambda *a: seen.append(measured(*a)) or seen[-1])
    ids, labels = np.arange(600), np.array(["a"] * 600)
    check(knn(frame(spark, ids, labels, x), "id", "c", "v", 3, cell_rows=20).collect(), brute(ids, labels, x, 3))
    assert seen == [{"a"} if prunes else set()]


def test_boxes_hold_their_rows_and_open_what_is_near():
    """Many cells for little work: a row meets as many cuts as the tree is deep."""
    rng = np.random.default_rng(1)
    x = np.column_stack([rng.integers(0, 50, 20_000), rng.random(20_000) * 100, rng.integers(0, 9, 20_000)]).astype(float)
    boxes = neighbors.Boxes(x[::5])
    cell = np.concatenate([c for _, c, _ in boxes.assign(x, np.arange(len(x)))])
    sizes = np.bincount(cell, minlength=len(boxes))
    assert len(boxes) >= 500 and sizes.max() < 400
    found = np.unique(cell)
    sides = [np.array([f(x[cell == c], axis=0) for c in found]) for f in (np.min, np.max)]
    boxes.bounded(found, *sides)
    theta = np.full(50, 2.0)
    opened = list(boxes.open_cells(x[:50], np.arange(50), cell[:50], theta))
    pairs = {(int(r), int(c)) for rows, cells in opened for r, c in zip(rows, cells)}
    near = np.sqrt(((x[:50, None] - x[None]) ** 2).sum(axis=2)) <= 2.0
    assert {(int(r), int(cell[p])) for r, p in zip(*np.nonzero(near)) if cell[p] != cell[r]} <= pairs
    assert len(pairs) < 0.1 * 50 * len(boxes)


def test_boxes_on_a_grid_with_ties(spark):
    """Whole numbers: many equal values on every axis and many equal distances."""
    rng = np.random.default_rng(2)
    x = rng.integers(0, 12, (900, 3)).astype(float) - 4.0
    ids, labels = rng.permutation(2000)[:900], np.array(["a"] * 900)
    check(knn(frame(spark, ids, labels, x), "id", "c", "v", 4, cell_rows=15).collect(), brute(ids, labels, x, 4))


@pytest.mark.parametrize("crowd", [5, 100_000])
def test_only_crowded_copies_are_salted(spark, crowd, monkeypatch):
    """Groups of copies beyond k: the listed ids are repeated for the large ones alone."""
    monkeypatch.setattr(neighbors, "COPY_ROWS", crowd)
    crowded, kept = [], neighbors.pin
    monkeypatch.setattr(
        neighbors, "pin", lambda df, *a, name="pinned": kept(df, *a, name=name) if name != "crowded" else crowded.append(df.count()) or kept(df, *a, name=name)
    )
    x = np.repeat(np.arange(20.0), 8).reshape(-1, 1)
    x[:40] = 0.0
    ids, labels = np.arange(160), np.array(["a"] * 160)
    check(knn(frame(spark, ids, labels, x), "id", "c", "v", 3).collect(), brute(ids, labels, x, 3))
    assert crowded == [1 if crowd == 5 else 0]


@pytest.mark.parametrize("sign", [1, -1])
def test_order_lines_with_ids_beyond_a_long(spark, data, tmp_path, sign):
    """Some order keys as they are and some of a table 360 times sf0.1: the same SQL, computed
    in whole numbers of 128 bits."""
    con = duckdb.connect()
    moved = f"{sign} * (l_orderkey + l_orderkey % 3 * 27000000)"
    con.execute(
        f"COPY (SELECT * REPLACE ({moved} AS l_orderkey) FROM '{data}/lineitem.parquet') TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)"
    )
    con.execute(f"CREATE VIEW lineitem AS SELECT * REPLACE (l_orderkey::HUGEINT AS l_orderkey) FROM '{tmp_path}/lineitem.parquet'")
    got = QUERIES["knn_large_class"](spark, str(tmp_path))
    beyond, within = (got.where(f"abs(id) {op} 9223372036854775807").count() for op in (">", "<="))
    assert beyond > 0 and within > 0
    assert compare(got, con, ORACLES["knn_large_class"]) is None


def test_ids_that_fit_stay_longs(spark, data):
    assert dict(QUERIES["knn_large_class"](spark, data).dtypes)["id"] == "bigint"


@pytest.mark.parametrize("keys, wide", [([11529215], False), ([11529216], True), ([7, -11529216], True), ([], False)])
def test_a_step_beyond_a_long_is_foreseen(spark, keys, wide):
    """An id just below and just above the largest long, and none at all."""
    ddl = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long"
    lines = spark.createDataFrame([(key, 0, 0, 0) for key in keys], ddl)
    assert exceeds_long(lines) == wide
    if not wide:
        assert [r[0] for r in lines.select(F.expr(ITEM_ID)).collect()] == [key * 8 * 10**11 for key in keys]
