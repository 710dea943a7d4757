"""The numpy kernel of the neighbour search on its own, against a plain double loop."""

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from skewlens.operators import neighbors


@settings(max_examples=150, deadline=None)
@given(
    data=st.data(),
    n=st.integers(1, 30),
    m=st.integers(1, 12),
    d=st.integers(1, 4),
    need=st.integers(1, 8),
    scale=st.sampled_from([1.0, 2.0**-10, 1e6]),
)
def test_nearest(data, n, m, d, need, scale):
    """Small integer grids give many equal distances; offsets far from zero test the
    rough distances. All offsets are exact, so equal distances are equal as floats."""
    grid = st.lists(st.integers(-2, 2), min_size=d, max_size=d)
    points = np.array(data.draw(st.lists(grid, min_size=n, max_size=n)), dtype=float) + scale
    queries = np.array(data.draw(st.lists(grid, min_size=m, max_size=m)), dtype=float) + scale
    ids = np.array(data.draw(st.permutations(range(100, 100 + n))))
    r, c, dist = neighbors.nearest(queries, points, ids, need)
    got = {}
    for a, b, x in zip(r, c, dist):
        got.setdefault(a, []).append((round(float(x), 9), int(ids[b])))
    for q in range(m):
        away = np.sqrt(((points - queries[q]) ** 2).sum(axis=1))
        want = sorted((round(float(x), 9), int(i)) for x, i in zip(away, ids))[:need]
        assert got[q] == want


@settings(max_examples=50, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c"]), max_size=40))
def test_rows_by_class(labels):
    found = {k: rows.tolist() for k, rows in neighbors.rows_by_class(pa.array(labels, pa.string()))}
    assert found == {k: [i for i, x in enumerate(labels) if x == k] for k in set(labels)}


def test_matrix_of_sliced_batches():
    column = pa.array([[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]])
    got = neighbors._matrix(pa.chunked_array([column.slice(1, 1), column.slice(2)]))
    assert got.tolist() == [[3.0, 4.0], [5.0, 6.0]]
