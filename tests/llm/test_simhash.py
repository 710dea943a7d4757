import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from skewlens.llm import simhash
from skewlens.llm.components import components


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, distance=3):
    """Smallest id reachable, for ``[(id, fingerprint)]``."""
    root = {i: i for i, _ in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    values = np.array([p for _, p in prints], np.uint64)
    for k, (i, p) in enumerate(prints):
        near = np.flatnonzero(np.bitwise_count(values[k + 1 :] ^ np.uint64(p)) <= distance)
        for j in near + k + 1:
            a, b = sorted((find(i), find(prints[j][0])))
            root[b] = a
    return {i: find(i) for i, _ in prints}


def test_against_brute_force(documents, texts):
    rows = simhash.near_duplicates(documents).select("doc_id", simhash.hex_digits().alias("f"), "component_id").collect()
    prints = [(i, brute_fingerprint(t)) for i, t in texts.items()]
    assert {r["doc_id"]: r["f"] for r in rows} == {i: f"{p:016x}" for i, p in prints}
    assert {r["doc_id"]: r["component_id"] for r in rows} == brute_components(prints)


def planted(seed, n=400):
    """Random fingerprints, chains of near ones, and pairs exactly 3 and 4 bits apart."""
    r = np.random.default_rng(seed)
    values = set(r.integers(0, 2**64, n, np.uint64).tolist())
    for base in list(values)[:60]:
        for flips in (1, 2, 3, 4):
            for b in r.choice(64, flips, replace=False):
                base ^= 1 << int(b)
            values.add(base)
    return sorted(values)


@pytest.mark.parametrize("partitions", [2, 3, 4, 5, 6])
def test_links_for_any_plan(spark, partitions):
    values = planted(partitions)
    r = np.random.default_rng(1)
    groups = [sorted(g.tolist()) for g in np.array_split(r.permutation(64), partitions)]
    thresholds, left = [-1] * partitions, 3 - partitions + 1 + partitions
    for k in r.permutation(partitions).tolist():
        add = min(left, int(r.integers(0, 4)))
        thresholds[k] += add
        left -= add
    thresholds[0] += left
    rows = [(int(np.uint64(v).view(np.int64)), k) for k, v in enumerate(values)]
    distinct = spark.createDataFrame(rows, "fp long, rep long")
    got = sorted(tuple(sorted((x["a"], x["b"]))) for x in simhash.fingerprint_links(distinct, list(zip(groups, thresholds)), 3).collect())
    want = [(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if (values[i] ^ values[j]).bit_count() <= 3]
    assert got == want


def test_plan_keeps_the_principle():
    r = np.random.default_rng(3)
    for values in (r.integers(0, 2**64, 3000, np.uint64), np.zeros(5, np.uint64), np.zeros(0, np.uint64)):
        for rows in (10, 10**6, 10**10):
            parts = simhash.plan(values, rows)
            assert sorted(b for g, _ in parts for b in g) == list(range(64))
            assert sum(t for _, t in parts) == 3 - len(parts) + 1


def test_correlated_bits_share_a_group():
    r = np.random.default_rng(5)
    bits = r.integers(0, 2, (500, 16)).astype(float)
    bits[:, 9] = bits[:, 2]
    groups = simhash.correlated_groups(bits, 4)
    assert any({2, 9} <= set(g) for g in groups) and sorted(sum(groups, [])) == list(range(16))


def test_components(spark):
    r = np.random.default_rng(0)
    links = [(int(a), int(b)) for a, b in r.integers(0, 300, (180, 2))] + [(1000 + k, 1001 + k) for k in range(200)]
    links += [(5000, 5000 + k) for k in range(1, 400)] + [(7, 7), (7, 7)]
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {}
    find = lambda i: i if root.setdefault(i, i) == i else find(root[i])
    for a, b in links:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    assert got == {i: find(i) for a, b in links if a != b for i in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_and_empty(odd_docs, no_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    assert len(rows) == 10
    by_id = {r["doc_id"]: r["component_id"] for r in rows if r["doc_id"] is not None}
    assert by_id[1] == by_id[2] == by_id[3] == 1  # no words: fingerprint zero, linked like any other
    assert by_id[5] == by_id[6] == 5
    assert simhash.near_duplicates(no_docs).count() == 0
    kept = simhash.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id IS NOT NULL").collect()) == [1, 4, 5, 7]
    assert kept.where("doc_id IS NULL").count() == 2


def test_a_large_group_of_copies(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("the same words in every text of it").alias("text"))
    got = simhash.near_duplicates(docs).groupBy("component_id").count().collect()
    assert [(r["component_id"], r["count"]) for r in got] == [(0, 3000)]


def test_texts_under_one_id_are_kept_apart(spark):
    """A repeated id neither joins the groups of its texts nor loses one of them."""
    a = "the first text has quite a few words of its own and no others"
    b = "something else entirely is written here by another hand altogether today"
    rows = [(1, a), (1, b), (2, b), (3, a), (1, a), (None, a), (4, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS _text", "1 AS fp")
    kept = sorted(((r["doc_id"], r["text"]) for r in simhash.one_of_each(df).collect()), key=str)
    assert sorted([x for x in kept if x[0] != 4], key=str) == sorted([(1, a), (1, b), (None, a)], key=str)
    assert len([x for x in kept if x[0] == 4]) == 1
    classes = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(df).collect()}
    assert classes == {(1, 1), (2, 1), (3, 1), (None, 1), (4, 4)}
