import random

import pytest
from pyspark.sql import functions as F

from skewlens.llm import mixing
from skewlens.session import stage


def brute_targets(sizes):
    """``{source: target}`` from ``{source: size}``; sources in code point order, null last."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    target, free, left = {}, set(order), sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 3 * sizes[s]}
        if not over:
            return target | {s: weight[s] * level for s in free}
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


def check(docs, near):
    rows = mixing.with_copies(docs).collect()
    size, taken = {}, {}
    for r in rows:
        assert r["size"] == len((r["text"] or "").encode().split()) and r["taken"] == r["copies"] * r["size"]
        assert 0 <= r["copies"] <= 3
        size[r["source"]] = size.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    want = brute_targets(size)
    for r in rows:
        assert r["source_size"] == size[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]], rel=1e-9, abs=1e-9)
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(near * t, 1)
    return rows


def test_given_documents(documents):
    rows = check(documents, 0.05)
    again = mixing.with_copies(documents.repartition(3)).collect()
    assert sorted(r["copies"] for r in rows) == sorted(r["copies"] for r in again)
    assert {(r["doc_id"], r["taken"]) for r in rows} == {(r["doc_id"], r["taken"]) for r in again}


def test_capped_sources(spark):
    r = random.Random(2)
    rows = [(k, " ".join("x" * r.randrange(1, 60)), r.choice(["a", "é", "Z", "￮", "\U0001f600", None])) for k in range(600)]
    rows += [(1000 + k, "w " * 400, "big") for k in range(300)]
    check(spark.createDataFrame(rows, "doc_id long, text string, source string"), 0.01)


def test_hot_class_is_cut_in_buckets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANK_ROWS", 64)
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", 0)
    docs = spark.range(4000).select(
        F.col("id").alias("doc_id"), F.lit("same words here").alias("text"), F.when(F.col("id") % 4 < 3, "a").otherwise("b").alias("source")
    )
    check(docs, 0.001)


def test_dual(spark):
    rows = [("a", 1000, 10.0), ("b", 10, 30.0), ("c", 5, 0.0), ("d", 0, 0.0), ("e", 10**12, 10.0**11)]
    got = mixing.balance(spark.createDataFrame(rows, "source string, source_size long, target double"))
    for r in got.collect():
        if r["target"] and r["source_size"]:
            assert r["source_size"] * 2.718281828459045 ** r["lambda"] == pytest.approx(r["target"], rel=1e-9)
        else:
            assert r["lambda"] is None


def test_mixed_rows(documents):
    counted = stage(mixing.with_copies(documents))
    rows = mixing.mixed(documents)
    assert rows.columns == documents.columns
    want = {r["doc_id"]: r["copies"] for r in counted.collect() if r["copies"]}
    assert {r["doc_id"]: r["count"] for r in rows.groupBy("doc_id").count().collect()} == want


def test_odd_and_empty(odd_docs, no_docs):
    assert len(check(odd_docs, 1.0)) == 10
    assert mixing.with_copies(no_docs).count() == 0 and mixing.mixed(no_docs).count() == 0
    empty = odd_docs.where("text IS NULL")
    assert {r["taken"] for r in mixing.with_copies(empty).collect()} == {0}
