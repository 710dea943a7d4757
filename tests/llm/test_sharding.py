import zlib

import numpy as np
from pyspark.sql import functions as F

from skewlens.llm.sharding import Tree, shard, with_shard


def test_law_and_slots(documents, texts):
    rows = shard(documents, 24).collect()
    assert len(rows) == len(texts)
    by_shard = {}
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 8, zlib.crc32(raw), "key")
        assert r["grown_shard"] in (r["shard"], 24) and 0 <= r["shard"] < 24
        by_shard.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(slots) == list(range(len(slots))) for slots in by_shard.values())


def test_even_and_stable(spark):
    keys = spark.range(60_000).withColumnRenamed("id", "doc_id")
    got = with_shard(with_shard(keys, Tree.of(24)), Tree.of(25), out="grown")
    counts = np.array([r["count"] for r in got.groupBy("shard").count().collect()])
    assert len(counts) == 24 and (abs(counts / 2500 - 1) < 0.1).all()
    moved = got.where("shard <> grown")
    assert moved.where("grown <> 24").isEmpty() and abs(moved.count() / 2400 - 1) < 0.1


def test_movement_stays_in_the_heavier_subtree(spark):
    keys = spark.range(20_000).withColumnRenamed("id", "doc_id")
    before = Tree((((1.0, 1.0), (1.0, 1.0)), ((1.0, 1.0), (1.0, 1.0))))
    after = Tree((((1.0, 1.0), (1.0, 1.0)), ((1.0, 1.0), (1.0, 3.0))))
    got = with_shard(with_shard(keys, before), after, out="now")
    moved = got.where("shard <> now")
    # the weight of region 1, of its second rack and of shard 7 rose: nothing moves elsewhere
    assert moved.where("now < 4").isEmpty()
    assert moved.where("shard >= 4 AND now < 6").isEmpty()
    assert moved.where("shard IN (6, 7) AND now = 6").isEmpty()
    share = got.where("now = 7").count() / 20_000
    assert abs(share - (6 / 10) * (4 / 6) * (3 / 4)) < 0.02


def test_odd_and_empty(odd_docs, no_docs):
    rows = shard(odd_docs, 5).collect()
    assert len(rows) == 10 and all(r["shard"] is not None and r["law"] == "key" for r in rows)
    assert {r["size"] for r in rows if r["text"] is None} == {8}
    assert len({(r["shard"], r["slot"]) for r in rows}) == 10
    assert shard(no_docs).count() == 0
    assert shard(odd_docs, 1, grown=False).where(F.col("grown_shard").isNotNull()).isEmpty()
