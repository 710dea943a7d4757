import random

import numpy as np
from pyspark.sql import functions as F

from skewlens.llm import substrings


def brute(texts, window):
    """``{id: removed word places}`` of ``{id: text}``."""
    first = {}
    split = {i: (t or "").encode().split() for i, t in texts.items()}
    for i in sorted(split):
        for k in range(len(split[i]) - window + 1):
            first.setdefault(tuple(split[i][k : k + window]), i)
    gone = {}
    for i, words in split.items():
        gone[i] = {
            p for k in range(len(words) - window + 1) if first[tuple(words[k : k + window])] < i for p in range(k, k + window)
        }
    return gone


def spans(found):
    return {r["doc_id"]: {p for s in r["spans"] for p in range(s["from"], s["to"])} for r in found.collect()}


def test_planted_passages(spark):
    r = random.Random(0)
    word = lambda: f"w{r.randrange(400)}"
    passages = [[word() for _ in range(n)] for n in (50, 51, 49, 120, 75, 300)]
    texts = {}
    for i in range(120):
        words = []
        for _ in range(r.randrange(1, 4)):
            words += [word() for _ in range(r.randrange(0, 90))]
            if r.random() < 0.7:
                passage = r.choice(passages)
                cut = r.randrange(0, 30) if r.random() < 0.3 else 0
                words += passage[cut:]
        texts[i] = " ".join(words)
    texts[200], texts[201] = texts[3], texts[3]
    texts[202] = " ".join(["same"] * 400)
    texts[203] = " ".join(["same"] * 130)
    texts[204] = "\n".join(texts[5].split())
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert spans(substrings.find_repeats(docs)) == brute(texts, 50)
    assert spans(substrings.find_repeats(docs, window=20, phrase=6)) == brute(texts, 20)


def test_small_shards_and_streams_agree(documents, monkeypatch):
    whole = spans(substrings.find_repeats(documents))
    monkeypatch.setattr(substrings, "SHARD_PHRASES", 7)
    monkeypatch.setattr(substrings, "STREAM_BYTES", 5000)
    assert spans(substrings.find_repeats(documents)) == whole


def test_a_stream_settles_its_own_windows():
    """Of every window only the rows of a stream's smallest doc_id are left to be compared."""
    r = np.random.default_rng(3)
    anchor, doc, at = (r.integers(0, n, 4000) for n in (15, 300, 9))
    held = list({(int(a), int(a) % 4, int(d), int(d) * 7, int(p)) for a, d, p in zip(anchor, doc, at)})
    columns = [np.array(c, np.int32 if k == 4 else np.int64) for k, c in enumerate(zip(*held))]
    found = substrings._settled(*columns).to_pylist()
    least = {}
    for a, h, d, _, _ in held:
        least[a, h] = min(d, least.get((a, h), d))
    covered, left = {}, {}
    for a, h, d, t, p in held:
        known = d > least[a, h]
        rows = covered if known else left
        rows.setdefault((0, 0, True, d, t) if known else (a, h, False, d, t), []).append(p)
    want = {k: sorted(v) for k, v in {**covered, **left}.items()}
    assert {tuple(x[c] for c in substrings._FOUND[:5]): x["at"] for x in found} == want
    assert len(found) == len(want)


def test_phrases_of_one_document_are_split(spark, monkeypatch):
    monkeypatch.setattr(substrings, "SHARD_PHRASES", 50)
    rows = [(k, 1) for k in range(900)] + [(k, 2 + k) for k in range(900, 1000)]
    shared = spark.createDataFrame(rows, "anchor long, first long")
    of = substrings._sharded(shared, 20)
    assert of.select("anchor", "first").distinct().count() == 1000 == of.count()
    assert of.where("first = 1").groupBy("shard").count().agg(F.max("count")).head()[0] < 450


def test_kept_text(documents, texts):
    found = substrings.find_repeats(documents)
    gone = brute(texts, 50)
    for r in substrings.kept_words(documents, found).collect():
        words = texts[r["doc_id"]].encode().split()
        assert r["text"].encode() == b" ".join(w for k, w in enumerate(words) if k not in gone[r["doc_id"]])


def test_odd_and_empty(odd_docs, no_docs, spark):
    rows = substrings.find_repeats(odd_docs).collect()
    assert len(rows) == 10 and all(r["spans"] == [] for r in rows)
    assert substrings.find_repeats(no_docs).count() == 0
    text = " ".join(f"x{k}" for k in range(60))
    rows = [(None, text), (4, text), (4, text), (9, text + " tail"), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, [tuple(s) for s in r["spans"]]) for r in substrings.find_repeats(docs).collect())
    assert got == [(-1, []), (2, []), (4, []), (4, []), (9, [(0, 60)])]


def test_a_passage_in_every_document(spark):
    passage = " ".join(f"p{k}" for k in range(64))
    docs = spark.range(2000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("a"), F.col("id"), F.lit(" " + passage + " z"), F.col("id")).alias("text")
    )
    found = substrings.find_repeats(docs).select("doc_id", F.col("spans").cast("string").alias("s"))
    assert {r["s"]: r["count"] for r in found.groupBy("s").count().collect()} == {"[]": 1, "[{1, 65}]": 1999}
