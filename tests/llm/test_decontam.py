import random
import re

import numpy as np
import pytest

from skewlens.llm import decontam


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_common_words():
    r = np.random.default_rng(0)
    for _ in range(200):
        a, b = (r.integers(0, 6, r.integers(0, 40)) for _ in range(2))
        assert decontam.common_words(a, b) == lcs(a.tolist(), b.tolist())


@pytest.fixture(scope="module")
def bench(spark, data):
    return spark.read.parquet(f"{data}/benchmark.parquet")


def plain(text):
    return " ".join(re.findall(r"\w+", text.lower()))


def test_whole_passages(documents, texts, bench):
    """Every item that a document holds word for word is found, and no other."""
    found = {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(documents, bench).collect()}
    items = [(r["item_id"], plain(r["text"])) for r in bench.collect()]
    assert found == {(d, i) for d, t in texts.items() for i, item in items if item in plain(t)}
    kept = {r["doc_id"] for r in decontam.clean(documents, bench).collect()}
    assert kept == texts.keys() - {d for d, _ in found}


def test_paraphrases(documents, texts, bench, spark):
    """Every seventh word is replaced and punctuation and case change; still found."""
    r = random.Random(4)
    items = {x["item_id"]: plain(x["text"]).split() for x in bench.collect()}
    rows, want = [], set()
    clean_docs = [t for t in texts.values() if len(t.split()) > 80][:40]
    for k, (item, words) in enumerate(items.items()):
        if len(words) < 15:
            continue
        told = [w if (j + k) % 7 else "otherword" for j, w in enumerate(words)]
        host = clean_docs[k % len(clean_docs)].split()
        at = r.randrange(len(host))
        rows.append((10_000 + k, " ".join([*host[:at], *(w.upper() + "," for w in told), *host[at:]])))
        want.add((10_000 + k, item))
    docs = documents.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    found = {(x["doc_id"], x["item_id"]) for x in decontam.find_leaks(docs, bench).collect()}
    assert len(want & found) >= 0.95 * len(want)


def test_shuffled_words_are_no_leak(documents, bench, spark):
    r = random.Random(5)
    rows = []
    for k, x in enumerate(bench.collect()):
        words = plain(x["text"]).split()
        r.shuffle(words)
        if len(words) > 25:
            rows.append((20_000 + k, " ".join(words)))
    docs = documents.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    found = decontam.find_leaks(docs, bench).where("doc_id >= 20000").count()
    assert found <= 0.05 * len(rows)


def test_blocks_of_the_benchmark_agree(documents, bench, monkeypatch):
    columns = ["doc_id", "item_id"]
    whole = decontam.find_leaks(documents, bench).select(*columns).collect()
    monkeypatch.setattr(decontam, "PARTS", 8)
    parts = decontam.find_leaks(documents, bench).select(*columns).collect()
    assert sorted(whole) == sorted(parts)
    monkeypatch.setattr(decontam, "SPACES", 3)  # several reads of the texts
    assert sorted(whole) == sorted(decontam.find_leaks(documents, bench).select(*columns).collect())


def test_odd_and_empty(odd_docs, no_docs, bench, spark):
    assert decontam.find_leaks(odd_docs, bench).count() == 0
    assert decontam.clean(odd_docs, bench).count() == 10
    assert decontam.find_leaks(no_docs, bench).count() == 0
    none = spark.createDataFrame([(1, None), (None, "text without id of some length"), (3, ""), (4, "too short")], "item_id long, text string")
    assert decontam.find_leaks(odd_docs, none).count() == 0
    same = spark.createDataFrame([(1, "one two three four five six")] * 2, "item_id long, text string")
    held = spark.createDataFrame([(None, "x one two three four five six y")] * 2 + [(1, None)], "doc_id long, text string")
    assert decontam.find_leaks(held, same).count() == 2
    assert [r["doc_id"] for r in decontam.clean(held, same).collect()] == [1]


def test_long_items_are_compared_in_parts(spark):
    r = random.Random(1)
    words = [f"word{r.randrange(5000)}" for _ in range(300)]
    bench = spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join(words[:150])), (2, " ".join(r.sample(words, 300)))], "doc_id long, text string")
    assert {x["doc_id"] for x in decontam.find_leaks(docs, bench).collect()} == {1}


def test_items_in_many_documents(spark):
    """One item in 5 % of the documents and one in a third: their words are frequent by that alone."""
    r = random.Random(6)
    host = [f"host{k}" for k in range(400)]
    items = {i: [f"item{i}x{k}" for k in range(16)] for i in (1, 2, 3)}
    rows, want = [], set()
    for d in range(1200):
        words = [r.choice(host) for _ in range(100)]
        for i, every in ((1, 20), (2, 3)):
            if d % every == 0:
                at = r.randrange(len(words))
                told = [w if (k + d) % 7 or d % 2 else "otherword" for k, w in enumerate(items[i])]
                words[at:at] = told
                want.add((d, i))
        if d % 3 == 1:  # the words of an item, but not in its order: no leak
            words += r.sample(items[2], 16)
        rows.append((d, " ".join(words)))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(x["doc_id"], x["item_id"]) for x in decontam.find_leaks(docs, bench).collect()}
    assert want <= found and len(found - want) <= 0.05 * 400


def test_half_of_a_part_without_the_answer_is_no_leak(spark):
    words = [f"word{k}" for k in range(128)]
    bench = spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")
    half = " ".join(f"{w} other{k}" for k, w in enumerate(words[:34]))
    most = " ".join([*words[:30], "other", *words[32:60]])
    docs = spark.createDataFrame([(1, half), (2, most)], "doc_id long, text string")
    assert {x["doc_id"] for x in decontam.find_leaks(docs, bench).collect()} == {2}


@pytest.mark.parametrize("words", [5, 6, 9, 14])
def test_short_items_side_by_side(spark, words):
    """Twelve short items in one document, back to back: every one is found, and none where it is not."""
    r = random.Random(words)
    items = {i: [f"i{i}w{k}" for k in range(words)] for i in range(12)}
    host = [f"host{k}" for k in range(300)]
    rows = [(d, " ".join(r.choice(host) for _ in range(150))) for d in range(60)]
    listed = [w for item in items.values() for w in item]
    rows.append((100, " ".join([*host[:20], *listed, *host[20:40]])))
    mixed = [w for item in items.values() for w in r.sample(item, 2)]
    rows.append((101, " ".join(mixed)))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(x["doc_id"], x["item_id"]) for x in decontam.find_leaks(docs, bench).collect()}
    assert found == {(100, i) for i in items}


def test_items_of_a_few_words(spark):
    """Under five words: found word for word alone, across lines and punctuation, not in pieces."""
    texts = {1: "Paris", 2: "blue whale", 3: "the speed of light", 4: "", 5: "...", 6: "light speed"}
    docs = {
        1: "we went to PARIS, then home",
        2: "a blue\nwhale; the speed of sound",
        3: "blue is the whale. The speed of light!",
        4: "the speed of", 5: "light", 6: None, 7: "speed light speed light",
    }
    longer = {7: " ".join(f"word{k}" for k in range(20))}
    schema = "item_id long, text string"
    want = {(1, 1), (2, 2), (3, 3), (7, 6)}
    table = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    for items in (texts, texts | longer):
        leaks = decontam.find_leaks(table, spark.createDataFrame(list(items.items()), schema))
        assert {(x["doc_id"], x["item_id"]) for x in leaks.collect()} == want


def test_restored_terms():
    full = np.array([1, 2, 3, 4, 5], np.float32)
    idf = np.array([0, 0, 0, 0, 5], np.float32)
    back = decontam.restored([np.array([0, 1, 2, 3]), np.array([4, 4])], idf, full, np.array([0]))
    assert back.tolist() == [0, 0, 0, 4, 5] and idf[3] == 0
