import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from skewlens.llm import langid


def test_held_out_accuracy(spark, data):
    docs = spark.read.parquet(f"{data.replace('sf0.001', 'sf0.01')}/documents.parquet")
    model = langid.fit(docs.where(~langid.held_out()), sample_rows=600)
    held = langid.identify(docs.where(langid.held_out()), model, ["lang"])
    right, total = held.agg(F.count_if(F.expr("lang = lang_pred")), F.count("*")).head()
    assert right >= 0.97 * total
    assert held.where("lang_score < 0 OR lang_score > 1").isEmpty()


def test_only_the_text_counts(documents):
    model = langid.fit(documents)
    plain = langid.identify(documents, model, ["doc_id"])
    other = langid.identify(documents.withColumn("lang", F.lit("zz")).withColumn("source", F.lit("q")), model, ["doc_id"])
    assert plain.exceptAll(other).isEmpty()


def test_grams_do_not_depend_on_neighbours():
    grams = langid.Grams()
    texts = ["Abc d", "", "é!! Öx", "   ", "x\U00010400y", "a" * 5000]
    together = list(grams(texts, block=10**6))
    for text, (where, count) in zip(texts, together):
        [(alone, n)] = grams([text])
        assert alone.tolist() == where.tolist() and n.tolist() == count.tolist()
    assert len(together[1][0]) == len(together[3][0]) == 0
    # a, b, c, d; ab, bc, " a", "c ", " d", "d "; " ab", "abc", "bc ", " d "
    assert together[0][1].sum() == 14


def plain_grams(text):
    """One to three characters from each place of the letters, other runs as one space."""
    words, word = [], ""
    for c in text.lower() + " ":
        if c.isalpha():
            word += c
        elif word:
            words, word = [*words, word], ""
    line = " " + " ".join(words) + " " if words else ""
    for i in range(len(line) - 1):
        if line[i] != " ":
            yield line[i]
        yield line[i : i + 2]
        if line[i + 1] != " ":
            yield line[i : i + 3]


def plain_slot(gram, bits):
    most = (1 << 64) - 1
    if len(gram) == 1:
        h = ord(gram) * 0x9E3779B97F4A7C15
    else:
        h = 0
        for c in gram:
            h = ((h << 21) & most) ^ ord(c)
    h = (h & most) * (0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)[len(gram) - 1] & most
    h ^= h >> 29
    return (h * 0x9E3779B97F4A7C15 & most) >> (64 - bits)


def plain_identify(text, model, bits):
    counts = Counter(plain_slot(g, bits) for g in plain_grams(text or ""))
    if not counts:
        return "und", 0.0
    values = {s: (1 + math.log(n)) * float(model.idf[s]) for s, n in counts.items()}
    norm = math.sqrt(sum(v * v for v in values.values()))
    odds = []
    for k in range(len(model.languages)):
        z = float(model.weights[-1][k]) + sum(v / norm * float(model.weights[s][k]) for s, v in values.items())
        odds.append(z / model.temperature)
    shares = [math.exp(z - max(odds)) for z in odds]
    best = max(range(len(odds)), key=lambda k: odds[k])
    return model.languages[best], shares[best] / sum(shares)


def test_scores_against_a_plain_pass(documents, make_docs):
    """Every prediction against one text at a time: n-grams, TF-IDF, softmax in plain Python."""
    bits = 12
    model = langid.fit(documents, sample_rows=200, bits=bits)
    odd = make_docs([None, "", "?! 12", "É", "x\U00010400y ß", "a-b_c", "word " * 4000], ids=range(10**6, 10**6 + 7))
    every = documents.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    found = langid.identify(every, model).collect()
    assert len(found) == documents.count() + 7
    for r in found:
        name, score = plain_identify(r["text"], model, bits)
        assert r["lang_pred"] == name and abs(r["lang_score"] - score) < 1e-5


def test_calibration():
    r = np.random.default_rng(0)
    logits = r.normal(size=(4000, 3))
    labels = np.array([r.choice(3, p=p) for p in langid.softmax(logits)])
    assert abs(langid.calibrated(logits * 3, labels) - 3) < 0.4


def test_odd_and_empty(odd_docs, no_docs, make_docs):
    trained = make_docs(["das ist ein haus", "the house is old"] * 4, source="s").withColumn(
        "lang", F.when(F.col("doc_id") % 2 == 0, "de").otherwise("en")
    )
    model = langid.fit(trained)
    rows = langid.identify(odd_docs, model).collect()
    assert len(rows) == 10 and len(rows[0]) == len(odd_docs.columns)
    for r in rows:
        blank = not any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == blank and (r["lang_score"] == 0) == blank
    assert langid.fit(no_docs) is None and langid.fit(odd_docs.where("lang IS NULL")) is None
    assert {r["lang_pred"] for r in langid.identify(odd_docs, None).collect()} == {"und"}
    assert langid.identify(no_docs, model).count() == 0


def test_many_labels(spark):
    """Beyond the bound the most frequent labels are learned, and nothing fails."""
    rows = [(i, f"some words number {i % 3} und mehr davon", "en" if i % 2 else "de") for i in range(60)]
    rows += [(100 + i, f"rare words {i}", f"x{i:04d}") for i in range(1100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df, sample_rows=400, bits=8, max_languages=20)
    assert len(model.languages) == 20 and {"de", "en", "x0000"} <= set(model.languages)
    found = langid.identify(df, model, ["doc_id"])
    assert found.count() == len(rows) and {r["lang_pred"] for r in found.collect()} <= set(model.languages)
