import math
import random
import re

import pytest
from pyspark.sql import functions as F

from skewlens.llm import toxicity

GRAMMAR = toxicity.Grammar({"zork*": 1.0, "blat": 0.5})


@pytest.mark.parametrize(
    "text, label",
    [
        ("You are an idiot.", "aimed insult"),
        ("What an idiot that was", "plain insult"),
        ("You are not an idiot", "denied insult"),
        ("He said you are an idiot!", "reported insult"),
        ("I will kill it", "plain threat"),
        ("and then you will be killed", "aimed threat"),
        ("never say kill", "reported threat"),
        ("ZORKING about", "plain insult"),
        ("a blat here", "plain insult"),
    ],
)
def test_clauses(text, label):
    found = {name for name, v in zip(GRAMMAR.labels, GRAMMAR.features(text)) if v}
    assert found == {label}


def test_scope():
    named = lambda text: {n for n, v in zip(GRAMMAR.labels, GRAMMAR.features(text)) if v}
    assert named("Not now. Idiot") == {"plain insult"}  # the clause ends the negation
    assert named("not a b c idiot") == {"plain insult"}  # three words further it is over
    assert named("He said so; idiot") == {"plain insult"}
    assert not any(GRAMMAR.features("blatant skill killjoys' unidiotic trashed"[:7]))  # "blatant" is not "blat"
    assert not any(GRAMMAR.features("")) and not any(GRAMMAR.features("\n . ?"))


def plain_features(text, learned):
    """Clause by clause with look-back over the words: no machines, no search for entries."""
    whole, begun = {}, {}
    listed = [(e, name, 1.0) for name, entries in toxicity.SEED.items() for e in entries.split()]
    for entry, name, weight in listed + [(e, "insult", w) for e, w in learned.items()]:
        (begun if entry.endswith("*") else whole)[entry.rstrip("*")] = (name, weight)

    def read(word):
        if word in whole:
            return whole[word]
        return next((begun[word[:n]] for n in range(len(word), 0, -1) if word[:n] in begun), ("other", 0.0))

    labels = [f"{how} {what}" for how in ("aimed", "denied", "plain", "reported") for what in ("insult", "threat")]
    sums, clauses = dict.fromkeys(labels, 0.0), 0
    for clause in re.split(r"[.!?;\n]", text.lower()):
        read_words = [read(w) for w in re.findall(r"[^\W_]+(?:['’][^\W_]+)*", clause)]
        names = [name for name, _ in read_words]
        marked = False
        for i, (name, weight) in enumerate(read_words):
            if name not in ("insult", "threat"):
                continue
            how = "plain"
            if "report" in names[:i]:
                how = "reported"
            elif "negation" in names[max(0, i - 3) : i]:
                how = "denied"
            elif "target" in names[:i]:
                how = "aimed"
            sums[f"{how} {name}"] += weight
            marked = True
        clauses += marked
    return [math.log1p(sums[k]) for k in sorted(labels)] + [math.log1p(clauses)]


def test_features_against_a_plain_reader():
    rng = random.Random(3)
    learned = {"zork*": 0.95, "blat": 0.5, "idio*": 0.7}
    grammar = toxicity.Grammar(learned)
    assert len(grammar.labels) == 8
    vocabulary = [e.replace("*", rng.choice(["", "s", "ing"])) for v in toxicity.SEED.values() for e in v.split()]
    vocabulary += ["zorkel", "blat", "blatant", "idiom", "d'idiot", "x_idiot", "skill", "plain", "words", "Über", "7"] * 6
    marks = [" "] * 12 + [", ", ". ", "; ", "!? ", "\n", " - ", "'", "_", "…"]
    for _ in range(600):
        text = "".join(rng.choice(vocabulary) + rng.choice(marks) for _ in range(rng.randint(0, 40)))
        text = text.upper() if rng.random() < 0.2 else text
        assert grammar.features(text) == pytest.approx(plain_features(text, learned), abs=1e-12)


def test_scores_against_a_plain_reader(spark, data, odd_docs):
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    learned, weights = model = toxicity.fit(docs, labels)
    every = docs.select("doc_id", "text").unionByName(odd_docs.select("doc_id", "text"))
    rows = toxicity.score(every, model).collect()
    assert len(rows) == docs.count() + 10
    for r in rows:
        z = sum(w * x for w, x in zip(weights, plain_features(r["text"] or "", learned))) + weights[-1]
        assert r["toxicity"] == pytest.approx(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), abs=1e-9)


def test_held_out(spark, data):
    sf = data.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels.where(~toxicity.held_out()))
    scored = toxicity.score(docs.where(toxicity.held_out()), model, ["doc_id"]).join(labels, "doc_id")
    caught, toxic, wrong, clean = scored.agg(
        *[F.count_if(F.expr(f"toxic = {k}{also}")) for k in (1, 0) for also in (" AND toxicity >= 0.3", "")]
    ).head()
    # a few dozen toxic rows to learn from; those of the rarer languages are too few to be learned
    assert caught >= 0.6 * toxic and wrong <= 0.05 * clean


def test_learns_what_marks_toxic_rows(spark):
    rows = [(k, f"aaa bbb{k} {'zorkel%d' % k if k % 4 == 0 else 'calm'} ccc", int(k % 4 == 0)) for k in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    sample, moved = toxicity.labelled_sample(table.select("doc_id", "text"), table.select("doc_id", "toxic"))
    assert moved == 0
    lexicon = toxicity.learn_lexicon(sample)
    assert any("zorkel1".startswith(e.rstrip("*")) for e in lexicon) and not any(e.startswith(("aaa", "cal")) for e in lexicon)


def test_odd_and_empty(spark, odd_docs, no_docs):
    ddl = "doc_id long, quality int, toxic int"
    labels = spark.createDataFrame([(None, 1, 1), (4, None, None), (5, 1, 1), (5, 0, 0), (77, 1, 0)], ddl)
    model = toxicity.fit(odd_docs, labels)
    rows = toxicity.score(odd_docs, model).collect()
    assert len(rows) == 10 and all(0 <= r["toxicity"] <= 1 for r in rows)
    assert toxicity.score(no_docs, toxicity.fit(no_docs, labels.limit(0))).count() == 0
