"""Toxicity by a weighted finite-state grammar over clauses.

A lexicon transducer reads words and writes classes: insult, threat, target, negation,
reported speech, other. It is composed with small machines that follow the scope of a
negation, a reporting word and a target through the clause. What they write for an insult
or a threat (plain, aimed, denied or reported) is weighed and added up over the document;
isolated words count for nothing but what the clause makes of them. Insults of the corpus
are learned from labelled rows as words or word beginnings, and so are the final weights.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import product

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skewlens.functions.hashing import hash_uniform
from skewlens.llm.words import mapped
from skewlens.session import local_table

#: Labelled rows that are learned from, at most about, by label.
TOXIC_ROWS, CLEAN_ROWS = 3000, 9000
#: Learned lexicon entries, strongest first.
MAX_ENTRIES = 2000
#: Share of toxic rows in the sample that an entry needs.
PURE = 0.9
STEM = (4, 5, 6, 7)

# Words by class, to which learned insults are added. A final * stands for any ending.
SEED = {
    "insult": "idiot* moron* stupid* imbecil* scum trash loser* pathetic worthless disgusting dumb* jerk "
    "abruti* connard* dummkopf* trottel* arschloch* estúpid* pendej*",
    "threat": "kill* murder* strangle* töten umbringen tuer matar*",
    "target": "you your yours yourself u he she they them him her these those tu toi vous vos votre il elle ils "
    "du dich dir ihr euch sie usted ustedes vosotros él ella ellos",
    "negation": "not never no none neither nor cannot isn't aren't don't doesn't nicht kein keine nie ne pas jamais "
    "nunca jamás ni",
    "report": "said says say told wrote writes quoted quote claimed called reported alleged sagte sagt schrieb dit "
    "disait écrit dijo dice escribió",
}
CLASSES = tuple(SEED)
#: Words that a negation reaches.
REACH = 3

WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
CLAUSE_END = re.compile(r"[.!?;\n]+")


def negation_machine() -> dict:
    """State: how many words the negation still reaches."""
    return {
        (left, c): REACH if c == "negation" else max(left - 1, 0)
        for left in range(REACH + 1)
        for c in (*CLASSES, "other")
    }


def latch_machine(word_class: str) -> dict:
    """State 1 from the first word of the class to the end of the clause."""
    return {(s, c): 1 if s or c == word_class else 0 for s in (0, 1) for c in (*CLASSES, "other")}


def compose(negation: dict, report: dict, target: dict) -> tuple[dict, list[str]]:
    """Product machine ``(state, class) -> (state, label or None)`` and its labels.

    Insults and threats write a label that says in which state they were met. What is
    reported or denied does not count as aimed.
    """
    table, labels = {}, []
    for n, r, t, c in product(range(REACH + 1), (0, 1), (0, 1), (*CLASSES, "other")):
        label = None
        if c in ("insult", "threat"):
            how = "reported" if r else "denied" if n else "aimed" if t else "plain"
            label = f"{how} {c}"
            if label not in labels:
                labels.append(label)
        table[(n, r, t), c] = ((negation[n, c], report[r, c], target[t, c]), label)
    return table, sorted(labels)


class Grammar:
    """Lexicon and clause machine; ``weights`` of entries default to 1."""

    def __init__(self, learned: dict[str, float] | None = None):
        self.table, self.labels = compose(negation_machine(), latch_machine("report"), latch_machine("target"))
        self.words: dict[str, tuple[str, float]] = {}
        self.stems: dict[str, tuple[str, float]] = {}
        for name, listed in SEED.items():
            for entry in listed.split():
                self._add(entry, name, 1.0)
        for entry, weight in (learned or {}).items():
            self._add(entry, "insult", weight)
        self.finder = ahocorasick.Automaton()
        for found in (self.words, self.stems):
            for entry, (name, _) in found.items():
                if name in ("insult", "threat"):
                    self.finder.add_word(entry, len(entry))
        self.finder.make_automaton()
        self.lengths = sorted({len(s) for s in self.stems})

    def _add(self, entry: str, name: str, weight: float) -> None:
        (self.stems if entry.endswith("*") else self.words)[entry.rstrip("*")] = (name, weight)

    def read(self, word: str) -> tuple[str, float]:
        """Class and weight of a word: as a whole, else by its longest known beginning."""
        if word in self.words:
            return self.words[word]
        for n in reversed(self.lengths):
            if len(word) >= n and word[:n] in self.stems:
                return self.stems[word[:n]]
        return "other", 0.0

    def features(self, text: str) -> list[float]:
        """Summed weights of each label, clauses that have one, and words, by logarithm."""
        sums = dict.fromkeys(self.labels, 0.0)
        text = text.lower()
        hits, clauses = [end - n + 1 for end, n in self.finder.iter(text)], 0
        done = -1
        for at in hits:
            if at < done or at and (text[at - 1].isalnum()):
                continue
            start = max(text.rfind(mark, 0, at) for mark in ".!?;\n") + 1
            found = CLAUSE_END.search(text, at)
            done = found.start() if found else len(text)
            state, any_label = (0, 0, 0), False
            for word in WORD.findall(text, start, done):
                name, weight = self.read(word)
                state, label = self.table[state, name]
                if label:
                    sums[label] += weight
                    any_label = True
            clauses += any_label
        return [math.log1p(v) for v in sums.values()] + [math.log1p(clauses)]


def held_out(parts: int = 4, part: int = 2) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % parts == part


def _forms(text: str) -> set[str]:
    words = set(WORD.findall(text.lower()))
    return words | {w[:n] + "*" for w in words for n in STEM if len(w) > n}


def labelled_sample(docs: DataFrame, labels: DataFrame, seed: int = 42) -> tuple[DataFrame, float]:
    """``(text, toxic)`` of a bounded number of labelled documents, chosen by a hash of doc_id,
    and by how much their log odds of being toxic have to be moved to fit all labelled rows."""
    spark = docs.sparkSession
    marked = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.col("toxic").cast("int")).alias("toxic")
    )
    found = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).where("toxic IN (0, 1)").collect()}
    share = [(k, min(1.0, most / found[k])) for k, most in ((1, TOXIC_ROWS), (0, CLEAN_ROWS)) if k in found]
    shares = local_table(spark, share, "toxic int, share double")
    chosen = marked.join(F.broadcast(shares), "toxic").where(hash_uniform(seed, "toxicity", "doc_id") < F.col("share"))
    sample = docs.where("text IS NOT NULL").join(F.broadcast(chosen.select("doc_id", "toxic")), "doc_id")
    taken = dict(share)
    moved = math.log(taken[0] / taken[1]) if len(taken) == 2 else 0.0
    return sample.select("text", "toxic"), moved


def learn_lexicon(sample: DataFrame, entries: int = MAX_ENTRIES) -> dict[str, float]:
    """Words and word beginnings that mark toxic rows, with their weights.

    An entry stays if chance alone would give about one form of all those looked at such an
    excess in toxic rows, and if no shorter beginning of it stays. Its weight is its share of toxic rows.
    """

    def count(batches):
        seen, rows = Counter(), Counter()
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows[toxic] += 1
                seen.update((form, toxic) for form in _forms(text))
        seen.update({("", k): n for k, n in rows.items()})
        keys = list(seen)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in keys], pa.string()),
                pa.array([n if k[1] else 0 for k, n in seen.items()], pa.int64()),
                pa.array([0 if k[1] else n for k, n in seen.items()], pa.int64()),
            ],
            names=["form", "toxic", "clean"],
        )

    counts = sample.mapInArrow(count, "form string, toxic long, clean long")
    counts = counts.groupBy("form").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).persist()
    total = counts.where("form = ''").head()
    if total is None or not total["toxic"] or not total["clean"]:
        counts.unpersist()
        return {}
    forms = counts.count()
    base = total["toxic"] / (total["toxic"] + total["clean"])
    n = F.col("toxic") + F.col("clean")
    p = F.col("toxic") / n
    surprise = F.col("toxic") * F.log(p / base) + F.when(
        F.col("clean") > 0, F.col("clean") * F.log((1 - p) / (1 - base))
    ).otherwise(0.0)
    strong = counts.where((F.col("form") != "") & (F.col("toxic") > 0) & (p >= PURE))
    strong = strong.select("form", p.alias("share"), surprise.alias("surprise")).where(
        F.col("surprise") > math.log(forms)
    )
    found = {r["form"]: r["share"] for r in strong.orderBy(F.desc("surprise"), "form").limit(entries).collect()}
    counts.unpersist()
    return {
        form: share
        for form, share in found.items()
        if not any(form[:k] + "*" in found for k in STEM if k < len(form.rstrip("*")))
    }


def _fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Weights and bias by Newton's steps on the penalised log loss."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.diag([ridge] * (len(w) - 1) + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty
        step = np.linalg.solve(hessian, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, float], list[float]]:
    """Learned lexicon and weights of the clause labels; bias last.

    Without toxic or without clean rows the seed lexicon is used with fixed weights.
    """
    sample, moved = labelled_sample(docs, labels)
    sample = sample.persist()
    lexicon = learn_lexicon(sample)

    def make():
        grammar = Grammar(lexicon)
        return lambda column: [pa.array([grammar.features(t) for t in column.to_pylist()], pa.list_(pa.float64()))]

    found = mapped(sample, ["toxic"], "features array<double>", make).toPandas()
    sample.unpersist()
    width = len(Grammar().labels) + 1
    if found["toxic"].nunique() < 2:
        return lexicon, [2.0] * width + [-3.0]
    weights = _fit_logistic(np.stack(found["features"].to_numpy()), found["toxic"].to_numpy(float))
    weights[-1] += moved
    return lexicon, weights.tolist()


def score(docs: DataFrame, model: tuple[dict[str, float], list[float]], keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default: all) of ``docs`` with ``toxicity``, the chance of label 1.

    Null and empty texts have no clause and get the score of such a text. Whole texts are
    read; extra columns stay, one that is named toxicity is replaced.
    """

    def make():
        lexicon, weights = model
        grammar, w = Grammar(lexicon), np.array(weights)

        def of_texts(column):
            x = np.array([grammar.features(t) for t in column.to_pylist()]).reshape(len(column), -1)
            z = np.clip(x @ w[:-1] + w[-1], -30, 30) if len(column) else np.zeros(0)
            return [pa.array(1 / (1 + np.exp(-z)))]

        return of_texts

    return mapped(docs, keep or docs.columns, "toxicity double", make)
