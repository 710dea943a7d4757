"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three letters are hashed into a fixed number of slots. Document
frequencies come from all training documents; the regression is fitted on a bounded sample
of labelled rows by the follow-the-regularised-leader rule with elastic-net penalties, and
its scores are calibrated by a temperature on rows of the sample it was not fitted on.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skewlens.functions.hashing import hash_uniform
from skewlens.llm.words import mapped
from skewlens.session import local_table

#: Slots of the hashed n-grams, as a power of two.
SLOT_BITS = 15
#: Labelled rows the regression is fitted on, in equal parts by language as far as they go.
SAMPLE_ROWS = 4000
#: Language labels a model learns unless the caller allows more: each has a weight for
#: every slot.
MAX_LANGUAGES = 1000
UNKNOWN = "und"


class Grams:
    """Slots of the n-grams of texts. A run of non-letters counts as one space."""

    def __init__(self, bits: int = SLOT_BITS):
        self.bits, self.slots = bits, 1 << bits
        self.letter = np.array([chr(c).isalpha() for c in range(1 << 16)])

    def _letters(self, codes: np.ndarray) -> np.ndarray:
        wide = codes > 0xFFFF
        found = self.letter[np.where(wide, 0, codes)]
        if wide.any():
            known = {c: chr(c).isalpha() for c in np.unique(codes[wide]).tolist()}
            found[wide] = [known[c] for c in codes[wide].tolist()]
        return found

    def __call__(self, texts: list[str], block: int = 1 << 17):
        """Distinct slots and their counts for each text, in order."""
        batch, size = [], 0
        for text in texts:
            batch.append(text.lower())
            size += len(text)
            if size >= block:
                yield from self._block(batch)
                batch, size = [], 0
        if batch:
            yield from self._block(batch)

    def _block(self, texts: list[str]):
        lengths = np.array([len(t) for t in texts])
        codes = np.frombuffer((" " + " ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
        letters = self._letters(codes)
        keep = letters.copy()
        keep[0] = True
        keep[1:] |= letters[:-1]  # the first non-letter after a letter
        heads = np.concatenate(([0], np.cumsum(lengths + 1)))  # the space before each text
        at = np.concatenate(([0], np.cumsum(keep)))[heads + 1] - 1
        codes = np.where(letters, codes, 32)[keep].astype(np.uint64)
        n, end = len(codes), np.full(2, 32, np.uint64)
        one = codes * np.uint64(0x9E3779B97F4A7C15)
        two = (codes << np.uint64(21)) ^ np.append(codes[1:], end[:1])
        three = (two << np.uint64(21)) ^ np.append(codes[2:], end)[:n]
        gap = codes == 32
        after = np.append(gap[1:], True)
        shift = np.uint64(64 - self.bits)
        slots = np.empty((n, 3), np.int32)
        for k, (h, missing, salt) in enumerate(
            ((one, gap, 0xD6E8FEB86659FD93), (two, gap & after, 0xC2B2AE3D27D4EB4F), (three, after, 0x165667B19E3779F9))
        ):
            h = h * np.uint64(salt)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0x9E3779B97F4A7C15)
            slots[:, k] = h >> shift
            slots[missing, k] = self.slots
        for d in range(len(texts)):
            found = slots[at[d] : at[d + 1]].ravel()
            if len(found) < 3000:
                where, count = np.unique(found, return_counts=True)
                if len(where) and where[-1] == self.slots:
                    where, count = where[:-1], count[:-1]
            else:
                all_counts = np.bincount(found, minlength=self.slots + 1)[: self.slots]
                where = np.flatnonzero(all_counts)
                count = all_counts[where]
            yield where, count


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray  # by slot
    weights: np.ndarray  # slot x language; the last row is the bias
    temperature: float


def weighted(count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    value = (1 + np.log(count)) * idf
    norm = np.sqrt(value @ value)
    return value / norm if norm else value


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit_ftrl(rows, slots: int, classes: int, alpha=2.0, beta=1.0, l1=1e-6, l2=1e-6, epochs=8) -> np.ndarray:
    """Weights by per-coordinate FTRL-proximal steps. ``rows`` is ``[(slots, values, class)]``."""
    z = np.zeros((slots + 1, classes))
    n = np.zeros((slots + 1, classes))
    order = np.random.default_rng(7)

    def solved(z, n):
        shrunk = np.sign(z) * np.maximum(np.abs(z) - l1, 0)
        return -shrunk / ((beta + np.sqrt(n)) / alpha + l2)

    for _ in range(epochs):
        for k in order.permutation(len(rows)).tolist():
            where, values, label = rows[k]
            w, seen = solved(z[where], n[where]), n[where]
            error = softmax(values @ w)
            error[label] -= 1
            slope = np.outer(values, error)
            grown = seen + slope**2
            z[where] += slope - (np.sqrt(grown) - np.sqrt(seen)) / alpha * w
            n[where] = grown
    return solved(z, n)


def calibrated(logits: np.ndarray, labels: np.ndarray) -> float:
    """Temperature with the least log loss, by golden-section search over its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        p = softmax(logits / np.exp(t))
        return -float(np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-12)).mean())

    low, high, ratio = np.log(0.2), np.log(5.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def held_out(parts: int = 5, part: int = 0) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % parts == part


def _document_frequencies(training: DataFrame, bits: int) -> tuple[np.ndarray, int]:
    def count(batches):
        grams, found, rows = Grams(bits), None, 0
        found = np.zeros(grams.slots + 1, np.int64)
        for batch in batches:
            for where, _ in grams(batch.column(0).to_pylist()):
                found[where] += 1
                rows += 1
        found[-1] = rows
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(found[at])], names=["slot", "n"])

    counted = training.select(F.col("text").cast("string")).mapInArrow(count, "slot int, n long")
    table = counted.groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros((1 << bits) + 1, np.int64)
    df[table["slot"].to_numpy()] = table["n"].to_numpy()
    return df[:-1], int(df[-1])


def fit(
    training: DataFrame,
    sample_rows: int = SAMPLE_ROWS,
    bits: int = SLOT_BITS,
    seed: int = 42,
    max_languages: int = MAX_LANGUAGES,
) -> Model | None:
    """A model of the non-null ``lang`` of rows with a text; None if there are none.

    At most about ``sample_rows`` rows are fitted, chosen by a hash of the doc_id in one
    task; document frequencies are those of all rows. Of more than ``max_languages`` labels
    the most frequent are learned, of equal ones the first by name; rows of the others are
    then taken for one of these.
    """
    spark = training.sparkSession
    training = training.where("text IS NOT NULL AND lang IS NOT NULL").select(
        "doc_id", "text", F.col("lang").cast("string").alias("lang")
    )
    counted = training.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    found = counted.orderBy(F.desc("n"), "lang").limit(max_languages).collect()
    if not found:
        return None
    languages = sorted(r["lang"] for r in found)
    df, documents = _document_frequencies(training, bits)
    idf = np.log((1 + documents) / (1 + df)) + 1
    quota = -(-sample_rows // len(languages))
    shares = local_table(spark, [(r["lang"], min(1.0, quota / r["n"])) for r in found], "lang string, share double")
    sample = training.join(F.broadcast(shares), "lang").where(hash_uniform(seed, "langid", "doc_id") < F.col("share"))
    code = {name: k for k, name in enumerate(languages)}

    def train(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "text"], na_position="first")
        grams = Grams(bits)
        labels = [code[x] for x in rows["lang"]]
        data = []
        for (where, count), label in zip(grams(rows["text"].tolist()), labels):
            values = np.append(weighted(count, idf[where]), 1.0)
            data.append((np.append(where, grams.slots), values, label))
        only = {label: k for k, label in reversed(list(enumerate(labels)))}  # a label's first row is fitted
        fits = [k % 5 > 0 or only[label] == k for k, label in enumerate(labels)]
        fitted, checked = ([x for x, f in zip(data, fits) if f == side] for side in (True, False))
        weights = fit_ftrl(fitted, grams.slots, len(languages))
        logits = np.array([v @ weights[w] for w, v, _ in checked])
        temperature = calibrated(logits, np.array([label for _, _, label in checked]))
        return pd.DataFrame({"weights": [weights.astype(np.float32).tobytes()], "temperature": [temperature]})

    row = sample.select("doc_id", "text", "lang").groupBy().applyInPandas(train, "weights binary, temperature double").head()
    if row is None:
        return None
    weights = np.frombuffer(row["weights"], np.float32).reshape(-1, len(languages))
    return Model(languages, idf.astype(np.float32), weights, row["temperature"])


def identify(docs: DataFrame, model: Model | None, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default: all) of ``docs`` with ``lang_pred`` and ``lang_score``.

    A text that is null or has no letter is ``und`` with score 0; so is every text without a
    model. Only the text is looked at, and all of it.
    """
    if model is None:
        return docs.select(*(keep or docs.columns)).withColumns(
            {"lang_pred": F.lit(UNKNOWN), "lang_score": F.lit(0.0)}
        )
    shared = docs.sparkSession.sparkContext.broadcast(
        (model.languages, model.idf, model.weights, model.temperature)
    )

    def make():
        model = Model(*shared.value)
        grams = Grams(int(model.idf.size).bit_length() - 1)

        def of_texts(column):
            names, scores = [], []
            for where, count in grams(column.to_pylist()):
                if not len(where):
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                logits = weighted(count, model.idf[where]) @ model.weights[where] + model.weights[-1]
                p = softmax(logits / model.temperature)
                names.append(model.languages[int(p.argmax())])
                scores.append(float(p.max()))
            return [pa.array(names, pa.string()), pa.array(scores, pa.float64())]

        return of_texts

    return mapped(docs, keep or docs.columns, "lang_pred string, lang_score double", make)
