"""Language-model scores of documents by a log-bilinear model.

The context of a token (the two words before it and the mean of the words before those)
predicts a vector; the vector's products with the word vectors are the words' log scores.
The model is trained in numpy by noise-contrastive estimation on all training documents:
each task trains on its own from a common start, and the parameters are averaged. Scores
are then normalised exactly, by products of whole batches with all word vectors.

The most frequent words have vectors of their own. The rest share one vector for words of
like endings, and split its probability by their smoothed counts in the training documents.
How many words and endings have vectors grows with the fourth root of the training tokens,
so the model grows with the corpus.
Counts of the more frequent words are broadcast up to a fixed size; the counts of all
others are joined.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skewlens.functions.hashing import hash_uniform
from skewlens.llm.words import Hasher, Index, Words, blocks, lookup, mapped, summed
from skewlens.session import stage

#: Words with vectors of their own and endings with vectors of their own: a number each, and
#: more by fourth roots of the training tokens.
HEAD, ENDINGS = (320, 1.0), (128, 0.3)
#: Vectors for all other endings: by the last letter, which its low six bits tell.
OTHERS = 64
#: Words whose counts are broadcast, 22 bytes each.
KNOWN_WORDS = 300_000
DIM, SPAN, NOISE, CHUNK = 16, 16, 64, 2048
#: Tokens whose scores with all words are held at once: they fit the processor's cache.
SCORED = 512
#: Documents the common start is trained on; all training documents follow.
START_ROWS = 1000
END = np.uint64(0x5BD1E9955BD1E995)  # hash of the end token


def held_out(parts: int = 5, part: int = 1) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % parts == part


def endings(words: Words) -> np.ndarray:
    """Last three bytes of each word, A-Z lowered, as one number."""
    lower = np.arange(256, dtype=np.int32)
    lower[65:91] += 32
    out = np.zeros(len(words), np.int32)
    for k in range(3):
        at = words.ends - 1 - k
        inside = at >= words.starts
        out |= np.where(inside, lower[words.data[np.where(inside, at, 0)]], 0) << np.int32(8 * k)
    return out


def token_counts(training: DataFrame) -> DataFrame:
    """``(word, ending, n)``: hash, ending and count of every distinct token, the end among them."""

    def count(batches):
        hasher = Hasher(lower=True)
        for batch in batches:
            hashes, ends = [np.full(batch.num_rows, END)], [np.zeros(batch.num_rows, np.int32)]
            for _, _, words in blocks(batch.column(0)):
                hashes.append(hasher(words))
                ends.append(endings(words))
            found, first, n = np.unique(np.concatenate(hashes), return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found.view(np.int64)), pa.array(np.concatenate(ends)[first]), pa.array(n)],
                names=["word", "ending", "n"],
            )

    counted = training.select(F.col("text").cast("string")).mapInArrow(count, "word long, ending int, n long")
    return counted.groupBy("word").agg(F.first("ending").alias("ending"), F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """Known words by hash, with count and class (-1: by ending); classes 0.. are HEAD words,
    then ENDINGS, then OTHERS."""

    words: np.ndarray
    counts: np.ndarray
    classes: np.ndarray
    endings: np.ndarray  # sorted
    ending_class: np.ndarray
    share: np.ndarray  # share of the training tokens by class
    within: np.ndarray  # log10 of what a shared class divides by; 0 for words of their own
    tokens: int
    distinct: int

    def __post_init__(self):
        self._index = None

    def parts(self) -> tuple:
        return tuple(v for k, v in self.__dict__.items() if k != "_index")

    def first_other(self) -> int:
        return len(self.share) - OTHERS

    def of(self, hashes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position among the known words (-1: none) and class of each word."""
        if self._index is None:
            self._index = Index(self.words)
        at = self._index(hashes)
        found = np.where(at >= 0, self.classes[at] if len(self.classes) else -1, -1).astype(np.int64)
        tail = np.flatnonzero(found < 0)
        listed = lookup(self.endings, ends[tail])
        other = self.first_other() + ends[tail] % OTHERS
        found[tail] = np.where(listed >= 0, self.ending_class[listed] if len(self.endings) else 0, other)
        return at, found


def vocabulary(counts: DataFrame, known: int = KNOWN_WORDS) -> Vocabulary:
    """From the staged ``counts``; what comes to the driver is bounded by ``known`` words."""
    steps = counts.groupBy(F.least("n", F.lit(4096)).alias("n")).agg(F.count(F.lit(1)).alias("words"), F.sum(F.col("n")).alias("t"))
    rows = sorted(((r["n"], r["words"]) for r in steps.select("n", "words").collect()), reverse=True)
    least, seen = 4097, 0
    for n, words in rows:
        if seen + words > known:
            break
        least, seen = n, seen + words
    total = counts.agg(F.sum("n"), F.count(F.lit(1))).head()
    tokens, distinct = int(total[0] or 0), int(total[1])
    frequent = counts.where(F.col("n") >= least)
    if least > 4096:  # more very frequent words than may be broadcast: the first by count
        frequent = frequent.orderBy(F.desc("n"), "word").limit(known)
    table = frequent.select("word", "ending", "n").toArrow()
    words, ends, n = table["word"].to_numpy().view(np.uint64), table["ending"].to_numpy(), table["n"].to_numpy()
    order = np.argsort(words)
    words, ends, n = words[order], ends[order], n[order]
    root = max(tokens, 1) ** 0.25
    own, ranked = (more + math.ceil(k * root) for more, k in (HEAD, ENDINGS))
    rank = np.lexsort((words, -n, words != END))[:own]  # the end token always has its own vector
    classes = np.full(len(words), -1, np.int16)
    classes[rank] = np.arange(len(rank))
    head = [int(x) for x in words[rank].view(np.int64)]
    tail = counts.where(~F.col("word").isin(head)) if head else counts
    top = tail.groupBy("ending").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "ending").limit(ranked).collect()
    listed = np.array(sorted(r["ending"] for r in top), np.int32)
    first = len(rank)
    place = F.array_position(F.array(*[F.lit(int(e)) for e in listed]), F.col("ending")) if len(listed) else F.lit(0)
    number = F.when(place > 0, first + place - 1).otherwise(first + len(listed) + F.col("ending") % OTHERS)
    size = first + len(listed) + OTHERS
    count, kinds = np.zeros(size), np.zeros(size)
    count[: len(rank)] = n[rank]
    for r in tail.groupBy(number.cast("int").alias("class")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        count[r["class"]], kinds[r["class"]] = r["n"], r["v"]
    within = np.log10(count + 0.5 * (kinds + 1))
    within[: len(rank)] = 0
    share = (count + 0.5) / (count + 0.5).sum()
    listed_class = first + np.arange(len(listed))
    return Vocabulary(words, n, classes, listed, listed_class, share, within, tokens, distinct)


class Bilinear:
    """Parameters as one flat array: context vectors (one more for "before the text"), word
    vectors, biases, and the weights of the three context positions."""

    def __init__(self, share: np.ndarray, flat: np.ndarray | None = None):
        self.share, c = share, len(share)
        shapes = [(c + 1, DIM), (c, DIM), (c,), (3, DIM)]
        sizes = [math.prod(s) for s in shapes]
        if flat is None:
            random = np.random.default_rng(11)
            flat = np.zeros(sum(sizes), np.float32)
            flat[: sizes[0] + sizes[1]] = random.normal(0, 0.1, sizes[0] + sizes[1])
            flat[sizes[0] + sizes[1] : -sizes[3]] = np.log(share)
            flat[-sizes[3] :] = 1.0
        self.flat = flat.astype(np.float32).copy()
        cuts = np.cumsum(sizes)[:-1]
        self.context, self.word, self.bias, self.mix = (
            part.reshape(shape) for part, shape in zip(np.split(self.flat, cuts), shapes)
        )

    def predicted(self, y: np.ndarray, at: np.ndarray):
        """Vectors predicted for tokens of classes ``y``; ``at``: place of each in its text."""
        n, before = len(y), len(self.share)
        place, vectors = np.arange(n), self.context[y]
        inputs = []
        for k in (0, 1):
            previous = np.empty_like(vectors)
            previous[k + 1 :] = vectors[: n - k - 1]
            previous[at <= k] = self.context[before]
            inputs.append(previous)
        running = np.zeros((n + 1, DIM))
        np.cumsum(vectors, axis=0, out=running[1:])
        span = np.minimum(at, SPAN)
        scale = (1 / np.maximum(span, 1)).astype(np.float32)[:, None]  # without words before: 0 / 1
        mean = (running[:-1] - running[place - span]).astype(np.float32) * scale
        inputs.append(mean)
        q = inputs[0] * self.mix[0] + inputs[1] * self.mix[1] + inputs[2] * self.mix[2]
        return q, inputs, span, scale

    def log10(self, y: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Normalised log10 probability of each token's class."""
        q = self.predicted(y, at)[0]
        q = np.hstack([q, np.ones((len(q), 1), np.float32)])
        words = np.hstack([self.word, self.bias[:, None]])
        columns, ones = words.T.copy(), np.ones(len(self.share), np.float32)
        held, total, tops = np.empty((SCORED, len(ones)), np.float32), np.empty(len(y), np.float32), np.zeros(len(y), np.float32)
        # exp holds up to 88; no score is beyond the product of the longest vectors
        longest = [float(np.einsum("ij,ij->i", v, v).max(initial=0)) for v in (q, words)]
        safe = math.sqrt(longest[0] * longest[1]) < 80
        for k in range(0, len(y), SCORED):
            part = slice(k, k + SCORED)
            scores = np.matmul(q[part], columns, out=held[: len(y[part])])
            if not safe:
                tops[part] = scores.max(1)
                scores -= tops[part, None]
            np.exp(scores, out=scores)
            np.matmul(scores, ones, out=total[part])
        own = np.einsum("ij,ij->i", q, words[y]).astype(np.float64) - tops
        return (own - np.log(np.maximum(total, 1e-37).astype(np.float64))) / math.log(10)


class Trainer:
    """Noise-contrastive steps with AdaGrad. All tokens of a chunk share the noise words, so
    that their scores are one matrix product."""

    def __init__(self, model: Bilinear, seed: int, rate: float):
        self.model, self.rate, self.random = model, rate, np.random.default_rng(seed)
        self.cumulative = np.cumsum(model.share)
        self.offset = np.log(NOISE * model.share).astype(np.float32)
        self.seen = Bilinear(model.share, np.full(len(model.flat), 1e-2))

    def _step(self, name: str, slope: np.ndarray) -> None:
        value, seen = getattr(self.model, name), getattr(self.seen, name)
        seen += slope * slope
        value -= self.rate * slope / np.sqrt(seen)

    def learn(self, y: np.ndarray, at: np.ndarray) -> None:
        m, n, before = self.model, len(y), len(self.model.share)
        q, inputs, span, scale = m.predicted(y, at)
        noise = np.minimum(np.searchsorted(self.cumulative, self.random.random(NOISE)), before - 1)
        own, other = m.word[y], m.word[noise]
        s = np.einsum("ij,ij->i", q, own) + (m.bias - self.offset)[y]
        z = q @ other.T
        z += (m.bias - self.offset)[noise]
        miss = np.float32(-1 / n) / (1 + np.exp(np.clip(s, -30, 30)))
        false = np.float32(1 / n) / (1 + np.exp(np.negative(np.clip(z, -30, 30, out=z), out=z)))
        to_q = miss[:, None] * own + false @ other
        # by token: what its word vector, its bias and its context vector get
        by_token = np.empty((n, 2 * DIM + 1), np.float32)
        np.multiply(miss[:, None], q, out=by_token[:, :DIM])
        by_token[:, DIM] = miss
        running = np.zeros((n + 1, DIM), np.float32)
        np.cumsum(to_q * (m.mix[2] * scale), axis=0, out=running[1:])
        # a word is in the mean of the SPAN tokens that follow it in its text
        starts = np.flatnonzero(at == 0)
        ends = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n)))
        follow = np.arange(1, n + 1)
        lift = running[np.minimum(follow + SPAN, ends)] - running[np.minimum(follow, ends)]
        context = np.zeros((before + 1, DIM), np.float32)
        for k in (0, 1):
            back = to_q * m.mix[k]
            inside = at > k
            lift[: n - k - 1] += np.where(inside[k + 1 :, None], back[k + 1 :], np.float32(0))
            context[before] += back[~inside].sum(0)
        by_token[:, DIM + 1 :] = lift
        narrow = y.astype(np.int16)
        order = np.argsort(narrow, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], np.diff(narrow[order]) != 0)))
        total = np.zeros((before, 2 * DIM + 1), np.float32)
        total[y[order[first]]] = np.add.reduceat(by_token[order], first, axis=0)
        np.add.at(total, noise, np.hstack([false.T @ q, false.sum(0)[:, None], np.zeros((NOISE, DIM), np.float32)]))
        context[:before] += total[:, DIM + 1 :]
        mix = np.stack([np.einsum("ij,ij->j", to_q, x) for x in inputs])
        self._step("word", total[:, :DIM])
        self._step("bias", total[:, DIM])
        self._step("context", context)
        self._step("mix", mix)


def sequences(column: pa.Array, vocab: Vocabulary, hasher: Hasher):
    """By block: words, position among known words, classes of all tokens with the ends, and
    the place of each token in its text."""
    end_at = lookup(vocab.words, np.array([END]))[0]
    end_class = int(vocab.classes[end_at]) if end_at >= 0 else 0
    for _, _, words in blocks(column):
        hashes = hasher(words)
        at, found = vocab.of(hashes, endings(words))
        counts = words.counts()
        ends = words.of[1:] + np.arange(words.docs)  # where the end tokens go
        total = len(words) + words.docs
        y = np.empty(total, np.int64)
        is_end = np.zeros(total, bool)
        is_end[ends] = True
        y[is_end], y[~is_end] = end_class, found
        first = words.of[:-1] + np.arange(words.docs)
        place = np.arange(total) - np.repeat(first, counts + 1)
        yield words, hashes, at, y, place, first


def _trained(training: DataFrame, vocab: Vocabulary, start: np.ndarray | None, rate: float, passes: int) -> DataFrame:
    """``(i, v, n)``: every parameter of every task's model, with the tokens it was trained on."""
    shared = training.sparkSession.sparkContext.broadcast((vocab.parts(), start))

    def train(batches):
        parts, begun = shared.value
        known = Vocabulary(*parts)
        model, hasher, seen = Bilinear(known.share, begun), Hasher(lower=True), 0
        trainer = Trainer(model, 5, rate)
        for batch in batches:
            for _ in range(passes):
                for _, _, _, y, place, _ in sequences(batch.column(0), known, hasher):
                    for k in range(0, len(y), CHUNK):
                        at = place[k : k + CHUNK]
                        # the words before a cut are taken as the beginning of the text
                        trainer.learn(y[k : k + CHUNK], np.minimum(at, np.arange(len(at))))
                    seen += len(y)
        if seen:
            n = len(model.flat)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(n, dtype=np.int32)), pa.array(model.flat.astype(np.float64)), pa.array(np.full(n, float(seen)))],
                names=["i", "v", "n"],
            )

    return training.select(F.coalesce(F.col("text").cast("string"), F.lit(""))).mapInArrow(train, "i int, v double, n double")


def _average(trained: DataFrame, size: int) -> np.ndarray | None:
    mean = trained.groupBy("i").agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("v")).toArrow()
    if not mean.num_rows:
        return None
    flat = np.zeros(size, np.float32)
    flat[mean["i"].to_numpy()] = mean["v"].to_numpy()
    return flat


@dataclass
class Fitted:
    counts: DataFrame
    vocab: Vocabulary
    flat: np.ndarray | None


def fit(training: DataFrame, start_rows: int = START_ROWS, seed: int = 42) -> Fitted:
    """Counts and parameters from all rows of ``training``; the start is from a part of them."""
    counts = stage(token_counts(training), "token-counts")
    vocab = vocabulary(counts)
    size = len(Bilinear(vocab.share).flat)
    rows = training.count()
    if not rows:
        return Fitted(counts, vocab, None)
    begin = training.where(hash_uniform(seed, "lm", "doc_id") < min(1.0, start_rows / rows)).coalesce(1)
    start = _average(_trained(begin, vocab, None, 0.1, 4), size)
    flat = _average(_trained(training, vocab, start, 0.03, 1), size)
    return Fitted(counts, vocab, flat)


def score(docs: DataFrame, fitted: Fitted, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default: all) of ``docs`` with n_tokens, n_known, train_tokens,
    base_score and score.

    A null or empty text is the end token alone. Repeated rows are scored alike. Without
    training documents both scores are 0. Columns that clash with a result are replaced.
    """
    ddl = "n_tokens long, n_known long, base_score double, score double, rare array<long>"
    shared = docs.sparkSession.sparkContext.broadcast((fitted.vocab.parts(), fitted.flat))
    tokens, distinct = fitted.vocab.tokens, fitted.vocab.distinct

    def make():
        parts, flat = shared.value
        vocab = Vocabulary(*parts)
        model, hasher = Bilinear(vocab.share, flat), Hasher(lower=True)
        divisor = math.log10(vocab.tokens + 0.5 * (vocab.distinct + 1))
        logs = np.append(np.log10(vocab.counts + 0.5), 0.0)  # the last is for words not known here
        end_at = int(lookup(vocab.words, np.array([END]))[0])
        end_log = float(logs[end_at]) if end_at >= 0 else math.log10(0.5)

        def of_texts(column):
            out = [[] for _ in range(6)]
            for words, hashes, at, y, place, first in sequences(column, vocab, hasher):
                counts = words.counts()
                rare = at < 0
                base = summed(logs[at], words.of) + end_log - divisor * (counts + 1)
                own = vocab.classes[at] >= 0 if len(vocab.classes) else np.zeros(len(at), bool)
                own &= ~rare
                word_class = y[np.delete(np.arange(len(y)), first + counts)]
                split = summed(np.where(own, 0.0, logs[at] - vocab.within[word_class]), words.of)
                log, bounds = model.log10(y, place), np.append(first, len(y))
                out[0].append(counts + 1)
                out[1].append(summed((~rare).astype(np.int64), words.of) + (end_at >= 0))
                out[2].append(base)
                out[3].append(summed(log, bounds) + split)
                out[4].append(hashes[rare])
                out[5].append(summed(rare.astype(np.int64), words.of))
            join = lambda k, kind: np.concatenate(out[k]).astype(kind) if out[k] else np.zeros(0, kind)
            offsets = np.concatenate(([0], np.cumsum(join(5, np.int64)))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(join(4, np.uint64).view(np.int64)))
            return [pa.array(join(0, np.int64)), pa.array(join(1, np.int64)), pa.array(join(2, float)), pa.array(join(3, float)), lists]

        return of_texts

    keep = [c for c in (keep or docs.columns) if c != "train_tokens"]
    scored = mapped(docs, keep, ddl, make)
    scored = stage(scored.withColumn("_row", F.monotonically_increasing_id()), "scored")
    seen = scored.select("_row", F.explode("rare").alias("word")).join(fitted.counts.select("word", "n"), "word", "left")
    n = F.coalesce("n", F.lit(0))
    rest = seen.groupBy("_row").agg(
        F.sum(F.log10(n + 0.5)).alias("_log"), F.sum(F.when(n > 0, 1).otherwise(0)).alias("_known")
    )
    log, known = F.coalesce("_log", F.lit(0.0)), F.coalesce("_known", F.lit(0))
    trained = F.lit(1.0 if tokens else 0.0)
    return scored.join(rest, "_row", "left").select(
        *[c for c in scored.columns if c not in ("_row", "n_tokens", "n_known", "base_score", "score", "rare")],
        "n_tokens",
        (F.col("n_known") + known).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        ((F.col("base_score") + log) * trained).alias("base_score"),
        ((F.col("score") + log) * trained).alias("score"),
    )
