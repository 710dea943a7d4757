import math
import zlib
from collections import Counter

import numpy as np
import pytest

from skewlens.llm import lm
from skewlens.session import stage


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


@pytest.fixture(scope="module")
def fitted(documents):
    return lm.fit(documents.where(~lm.held_out()), start_rows=100)


def brute_base(texts, training):
    counts = Counter(t for text in training for t in tokens(text))
    total, kinds = sum(counts.values()), len(counts)
    divisor = math.log10(total + 0.5 * (kinds + 1))
    base = [
        (len(ts), sum(counts[t] > 0 for t in ts), total, sum(math.log10(counts[t] + 0.5) - divisor for t in ts))
        for ts in map(tokens, texts)
    ]
    return base


@pytest.mark.parametrize("known", [lm.KNOWN_WORDS, 700])
def test_base_and_gain(documents, texts, known):
    """Counts are exact however many of them are broadcast; the model is better than the base."""
    training = documents.where(~lm.held_out())
    counts = stage(lm.token_counts(training))
    vocab = lm.vocabulary(counts, known)
    assert len(vocab.words) <= known
    flat = lm._average(lm._trained(training, vocab, None, 0.1, 3), len(lm.Bilinear(vocab.share).flat))
    rows = lm.score(documents, lm.Fitted(counts, vocab, flat), ["doc_id"]).collect()
    order = [r["doc_id"] for r in rows]
    learned = [t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 5 != 1]
    for r, (n, seen, total, base) in zip(rows, brute_base([texts[i] for i in order], learned)):
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, seen, total)
        assert abs(r["base_score"] - base) < 1e-6 * max(1, abs(base))
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_probabilities_sum_to_one(fitted):
    vocab = fitted.vocab
    model = lm.Bilinear(vocab.share, fitted.flat)
    history = np.array([0, 3, 5, 2])
    classes = len(vocab.share)
    total = sum(
        10 ** model.log10(np.append(history, c), np.arange(5))[-1] for c in range(classes)
    )
    assert abs(total - 1) < 1e-4
    # within a shared class: its words and one for all unseen
    tail = fitted.counts.toPandas()
    _, of = vocab.of(tail["word"].to_numpy().view(np.uint64), tail["ending"].to_numpy())
    own = vocab.classes[np.maximum(lm.lookup(vocab.words, tail["word"].to_numpy().view(np.uint64)), 0)] >= 0
    for c in np.unique(of[~own])[:20]:
        n = tail["n"].to_numpy()[(of == c) & ~own]
        assert abs(((n + 0.5).sum() + 0.5) / 10 ** vocab.within[c] - 1) < 1e-9


def test_gradient(fitted):
    """A step against the slope lowers the noise-contrastive loss it is the slope of."""
    share = fitted.vocab.share
    r = np.random.default_rng(0)
    y = r.integers(0, len(share), 300)
    at = np.concatenate([np.arange(120), np.arange(180)])

    def loss(flat, seed=5):
        model, random = lm.Bilinear(share, flat), np.random.default_rng(seed)
        noise = np.minimum(np.searchsorted(np.cumsum(share), random.random(lm.NOISE)), len(share) - 1)
        offset = np.log(lm.NOISE * share)
        q = model.predicted(y, at)[0].astype(np.float64)
        s = (q * model.word[y]).sum(1) + model.bias[y] - offset[y]
        z = q @ model.word[noise].T + model.bias[noise] - offset[noise]
        return (np.log1p(np.exp(-s)).sum() + np.log1p(np.exp(z)).sum()) / len(y)

    class Recorder(lm.Trainer):
        def _step(self, name, slope):
            getattr(slopes, name)[...] += slope

    begin = lm.Bilinear(share)
    slopes = lm.Bilinear(share, np.zeros(len(begin.flat)))
    Recorder(begin, 5, 0.1).learn(y, at)
    for k in r.choice(np.flatnonzero(np.abs(slopes.flat) > 1e-4), 25):
        moved, step = begin.flat.astype(np.float64), 2e-2
        moved[k] += step
        up = loss(moved)
        moved[k] -= 2 * step
        assert abs((up - loss(moved)) / (2 * step) - slopes.flat[k]) < 2e-3 + 0.05 * abs(slopes.flat[k])


def test_odd_and_empty(odd_docs, no_docs, fitted):
    rows = lm.score(odd_docs, fitted).collect()
    assert len(rows) == 10
    for r in rows:
        assert r["n_tokens"] == len(tokens(r["text"])) and math.isfinite(r["score"]) and r["score"] < 0
    nothing = lm.fit(no_docs)
    assert {(r["score"], r["base_score"], r["train_tokens"]) for r in lm.score(odd_docs, nothing).collect()} == {(0.0, 0.0, 0)}
    assert lm.score(no_docs, fitted).count() == 0


def test_model_grows_with_the_corpus(fitted, documents):
    """Words and endings with vectors follow the training tokens."""
    vocab = fitted.vocab
    root = vocab.tokens ** 0.25
    wanted = [least + math.ceil(k * root) for least, k in (lm.HEAD, lm.ENDINGS)]
    assert (vocab.classes >= 0).sum() == wanted[0] and len(vocab.endings) == wanted[1]
    assert len(vocab.share) == sum(wanted) + lm.OTHERS
    less = lm.vocabulary(stage(lm.token_counts(documents.where("doc_id % 9 = 0"))))
    assert len(less.share) < len(vocab.share)


def test_large_scores_do_not_overflow(fitted):
    vocab = fitted.vocab
    model = lm.Bilinear(vocab.share, fitted.flat * 60)
    y = np.random.default_rng(1).integers(0, len(vocab.share), 700)
    at = np.arange(700)
    q = model.predicted(y, at)[0].astype(float)
    z = q @ model.word.T.astype(float) + model.bias
    want = z[at, y] - z.max(1) - np.log(np.exp(z - z.max(1)[:, None]).sum(1))
    assert np.abs(z).max() > 100
    assert np.allclose(model.log10(y, at), want / math.log(10), rtol=1e-4, atol=1e-2)


def plain_score(text, fitted):
    """log10 probability of a text by a loop over its tokens, from the parameters alone."""
    vocab, m = fitted.vocab, lm.Bilinear(fitted.vocab.share, fitted.flat)
    counts = {int(r["word"]): r["n"] for r in fitted.counts.collect()}
    hasher = lm.Hasher(lower=True)
    total, history = 0.0, []
    raw = [w.decode() for w in (text or "").encode().split()]
    for token in [*raw, None]:
        if token is None:
            h, ending = lm.END, 0
        else:
            words = lm.Words(np.frombuffer(token.encode(), np.uint8), np.array([0, len(token.encode())]))
            h, ending = hasher(words)[0], int(lm.endings(words)[0])
        at = np.flatnonzero(vocab.words == h)
        k = int(at[0]) if len(at) else -1
        if k >= 0 and vocab.classes[k] >= 0:
            c = int(vocab.classes[k])
        elif ending in vocab.endings:
            c = int(vocab.ending_class[list(vocab.endings).index(ending)])
        else:
            c = vocab.first_other() + ending % (len(vocab.share) - vocab.first_other())
        begin = m.context[len(vocab.share)]
        near = [m.context[history[-1 - j]] if len(history) > j else begin for j in (0, 1)]
        recent = history[-lm.SPAN :]
        mean = np.mean([m.context[x] for x in recent], axis=0) if recent else np.zeros(lm.DIM)
        q = near[0] * m.mix[0] + near[1] * m.mix[1] + mean * m.mix[2]
        scores = m.word.astype(float) @ q + m.bias
        total += (scores[c] - np.log(np.exp(scores - scores.max()).sum()) - scores.max()) / math.log(10)
        if not (k >= 0 and vocab.classes[k] >= 0):
            total += math.log10(counts.get(int(np.uint64(h).view(np.int64)), 0) + 0.5) - vocab.within[c]
        history.append(c)
    return total


def test_scores_against_a_loop(spark, fitted, texts):
    asked = {i: t for i, t in list(texts.items())[:40] if len(t) < 3000}
    asked |= {-1: None, -2: "", -3: "  Zxqj zxqj \n The", -4: "unseenwordhere"}
    docs = spark.createDataFrame(list(asked.items()), "doc_id long, text string")
    for r in lm.score(docs, fitted, ["doc_id"]).collect():
        want = plain_score(asked[r["doc_id"]], fitted)
        assert abs(r["score"] - want) < 1e-4 * max(1, abs(want))
