"""Benchmark decontamination by latent semantic retrieval.

Passages are described by TF-IDF over the words of the benchmark. A randomised SVD of all
passages, those of the benchmark weighted up to the rest, gives a latent space; windows of
the documents are compared with benchmark passages by cosine in it, and close pairs are
checked by their longest common subsequence and by the words of the passage's answer, its
last sentence. Short passages are compared with windows of their own length, so that they
are found where many stand side by side; those of a few words are looked up as they are.
Texts are read once: what follows works on the places of benchmark words.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skewlens.llm.words import Hasher, Words, blocks, fresh, lookup, mapped, punctuation_bytes
from skewlens.session import stage

#: Words of a passage; windows of the search are two passages long and one apart.
PASSAGE = 32
#: Passages of the search for parts of no more words than that.
SHORT = (8, 16)
#: Longest part of a benchmark item that is compared as a whole.
PART = 64
#: Items with fewer words are looked up word for word.
MIN_WORDS = 5
#: Benchmark parts that share one latent space, and directions beyond one for each.
PARTS, EXTRA = 256, 24
#: Latent spaces served by one read of the texts: their words, 8 bytes each, are broadcast.
SPACES = 256
#: Terms in a larger share of the passages have no weight in the latent space. Copies of an
#: item count too, so parts that would keep less than KEPT of their energy get terms back,
#: the rarest first, and are looked for by their words as well.
MAX_SHARE, KEPT = 0.001, 0.5
#: Least cosine of a candidate. A window's length is taken before it is projected: what it
#: holds beyond the benchmark's directions counts against it.
COSINE = 0.35
#: Shares of a part's words in order, with and without its answer; CHANCE words more are
#: asked for with the answer, since a few words of a short part meet anywhere.
COMMON_WITH_ANSWER, COMMON_ALONE, ANSWER, CHANCE = 0.5, 0.8, 0.5, 2
#: Parts looked for by their words must have them within so many times their length: these
#: words may be frequent ones, of which some meet in any text.
STRETCH = 2


@dataclass
class Benchmark:
    """Parts of the items: item ids, word numbers, and the numbers of the answer's words (None
    for parts before the last, which do not hold it). ``brief``: items of under MIN_WORDS words."""

    items: list[int]
    parts: list[np.ndarray]
    answers: list[np.ndarray | None]
    vocabulary: np.ndarray  # sorted hashes; a word's number is its position
    brief: list[tuple[int, np.ndarray]] = field(default_factory=list)


def _hashes(text: str, hasher: Hasher) -> np.ndarray:
    raw = np.frombuffer(pc.utf8_lower(text).as_py().encode(), np.uint8)
    return hasher(Words(raw, np.array([0, len(raw)]), punctuation_bytes()))


def read_benchmark(rows: list) -> Benchmark:
    hasher = Hasher(between=punctuation_bytes())
    items, texts, answers, brief = [], [], [], []
    for item_id, text in rows:
        words = _hashes(text, hasher)
        sentences = [s for s in re.split(r"[.!?\n]+", text) if s.strip()]
        answer = _hashes(sentences[-1], hasher) if sentences else words[:0]
        if 0 < len(words) < MIN_WORDS:
            brief.append((item_id, words))
            continue
        count = max(1, len(words) // PART)
        for k, part in enumerate(np.array_split(words, count)):
            if len(part) >= MIN_WORDS:
                items.append(item_id)
                texts.append(part)
                answers.append(answer if k == count - 1 else None)
    held = texts + [words for _, words in brief]
    vocabulary = np.unique(np.concatenate(held)) if held else np.zeros(0, np.uint64)
    number = lambda words: lookup(vocabulary, words)
    known = [a if a is None else (n := number(a))[n >= 0] for a in answers]
    return Benchmark(items, [number(t) for t in texts], known, vocabulary, [(i, number(w)) for i, w in brief])


def benchmark_words(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """``(doc_id, text_key, n_words, at, word)``: places and numbers of the benchmark's words."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def make():
        known, between = shared.value, punctuation_bytes()
        hasher = Hasher(between=between)

        def of_texts(column):
            counts, sizes, places, numbers = [], [], [], []
            for _, _, words in blocks(pc.utf8_lower(column), between=between):
                found = lookup(known, hasher(words))
                hits = np.flatnonzero(found >= 0)
                first = np.searchsorted(hits, words.of)
                counts.append(words.counts())
                sizes.append(np.diff(first))
                places.append(hits - np.repeat(words.of[:-1], np.diff(first)))
                numbers.append(found[hits])
            join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
            offsets = pa.array(np.concatenate(([0], np.cumsum(join(sizes, np.int64)))).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(join(x, np.int32))) for x in (places, numbers)]
            return [pa.array(join(counts, np.int64)), *lists]

        return of_texts

    keyed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), "text"
    )
    return mapped(keyed, ["doc_id", "text_key"], "n_words long, at array<int>, word array<int>", make)


def narrowed(found: DataFrame, vocabulary: np.ndarray, part: np.ndarray) -> DataFrame:
    """The rows of ``benchmark_words(docs, vocabulary)`` with the words of ``part`` alone, in its numbers."""
    numbers = np.full(len(vocabulary), -1, np.int32)
    numbers[lookup(vocabulary, part)] = np.arange(len(part))
    shared = found.sparkSession.sparkContext.broadcast(numbers)

    def run(batches):
        for batch in batches:
            places, first = _lists(batch.column(3))
            own = shared.value[_lists(batch.column(4))[0]]
            hits = np.flatnonzero(own >= 0)
            offsets = pa.array(np.searchsorted(hits, first).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x[hits])) for x in (places, own)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *lists], names=batch.schema.names)

    return found.select("doc_id", "text_key", "n_words", "at", "word").mapInArrow(run, found.schema)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and where each row's begin."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy()[offsets[0] : offsets[-1]], offsets - offsets[0]


def _entries(n_words: pa.Array, at: pa.Array, word: pa.Array, size: int, length: int = PASSAGE):
    """Distinct ``(passage, word)`` with counts; ``of``: first passage of each row, and their number."""
    places, first = _lists(at)
    numbers, _ = _lists(word)
    passages = -(-n_words.to_numpy() // length)
    of = np.concatenate(([0], np.cumsum(passages)))
    passage = np.repeat(of[:-1], np.diff(first)) + places // length
    keys, count = np.unique(passage * np.int64(size) + numbers, return_counts=True)
    return keys // size, keys % size, count, of


def _pieces(batches, n_words: int, passages: int = 1 << 14):
    """Slices of the batches with about as many passages: each has a row of the latent space's width."""
    for batch in batches:
        ahead = np.cumsum(-(-batch.column(n_words).to_numpy() // PASSAGE))
        row = 0
        while row < batch.num_rows:
            before = ahead[row - 1] if row else 0
            end = max(row + 1, int(np.searchsorted(ahead, before + passages, "right")))
            yield batch.slice(row, end - row)
            row = end


def passage_frequencies(found: DataFrame, size: int) -> tuple[np.ndarray, int]:
    def count(batches):
        df, total = np.zeros(size, np.int64), 0
        for batch in _pieces(batches, 0):
            _, numbers, _, of = _entries(batch.column(0), batch.column(1), batch.column(2), size)
            df += np.bincount(numbers, minlength=size)
            total += int(of[-1])
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(seen, -1).astype(np.int32)), pa.array(np.append(df[seen], total))], names=["word", "n"]
        )

    counted = found.select("n_words", "at", "word").mapInArrow(count, "word int, n long")
    table = counted.groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    at, n = table["word"].to_numpy(), table["n"].to_numpy()
    df = np.zeros(size, np.int64)
    df[at[at >= 0]] = n[at >= 0]
    return df, int(n[at < 0].sum())


def _rows(numbers, values, passage, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Passages that have entries, and the sums of their entries' basis rows."""
    first = np.flatnonzero(np.concatenate(([True], passage[1:] != passage[:-1]))) if len(passage) else np.zeros(0, np.int64)
    if not len(first):
        return np.zeros(0, np.int64), np.zeros((0, basis.shape[1]), np.float32)
    out = np.empty((len(first), basis.shape[1]), np.float32)
    for k in range(0, len(first), 4096):  # keeps the gathered rows in cache
        a, b = first[k], first[k + 4096] if k + 4096 < len(first) else len(passage)
        out[k : k + 4096] = np.add.reduceat(basis[numbers[a:b]] * values[a:b, None], first[k : k + 4096] - a, axis=0)
    return passage[first], out


def _gram_times(found: DataFrame, idf: np.ndarray, test: np.ndarray) -> np.ndarray:
    """Sum over all passages of ``a' (a test)``, a: the passage's TF-IDF row of length one.

    Tasks send their sums in slices, which are added up in two levels, so that no task
    gathers those of all others.
    """
    size, width = test.shape
    slices = max(1, -(-size * width // (1 << 18)))
    shared = found.sparkSession.sparkContext.broadcast((idf, test))

    def multiply(batches):
        weights, omega = shared.value
        total = np.zeros((size, width), np.float32)
        for batch in _pieces(batches, 0):
            passage, numbers, count, _ = _entries(batch.column(0), batch.column(1), batch.column(2), size)
            use = weights[numbers] > 0
            passage, numbers, values = passage[use], numbers[use], (count[use] * weights[numbers[use]]).astype(np.float32)
            if not len(passage):
                continue
            starts = np.flatnonzero(np.concatenate(([True], passage[1:] != passage[:-1])))
            norm = np.sqrt(np.add.reduceat(values * values, starts))
            row = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(passage))))
            values = values / norm[row]
            _, y = _rows(numbers, values, passage, omega)
            order = np.argsort(numbers, kind="stable")
            at, part = _rows(row[order], values[order], numbers[order], y)
            total[at] += part
        cut = np.array_split(total, slices)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(slices, dtype=np.int32)), pa.array([c.tobytes() for c in cut], pa.binary())],
            names=["slice", "sums"],
        )

    def add(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.float32).astype(np.float64) for x in rows["sums"].to_pylist())
        return pa.table({"slice": [rows["slice"][0].as_py()], "sums": [total.astype(np.float32).tobytes()]},
                        schema=pa.schema([("slice", pa.int32()), ("sums", pa.binary())]))

    ddl = "slice int, sums binary"
    sums = found.select("n_words", "at", "word").mapInArrow(multiply, ddl)
    dealt = sums.withColumn("_task", F.spark_partition_id() % 1000)
    dealt = dealt.groupBy("slice", "_task").applyInArrow(add, ddl).groupBy("slice").applyInArrow(add, ddl)
    parts = {r["slice"]: np.frombuffer(r["sums"], np.float32) for r in dealt.collect()}
    if not parts:
        return np.zeros((size, width))
    return np.concatenate([parts[k] for k in sorted(parts)]).reshape(size, width).astype(np.float64)


def latent_space(found: DataFrame, parts: np.ndarray, idf: np.ndarray, passages: int, seed: int = 42) -> np.ndarray:
    """Leading right singular vectors (word x direction) of the TF-IDF of all passages.

    ``parts`` are the benchmark's rows of length one; together they weigh as much as the
    corpus, else the few directions that tell its items apart would drown. One pass of the
    corpus gives ``G = A'A`` times a random matrix; the Nystrom form of G follows from it.
    """
    rank = min(parts.shape[1], len(parts) + EXTRA)
    width = min(parts.shape[1], rank + 8)
    test = np.random.default_rng(seed).normal(size=(parts.shape[1], width)).astype(np.float32)
    weight = max(passages, 1) / len(parts)
    sketch = _gram_times(found, idf, test) + weight * (parts.T @ (parts @ test.astype(np.float64)))
    shift = 1e-7 * np.linalg.norm(sketch)
    shifted = sketch + shift * test
    core = test.T.astype(np.float64) @ shifted
    try:
        factor = np.linalg.solve(np.linalg.cholesky((core + core.T) / 2), shifted.T).T
    except np.linalg.LinAlgError:  # the words span fewer directions than were asked for
        factor = shifted
    vectors, _, _ = np.linalg.svd(factor, full_matrices=False)
    return vectors[:, :rank].astype(np.float32)


def common_words(part: np.ndarray, window: np.ndarray) -> int:
    """Length of the longest common subsequence, a row of the table in the bits of one integer."""
    places: dict[int, int] = {}
    for k, w in enumerate(part.tolist()):
        places[w] = places.get(w, 0) | 1 << k
    full = (1 << len(part)) - 1
    row = full
    for w in window.tolist():
        match = row & places.get(w, 0)
        row = ((row + match) | (row - match)) & full
    return len(part) - row.bit_count()


def by_words(parts: list[np.ndarray], idf: np.ndarray, full: np.ndarray) -> np.ndarray:
    """Parts of which terms without weight (0 in ``idf``) took more than the latent space can miss."""
    energy = lambda weights, part: float((np.bincount(part, weights[part]) ** 2).sum())
    return np.array([k for k, p in enumerate(parts) if energy(idf, p) < KEPT * energy(full, p)], np.int64)


def restored(parts: list[np.ndarray], idf: np.ndarray, full: np.ndarray, plain: np.ndarray) -> np.ndarray:
    """``idf`` with the weights of ``plain`` parts' rarest terms back, until each part has KEPT of its energy."""
    idf = idf.copy()
    for p in plain.tolist():
        words, times = np.unique(parts[p], return_counts=True)
        energy = (times * full[words].astype(np.float64)) ** 2
        order = np.argsort(-full[words], kind="stable")
        enough = int(np.searchsorted(np.cumsum(energy[order]), KEPT * energy.sum())) + 1
        back = words[order[:enough]]
        idf[back] = full[back]
    return idf


def _brief(places: np.ndarray, numbers: np.ndarray, first: np.ndarray, wanted: list[tuple[int, np.ndarray]]):
    """``(row, item)`` of the wanted word sequences that stand in a row's text, each once."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for n in sorted({len(words) for _, words in wanted}):
        ends = len(numbers) - n + 1
        if ends <= 0:
            continue
        whole = (places[n - 1 :] - places[:ends] == n - 1) & (row[n - 1 :] == row[:ends])
        for item, words in wanted:
            if len(words) == n:
                here = whole.copy()
                for k, w in enumerate(words.tolist()):
                    here &= numbers[k : k + ends] == w
                for d in np.unique(row[:ends][here]).tolist():
                    yield d, item


def _sharing(passage, numbers, count, of, held: np.ndarray, least: np.ndarray):
    """``(first passage, part)`` of every run of four passages of a document that holds at least
    ``least`` words of a part, in any order. ``held``: word x part, how often. Nothing that
    has them in order is missed."""
    use = held.any(1)[numbers]
    passage, numbers, count = passage[use], numbers[use], count[use]
    begin = of[np.searchsorted(of, passage, "right") - 1]
    size = len(held)
    runs = [(passage - k >= begin, k) for k in range(4)]
    keys = np.concatenate([(passage[ok] - k) * np.int64(size) + numbers[ok] for ok, k in runs])
    keys, back = np.unique(keys, return_inverse=True)
    times = np.bincount(back, np.concatenate([count[ok] for ok, _ in runs]), len(keys)).astype(held.dtype)
    run, word = keys // size, keys % size
    first = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1]))) if len(run) else np.zeros(0, np.int64)
    for k in range(0, len(first), 4096):
        a, b = first[k], first[k + 4096] if k + 4096 < len(first) else len(run)
        both = np.minimum(held[word[a:b]], times[a:b, None])
        total = np.add.reduceat(both, first[k : k + 4096] - a, axis=0)
        for r, p in zip(*np.nonzero(total >= least)):
            yield int(run[first[k + r]]), int(p)


def _stretches(places: np.ndarray, numbers: np.ndarray, begin: int, words: int):
    """Words of the four passages from ``begin``, in stretches of STRETCH times ``words``, half of ``words`` apart."""
    end = begin + 4 * PASSAGE
    for at in range(begin, max(begin + 1, end - words), max(1, words // 2)):
        a, b = np.searchsorted(places, [at, min(end, at + STRETCH * words)])
        yield numbers[a:b]


def _near(passage, numbers, count, of, weights, vectors, wanted, length: int):
    """``(row, first word, part, cosine)`` of windows, with a passage before and behind, near a wanted vector."""
    use = weights[numbers] > 0
    passage, numbers = passage[use], numbers[use]
    values = (count[use] * weights[numbers]).astype(np.float32)
    have, rows = _rows(numbers, values, passage, vectors)
    # a window is a passage and the next one of the same document
    doc = np.searchsorted(of, have, "right") - 1
    follows = np.flatnonzero((np.diff(have) == 1) & (doc[1:] == doc[:-1])) if len(have) else np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate(([True], passage[1:] != passage[:-1]))) if len(passage) else follows
    square = np.add.reduceat(values * values, starts) if len(passage) else np.zeros(0)
    windows = rows.copy()
    windows[follows] += rows[follows + 1]
    norms = square.copy()
    norms[follows] += square[follows + 1]
    for k in range(0, len(have), 8192):
        cosine = windows[k : k + 8192] @ wanted.T / np.maximum(np.sqrt(norms[k : k + 8192]), 1e-9)[:, None]
        for w, p in zip(*np.nonzero(cosine >= COSINE)):
            d = int(doc[k + w])
            yield d, (int(have[k + w]) - int(of[d]) - 1) * length, p, float(cosine[w, p])


def _search(
    found: DataFrame, bench: Benchmark, idf: np.ndarray, basis: np.ndarray, latent: np.ndarray, frequent: np.ndarray
) -> DataFrame:
    """``frequent``: the parts that are also looked for by their words."""
    size = len(idf)
    shared = found.sparkSession.sparkContext.broadcast(
        (bench.items, bench.parts, bench.answers, idf, basis, latent, frequent, bench.brief)
    )
    sizes = np.array([len(p) for p in bench.parts])
    scales, least_words = [], 0
    for length in (*SHORT, PASSAGE):
        chosen = np.flatnonzero((sizes > least_words) & ((sizes <= length) | (length == PASSAGE)))
        if len(chosen):
            scales.append((length, chosen))
        least_words = length
    smallest = min((length for length, _ in scales), default=PASSAGE)

    def search(batches):
        items, parts, answers, weights, vectors, wanted, plain, brief = shared.value
        held = np.zeros((size, len(plain)), np.float32)
        for k, p in enumerate(plain.tolist()):
            np.add.at(held[:, k], parts[p], 1)
        least = np.array([COMMON_WITH_ANSWER * len(parts[p]) + CHANCE for p in plain.tolist()], np.float32)

        def judged(p: int, there: np.ndarray) -> tuple[float, float] | None:
            share = common_words(parts[p], there) / len(parts[p])
            if share < COMMON_WITH_ANSWER + CHANCE / len(parts[p]):
                return None
            if answers[p] is None:
                return (share, 0.0) if share >= COMMON_ALONE else None
            answer = float(np.isin(answers[p], there).mean()) if len(answers[p]) else 1.0
            return (share, answer) if share >= COMMON_ALONE or answer >= ANSWER else None

        for batch in _pieces(batches, 2, (1 << 14) * smallest // PASSAGE):
            n_words, at, word = batch.column(2), batch.column(3), batch.column(4)
            passage, numbers, count, of = _entries(n_words, at, word, size)
            places, first = _lists(at)
            all_words, _ = _lists(word)
            best: dict[tuple[int, int], list[float]] = {}

            def note(d: int, p: int, *figures: float) -> None:
                seen = best.get((d, items[p]), [0.0, 0.0, 0.0])
                best[d, items[p]] = [max(x, y) for x, y in zip(seen, figures)]

            for run, k in _sharing(passage, numbers, count, of, held, least) if len(plain) else ():
                p, d = int(plain[k]), int(np.searchsorted(of, run, "right")) - 1
                if best.get((d, items[p]), [0.0, 0.0])[:2] == [1.0, 1.0]:
                    continue
                own = slice(first[d], first[d + 1])
                begin = (run - int(of[d])) * PASSAGE
                for there in _stretches(places[own], all_words[own], begin, len(parts[p])):
                    if verdict := judged(p, there):
                        note(d, p, *verdict, 0.0)
            for d, item in _brief(places, all_words, first, brief):
                best[d, item] = [1.0, 1.0, 0.0]
            for length, chosen in scales:
                of_scale = (passage, numbers, count, of)
                if length != PASSAGE:
                    of_scale = _entries(n_words, at, word, size, length)
                for d, begin, p, cosine in _near(*of_scale, weights, vectors, wanted[chosen], length):
                    own = slice(first[d], first[d + 1])
                    a, b = np.searchsorted(places[own], [begin, begin + 4 * length])
                    p = int(chosen[p])
                    if verdict := judged(p, all_words[own][a:b]):
                        note(d, p, *verdict, cosine)
            rows_of = pa.array([d for d, _ in best], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(rows_of),
                    batch.column(1).take(rows_of),
                    pa.array([i for _, i in best], pa.int64()),
                    *[pa.array([v[k] for v in best.values()], pa.float64()) for k in range(3)],
                ],
                names=["doc_id", "text_key", "item_id", "common", "answer", "cosine"],
            )

    ddl = "doc_id long, text_key long, item_id long, common double, answer double, cosine double"
    return found.select("doc_id", "text_key", "n_words", "at", "word").mapInArrow(search, ddl)


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, text_key, item_id, common, answer, cosine)``: one row for each benchmark item
    in each document; clean documents have none.

    ``common`` is the share of the item's words found in order, ``answer`` the share of its
    answer's words, ``cosine`` that of the latent vectors, each the best over windows and
    parts of the item; it is 0 where the words alone were looked for. ``text_key`` is a hash
    of the text. Null texts hold nothing; items that are null or have no word are not looked
    for, items of under 5 words are found word for word, their words side by side; repeated
    rows are found alike. The texts are read once for every SPACES latent spaces of the
    benchmark, and the benchmark itself in bounded parts, whatever its size.
    """
    spark = docs.sparkSession
    wanted = benchmark.where("text IS NOT NULL AND item_id IS NOT NULL")
    wanted = wanted.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    length = F.greatest(F.lit(1), F.regexp_count("text", F.lit(r"\S+")) / PART)
    slots = wanted.agg(F.sum(F.ceil(length))).head()[0] or 0
    spaces = max(1, -(-int(slots) // PARTS))
    wanted = wanted.withColumn("space", F.pmod(F.xxhash64("item_id"), F.lit(spaces)))
    leaks = None
    for begin in range(0, spaces, SPACES):
        rows = wanted.where(F.col("space").between(begin, begin + SPACES - 1)).orderBy("space", "item_id", "text")
        of_space = itertools.groupby(rows.toLocalIterator(), lambda r: r["space"])
        read = [read_benchmark([(r["item_id"], r["text"]) for r in group]) for _, group in of_space]
        read = [bench for bench in read if len(bench.vocabulary)]
        if not read:
            continue
        vocabulary = np.unique(np.concatenate([bench.vocabulary for bench in read]))
        found = stage(benchmark_words(docs, vocabulary), "benchmark-words")
        for bench in read:
            own = found if len(read) == 1 else narrowed(found, vocabulary, bench.vocabulary)
            part = stage(_leaks_of(own, bench), "leaks")
            leaks = part if leaks is None else leaks.unionByName(part)
    if leaks is None:
        ddl = "doc_id long, text_key long, item_id long, common double, answer double, cosine double"
        return spark.createDataFrame([], ddl)
    return leaks


def _leaks_of(found: DataFrame, bench: Benchmark) -> DataFrame:
    size = len(bench.vocabulary)
    df, passages = passage_frequencies(found, size)
    full = np.log1p(passages / np.maximum(df, 1)).astype(np.float32)
    idf = np.where(df > max(MAX_SHARE * passages, 50), np.float32(0), full)
    plain = by_words(bench.parts, idf, full)
    idf = restored(bench.parts, idf, full, plain)
    if not bench.parts:
        none = np.zeros((0, 1), np.float32)
        return _search(found, bench, idf, np.zeros((size, 1), np.float32), none, plain)
    rows = np.zeros((len(bench.parts), size))
    for k, part in enumerate(bench.parts):
        np.add.at(rows[k], part, idf[part])
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    rows = np.divide(rows, norm, out=rows, where=norm > 0)
    basis = latent_space(found, rows, idf, passages)
    latent = rows @ basis
    norm = np.linalg.norm(latent, axis=1, keepdims=True)
    latent = np.divide(latent, norm, out=latent, where=norm > 0).astype(np.float32)
    return _search(found, bench, idf, basis, latent, plain)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs`` that hold no benchmark item, unchanged."""
    [leak] = fresh(docs, "_leak")
    leaks = find_leaks(docs, benchmark).select(F.struct("doc_id", "text_key").alias(leak)).distinct()
    key = F.struct(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key")
    )
    return docs.join(leaks, key == F.col(leak), "left_anti")
