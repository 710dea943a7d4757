import numpy as np
import pyarrow as pa

from skewlens.llm import decontam, mixing, quality, sharding, simhash
from skewlens.llm.words import Hasher, Index, blocks, lookup, rolled

TEXTS = ["", " a  bc\n", None, "x", "Abé  y\tz\x0b", "tail "]


def test_words_and_hashes():
    hasher, found = Hasher(), []
    for _, _, words in blocks(pa.array(TEXTS), size=4):
        hashes = hasher(words)
        raw = words.data.tobytes()
        for d in range(words.docs):
            here = range(words.of[d], words.of[d + 1])
            found.append([(raw[words.starts[w] : words.ends[w]], int(hashes[w])) for w in here])
    assert [[w for w, _ in doc] for doc in found] == [(t or "").encode().split() for t in TEXTS]
    by_word = {}
    for doc in found:
        for w, h in doc:
            assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_hash_does_not_depend_on_place():
    text = "alpha beta alpha gamma"
    [(_, _, words)] = blocks(pa.array([text]))
    [(_, _, shouted)] = blocks(pa.array([text.upper()]))
    h = Hasher(lower=True)(words)
    assert h[0] == h[2] != h[1]
    assert (Hasher(lower=True)(shouted) == h).all() and (Hasher()(shouted) != h).all()


def test_rolled():
    h = np.random.default_rng(0).integers(0, 5, 400).astype(np.uint64)
    for width in (1, 2, 3, 8, 16, 50):
        r = rolled(h, width)
        runs = [tuple(h[i : i + width]) for i in range(len(h) - width + 1)]
        assert len(r) == len(runs) and len(set(zip(runs, r.tolist()))) == len(set(runs)) == len(set(r.tolist()))
    assert len(rolled(h[:3], 4)) == 0


def test_index():
    r = np.random.default_rng(2)
    for n in (0, 1, 3, 1000, 50_000):
        keys = np.unique(r.integers(0, 2**64, n, np.uint64))
        keys[: n // 10] = keys[: n // 10] & np.uint64(0xFFFF)  # many that share their leading bits
        keys = np.unique(keys)
        wanted = np.concatenate([keys, r.integers(0, 2**64, 100, np.uint64), np.array([0, 2**64 - 1], np.uint64)])
        assert (Index(keys)(wanted) == lookup(keys, wanted)).all()


def test_lookup():
    assert lookup(np.array([2, 5, 9]), np.array([9, 1, 5, 10])).tolist() == [2, -1, 1, -1]
    assert lookup(np.array([], int), np.array([1])).tolist() == [-1]


def test_columns_of_the_caller_are_kept(spark):
    """Columns named like those an operator works with come through with their values."""
    names = ["_h", "_words", "_lines", "_at", "_region", "_rack", "_place", "_class", "_base", "_copy", "_leak"]
    names += ["_hash", "_slot", "_bucket", "_ahead", "_n", "_times", "_Win", "_text", "_keep", "_id"]
    rows = [(i, f"some words of text number {i}", "s", *(f"{c}{i}" for c in names)) for i in range(12)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "source", *names])
    bench = spark.createDataFrame([(1, "other words that nobody holds at all")], "item_id long, text string")
    results = {
        "judge": quality.judge(docs),
        "shard": sharding.shard(docs),
        "mixed": mixing.mixed(docs),
        "clean": decontam.clean(docs, bench),
        "one": simhash.one_of_each(docs),
    }
    for name, found in results.items():
        for r in found.collect():
            assert [r[c] for c in names] == [f"{c}{r['doc_id']}" for c in names], name


def test_mix_keeps_columns_named_like_its_results(spark):
    rows = [(i, "a b c", "s", f"x{i}", f"y{i}") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string, _own_size string")
    assert sorted(mixing.mixed(docs).collect()) == sorted(docs.collect())
