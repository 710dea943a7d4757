import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators themselves write.
CLASHING = ("size", "shard", "slot", "kept", "n_words", "lang_pred", "lang_score", "toxicity", "copies", "taken", "fp", "score", "rare", "spans", "law")


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(texts, ids=None, source="s", lang="en"):
        ids = list(range(len(texts))) if ids is None else ids
        rows = [(i, t, lang, source, None if t is None else len(t)) for i, t in zip(ids, texts)]
        return spark.createDataFrame(rows, COLUMNS)

    return make


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, clashing columns."""
    long_text = " ".join(f"w{k % 977}" for k in range(30_000))
    rows = [
        (None, None, None, None, None),
        (None, "a text without an id", "en", "s", 20),
        (1, None, "en", "s", None),
        (2, "", "en", None, 0),
        (3, " \t\n\x0b\x0c\r ", None, "s", 7),
        (4, long_text, "en", "t", len(long_text)),
        (5, "one two three", "en", "s", 13),
        (5, "one two three", "en", "s", 13),
        (6, "one two three", "de", "s", 13),
        (7, " 中文 \U0001f600 *** !!!", "zh", "t", 12),
    ]
    docs = spark.createDataFrame(rows, COLUMNS)
    for name in CLASHING:
        docs = docs.selectExpr("*", f"'x' AS {name}")
    return docs


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] or "" for r in documents.select("doc_id", "text").collect()}
