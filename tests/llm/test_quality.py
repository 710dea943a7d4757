import re

from pyspark.sql import functions as F

from skewlens.llm import quality


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", text or "")
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    hit = {p for at in windows.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    packed = "".join(words)
    return len(words), len(packed), len(re.findall(r"[#*$%&|<>]", packed)), len(lines) - len(set(lines)), len(hit)


FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_features(documents, odd_docs, make_docs):
    phrase = "a b c d e f g h "
    made = make_docs([phrase * 2, phrase + phrase.strip(), (phrase + "x ") * 3, "a " * 40, "l\nl\n \nl", "a b c d e f g h"])
    for docs in (documents, odd_docs, made):
        for row in quality.with_features(docs).collect():
            assert tuple(row[f] for f in FEATURES) == brute(row["text"])


def test_cascade_order_and_verdict(documents):
    rules = quality.default_rules()
    ordered = quality.order_rules(documents, rules, 100)
    assert sorted(r.name for r in ordered) == sorted(r.name for r in rules)
    features = quality.with_features(documents)
    verdicts = [
        features.select("doc_id", quality.cascade(order).isNull().alias("ok")) for order in (rules, rules[::-1])
    ]
    assert verdicts[0].exceptAll(verdicts[1]).isEmpty()


def test_later_rules_are_not_evaluated(spark):
    rules = [quality.Rule("first", F.col("n") > 0), quality.Rule("never", F.raise_error(F.lit("tried")).isNotNull())]
    assert spark.range(1, 3).toDF("n").select(quality.cascade(rules).alias("r")).distinct().head()["r"] == "first"


def test_odd_and_empty(odd_docs, no_docs):
    rows = quality.judge(odd_docs).collect()
    assert len(rows) == 10 and all(isinstance(r["kept"], bool) for r in rows)
    assert all(r["base_failed"] and not r["kept"] for r in rows if not (r["text"] or "").strip())
    assert quality.judge(no_docs).count() == 0


def test_agrees_with_labels(spark, data):
    """The rules were made for junk of all kinds; on labelled rows they are right nearly always."""
    sf = data.replace("sf0.001", "sf0.01")
    judged = quality.judge(spark.read.parquet(f"{sf}/documents.parquet")).where("n_words >= 20")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    wrong = judged.join(labels, "doc_id").where(F.col("kept") != (F.col("quality") == 1)).count()
    assert wrong <= 0.05 * labels.count()
