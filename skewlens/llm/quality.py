"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

Each rule's cost and selectivity are measured on a sample, and the rules are tried in the
order of documents rejected per second. A later rule is evaluated only for documents that
passed the earlier ones. The order never changes the verdict.
"""

from __future__ import annotations

import statistics
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skewlens.llm.words import SPACE, WORD, fresh
from skewlens.session import stage

SYMBOLS = "[#*$%&|<>]"
WINDOW = 8
#: Rows looked at to order the rules, and passes of each rule over them: the median counts.
SAMPLE_ROWS = 4000
PASSES = 5


@dataclass(frozen=True)
class Rule:
    """``rejects`` is a boolean expression over the text and the base columns."""

    name: str
    rejects: Column


def default_rules() -> list[Rule]:
    n = F.col("n_words")
    letters = F.length(F.regexp_replace("text", r"[^\p{L}]+", ""))
    return [
        Rule("symbols", 20 * F.col("n_symbols") > n),
        Rule("repeated_lines", 2 * F.col("n_dup_lines") > F.col("n_lines")),
        Rule("echoes", 5 * F.col("n_echoes") > n),
        Rule("word_length", (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 20 * n)),
        Rule("few_letters", 2 * letters < F.col("word_chars")),
        Rule("shouting", 2 * F.length(F.regexp_replace("text", r"[^\p{Lu}]+", "")) > letters),
    ]


def word_list(text: Column) -> Column:
    return F.array_remove(F.split(text, f"{SPACE}+"), "")


def with_features(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_echoes, n_repeat_words.

    A null text counts as empty. Lines without a word are not lines. An echo is a word that
    equals the one before it. The words of an
    8-word window that the text holds twice or more are repeated, its first place included;
    windows are compared by a 64-bit hash within their own document.
    """
    words, packed, held_lines, hashes, win, in_order, at = fresh(
        docs, "_words", "_packed", "_lines", "_h", "_win", "_sorted", "_at"
    )
    text = F.coalesce("text", F.lit(""))
    filled = docs.withColumn("text", text).withColumn(words, word_list(F.col("text")))
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(WORD))
    counted = (
        filled.withColumn("n_words", F.size(words).cast("long"))
        .withColumn(packed, F.regexp_replace("text", f"{SPACE}+", ""))
        .withColumn(held_lines, lines)
        .withColumn(hashes, F.transform(words, lambda w: F.xxhash64(w)))
        .withColumn("word_chars", F.length(packed).cast("long"))
        .withColumn(
            "n_symbols",
            (F.length(packed) - F.length(F.regexp_replace(packed, SYMBOLS, ""))).cast("long"),
        )
        .withColumn("n_lines", F.size(held_lines).cast("long"))
        .withColumn("n_dup_lines", (F.size(held_lines) - F.size(F.array_distinct(held_lines))).cast("long"))
        .drop(words, packed, held_lines)
    )
    last = F.col("n_words").cast("int") - WINDOW
    windows = F.when(
        last >= 0,
        F.transform(
            F.sequence(F.lit(0), last),
            lambda i: F.xxhash64(*[F.get(F.col(hashes), i + k) for k in range(WINDOW)]),
        ),
    )
    echoes = F.filter(hashes, lambda h, i: F.coalesce(h == F.get(F.col(hashes), i - 1), F.lit(False)))
    counted = counted.withColumn("n_echoes", F.size(echoes).cast("long"))
    windowed = counted.withColumn(win, windows).drop(hashes)
    # only texts that hold some window twice go through the sort
    ordered = F.when(
        F.size(F.array_distinct(win)) < F.size(win),
        F.sort_array(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    )
    windowed = windowed.withColumn(in_order, ordered).drop(win)
    beside = lambda i, k: F.get(F.col(in_order), i + k)["h"]
    twice = F.filter(
        in_order,
        lambda x, i: F.coalesce(x["h"] == beside(i, -1), F.lit(False))
        | F.coalesce(x["h"] == beside(i, 1), F.lit(False)),
    )
    places = F.sort_array(F.transform(twice, lambda x: x["i"]))
    windowed = windowed.withColumn(at, places).drop(in_order)
    spans = F.transform(
        at, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col(at), i + 1) - p, F.lit(WINDOW)))
    )
    covered = F.aggregate(spans, F.lit(0), lambda total, s: total + s)
    # the row number, never negative, keeps filters on the result from being pushed down: they
    # would repeat every array expression above
    repeated = F.when(F.monotonically_increasing_id() >= 0, F.coalesce(covered, F.lit(0)).cast("long"))
    return windowed.withColumn("n_repeat_words", repeated).drop(at)


def base_failed() -> Column:
    n = F.col("n_words")
    return (n < 20) | (100 * F.col("n_repeat_words") > 30 * n)


def order_rules(docs: DataFrame, rules: list[Rule], sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules by rejections per second on a sample of about ``sample_rows`` rows.

    Cost is the median time of a pass with the rule less that of a pass without any. The
    passes of all rules take turns, so that a slow moment does not fall on one of them.
    """
    rows = docs.count()
    if not rows or len(rules) < 2:
        return list(rules)
    sample = docs.sample(fraction=min(1.0, sample_rows / rows), seed=42)
    sample = stage(with_features(sample.select("text")).repartition(2), "rule-sample")

    def seconds(condition: Column) -> tuple[float, int]:
        start = time.perf_counter()
        found = sample.agg(F.count(F.lit(1)), F.sum(F.length("text")), F.count_if(condition)).head()
        return time.perf_counter() - start, found[2]

    tried = [F.lit(False), *(rule.rejects for rule in rules)]
    for condition in tried:
        seconds(condition)  # compiles the plan
    rounds = [[seconds(condition) for condition in tried] for _ in range(PASSES)]
    spent = [statistics.median(r[k][0] for r in rounds) for k in range(len(tried))]
    scored = []
    for place in range(len(rules)):
        rejected = rounds[0][place + 1][1]
        scored.append((-rejected / max(spent[place + 1] - spent[0], 1e-3), place))
    return [rules[place] for _, place in sorted(scored)]


def cascade(rules: list[Rule]) -> Column:
    """Name of the first rule that rejects, null where all pass; stops at the first."""
    verdict = F.lit(None).cast("string")
    for rule in reversed(rules):
        verdict = F.when(F.coalesce(rule.rejects, F.lit(False)), F.lit(rule.name)).otherwise(verdict)
    return verdict


def judge(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """All columns of ``docs`` (text among them) with the base features, base_failed and kept.

    Columns of ``docs`` that clash with a feature are replaced. Empty and null texts have no
    word and fail the base. An empty table gives an empty table.
    """
    ordered = order_rules(docs, rules if rules is not None else default_rules(), sample_rows)
    judged = with_features(docs).withColumn("base_failed", base_failed())
    rejected = F.when(F.col("base_failed"), F.lit("base")).otherwise(cascade(ordered))
    return judged.withColumn("kept", rejected.isNull())
