"""Name -> query and SQL of the text operators, over the given tables."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skewlens.llm import (
    chat,
    decontam,
    html,
    langid,
    lm,
    mixing,
    quality,
    repair,
    sharding,
    simhash,
    substrings,
    toxicity,
    whitening,
)
from skewlens.session import local_table, stage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_QUALITY_SQL = """
WITH src AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
             regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g') AS packed,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
      FROM src),
win AS (SELECT doc_id, i, array_to_string(list_slice(words, i, i + 7), ' ') AS phrase
        FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, phrase) > 1),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id),
f AS (SELECT w.doc_id, text, len(words)::BIGINT AS n_words, length(packed)::BIGINT AS word_chars,
             (length(packed) - length(regexp_replace(packed, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             len(lines) AS n_lines,
             len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1])) AS n_echoes,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             coalesce(n, 0)::BIGINT AS n_repeat_words,
             length(regexp_replace(text, '[^\\p{L}]+', '', 'g')) AS letters,
             length(regexp_replace(text, '[^\\p{Lu}]+', '', 'g')) AS capitals
      FROM w LEFT JOIN hit USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 20 * n_symbols > n_words OR 2 * n_dup_lines > n_lines OR 5 * n_echoes > n_words
            OR word_chars < 2 * n_words OR word_chars > 20 * n_words
            OR 2 * letters < word_chars OR 2 * capitals > letters) AS kept
FROM b"""


@query(_QUALITY_SQL)
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query()
def op2_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=24).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )


@query()
def op3_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@query()
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out()))
    found = langid.identify(docs.withColumn("held_out", langid.held_out()), model, ["doc_id", "held_out"])
    return found.withColumnRenamed("lang_score", "score")


@query()
def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return leaks.select("doc_id", "item_id", "common", "answer", "cosine")


@query()
def op6_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~toxicity.held_out()))
    found = toxicity.score(docs.withColumn("held_out", toxicity.held_out()), model, ["doc_id", "held_out"])
    return found.select(
        "doc_id", "held_out", F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.3).cast("int").alias("predicted")
    )


@query()
def op7_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, distance=3)
    return found.select("doc_id", simhash.hex_digits().alias("fingerprint"), "component_id")


@query()
def op8_log_bilinear_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fitted = lm.fit(docs.where(~lm.held_out()))
    return lm.score(docs.withColumn("held_out", lm.held_out()), fitted, ["doc_id", "held_out"])


_SUBSTRING_SQL = """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
win AS (SELECT doc_id, i, sha256(array_to_string(list_slice(words, i, i + 49), ' ')) AS phrase
        FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM w)),
late AS (SELECT doc_id, i FROM win QUALIFY min(doc_id) OVER (PARTITION BY phrase) < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM late),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text
         FROM (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM w) ANTI JOIN gone USING (doc_id, p)
         GROUP BY doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id)"""


@query(_SUBSTRING_SQL)
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = stage(substrings.find_repeats(docs), "repeats")
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["from"])
    found = found.withColumn("n_removed", gone)
    part = substrings.kept_words(docs, found.where("n_removed < n_words")).dropDuplicates(["doc_id", "text_key"])
    left = part.select("doc_id", "text_key", F.sha2("text", 256).alias("left"))
    none = F.sha2(F.lit(""), 256)
    return found.join(left, ["doc_id", "text_key"], "left").select(
        "doc_id",
        "n_words",
        "n_removed",
        F.when(F.col("n_removed") == 0, F.col("sha256")).otherwise(F.coalesce("left", none)).alias("kept_sha256"),
    )


@query()
def op10_entropy_balanced_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.with_copies(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


#: Conversation -1, in another layout than the rows of the table.
_ODD_CHAT = json.dumps({"messages": [{"role": r, "content": "</s>[INST] ok [/INST]"} for r in ("user", "assistant")]})

_CHAT_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
           UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
c AS (SELECT *, length(role) + length(text) + length(role || text) - length(replace(role || text, '\', ''))
             + length(role) - length(replace(role, chr(10), ''))
             + 2 * (length(regexp_replace(text, '(<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>|</?s>|\[/?INST\]|<</?SYS>>)', '\1#', 'g')) - length(text))
             + 2 * (length(regexp_replace(role, '(<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>|</?s>|\[/?INST\]|<</?SYS>>)', '\1#', 'g')) - length(role))
             + length('<|im_start|>') + 1 + length('<|im_end|>') AS chars FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id"""


@query(_CHAT_SQL)
def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.turn_records(table(spark, sf_dir, "conversations"))
    odd = local_table(spark, [(-1, 0, _ODD_CHAT)], "conv_id long, turn long, record string")
    return chat.read_back(chat.in_order(chat.segments(rows.unionByName(odd))))


_REPAIR_SQL = r"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
             list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)),
             lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0],
                 lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)))) % 20 AS d
  FROM conversations),
dam AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
               CASE d WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
               unnest(CASE WHEN d = 3 THEN [0, 1] ELSE [0] END) AS copy FROM k WHERE d <> 0),
o AS (SELECT conv_id, turn, role, text, left(role, 1) AS r,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i,
             row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS seen,
             NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS nothing,
             NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS breaks FROM dam),
f AS (SELECT conv_id, turn, role, text, r, i, nothing, seen AND NOT nothing AS twice, breaks AND NOT nothing AND NOT seen AS cut,
             lag(r) OVER (PARTITION BY conv_id ORDER BY i) || r AS pair FROM o),
figures AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE nothing) AS blank,
                   count(*) FILTER (WHERE twice) AS duplicate, count(*) FILTER (WHERE cut) AS truncated,
                   count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
edits(s, r, letter, t, cost) AS (VALUES (0, NULL, 'D', 0, 2), (1, NULL, 'D', 1, 2), (2, NULL, 'D', 2, 2), (3, NULL, 'D', 3, 2),
    (0, 's', 'K', 1, 0), (0, 'u', 'K', 2, 0), (1, 'u', 'K', 2, 0), (2, 'a', 'K', 3, 0), (3, 'u', 'K', 2, 0),
    (0, NULL, 'R', 2, 1), (1, NULL, 'R', 2, 1), (2, NULL, 'R', 3, 1), (3, NULL, 'R', 2, 1)),
inserts(t, u, letters, cost) AS (VALUES (0, 0, '', 0), (1, 1, '', 0), (2, 2, '', 0), (3, 3, '', 0),
    (0, 2, 'I', 5), (1, 2, 'I', 5), (2, 3, 'I', 5), (3, 2, 'I', 5), (0, 3, 'II', 10), (1, 3, 'II', 10)),
ways AS (
  SELECT conv_id, 0::BIGINT AS i, u AS s, lpad(cost::VARCHAR, 9, '0') || letters AS best FROM figures, inserts WHERE t = 0
  UNION ALL
  SELECT w.conv_id, w.i + 1, n.u, min(lpad((left(best, 9)::INT + e.cost + n.cost + CASE WHEN cut AND letter <> 'D' THEN 5 ELSE 0 END)::VARCHAR, 9, '0')
                                      || substr(best, 10) || letter || letters)
  FROM ways w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1
  JOIN edits e ON e.s = w.s AND (e.r IS NULL OR e.r = f.r) AND (letter = 'D' OR NOT (nothing OR twice)) JOIN inserts n ON n.t = e.t
  GROUP BY w.conv_id, w.i + 1, n.u),
found AS (SELECT g.conv_id, min(best) AS best FROM ways w JOIN figures g ON g.conv_id IS NOT DISTINCT FROM w.conv_id AND g.n = w.i
          WHERE s IN (0, 3) GROUP BY g.conv_id),
steps AS (SELECT conv_id, q, substr(best, 9 + q::INT, 1) AS letter FROM (SELECT *, unnest(range(1, length(best) - 8)) AS q FROM found)),
put AS (SELECT *, sum((letter <> 'I')::INT) OVER (PARTITION BY conv_id ORDER BY q) AS i,
               sum((letter <> 'D')::INT) OVER (PARTITION BY conv_id ORDER BY q) AS place FROM steps),
kept AS (SELECT p.conv_id, letter, place, f.role, CASE WHEN letter = 'I' THEN '' ELSE f.text END AS text,
                max((place = 1 AND letter = 'K' AND f.r = 's')::INT) OVER (PARTITION BY p.conv_id) AS opens
         FROM put p LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i AND letter <> 'I' WHERE letter <> 'D'),
lines AS (SELECT conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (place - opens) % 2 = 1 THEN 'user' ELSE 'assistant' END
                                            || ':' || text, chr(10) ORDER BY place)) AS sha FROM kept GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(left(best, 9)::BIGINT, 0) AS cost,
       coalesce(substr(best, 10), '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN figures g ON g.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN found b ON b.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN lines l ON l.conv_id IS NOT DISTINCT FROM c.conv_id"""


@query(_REPAIR_SQL)
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    damaged = repair.damage(rows)
    return repair.digests(damaged, repair.audits(damaged, ids=rows))


@query()
def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.fixed_point(table(spark, sf_dir, "embeddings"), "embedding")
    return whitening.whiten(rows, "embedding", "vec_id", k=8)
