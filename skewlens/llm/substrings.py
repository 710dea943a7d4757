"""Removal of long passages that an earlier document already holds.

A window is 50 consecutive words. Every window picks its anchor by content: the 16-word
phrase with the smallest hash in it, so equal windows share their anchor wherever they
stand. Phrases met in several documents are confirmed as text and compiled into
Aho-Corasick automata, sharded by the first document that holds them; the documents that
share a phrase stream through the automata of its shard, which locate every occurrence.
Windows around located phrases are then compared whole, by their anchor and a second hash:
first among the documents of one stream, so that of each window only a stream's earliest
document is left to be compared with those of other streams.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skewlens.llm.words import Hasher, Words, blocks, mapped, rolled
from skewlens.session import stage

WINDOW = 50
PHRASE = 16
#: Phrases of one automaton: about 100 letters each.
SHARD_PHRASES = 4000
#: Bytes of text that stream through one copy of an automaton.
STREAM_BYTES = 16 << 20
_TOP = np.uint64(2**64 - 1)
_FOUND = ["anchor", "hash", "covered", "doc_id", "text_key", "at"]
_NOTHING = pa.schema(list(zip(_FOUND, [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int32())])))


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (np.minimum or np.maximum) over every run of ``width`` values."""
    length = 1
    while 2 * length <= width:
        values = pick(values[: len(values) - length], values[length:])
        length *= 2
    rest = width - length
    return pick(values[: len(values) - rest], values[rest:]) if rest else values


def window_anchors(hashes: np.ndarray, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray]:
    """Phrase hashes, and the anchor hash of every window (empty if there is none)."""
    phrases = rolled(hashes, phrase)
    width = window - phrase + 1
    if len(phrases) < width:
        return phrases, np.zeros(0, np.uint64)
    return phrases, sliding(phrases, width, np.minimum)


def _anchors(words: Words, hashes: np.ndarray, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchor hashes of the documents of a block, and where each document's begin."""
    phrases, least = window_anchors(hashes, window, phrase)
    if not len(least):
        return np.zeros(0, np.uint64), np.zeros(words.docs + 1, np.int64)
    # a window that crosses into the next document picks none
    ends = np.repeat(words.of[1:], words.counts())
    picks = np.where(np.arange(len(least)) + window <= ends[: len(least)], least, np.uint64(0))
    width = window - phrase + 1
    edge = np.zeros(width - 1, np.uint64)
    chosen = sliding(np.concatenate((edge, picks, edge)), width, np.maximum) == phrases
    at = np.flatnonzero(chosen)
    return phrases[at], np.searchsorted(at, words.of)


def _signatures(docs: DataFrame, window: int, phrase: int) -> DataFrame:
    """``(doc_id, text_key, n_words, sha256, anchors)`` of every row."""

    def make():
        hasher = Hasher()

        def of_texts(column):
            counts, digests, anchors, sizes = [], [], [], []
            for _, _, words in blocks(column):
                found, first = _anchors(words, hasher(words), window, phrase)
                counts.append(words.counts())
                anchors.append(found)
                sizes.append(np.diff(first))
                raw = words.data.tobytes()
                bounds = words.offsets.tolist()
                for a, b in zip(bounds, bounds[1:]):
                    digests.append(hashlib.sha256(b" ".join(raw[a:b].split())).hexdigest())
            join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
            offsets = np.concatenate(([0], np.cumsum(join(sizes, np.int64)))).astype(np.int32)
            values = pa.array(join(anchors, np.uint64).view(np.int64))
            return [
                pa.array(join(counts, np.int64)),
                pa.array(digests, pa.string()),
                pa.ListArray.from_arrays(pa.array(offsets), values),
            ]

        return of_texts

    ddl = "n_words long, sha256 string, anchors array<long>"
    return mapped(docs, ["doc_id", "text_key"], ddl, make)


def _phrases(owners: DataFrame, phrase: int) -> DataFrame:
    """Text of the phrases that first stand in these documents: ``(shard, phrase)``."""

    def cut(batches):
        hasher = Hasher()
        for batch in batches:
            shards, found = [], []
            for shard, owned, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                raw = b" ".join(text.encode().split())
                words = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                hashes = rolled(hasher(words), phrase).view(np.int64)
                _, first = np.unique(hashes, return_index=True)
                for at in first[np.isin(hashes[first], np.array(owned, np.int64))].tolist():
                    shards.append(shard)
                    found.append(raw[words.starts[at] : words.ends[at + phrase - 1]].decode())
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int64()), pa.array(found, pa.string())], names=["shard", "phrase"])

    return owners.select("shard", "owned", "text").mapInArrow(cut, "shard long, phrase string").distinct()


def _settled(anchor, hashes, doc_id, text_key, at) -> pa.Table:
    """Windows of one stream by what is known of them.

    A window that a smaller doc_id of the stream holds too is covered: one row a document,
    without anchor, lists these. Of the others one row a window and document is left.
    """
    order = np.lexsort((at, text_key, doc_id, hashes, anchor))
    anchor, hashes, doc_id, text_key, at = (x[order] for x in (anchor, hashes, doc_id, text_key, at))
    new = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (hashes[1:] != hashes[:-1]))))
    least = np.repeat(doc_id[new], np.diff(np.append(new, len(at))))  # sorted: the first is the smallest
    open_ = doc_id == least
    later = np.flatnonzero(~open_)
    later = later[np.lexsort((at[later], text_key[later], doc_id[later]))]
    rows = np.concatenate((np.flatnonzero(open_), later))
    covered = np.arange(len(rows)) >= len(rows) - len(later)
    keys = [np.where(covered, 0, anchor[rows]), np.where(covered, 0, hashes[rows]), covered, doc_id[rows], text_key[rows]]
    starts = np.flatnonzero(np.concatenate(([True], np.any([k[1:] != k[:-1] for k in keys], axis=0))))
    lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(rows)).astype(np.int32)), pa.array(at[rows], pa.int32()))
    return pa.Table.from_arrays([*(pa.array(k[starts]) for k in keys), lists], names=_FOUND)


def _locate(window: int, phrase: int):
    """Task: stream documents through one automaton; rows are the windows around what it finds."""

    def run(docs: pa.Table, phrases: pa.Table) -> pa.Table:
        parts = []
        listed = phrases["phrase"].to_pylist()
        if listed and docs.num_rows:
            automaton, hasher, width = ahocorasick.Automaton(), Hasher(), window - phrase + 1
            for p in listed:
                automaton.add_word(f" {p} ", len(p) + 2)
            automaton.make_automaton()
            columns = (docs[c].to_pylist() for c in ("doc_id", "text_key", "text"))
            for doc_id, text_key, text in zip(*columns):
                raw = b" ".join(text.encode().split())
                words = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                hashes = hasher(words)
                phrases_at, least = window_anchors(hashes, window, phrase)
                if not len(least):
                    continue
                stream = f" {raw.decode()} "
                starts = [end - size + 1 for end, size in automaton.iter(stream)]
                if not starts:
                    continue
                gaps = np.flatnonzero(np.frombuffer(stream.encode("utf-32-le"), np.uint32) == 32)
                met = np.full(len(phrases_at), _TOP)
                at = np.searchsorted(gaps, starts)
                met[at] = phrases_at[at]
                found = np.flatnonzero(sliding(met, width, np.minimum) == least)
                n = len(found)
                parts.append(
                    (
                        least[found].view(np.int64),
                        rolled(hashes, window)[found].view(np.int64),
                        np.full(n, doc_id),
                        np.full(n, text_key),
                        found.astype(np.int32),
                    )
                )
        if not sum(len(p[4]) for p in parts):
            return _NOTHING.empty_table()
        return _settled(*(np.concatenate([p[k] for p in parts]) for k in range(5)))

    return run


def _windows(routed: DataFrame, window: int, phrase: int) -> DataFrame:
    phrases = stage(_phrases(routed.where(F.size("owned") > 0), phrase), "phrases")
    streams = routed.groupBy("shard").agg(F.ceil(F.sum("size") / STREAM_BYTES).cast("long").alias("copies"))
    streams = stage(streams, "streams")
    dealt = routed.join(streams, "shard").select(
        "shard", F.pmod(F.xxhash64("doc_id"), F.col("copies")).alias("copy"), "doc_id", "text_key", "text"
    )
    compiled = phrases.join(streams, "shard").select(
        "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"), "phrase"
    )
    return (
        dealt.groupBy("shard", "copy")
        .cogroup(compiled.groupBy("shard", "copy"))
        .applyInArrow(
            _locate(window, phrase),
            "anchor long, hash long, covered boolean, doc_id long, text_key long, at array<int>",
        )
    )


def _sharded(shared: DataFrame, shards: int) -> DataFrame:
    """``(anchor, first, shard)``: phrases of one first document stay together, in as many
    shards as their number asks for."""
    crowded = shared.groupBy("first").agg(F.ceil(F.count("*") / SHARD_PHRASES).cast("long").alias("pieces"))
    piece = F.pmod("anchor", F.coalesce("pieces", F.lit(1).cast("long")))
    shard = F.pmod(F.xxhash64("first", piece), F.lit(shards)).cast("long")
    return shared.join(crowded.where("pieces > 1"), "first", "left").select("anchor", "first", shard.alias("shard"))


def _spans(window: int) -> Column:
    """Merged word spans ``[from, to)`` of sorted window starts."""
    starts = F.col("starts")
    gap = lambda x, i, step: F.coalesce(F.abs(F.get(starts, i + step) - x) > window, F.lit(True))
    heads = F.filter(starts, lambda x, i: gap(x, i, -1))
    tails = F.filter(starts, lambda x, i: gap(x, i, 1))
    return F.zip_with(
        heads, tails, lambda a, b: F.struct(a.cast("long").alias("from"), (b + window).cast("long").alias("to"))
    )


def find_repeats(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """``(doc_id, text_key, n_words, sha256, spans)`` for every row of ``docs``.

    ``spans`` are the words covered by a window that also starts in a document with a
    smaller doc_id; ``sha256`` is that of all words joined by one space and ``text_key`` a
    hash of the text, which tells rows with the same doc_id apart. Whole copies are settled
    by their digest, so a group of copies costs one document. A null text has no words; rows
    without a doc_id, and texts shorter than a window, have no spans and give none to
    others. An empty table gives an empty table.
    """
    keyed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"),
        "text",
    )
    signed = stage(_signatures(keyed, window, phrase), "signatures")
    long = signed.where((F.col("n_words") >= window) & F.col("doc_id").isNotNull())
    firsts = stage(long.groupBy("sha256").agg(F.min("doc_id").alias("first")), "first-copies")
    own = F.col("doc_id") == F.col("first")
    originals = long.join(firsts, "sha256").where(own).dropDuplicates(["doc_id", "sha256"])
    anchors = stage(originals.select("doc_id", "text_key", F.explode("anchors").alias("anchor")), "anchors")
    shared = anchors.groupBy("anchor").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    shared = stage(shared.where("first < last").select("anchor", "first"), "shared-phrases")
    shards = max(1, -(-shared.count() // SHARD_PHRASES))
    met = anchors.join(_sharded(shared, shards), "anchor")
    routes = met.groupBy("doc_id", "text_key", "shard").agg(
        F.collect_set(F.when(own, F.col("anchor"))).alias("owned")
    )
    routed = routes.join(keyed, ["doc_id", "text_key"])
    routed = stage(routed.select("shard", "doc_id", "text_key", "owned", F.octet_length("text").alias("size"), "text"), "routed")
    windows = stage(_windows(routed, window, phrase), "windows")
    left = windows.where("NOT covered")
    repeated = left.groupBy("anchor", "hash").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    repeated = repeated.where("first < last").select("anchor", "hash", "first")
    across = left.join(repeated, ["anchor", "hash"]).where(F.col("doc_id") > F.col("first"))
    covered = windows.where("covered").select("doc_id", "text_key", "at")
    covered = covered.unionByName(across.select("doc_id", "text_key", "at")).groupBy("doc_id", "text_key")
    covered = covered.agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("at")))).alias("starts"))
    covered = covered.select("doc_id", "text_key", _spans(window).alias("found"))
    whole = F.when(
        (F.col("doc_id") > F.col("first")), F.array(F.struct(F.lit(0).cast("long").alias("from"), F.col("n_words").alias("to")))
    )
    empty = F.array().cast("array<struct<from:bigint,to:bigint>>")
    return (
        signed.drop("anchors")
        .join(firsts, "sha256", "left")
        .join(covered, ["doc_id", "text_key"], "left")
        .select("doc_id", "text_key", "n_words", "sha256", F.coalesce(whole, "found", empty).alias("spans"))
    )


def kept_words(docs: DataFrame, repeats: DataFrame) -> DataFrame:
    """``(doc_id, text_key, text)``: what is left of the documents that have spans."""
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    touched = repeats.where(F.size("spans") > 0).select("doc_id", "text_key", "spans").dropDuplicates(["doc_id", "text_key"])
    met = texts.join(touched, ["doc_id", "text_key"])

    def cut(batches):
        for batch in batches:
            left = []
            for spans, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                words, kept, at = text.encode().split(), [], 0
                for span in spans:
                    kept += words[at : span["from"]]
                    at = span["to"]
                left.append(b" ".join(kept + words[at:]).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(left, pa.string())], names=["doc_id", "text_key", "text"])

    return met.select("doc_id", "text_key", "spans", "text").mapInArrow(cut, "doc_id long, text_key long, text string")
