"""Words of Arrow text columns as arrays: bounds, hashes and lookups without a Python loop.

A word is a maximal run of characters other than space and U+0009 to U+000D. All of these
are single UTF-8 bytes, so words are found on the bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Java pattern of the white space that separates words, and of the words.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes handled at once: the arrays of one block stay in the processor's cache.
BLOCK = 1 << 18
_STEP = 0x9E3779B97F4A7C15 | 5


def space_bytes() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[9, 10, 11, 12, 13, 32]] = True
    return table


def punctuation_bytes() -> np.ndarray:
    """White space and all ASCII that is neither letter nor digit: words without their marks."""
    table = np.zeros(256, bool)
    table[:128] = [not chr(c).isalnum() for c in range(128)]
    return table


class Words:
    """Words of the documents of one block.

    ``starts``/``ends``: byte bounds of each word in ``data``. ``of``: index of the first
    word of each document, and the number of words at the end.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, between: np.ndarray | None = None):
        self.data, self.offsets = data, offsets
        self.docs = len(offsets) - 1
        if not len(data):
            self.starts = self.ends = np.zeros(0, np.int64)
            self.of = np.zeros(self.docs + 1, np.int64)
            return
        blank = (space_bytes() if between is None else between)[data]
        edge = np.zeros(len(data) + 1, bool)  # a document begins here
        edge[offsets] = True
        first = ~blank
        first[1:] &= blank[:-1] | edge[1:-1]
        last = ~blank
        last[:-1] &= blank[1:] | edge[1:-1]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.of = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.of)

    def doc(self) -> np.ndarray:
        """Document of each word."""
        return np.repeat(np.arange(self.docs), self.counts())


class Hasher:
    """64-bit word hashes: a polynomial over random values of the bytes, then mixed.

    ``lower`` takes A-Z as a-z. Equal words have equal hashes in every process.
    """

    def __init__(self, lower: bool = False, seed: int = 42, between: np.ndarray | None = None):
        self.table = np.random.default_rng(seed).integers(0, 2**64, 256, np.uint64)
        if lower:
            self.table[65:91] = self.table[97:123]
        self.table[space_bytes() if between is None else between] = 0
        self.size = 0

    def _powers(self, n: int) -> None:
        if n > self.size:
            self.size = max(n, BLOCK)
            with np.errstate(over="ignore"):
                for name, base in (("up", _STEP), ("down", pow(_STEP, -1, 2**64))):
                    steps = np.full(self.size, base, np.uint64)
                    steps[0] = 1
                    setattr(self, name, np.multiply.accumulate(steps))

    def __call__(self, words: Words) -> np.ndarray:
        if not len(words):
            return np.zeros(0, np.uint64)
        n = len(words.data)
        self._powers(n)
        values = self.table[words.data]
        values *= self.up[:n]
        hashes = np.add.reduceat(values, words.starts)
        hashes *= self.down[words.starts]
        return mixed(hashes)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (in place)."""
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def rolled(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive hashes; shorter by ``width - 1``.

    Sums over blocks of doubling length, so the cost is the logarithm of the width.
    """
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total, covered = None, 0
    power, length, step = h, 1, _STEP
    left = width
    while left:
        if left & 1:
            part = power[covered : covered + n]
            factor = np.uint64(pow(_STEP, covered, 2**64))
            total = part * factor if total is None else total + part * factor
            covered += length
        left >>= 1
        if left:
            power = power[: len(power) - length] + power[length:] * np.uint64(step)
            step = step * step % 2**64
            length *= 2
    return mixed(total.copy() if total is h else total)


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, bounds, data = column.buffers()
    offsets = np.frombuffer(bounds, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets


def blocks(column: pa.Array, size: int = BLOCK, between: np.ndarray | None = None):
    """``(first row, end row, Words)`` of consecutive rows of about ``size`` bytes."""
    raw, offsets = texts(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        end = min(end, rows)
        yield row, end, Words(raw[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row], between)
        row = end


def summed(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over the words of each document (0 without words)."""
    running = np.zeros(len(values) + 1, values.dtype if values.dtype.kind in "iu" else np.float64)
    np.cumsum(values, out=running[1:])
    return running[of[1:]] - running[of[:-1]]


class Index:
    """Positions of hashes among sorted hashes, found by their leading bits.

    Hashes spread evenly, so a few comparisons settle each, however many there are.
    """

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = max(4, int(len(keys)).bit_length() + 2)
        self.shift = np.uint64(64 - bits)
        edges = np.arange(1 << bits, dtype=np.uint64) << self.shift
        self.first = np.append(np.searchsorted(keys, edges), len(keys)).astype(np.int32)

    def __call__(self, wanted: np.ndarray) -> np.ndarray:
        """Position of each, -1 where it is missing."""
        slot = (wanted >> self.shift).astype(np.int64)
        at, end = self.first[slot], self.first[slot + 1]
        out = np.full(len(wanted), -1, np.int64)
        left = np.flatnonzero(at < end)
        at, end, wanted = at[left], end[left], wanted[left]
        while len(left):
            hit = self.keys[at] == wanted
            out[left[hit]] = at[hit]
            at = at + 1
            more = ~hit & (at < end)
            left, at, end, wanted = left[more], at[more], end[more], wanted[more]
        return out


def lookup(sorted_keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Position of each wanted key among the sorted keys, -1 where it is missing."""
    if not len(sorted_keys):
        return np.full(len(wanted), -1, np.int64)
    at = np.searchsorted(sorted_keys, wanted)
    at[at == len(sorted_keys)] = 0
    return np.where(sorted_keys[at] == wanted, at, -1)


def fresh(df, *names: str) -> list[str]:
    """The names, with underscores before them until no column of ``df`` is called so in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def mapped(df, keep: list[str], new: str, make, text: str = "text"):
    """Columns ``keep`` of ``df`` and the columns ``new`` (DDL) made from the texts by Arrow batches.

    ``make()`` is called once per task and returns a function from the text column (null:
    empty) to one array per new column. Kept columns that clash with a new one are dropped.
    """
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    fields = T.StructType.fromDDL(new).fields
    added = [f.name for f in fields]
    kept = [c for c in keep if c not in added]
    source = df.select(*kept)
    carried = text in kept and isinstance(source.schema[text].dataType, T.StringType)
    if not carried:
        source = df.select(*kept, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    schema = T.StructType([*df.select(*kept).schema.fields, *fields])
    names, width, at = [f.name for f in schema.fields], len(kept), kept.index(text) if carried else len(kept)

    def run(batches):
        of_texts = make()
        for batch in batches:
            texts = pc.fill_null(batch.column(at), "")
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *of_texts(texts)], names=names)

    return source.mapInArrow(run, schema)
