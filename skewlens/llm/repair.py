"""Repair of conversation structure: the cheapest edits that make the roles alternate.

Rows of a conversation are kept (0), given the role that is due (1) or deleted (2), and
rows without text can be inserted (5); a row that is kept or reroled although its text
breaks off adds 5, and blank or repeated rows must go. The result's role initials are
empty, or an optional ``s`` followed by pairs ``ua``.

Edits are arcs of a lattice of (rows read, state of the pattern). Its shortest paths are
found by the auction algorithm: a path grows from a start node along arcs that are tight
under the node prices, and where none is tight the price of its last node rises and the
path shrinks by that node. Starts are taken block by block from the end of the conversation
back, with prices of later blocks kept, so the work grows with the length of the
conversation. When a path reaches the end, every arc of every cheapest path is tight; the
audit follows the tight arcs, least letter first.

Conversations are read as sorted streams, twice: first the flags, digests and turns of the
rows (a few dozen bytes each), then roles and texts beside the audit found. No task holds
the texts of a conversation.

Defined cases: null roles and texts are one space; null turns come first; rows of equal
turn follow by role and digest of the text; a role of another or no initial can only be
reroled or deleted; a null conversation id is one conversation; an id without rows gives
zeros and an empty audit; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Costs of the edits, and of a broken-off text that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Rows between two sets of start nodes.
BLOCK = 8
#: Solved conversations a task remembers, and rows a remembered one may have.
REMEMBERED, REMEMBERED_ROWS = 50_000, 64

#: Row codes: role (0 system, 1 user, 2 assistant, 3 other) and flags.
SYSTEM, USER, ASSISTANT, OTHER = range(4)
GOES, BREAKS = 4, 8
#: Pattern states: start, after s, after u, after a. What each role leads to, and the role due.
AFTER = ({SYSTEM: 1, USER: 2}, {USER: 2}, {ASSISTANT: 3}, {USER: 2})
DUE = (USER, USER, ASSISTANT, USER)
FINAL = (0, 3)
NAMES = ("system", "user", "assistant")

SPACE = r"\x20\x09-\x0D"


def arcs(codes: bytes, node: int) -> list[tuple[str, int, int]]:
    """``(letter, cost, next node)`` of a node ``4 * rows read + state``, by letter; the
    end of the lattice is node ``4 * len(codes) + 4``."""
    read, state = divmod(node, 4)
    due = DUE[state]
    insert = ("I", INSERT, 4 * read + AFTER[state][due])
    if read == len(codes):
        return [insert, ("", 0, 4 * read + 4)] if state in FINAL else [insert]
    code, after = codes[read], 4 * read + 4
    out = [("D", DELETE, after + state), insert]
    if not code & GOES:
        extra = TRUNCATED if code & BREAKS else 0
        role = code & 3
        if role in AFTER[state]:
            out.append(("K", extra, after + AFTER[state][role]))
        if role != due:
            out.append(("R", REROLE + extra, after + AFTER[state][due]))
    return out


def auction(codes: bytes) -> list[int]:
    """Node prices at which every arc of every cheapest path from node 0 is tight.

    ``price[i] <= cost + price[j]`` holds for all arcs throughout; the price of a start is
    its exact distance once its path meets a later start or the end.
    """
    n = len(codes)
    end = 4 * n + 4
    price = [0] * (end + 1)
    known = {}

    def out(node):
        if node not in known:
            known[node] = arcs(codes, node)
        return known[node]

    above = n + 1  # layers from here on are settled, or lie beyond the end
    while above > 0:
        below = max(0, above - (BLOCK if above <= n else BLOCK + 1))
        goal = 4 * above
        if above <= n:
            level = min(price[goal : goal + 4])
            price[4 * below : goal] = [level] * (goal - 4 * below)
        known.clear()
        for start in range(4 * below, 4 * below + 4):
            path = [start]
            while path[-1] < goal:
                last = path[-1]
                best, to = None, None
                for _, cost, j in out(last):
                    if best is None or cost + price[j] < best:
                        best, to = cost + price[j], j
                if price[last] < best:  # contract
                    price[last] = best
                    if len(path) > 1:
                        path.pop()
                else:  # extend
                    path.append(to)
        above = below
    return price


def cheapest(codes: bytes) -> tuple[int, str]:
    """Least cost, and of the cheapest edits the letters that come first in ASCII order."""
    price = auction(codes)
    n = len(codes)
    end = 4 * n + 4
    leads = bytearray(end + 1)  # has a chain of tight arcs to the end
    leads[end] = 1
    for read in range(n, -1, -1):
        for _ in range(3):  # arcs inside a layer form chains of at most three
            for node in range(4 * read, 4 * read + 4):
                if not leads[node]:
                    leads[node] = any(price[node] == c + price[j] and leads[j] for _, c, j in arcs(codes, node))
    node, letters = 0, []
    while node != end:
        letter, node = next((a, j) for a, c, j in arcs(codes, node) if price[node] == c + price[j] and leads[j])
        letters.append(letter)
    return price[0], "".join(letters)


def _solver():
    solved = {}

    def solve(codes: bytes):
        if len(codes) > REMEMBERED_ROWS:
            return cheapest(codes)
        if codes not in solved:
            if len(solved) >= REMEMBERED:
                solved.clear()
            solved[codes] = cheapest(codes)
        return solved[codes]

    return solve


def is_blank(text: Column) -> Column:
    return ~text.rlike(f"[^{SPACE}]")


def breaks_off(text: Column) -> Column:
    """The last character that is no white space is not one of ``.!?``."""
    return ~text.rlike(rf"[.!?][{SPACE}]*\z")


def _rows(rows: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """``(_key, _turn, _role, _text, _digest)`` without nulls in role and text."""
    role_, text_ = F.coalesce(F.col(role), F.lit(" ")), F.coalesce(F.col(text), F.lit(" "))
    return rows.select(
        F.col(key).alias("_key"),
        F.col(turn).cast("long").alias("_turn"),
        role_.alias("_role"),
        text_.alias("_text"),
        F.unhex(F.md5(text_)).alias("_digest"),
    )


def _sorted(rows: DataFrame) -> DataFrame:
    by = [F.col("_key"), "_kind", F.col("_turn").asc_nulls_first(), "_role", "_digest"]
    return rows.repartition(F.col("_key")).sortWithinPartitions(*by)


FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def audits(
    rows: DataFrame,
    key: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    ids: DataFrame | None = None,
) -> DataFrame:
    """``(key, gaps, blank, duplicate, truncated, illegal, cost, audit)`` of every
    conversation, those of ``ids`` (a column of the same name) included that have no rows.
    Every row counts for its first fault only."""
    initial = F.substring("_role", 1, 1)
    code = F.lit(OTHER)
    for i, name in enumerate(NAMES):
        code = F.when(initial == name[0], F.lit(i)).otherwise(code)
    found = _rows(rows, key, turn, role, text).select(
        "_key",
        F.lit(1).cast("tinyint").alias("_kind"),
        "_turn",
        "_role",
        "_digest",
        F.unhex(F.md5(F.concat(F.md5("_role"), F.hex("_digest")))).alias("_same"),
        code.cast("tinyint").alias("_code"),
        is_blank(F.col("_text")).alias("_blank"),
        breaks_off(F.col("_text")).alias("_breaks"),
    )
    if ids is not None:
        every = ids.select(F.col(key).alias("_key")).distinct().withColumn("_kind", F.lit(0).cast("tinyint"))
        found = every.unionByName(found, allowMissingColumns=True)
    schema = T.StructType([T.StructField(key, found.schema["_key"].dataType)])
    for name in FIGURES:
        schema = schema.add(name, "long")
    schema = schema.add("audit", "string")
    arrow = to_arrow_schema(schema)

    def audited(batches):
        solve, done = _solver(), []
        current, open_ = None, None

        def close():
            turns, same, codes, blank = open_
            n = len(codes)
            codes = np.frombuffer(bytes(codes), np.uint8)
            blank = np.frombuffer(bytes(blank), bool)
            pairs = np.frombuffer(bytes(same), "V16")
            repeated = np.ones(n, bool)
            repeated[np.unique(pairs, return_index=True)[1]] = False
            twice = repeated & ~blank
            breaks = ((codes & BREAKS) > 0) & ~blank & ~twice
            roles = codes & 3
            left, right = roles[:-1], roles[1:]
            legal = ((left == SYSTEM) & (right == USER)) | ((left == USER) & (right == ASSISTANT)) | ((left == ASSISTANT) & (right == USER))
            coded = (roles | np.where(blank | twice, GOES, 0) | np.where(breaks, BREAKS, 0)).astype(np.uint8)
            at = np.frombuffer(turns, np.int64) if len(turns) else np.empty(0, np.int64)
            gaps = int(at.max()) - int(at.min()) + 1 - len(np.unique(at)) if len(at) else 0
            cost, audit = solve(coded.tobytes())
            figures = (gaps, int(blank.sum()), int(twice.sum()), int(breaks.sum()), int((~legal).sum()) if n > 1 else 0, cost)
            done.append((current, *figures, audit))

        def table():
            out = [pa.array([d[c] for d in done], arrow.field(c).type) for c in range(len(arrow))]
            done.clear()
            return pa.RecordBatch.from_arrays(out, schema=arrow)

        for batch in batches:
            for name, kind, at, same, code_, blank, breaks in zip(*(c.to_pylist() for c in batch.columns)):
                if open_ is None or name != current:
                    if open_ is not None:
                        close()
                    current, open_ = name, (array("q"), bytearray(), bytearray(), bytearray())
                if kind:
                    if at is not None:
                        open_[0].append(at)
                    open_[1].extend(same)
                    open_[2].append(code_ | (BREAKS if breaks else 0))
                    open_[3].append(blank)
            yield table()
        if open_ is not None:
            close()
            yield table()

    return _sorted(found).select("_key", "_kind", "_turn", "_same", "_code", "_blank", "_breaks").mapInArrow(audited, schema)


def _apply(rows: DataFrame, found: DataFrame, names: tuple, schema: T.StructType, make) -> DataFrame:
    """Stream the rows of every conversation past its audit. ``make`` gives an object with
    ``open(audit row)``, ``put(role, text, letter)`` and ``close()`` whose outcome rows come
    out of ``take()``."""
    key, turn, role, text = names
    info = [c for c in found.columns if c != key]
    heads = found.select(F.col(key).alias("_key"), F.lit(0).cast("tinyint").alias("_kind"), F.struct(*info).alias("_info"))
    body = _rows(rows, key, turn, role, text).withColumn("_kind", F.lit(1).cast("tinyint"))
    both = _sorted(heads.unionByName(body, allowMissingColumns=True)).select("_key", "_kind", "_info", "_role", "_text")
    arrow = to_arrow_schema(schema)

    def applied(batches):
        sink, audit, at, state, is_open = make(), "", 0, 0, False

        def inserts():
            nonlocal at, state
            while at < len(audit) and audit[at] == "I":
                due = DUE[state]
                sink.put(NAMES[due], "", "I")
                at, state = at + 1, AFTER[state][due]

        def table():
            made = sink.take()
            return pa.RecordBatch.from_arrays(
                [pa.array([m[c] for m in made], arrow.field(c).type) for c in range(len(arrow))], schema=arrow
            )

        for batch in batches:
            for name, kind, head, role_, text_ in zip(*(c.to_pylist() for c in batch.columns)):
                if not kind:
                    if is_open:
                        inserts()
                        sink.close()
                    sink.open(name, head)
                    audit, at, state, is_open = head["audit"], 0, 0, True
                    continue
                inserts()
                letter, at = audit[at], at + 1
                if letter == "D":
                    continue
                if letter == "R":
                    role_, state = NAMES[DUE[state]], AFTER[state][DUE[state]]
                else:
                    state = AFTER[state]["sua".index(role_[0])]
                sink.put(role_, text_, letter)
            yield table()
        if is_open:
            inserts()
            sink.close()
            yield table()

    return both.mapInArrow(applied, schema)


def repaired_rows(
    rows: DataFrame, found: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """``(key, place, role, text, edit)``: the repaired conversations, by the audits found."""
    schema = (
        T.StructType([found.schema[key]]).add("place", "long").add("role", "string").add("text", "string").add("edit", "string")
    )

    def make():
        class Sink:
            def __init__(self):
                self.rows = []

            def open(self, name, head):
                self.name, self.place = name, 0

            def put(self, role, text, letter):
                self.rows.append((self.name, self.place, role, text, letter))
                self.place += 1

            def close(self):
                pass

            def take(self):
                rows, self.rows = self.rows, []
                return rows

        return Sink()

    return _apply(rows, found, (key, turn, role, text), schema, make)


def digests(
    rows: DataFrame, found: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """The audits with ``repaired_sha256``: the repaired rows as ``role:text`` lines."""
    schema = T.StructType([found.schema[key]])
    names = [f.name for f in found.schema if f.name != key]
    for name in names:
        schema = schema.add(found.schema[name])
    schema = schema.add("repaired_sha256", "string")

    def make():
        class Sink:
            def __init__(self):
                self.rows = []

            def open(self, name, head):
                self.row = (name, *(head[c] for c in names))
                self.hash, self.first = hashlib.sha256(), True

            def put(self, role, text, letter):
                line = f"{role}:{text}" if self.first else f"\n{role}:{text}"
                self.first = False
                self.hash.update(line.encode("utf-8", "surrogatepass"))

            def close(self):
                self.rows.append((*self.row, self.hash.hexdigest()))

            def take(self):
                rows, self.rows = self.rows, []
                return rows

        return Sink()

    return _apply(rows, found, (key, turn, role, text), schema, make)


def damage(rows: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text)`` with faults planted by ``crc32('conv_id:turn') % 20``:
    0 drops a row, 1 empties its text, 2 takes its ``.!?``, 3 repeats it, 4 makes it a
    user's. Nulls are one space."""
    space = F.lit(" ")
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")])
    kind = F.crc32(name) % 20
    text = F.coalesce("text", space)
    said = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(text, ".!?", "")).otherwise(text)
    return (
        rows.where(kind != 0)
        .select(
            "conv_id",
            "turn",
            F.when(kind == 4, F.lit("user")).otherwise(F.coalesce("role", space)).alias("role"),
            said.alias("text"),
            F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
        )
        .drop("_copy")
    )
