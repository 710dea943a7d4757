"""Chat formatting: records of many layouts become one marked text per conversation.

A record is a JSON object. The set of its nested field paths (lists as ``[]``), as far as
any mapping knows them, is hashed; the hash selects one of the declared mappings, which
says where the turns and their roles stand. Each canonical turn becomes a segment: start
mark, role, line break, escaped text, end mark. The segments of a conversation in order are
its formatted text, and the text of an assistant's turn is under the loss mask.

Segments are made turn by turn before anything moves, and only they are shuffled; a
conversation is read back as a stream, so neither a long one nor its texts are ever held.

Defined cases: a null text or role is empty; roles and texts may hold any control string;
turns of equal order follow by role and text; a null conversation id is one conversation of
its own; repeated rows are repeated turns; a record that is no JSON object, or whose paths
fit no mapping, gives no turns and shows up in :func:`layouts`; an empty table gives no
rows. Columns beyond key, order and record are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


@dataclass(frozen=True)
class One:
    """A turn of a fixed role whose text stands under one or more paths (joined by a line
    break where several hold text)."""

    role: str
    paths: tuple[str, ...]


@dataclass(frozen=True)
class Each:
    """A turn per element of a list; an empty list path is the record itself."""

    items: str
    role: str
    text: str
    roles: dict = field(default_factory=dict, hash=False)


@dataclass(frozen=True)
class Mapping:
    """A layout: paths a record must have, and where its turns stand, in order."""

    name: str
    needs: tuple[str, ...]
    turns: tuple


#: Names of the speakers in shared chats, fixed values.
SPEAKERS = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}

#: Known layouts; of those that fit, the first holds.
MAPPINGS = (
    Mapping("turn row", ("role", "text", "turn"), (Each("", "role", "text"),)),
    Mapping(
        "messages in parts",
        ("messages[].role", "messages[].content[].text"),
        (Each("messages[]", "role", "content"),),
    ),
    Mapping("messages", ("messages[].role", "messages[].content"), (Each("messages[]", "role", "content"),)),
    Mapping(
        "shared chat",
        ("conversations[].from", "conversations[].value"),
        (One("system", ("system",)), Each("conversations[]", "from", "value", SPEAKERS)),
    ),
    Mapping(
        "instruction",
        ("instruction", "output"),
        (One("system", ("system",)), One("user", ("instruction", "input")), One("assistant", ("output",))),
    ),
    Mapping(
        "instruction and response",
        ("instruction", "response"),
        (One("system", ("system",)), One("user", ("instruction", "context")), One("assistant", ("response",))),
    ),
    Mapping(
        "prompt and completion",
        ("prompt", "completion"),
        (One("system", ("system",)), One("user", ("prompt",)), One("assistant", ("completion",))),
    ),
    Mapping(
        "prompt and response",
        ("prompt", "response"),
        (One("system", ("system",)), One("user", ("prompt",)), One("assistant", ("response",))),
    ),
    Mapping(
        "question and answer",
        ("question", "answer"),
        (One("user", ("context", "question")), One("assistant", ("answer",))),
    ),
)

#: Marks of the template.
START, END = "<|im_start|>", "<|im_end|>"
#: Strings that mean something to chat templates and never stand in a formatted text
#: except as its own marks. Fixed values.
CONTROL = (START, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
LOSS_ROLE = "assistant"

_CONTROL_START = re.compile("(?=" + "|".join(re.escape(c) for c in CONTROL) + ")(.)", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_ORIGINAL = {"\\": "\\", "|": "", "n": "\n"}


def escape(text: str) -> str:
    """Backslashes doubled, and ``\\|`` after the first character of every control string."""
    return _CONTROL_START.sub(r"\1\\|", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    if "\\" not in text:
        return text
    return _ESCAPED.sub(lambda m: _ORIGINAL[m[1]], text)


def segment(role: str, text: str) -> tuple[str, int, int]:
    """Formatted turn, and where its text starts and ends in it."""
    head = START + escape(role).replace("\n", "\\n") + "\n"
    body = escape(text)
    return head + body + END, len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Turns of a formatted text, whole conversation or segment."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise ValueError("no start mark where a turn begins")
        line = formatted.index("\n", at)
        end = formatted.index(END, line)
        turns.append((unescape(formatted[at + len(START) : line]), unescape(formatted[line + 1 : end])))
        at = end + len(END)
    return turns


def field_paths(value, prefix: str = "") -> set[str]:
    """Paths of all nested fields of a JSON value."""
    found, todo = set(), [(prefix, value)]
    while todo:
        path, value = todo.pop()
        if path:
            found.add(path)
        if isinstance(value, dict):
            todo += [(f"{path}.{k}" if path else k, v) for k, v in value.items()]
        elif isinstance(value, list):
            found.add(path + "[]")
            todo += [(path + "[]", v) for v in value]
    return found


def fingerprint(paths: set[str]) -> str:
    """Hash of a set of field paths, in 16 hexadecimal digits."""
    return hashlib.blake2b("\n".join(sorted(paths)).encode(), digest_size=8).hexdigest()


def _known_paths(mappings) -> set[str]:
    known = set()
    for mapping in mappings:
        known.update(mapping.needs)
        for turn in mapping.turns:
            if isinstance(turn, One):
                known.update(turn.paths)
    return known


def select(paths: set[str], mappings=MAPPINGS) -> Mapping | None:
    return next((m for m in mappings if paths.issuperset(m.needs)), None)


def _text(value) -> str:
    """Text of a JSON value: parts of a list joined, the text of an object that has one,
    nothing for null."""
    if value is None:
        return ""
    if isinstance(value, str):
        return value
    if isinstance(value, list):
        return "".join(_text(v) for v in value)
    if isinstance(value, dict) and "text" in value:
        return _text(value["text"])
    return json.dumps(value, ensure_ascii=False)


def turns_of(record: dict, mapping: Mapping) -> list[tuple[str, str]]:
    """Canonical turns of a record, as its mapping declares them."""
    turns = []
    for source in mapping.turns:
        if isinstance(source, One):
            texts = [t for t in (_text(record.get(p)) for p in source.paths) if t]
            if texts or any(p in mapping.needs for p in source.paths):
                turns.append((source.role, "\n".join(texts)))
            continue
        items = record[source.items[:-2]] if source.items else [record]
        for item in items:
            if isinstance(item, dict):
                role = _text(item.get(source.role))
                turns.append((source.roles.get(role, role), _text(item.get(source.text))))
    return turns


def _reader(mappings):
    """A function from the JSON text of a record to (fingerprint, layout, turns); mappings
    are looked up by fingerprint, each once in a task."""
    known, chosen = _known_paths(mappings), {}

    def read(text):
        try:
            record = json.loads(text) if text is not None else None
        except ValueError:
            record = None
        if not isinstance(record, dict):
            return None, None, []
        paths = field_paths(record) & known
        print_ = fingerprint(paths)
        if print_ not in chosen:
            chosen[print_] = select(paths, mappings)
        mapping = chosen[print_]
        return print_, mapping and mapping.name, turns_of(record, mapping) if mapping else []

    return read


def layouts(records: DataFrame, record: str = "record", mappings=MAPPINGS) -> DataFrame:
    """``(fingerprint, layout, records, turns)``: how often each fingerprint occurs and the
    layout it selects; a null layout is one that no mapping fits, a null fingerprint no
    JSON object."""

    def seen(batches):
        read = _reader(mappings)
        for batch in batches:
            rows = [read(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.string()),
                    pa.array([r[1] for r in rows], pa.string()),
                    pa.array([len(r[2]) for r in rows], pa.int64()),
                ],
                ["fingerprint", "layout", "turns"],
            )

    found = records.select(record).mapInArrow(seen, "fingerprint string, layout string, turns long")
    return found.groupBy("fingerprint", "layout").agg(
        F.count(F.lit(1)).alias("records"), F.sum("turns").alias("turns")
    )


def segments(
    records: DataFrame, key: str = "conv_id", order: str = "turn", record: str = "record", mappings=MAPPINGS
) -> DataFrame:
    """``(key, order, place, segment, loss_from, loss_to)``: formatted turns of all records.

    Segments of a conversation, by order and place, make its formatted text. ``loss_from``
    and ``loss_to`` bound the characters of the segment that are under the loss mask, null
    where none are.
    """
    rows = records.select(F.col(key), F.col(order), F.col(record))
    kept = [rows.schema[0], rows.schema[1]]
    schema = T.StructType(kept).add("place", "integer").add("segment", "string").add("loss_from", "integer").add("loss_to", "integer")
    arrow = to_arrow_schema(schema)

    def formatted(batches):
        read = _reader(mappings)
        for batch in batches:
            source, made = [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                for place, (role, said) in enumerate(read(text)[2]):
                    whole, start, end = segment(role, said)
                    source.append(i)
                    made.append((place, whole, start, end) if role == LOSS_ROLE else (place, whole, None, None))
            take = pa.array(source, pa.int64())
            columns = [batch.column(c).take(take).cast(arrow.field(c).type) for c in (0, 1)]
            columns += [pa.array([m[c] for m in made], arrow.field(c + 2).type) for c in range(4)]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return rows.mapInArrow(formatted, schema)


def in_order(parts: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Segments with each conversation's ones side by side, in order."""
    by = [F.col(key), F.col(order).asc_nulls_first(), "place", "segment"]
    return parts.repartition(F.col(key)).sortWithinPartitions(*by)


def texts(parts: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """``(key, formatted, loss)``: one text per conversation, with the spans of it that are
    under the loss mask. A text must fit a row; :func:`segments` has no such limit."""
    held = F.sort_array(F.collect_list(F.struct(order, "place", "segment", "loss_from", "loss_to")))
    found = parts.groupBy(key).agg(held.alias("_s"))
    whole = F.array_join(F.transform("_s", lambda s: s["segment"]), "")

    def step(acc, s):
        span = F.struct((acc["at"] + s["loss_from"]).alias("from"), (acc["at"] + s["loss_to"]).alias("to"))
        spans = F.when(s["loss_from"].isNull(), acc["spans"]).otherwise(F.concat(acc["spans"], F.array(span)))
        return F.struct((acc["at"] + F.length(s["segment"])).cast("long").alias("at"), spans.alias("spans"))

    none = F.array().cast("array<struct<from: bigint, to: bigint>>")
    start = F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans"))
    return found.select(key, whole.alias("formatted"), F.aggregate("_s", start, step, lambda a: a["spans"]).alias("loss"))


def read_back(ordered: DataFrame, key: str = "conv_id") -> DataFrame:
    """``(key, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)`` of
    segments in order, parsed from the formatted text alone."""
    rows = ordered.select(key, "segment", "loss_from", "loss_to")
    schema = (
        T.StructType([rows.schema[0]])
        .add("n_turns", "long")
        .add("turns_sha256", "string")
        .add("loss_chars", "long")
        .add("loss_sha256", "string")
        .add("formatted_chars", "long")
    )
    arrow = to_arrow_schema(schema)

    def digests(batches):
        current, state, done = None, None, []

        def close():
            turns, chars, loss, size, count = state
            done.append((current, count, turns.hexdigest(), chars, loss.hexdigest(), size))

        def table():
            out = [pa.array([d[c] for d in done], arrow.field(c).type) for c in range(6)]
            done.clear()
            return pa.RecordBatch.from_arrays(out, schema=arrow)

        for batch in batches:
            for name, text, start, end in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or name != current:
                    if state is not None:
                        close()
                    current, state = name, [hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, said in parse(text):
                    state[0].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                    state[4] += 1
                if start is not None:
                    under = unescape(text[start:end])
                    state[1] += len(under)
                    state[2].update(under.encode("utf-8", "surrogatepass"))
                state[3] += len(text)
            yield table()
        if state is not None:
            close()
            yield table()

    return rows.mapInArrow(digests, schema)


def turn_records(rows: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text) as records, one each."""
    row = F.to_json(F.struct("turn", "role", "text"), {"ignoreNullFields": "false"})
    return rows.select("conv_id", "turn", row.alias("record"))
