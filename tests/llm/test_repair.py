"""Conversation repair against a plain dynamic program and direct counts."""

import hashlib
import itertools
import random
import re
import zlib

from skewlens.llm import repair

WORD = re.compile(r"[^\x20\x09-\x0D]")


def plain(codes):
    """Least (cost, letters) by forward search over all states."""
    moves = {(0, 0): (1, "s"), (0, 1): (2, "u"), (1, 1): (2, "u"), (2, 2): (3, "a"), (3, 1): (2, "u")}
    follow = {0: 2, 1: 2, 2: 3, 3: 2}

    def close(states):
        for _ in range(3):
            for s, (c, a) in list(states.items()):
                new = (c + 5, a + "I")
                if follow[s] not in states or new < states[follow[s]]:
                    states[follow[s]] = new
        return states

    states = close({0: (0, "")})
    for code in codes:
        role, goes, cut = code & 3, code & 4, 5 if code & 8 else 0
        new = {}
        for s, (c, a) in states.items():
            options = [(s, c + 2, "D")]
            if not goes:
                options.append((follow[s], c + 1 + cut, "R"))
                if (s, role) in moves:
                    options.append((moves[s, role][0], c + cut, "K"))
            for t, cost, letter in options:
                if t not in new or (cost, a + letter) < new[t]:
                    new[t] = (cost, a + letter)
        states = close(new)
    return min(states[s] for s in (0, 3) if s in states)


def test_cheapest_on_all_short_rows():
    codes = [r | f for r in range(4) for f in (0, 4, 8)]
    for n in range(4):
        for rows in itertools.product(codes, repeat=n):
            assert repair.cheapest(bytes(rows)) == plain(rows)


def test_cheapest_on_long_rows():
    rng = random.Random(5)
    codes = [r | f for r in range(4) for f in (0, 0, 0, 4, 8)]
    for n in (7, 8, 9, 16, 17, 40, 200, 3000):
        for _ in range(5):
            rows = bytes(rng.choice(codes) for _ in range(n))
            assert repair.cheapest(rows) == plain(rows)
    assert repair.cheapest(bytes([2]) * 500) == plain([2] * 500)


def test_prices_are_dual_feasible_and_exact():
    rng = random.Random(6)
    rows = bytes(rng.choice([0, 1, 2, 3, 5, 9, 10]) for _ in range(60))
    price = repair.auction(rows)
    for node in range(4 * len(rows) + 4):
        for _, cost, to in repair.arcs(rows, node):
            assert price[node] <= cost + price[to]
    assert price[0] == plain(rows)[0]


def expected(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, sha) of ordered rows."""
    seen, codes = set(), []
    counts = [0, 0, 0]
    for _, role, text in rows:
        role_code = {"s": 0, "u": 1, "a": 2}.get(role[:1], 3)
        found = WORD.findall(text)
        if not found:
            codes.append(role_code | 4)
            counts[0] += 1
        elif (role, text) in seen:
            codes.append(role_code | 4)
            counts[1] += 1
        elif found[-1] not in ".!?":
            codes.append(role_code | 8)
            counts[2] += 1
        else:
            codes.append(role_code)
        seen.add((role, text))
    pairs = zip(rows, rows[1:])
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in pairs)
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    cost, audit = plain(codes)
    out, state, at = [], 0, 0
    for letter in audit:
        due = ("user", "user", "assistant", "user")[state]
        role, text = (due, "") if letter == "I" else rows[at][1:]
        at += letter != "I"
        if letter == "D":
            continue
        role = due if letter == "R" else role
        out.append(f"{role}:{text}")
        state = {"s": 1, "u": 2, "a": 3}[role[0]]
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def harmed(rows):
    """The damage of the query, row by row."""
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, [])
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest())
    return {k: sorted(v, key=order) for k, v in out.items()}


def found(df):
    damaged = repair.damage(df)
    rows = repair.digests(damaged, repair.audits(damaged, ids=df)).collect()
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r["conv_id"]: tuple(r)[1:] for r in rows}


def test_given_conversations(spark, data):
    df = spark.read.parquet(f"{data}/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert found(df) == {k: expected(v) for k, v in harmed(rows).items()}


def test_odd_rows(spark):
    rng = random.Random(7)
    texts = ["", " ", "Yes.", "Yes. \n", "no", "a? b", None, "x" * 300_000 + ".", "中文!"]
    roles = ["user", "assistant", "system", "tool", "", None, "umpire"]
    rows = [(None, None, None, None), (None, None, None, None)]
    for conv in range(60):
        for _ in range(rng.randint(1, 9)):
            rows.append((conv, rng.choice([None, 0, 1, 2, 3, 9]), rng.choice(roles), rng.choice(texts)))
    rows += rows[:20]
    rows += [(77, i, "user", f"same {i % 3}.") for i in range(2000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = df.selectExpr("*", "'x' AS _key", "'x' AS audit", "'x' AS cost", "1 AS _kind")
    assert found(df) == {k: expected(v) for k, v in harmed(rows).items()}
    assert found(df.limit(0)) == {}


def test_all_rows_dropped(spark):
    conv = next(c for c in itertools.count() if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(conv, 0, "user", "Hello.")], "conv_id long, turn long, role string, text string")
    assert found(df) == {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_repaired_rows(spark):
    rows = [(1, 0, "user", "A."), (1, 1, "tool", "B."), (1, 2, "user", "C."), (2, 0, "assistant", "No question.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    fixed = repair.repaired_rows(df, repair.audits(df)).orderBy("conv_id", "place").collect()
    assert [tuple(r) for r in fixed if r["conv_id"] == 1] == [
        (1, 0, "user", "A.", "K"),
        (1, 1, "assistant", "C.", "R"),  # KDR comes before KRD
    ]
    assert not [r for r in fixed if r["conv_id"] == 2]
