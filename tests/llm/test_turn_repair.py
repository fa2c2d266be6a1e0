from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from functools import cache

import pytest

from lexifold.llm import turn_repair as T

SCHEMA = "conv_id long, turn long, role string, text string"
LEGAL = re.compile("(s?(ua)+)?")


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        role, text = "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def plain_faults(rows):
    seen, out = set(), []
    for role, text in rows:
        t = text.strip(" \t\n\v\f\r")
        out.append("blank" if not t else "duplicate" if (role, text) in seen else "truncated" if t[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain_script(rows, kinds):
    """(cost, audit, lines) by a plain recursion over rows and states, at most three insertions in a row."""
    state_after = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}

    @cache
    def best(i, q, room):
        found = [(0, "", ())] if i == len(rows) and q in (0, 3) else []

        def add(cost, letter, i, line, q, room):
            if q is not None:
                rest = best(i, q, room)
                if rest:
                    found.append((cost + rest[0], letter + rest[1], (line, *rest[2]) if line is not None else rest[2]))

        for name in ("user", "assistant"):
            to = state_after[q].get(name[0])
            if room:
                add(2, "I", i, f"{name}:", to, room - 1)
            if i < len(rows) and kinds[i] not in ("blank", "duplicate"):
                add(2 + (kinds[i] == "truncated"), "R", i + 1, f"{name}:{rows[i][1]}", to, 3)
        if i < len(rows):
            add(3, "D", i + 1, None, q, 3)
            if kinds[i] not in ("blank", "duplicate"):
                add(int(kinds[i] == "truncated"), "K", i + 1, f"{rows[i][0]}:{rows[i][1]}", state_after[q].get(rows[i][0][:1]), 3)
        return min(found, default=None)

    for i in range(len(rows), -1, -1):  # rows from the last on, so that no call goes deep
        for q, room in itertools.product(range(4), range(4)):
            best(i, q, room)
    return best(0, 0, 3)


def plain_repair(rows):
    out = {conv: [] for conv, *_ in rows}
    for conv, turn, role, text in plain_damage(rows):
        out[conv].append((turn is not None, turn or 0, role, hashlib.md5(text.encode()).hexdigest(), text))
    for conv, found in out.items():
        found.sort()
        turns = [t for known, t, *_ in found if known]
        lines = [(r[2], r[4]) for r in found]
        kinds = plain_faults(lines)
        cost, audit, text = plain_script(lines, kinds)
        initials = [r[:1] for r, _ in lines]
        bad = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        gaps = turns[-1] - turns[0] + 1 - len(set(turns)) if turns else 0
        yield conv, gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), bad, cost, audit, hashlib.sha256("\n".join(text).encode()).hexdigest()


def talks(n, seed):
    rnd = random.Random(seed)
    for conv in range(n):
        turns = rnd.choice([1, 2, 5, 9])
        for i in range(turns):
            role = rnd.choice(["user", "assistant"][i % 2 :: 2] * 3 + ["system", "user", "assistant", "tool", "", None, "ü"])
            text = rnd.choice([None, "", " \t", "Yes.", "No", "What? ", "Fine!\n", f"Text {rnd.randrange(4)}.", f"cut {i}"])
            yield (conv, rnd.choice([i, i, i, i * 2, None]), role, text)


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0))


def test_scripts_against_all_scripts():
    """Every script of up to three rows and insertions, tried."""
    rnd = random.Random(1)
    for _ in range(60):
        n = rnd.randint(0, 3)
        kinds = [(rnd.choice("suax"), rnd.choice(["", "", "truncated", "blank"])) for _ in range(n)]
        options = []
        for initial, kind in kinds:
            ways = [("D", 3, "")]
            if kind != "blank":
                ways += [("K", int(kind == "truncated"), initial)] + [("R", 2 + (kind == "truncated"), c) for c in "ua"]
            options.append(ways)
        fill = [("I" * k, 2 * k, "".join(p)) for k in range(3) for p in itertools.product("ua", repeat=k)]
        scripts = itertools.product(fill, *itertools.chain(*((o, fill) for o in options)))
        best = min((sum(c for _, c, _ in s), "".join(e for e, _, _ in s)) for s in scripts if LEGAL.fullmatch("".join(r for *_, r in s)))
        symbols = bytes(0 if kind == "blank" else 1 + 2 * "suax".index(initial) + (kind == "truncated") for initial, kind in kinds)
        audit, _ = T.trace(symbols, 0, 0, True)
        assert (T.edit_cost(audit, symbols), audit) == best


def test_blocks_give_what_single_symbols_give():
    t, rnd = T.tables(), random.Random(2)
    assert len(t.before[0]) == T.SYMBOLS**T.BLOCK
    for _ in range(300):
        symbols = bytes(rnd.randrange(T.SYMBOLS) for _ in range(rnd.randint(0, 23)))
        for start in range(len(t.step)):
            now, behind, cost = start, [], 0
            for s in reversed(symbols):
                behind.insert(0, now)
                cost += t.step_grows[now][s]
                now = t.step[now][s]
            assert T.vectors_behind(symbols, start) == behind and T.ahead_of(symbols)[start] == now
            if len(symbols) == T.BLOCK:
                number = sum(s * T.SYMBOLS ** (T.BLOCK - 1 - i) for i, s in enumerate(symbols))
                assert (t.before[start][number], t.grows[start][number]) == (now, cost)


def test_many_conversations(spark):
    rows = list(talks(250, 5))
    rows += [(None, t, r, x) for _, t, r, x in talks(2, 6)] + [rows[7]] * 3
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as part", "1 as kept", "2 as digest", "3 as uid").repartition(5)
    assert ordered(T.repair(T.damage(df)).collect()) == ordered(plain_repair(rows))


@pytest.fixture
def apart(spark):
    """Every partition of an exchange stays, so conversations lie across them."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    yield spark
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_long_conversations_in_parts(apart):
    rnd = random.Random(3)
    long = [(7, i // 2 if i % 5 else None, rnd.choice(["user", "assistant", "system", "x"]), rnd.choice([f"line {i}.", f"line {i % 50}", "same.", "", None])) for i in range(2500)]
    wide = [(8, i, ["user", "assistant"][i % 2], "w" * 30_000 + f" {i}.") for i in range(12)]
    rows = long + wide + list(talks(60, 8)) + [(9, None, "user", "same.")] * 900
    got = ordered(T.repair(T.damage(apart.createDataFrame(rows, SCHEMA).repartition(6))).collect())
    assert got == ordered(plain_repair(rows))


def test_dropped_conversations_and_empty_tables(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = T.repair(T.damage(spark.createDataFrame([(gone, 0, "user", "a.")], SCHEMA))).collect()
    assert [tuple(r) for r in rows] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert T.repair(T.damage(spark.createDataFrame([], SCHEMA))).count() == 0


def test_query(spark, write):
    rows = list(talks(50, 9))
    got = T.op12_turn_repair(spark, write(conversations=spark.createDataFrame(rows, SCHEMA))).collect()
    assert ordered(got) == ordered(plain_repair(rows))
