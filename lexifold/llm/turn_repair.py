"""Operator 12: repair of conversation structure by edit distance to a pattern of roles, in blocks looked up in precomputed tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, stash, table

#: Costs of the edits of a row; a row that stays although its text breaks off costs BROKEN besides.
DELETE, INSERT, REROLE, BROKEN = 3, 2, 2, 1
#: States of the pattern `(s?(ua)+)?`: nothing yet, after s, after u, after a. For each the role that may come next, and the state then.
NEXT_ROLE, NEXT_STATE = ("user", "user", "assistant", "user"), (2, 2, 3, 2)
_KEEPS = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("a", 2): 3, ("u", 3): 2}
_ACCEPTS = (0, 3)
_FAR = 1 << 30
#: Symbols: 0 for a row that must go, then for each initial (s, u, a, others) a whole and a broken row.
INITIALS = "sua"
SYMBOLS = 1 + 2 * (len(INITIALS) + 1)
#: Symbols in a block.
BLOCK = 4
#: A conversation is read in parts of so many rows or characters, about.
PART_ROWS, PART_CHARS = 1024, 1 << 16

_SPACE = " \t\n\v\f\r"


class Tables(NamedTuple):
    """Cost vectors and their transitions. A vector holds, for each state, the least cost of the rows from some place to the end, less
    the smallest of them; it has an ordinal, and number 0 is that at the end."""

    #: [vector behind, block] to the vector before the block, and what the smallest cost grows by
    before: list[list[int]]
    grows: list[list[int]]
    #: the same for single symbols
    step: list[list[int]]
    step_grows: list[list[int]]
    #: [vector behind][symbol][state]: the edit that comes first among the cheapest, by letter, and the state after it
    edits: list[list[list[tuple[str, int]]]]


def _close(costs: list[int]) -> list[int]:
    """Costs with insertions before them."""
    two, three = min(costs[2], INSERT + costs[3]), min(costs[3], INSERT + costs[2])
    return [min(costs[0], INSERT + two), min(costs[1], INSERT + two), two, three]


def _ways(behind: tuple[int, ...], symbol: int, state: int) -> Iterator[tuple[str, int, int]]:
    """(edit, state after it, cost to the end) of the edits that use the row up."""
    yield "D", state, DELETE + behind[state]
    if symbol:
        kind, broken = divmod(symbol - 1, 2)
        to = _KEEPS.get((INITIALS[kind], state)) if kind < len(INITIALS) else None
        if to is not None:
            yield "K", to, broken * BROKEN + behind[to]
        yield "R", NEXT_STATE[state], REROLE + broken * BROKEN + behind[NEXT_STATE[state]]


@cache
def tables() -> Tables:
    """All vectors that rows can lead to, found from the one at the end; then blocks of 2, 3... symbols from shorter ones."""
    end = _close([0 if q in _ACCEPTS else _FAR for q in range(4)])
    number, found = {tuple(end): 0}, [tuple(end)]
    step, grows, edits = [], [], []
    for vector in found:  # grows while it is read
        step.append([])
        grows.append([])
        edits.append([])
        for symbol in range(SYMBOLS):
            ways = [sorted(_ways(vector, symbol, q)) for q in range(4)]
            costs = _close([min(w[2] for w in ways[q]) for q in range(4)])
            least = min(costs)
            key = tuple(c - least for c in costs)
            if key not in number:
                number[key] = len(found)
                found.append(key)
            step[-1].append(number[key])
            grows[-1].append(least)
            chosen = [sorted([*ways[q], ("I", NEXT_STATE[q], INSERT + costs[NEXT_STATE[q]])]) for q in range(4)]
            edits[-1].append([next((e, to) for e, to, cost in chosen[q] if cost == costs[q]) for q in range(4)])
    one, one_grows = np.array(step), np.array(grows)
    before, total = one, one_grows
    for _ in range(BLOCK - 1):
        # the symbol ahead of a block is its highest digit
        total = np.concatenate([total + one_grows[before, s] for s in range(SYMBOLS)], axis=1)
        before = np.concatenate([one[before, s] for s in range(SYMBOLS)], axis=1)
    return Tables(before.tolist(), total.tolist(), step, grows, edits)


def _blocks(symbols: bytes) -> tuple[list[int], int]:
    """Blocks of symbols in their order, and how many symbols are left over ahead of them."""
    odd = len(symbols) % BLOCK
    digits = np.frombuffer(symbols, np.uint8)[odd:].reshape(-1, BLOCK).astype(np.int64)
    return (digits @ SYMBOLS ** np.arange(BLOCK - 1, -1, -1)).tolist(), odd


@cache
def _arrays() -> tuple[np.ndarray, np.ndarray]:
    return np.array(tables().before), np.array(tables().step)


def ahead_of(symbols: bytes) -> list[int]:
    """For each vector behind the symbols the vector ahead of them."""
    before, step = _arrays()
    blocks, odd = _blocks(symbols)
    now = np.arange(len(before))
    for b in reversed(blocks):
        now = before[now, b]
    for s in reversed(symbols[:odd]):
        now = step[now, s]
    return now.tolist()


def vectors_behind(symbols: bytes, behind: int) -> list[int]:
    """The vector behind each symbol: borders of blocks by lookup from the end, then every block by itself from its border backward."""
    before, step = tables().before, tables().step
    blocks, odd = _blocks(symbols)
    out = [0] * len(symbols)
    border = behind
    for k in range(len(blocks) - 1, -1, -1):
        now, first = border, odd + k * BLOCK
        for i in range(first + BLOCK - 1, first, -1):
            out[i] = now
            now = step[now][symbols[i]]
        out[first] = now
        border = before[border][blocks[k]]
    for i in range(odd - 1, -1, -1):
        out[i] = border
        border = step[border][symbols[i]]
    return out


def trace(symbols: bytes, behind: int, state: int, last: bool) -> tuple[str, int]:
    """(edits of the symbols by initials, state after them) from a state on: at each place the least letter among the cheapest, which
    gives the least audit, as letters alone decide the states. last: what the pattern still needs is inserted."""
    edits, out = tables().edits, []
    for symbol, vector in zip(symbols, vectors_behind(symbols, behind)):
        choices = edits[vector][symbol]
        letter, state = choices[state]
        out.append(letter)
        while letter == "I":
            letter, state = choices[state]
            out.append(letter)
    while last and state not in _ACCEPTS:
        out.append("I")
        state = NEXT_STATE[state]
    return "".join(out), state


def repaired(edits: str, state: int, rows: Iterable[tuple[str, str]]) -> list[str]:
    """`role:text` of the rows that the edits leave, from a state on."""
    out, rows = [], iter(rows)
    for letter in edits:
        if letter == "I":
            out.append(f"{NEXT_ROLE[state]}:")
            state = NEXT_STATE[state]
            continue
        role, text = next(rows)
        if letter == "K":
            out.append(f"{role}:{text}")
            state = _KEEPS[role[:1], state]
        elif letter == "R":
            out.append(f"{NEXT_ROLE[state]}:{text}")
            state = NEXT_STATE[state]
    return out


def edit_cost(edits: str, symbols: bytes) -> int:
    kept = [e for e in edits if e != "I"]
    return DELETE * kept.count("D") + INSERT * edits.count("I") + REROLE * kept.count("R") + BROKEN * sum(e != "D" and s > 0 and s % 2 == 0 for e, s in zip(kept, symbols))


class Faults(NamedTuple):
    symbols: bytes
    blank: int
    duplicate: int
    truncated: int


def faults(rows: list[tuple[str, str]], first: Iterable[bool]) -> Faults:
    """Symbols and counts of rows (role, text); first: whether no earlier row of the conversation has the same role and text."""
    symbols, blank, duplicate, truncated = bytearray(), 0, 0, 0
    for (role, text), fresh in zip(rows, first):
        text = text.rstrip(_SPACE)
        if not text:
            blank += 1
            symbols.append(0)
        elif not fresh:
            duplicate += 1
            symbols.append(0)
        else:
            broken = text[-1] not in ".!?"
            truncated += broken
            symbols.append(1 + 2 * (INITIALS.find(role[:1]) if role[:1] and role[0] in INITIALS else len(INITIALS)) + broken)
    return Faults(bytes(symbols), blank, duplicate, truncated)


def _fresh(rows: list[tuple[str, str]]) -> list[bool]:
    seen: set[tuple[str, str]] = set()
    return [not (r in seen or seen.add(r)) for r in rows]


def illegal(initials: list[str]) -> int:
    """Adjacent initials that the pattern has nowhere; rows without a role have an empty one."""
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


class Turns:
    """Numbers of turns met in order, nulls left out: the range less the distinct ones, which may come in parts."""

    def __init__(self) -> None:
        self.first: int | None = None
        self.last: int | None = None
        self.distinct = 0

    def add(self, first: int | None, last: int | None, distinct: int) -> None:
        if distinct:
            self.distinct += distinct - (self.last == first)
            self.first = first if self.first is None else self.first
            self.last = last

    @property
    def gaps(self) -> int:
        return self.last - self.first + 1 - self.distinct if self.distinct else 0


RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_CUTS = RESULT + ", part long, turns array<long>, roles array<string>, texts array<string>"
_READ = "conv_id long, part long, symbols binary, ahead array<int>, roles array<string>, texts array<string>, blank long, duplicate long, truncated long, first_turn long, last_turn long, distinct_turns long"


def _columns(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _table(rows: list[tuple], schema: str) -> pd.DataFrame:
    f = pd.DataFrame(rows, columns=_columns(schema), dtype=object)
    return f.astype({x.split()[0]: "Int64" for x in schema.split(", ") if x.split()[1] == "long"})


def _number(x: object) -> int | None:
    return None if x is None or x != x or x is pd.NA else int(x)


def _result(conv_id: int | None, turns: list[int | None], rows: list[tuple[str, str]]) -> tuple:
    """The result of a conversation that is here as a whole."""
    found, span = faults(rows, _fresh(rows)), Turns()
    known = [t for t in turns if t is not None]
    span.add(known[0] if known else None, known[-1] if known else None, len(set(known)))
    audit, _ = trace(found.symbols, 0, 0, True)
    text = "\n".join(repaired(audit, 0, rows))
    return conv_id, span.gaps, found.blank, found.duplicate, found.truncated, illegal([r[:1] for r, _ in rows]), edit_cost(audit, found.symbols), audit, hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


@lean
def _cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted rows to results of conversations that lie inside the partition, and parts of those that may go on outside or are long."""
    number = TaskContext.get().partitionId() << 32
    out: list[tuple] = []
    conv: object = None
    turns: list[int | None] = []
    rows: list[tuple[str, str]] = []
    room, begun, edge = 0, False, True

    def end(whole: bool) -> None:
        nonlocal turns, rows, room, number
        if whole:
            out.append((*_result(_number(conv), turns, rows), None, None, None, None))
        else:
            out.append((_number(conv), *[None] * 8, number, turns, [r for r, _ in rows], [t for _, t in rows]))
            number += 1
        turns, rows, room = [], [], 0

    for f in frames:
        for c, turn, role, text, kept in zip(f["conv_id"].tolist(), f["turn"].tolist(), f["role"].tolist(), f["text"].tolist(), f["kept"].tolist()):
            if not begun or c != conv:
                if begun:
                    end(not edge)
                    edge = False
                conv, begun = c, True
            if not kept:
                continue
            turns.append(_number(turn))
            rows.append((role, text))
            room += len(text)
            if len(rows) >= PART_ROWS or room >= PART_CHARS:
                end(False)
                edge = True
        if len(out) > 256:
            yield _table(out, _CUTS)
            out = []
    if begun:
        end(False)
    yield _table(out, _CUTS)


@lean
def _summaries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Parts with the places of first texts to their symbols, counts and transitions."""
    for f in frames:
        out = []
        for conv, part, turns, roles, texts, firsts in zip(*(f[c].tolist() for c in ("conv_id", "part", "turns", "roles", "texts", "firsts"))):
            rows = list(zip(roles, texts))
            places = set() if firsts is None else set(map(int, firsts))
            found = faults(rows, (i in places for i in range(len(rows))))
            known = [int(t) for t in turns if t is not None and t == t]
            out.append((_number(conv), int(part), found.symbols, ahead_of(found.symbols), list(roles), list(texts), found.blank, found.duplicate, found.truncated, known[0] if known else None, known[-1] if known else None, len(set(known))))
        yield _table(out, _READ)


def _backward(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Parts from a conversation's last to its first: the vector behind each."""
    begun, conv, vector = False, None, 0
    for f in frames:
        out = []
        for c, part, ahead in zip(f["conv_id"].tolist(), f["part"].tolist(), f["ahead"].tolist()):
            if not begun or c != conv:
                begun, conv, vector, last = True, c, 0, True
            out.append((int(part), vector, last))
            vector, last = int(ahead[vector]), False
        yield pd.DataFrame(out, columns=["part", "behind", "last"])


def _ends(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each state before a part the state after it."""
    for f in frames:
        out = [[trace(s, int(v), q, False)[1] for q in range(4)] for s, v in zip(f["symbols"].tolist(), f["behind"].tolist())]
        yield f[["conv_id", "part", "behind", "last"]].assign(ends=out)


def _forward(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Parts from a conversation's first to its last: the state before each."""
    begun, conv, state = False, None, 0
    for f in frames:
        out = []
        for c, part, behind, last, ends in zip(*(f[x].tolist() for x in ("conv_id", "part", "behind", "last", "ends"))):
            if not begun or c != conv:
                begun, conv, state = True, c, 0
            out.append((int(part), int(behind), bool(last), state))
            state = int(ends[state])
        yield pd.DataFrame(out, columns=["part", "behind", "last", "state"])


_PIECES = "conv_id long, part long, blank long, duplicate long, truncated long, first_turn long, last_turn long, distinct_turns long, illegal long, rows long, first_role string, last_role string, cost long, audit string, repaired string, any boolean"


@lean
def _pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Parts with the vector behind and the state before them to their edits and repaired text."""
    for f in frames:
        out = []
        for conv, part, symbols, roles, texts, blank, duplicate, truncated, first, last_turn, distinct, behind, last, state in zip(*(f[c].tolist() for c in (*_columns(_READ)[:3], *_columns(_READ)[4:], "behind", "last", "state"))):
            audit, _ = trace(symbols, int(behind), int(state), bool(last))
            lines = repaired(audit, int(state), zip(roles, texts))
            initials = [r[:1] for r in roles]
            edge = (initials[0], initials[-1]) if initials else (None, None)
            out.append((_number(conv), int(part), blank, duplicate, truncated, _number(first), _number(last_turn), distinct, illegal(initials), len(initials), *edge, edit_cost(audit, symbols), audit, "\n".join(lines), bool(lines)))
        yield _table(out, _PIECES)


@lean
def _joined(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pieces in order to one row for each conversation. The checksum takes one text after another; no more than a batch of them and
    the audit is held."""
    begun, conv = False, None
    audit: list[str] = []

    def row() -> tuple:
        return _number(conv), span.gaps, *counts, "".join(audit), digest.hexdigest()

    for f in frames:
        out = []
        for c, blank, duplicate, truncated, first, last, distinct, pairs, n, first_role, last_role, cost, edits, text, any_text in zip(*(f[x].tolist() for x in (_columns(_PIECES)[:1] + _columns(_PIECES)[2:]))):
            if not begun or c != conv:
                if begun:
                    out.append(row())
                begun, conv, audit, span, counts, digest, filled, before = True, c, [], Turns(), [0] * 5, hashlib.sha256(), False, None
            between = illegal([before, first_role]) if n and before is not None else 0
            counts = [a + int(b) for a, b in zip(counts, (blank, duplicate, truncated, pairs + between, cost))]
            before = last_role if n else before
            span.add(_number(first), _number(last), int(distinct))
            audit.append(edits)
            if any_text:
                digest.update((("\n" if filled else "") + text).encode("utf-8", "surrogatepass"))
                filled = True
        yield _table(out, RESULT)
    if begun:
        yield _table([row()], RESULT)


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, kept) of conversations with faults that a checksum of `conv_id:turn` decides on: rows not kept, texts
    emptied or without ends, rows twice, wrong roles. Nulls of roles and texts are one space, and so are those of ids in the key."""
    space = F.lit(" ")
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))
    fault = F.pmod(F.crc32(F.encode(key, "UTF-8")), F.lit(20))
    text, role = F.coalesce(F.col("text").cast("string"), space), F.coalesce(F.col("role").cast("string"), space)
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(fault == 4, "user").otherwise(role).alias("role"),
        F.when(fault.isin(0, 1), "").when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (fault != 0).alias("kept"),
        F.explode(F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return rows.drop("copy")


def _streamed(df: DataFrame, order: Column) -> DataFrame:
    return df.repartition("conv_id").sortWithinPartitions("conv_id", order)


def _named(df: DataFrame, conv: Column | None = None) -> DataFrame:
    """conv_id as text, which pandas keeps with its nulls."""
    return df.withColumn("conv_id", F.col("conv_id").cast("string"))


def repair(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text, kept) to one RESULT row for each conv_id, null among them.

    A conversation's kept rows stand by turn, nulls first; rows of one turn by role, then by a checksum of the text. Each edit script
    is the cheapest that makes the initials of roles match `(s?(ua)+)?`, with the least audit. A role that begins with another
    character, or is empty, can't be kept. A conversation without kept rows has zeros and empty texts; an empty table gives no rows.

    Rows are exchanged once, by ranges of (conv_id, turn...), so a conversation that holds a share of all rows lies in many
    partitions. One that lies inside a partition is repaired there. Others are cut into parts of PART_ROWS: a part's tables tell
    which vector it makes of each vector behind it, and into which state each state leads, so both passes over a conversation
    read one short row for each part. Its checksum alone must take the repaired text in one place, a batch at a time.
    """
    order = ["conv_id", "turn", "role", "digest", "uid"]
    dealt = rows.withColumn("digest", F.md5("text")).withColumn("uid", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    cuts = stash(_named(dealt.select("conv_id", F.col("turn").cast("string").alias("turn"), "role", "text", "kept")).mapInPandas(_cut, _CUTS), "turn-cuts")
    parts = cuts.where("part is not null").select("conv_id", "part", "turns", "roles", "texts")
    texts = parts.select("conv_id", "part", F.posexplode(F.arrays_zip("roles", "texts")).alias("at", "row"))
    texts = texts.where(F.col("row.texts").rlike(r"[^\x20\x09-\x0D]")).groupBy("conv_id", F.col("row.roles").alias("role"), F.md5("row.texts").alias("digest"))
    firsts = texts.agg(F.min(F.struct("part", "at")).alias("first")).groupBy("first.part").agg(F.collect_list("first.at").alias("firsts"))
    read = stash(_named(parts.join(firsts, "part", "left").select("conv_id", "part", "turns", "roles", "texts", "firsts")).mapInPandas(_summaries, _READ), "turn-parts")
    behind = _named(_streamed(read.select("conv_id", "part", "ahead"), F.desc("part"))).mapInPandas(_backward, "part long, behind int, last boolean")
    ends = _named(read.select("conv_id", "part", "symbols").join(behind, "part")).mapInPandas(_ends, "conv_id long, part long, behind int, last boolean, ends array<int>")
    states = _named(_streamed(ends, F.asc("part"))).mapInPandas(_forward, "part long, behind int, last boolean, state int")
    pieces = _named(read.drop("ahead").join(states, "part")).mapInPandas(_pieces, _PIECES)
    joined = stash(_named(_streamed(pieces, F.asc("part"))).mapInPandas(_joined, RESULT), "turn-joined")
    return cuts.where("part is null").select(*_columns(RESULT)).unionByName(joined)


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damage(table(spark, sf_dir, "conversations")))
