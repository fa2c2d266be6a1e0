"""Operator 13: periodic runs of words, found by longest common extensions over a difference cover."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, lean, table

#: A perfect difference set: every remainder by PERIOD but 0 is a difference of two of these, once. Fixed values.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
#: A run has so many periods and so many words at least.
TIMES, LEAST = 4, 6
#: Words of the documents that are read together, about; a longer document is read by itself.
TOGETHER = 1 << 18
#: Pairs of grid points that are looked at together, about.
PAIRS = 1 << 20

_WORDS = re.compile(WORD)


def _shifts() -> np.ndarray:
    """For remainders r and s of two places: the fewest words from both to places that are in the cover."""
    inside = np.zeros(PERIOD, bool)
    inside[list(COVER)] = True
    r = np.arange(PERIOD)
    both = np.array([[inside[(r + i) % PERIOD] & inside[(r + j) % PERIOD] for j in range(PERIOD)] for i in range(PERIOD)])
    return both.argmax(axis=2)


_SHIFT = _shifts()


class Extensions:
    """Longest common extensions of one sequence of numbers from 0 up, to the right.

    Only suffixes at places whose remainder by PERIOD is in the cover are sorted, as sequences of blocks of PERIOD numbers: blocks
    get ordinals, sequences of 2, 4, 8... blocks ranks by doubling. Neighbours' common blocks go into a sparse table of minima. The
    extension of two places is: number by number to the next places that are both sampled, then the blocks that the table says,
    then number by number inside the block that differs. The end of the sequence differs from all numbers.
    """

    def __init__(self, numbers: np.ndarray) -> None:
        self._n = len(numbers)
        # past the end come numbers that occur once, so that suffixes differ
        self._numbers = np.concatenate([numbers, -1 - np.arange(2 * PERIOD)]).astype(np.int32)
        at = np.flatnonzero(np.isin(np.arange(self._n + PERIOD) % PERIOD, COVER))
        self._order = np.full(self._n + PERIOD, -1, np.int64)
        self._order[at] = np.arange(len(at))
        step = len(COVER)  # samples from a place to the one a block on
        blocks = np.lib.stride_tricks.sliding_window_view(self._numbers, PERIOD)[at]
        rank = np.unique(np.ascontiguousarray(blocks).view(np.dtype((np.void, 4 * PERIOD))).ravel(), return_inverse=True)[1].ravel()
        levels = [rank]
        while rank.max(initial=-1) + 1 < len(rank):
            ahead = np.full(len(rank), -1, np.int64)
            ahead[: len(rank) - step] = rank[step:]
            rank = np.unique(rank * (len(rank) + 1) + ahead + 1, return_inverse=True)[1]
            step *= 2
            levels.append(rank)
        self._rank = rank
        by_rank = np.argsort(rank)
        a, b = by_rank[:-1].copy(), by_rank[1:].copy()
        common = np.zeros(len(a), np.int64)
        for i in range(len(levels) - 1, -1, -1):
            inside = (a < len(rank)) & (b < len(rank))
            same = inside.copy()
            same[inside] = levels[i][a[inside]] == levels[i][b[inside]]
            common += same << i
            move = (len(COVER) << i) * same
            a, b = a + move, b + move
        self._minima = [common.astype(np.int32)]
        while len(self._minima[-1]) > 1 << (len(self._minima) - 1):
            last, size = self._minima[-1], 1 << (len(self._minima) - 1)
            self._minima.append(np.minimum(last[:-size], last[size:]))

    def _one_by_one(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal numbers from i and j on, up to most."""
        same = np.zeros(len(i), np.int64)
        alive = np.arange(len(i))
        for k in range(PERIOD):
            alive = alive[most[alive] > k]
            alive = alive[self._numbers[i[alive] + k] == self._numbers[j[alive] + k]]
            if not len(alive):
                break
            same[alive] = k + 1
        return same

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Lengths of the common extensions of places i < j."""
        shift = _SHIFT[i % PERIOD, j % PERIOD]
        found = self._one_by_one(i, j, shift)
        go = np.flatnonzero((found == shift) & (j + shift < self._n))
        a, b = self._rank[self._order[i[go] + shift[go]]], self._rank[self._order[j[go] + shift[go]]]
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        blocks = np.zeros(len(go), np.int64)
        for k in np.unique(level).tolist():
            which = np.flatnonzero(level == k)
            blocks[which] = np.minimum(self._minima[k][low[which]], self._minima[k][high[which] - (1 << k)])
        length = shift[go] + PERIOD * blocks
        rest = self._one_by_one(i[go] + length, j[go] + length, np.full(len(go), PERIOD))
        found[go] = length + rest
        return found


def _grid(starts: np.ndarray, sizes: np.ndarray, times: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, periods) of the harmonic grid of each document (start, size): for each period every so many words that a run of it,
    times periods and least words long at least, has a point i of it with i + period inside. In parts of PAIRS or so."""
    most = sizes // times
    doc = np.repeat(np.arange(len(sizes)), most)
    period = np.arange(len(doc)) - np.repeat(np.cumsum(most) - most, most) + 1
    step = np.maximum(times * period, least) - period
    points = (sizes[doc] - period - 1) // step + 1
    points[sizes[doc] < np.maximum(times * period, least)] = 0
    ends = np.cumsum(points)
    at = 0
    while at < len(doc):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        n = points[at:to]
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        yield np.repeat(starts[doc[at:to]], n) + k * np.repeat(step[at:to], n), np.repeat(period[at:to], n)
        at = to


def find_runs(numbers: np.ndarray, sizes: np.ndarray, times: int = TIMES, least: int = LEAST) -> np.ndarray:
    """Rows (document, start, length, period) of all runs of documents that lie in numbers one after another, in this order.

    A run has its smallest period at least `times` times and `least` numbers, and can't be made longer on either side with that
    period. Each is met at a grid point whose word comes again a period later, and is as long as common extensions to both sides say.
    Multiples of its period find the same stretch, of which the smallest stays.
    """
    n_docs = len(sizes)
    # a number of its own after each document keeps extensions inside
    top = int(numbers.max(initial=-1)) + 1
    ends = np.cumsum(sizes)
    joined = np.insert(numbers, ends, top + np.arange(n_docs)).astype(np.int64)
    starts = ends - sizes + np.arange(n_docs)
    forward: Extensions | None = None
    backward: Extensions | None = None
    found = []
    for at, period in _grid(starts, sizes, times, least):
        same = np.flatnonzero(joined[at] == joined[at + period])
        at, period = at[same], period[same]
        if not len(at):
            continue
        if forward is None or backward is None:
            forward, backward = Extensions(joined), Extensions(joined[::-1])
        last = len(joined) - 1
        right = forward.of(at, at + period)
        # to the left: places mirrored, the later one first
        left = backward.of(last - at - period, last - at) - 1
        length = left + right + period
        long = length >= np.maximum(times * period, least)
        found.append(np.stack([at[long] - left[long], length[long], period[long]]))
    if not found:
        return np.empty((0, 4), np.int64)
    start, length, period = np.concatenate(found, axis=1)
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    fresh = np.ones(len(start), bool)
    fresh[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[fresh], length[fresh], period[fresh]
    doc = np.searchsorted(starts, start, "right") - 1
    order = np.lexsort((period, start, doc))
    return np.stack([doc, start - starts[doc], length, period], axis=1)[order]


def plant(words: list[str], doc_id: int | None) -> list[str]:
    """The words with a period planted in every tenth document, by the id's checksum (null: as the text null)."""
    h = zlib.crc32(("null" if doc_id is None else str(doc_id)).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def collapse(words: list[str], runs: np.ndarray) -> list[str]:
    """Words without those that some run (start, length, period) repeats after its first period."""
    if not len(runs):
        return words
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    kept = np.cumsum(edges[:-1]) == 0
    return [words[i] for i in np.flatnonzero(kept).tolist()]


RUNS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
DIGEST = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"

Words = Callable[[list[str], "int | None"], list[str]]


def _best(runs: np.ndarray) -> tuple[int | None, ...]:
    """(start, length, period, exponent in thousandths) of the run with the greatest exponent, exactly; four nulls without runs."""
    best = None
    for start, length, period in runs.tolist():
        if best is None or length * best[2] > best[1] * period:
            best = (start, length, period)
    return (*best, 1000 * best[1] // best[2]) if best else (None,) * 4


def _rows_of(words: list[str], doc_id: int | None, runs: np.ndarray, full: bool) -> tuple:
    text = " ".join(collapse(words, runs))
    if full:
        return doc_id, len(words), [dict(zip(("start", "length", "period"), r)) for r in runs.tolist()], text
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs.tolist())
    return doc_id, len(runs), *_best(runs), hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    names = [x.split()[0] for x in re.split(r", (?![^<]*>)", schema)]
    f = pd.DataFrame(rows, columns=names, dtype=object)
    return f.astype({c: "Int64" for c in ("doc_id", "start", "length", "period", "exponent_milli") if c in names})


def _read(words_of: Words | None, times: int, least: int, full: bool):
    schema = RUNS if full else DIGEST

    def flush(held: list[tuple[int | None, list[str]]]) -> pd.DataFrame:
        sizes = np.array([len(w) for _, w in held], np.int64)
        numbers = pd.factorize(np.array([w for _, ws in held for w in ws], object))[0].astype(np.int64)
        runs = find_runs(numbers, sizes, times, least)
        cuts = np.searchsorted(runs[:, 0], np.arange(len(held) + 1))
        return _frame([_rows_of(ws, doc_id, runs[cuts[i] : cuts[i + 1], 1:], full) for i, (doc_id, ws) in enumerate(held)], schema)

    @lean
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[int | None, list[str]]] = []
        size = 0
        for f in frames:
            for doc_id, text in zip(f["doc_id"].tolist(), f["text"].tolist()):
                doc_id = None if doc_id is None else int(doc_id)
                words = _WORDS.findall(text or "")
                words = words_of(words, doc_id) if words_of else words
                if held and size + len(words) > TOGETHER:
                    yield flush(held)
                    held, size = [], 0
                held.append((doc_id, words))
                size += len(words)
        if held:
            yield flush(held)

    return run


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))


def periodic_runs(docs: DataFrame, times: int = TIMES, least: int = LEAST, words_of: Words | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_words, runs (start in words, length, period; by start, then period) and collapsed, the
    text's words without repeated periods, joined by one space. words_of: what is read instead of the text's words, if given.

    Every text is read whole, where it lies: nothing is exchanged, and memory is bounded by TOGETHER words or the longest text.
    Null and empty texts, and texts too short for a run, have none; ids may be null or repeat; an empty table gives no rows; other
    columns, whatever their names, aren't read. Runs of one start are ordered by period; equal texts have equal runs.
    """
    return _rows(docs).mapInPandas(_read(words_of, times, least, True), RUNS)


def run_digests(docs: DataFrame, times: int = TIMES, least: int = LEAST, words_of: Words | None = None) -> DataFrame:
    """periodic_runs as DIGEST lists: the number of runs, the one of the greatest exponent (ties: smallest start, then period) and
    checksums of all runs and of the collapsed text, which doesn't leave the task. The same rows in the same cases."""
    return _rows(docs).mapInPandas(_read(words_of, times, least, False), DIGEST)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(table(spark, sf_dir, "documents"), words_of=plant)
