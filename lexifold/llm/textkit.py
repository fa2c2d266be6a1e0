"""Words and word shingles of whole batches of texts as 64-bit hashes, in numpy."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: Words in a shingle.
K = 5
#: Shapes of words that shaped hashes tell apart.
SHAPES = 6
#: Bytes hashed at once; pieces end between words.
PIECE = 1 << 19
#: Texts handled together take about so many bytes.
GROUP = 1 << 21

_MULT = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.Generator(np.random.PCG64(20240501)).integers(1, 1 << 63, 256, np.int64).astype(np.uint64)[_LOWER]
_SHINGLE = np.random.Generator(np.random.PCG64(20240502)).integers(1, 1 << 62, K, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit values whose output bits each depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_MULT, pow(_MULT, -1, 1 << 64))):
            steps = np.full(max(n, PIECE + 4096), base & _MASK, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers[0], _powers[1]


def _pieces(data: bytes) -> Iterator[tuple[int, np.ndarray]]:
    at = 0
    whole = np.frombuffer(data, np.uint8)
    while at < len(whole):
        end, step = at + PIECE, 4096
        while end < len(whole):
            found = np.flatnonzero(_SEP[whole[end : end + step]])
            if len(found):
                end += int(found[0])
                break
            end, step = end + step, step * 2
        end = min(end, len(whole))
        yield at, whole[at:end]
        at = end


def word_hashes(texts: list[bytes], shaped: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, where each text's words begin and the last's end). A to Z count as a to z.

    shaped: the lowest three bits tell the word's shape instead, one of SHAPES: whether it ends in a full stop, a comma or
    neither, and whether it has characters past ASCII.
    """
    data = b"\n".join(texts)
    found, begins = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for at, raw in _pieces(data):
        edge = np.diff(_SEP[raw].astype(np.int8), prepend=1, append=1)
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        if not len(start):
            continue
        power, inverse = powers(len(raw) + 1)
        total = np.empty(len(raw) + 1, np.uint64)
        total[0] = 0
        np.cumsum(_BYTE[raw] * power[: len(raw)], out=total[1:])
        words = mix64((total[end] - total[start]) * inverse[start])
        if shaped:
            past = np.concatenate([[0], np.cumsum(raw >= 0x80)])
            stop = raw[end - 1]
            shape = (stop == 0x2E) + 2 * (stop == 0x2C) + 3 * (past[end] > past[start])
            words = (words & ~np.uint64(7)) | shape.astype(np.uint64)
        found.append(words)
        begins.append(start + at)
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return np.concatenate(found), np.searchsorted(np.concatenate(begins), offsets)


def text_groups(texts: Iterable[str | None]) -> Iterator[list[bytes]]:
    group, size = [], 0
    for t in texts:
        group.append((t or "").encode("utf-8", "surrogatepass"))
        size += len(group[-1])
        if size >= GROUP:
            yield group
            group, size = [], 0
    if group:
        yield group


def shingles(texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    """For each text (null: empty) the hashes of its shingles in order: of every five words in a row, or of all words where
    there are one to four, or none."""
    for group in text_groups(texts):
        words, cut = word_hashes(group)
        rolled = np.zeros(max(0, len(words) - K + 1), np.uint64)
        for j in range(K):
            rolled += words[j : len(words) - K + 1 + j] * _SHINGLE[j] if len(rolled) else rolled
        rolled = mix64(rolled)
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            if b - a >= K:
                yield rolled[a : b - K + 1]
            elif b > a:
                short = np.array([b - a], np.uint64)
                for j in range(b - a):
                    short = mix64(short + words[a + j : a + j + 1] * _SHINGLE[j])
                yield short
            else:
                yield words[:0]


def shingle_sets(texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles."""
    return map(np.unique, shingles(texts))
