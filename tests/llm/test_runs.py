from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from lexifold.llm import runs as R

from .conftest import documents


def plain_runs(words, times=4, least=6):
    """Every maximal stretch by trying all periods and places; of stretches found twice the smallest period stays."""
    found = {}
    for period in range(1, len(words) // times + 1):
        at = 0
        while at + period < len(words):
            to = at
            while to + period < len(words) and words[to] == words[to + period]:
                to += 1
            if to > at and to + period - at >= max(times * period, least):
                found.setdefault((at, to + period - at), period)
            at = max(to, at + 1)
    return sorted((start, length, period) for (start, length), period in found.items())


def plain_digest(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(("null" if doc_id is None else str(doc_id)).encode())
    if h % 10 == 0 and words:
        a = h // 10 % len(words)
        p = 1 + (len(words) - a) // (3 + h // 10 % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words)
    best = max(found, key=lambda r: (r[1] * 10**12 // r[2], -r[0], -r[2]), default=None)
    dropped = {i for s, n, p in found for i in range(s + p, s + n)}
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in found)
    text = " ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def repetitive(n, seed):
    rnd = random.Random(seed)
    for _ in range(n):
        size = rnd.choice([0, 1, 5, 6, 9, 40, 120, 300])
        words = [str(rnd.randrange(rnd.choice([1, 2, 3, 5, 50]))) for _ in range(size)]
        for _ in range(2):
            if size > 10 and rnd.random() < 0.6:
                a = rnd.randrange(size)
                b, p = rnd.randrange(a, size), 1 + rnd.randrange(max(1, (size - a) // 4))
                words[a:b] = [words[a + i % p] for i in range(b - a)]
        yield words


def test_cover_has_every_difference():
    assert sorted((a - b) % R.PERIOD for a in R.COVER for b in R.COVER if a != b) == list(range(1, R.PERIOD))
    for i in range(R.PERIOD):
        for j in range(R.PERIOD):
            assert (i + R._SHIFT[i, j]) % R.PERIOD in R.COVER and (j + R._SHIFT[i, j]) % R.PERIOD in R.COVER


@pytest.mark.parametrize("kinds", [1, 2, 3, 40])
def test_extensions(kinds):
    rnd = random.Random(kinds)
    numbers = [rnd.randrange(kinds) for _ in range(150)] * 3 + [7] * 100 + [rnd.randrange(kinds) for _ in range(50)]
    pairs = [sorted(rnd.sample(range(len(numbers)), 2)) for _ in range(2000)]

    def plain(i, j):
        k = 0
        while j + k < len(numbers) and numbers[i + k] == numbers[j + k]:
            k += 1
        return k

    i, j = np.array(pairs).T
    assert R.Extensions(np.array(numbers)).of(i, j).tolist() == [plain(a, b) for a, b in pairs]


@pytest.mark.parametrize("times,least", [(4, 6), (2, 2), (3, 10)])
def test_runs_of_many_documents_together(monkeypatch, times, least):
    monkeypatch.setattr(R, "PAIRS", 500)
    docs = list(repetitive(400, times))
    ids = {}
    numbers = np.array([ids.setdefault(w, len(ids)) for d in docs for w in d])
    found = R.find_runs(numbers, np.array([len(d) for d in docs]), times, least).tolist()
    assert [tuple(r) for r in found] == [(i, *r) for i, d in enumerate(docs) for r in plain_runs(d, times, least)]


def test_digests_of_all_rows(spark, odd_texts):
    texts = odd_texts[:7] + [" ".join(d) for d in repetitive(300, 9)] + ["a b " * 2000, "\t".join(map(str, range(3000))), "x"]
    got = R.run_digests(documents(spark, texts).repartition(3), words_of=R.plant).collect()
    assert sorted(map(tuple, got)) == sorted(plain_digest(i, t) for i, t in enumerate(texts))
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))) > 10


def test_long_texts_are_read_whole(spark, odd_texts):
    one = R.periodic_runs(documents(spark, [odd_texts[7] + " tail" * 50, "y " * 400_000]), words_of=None).collect()
    assert (30_000, 50, 1) in [tuple(r) for r in one[0].runs] and [tuple(r) for r in one[1].runs] == [(0, 400_000, 1)]
    assert one[0].n_words == 30_050 and one[1].collapsed == "y"


def test_repeated_and_null_ids_clashing_names_and_empty_tables(spark):
    text = "a b " * 5 + "c"
    docs = documents(spark, [text, None, text, ""], ids=[7, 7, None, None]).selectExpr("*", "1 as start", "'r' as runs", "2 as n_runs", "3 as words")
    rows = R.periodic_runs(docs).collect()
    assert sorted((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in rows) == [(0, 0, [], ""), (0, 11, [(0, 10, 2)], "a b c"), (7, 0, [], ""), (7, 11, [(0, 10, 2)], "a b c")]
    assert R.run_digests(documents(spark, [])).count() == 0


def test_query(spark, write):
    texts = [" ".join(d) for d in repetitive(40, 2)]
    got = R.op13_periodic_runs(spark, write(documents=documents(spark, texts))).collect()
    assert sorted(map(tuple, got)) == sorted(plain_digest(i, t) for i, t in enumerate(texts))
