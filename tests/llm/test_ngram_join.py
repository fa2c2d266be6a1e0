from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexifold.llm import ngram_join
from lexifold.llm.components import components

from .conftest import documents
from .test_fingerprints_leaks import plain_sets


def plain_components(texts, ids):
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    sets = [plain_sets(t) for t in texts]
    for a in range(len(texts)):
        for b in range(a):
            if ids[a] == ids[b] or (sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])):
                x, y = top(ids[a]), top(ids[b])
                up[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


def near_texts(words, seed):
    """Clusters around base texts with some words changed, chains, a passage that many share, and copies."""
    rnd, passage, out = random.Random(seed), words(25, 999), []
    for base in range(6):
        w = words(rnd.randint(20, 160), base)
        for _ in range(rnd.randint(1, 9)):
            out.append(" ".join(w))
            w = list(w)
            for _ in range(rnd.randint(0, 3)):
                w[rnd.randrange(len(w))] = rnd.choice(("new", "words", "here"))
    out += [" ".join(passage + words(n, 50 + n)) for n in range(2, 40)]
    out += [" ".join(passage)] * 3
    return rnd.sample(out, len(out))


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_all_pairs(spark, words, odd_texts, seed, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 2)
    monkeypatch.setattr(ngram_join, "LEADERS", 2)
    monkeypatch.setattr(ngram_join, "COMMON", 3)
    monkeypatch.setattr(ngram_join, "RANGE", 500)
    texts = near_texts(words, seed) + odd_texts
    ids = list(range(100, 100 + len(texts)))
    random.Random(seed).shuffle(ids)
    got = {r.doc_id: r for r in ngram_join.jaccard_classes(documents(spark, texts, ids=ids)).collect()}
    expect = plain_components(texts, ids)
    assert {i: r.component_id for i, r in got.items()} == expect
    assert all(got[i].n_shingles == len(plain_sets(t)) for i, t in zip(ids, texts))


def test_large_groups_of_near_copies_meet_in_rounds(spark, words, monkeypatch):
    """Near copies that are dealt to many salts end in one component, and their tasks hold few of them."""
    for name, value in (("SALT", 2), ("COMMON", 2)):
        monkeypatch.setattr(ngram_join, name, value)
    base = words(90, 77)
    texts = [" ".join(base[: 89 - k] + [f"end{k}"] + base[90 - k :]) for k in range(80)] + [" ".join(words(60, i)) for i in range(20)]
    ids = list(range(len(texts)))
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_classes(documents(spark, texts)).collect()}
    assert got == plain_components(texts, ids) and set(list(got.values())[:80]) == {0}


def test_shared_ids_nulls_and_clashes(spark, words):
    a, b = " ".join(words(40, 1)), " ".join(words(40, 2))
    docs = documents(spark, [a, b, b, a, None, a], ids=[5, 5, 9, None, 7, 3]).withColumn("n", F.lit("clash")).withColumn("rep", F.lit("clash"))
    got = sorted(((r.doc_id, r.component_id) for r in ngram_join.jaccard_classes(docs).collect()), key=str)
    assert got == sorted([(5, 3), (5, 3), (9, 3), (None, None), (7, 7), (3, 3)], key=str)
    kept = ngram_join.keep_representatives(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["3", "7", "None"]
    assert ngram_join.jaccard_classes(docs.limit(0)).count() == 0


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (200, 200)], "a long, b long")
    got = {r.id: r.component for r in components(links).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 200: 200}


def plain_links(texts, ids):
    sets, near = [plain_sets(t) for t in texts], {i: set() for i in ids}
    for a in range(len(texts)):
        for b in range(a):
            if ids[a] != ids[b] and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                near[ids[a]].add(ids[b])
                near[ids[b]].add(ids[a])
    return {i: len(x) for i, x in near.items()}


def test_links_against_all_pairs(spark, words, odd_texts, monkeypatch):
    monkeypatch.setattr(ngram_join, "RANGE", 500)
    monkeypatch.setattr(ngram_join, "MEMBERS", 4)
    base = words(120, 77)
    stars = [" ".join(base[: 119 - k] + [f"end{k}"] + base[120 - k :]) for k in range(30)]  # all near, none equal
    texts = near_texts(words, 3) + odd_texts + stars
    ids = list(range(100, 100 + len(texts)))
    random.Random(3).shuffle(ids)
    got = {r.doc_id: r for r in ngram_join.jaccard_links(documents(spark, texts, ids=ids)).collect()}
    expect = plain_links(texts, ids)
    assert {i: r.n_links for i, r in got.items()} == expect
    assert {i: r.component_id for i, r in got.items()} == plain_components(texts, ids)
    assert min(expect[i] for i in ids[-30:]) > 10
    # rows that share an id are one document, which counts once
    ids = [i % 40 if k % 3 == 0 else i for k, i in enumerate(ids)]
    got = {r.doc_id: r.n_links for r in ngram_join.jaccard_links(documents(spark, texts, ids=ids)).collect()}
    assert got == plain_links(texts, ids)


def test_common_counts(monkeypatch):
    r = np.random.default_rng(0)
    monkeypatch.setattr(ngram_join, "COLUMNS", 7)
    monkeypatch.setattr(ngram_join, "RANGE", 50)
    one, two = ([np.unique(np.r_[r.integers(0, top, 40), r.integers(1 << 40, 1 << 41, 5)]).astype(np.uint64) for top in (30, 60, 900) * 5] for _ in range(2))
    assert (ngram_join.common_counts(one, two) == [[len(np.intersect1d(a, b)) for b in two] for a in one]).all()
    assert (ngram_join.common_counts(one, one).diagonal() == [len(a) for a in one]).all()
