from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lexifold.llm import decontamination, fingerprints
from lexifold.llm.fingerprints import GRAM, WINDOW, edit, fingerprint, gram_hashes, likeness, unpack, winnow

from .conftest import documents


@pytest.mark.parametrize("n", [0, 1, 5, 15, 16, 17, 40, 55, 56, 100, 700])
def test_winnowing_against_its_definition(n):
    rnd = random.Random(n)
    text = "".join(rnd.choice("ab é😀") for _ in range(n))
    h = gram_hashes(text)
    assert len(h) == (max(1, n - GRAM + 1) if n else 0)
    names = {}
    for g, x in zip((text[i : i + GRAM] for i in range(len(h))), h.tolist()):
        assert names.setdefault(g, x) == x
    assert len(set(names.values())) == len(names)
    window, chosen = min(WINDOW, len(h)), []
    for i in range(len(h) - window + 1 if len(h) else 0):
        part = h[i : i + window]
        at = i + max(j for j in range(window) if part[j] == part.min())
        if not chosen or chosen[-1] != at:
            chosen.append(at)
    assert winnow(h).tolist() == chosen
    assert unpack(fingerprint(text)[0]) == [(int(h[i]), i) for i in chosen]


def test_shared_passages_are_found(words):
    passage = " ".join(words(30, 9))
    assert len(passage) >= GRAM + WINDOW - 1
    a, b = " ".join(words(100, 1)) + passage, passage + " ".join(words(80, 2))
    assert set(fingerprint(a)[1].tolist()) & set(fingerprint(b)[1].tolist())


def test_prints_of_all_documents_in_order(spark, odd_texts):
    ids = [7, 3, 5, 11, 13, 17, 19, 23, 29, 31, 37, 41]
    docs = documents(spark, odd_texts, ids=ids).withColumn("part", F.lit("clash")).withColumn("tail", F.lit("clash"))
    order = sorted(zip(ids, odd_texts))
    for parts in (1, 3, 8):
        got = {r.doc_id: r for r in fingerprints.print_documents(docs, parts).collect()}
        assert len(got) == len(ids)
        for (i, text), (_, after) in zip(order, order[1:] + order[:1]):
            text, after = text or "", after or ""
            edited = edit(text, after)
            assert got[i].n_chars == len(text) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            assert got[i].fingerprint == fingerprint(text)[0] and got[i].edited_fingerprint == fingerprint(edited)[0]
            assert got[i].near_next == likeness(fingerprint(text)[1], fingerprint(after)[1])


def test_prints_of_hot_and_null_ids(spark, words):
    """Rows of one id or none are dealt to several ranges; every row but the last of all meets the one after it."""
    texts = [" ".join(words(20, i)) for i in range(160)]
    ids = [7] * 60 + [None] * 50 + list(range(50))
    docs = documents(spark, texts, ids=ids)
    hashes = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    order = [t for _, t in sorted(zip(ids, texts), key=lambda x: (x[0] is None, x[0] or 0, hashes[x[1]]))]
    expect = sorted(hashlib.sha256(edit(a, b).encode()).hexdigest() for a, b in zip(order, order[1:] + order[:1]))
    assert fingerprints._with_next(docs, 8).where("tail = 0").groupBy("part").count().agg(F.max("count")).first()[0] < 30
    for parts in (2, 8):
        assert sorted(r.edited_sha256 for r in fingerprints.print_documents(docs, parts).collect()) == expect


def test_prints_of_few_and_repeated_rows(spark):
    one = fingerprints.print_documents(documents(spark, ["alone here"]), 4).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert fingerprints.print_documents(documents(spark, ["x"]).limit(0), 4).count() == 0
    same = documents(spark, ["same text", "same text", None, "other"], ids=[1, 1, None, 2])
    assert fingerprints.print_documents(same, 3).count() == 4


def plain_sets(text):
    import re

    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(low))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_leaks_against_all_pairs(spark, words, odd_texts):
    items = [" ".join(words(n, 100 + n)) for n in (4, 12, 35, 60, 300)] + ["one", None, ""]
    texts = list(odd_texts)
    for k, item in enumerate(items[:5]):
        w = item.split()
        for lost in range(0, 12, 3):
            kept = [x for i, x in enumerate(w) if i >= lost]
            texts.append(" ".join(words(50 * k, k) + kept + words(300, lost)).upper())
    docs = documents(spark, texts).withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.shared, r.item_shingles) for r in decontamination.find_items(docs, bench).collect()}
    expect = {}
    for d, t in enumerate(texts):
        for i, q in enumerate(items):
            a, b = plain_sets(q), plain_sets(t)
            if a and 100 * len(a & b) >= 75 * len(a):
                expect[d, i] = (len(a & b), len(a))
    assert got == expect and len(expect) > 8
    kept = {r.doc_id for r in decontamination.drop_contaminated(docs, bench).collect()}
    assert kept == set(range(len(texts))) - {d for d, _ in expect}


def test_leaks_in_blocks_and_empty_tables(spark, words, monkeypatch):
    docs = documents(spark, [" ".join(words(80, i)) for i in range(6)])
    bench = docs.select(F.col("doc_id").alias("item_id"), F.substring("text", 1, 150).alias("text"))
    whole = sorted(map(tuple, decontamination.find_items(docs, bench).collect()))
    monkeypatch.setattr(decontamination, "BLOCK", 40)
    assert sorted(map(tuple, decontamination.find_items(docs, bench).collect())) == whole and len(whole) == 6
    assert decontamination.find_items(docs.limit(0), bench).count() == 0 and decontamination.find_items(docs, bench.limit(0)).count() == 0
