from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lexifold.llm import mixing, sharding

from .conftest import documents

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def filled(sizes, weights, share, epochs):
    """Water-filling by its words: clamp, share out again, until no source is above its cap."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, set(names), share * sum(sizes.values())
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if w[s] * level > epochs * sizes[s] + 1e-9}
        if not over:
            return target | {s: w[s] * level for s in free}
        for s in over:
            target[s] = epochs * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_targets_and_taken_words(spark, words):
    texts = [" ".join(words(5 + i % 40, i)) for i in range(400)]
    sources = [None if i % 11 == 0 else "hot" if i % 3 else f"s{i % 7}" for i in range(400)]
    docs = documents(spark, texts, sources=sources)
    rows = mixing.mix_sources(docs).select("row.doc_id", "row.source", "size", "source_size", "target", "copies").collect()
    sizes = Counter()
    for t, s in zip(texts, sources):
        sizes[s] += len(WORDS.findall(t))
    expect = filled(sizes, (3, 1, 2), 1.5, 2)
    taken = Counter()
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(expect[r.source]) and 0 <= r.copies <= 2
        taken[r.source] += r.size * r.copies
    for s in sizes:
        assert abs(taken[s] - expect[s]) <= 45  # at most one document off
    again = {r.doc_id: r.copies for r in mixing.mix_sources(docs.repartition(7)).select("row.doc_id", "copies").collect()}
    assert again == {r.doc_id: r.copies for r in rows}
    assert mixing.repeat_rows(mixing.mix_sources(docs)).columns == docs.columns


@pytest.mark.parametrize("shared", [None, 7])
@pytest.mark.parametrize("equal", [False, True])
def test_rows_of_one_id_are_taken_one_by_one(spark, words, shared, equal):
    """A third of all rows have one id or none, and different or equal texts: targets are met within one document all the same."""
    texts = [" ".join(words(20, 1 if equal and i % 3 == 0 else i)) for i in range(600)]
    ids = [shared if i % 3 == 0 else i for i in range(600)]
    sources = ["a" if i % 3 == 0 else f"s{i % 4}" for i in range(600)]
    docs = documents(spark, texts, ids=ids, sources=sources).repartition(5).withColumn("m", F.create_map(F.lit("k"), F.lit(1)))
    rows = mixing.mix_sources(docs).select("row.*", "size", "target", "copies").collect()
    taken, target = Counter(), {}
    for r in rows:
        taken[r.source] += r["size"] * r.copies
        target[r.source] = r.target
    assert len(rows) == 600 and {r.copies for r in rows} <= {0, 1, 2}
    assert all(abs(taken[s] - target[s]) <= 11 for s in target), (taken, target)
    again = mixing.mix_sources(docs.repartition(3)).select("row.doc_id", "row.text", "copies").collect()
    assert Counter(map(tuple, again)) == Counter((r.doc_id, r.text, r.copies) for r in rows)


def test_mixing_odd_rows(spark, odd_texts):
    docs = documents(spark, odd_texts, ids=[None, 1, 1, *range(3, len(odd_texts))], sources=[None] * 6 + ["a"] * (len(odd_texts) - 6)).withColumn("size", F.lit("clash")).withColumn("target", F.lit(1))
    out = mixing.mix_sources(docs)
    assert out.count() == len(odd_texts) and out.select("row.*").columns == docs.columns
    assert {r["size"] for r in out.where("row.text is null").collect()} == {0}
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    empty = documents(spark, ["", None])
    assert {(r.target, r.copies) for r in mixing.mix_sources(empty).collect()} == {(0.0, 0)}


def test_shards_are_balanced_and_slots_gapless(spark, words, write):
    docs = documents(spark, [" ".join(words(1 + i * 7 % 90, i)) for i in range(900)])
    rows = sharding.op4_shard_slots(spark, write(documents=docs)).collect()
    by = defaultdict(list)
    load = Counter()
    for r in rows:
        by[r.shard].append(r.slot)
        load[r.shard] += r["size"]
    assert all(sorted(x) == list(range(len(x))) for x in by.values()) and set(by) == set(range(24))
    assert max(load.values()) - min(load.values()) < 0.02 * sum(load.values()) / 24 + 700
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) and r["size"] == len(texts[r.doc_id].encode()) + 8 for r in rows)


def test_rebalancing_edits_the_map(spark):
    totals = spark.range(64).select(F.col("id").cast("int").alias("vslot"), F.when(F.col("id") < 8, 1000).otherwise(10).cast("long").alias("bytes"), F.lit(1).cast("long").alias("rows"))
    first = sharding.first_map(totals, 4, 64)
    second = sharding.rebalance(totals, first, 4)
    moved = second.alias("b").join(first.alias("a"), "vslot").where("a.shard <> b.shard").count()
    assert 0 < moved <= 16 and {r.version for r in second.collect()} == {2}
    load = [r[1] for r in second.join(totals, "vslot").groupBy("shard").agg(F.sum("bytes")).collect()]
    assert max(load) - min(load) <= 1000
    third = sharding.rebalance(totals, second, 4)
    assert third.join(second.withColumnRenamed("shard", "before"), "vslot").where("shard <> before").count() == 0


def plain_rebalance(sizes, placed, shards):
    """The edited map (slot to shard) by plain loops."""
    placed = dict(placed)
    load = [sum(b for s, b in sizes.items() if placed[s] == k) for k in range(shards)]
    for s in sorted(sizes, key=lambda s: (-sizes[s], s)):
        to, now = load.index(min(load)), placed[s]
        if now >= shards or (sizes[s] > 0 and load[to] + sizes[s] < load[now]):
            if now < shards:
                load[now] -= sizes[s]
            load[to] += sizes[s]
            placed[s] = to
    return placed


def test_stored_map_against_a_plain_one(spark, words, tmp_path):
    path, slots = str(tmp_path / "map"), 64
    first = documents(spark, [" ".join(words(1 + i * 7 % 90, i)) for i in range(400)])
    more = first.unionByName(documents(spark, [" ".join(words(300, i)) for i in range(40)], ids=[i % 3 + 1000 for i in range(40)]))
    placed = {s: s * 4 // slots for s in range(slots)}
    for version, (docs, shards) in enumerate([(first, 4), (more, 4), (more, 4), (more, 5), (more, 3)]):
        sizes = Counter({s: 0 for s in range(slots)})
        for r in docs.select(sharding.virtual_slot(F.col("doc_id"), slots).alias("s"), sharding.record_size(F.col("text")).alias("b")).collect():
            sizes[r.s] += r.b
        placed = plain_rebalance(sizes, placed, shards)
        rows = sharding.assign_shards(docs, shards, slots, path).collect()
        assert all(r.shard == placed[r.vslot] for r in rows) and len(rows) == docs.count()
        assert {r.vslot: r.shard for r in sharding.load_map(spark, path).collect()} == placed
        if version == 0:
            kept = dict(placed)
    newest = sharding.load_map(spark, path).first().version
    # version 1 is the ranges; the unchanged third run stored nothing
    assert newest == 5 and {r.vslot: r.shard for r in sharding.load_map(spark, path, 2).collect()} == kept
    assert sharding.load_map(spark, str(tmp_path / "none")) is None


def test_hot_slots_are_numbered_in_parts(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PART", 50)
    docs = documents(spark, ["same"] * 600 + [f"t{i}" for i in range(100)], ids=[7] * 300 + [None] * 300 + list(range(100, 200)))
    rows = docs.select("doc_id", sharding.record_size(F.col("text")).alias("size"), sharding.virtual_slot(F.col("doc_id"), 64).alias("vslot"))
    by = defaultdict(list)
    for r in sharding.place_in_shards(rows, 3, 64).collect():
        by[r.shard].append(r.slot)
    assert sum(map(len, by.values())) == 700 and all(sorted(x) == list(range(len(x))) for x in by.values())
    assert sharding.place_in_shards(rows.limit(0), 3, 64).count() == 0


def test_sharding_odd_rows(spark, odd_texts):
    docs = documents(spark, odd_texts, ids=[None, 1, 1, *range(3, len(odd_texts))]).withColumn("size", F.lit("clash")).withColumn("shard", F.lit("old"))
    out = sharding.assign_shards(docs, 3, 64)
    assert out.count() == len(odd_texts) and out.where("shard is null or shard < 0 or shard > 2").count() == 0
    assert {(r["size"], r.text_crc32) for r in out.where("row.text is null").collect()} == {(8, 0)}
    assert sharding.assign_shards(docs.limit(0), 3, 64).count() == 0
