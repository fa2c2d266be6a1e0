from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline

from .conftest import documents
from .test_fingerprints_leaks import plain_sets
from .test_mixing_sharding import filled
from .test_ngram_join import plain_components


def test_stages_against_plain_ones(spark, words, write):
    base = [" ".join(words(60, i)) for i in range(90)]
    for i in range(0, 90, 9):
        base[i] = base[i].replace(" ", " idiot ", 3)
    near = [base[k] + " more" for k in (1, 2, 2, 10)]
    leak = " ".join(words(30, 777))
    texts = base + near + [" ".join(words(100, 5)) + " " + leak]
    docs = documents(spark, texts).withColumn("shard", F.lit("old"))
    labels = spark.createDataFrame([(i, int(i % 9 == 0)) for i in range(90)], "doc_id long, toxic int")
    d = write(documents=docs, labels=labels, benchmark=spark.createDataFrame([(1, leak)], "item_id long, text string"))
    alive = {i for i in range(len(texts)) if "idiot" not in texts[i]}
    now = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, d)
        rows = out.collect()
        if name == "toxicity":
            assert {r.doc_id for r in rows} == alive
        elif name == "near_duplicates":
            left = sorted(alive)
            found = plain_components([texts[i] for i in left], left)
            alive = {i for i, c in found.items() if i == c}
            assert {r.doc_id for r in rows} == alive and len(left) > len(alive)
        elif name == "decontamination":
            alive = {i for i in alive if not plain_sets(leak) <= plain_sets(texts[i])}
            assert {r.doc_id for r in rows} == alive
        elif name == "mixing":
            sizes, taken = Counter(), Counter()
            for i in alive:
                sizes[f"s{i % 3}"] += len(texts[i].split())
            for r in rows:
                taken[r.source] += len(r.text.split())
            target = filled(sizes, (3, 1, 2), 1.5, 2)
            assert all(abs(taken[s] - target[s]) <= 110 for s in sizes) and max(Counter(r.doc_id for r in rows).values()) <= 2
        else:
            assert {r.shard for r in rows} <= set(range(24)) and "text" in out.columns
        if name != "sharding":
            assert out.columns == docs.columns
            at = f"{d}/{name}-out"
            out.write.parquet(at)
            now = spark.read.parquet(at)
    assert corpus_pipeline.run(spark, d).count() == len(rows)


def test_odd_rows_go_through(spark, words, odd_texts, write):
    texts = odd_texts + [" ".join(words(50, 1000 + i)) for i in range(20)] + [" ".join(words(50, 1003))] * 3
    ids = [None, 1, 1, *range(3, len(texts))]
    docs = documents(spark, texts, ids=ids, sources=[None if i % 5 == 0 else f"s{i % 3}" for i in range(len(texts))])
    for c in ("score", "row", "size", "target", "component_id", "shard", "h"):
        docs = docs.withColumn(c, F.lit("clash"))
    items = spark.createDataFrame([(1, None), (2, ""), (None, " ".join(words(40, 555)))], "item_id long, text string")
    labels = spark.createDataFrame([(1, 0), (None, 1), (7, None)], "doc_id long, toxic int")
    d = write(documents=docs, labels=labels, benchmark=items)
    now = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        now = stage(spark, now, d)
        assert now.columns == docs.columns, name
    left = now.collect()
    # of the repeated texts one document stays; nothing else goes
    first = {}
    for i, t in zip(ids, texts):
        if i is not None and t and t.strip():
            first[t] = min(i, first.get(t, i))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in left) == sorted((i is None, i or 0) for i, t in zip(ids, texts) if i is None or not (t and t.strip()) or first[t] == i)
    out = corpus_pipeline.run(spark, d)
    assert set(docs.columns) <= set(out.columns) and out.count() > 0 and out.where("shard is null").count() == 0


def test_empty_tables_go_through(spark, write):
    docs = documents(spark, ["x"]).limit(0)
    d = write(documents=docs, labels=spark.createDataFrame([], "doc_id long, toxic int"), benchmark=spark.createDataFrame([], "item_id long, text string"))
    assert corpus_pipeline.run(spark, d).count() == 0
