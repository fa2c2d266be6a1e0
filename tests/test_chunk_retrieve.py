from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lexifold.operators import chunk, evaluate, retrieve


def test_split_text_windows():
    rnd = random.Random(3)
    for n in (0, 5, 1200, 1201, 5000):
        t = "".join(rnd.choice("ab . ") for _ in range(n)).strip()
        parts = chunk.split_text(t, 1200, 180)
        assert all(len(p) <= 1200 for p in parts) and (len(t) > 1200 or parts == [t])
        spans = list(chunk.cut_points(t, 1200, 180))
        assert all(b - a <= 1200 for a, b in spans) and all(x[1] - y[0] == 180 for x, y in zip(spans, spans[1:]))


def test_points_sections_and_chunks(spark):
    lines = ["## Title", "SECTION", "preamble", "## late", "1. first", "more", "1.1) second", "", "(см. текст)"]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)] + [(2, i, f"## h{i}") for i in range(6)] + [(2, 6, "body")], "doc_id long, pos int, line string")
    got = {(r.doc_id, r.grp): r for r in chunk.point_groups(df).collect()}
    assert (got[1, 0].text, got[1, 0].point, got[1, 0].section_path) == ("preamble\nlate", None, ["Title", "SECTION"])
    assert (got[1, 1].text, got[1, 1].point) == ("1. first\nmore", "1") and got[1, 2].point == "1.1"
    assert got[2, 0].section_path == ["h0", "h1", "h2", "h5"]
    chunks = chunk.chunk_documents(df, 10, 2)
    assert [r.ord for r in chunks.where("doc_id = 1").orderBy("ord").collect()] == list(range(1, chunks.where("doc_id = 1").count() + 1))


def merged_rows(rows, target):
    out = []
    for key, point, path, text in rows:
        if out and out[-1][0] == key and len(out[-1][3]) + len(text) + 1 <= target:
            out[-1] = (key, out[-1][1] or point, out[-1][2], out[-1][3] + "\n" + text)
        else:
            out.append((key, point, path, text))
    return out


def test_merging_against_a_loop(spark):
    rnd = random.Random(5)
    rows = [(d, i + 1, rnd.choice([None, "", str(i)]), rnd.choice([[], ["s", str(i)]]), "x" * rnd.randint(1, 60), rnd.choice("ab")) for d in range(6) for i in range(d * 7)]
    df = spark.createDataFrame(rows, "doc_id long, ord int, point string, section_path array<string>, text string, source string")
    for run, least in ((None, 40), ("source", 0)):
        got = {}
        for r in chunk.merge_siblings(df, 99, "doc_id", run, least).orderBy("doc_id", "ord").collect():
            got.setdefault(r.doc_id, []).append((r[run] if run else 0, r.point, r.section_path, r.text))
        expect = {d: merged_rows([(x[5] if run else 0, *x[2:5]) for x in rows if x[0] == d and len(x[4]) >= least], 99) for d in range(6)}
        assert {d: [(k, p or None, s, t) for k, p, s, t in x] for d, x in got.items()} == {d: [(k, p or None, s, t) for k, p, s, t in x] for d, x in expect.items() if x}


def test_merging(spark):
    df = spark.createDataFrame([(1, i, str(i), ["s"], "x" * n) for i, n in enumerate((39, 40, 500, 500, 900))], "doc_id long, ord int, point string, section_path array<string>, text string")
    assert [len(r.text) for r in chunk.merge_siblings(df).orderBy("ord").collect()] == [541, 500, 900]
    assert chunk.merge_siblings(df, None).count() == 4
    assert {r.variant: r["count"] for r in chunk.sweep_chunking(df, (None, 900)).groupBy("variant").count().collect()} == {0: 4, 900: 3}


def test_units_and_citations(spark):
    lines = ["# One", "alpha text that is long enough", "Источник: N 7 и N 9 п. 3.1", "tail of one that is long enough", "# См. также", "left out and long enough text", "# Two", "short"]
    notes = spark.createDataFrame([("n", i, x) for i, x in enumerate(lines)], "note string, pos int, line string")
    units = chunk.citation_units(notes).withColumn("primary", F.lit("main"))
    got = chunk.map_citations(units, [("N 9", "nine"), ("N 7", "seven")]).orderBy("unit").collect()
    assert [(r.head, r.source, r.point) for r in got] == [("One", "seven", "3.1"), ("One", "main", None)]


def test_bm25_against_its_formula(spark):
    import math

    docs = {1: "aa bb aa cc", 2: "bb cc dd", 3: "cc cc", 4: "", 5: "aa"}
    chunks = spark.createDataFrame(list(docs.items()), "chunk_id long, text string")
    top = retrieve.bm25_topk(spark.createDataFrame([(1, "aa aa bb"), (2, "zz")], "query_id long, text string"), retrieve.build_bm25(chunks), 5).collect()
    words = {k: v.split() for k, v in docs.items()}
    n, avg = len(docs), sum(map(len, words.values())) / len(docs)
    raw = {t: math.log((n - d + 0.5) / (d + 0.5)) for t in ("aa", "bb", "cc", "dd") for d in [sum(t in w for w in words.values())]}
    idf = {t: x if x >= 0 else 0.25 * sum(raw.values()) / len(raw) for t, x in raw.items()}
    score = {k: sum(idf[t] * w.count(t) * 2.5 / (w.count(t) + 1.5 * (0.25 + 0.75 * len(w) / avg)) for t in ("aa", "aa", "bb")) for k, w in words.items() if {"aa", "bb"} & set(w)}
    assert {r.chunk_id: r.score for r in top} == pytest.approx(score, abs=1e-6) and {r.query_id for r in top} == {1}
    assert [r.chunk_id for r in sorted(top, key=lambda r: r["rank"])] == sorted(score, key=lambda k: (-round(score[k], 6), k))


def test_dense_blocks_and_fusion(spark, monkeypatch):
    rnd = random.Random(1)
    v = {i: [rnd.gauss(0, 1) for _ in range(8)] for i in range(50)}
    vectors = spark.createDataFrame([(i, x) for i, x in v.items()], "chunk_id long, vector array<float>").repartition(5)
    queries = vectors.where("chunk_id < 7").withColumnRenamed("chunk_id", "query_id")
    whole = sorted(map(tuple, retrieve.dense_topk(queries, vectors, 4).collect()))
    monkeypatch.setattr(retrieve, "BLOCK", 3)
    assert sorted(map(tuple, retrieve.dense_topk(queries, vectors, 4).collect())) == whole and len(whole) == 28
    lists = spark.createDataFrame([(1, 0, 10, 1), (1, 0, 11, 2), (1, 1, 12, 1), (1, 1, 11, 2), (1, 1, 13, 3)], "query_id int, list_id int, chunk_id int, rank int")
    assert [r.chunk_id for r in retrieve.rrf(lists).orderBy("rank").collect()] == [11, 10, 12, 13]


def test_rerank_order_is_that_of_logits(spark):
    logits = [-0.63, 40.0, 30.0, None, -1000.0, 1000.0, -25.0, -30.0, 40.0, None]
    c = spark.createDataFrame([(1, i, i + 1, "q", "" if x is None else str(x)) for i, x in enumerate(logits)], "query_id int, chunk_id int, rank int, question string, text string")
    scorer = lambda q, t: t.map(lambda x: float(x) if x else None).astype(float)
    best = retrieve.rerank(c, scorer, 20).orderBy("rank").collect()
    assert [r.chunk_id for r in best] == [5, 1, 8, 2, 0, 6, 7, 4, 3, 9] and [r["rank"] for r in best] == list(range(1, 11))
    assert all(0 <= r.rerank_score <= 1 for r in best) and best[0].rerank_score == 1.0 and [r.rerank_score for r in best[-3:]] == [0.0] * 3


def test_dense_best_against_a_sort():
    import numpy as np

    r = np.random.default_rng(0)
    for n, top in ((3, 5), (40, 5), (40, 1), (5, 5)):
        scores, ids = np.round(r.normal(0, 1, (7, n)), 1), np.sort(r.permutation(1000)[:n])
        found, of = retrieve._best(scores, ids, top)
        for row, values, names in zip(scores, found, of):
            expect = sorted(zip(-row, ids))[:top]
            assert sorted(zip(-values, names)) == expect


def test_rerank_gate_and_context(spark):
    c = spark.createDataFrame([(1, 5, 1, "red fox", "a"), (1, 6, 2, "red fox", "the red fox"), (1, 7, 3, "red fox", "fox"), (1, 8, 4, "red fox", None)], "query_id int, chunk_id int, rank int, question string, text string")
    best = retrieve.rerank(c, retrieve.lexical_scorer, 3).orderBy("rank").collect()
    assert [r.chunk_id for r in best] == [6, 7, 5]
    kept = spark.createDataFrame([(1, 0.3), (2, 0.2)], "query_id int, rerank_score double")
    asked = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    assert [(r.n, r.answered) for r in retrieve.answerable(asked, kept).orderBy("query_id").collect()] == [(1, True), (1, False), (0, False)]
    ranked = spark.createDataFrame([(1, 2, "b.docx", None, "two"), (1, 1, "a.docx", "3.1", "one")], "query_id int, rank int, source string, point string, text string")
    assert retrieve.build_context(ranked).first().context == "[1] (a.docx, п. 3.1)\none\n\n[2] (b.docx)\ntwo"
    assert retrieve.build_context(ranked, numbered=False).first().context == "[a.docx] one\n\n[b.docx] two"


def test_shuffles_of_the_sparse_search(spark):
    chunks = spark.createDataFrame([(1, "aa bb")], "chunk_id long, text string")
    groups = chunk.point_groups(spark.createDataFrame([(1, 0, "x")], "doc_id long, pos int, line string"))
    assert groups._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert chunks.count() == 1


def test_edit_distance_against_the_table():
    rnd = random.Random(2)
    for _ in range(60):
        a, b = ([rnd.choice("xyz") for _ in range(rnd.randint(0, 9))] for _ in range(2))
        t = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                t[i][j] = min(t[i - 1][j] + 1, t[i][j - 1] + 1, t[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
        assert evaluate.edit_distance(a, b) == t[-1][-1]


def test_error_rates(spark):
    df = spark.createDataFrame([("a b c", "a c"), ("", ""), ("", "x"), ("Ёж!", "еж")], "r string, h string")
    got = df.select(evaluate.wer(F.col("r"), F.col("h")).alias("w"), evaluate.cer(F.col("r"), F.col("h")).alias("c")).collect()
    assert [round(r.w, 3) for r in got] == [0.333, 0.0, 1.0, 0.0] and [round(r.c, 3) for r in got] == [0.4, 0.0, 1.0, 0.0]
