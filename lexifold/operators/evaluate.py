"""Checking evaluation items, scoring retrieval and transcripts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import dot, norm_transcript, norm_ws
from ..session import shared_place
from .retrieve import SCORES
from .stats import listed

KS = (1, 3, 5)
#: Steps of a cosine from 0 to 1 where orders of encodings are compared: six digits. Cosines of a side that a task holds at once.
STEPS, HELD = 1_000_000, 1 << 25


def fragments(quote: Column) -> Column:
    """Normalised parts of a quote between ellipses, empty ones left out."""
    return F.filter(F.transform(F.split(F.coalesce(quote, F.lit("")), "…"), lambda f: norm_ws(f)), lambda f: f != "")


#: Fields that an item must have; a quote may be empty.
REQUIRED = ("id", "question", "answer", "gold_source", "topic", "difficulty")
DIFFICULTIES = ("easy", "medium", "hard")


def verify_items(items: DataFrame, docs: DataFrame, topics: list[str], difficulties: tuple[str, ...] = DIFFICULTIES, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """items with errors: missing fields, bad topics and difficulties, unknown sources, and (of known sources) quote fragments that the
    source's text (source, text) doesn't have, cut to 60 characters. Texts are normalised once, before the join."""
    norm = docs.select(F.col("source").alias("known"), norm_ws(F.col("text")).alias("hay"))
    j = items.join(norm, F.col("gold_source") == F.col("known"), "left")
    missing = [F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", F.lit(f"missing {c}")) for c in required]
    bad = [F.when(~F.coalesce(F.col(c).isin(*allowed), F.lit(False)), F.concat(F.lit(f"bad {c} "), F.coalesce(c, F.lit("")))) for c, allowed in (("topic", topics), ("difficulty", difficulties))]
    unknown = F.when(F.col("known").isNull(), F.concat(F.lit("unknown source "), F.coalesce("gold_source", F.lit(""))))
    # a fragment of white space alone is in every text
    parts = F.filter(F.split(F.coalesce("gold_quote", F.lit("")), "…"), lambda f: ~F.contains(F.col("hay"), norm_ws(f)))
    quotes = F.when(F.col("known").isNotNull(), F.transform(parts, lambda f: F.concat(F.lit("quote not found "), F.substring(f, 1, 60))))
    errors = F.concat(F.filter(F.array(*missing, *bad, unknown), lambda e: e.isNotNull()), F.coalesce(quotes, F.array().cast("array<string>")))
    return j.withColumn("errors", errors).drop("known", "hay")


def rename_repeats(items: DataFrame, key: str = "id", file: str = "file", pos: str = "pos") -> DataFrame:
    """items whose repeated ids, in the order of file and place, become id-file."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(file, pos))
    return items.withColumn(key, F.when(n == 1, F.col(key)).otherwise(F.concat_ws("-", F.col(key), F.col(file))))


def score_retrieval(topk: DataFrame, items: DataFrame, ks: tuple[int, ...] = KS, by: str = "id") -> DataFrame:
    """Per item (id, gold_source, gold_quote) and its ranked chunks (id, rank, source, text): recall_k, whether the source is among
    the first k; quote_k, whether their joined text has all fragments of the quote (an empty quote never); mrr; found_rank."""
    ranked = topk.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("rank", "source", norm_ws(F.col("text")).alias("norm")))).alias("c"))
    j = items.select(by, "gold_source", fragments(F.col("gold_quote")).alias("f")).join(ranked, by, "left").withColumn("c", F.coalesce("c", F.array().cast("array<struct<rank:int,source:string,norm:string>>")))
    found = F.array_min(F.transform(F.filter("c", lambda x: x["source"] == F.col("gold_source")), lambda x: x["rank"]))
    out = j.withColumn("found_rank", found)
    for k in ks:
        joined = F.array_join(F.transform(F.filter("c", lambda x: x["rank"] <= F.lit(k)), lambda x: x["norm"]), " ")
        out = out.withColumn(f"recall_{k}", F.coalesce((F.col("found_rank") <= k).cast("int"), F.lit(0)))
        out = out.withColumn(f"joined_{k}", joined)
        out = out.withColumn(f"quote_{k}", ((F.size("f") > 0) & F.forall("f", lambda f: F.contains(F.col(f"joined_{k}"), f))).cast("int")).drop(f"joined_{k}")  # noqa: B023
    return out.withColumn("mrr", F.coalesce(1.0 / F.col("found_rank"), F.lit(0.0))).drop("c", "f", "gold_source")


def aggregate_scores(scores: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    return scores.groupBy(*by).agg(*(F.round(F.avg(m), 4).alias(m) for m in metrics))


def retrieval_grid(ranked: DataFrame, items: DataFrame, configs: DataFrame) -> DataFrame:
    """Mean scores and latency of each config (config, top_k, pool, rrf_k, rerank, ms): ranked lists (id, rank, source, text, list_id,
    logit) are made and scored once, and a config only cuts, fuses and orders them, by the logit where it reranks."""
    pooled = ranked.crossJoin(listed(configs)).where("rank <= pool")
    fused = pooled.groupBy("config", "top_k", "rerank", "id", "source").agg(F.round(F.sum(1.0 / (F.col("rrf_k") + F.col("rank"))), 12).alias("s"), F.min("rank").alias("first"), F.max("logit").alias("logit"), F.min_by("text", "rank").alias("text"))
    order = Window.partitionBy("config", "id").orderBy(F.when(F.col("rerank"), F.col("logit")).desc_nulls_last(), F.desc("s"), "first", "source")
    cut = fused.withColumn("rank", F.row_number().over(order)).where("rank <= top_k")
    keyed = cut.withColumn("id", F.struct("config", "id"))
    each = items.crossJoin(listed(configs.select("config", "ms"))).select(F.struct("config", "id").alias("id"), "gold_source", "gold_quote", "ms")
    scores = score_retrieval(keyed, each).join(each.select("id", "ms"), "id")
    return scores.groupBy("id.config").agg(*(F.round(F.avg(m), 4).alias(m) for m in ("recall_1", "recall_3", "recall_5", "quote_3", "mrr")), F.avg("ms").alias("ms"))


def compare_arms(scores: DataFrame, baseline: str, hit: str = "hit") -> DataFrame:
    """Per arm: items that it finds and the baseline doesn't, and the reverse, from (arm, id, hit 0/1)."""
    base = scores.where(F.col("arm") == baseline).select("id", F.col(hit).alias("b"))
    j = scores.where(F.col("arm") != baseline).join(base, "id")
    return j.groupBy("arm").agg(F.count_if((F.col("b") == 0) & (F.col(hit) == 1)).alias("recovered"), F.count_if((F.col("b") == 1) & (F.col(hit) == 0)).alias("lost"))


def topk_overlap(a: DataFrame, b: DataFrame, ks: tuple[int, ...] = (5, 10, 20), neutral: float = 0.99) -> DataFrame:
    """Per k over two runs (id, chunks array<string>): mean share of distinct texts in both, share of items in equal order; and
    whether the first ten agree on every item."""
    j = a.select("id", F.col("chunks").alias("a")).join(b.select("id", F.col("chunks").alias("b")), "id")
    each = j.select("id", "a", "b", F.explode(F.array(*map(F.lit, ks))).alias("k"))
    cut = lambda c: F.slice(c, F.lit(1), F.col("k"))
    share = F.size(F.array_intersect(cut("a"), cut("b"))) / F.col("k")
    out = each.groupBy("k").agg(F.avg(share).alias("overlap"), F.avg((cut("a") == cut("b")).cast("int")).alias("same_order"))
    ten = j.agg(F.bool_and(F.size(F.array_intersect(F.slice("a", 1, 10), F.slice("b", 1, 10))) / 10 >= neutral).alias("neutral"))
    return out.crossJoin(F.broadcast(ten))


def spearman(df: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """Rank correlation of two columns within groups, ties with their mean rank, to four digits; 0 where a side is constant.

    Values are counted first, so that a group's ranks come from its different values, and its sums from its different pairs.
    """
    pairs = df.groupBy(*by, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("k"))

    def ranks(c: str) -> DataFrame:
        counted = pairs.groupBy(*by, c).agg(F.sum("k").alias("k"))
        w = Window.partitionBy(*by).orderBy(c)
        middle = F.sum("k").over(w) - (F.col("k") - 1) / 2 - (F.sum("k").over(Window.partitionBy(*by)) + 1) / 2
        return counted.select(*(F.col(x).alias(f"{x}_of") for x in by), F.col(c).alias("value"), middle.alias(f"r{c}"))

    for c in ("a", "b"):
        r = ranks(c)
        on = F.col(c).eqNullSafe(F.col("value"))
        for x in by:
            on = on & F.col(x).eqNullSafe(F.col(f"{x}_of"))
        pairs = pairs.join(r, on).drop("value", *(f"{x}_of" for x in by))
    dot_ = lambda x, y: F.sum(F.col("k") * F.col(x) * F.col(y))
    corr = F.try_divide(dot_("ra", "rb"), F.sqrt(dot_("ra", "ra")) * F.sqrt(dot_("rb", "rb")))
    return pairs.groupBy(*by).agg(F.round(F.coalesce(corr, F.lit(0.0)), 4).alias("spearman"))


def encoding_fidelity(a: DataFrame, b: DataFrame) -> DataFrame:
    """Mean and least cosine of two encodings (chunk_id, vector) of the same texts."""
    j = a.select("chunk_id", F.col("vector").alias("a")).join(b.select("chunk_id", F.col("vector").alias("b")), "chunk_id")
    cos = F.try_divide(dot(F.col("a"), F.col("b")), F.sqrt(dot(F.col("a"), F.col("a")) * dot(F.col("b"), F.col("b"))))
    return j.agg(F.round(F.avg(cos), 6).alias("mean"), F.round(F.min(cos), 6).alias("least"))


def _units(column: pd.Series) -> np.ndarray:
    """The vectors of a column over their lengths; zero vectors as they are."""
    m = np.array(column.tolist(), np.float64)
    length = np.sqrt((m * m).sum(1, keepdims=True))
    return m / np.where(length > 0, length, 1.0)


def _steps(asked: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """The cosine of each asked vector to each of the others, all of length 1, in whole steps; halves go away from 0."""
    x = asked @ vectors.T * STEPS
    return (x + np.copysign(0.5, x)).astype(np.int32)


def _middle_ranks(values: np.ndarray) -> np.ndarray:
    """Ranks less the mean of all ranks, equal values with their mean rank."""
    _, at, counts = np.unique(values, return_inverse=True, return_counts=True)
    return (np.cumsum(counts) - (counts - 1) / 2 - (len(values) + 1) / 2)[at]


def _best_places(values: np.ndarray, places: np.ndarray, top: int) -> np.ndarray:
    """The places of the highest values, equal ones by place."""
    near = np.nonzero(values >= np.partition(values, -top)[-top])[0] if len(values) > top else np.arange(len(values))
    return places[near[np.lexsort((places[near], -values[near]))[:top]]]


def order_fidelity(a: DataFrame, b: DataFrame, queries: DataFrame, top: int = 5, block: int = 256) -> DataFrame:
    """Over a stated set of queries (query_id), texts of both encodings (chunk_id, vector) themselves: the mean rank correlation of their
    cosines to all texts in the two encodings, and the mean share of the best `top` that are the same.

    Both are by cosines of six digits, equal ones with their mean rank in the one and by id in the other. Texts of both encodings are
    written once. A task has one block of queries, at most `block` and about HELD cosines a side (one query, where there are more texts
    than that), and reads all texts batch by batch; of them it keeps a whole number for each query and side. So no row for each query
    and text is made or exchanged, and neither texts nor cosines go through the driver. A side without any variety has correlation 0,
    a zero vector cosines of 0; texts that one of the encodings lacks, and null vectors, are left out. Without queries both means are
    null.
    """
    spark = a.sparkSession
    side = lambda df, c: df.where(F.col("vector").isNotNull()).select("chunk_id", F.col("vector").alias(c))
    named = queries.select(F.col("query_id").alias("chunk_id")).distinct().withColumn("asked", F.lit(True))
    place = shared_place(spark, "encodings")
    side(a, "a").join(side(b, "b"), "chunk_id").join(named, "chunk_id", "left").write.parquet(place)
    j = spark.read.parquet(place)
    n, stated = j.agg(F.count("*"), F.count("asked")).first()
    blocks = max(1, -(-stated // max(1, min(block, HELD // max(1, n)))))

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, asked, steps, ids, done = [], {}, {}, [], 0
        for f in frames:
            if f["first"].any():
                first.append(f[f["first"]])
                f = f[~f["first"]]
            if first and not asked and len(f):
                asked = {c: _units(pd.concat(first)[c]) for c in "ab"}
                steps = {c: np.empty((len(m), n), np.int32) for c, m in asked.items()}
            if not asked:
                continue
            ids.append(f["chunk_id"].to_numpy())
            size = max(1, SCORES // len(asked["a"]))
            for i in range(0, len(f), size):
                part = f.iloc[i : i + size]
                for c, m in asked.items():
                    steps[c][:, done : done + len(part)] = _steps(m, _units(part[c]))
                done += len(part)
        if not asked:
            return
        places = np.empty(n, np.int64)
        places[np.argsort(np.concatenate(ids), kind="stable")] = np.arange(n)
        rows = []
        for x, y in zip(steps["a"], steps["b"]):
            ra, rb = _middle_ranks(x), _middle_ranks(y)
            length = np.sqrt(ra @ ra) * np.sqrt(rb @ rb)
            rows.append((ra @ rb / length if length else 0.0, len(np.intersect1d(_best_places(x, places, top), _best_places(y, places, top)))))
        yield pd.DataFrame(rows, columns=["spearman", "same"])

    texts = j.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(False).alias("first"), "chunk_id", "a", "b")
    first = j.where("asked").select(F.pmod(F.xxhash64("chunk_id"), F.lit(blocks)).cast("int").alias("block"), F.lit(True).alias("first"), "chunk_id", "a", "b")
    dealt = first.unionByName(texts).repartitionById(blocks, F.col("block")).sortWithinPartitions(F.desc("first"))
    each = dealt.drop("block").mapInPandas(compare, "spearman double, same long")
    return each.agg(F.round(F.avg(F.round("spearman", 4)), 4).alias("spearman"), F.round(F.avg(F.col("same") / top), 4).alias("same_top"))


def accept_configs(runs: DataFrame, floor: float = 0.98) -> DataFrame:
    """Of (config, spearman, ms): the fastest config whose order holds."""
    return runs.where(F.col("spearman") >= floor).agg(F.min_by("config", F.struct("ms", "config")).alias("best"), F.min("ms").alias("ms"), F.count("*").alias("accepted"))


def rephrase_checks(df: DataFrame, by: str = "arm") -> DataFrame:
    """Per arm of (question, rephrased, ms, base_ms): how many end in ?, how many changed, and the latency's change in percent."""
    low = lambda c: F.lower(F.trim(c))
    return df.groupBy(by).agg(F.count("*").alias("n"), F.count_if(F.trim("rephrased").endswith("?")).alias("asks"), F.count_if(low(F.col("rephrased")) != low(F.col("question"))).alias("changed"), F.round((F.avg("ms") / F.avg("base_ms") - 1) * 100, 2).alias("ms_change"))


def truncation_checks(df: DataFrame, max_tokens: int, by: str = "arm") -> DataFrame:
    """Answers that used up their tokens, and answers that don't end like a sentence."""
    return df.groupBy(by).agg(F.count("*").alias("n"), F.count_if(F.col("tokens") >= max_tokens).alias("capped"), F.count_if(~F.col("answer").rlike(r"[.!?»)]\s*$")).alias("cut"))


def repeat_stability(df: DataFrame) -> DataFrame:
    """Share of ids whose repeated answers are all equal but for blanks at the ends, in percent."""
    each = df.groupBy("id").agg((F.countDistinct(F.trim("answer")) == 1).cast("int").alias("stable"))
    return each.agg(F.count("*").alias("n"), F.round(F.avg("stable") * 100, 2).alias("stable_pct"))


def edit_distance(a: list[str], b: list[str]) -> int:
    """Least number of tokens inserted, removed or changed, a row of the table at a time."""
    codes = {w: i for i, w in enumerate({*a, *b})}
    y, row = np.array([codes[w] for w in b]), np.arange(len(b) + 1)
    steps = np.arange(len(b) + 1)
    for i, w in enumerate(a, 1):
        best = np.empty_like(row)
        best[0] = i
        best[1:] = np.minimum(row[1:] + 1, row[:-1] + (y != codes[w]))
        row = np.minimum.accumulate(best - steps) + steps
    return int(row[-1])


def wer(ref: Column, hyp: Column) -> Column:
    """Word error rate after normalising; of an empty reference 0 if the hypothesis is empty too, else 1."""

    @F.pandas_udf("double")
    def rate(r: pd.Series, h: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(r.str.split(), h.str.split()):
            out.append(edit_distance(a, b) / len(a) if a else float(bool(b)))
        return pd.Series(out, dtype=float)

    return rate(norm_transcript(ref), norm_transcript(hyp))


def cer(ref: Column, hyp: Column) -> Column:
    r, h = norm_transcript(ref), norm_transcript(hyp)
    return F.when(F.length(r) > 0, F.levenshtein(r, h) / F.length(r)).otherwise((F.length(h) > 0).cast("double"))


def model_summary(df: DataFrame, by: str = "model") -> DataFrame:
    """Means over samples without error, null where there are none, and the number of failed ones."""
    ok = F.col("error").isNull()
    return df.groupBy(by).agg(*(F.avg(F.when(ok, F.col(m))).alias(m) for m in ("wer", "cer", "rtf")), F.count_if(~ok).alias("failed"))


def voice_grid(df: DataFrame, cells: list[str]) -> DataFrame:
    return df.groupBy(*cells).agg(F.avg("ms").alias("ms"), F.max("peak").alias("peak"), F.avg("rms").alias("rms")).orderBy("ms", *cells)
