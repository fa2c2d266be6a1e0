"""Operator 10: log-likelihoods of whole documents by a gated recurrent language model and by smoothed counts.

Words are counted over all training texts into a lexicon, a table of their hashes. The most frequent words have places in the
model's class-factored softmax; the others are drawn from classes by shape, within which their smoothed counts decide, so that
every text has a probability. A bounded, checked number of words is broadcast with counts; a document's other words meet the
lexicon in a join. All training texts train the network once: in each of several rounds every task goes over its own part of the
round's texts from the weights so far, and the tasks' weights are averaged by tokens in a tree.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import gru
from .common import shared_dir, stash, table
from .textkit import SHAPES, text_groups, word_hashes

#: Word classes of the softmax and places in each; the first place is the end of a text.
CLASSES, SIZE = 32, 64
#: Words whose counts are broadcast at most (16 bytes each).
KNOWN = 1 << 18
#: Step of the weights in each round; a round has an equal part of the training texts, by hash.
RATES = (0.01, 0.006, 0.003, 0.0015)
#: Tokens that a task trains on, counts or scores at once; steps of a lane and longest piece of a text in training.
FLUSH, COUNTED, STEPS = 1 << 19, 1 << 21, 2048
LANES = 512
#: Models that are averaged in one task, one after the other, and that the driver gets at most.
FAN = 16


def held_out(doc_id: Column) -> Column:
    """Whether crc32(doc_id as text) mod 7 is 2 (a null doc_id: that of empty text)."""
    return F.pmod(F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")), F.lit(7)) == 2


def _token_lists(texts) -> Iterator[np.ndarray]:
    for group in text_groups(texts):
        words, cut = word_hashes(group, shaped=True)
        yield from (words[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()))


def _count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def flush(held):
        ids, counts = np.unique(np.concatenate(held), return_counts=True)
        return pd.DataFrame({"id": ids.view(np.int64), "n": counts.astype(np.int64)})

    held, size = [], 0
    for f in frames:
        for words in _token_lists(f["text"]):
            held.append(words)
            size += len(words)
            if size >= COUNTED:
                yield flush(held)
                held, size = [], 0
    if size:
        yield flush(held)


class Vocabulary:
    """Codes of words for the recurrent model, and counts of the words that are broadcast.

    code: the place of a frequent word; CLASSES * SIZE + shape for others. tail: for each shape how many tokens and words the
    lexicon has that have no place.
    """

    def __init__(self, ids: np.ndarray, counts: np.ndarray, n: np.ndarray, v: np.ndarray, texts: int):
        order = np.argsort(ids)
        self.ids, self.counts = ids[order], counts[order]
        head = CLASSES * SIZE - 1
        rank = np.full(len(ids), -1, np.int64)
        rank[:head] = np.arange(1, min(head, len(ids)) + 1)
        self.rank = rank[order]
        self.texts, self.tokens = texts, int(n.sum()) + texts
        self.types = int(v.sum()) + (texts > 0)
        shape = (ids[:head] & np.uint64(7)).astype(np.int64)
        self.tail_n = n - np.bincount(shape, counts[:head], SHAPES).astype(np.int64)
        self.tail_v = v - np.bincount(shape, minlength=SHAPES)
        self.head_counts = np.zeros(CLASSES * SIZE, np.int64)
        self.head_counts[0] = texts
        self.head_counts[1 : len(shape) + 1] = counts[:head]

    def biases(self) -> tuple[np.ndarray, np.ndarray]:
        """Logs of the classes' and places' shares of the training tokens: the model starts from these."""
        words = self.head_counts.reshape(CLASSES, SIZE)
        return np.log(np.concatenate([words.sum(1), self.tail_n]) + 0.5), np.log(words + np.where(words, 0.0, 1e-4))

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(code, count, or -1 where it isn't broadcast) of each word."""
        if not len(self.ids):
            return CLASSES * SIZE + (words & np.uint64(7)).astype(np.int64), np.full(len(words), -1, np.int64)
        at = np.minimum(np.searchsorted(self.ids, words), len(self.ids) - 1)
        known = self.ids[at] == words
        rank = np.where(known, self.rank[at], -1)
        return np.where(rank > 0, rank, CLASSES * SIZE + (words & np.uint64(7)).astype(np.int64)), np.where(known, self.counts[at], -1)


START = CLASSES * SIZE + SHAPES


def lexicon_of(texts: DataFrame) -> DataFrame:
    """(id, n): the count of every word of texts; tasks send each of their words about once."""
    return stash(texts.mapInPandas(_count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")), "lexicon")


def vocabulary(lexicon: DataFrame, texts: int) -> Vocabulary:
    shape = F.col("id").bitwiseAND(F.lit(7)).cast("int")
    sums = np.zeros((2, SHAPES), np.int64)
    for r in lexicon.groupBy(shape.alias("shape")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        sums[:, r["shape"]] = r["n"], r["v"]
    # the driver gets the sizes of levels of frequency, sixteenths of a doubling, then the words of as many levels, from the top, as
    # hold at most KNOWN
    level = F.floor(16 * F.log2("n"))
    levels = lexicon.groupBy(level.alias("level")).agg(F.count("*").alias("words")).toPandas().sort_values("level", ascending=False)
    fits = levels["level"][levels["words"].cumsum() <= KNOWN]
    top = lexicon.where(level >= (int(fits.min()) if len(fits) else 1 << 20)).toPandas().sort_values(["n", "id"], ascending=[False, True])
    return Vocabulary(top["id"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64), sums[0], sums[1], texts)


def _sequence(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(inputs, targets) of a text: the start and its words; its words and the end."""
    return np.concatenate([[START], codes]).astype(np.int32), np.concatenate([codes, [0]]).astype(np.int32)


ENCODED = "row_id long, doc_id long, n_tokens long, n_known long, base double, inside double, codes binary, rare array<long>, turn int"


def _encode(shared) -> object:
    """Texts as codes, with what the broadcast counts say of them: tokens known, logs of counts, logs of words within their shapes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocab = shared.value
        first, made = TaskContext.get().partitionId() << 40, 0
        within = -np.log10(vocab.tail_n + vocab.tail_v + 1.0)
        for f in frames:
            doc_ids, turns, rows = f["doc_id"].astype("Int64"), f["turn"].tolist(), []
            for group in text_groups(f["text"]):
                words, cut = word_hashes(group, shaped=True)
                codes, counts = vocab.find(words)
                found = counts >= 0
                logs = np.where(found, np.log10(np.maximum(counts, 0) + 1.0), 0.0)
                shape = codes - CLASSES * SIZE
                inside = np.where(shape >= 0, logs + within[np.maximum(shape, 0)], 0.0)
                base_sums, inside_sums, known_sums = (np.concatenate([[0], np.cumsum(x)]) for x in (logs, inside, found))
                packed = codes.astype("<u2")
                for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
                    known, rare = known_sums[b] - known_sums[a], words[a:b][~found[a:b]].view(np.int64)
                    rows.append((b - a + 1, known + (vocab.texts > 0), base_sums[b] - base_sums[a] + math.log10(vocab.texts + 1), inside_sums[b] - inside_sums[a], packed[a:b].tobytes(), rare))
            out = pd.DataFrame(rows, columns=["n_tokens", "n_known", "base", "inside", "codes", "rare"])
            out.insert(0, "row_id", first + made + np.arange(len(rows)))
            out.insert(1, "doc_id", doc_ids.values)
            out["turn"] = turns
            made += len(rows)
            yield out

    return run


def encoded(rows: DataFrame, shared) -> DataFrame:
    """ENCODED of every row, written in folders by turn: the training round, or len(RATES) for texts that are held out."""
    draw = F.pmod(F.xxhash64(F.lit("lm"), "doc_id", "text"), F.lit(len(RATES)))
    turn = F.when(held_out(F.col("doc_id")), len(RATES)).otherwise(draw).cast("int")
    path = f"{shared_dir(rows.sparkSession)}/lm-codes-{uuid.uuid4().hex}"
    made = rows.withColumn("turn", turn).mapInPandas(_encode(shared), ENCODED)
    made.write.partitionBy("turn").parquet(path)
    return rows.sparkSession.read.schema(made.schema).parquet(path)


def _batches(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """(rows, codes) of about FLUSH tokens, more where one text has more."""
    rows, held, size = [], [], 0
    for f in frames:
        for row, codes in zip(f["row_id"].tolist(), f["codes"]):
            rows.append(row)
            held.append(np.frombuffer(codes, "<u2"))
            size += len(held[-1]) + 1
            if size >= FLUSH:
                yield rows, held
                rows, held, size = [], [], 0
    if rows:
        yield rows, held


WEIGHTS = "tokens long, weights array<binary>"


def _weights(p: gru.Params, tokens: int) -> pd.DataFrame:
    return pd.DataFrame({"tokens": [tokens], "weights": [[p[k].tobytes() for k in sorted(p)]]})


def _train(shared, rate: float) -> object:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trainer, tokens = gru.Trainer(shared.value, rate), 0
        for _, held in _batches(frames):
            pieces = [(x[i : i + STEPS], y[i : i + STEPS]) for x, y in map(_sequence, held) for i in range(0, len(x), STEPS)]
            size = sum(len(x) for x, _ in pieces)
            trainer.train([x for x, _ in pieces], [y for _, y in pieces], min(LANES, max(16, size // STEPS)))
            tokens += size
        if tokens:
            yield _weights(trainer.p, tokens)

    return run


def _mean(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One model for all of a task's models, which come one after the other."""
    total, tokens = None, 0
    for f in frames:
        for n, weights in zip(f["tokens"].tolist(), f["weights"]):
            each = [n * np.frombuffer(w, np.float32).astype(np.float64) for w in weights]
            total, tokens = each if total is None else [a + b for a, b in zip(total, each)], tokens + n
    if tokens:
        yield pd.DataFrame({"tokens": [tokens], "weights": [[(w / tokens).astype(np.float32).tobytes() for w in total]]})


def recurrent_model(codes: DataFrame, vocab: Vocabulary) -> gru.Params:
    """Weights trained on every training text once, in as many rounds as there are rates."""
    spark = codes.sparkSession
    model = gru.initial(START + 1, *vocab.biases())
    for turn, rate in enumerate(RATES):
        part = codes.where(F.col("turn") == turn).select("row_id", "codes")
        made = part.mapInPandas(_train(spark.sparkContext.broadcast(model), rate), WEIGHTS)
        trainers = part.rdd.getNumPartitions()
        while trainers > FAN:
            made = stash(made, "lm-weights")
            trainers = -(-trainers // FAN)
            made = made.repartition(trainers, F.xxhash64("weights")).mapInPandas(_mean, WEIGHTS)
        parts = sorted(made.collect(), key=lambda p: (p["tokens"], p["weights"]))
        tokens = sum(p["tokens"] for p in parts)
        if tokens:
            mean = [sum(p["tokens"] / tokens * np.frombuffer(p["weights"][i], np.float32) for p in parts) for i in range(len(model))]
            model = {k: w.astype(np.float32).reshape(model[k].shape) for k, w in zip(sorted(model), mean)}
    return model


def _score(shared) -> object:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, held in _batches(frames):
            sequences = [_sequence(codes) for codes in held]
            yield pd.DataFrame({"row": rows, "log": gru.score(shared.value, [x for x, _ in sequences], [y for _, y in sequences]) / math.log(10)})

    return run


def score_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs.

    Learned from all texts that aren't held out. Null and empty texts are one end token. Rows that share a doc_id are scored
    each. With no training text every base term is log10(1 / 1), and an empty table gives no rows. Scores are base-10 logs;
    very long texts are scored whole, state and all, and train in pieces of STEPS words.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    training = rows.where(~held_out(F.col("doc_id"))).select("text")
    lexicon = lexicon_of(training)
    vocab = vocabulary(lexicon, training.count())
    codes = encoded(rows, spark.sparkContext.broadcast(vocab))
    model = recurrent_model(codes, vocab)
    logs = codes.select("row_id", "codes").mapInPandas(_score(spark.sparkContext.broadcast(model)), "row long, log double")
    rare = codes.where(F.size("rare") > 0).select("row_id", F.explode("rare").alias("id")).join(lexicon, "id")
    rare = rare.groupBy("row_id").agg(F.count("*").alias("more_known"), F.sum(F.log10(F.col("n") + 1.0)).alias("more"))
    more = F.coalesce("more", F.lit(0.0))
    facts = codes.drop("codes", "rare").join(rare, "row_id", "left").join(logs, F.col("row_id") == F.col("row"))
    return facts.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(vocab.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * F.lit(math.log10(vocab.tokens + vocab.types + 1))).alias("base_score"), (F.col("log") + F.col("inside") + more).alias("score"),
    )


def op10_gru_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
