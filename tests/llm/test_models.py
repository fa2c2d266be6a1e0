from __future__ import annotations

import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexifold.llm import gru, lm_scoring, toxicity

from .conftest import documents


def plain_log_likelihood(p, inputs, targets):
    """One sequence through the network, a step at a time, with whole softmaxes."""
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    softmax = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    h, total, (classes, size), m = np.zeros(gru.HIDDEN), 0.0, p["word_bias"].shape, gru.HIDDEN
    for x, y in zip(inputs, targets):
        a, u = p["input"][x].astype(float), p["state"].astype(float) @ h
        z, r = sigmoid(a[:m] + u[:m]), sigmoid(a[m : 2 * m] + u[m : 2 * m])
        n = np.tanh(a[2 * m :] + r * u[2 * m :])
        h = (1 - z) * n + z * h
        k = y // size if y < classes * size else classes + y - classes * size
        total += np.log(softmax(p["classes"] @ h + p["class_bias"])[k])
        if y < classes * size:
            total += np.log(softmax(p["words"][k] @ h + p["word_bias"][k])[y % size])
    return total


def shaken(p, seed, dtype=np.float32):
    r = np.random.default_rng(seed)
    return {k: (v.astype(np.float64) + r.normal(0, 0.3, v.shape)).astype(dtype) for k, v in p.items()}


def test_gradients_are_those_of_the_loss():
    r = np.random.default_rng(0)
    p = shaken(gru.initial(10, np.log(np.full(5, 0.2)), np.log(np.full((3, 4), 0.25))), 0, np.float64)
    targets = [r.integers(0, 14, n) for n in (5, 17, 6, 3)]
    inputs = [np.r_[9, t[:-1] % 10] for t in targets]
    lanes = gru.Lanes(inputs, targets, 3)
    (at, live), *rest = lanes.windows()
    assert not rest
    h, keep, n = np.zeros((gru.HIDDEN, 3)), (~lanes.fresh[at]).astype(float), sum(map(len, targets))
    loss = lambda p: -sum(plain_log_likelihood(p, x, y) for x, y in zip(inputs, targets)) / n
    g, _, found = gru._gradients(p, lanes.x[at], lanes.y[at], live, keep, h)
    assert found == pytest.approx(loss(p), rel=1e-9)
    for k in p:
        for _ in range(4):
            at = tuple(r.integers(0, s) for s in p[k].shape)
            step = {a: v.copy() for a, v in p.items()}
            step[k][at] += 1e-4
            up = loss(step)
            step[k][at] -= 2e-4
            assert g[k][at] == pytest.approx((up - loss(step)) / 2e-4, abs=1e-6)


@pytest.mark.parametrize("steep", [1, 40])
def test_scores_against_a_plain_loop(steep):
    r = np.random.default_rng(1)
    p = shaken(gru.initial(20, np.zeros(6), np.zeros((4, 4))), 1)
    p["class_bias"] *= steep
    p["classes"] *= steep
    targets = [r.integers(0, 18, n) for n in (1, 90, 33, 32, 7, 200)]
    inputs = [np.r_[19, t[:-1]] for t in targets]
    expect = [plain_log_likelihood(p, a, b) for a, b in zip(inputs, targets)]
    for n in (1, 3, 50):
        assert gru.score(p, inputs, targets, n) == pytest.approx(expect, rel=1e-4)
    probabilities = np.exp([gru.score(p, [np.array([19])], [np.array([t])], 1)[0] for t in range(18)])
    assert probabilities.sum() == pytest.approx(1, rel=1e-5)


def test_counts_and_scores_against_plain_ones(spark, odd_texts, words, monkeypatch):
    monkeypatch.setattr(lm_scoring, "KNOWN", 50)
    texts = odd_texts + [" ".join(words(40, i) + ["The.", "end,"]) for i in range(60)]
    docs = documents(spark, texts).withColumn("score", F.lit("clash")).withColumn("row_id", F.lit("clash"))
    used = {}

    def fixed(codes, vocab):
        used["model"] = shaken(gru.initial(lm_scoring.START + 1, *vocab.biases()), 2)
        used["vocab"] = vocab
        return used["model"]

    monkeypatch.setattr(lm_scoring, "recurrent_model", fixed)
    got = {r.doc_id: r for r in lm_scoring.score_documents(docs).collect()}
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low)) + [None] for t in texts]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    c = Counter(x for t, h in zip(tokens, held) if not h for x in t)
    n, v = sum(c.values()), len(c)
    assert len(got) == len(texts)
    for i, t in enumerate(tokens):
        assert (got[i].held_out, got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (held[i], len(t), sum(c[x] > 0 for x in t), n)
        assert got[i].base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in t))
    # the score: the network over codes, and the smoothed counts of words without a place among those of their shape
    vocab, hashed = used["vocab"], dict(zip([x for t in tokens for x in t[:-1]], np.concatenate(list(lm_scoring._token_lists(texts))).tolist()))
    place = {int(h): int(r) for h, r in zip(vocab.ids, vocab.rank) if r > 0}
    assert 0 < len(place) <= 50
    shapes = {x: int(hashed[x]) & 7 for x in hashed}
    rest = Counter({s: 0 for s in range(6)})
    types = Counter()
    for x, k in c.items():
        if x is not None and hashed[x] not in place:
            rest[shapes[x]] += k
            types[shapes[x]] += 1
    for i in (0, 3, 7, 20, 41):
        words = tokens[i][:-1]
        codes = [place.get(hashed[x], lm_scoring.CLASSES * lm_scoring.SIZE + shapes[x]) for x in words]
        inside = sum(math.log10((c[x] + 1) / (rest[shapes[x]] + types[shapes[x]] + 1)) for x in words if hashed[x] not in place)
        assert got[i].score == pytest.approx(plain_log_likelihood(used["model"], [lm_scoring.START, *codes], [*codes, 0]) / math.log(10) + inside, rel=1e-4)


def test_all_training_texts_train(spark, words, monkeypatch):
    seen = spark.sparkContext.accumulator(0)
    plain = lm_scoring._weights
    monkeypatch.setattr(lm_scoring, "FAN", 2)

    def counted(p, tokens):
        seen.add(tokens)
        return plain(p, tokens)

    monkeypatch.setattr(lm_scoring, "_weights", counted)
    texts = [" ".join(words(5 + i % 90, i)) for i in range(200)] + [" ".join(words(5000, 999))]
    rows = lm_scoring.score_documents(documents(spark, texts).repartition(6)).collect()
    assert seen.value == rows[0].train_tokens == sum(r.n_tokens for r in rows if not r.held_out)
    # the network knows more than a model that starts from counts
    monkeypatch.setattr(lm_scoring, "RATES", (0.0,))
    start = {r.doc_id: r.score for r in lm_scoring.score_documents(documents(spark, texts)).collect()}
    assert sum(r.score for r in rows) > sum(start.values())


def test_training_learns_what_follows_what():
    r = np.random.default_rng(3)
    texts = [np.array([(s + i) % 5 + 1 for i in range(40)]) for s in r.integers(0, 5, 80)]
    inputs = [np.r_[19, t[:-1]] for t in texts]
    start = gru.initial(20, np.zeros(6), np.zeros((4, 4)))
    trainer = gru.Trainer(start, 0.01)
    for _ in range(6):
        trainer.train(inputs, texts, 8)
    assert gru.score(trainer.p, inputs[:5], texts[:5]).sum() > 0.5 * gru.score(start, inputs[:5], texts[:5]).sum()


def test_scoring_small_tables(spark):
    assert lm_scoring.score_documents(documents(spark, ["x"]).limit(0)).count() == 0
    rows = lm_scoring.score_documents(documents(spark, ["a b", "a b", None], ids=[1, 1, None])).collect()
    assert len(rows) == 3 and len({r.score for r in rows if r.doc_id == 1}) == 1


def test_decoding_of_obfuscated_words(spark, words):
    plain = " ".join(["idiot worthless moron pathetic stupid clown trash"] * 30)
    model = toxicity.character_model(documents(spark, [plain, " ".join(words(500, 1)), None, ""]))
    found = toxicity.Restorer(model)
    for token, word in {"1d10t": "idiot", "w0rthle$$": "worthless", "m.o.r.o.n": "moron", "id10t###": "idiot", "clooown": "clown", "TR4SH!!": "trash", "p@thetic": "pathetic", "5tup1d": "stupid"}.items():
        assert found.words(token) == {word}, token
    assert "idiot" in found.words("you are an i d i o t now") and found.words("plain words stay.") == {"plain", "words", "stay"}
    assert found.words("") == set() and found.words("%%% ... 123") == set()


def all_readings(token):
    """(cost, text) of every way through a token's lattice."""
    ways = [(0.0, "")]
    for options in toxicity.lattice(token):
        ways = [(cost + c, text + out) for cost, text in ways for out, c in options]
    return ways


def test_viterbi_against_all_readings(spark, words):
    model = toxicity.character_model(documents(spark, [" ".join(words(3000, 1)), "idiot scum moron " * 40]))
    assert all(model.log[toxicity._slots(np.array([ord(c) for c in run], np.uint64), 4)[0]] == model.log[toxicity._slot([ord(c) for c in run])] for run in ("idio", "zzzz", "él!~"))

    def log_likelihood(cost, text):
        total, state = -cost, "   "
        for c in text + " ":
            if not (c == " " and state[-1] == " "):
                total += model.logp(state + c)
                state = state[1:] + c
        return total

    r = np.random.default_rng(4)
    tokens = ["1d10t", "m.o.r.o.n", "$cuuum", "a1b2c3d", "i$d$i", "1010110", "s c u m", "s  c u m"] + ["".join(r.choice(list("abio01$!.- 4e3"), n)).strip() for n in r.integers(2, 9, 120)]
    for token in tokens:
        found = toxicity.decode(token, model)
        best = max(log_likelihood(*way) for way in all_readings(token))
        assert any(text.strip() == found and log_likelihood(cost, text) == pytest.approx(best, abs=1e-9) for cost, text in all_readings(token)), token


def test_decoding_of_long_tokens_takes_steady_time(spark, words):

    model = toxicity.character_model(documents(spark, [" ".join(words(3000, 1))]))
    r = np.random.default_rng(4)
    for letters in ("abcdefghijk0123456789", "@$!|+€£a1i", "1"):
        token = "".join(r.choice(list(letters), 60_000)) + "x"
        began = time.process_time()
        assert toxicity.decode(token, model)
        assert time.process_time() - began < 10
    # survivors without a common state for long are settled in parts
    assert toxicity.decode("a1" * 3000, model) == toxicity.decode("a1" * 200, model)[:6] + toxicity.decode("a1" * 3000, model)[6:]


def test_features_of_batches_are_those_of_words(spark, words, odd_texts, monkeypatch):
    model = toxicity.character_model(documents(spark, [" ".join(words(3000, 1)), "idiot scum moron " * 40]))
    texts = odd_texts + ["You 1d10t! (what) an i d i o t; 'quoted', don't _x_ ²x Ⅷ 𝐚𝐛 aaa baaad e-mail 12 $$$ !no ok!!", "s.t.u.p.1.d\nx y\tz a b c", "İstanbul ﬁne ŒUVRE 中文，句子。", "!", "a", " a b ", "q w e r t y" * 300] + [" ".join(words(30, i)) + " m0ron" for i in range(9)]
    for group in (toxicity.GROUP, 500):
        monkeypatch.setattr(toxicity, "GROUP", group)
        restorer = toxicity.Restorer(model)
        owner, found = toxicity.text_features(texts, restorer)
        for i, t in enumerate(texts):
            expect = set(toxicity.features(sorted(restorer.words(t or ""))).ravel().tolist()) - {0} if restorer.words(t or "") else set()
            assert set(found[owner == i].tolist()) == expect, (group, i)
        some = np.unique(found)[::3]
        owner_2, place = toxicity.text_features(texts, restorer, some)
        hit = np.isin(found, some)
        assert owner_2.tolist() == owner[hit].tolist() and some[place.astype(int)].tolist() == found[hit].tolist()


def test_decoding_of_spaced_words(spark, words):
    plain = " ".join(["you are a loser", "you idiot", "what a stupid clown", "such scum"] * 40)
    found = toxicity.Restorer(toxicity.character_model(documents(spark, [plain, " ".join(words(500, 1))])))
    several = {"y o u i d i o t": "you idiot", "you are a l o s e r": "a loser", "y o u  a r e  a  l o s e r": "you are a loser", "$ t u p ! d": "stupid", "s.t.u.p.1.d c l o w n": "stupid clown", "s c u m": "scum", "y o u": "you"}
    for text, expect in several.items():
        assert set(expect.split()) <= found.words(text), text
    assert found.words("! ! ! + + +") == set()


def test_restoration_by_disguise(spark, words):
    insults = ["idiot", "scum", "moron", "loser", "clown", "stupid", "trash", "pathetic", "disgusting", "worthless"]
    plain = [" ".join(words(40, i) + [w] + words(40, 99 + i)) for i, w in enumerate(insults * 3)]
    restorer = toxicity.Restorer(toxicity.character_model(documents(spark, plain)))
    signs = str.maketrans("oieast", "013457")
    disguises = {
        "dots": ".".join,
        "spaces": " ".join,
        "wide": "  ".join,
        "repeats": lambda w: w[0] + w[1] * 4 + w[2:],
        "signs": lambda w: w.translate(signs),
        "spaced signs": lambda w: " ".join(w.translate(signs)),
        "half, first": lambda w: " ".join(w[:2]) + " " + w[2:],
        "half, last": lambda w: w[:-2] + " " + " ".join(w[-2:]),
    }
    for name, disguise in disguises.items():
        for sentence in ("the report says {} about this", "you are a {} and so on", "well, what a {}!"):
            restored = [w in restorer.words(sentence.format(disguise(w))) for w in insults]
            assert sum(restored) >= 0.9 * len(insults), (name, sentence, restored)


def test_spans_of_spaced_letters():
    found = lambda text: [toxicity.spans(*m.groups()) for m in toxicity._SPACED.finditer(text)]
    assert found("a dog and y a") == [["and y a"]]
    assert found("l o ser") == [["l o ser"]]
    assert found("idi o t.") == [["idi o t"]]
    assert found("a b") == [[]] and found("word other") == [] and found("! ! !") == [[]]
    assert found("a s c u m") == [["a s c u m", "s c u m", "a s c u"]]
    assert found("l o ser i d iot") == [["l o ser"], ["i d iot"]]
    began = time.process_time()
    for text in ("$" * 60_000, "a " * 60_000, "$ " * 60_000, "ab " * 60_000, "a bc " * 30_000):
        found(text)
    assert time.process_time() - began < 10


def test_toxicity_held_out(spark, words, odd_texts):
    bad = ["idiot", "scum", "moron"]
    texts, marks = list(odd_texts), [0] * len(odd_texts)
    for i in range(240):
        w = words(30 + i % 50, i)
        if i % 4 == 0:
            w[5], w[20] = bad[i % 3], "1d10t"
        texts.append(" ".join(w))
        marks.append(int(i % 4 == 0))
    docs = documents(spark, texts).withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, m) for i, m in enumerate(marks)] + [(None, 1), (9999, None)], "doc_id long, toxic int")
    rows = toxicity.score_toxicity(docs, labels).select("row.doc_id", "held_out", "score", "predicted").collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
        assert r.predicted == marks[r.doc_id] == (r.score >= 0.5)
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == marks.count(0)


def test_toxicity_without_labels(spark):
    docs = documents(spark, ["some text", None])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.score_toxicity(docs, none).collect()} <= {0, 1}
    assert toxicity.score_toxicity(docs.limit(0), none).count() == 0
