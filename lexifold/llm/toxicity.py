"""Operator 8: toxicity after noisy-channel deobfuscation.

A character language model is counted over all texts. Tokens written in leetspeak, with separators or spaces between letters, or
with repeated letters become lattices of what may have been meant; Viterbi search takes the reading that the model and the
channel's costs make likeliest. The restored words and their stems are scored by what labels say of them. Plain words, nearly all
of a text, are found and hashed for whole batches of texts at once; only the others are read one by one.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, small_batches, stash, table
from .textkit import mix64, powers

#: Slots of the hashed counts of character runs (fixed size, so broadcast is bounded), and the run's length.
SLOTS, ORDER = 1 << 18, 4
#: Labelled rows that the classifier is fitted on about, chosen by a hash where there are more; features of words kept at most.
SAMPLE, FEATURES = 20_000, 1 << 16
#: What may stand for a letter.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l"}
#: Costs of the channel, in natural log units: a substitution, a dropped separator, a boundary, a shortened repetition, a kept mark.
SWAP, DROP, SPLIT, SHORTEN, KEEP = 1.0, 0.7, 1.5, 0.5, 6.0
STEMS = (3, 4, 5, 6)
#: Strength of the prior on a feature's rate of label 1.
PRIOR = 4.0

#: Characters of texts handled together, and of tokens whose reading is kept; steps of the character model that are kept; texts of
#: the sample whose features are held together.
GROUP, KEPT, STEPS_KEPT, ROWS = 1 << 18, 1 << 20, 1 << 15, 256

_WORDS = re.compile(r"[^\W\d_]+")
_EDGE = re.compile(r"^(?:[^\w@$!|+€£]|[@$!|+€£](?=[^\w])|_)+|(?:[^\w@$|+€£]|_|[@$|+€£]{3,})+$")
_UNIT, _GAP = r"(?:[^\W_]|[@$!|+€£])", r"[\x20.\-_*]{1,2}"
#: Two or more lone letters or signs, and the longer tokens next to them: words may be spaced in part only ("l o ser", "idi o t").
_SPACED = re.compile(rf"(?<![^\W_])(?:(?<![@$!|+€£])({_UNIT}{{2,}}+{_GAP}))?({_UNIT}(?:{_GAP}{_UNIT})+)(?![^\W_])({_GAP}{_UNIT}{{2,}}+)?")
_FIRST, _LAST, _GAPS = re.compile(rf"{_UNIT}{_GAP}"), re.compile(rf"{_GAP}{_UNIT}\Z"), re.compile(_GAP)
_CLEAN = re.compile(r"(?:([^\W\d_])(?!\1\1))+\Z")
#: Where a long text may be cut: no token and no run of spaced letters goes on over two letters, a space and two letters.
_CUT = re.compile(r"[^\W\d_]{2}[\x20\x09-\x0D](?=[^\W\d_]{2})")

# kinds of characters, as bits; what lies past 16 bits may be a letter and counts as hard, which means: read one by one
_ALPHA, _HARD, _BANG, _SPACE, _SPACER, _ALNUM = 1, 2, 4, 8, 16, 32
_KIND = np.zeros(1 << 16, np.uint8)
for _i in range(1 << 16):
    _c = chr(_i)
    _KIND[_i] = (_ALPHA * _c.isalpha() | _ALNUM * _c.isalnum() | _HARD * (not _c.isalpha() and (_c.isalnum() or _c in LEET or _c == "_")) | _SPACER * (_c in " .-_*")) if not 0xD800 <= _i < 0xE000 else _HARD
_KIND[ord("!")] = _BANG
_KIND[[0x20, *range(0x09, 0x0E)]] |= _SPACE
_KIND[0xFFFF] = _ALPHA | _HARD
_CHARACTER = np.random.Generator(np.random.PCG64(20240503)).integers(1, 1 << 63, 1 << 16, np.int64).astype(np.uint64)


def _slots(codes: np.ndarray, length: int) -> np.ndarray:
    """Slots of all runs of `length` characters; boundaries are 0."""
    with np.errstate(over="ignore"):
        h = codes[: len(codes) - length + 1].copy()
        for j in range(1, length):
            h = h * np.uint64(0x100000001B3) + codes[j : len(codes) - length + 1 + j]
        return (mix64(h) % np.uint64(SLOTS)).astype(np.int64)


def _slot(codes: list[int]) -> int:
    """The slot of one run, as _slots has it."""
    h, mask = 0, (1 << 64) - 1
    for c in codes:
        h = (h * 0x100000001B3 + c) & mask
    h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & mask
    h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & mask
    return (h ^ (h >> 31)) % SLOTS


def _codes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(_KIND[np.minimum(raw, 0xFFFF)] & (_ALPHA | _HARD) == _ALPHA, raw, 0).astype(np.uint64)
    return codes[(codes != 0) | (np.concatenate([codes[:1] * 0 + 1, codes[:-1]]) != 0)]  # one boundary between words


def _count_runs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts = np.zeros((2, SLOTS), np.int64)
    for f in frames:
        held, size = [], 0
        for text in [*f["text"], None]:
            if text:
                held.append(text)
                size += len(text)
            if held and (text is None or size > 1 << 18):
                codes = _codes("\x00\x00\x00" + "\x00".join(held) + "\x00")
                codes = np.concatenate([np.zeros(2, np.uint64), codes])
                for i, n in enumerate((ORDER, ORDER - 1)):
                    if len(codes) >= n:
                        counts[i] += np.bincount(_slots(codes, n), minlength=SLOTS)
                held, size = [], 0
    for part in range(16):
        yield pd.DataFrame({"part": [part], "counts": [counts[:, part * SLOTS // 16 : (part + 1) * SLOTS // 16].tobytes()]})


def _sum_runs(f: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(c, np.int64) for c in f["counts"])
    return pd.DataFrame({"part": f["part"].iloc[:1], "counts": [total.tobytes()]})


class CharacterModel:
    """P(character | three before) from hashed counts of all texts."""

    def __init__(self, counts: np.ndarray):
        self.log = np.log((counts[0] + 0.05)).astype(np.float32)
        self.context = np.log(counts[1] + 0.05 * 64).astype(np.float32)
        self.memo: dict[str, float] = {}
        self.moves: dict[tuple[str, str], tuple[float, str]] = {}

    def __getstate__(self):
        return self.__dict__ | {"memo": {}, "moves": {}}

    def logp(self, run: str) -> float:
        """Of the last character of a run of four after the first three; a space is a boundary."""
        if (found := self.memo.get(run)) is None:
            codes = [0 if c == " " else ord(c) for c in run]
            found = float(self.log[_slot(codes)]) - float(self.context[_slot(codes[:-1])])
            if len(self.memo) > STEPS_KEPT:
                self.memo.clear()
            self.memo[run] = found
        return found

    def forget(self) -> None:
        """Let go of what is kept: workers keep the model from one task to the next."""
        self.memo.clear()
        self.moves.clear()

    def move(self, state: str, out: str) -> tuple[float, str]:
        """(log probability of what is put out after a state of three characters, state after it); boundaries in a row are one."""
        total, s = 0.0, state
        for c in out:
            if not (c == " " and s[-1] == " "):
                total += self.logp(s + c)
                s = s[1:] + c
        if len(self.moves) > STEPS_KEPT:
            self.moves.clear()
        self.moves[state, out] = found = (total, s)
        return found


def character_model(docs: DataFrame) -> CharacterModel:
    """Counted over every whole text; tasks add up tables of fixed size, of which the driver gets the sum (4 MB)."""
    counted = docs.select(F.col("text").alias("text")).mapInPandas(lean(_count_runs), "part int, counts binary")
    with small_batches(docs.sparkSession):
        parts = counted.groupBy("part").applyInPandas(_sum_runs, "part int, counts binary").orderBy("part").collect()
    pieces = [np.frombuffer(p["counts"], np.int64).reshape(2, -1) for p in parts]
    return CharacterModel(np.concatenate(pieces, 1) if pieces else np.zeros((2, SLOTS), np.int64))


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each run of equal characters what it may stand for, with costs. A sign for a letter may also be a mark between letters, which
    is dropped, if it stands alone among letters and digits, else a boundary."""
    steps, runs = [], list(re.finditer(r"(.)\1*", token, re.S))
    for i, m in enumerate(runs):
        c, n = m[1], len(m[0])
        if c.isalpha():
            steps.append([(c, 0.0)] if n == 1 else [(c * 2, 0.0 if n == 2 else SHORTEN), (c, SHORTEN)])
        elif c in LEET:
            alone = n == 1 and all(runs[j][1].isalnum() for j in (i - 1, i + 1) if 0 <= j < len(runs))
            mark = (" ", KEEP) if c.isdigit() else ("" if alone else " ", 4 * DROP)
            steps += [[*((x, SWAP) for x in LEET[c]), mark]] * min(n, 2)
        elif c == " " and n > 1:  # a wide gap among spaced letters is likelier a boundary
            steps.append([("", SPLIT), (" ", DROP)])
        else:
            steps.append([("", DROP), (" ", SPLIT)])
    return steps


def _back(trail: list[dict], state: str, least: int = 0) -> list[str]:
    """What the best way to a state after the last step of a trail put out from step `least` on."""
    out = []
    for now in reversed(trail[least:]):
        _, state, text = now[state]
        out.append(text)
    return out[::-1]


def decode(token: str, model: CharacterModel) -> str:
    """The best reading of a token: Viterbi search over the last three characters, with back pointers. Where one state is left, or
    all ways have a step in common, what came before is settled, so that long tokens take little memory."""
    states, trail, settled, moves = {"   ": (0.0, "", "")}, [], [], model.moves
    for options in lattice(token):
        if len(states) == 1:
            (last,) = states
            settled += _back(trail, last)
            trail = []
            if len(options) == 1 and len(options[0][0]) == 1:
                settled.append(options[0][0])
                states = {last[1:] + options[0][0]: (0.0, "", "")}
                continue
        ahead: dict[str, tuple[float, str, str]] = {}
        for state, (score, _, _) in states.items():
            for out, cost in options:
                more, s = moves.get((state, out)) or model.move(state, out)
                total, other = score - cost + more, ahead.get(s)
                if other is None or total > other[0]:
                    ahead[s] = (total, state, out)
        states = ahead
        trail.append(ahead)
        if len(trail) % 512 == 0:
            on, at = set(states), len(trail)
            while at and len(on) > 1:
                at -= 1
                on = {trail[at][s][1] for s in on}
            if at:
                settled += _back(trail[:at], on.pop())
                trail = trail[at:]
    best = max(states, key=lambda s: states[s][0] + model.logp(s + " ") * (s[-1] != " "))
    return "".join([*settled, *_back(trail, best)]).strip()


def spans(before: str | None, run: str, after: str | None) -> list[str]:
    """What may be spelled out where lone letters stand between longer tokens: the run, and the run with the token on either side,
    each also without the letter at its far end where a space is next to it: it may be a word of its own ("a l o s e r")."""
    n, first, last = len(_GAPS.findall(run)) + 1, _FIRST.match(run)[0], _LAST.search(run)[0]
    later, earlier = [run[len(first) :]] * (" " in first), [run[: -len(last)]] * (" " in last)
    out = [run] * (n > 2) + (later + earlier) * (n > 3)
    if after:
        out += [x + after for x in [run] + later * (n > 2)]
    if before:
        out += [before + x for x in [run] + earlier * (n > 2)]
    return [x for x in out if re.search(r"[^\W_]", x)]


class Restorer:
    """Words of texts as they were meant."""

    def __init__(self, model: CharacterModel):
        self.model, self.memo, self.size = model, {}, 0

    def token(self, token: str) -> tuple[str, ...]:
        if (words := self.memo.get(token)) is None:
            core = _EDGE.sub("", token)
            if not any(c.isalpha() for c in core):
                words = ()
            else:
                words = (core,) if _CLEAN.match(core) else tuple(_WORDS.findall(decode(core, self.model)))
            if len(token) <= 64:
                self.size += len(token) + 16
                if self.size > KEPT:
                    self.memo.clear()
                    self.size = len(token) + 16
                self.memo[token] = words
        return words

    def spaced(self, text: str) -> list[str]:
        """Words spelled with spaces or marks between letters of a text in lower case: of each span the likeliest reading, and that
        in which all gaps are dropped."""
        out = []
        for m in _SPACED.finditer(text):
            for span in spans(*m.groups()):
                out += [*_WORDS.findall(decode(span, self.model)), *self.token(_GAPS.sub("", span))]
        return out

    def found(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of the text, hashes of the features) of all words of texts in lower case; a word may come several times."""
        joined = "\n".join(texts)
        raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        kind = _KIND[np.minimum(raw, 0xFFFF)]
        edge = np.diff((kind & _SPACE != 0).astype(np.int8), prepend=1, append=1)
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        alpha = kind & _ALPHA != 0
        at = np.flatnonzero(alpha)
        upto = lambda x: np.concatenate([[0], np.cumsum(x, dtype=np.int32)])
        letters, hard, bang = upto(alpha), upto(kind & _HARD != 0), upto(kind & _BANG != 0)
        some = letters[end] > letters[start]
        start, end = start[some], end[some]
        first, last = at[letters[start]], at[letters[end] - 1] + 1
        again = np.zeros(len(raw) + 2, bool)
        again[2 : len(raw)] = (raw[2:] == raw[1:-1]) & (raw[2:] == raw[:-2]) if len(raw) > 2 else False
        again = upto(again[: len(raw)])
        clean = (letters[end] - letters[start] == last - first) & (hard[end] == hard[start]) & (bang[first] == bang[start])
        clean &= again[last] == again[np.minimum(first + 2, last)]
        owners, hashes = [np.searchsorted(begins, start[clean], "right") - 1], [hashed_features(raw, first[clean], last[clean])]

        words, of = [], []
        for i, a, b in zip((np.searchsorted(begins, start[~clean], "right") - 1).tolist(), start[~clean].tolist(), end[~clean].tolist()):
            more = self.token(joined[a:b])
            words += more
            of += [i] * len(more)
        for i in self._spaced_texts(kind, begins):
            more = self.spaced(texts[i])
            words += more
            of += [i] * len(more)
        if words:
            owners.append(np.array(of))
            hashes.append(features(words))
        return np.concatenate(owners), np.concatenate(hashes)

    @staticmethod
    def _spaced_texts(kind: np.ndarray, begins: np.ndarray) -> list[int]:
        """Texts that may have two spaced letters or signs next to each other."""
        kind = np.concatenate([np.zeros(4, np.uint8), kind, np.zeros(4, np.uint8)])
        sign = kind & (_ALNUM | _HARD | _BANG) != 0
        gap = kind & _SPACER != 0
        alnum = kind & _ALNUM != 0
        i = np.flatnonzero(sign[4:-4] & ~alnum[3:-5] & gap[5:-3]) + 4
        after = (sign[i + 2] & ~alnum[i + 3]) | (gap[i + 2] & sign[i + 3] & ~alnum[i + 4])
        return np.unique(np.searchsorted(begins, i[after] - 4, "right") - 1).tolist()

    def words(self, text: str) -> set[str]:
        """The restored words of one text."""
        text = text.lower()
        return {*self.spaced(text), *(w for t in re.split(r"[\x20\x09-\x0D]+", text) for w in self.token(t))} - {""}


def hashed_features(raw: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of the words raw[first:last] and of their stems, which are 0 for words that are shorter: a column each."""
    power, inverse = powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_CHARACTER[raw & 0xFFFF] * power[: len(raw)], out=total[1:])
    base, scale = total[first], inverse[first]
    out = np.zeros((len(first), 1 + len(STEMS)), np.uint64)
    high = np.uint64(1 << 63)  # set in all hashes, so that none is 0
    out[:, 0] = mix64((total[last] - base) * scale) | high
    for i, k in enumerate(STEMS, 1):
        long = last - first >= k
        out[long, i] = mix64((total[first[long] + k] - base[long]) * scale[long] + np.uint64(k)) | high
    return out


def features(words: list[str]) -> np.ndarray:
    raw = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    end = np.cumsum([len(w) for w in words])
    return hashed_features(raw, end - [len(w) for w in words], end)


def _groups(texts: Iterable[str | None]) -> Iterator[tuple[list[str], list[int]]]:
    """(texts in lower case, number of each) of about GROUP characters; longer texts in pieces that no word or run spans."""
    held, numbers, size = [], [], 0
    for i, text in enumerate(texts):
        text, at = (text or "").lower(), 0
        while True:
            cut = _CUT.search(text, at + GROUP) if len(text) - at > GROUP else None
            end = cut.end() if cut else len(text)
            held.append(text[at:end])
            numbers.append(i)
            size += end - at
            if size >= GROUP:
                yield held, numbers
                held, numbers, size = [], [], 0
            at = end
            if not cut:
                break
    if held:
        yield held, numbers


def text_features(texts: Iterable[str | None], restorer: Restorer, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, feature), once each and sorted; with known, sorted hashes, only these, by their place in it."""
    owners, found = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    some = np.ones(1 << 20, bool)
    if known is not None:
        some[:] = False
        some[known >> np.uint64(44)] = True
    some[0] = False  # no feature has such a hash
    for group, numbers in _groups(texts):
        owner, hashes = restorer.found(group)
        near = np.flatnonzero(some[hashes.ravel() >> np.uint64(44)])
        owner, hashes = np.array(numbers)[owner[near // hashes.shape[1]]], hashes.ravel()[near]
        if known is not None:
            at = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
            hit = known[at] == hashes if len(known) else np.zeros(len(at), bool)
            key = np.unique((owner[hit] << 32) | at[hit])
            owner, hashes = key >> 32, (key & 0xFFFFFFFF).astype(np.uint64)
        owners.append(owner)
        found.append(hashes)
    owner, found = np.concatenate(owners), np.concatenate(found)
    order = np.lexsort((found, owner))
    owner, found = owner[order], found[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (found[1:] != found[:-1])
    return owner[new], found[new]


def _sampled(model) -> object:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restorer = Restorer(model.value)
        for f in frames:
            for i in range(0, len(f), ROWS):
                part = f.iloc[i : i + ROWS]
                owner, found = text_features(part["text"], restorer)
                cuts = np.searchsorted(owner, np.arange(len(part) + 1))
                yield pd.DataFrame({"toxic": part["toxic"], "features": [found[a:b].view(np.int64) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]})
        restorer.model.forget()

    return run


def evidence(p: np.ndarray, n: np.ndarray, rate: float) -> np.ndarray:
    """Log lift of label 1 where a feature is found in p rows with label 1 and n with label 0."""
    return np.log((p + PRIOR * rate) / (n + PRIOR * (1 - rate))) - np.log(rate / (1 - rate))


#: Ranks of a document's evidence that the score sees: of its best word, of some words, of several.
RANKS = (0, 4, 9, 19)


def ranked(owner: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """(n, ranks): of each of n rows its values of these ranks, from 0 up; 0 where there are fewer. owner is sorted."""
    order = np.lexsort((-values, owner))
    owner, values = owner[order], values[order]
    place = np.arange(len(owner)) - np.searchsorted(owner, owner)
    out = np.zeros((n, len(RANKS)))
    for i, r in enumerate(RANKS):
        out[owner[place == r], i] = np.maximum(values[place == r], 0.0)
    return out


def _left_out(known, rate: float) -> object:
    """The ranks of each sampled row by counts without itself."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, p, n = known.value
        for f in frames:
            owner = np.repeat(np.arange(len(f)), [len(x) for x in f["features"]])
            own, toxic = np.concatenate([np.empty(0, np.int64), *f["features"]]).view(np.uint64), f["toxic"].to_numpy()
            at = np.minimum(np.searchsorted(names, own), max(len(names) - 1, 0))
            hit = names[at] == own if len(names) else np.zeros(len(own), bool)
            owner, at = owner[hit], at[hit]
            out = pd.DataFrame(ranked(owner, evidence(p[at] - toxic[owner], n[at] - (1 - toxic[owner]), rate), len(f)), columns=[f"r{r}" for r in RANKS])
            out.insert(0, "toxic", toxic)
            yield out

    return run


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Logistic regression by Newton's method, with an intercept, weights from 0 up: more evidence never lowers a score."""
    x, live = np.c_[np.ones(len(x)), x], list(range(x.shape[1] + 1))
    while True:
        w = np.zeros(x.shape[1])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            slope = x[:, live].T @ (p - y) + ridge * w[live]
            step = np.linalg.solve((x[:, live] * (p * (1 - p))[:, None]).T @ x[:, live] + ridge * np.eye(len(live)), slope)
            w[live] -= np.clip(step, -2, 2)
        if all(w[i] >= 0 for i in live[1:]):
            return w
        live = [0, *(i for i in live[1:] if w[i] > 0)]


#: The character model, hashes of features, their evidence, and weights of the ranks.
Fitted = tuple[CharacterModel, np.ndarray, np.ndarray, np.ndarray]


def toxicity_model(docs: DataFrame, labels: DataFrame) -> Fitted:
    """Labels count only of rows whose crc32(doc_id) mod 5 isn't 0; the fit takes at most SAMPLE of them, all if there are fewer, and
    keeps at most FEATURES features, those of the greatest lift, which two rows with label 1 must have. Null labels and labels
    without a document are passed over."""
    spark = docs.sparkSession
    model = character_model(docs)
    marks = labels.select(F.col("doc_id").alias("of"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isNotNull() & ~held_out(F.col("of")))
    marks = stash(marks.groupBy("of").agg(F.max("toxic").alias("toxic")), "toxic-labels")
    share = min(1.0, 0.95 * SAMPLE / max(1, marks.count()))
    if share < 1:
        marks = marks.where(F.pmod(F.xxhash64("of"), F.lit(1 << 20)) < int(share * (1 << 20)))
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text")).join(F.broadcast(marks), F.col("doc_id") == F.col("of")).select("text", "toxic")
    sample = stash(rows.mapInPandas(lean(_sampled(shared)), "toxic int, features array<long>"), "toxic-sample")
    size, toxic = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    rate = (toxic + 0.5) / (size + 1)
    counts = sample.select("toxic", F.explode("features").alias("feature")).groupBy("feature").agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("n"))
    lift = (F.col("p") + PRIOR * rate) / (F.col("n") + PRIOR * (1 - rate))
    top = counts.where("p >= 2").where(lift > 2 * rate / (1 - rate)).orderBy(lift.desc(), "feature").limit(FEATURES).toPandas()
    names = top["feature"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(names)
    names, p, n = names[order], top["p"].to_numpy(np.int64)[order], top["n"].to_numpy(np.int64)[order]
    known = spark.sparkContext.broadcast((names, p, n))
    ranks = sample.mapInPandas(_left_out(known, rate), "toxic int, " + ", ".join(f"r{r} double" for r in RANKS)).toPandas().to_numpy(float).reshape(-1, len(RANKS) + 1)
    weights = fit(ranks[:, 1:], ranks[:, 0]) if 0 < toxic < size else np.r_[np.log(rate / (1 - rate)), np.ones(1), np.zeros(len(RANKS) - 1)]
    return model, names, evidence(p, n, rate), weights


def score_column(spark: SparkSession, fitted: Fitted):
    """A pandas UDF from texts to scores."""
    shared = spark.sparkContext.broadcast(fitted)

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model, known, lift, weights = shared.value
        restorer = Restorer(model)
        for texts in batches:
            owner, place = text_features(texts, restorer, known)
            z = weights[0] + ranked(owner, lift[place.astype(np.int64)], len(texts)) @ weights[1:]
            yield pd.Series(1 / (1 + np.exp(-z)), dtype=float)
        model.forget()

    return score


def held_out(doc_id):
    return F.pmod(F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")), F.lit(5)) == 0


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(row, held_out, score, predicted): row is a struct of all columns of a row of docs.

    Every whole text is restored and scored; its length doesn't matter to the score. Null and empty texts have the score of no
    evidence; repeated rows have equal scores; a null doc_id counts as empty text for held_out. Without labels of both kinds
    the score is the smoothed rate of label 1, raised by evidence. An empty table gives no rows.
    """
    score = score_column(docs.sparkSession, toxicity_model(docs, labels))
    rows = docs.select(F.struct("*").alias("row"), score(F.col("text")).alias("score"))
    return rows.select("row", held_out(F.col("row.doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that aren't predicted toxic, written once."""
    return stash(score_toxicity(docs, labels).where("predicted = 0").select("row.*"), "clean-documents")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("row.doc_id", "held_out", "score", "predicted")
