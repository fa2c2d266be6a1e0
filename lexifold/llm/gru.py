"""A gated recurrent language model in numpy: class-factored softmax, truncated backpropagation, state carried across windows.

Arrays of a window are (steps, units, lanes), so that every operation of a step runs over one piece of memory; those of targets are
(units, targets).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

HIDDEN = 16
#: Steps that gradients go back, and that are laid out at once.
WINDOW = 32
#: Places whose probabilities are worked out at once.
PLACES = 1 << 14
Params = dict[str, np.ndarray]


def initial(inputs: int, class_bias: np.ndarray, word_bias: np.ndarray, seed: int = 7) -> Params:
    """word_bias: (classes of words, words in each); class_bias has these classes first, then classes without words."""
    r = np.random.default_rng(seed)
    classes, size = word_bias.shape
    return {
        "input": r.normal(0, 0.1, (inputs, 3 * HIDDEN)).astype(np.float32),
        "state": r.normal(0, 0.2, (3 * HIDDEN, HIDDEN)).astype(np.float32),
        "classes": np.zeros((len(class_bias), HIDDEN), np.float32),
        "class_bias": class_bias.astype(np.float32),
        "words": np.zeros((classes, size, HIDDEN), np.float32),
        "word_bias": word_bias.astype(np.float32),
    }


class Lanes:
    """Sequences end to end in at most n lanes of near equal length, the longest lane first."""

    def __init__(self, inputs: list[np.ndarray], targets: list[np.ndarray], n: int):
        size = np.array([len(s) for s in inputs])
        n = max(1, min(n, len(size)))
        load, dealt = np.zeros(n, np.int64), [[] for _ in range(n)]
        for i in np.argsort(-size, kind="stable").tolist():
            k = int(load.argmin())
            dealt[k].append(i)
            load[k] += size[i]
        by_length = np.argsort(-load, kind="stable")
        order = [i for k in by_length.tolist() for i in dealt[k]]
        self.lengths = load[by_length]
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.x, self.y = (np.concatenate([s[i] for i in order]) for s in (inputs, targets))
        self.owner = np.repeat(order, size[order]).astype(np.int32)
        self.fresh = np.zeros(len(self.x), bool)
        self.fresh[np.cumsum(size[order]) - size[order]] = True

    def windows(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place of each step and lane in the arrays, whether there is one) of each window; lanes that have ended are left out."""
        for at in range(0, int(self.lengths[0]), WINDOW):
            k = int((self.lengths > at).sum())
            step = np.arange(at, min(at + WINDOW, int(self.lengths[0])))[:, None]
            live = step < self.lengths[None, :k]
            yield np.where(live, self.starts[None, :k] + step, 0), live


def _forward(p: Params, x: np.ndarray, keep: np.ndarray, h: np.ndarray, back: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The states after each step of a window and after it; x, keep: (steps, lanes), keep 0 where a sequence starts. back is filled
    with what the way back needs: states before the steps, gates, what the reset gate opens to, and candidates."""
    steps, k = x.shape
    a = np.ascontiguousarray(p["input"][x.ravel()].reshape(steps, k, 3 * HIDDEN).transpose(0, 2, 1))
    kept = [np.empty((steps if back is not None else 1, m * HIDDEN, k), a.dtype) for m in (1, 2, 3, 1)]
    if back is not None:
        back += kept
    states = np.empty((steps, HIDDEN, k), a.dtype)
    starts = (keep == 0).any(1).tolist()
    with np.errstate(over="ignore"):
        for t in range(steps):
            before, g, u, n = (x[t if back is not None else 0] for x in kept)
            np.multiply(h, keep[t], out=before) if starts[t] else np.copyto(before, h)
            np.matmul(p["state"], before, out=u)
            np.add(a[t, : 2 * HIDDEN], u[: 2 * HIDDEN], out=g)
            np.negative(g, out=g)
            np.exp(g, out=g)
            g += 1
            np.reciprocal(g, out=g)
            np.multiply(g[HIDDEN:], u[2 * HIDDEN :], out=n)
            n += a[t, 2 * HIDDEN :]
            np.tanh(n, out=n)
            h = states[t]
            np.subtract(before, n, out=h)
            h *= g[:HIDDEN]
            h += n
    return states, h


def _by_target(rows: np.ndarray) -> np.ndarray:
    """(units, steps * lanes) of (steps, units, lanes)."""
    return np.ascontiguousarray(rows.transpose(1, 0, 2)).reshape(rows.shape[1], -1)


def _exponentials(weights: np.ndarray, bias: np.ndarray, states: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(exp of all logits less a number for each place, their sums, the targets' logits less it). States lie within -1 and 1, which
    bounds logits: as long as none of the sums can vanish, one number does for all places."""
    reach = np.abs(weights).sum(1)
    top = float((bias + reach).max())
    logits = weights @ states
    logits += (bias - top)[:, None]
    if float((bias - reach).max()) - top < -60:
        logits -= logits.max(0)
    chosen = logits[target, np.arange(len(target))]
    np.exp(logits, out=logits)
    return logits, logits.sum(0), chosen


def _by_class(p: Params, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class of each target, order of the targets that have a word by class, where each class begins). A target is class * size +
    place, or classes * size + k for a class k past those with words."""
    classes, size = p["word_bias"].shape
    c = np.where(y < classes * size, y // size, y - classes * (size - 1)).astype(np.uint8)
    order = np.argsort(c, kind="stable")
    cuts = np.searchsorted(c[order], np.arange(classes + 1))
    return c, order[: cuts[-1]], cuts


def log_likelihood(p: Params, states: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Natural logs of each target's probability; states: (units, targets)."""
    size = p["word_bias"].shape[1]
    c, order, cuts = _by_class(p, y)
    _, total, out = _exponentials(p["classes"], p["class_bias"], states, c)
    out -= np.log(total)
    s, place = states[:, order], y[order] % size
    within, total = np.empty(len(order), out.dtype), np.empty(len(order), out.dtype)
    for k in np.flatnonzero(np.diff(cuts)).tolist():
        a, b = cuts[k], cuts[k + 1]
        _, total[a:b], within[a:b] = _exponentials(p["words"][k], p["word_bias"][k], s[:, a:b], place[a:b])
    out[order] += within - np.log(total)
    return out


def _summed(rows: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """(n, units): rows (steps, units, lanes) summed by the number of each place."""
    return np.stack([np.bincount(at, rows[:, i].ravel(), n) for i in range(rows.shape[1])], 1).astype(rows.dtype)


def _gradients(p: Params, x: np.ndarray, y: np.ndarray, live: np.ndarray, keep: np.ndarray, h: np.ndarray) -> tuple[Params, np.ndarray, float]:
    """Gradients of the mean loss over one window's live places, the state after it and the loss."""
    kept: list = []
    states, after = _forward(p, x, keep, h, kept)
    steps, k = x.shape
    flat, use = _by_target(states), np.flatnonzero(live.ravel())
    s, t = (flat, y.ravel()) if len(use) == flat.shape[1] else (flat[:, use], y.ravel()[use])
    size, n = p["word_bias"].shape[1], len(t)
    c, order, cuts = _by_class(p, t)
    g = {name: np.zeros_like(p[name]) for name in ("words", "word_bias")}

    def backward(weights, bias, states, target):
        d, total, chosen = _exponentials(weights, bias, states, target)
        loss = np.log(total).sum() - chosen.sum()
        d *= (1 / n) / total
        d[target, np.arange(len(target))] -= 1 / n
        return d, loss

    d, loss = backward(p["classes"], p["class_bias"], s, c)
    g["classes"], g["class_bias"] = d @ s.T, d.sum(1)
    ds = p["classes"].T @ d
    sorted_s, place, within = s[:, order], t[order] % size, np.empty((HIDDEN, len(order)), s.dtype)
    for i in np.flatnonzero(np.diff(cuts)).tolist():
        a, b = cuts[i], cuts[i + 1]
        d, more = backward(p["words"][i], p["word_bias"][i], sorted_s[:, a:b], place[a:b])
        loss += more
        g["words"][i], g["word_bias"][i] = d @ sorted_s[:, a:b].T, d.sum(1)
        within[:, a:b] = p["words"][i].T @ d
    ds[:, order] += within
    back = ds
    if n < flat.shape[1]:
        back = np.zeros_like(flat)
        back[:, use] = ds
    back = np.ascontiguousarray(back.reshape(HIDDEN, steps, k).transpose(1, 0, 2))
    before, gates, opened, candidate = kept
    z, r, un = gates[:, :HIDDEN], gates[:, HIDDEN:], opened[:, 2 * HIDDEN :]
    # what a state's gradient is multiplied by on the way into the update gate, the reset gate and the candidate
    into = np.empty((steps, 3, HIDDEN, k), s.dtype)
    shut = 1 - z
    np.multiply(before - candidate, z * shut, out=into[:, 0])
    shut *= 1 - candidate * candidate
    np.multiply(shut * un, r * (1 - r), out=into[:, 1])
    np.multiply(shut, r, out=into[:, 2])
    dh, turned = np.zeros_like(h), np.ascontiguousarray(p["state"].T)
    starts = (keep == 0).any(1).tolist()
    for i in range(steps - 1, -1, -1):
        dh += back[i]
        back[i] = dh
        into[i] *= dh
        dh *= z[i]
        dh += turned @ into[i].reshape(3 * HIDDEN, k)
        if starts[i]:
            dh *= keep[i]
    g["state"] = np.matmul(into.reshape(steps, 3 * HIDDEN, k), before.transpose(0, 2, 1)).sum(0)
    np.multiply(back, shut, out=into[:, 2])
    g["input"] = _summed(into.reshape(steps, 3 * HIDDEN, k), x.ravel(), len(p["input"]))
    return g, after, float(loss / n)


class Trainer:
    """Adam over windows of sequences; its means go on from one call to the next."""

    def __init__(self, p: Params, rate: float):
        self.p, self.rate, self.step = {k: v.copy() for k, v in p.items()}, rate, 0
        self.first, self.second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))

    def train(self, inputs: list[np.ndarray], targets: list[np.ndarray], n: int) -> None:
        """One pass over sequences in n lanes; the state goes on from window to window of a sequence."""
        if not inputs:
            return
        lanes, p = Lanes(inputs, targets, n), self.p
        h = np.zeros((HIDDEN, len(lanes.lengths)), p["state"].dtype)
        for at, live in lanes.windows():
            k = at.shape[1]
            keep = (~lanes.fresh[at]).astype(h.dtype)
            g, h, _ = _gradients(p, lanes.x[at], lanes.y[at], live, keep, h[:, :k])
            self.step += 1
            scale = min(1.0, 1.0 / max(1e-8, float(np.sqrt(sum(float(np.vdot(v, v)) for v in g.values())))))
            now = self.rate * np.sqrt(1 - 0.99**self.step) / (1 - 0.9**self.step)
            for name, v in g.items():
                first, second = self.first[name], self.second[name]
                v *= scale
                first += 0.1 * (v - first)
                second += 0.01 * (v * v - second)
                p[name] -= (now * first / (np.sqrt(second) + 1e-6)).astype(p[name].dtype)


def score(p: Params, inputs: list[np.ndarray], targets: list[np.ndarray], n: int = 1024) -> np.ndarray:
    """Natural log-likelihood of each whole sequence, however long."""
    total = np.zeros(len(inputs))
    if not inputs:
        return total
    lanes = Lanes(inputs, targets, n)
    h, held, size = np.zeros((HIDDEN, len(lanes.lengths)), np.float32), [], 0
    for at, live in lanes.windows():
        states, h = _forward(p, lanes.x[at], (~lanes.fresh[at]).astype(np.float32), h[:, : at.shape[1]])
        use = live.ravel()
        held.append((_by_target(states)[:, use], at.ravel()[use]))
        size += len(held[-1][1])
        if size >= PLACES or at[0, 0] + WINDOW >= lanes.lengths[0]:
            places = np.concatenate([a for _, a in held])
            logs = log_likelihood(p, np.concatenate([s for s, _ in held], 1), lanes.y[places])
            total += np.bincount(lanes.owner[places], logs, len(inputs))
            held, size = [], 0
    return total
