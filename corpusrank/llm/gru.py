"""A gated recurrent language model in numpy: truncated backpropagation, class-factored softmax, carried state."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

HIDDEN = 24
CLASS_SIZE = 64
F32 = np.float32
FREQUENT = 16
"""A word of a window with more rows than that is summed on its own."""
UPDATE_BLOCK = 16_384
"""Parameters that are updated together, so that all passes over them find them in the cache."""


@dataclass
class Shape:
    """Sizes of the model: words (a multiple of ``class_size``), hidden units, and words in a class."""

    words: int
    hidden: int = HIDDEN
    class_size: int = CLASS_SIZE

    @property
    def parts(self) -> list[tuple[str, tuple[int, ...]]]:
        w, h, c = self.words, self.hidden, self.class_size
        return [("Eg", (2, w, h)), ("En", (w, h)), ("Ug", (2, h, h)), ("Un", (h, h)), ("Wc", (h, w // c)), ("bc", (w // c,)), ("Wo", (w // c, h, c)), ("bo", (w // c, c))]

    @property
    def size(self) -> int:
        return sum(int(np.prod(s)) for _, s in self.parts)

    def views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, shape in self.parts:
            n = int(np.prod(shape))
            out[name] = flat[at : at + n].reshape(shape)
            at += n
        return out


def initial(shape: Shape, counts: np.ndarray, seed: int = 11) -> np.ndarray:
    """Parameters that predict by frequency alone: small random weights, biases from the counts."""
    flat = np.random.default_rng(seed).normal(0, 0.08, shape.size).astype(F32)
    p = shape.views(flat)
    by_class = np.maximum(counts, 0.5).reshape(-1, shape.class_size)
    p["bc"][:] = np.log(by_class.sum(axis=1) / by_class.sum())
    p["bo"][:] = np.log(by_class / by_class.sum(axis=1, keepdims=True))
    p["Wo"] *= 0.3
    p["Wc"] *= 0.3
    return flat


class Lanes:
    """Documents dealt to lanes, longest first to the shortest lane; each lane is a stream of whole documents."""

    def __init__(self, lengths: np.ndarray, lanes: int):
        lanes = max(1, min(lanes, len(lengths)))
        heap = [(0, i) for i in range(lanes)]
        dealt: list[list[int]] = [[] for _ in range(lanes)]
        for d in np.argsort(-lengths, kind="stable").tolist():
            load, i = heapq.heappop(heap)
            dealt[i].append(d)
            heapq.heappush(heap, (load + int(lengths[d]), i))
        loads = np.array([sum(int(lengths[d]) for d in docs) for docs in dealt])
        order = np.argsort(-loads, kind="stable")
        self.loads = loads[order]
        self.starts = np.cumsum(self.loads) - self.loads
        docs = np.array([d for i in order for d in dealt[i]], np.int64)
        begin = np.cumsum(lengths) - lengths
        n = lengths[docs]
        ends = np.cumsum(n)
        self.index = np.repeat(begin[docs] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)
        self.first = np.zeros(len(self.index), bool)
        self.first[ends - n] = True

    def windows(self, steps: int, most: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places in the lanes' order, (steps, active lanes), and which of them exist.

        All lanes end at the same step: the longest documents begin alone, and the last windows hold
        many documents.  While only a few lanes run, windows are longer (up to ``most`` steps), so
        that they hold as many tokens.
        """
        at, room = 0, steps * len(self.loads)
        longest = int(self.loads[0]) if len(self.loads) else 0
        begin = longest - self.loads
        while at < longest:
            active = int(np.searchsorted(begin, at, "right"))
            n = min(max(steps, min(most or steps, room // active)), longest - at)
            active = int(np.searchsorted(begin, at + n, "left"))
            t = at + np.arange(n)
            there = t[:, None] >= begin[None, :active]
            yield np.where(there, self.starts[None, :active] + t[:, None] - begin[None, :active], 0), there
            at += n


def sums_by_word(rows: np.ndarray, word: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The words that occur, the most frequent ones first, and the sums of their rows.

    Rows of a frequent word are summed by a product with ones; of all others the first rows, then the second ones, and so on.
    """
    order = np.argsort(word.astype(np.uint16 if words <= 1 << 16 else np.int64), kind="stable")
    word, rows = word[order], np.take(rows, order, axis=0)
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    count = np.diff(np.concatenate([first, [len(word)]]))
    by = np.argsort(-count, kind="stable")
    first, count = first[by], count[by]
    more = np.searchsorted(-count, -np.arange(FREQUENT + 1)).tolist()  # how many words have more than 0, 1, ... rows
    sums, ones = np.take(rows, first, axis=0), np.ones(int(count.max(initial=0)), F32)
    for j in range(1, FREQUENT):
        here = slice(more[FREQUENT], more[j])
        sums[here] += np.take(rows, first[here] + j, axis=0)
    for i, (a, n) in enumerate(zip(first[: more[FREQUENT]].tolist(), count.tolist())):
        np.matmul(ones[:n], rows[a : a + n], out=sums[i])
    return word[first], sums


class Model:
    """Forward and backward passes over one window of steps.

    Written for few passes over memory: every gate is an array of its own without gaps, kept for a
    whole window, sums over a row are matrix products, and what doesn't depend on the step before is
    computed for all steps at once.  A gate is 1 / (1 + exp(a)), so the sign of its weights is
    opposite to the usual one.  Logits stay small enough (inputs are bounded, weights moderate) for
    exp without a shift; they are clipped where they might not.
    """

    def __init__(self, shape: Shape, flat: np.ndarray):
        self.shape, self.flat, self.p = shape, flat, shape.views(flat)

    def recur(self, x: np.ndarray, keep: np.ndarray, h: np.ndarray, store: bool = False) -> tuple[np.ndarray, np.ndarray, tuple | None]:
        """Hidden states for inputs ``x`` (steps, lanes); ``keep`` is 0 where a document starts."""
        k, steps = self.shape.hidden, len(x)
        eg, en, ug, un = (self.p[name] for name in ("Eg", "En", "Ug", "Un"))
        out = np.empty((*x.shape, k), F32)
        # Of all steps where they are kept, else of the step at hand alone, which stays in the cache: gates keep and reset, the new state, the inputs of both.
        held = steps if store else min(1, steps)
        gates, new, inner = np.empty((held, 2, *out.shape[1:]), F32), np.empty((held, *out.shape[1:]), F32), np.empty((held, *out.shape[1:]), F32)
        before = np.empty_like(out) if store else None
        both, part = np.empty((2, *out.shape[1:]), F32), np.empty(out.shape[1:], F32)
        fresh = (keep.min(axis=1) == 0).tolist()
        with np.errstate(over="ignore"):
            for t in range(steps):
                if fresh[t]:
                    h = h * keep[t][:, None]
                if store:
                    before[t] = h
                at = t if store else 0
                g = np.take(eg, x[t], axis=1, out=gates[at], mode="clip")
                g += np.matmul(h, ug, out=both)
                np.exp(g, out=g)
                g += 1
                np.reciprocal(g, out=g)
                n = np.take(en, x[t], axis=0, out=new[at], mode="clip")
                n += np.multiply(g[1], np.matmul(h, un, out=inner[at]), out=part)
                np.tanh(n, out=n)
                after = out[t]
                np.subtract(h, n, out=after)
                after *= g[0]
                after += n
                h = after
        return out, h.copy() if steps else h, (before, gates[:, 0], gates[:, 1], new, inner) if store else None

    def log_probs(self, hs: np.ndarray, y: np.ndarray, grad: dict[str, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """ln P of targets ``y`` after states ``hs``: of the class, and of the word in its class; with ``grad``, also d/d hs of the mean loss."""
        p, n, k = self.p, len(y), self.shape.hidden
        size = self.shape.class_size
        cls = y // size
        order = np.argsort(cls.astype(np.uint16), kind="stable")
        cls, word = cls[order], (y % size)[order]
        bounds = np.searchsorted(cls, np.arange(self.shape.words // size + 1)).tolist()
        # A last input of 1 has the bias as its weights.
        inputs = np.ones((n, k + 1), F32)
        inputs[:, :k] = np.take(hs, order, axis=0)
        class_weights, word_weights = np.concatenate([p["Wc"], p["bc"][None]]), np.concatenate([p["Wo"], p["bo"][:, None]], axis=1)
        # States lie within -1..1, so weights bound the logits.
        small = max(np.abs(class_weights).sum(axis=0).max(), np.abs(word_weights).sum(axis=1).max()) < 80
        parts = [(c, slice(a, b)) for c, (a, b) in enumerate(zip(bounds, bounds[1:])) if a < b]

        def softmax(e: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """ln P of the targets, exp of the logits in their place, and sums of those; places of targets."""
            if not small:
                np.clip(e, -80, 80, out=e)
            places = np.arange(0, e.size, e.shape[1]) + at
            picked = e.ravel()[places]
            np.exp(e, out=e)
            total = e @ np.ones(e.shape[1], F32)
            return picked - np.log(total), total, places

        def loss(e: np.ndarray, total: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Makes the slopes of the mean loss from ``e``, but for a factor a row; the factors, and the inputs times them."""
            e.ravel()[places] -= total
            factor = (1 / (total * F32(n)))[:, None]
            return factor, inputs * factor

        e = inputs @ class_weights
        logs, total, places = softmax(e, cls)
        dh = None
        if grad is not None:
            factor, scaled = loss(e, total, places)
            made = scaled.T @ e
            grad["Wc"][:], grad["bc"][:] = made[:k], made[k]
            dh = e @ p["Wc"].T
            dh *= factor
        e = np.empty((n, size), F32)
        for c, s in parts:
            np.matmul(inputs[s], word_weights[c], out=e[s])
        more, total, places = softmax(e, word)
        logs += more
        if grad is not None:
            factor, scaled = loss(e, total, places)
            made, added = np.zeros_like(word_weights), np.empty_like(dh)
            for c, s in parts:
                np.matmul(scaled[s].T, e[s], out=made[c])
                np.matmul(e[s], p["Wo"][c].T, out=added[s])
            grad["Wo"][:], grad["bo"][:] = made[:, :k], made[:, k]
            added *= factor
            dh += added
        back = np.empty_like(order)
        back[order] = np.arange(n)
        return logs[back], None if dh is None else np.take(dh, back, axis=0)

    def gradient(self, x: np.ndarray, y: np.ndarray, there: np.ndarray, keep: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Gradient of the mean loss of one window, the state after it, and the loss."""
        hs, last, kept = self.recur(x, keep, h, store=True)
        before, z, r, n, inner = kept
        flat = np.zeros_like(self.flat)
        grad = self.shape.views(flat)
        whole = bool(there.all())
        k = self.shape.hidden
        logs, dh = self.log_probs(hs.reshape(-1, k) if whole else hs[there], y.ravel() if whole else y[there], grad)
        if whole:
            dhs = dh.reshape(hs.shape)
        else:
            dhs = np.zeros_like(hs)
            dhs[there] = dh
        to_n = np.multiply(n, n)
        np.subtract(1, to_n, out=to_n)
        slope = np.subtract(1, z)
        to_n *= slope
        slope *= z
        to_z = np.subtract(n, before)
        to_z *= slope
        to_r = np.subtract(r, 1)
        to_r *= r
        to_r *= inner
        # Of both gates and the new state side by side: one product and one sum by word serve them all.
        d, dn = np.empty((*hs.shape[:2], 3 * k), F32), np.empty_like(hs)
        carried, part, dan = np.zeros_like(h), np.empty_like(h), np.empty_like(h)
        ug, un = self.p["Ug"].transpose(0, 2, 1).reshape(2 * k, k), self.p["Un"].T.copy()
        fresh = (keep.min(axis=1) == 0).tolist()
        for t in range(len(x) - 1, -1, -1):
            carried += dhs[t]
            here = d[t]
            np.multiply(carried, to_n[t], out=dan)
            here[:, 2 * k :] = dan
            np.multiply(carried, to_z[t], out=here[:, :k])
            np.multiply(dan, to_r[t], out=here[:, k : 2 * k])
            np.multiply(dan, r[t], out=dn[t])
            carried *= z[t]
            carried += np.matmul(here[:, : 2 * k], ug, out=part)
            carried += np.matmul(dn[t], un, out=part)
            if fresh[t]:
                carried *= keep[t][:, None]
        past, d = before.reshape(-1, k).T, d.reshape(-1, 3 * k)
        grad["Ug"][:] = (past @ d[:, : 2 * k]).reshape(k, 2, k).transpose(1, 0, 2)
        grad["Un"][:] = past @ dn.reshape(-1, k)
        seen, sums = sums_by_word(d, x.ravel(), self.shape.words)
        for i, target in enumerate((grad["Eg"][0], grad["Eg"][1], grad["En"])):
            target[seen] = sums[:, i * k : (i + 1) * k]
        return flat, last, -float(logs.mean())


class Trainer:
    """Adam over windows; the state of a lane goes from window to window, its gradient doesn't.

    Documents are whole: a lane's state is carried from a document's first token to its last.
    """

    def __init__(self, model: Model, rate: float = 0.012, lanes: int = 256, steps: int = 24):
        self.model, self.rate, self.lanes, self.steps = model, rate, lanes, steps
        self.m, self.v, self.t = np.zeros_like(model.flat), np.zeros_like(model.flat), 0
        self.seen, self.loss = 0, 0.0

    def learn(self, tokens: np.ndarray, lengths: np.ndarray) -> None:
        """One pass over documents, given as all tokens (each document's end included) and lengths.

        A small set has fewer lanes, so that it still makes some updates.
        """
        lanes = Lanes(lengths, max(16, min(self.lanes, len(tokens) // (64 * self.steps))))
        previous = np.concatenate([[0], tokens[:-1]])
        previous[np.cumsum(lengths) - lengths] = 0
        x, y = previous[lanes.index], tokens[lanes.index]
        h, full = np.zeros((len(lanes.loads), self.model.shape.hidden), F32), self.steps * len(lanes.loads)
        for at, there in lanes.windows(self.steps, 8 * self.steps):
            keep, active = (~(lanes.first[at] & there)).astype(F32), at.shape[1]
            grad, h[:active], loss = self.model.gradient(x[at], y[at], there, keep, h[:active])
            norm, here = float(np.sqrt(grad @ grad)), int(there.sum())
            # A window of few tokens, where the longest documents run alone, moves the parameters by as much less.
            grad *= F32(min(1.0, here / full) / max(1.0, norm))
            self.t += 1
            # Both moments without the factors that would make means of them: those are part of the rate.
            rate = F32(self.rate * min(1.0, self.t / 20) * np.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t))
            for low in range(0, len(grad), UPDATE_BLOCK):
                part = slice(low, low + UPDATE_BLOCK)
                g, m, v = grad[part], self.m[part], self.v[part]
                m *= F32(0.9)
                m += g
                v *= F32(0.99)
                g *= g
                v += g
                np.sqrt(v, out=g)
                g += F32(1e-7)
                np.divide(m, g, out=g)
                g *= rate
                self.model.flat[part] -= g
            self.seen += here
            self.loss += loss * here


def score(model: Model, tokens: np.ndarray, lengths: np.ndarray, lanes: int = 256, steps: int = 32) -> np.ndarray:
    """ln P of every token in its document, the state carried from the document's first token to its last."""
    dealt = Lanes(lengths, lanes)
    y = tokens[dealt.index]
    x = np.concatenate([[0], y[:-1]]) * ~dealt.first if len(y) else y
    h = np.zeros((len(dealt.loads), model.shape.hidden), F32)
    out = np.zeros(len(tokens), np.float64)
    for at, there in dealt.windows(steps, 16 * steps):
        active = at.shape[1]
        hs, h[:active], _ = model.recur(x[at], (~(dealt.first[at] & there)).astype(F32), h[:active])
        logs, _ = model.log_probs(hs[there], y[at][there])
        out[dealt.index[at[there]]] = logs
    return out
