"""An averaged perceptron for part-of-speech tags: trained online in order, predicted greedily from left to right."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from math import exp
from typing import Any

CLASSES = 40
START = 40
MIN_OBSERVATIONS = 3


@dataclass
class Perceptron:
    """weights: feature -> {class: weight}; seen: feature -> observations."""

    weights: dict[str, dict[int, float]] = field(default_factory=dict)
    seen: dict[str, int] = field(default_factory=dict)

    def scores(self, features: Iterable[str]) -> list[float]:
        total = [0.0] * CLASSES
        for f in features:
            for c, w in self.weights.get(f, {}).items():
                total[c] += w
        return total


def best_class(scores: Sequence[float]) -> int:
    """The class with the highest score, the last one among equals."""
    top = max(scores)
    return max(i for i, s in enumerate(scores) if s == top)


def _contexts(words: Sequence[str], i: int) -> tuple[str, str, str, str]:
    """What the features of word i see of the sentence: the words at -2, -1, 0 and 1."""
    at = lambda j: words[j] if 0 <= j < len(words) else {-2: "_START2", -1: "_START1", len(words): "."}.get(j, "_END")
    return at(i - 2), at(i - 1), words[i], at(i + 1)


def _features(context: tuple[str, str, str, str], guess: int) -> list[str]:
    two, one, word, after = context
    return [f"{word}_0", "bias", f"{two}_-2", f"{one}_-1", f"{after}_+1", f"{guess}_t", f"{guess}_{one}_t-1"]


def context_features(words: Sequence[str], i: int, guess: int) -> list[str]:
    """Features of word i; ``guess`` is the tag given to the word before it."""
    return _features(_contexts(words, i), guess)


def predict(model: Perceptron, words: Sequence[str]) -> list[tuple[list[float], int]]:
    """For each word its class scores, and how often the word was seen in training."""
    out, guess = [], START
    for i in range(len(words)):
        features = context_features(words, i, guess)
        scores = model.scores(features)
        guess = best_class(scores)
        out.append((scores, model.seen.get(features[0], 0)))
    return out


class Scorer:
    """``use(scores, observations)`` for each word as :func:`predict` gives them; a context that comes again isn't scored again.

    At most ``KEPT`` contexts are held.
    """

    KEPT = 50_000

    def __init__(self, model: Perceptron, use: Callable[[list[float], int], Any]) -> None:
        self.model, self.use = model, use
        self.known: dict[tuple, tuple[int, Any]] = {}

    def __call__(self, words: Sequence[str]) -> list[Any]:
        out, guess = [], START
        for i in range(len(words)):
            key = (*_contexts(words, i), guess)
            found = self.known.get(key)
            if found is None:
                if len(self.known) >= self.KEPT:
                    self.known.clear()
                features = _features(key[:4], guess)
                scores = self.model.scores(features)
                found = self.known[key] = best_class(scores), self.use(scores, self.model.seen.get(features[0], 0))
            guess = found[0]
            out.append(found[1])
        return out


def noun_share(scores: Sequence[float], temperature: float = 0.5) -> float:
    """The larger share of the two proper nouns' classes in the softmax of a word's scores, kept as 32-bit floats."""
    short = struct.unpack(f"{CLASSES}f", struct.pack(f"{CLASSES}f", *scores))
    top = max(short)
    powers = [exp((s - top) * temperature) for s in short]
    total = 0.0
    for x in powers:
        total += x
    return max(powers[16] / total, powers[17] / total)


class Trainer:
    """Mistake-driven updates of one, averaged lazily over all steps.

    A sentence that was guessed right is guessed right again as long as no weight changes: then it is only counted,
    and its features' observations are added later.  At most ``KEPT`` sentences are held for that.
    """

    KEPT = 50_000

    def __init__(self) -> None:
        self.mistakes = 0
        self.settled: dict[tuple, list[int]] = {}  # sentence -> mistakes before it was guessed right, times since not yet in ``seen``
        self.now: dict[str, dict[int, list[float]]] = {}  # weight, total, step of the last change
        self.seen: dict[str, int] = {}
        self.steps = self.right = 0

    def _bump(self, feature: str, cls: int, by: float) -> None:
        record = self.now[feature].setdefault(cls, [0.0, 0.0, self.steps])
        record[1] += (self.steps - record[2]) * record[0]
        record[0] += by
        record[2] = self.steps

    def learn(self, words: Sequence[str], tags: Sequence[int]) -> None:
        key = (tuple(words), tuple(tags))
        known = self.settled.get(key)
        if known is not None and known[0] == self.mistakes:
            known[1] += 1
            self.steps += len(key[1])
            self.right += len(key[1])
            return
        before = self.mistakes
        self._learn(*key)
        if before != self.mistakes:
            return
        if known is not None:
            known[0] = before
            return
        if len(self.settled) >= self.KEPT:
            self._settle()
        self.settled[key] = [before, 0]

    def _settle(self) -> None:
        """Add the observations of sentences that were only counted."""
        for (words, tags), (_, times) in self.settled.items():
            if times:
                for i, guess in enumerate((START, *tags)[: len(tags)]):
                    for f in context_features(words, i, guess):
                        self.seen[f] += times
        self.settled.clear()

    def _learn(self, words: Sequence[str], tags: Sequence[int]) -> None:
        guess = START
        for i, truth in enumerate(tags):
            features = context_features(words, i, guess)
            scores = [0.0] * CLASSES
            for f in features:
                self.seen[f] = self.seen.get(f, 0) + 1
                for c, (weight, _, _) in self.now.setdefault(f, {}).items():
                    scores[c] += weight
            guess = best_class(scores)
            if guess != truth:
                self.mistakes += 1
                for f in features:
                    self._bump(f, truth, 1.0)
                    self._bump(f, guess, -1.0)
            self.right += guess == truth
            self.steps += 1

    def finish(self) -> tuple[Perceptron, float]:
        """The averaged model, rare features left out, and the share of right guesses on the way."""
        self._settle()
        model = Perceptron()
        for f, classes in self.now.items():
            if self.seen[f] < MIN_OBSERVATIONS:
                continue
            model.seen[f] = self.seen[f]
            model.weights[f] = {c: (t + (self.steps - s) * w) / self.steps for c, (w, t, s) in classes.items()}
        return model, self.right / self.steps if self.steps else 0.0
