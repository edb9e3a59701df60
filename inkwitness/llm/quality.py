"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every document. Documents with equal votes are one row, so that
expectation-maximisation over the whole corpus works on a table no larger than the number of vote patterns. It finds how
often each labeller votes each way on good and on bad documents, and with that the posterior of every pattern. Posteriors
of a bounded sample label a linear scorer over hashed word shapes, which then scores every whole text.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import over_batches

#: Documents that train the scorer, about; they are chosen by a hash of their ids over the whole corpus.
SAMPLE = 8000
#: Hashed features, of which the last two are the bias and the share of repeated triples of words.
WIDTH = 1024
#: Characters of a piece; a word is one piece unless it is longer.
PIECE = 64
#: A document stays when its score is at least this.
KEEP = 0.5

_MARKS = "#$%&*|<>{}[]~^=\\@_+"
_NOT_MARKS = bytes(b for b in range(256) if chr(b) not in _MARKS)
_NOT_UPPER = bytes(b for b in range(256) if chr(b) not in string.ascii_uppercase)
_NOT_LETTER = bytes(b for b in range(256) if chr(b) not in string.ascii_letters and b < 128)
_NOT_DIGIT = bytes(b for b in range(256) if chr(b) not in string.digits)
_NOT_STOP = bytes(b for b in range(256) if chr(b) not in ".,;:")


def statistics(raw: bytes, words: list[bytes]) -> tuple[float, ...]:
    """What the labellers look at: shares of marks, capitals, digits, shouting, table bars, repeated words and stops;
    mean word; share of letters; share of distinct triples of words."""
    size, count, letters = max(1, len(raw)), max(1, len(words)), len(raw.translate(None, _NOT_LETTER))
    room, told = max(80, size), max(60, letters)  # one capital or digit of a short text says little
    triples = max(1, count - 2)
    fresh = len(set(zip(words, words[1:], words[2:]))) / triples if count >= 10 else 1.0
    return (len(raw.translate(None, _NOT_MARKS)) / room, len(raw.translate(None, _NOT_UPPER)) / told,
            len(raw.translate(None, _NOT_DIGIT)) / room, raw.count(b"!") / count, raw.count(b"|") / count,
            1 - len(set(words)) / count if count >= 100 else 0.0, len(raw.translate(None, _NOT_STOP)) / count,
            len(raw) / count, letters / size, fresh)


#: (statistic, unsuspicious up to, objected to from); a negative statistic number asks for the opposite direction.
LABELLERS = ((0, 0.02, 0.05), (1, 0.15, 0.35), (2, 0.08, 0.15), (3, 0.10, 0.30), (4, 0.10, 0.25), (7, 10.0, 14.0),
             (-8, -0.65, -0.55), (-6, -0.03, -0.01), (-9, -0.80, -0.50))


def votes(stats: tuple[float, ...]) -> int:
    """All votes as one number, base 3: 0 nothing, 1 good, 2 bad.

    Each labeller objects or says nothing; the last one, prose, votes good where no statistic is suspicious.
    """
    number, prose = 0, 1
    for which, good, bad in LABELLERS:
        value = stats[which] if which >= 0 else -stats[-which]
        number = 3 * number + (2 if value >= bad else 0)
        prose &= value <= good
    return 3 * number + prose


class _Shapes(dict):
    """Bucket of the shape of a piece of a word: letters as a or A, digits as 0, runs as one, other characters as they are."""

    def __missing__(self, word: bytes) -> int:
        text = word.decode(errors="replace")
        shape = re.sub(r"(.)\1+", r"\1", "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in text))
        value = xxhash.xxh3_64_intdigest(shape.encode()) % (WIDTH - 2)
        if len(self) < 300_000:
            self[word] = value
        return value


_shapes = _Shapes()


def pieces(words: list[bytes]) -> list[bytes]:
    """The words, those of more than ``PIECE`` characters cut into successive pieces of so many."""
    if not words or len(max(words, key=len)) <= PIECE:
        return words
    out = []
    for word in words:
        if len(word) <= PIECE:
            out.append(word)
        else:
            text = word.decode(errors="replace")
            out.extend(text[i:i + PIECE].encode() for i in range(0, len(text), PIECE))
    return out


def features(words: list[bytes]) -> np.ndarray:
    """Shares of the hashed shapes of all pieces, square-rooted; then the bias and the share of repeated triples of words."""
    out = np.zeros(WIDTH)
    if words:
        parts = pieces(words)
        out[:WIDTH - 2] = np.sqrt(np.bincount(np.fromiter(map(_shapes.__getitem__, parts), np.int64), minlength=WIDTH - 2) / len(parts))
        out[-1] = 1 - len(set(zip(words, words[1:], words[2:]))) / (len(words) - 2) if len(words) >= 10 else 0
    out[-2] = 1
    return out


def accuracies(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation: (rates[class, labeller, vote], posterior probability of good per pattern).

    ``patterns`` holds votes 0, 1, 2 by column; class 1 is good. It begins with every document
    bad that a labeller objects to, and a labeller's abstentions count as a third way to vote. Every count starts with one document, spread over the ways to vote.
    """
    posterior = np.where((patterns == 2).any(1), 0.05, 0.95)
    rates = np.full((2, patterns.shape[1], 3), 1 / 3)
    for _ in range(rounds):
        prior = np.array([1 + counts @ (1 - posterior), 1 + counts @ posterior])
        for which, weight in enumerate((counts * (1 - posterior), counts * posterior)):
            for vote in range(3):
                rates[which, :, vote] = (1 / 3 + weight @ (patterns == vote)) / (1 + weight.sum())
        log = np.log(prior / prior.sum())[:, None] + np.stack(
            [np.log(rates[which][np.arange(patterns.shape[1]), patterns]).sum(1) for which in (0, 1)])
        updated = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
        if np.abs(updated - posterior).max(initial=0) < 1e-9:
            break
        posterior = updated
    return rates, posterior


def train(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, rounds: int = 400) -> np.ndarray:
    """Weights of a logistic scorer for soft labels ``y``, by accelerated gradient descent."""
    if not len(x):
        return np.zeros(x.shape[1])
    used = np.flatnonzero(x.any(0))  # the other weights stay 0
    out, x = np.zeros(x.shape[1]), x[:, used].astype(float)
    weights, ahead = np.zeros(len(used)), np.zeros(len(used))
    rate = 4 / np.max((x * x).sum(1), initial=1)
    for turn in range(rounds):
        wrong = 1 / (1 + np.exp(-np.clip(x @ ahead, -500, 500))) - y
        following = ahead - rate * (x.T @ wrong / len(x) + penalty * ahead)
        ahead = following + turn / (turn + 3) * (following - weights)
        weights = following
    out[used] = weights
    return out


@dataclass(frozen=True)
class Quality:
    weights: np.ndarray
    posterior: dict[int, float]
    rates: np.ndarray

    def score(self, docs: DataFrame) -> DataFrame:
        """``docs`` with ``posterior`` (of the votes) and ``score`` (of the scorer) from 0 to 1; other columns stay.

        A null or empty text has no word to judge: both are 0. Columns of these names are replaced.
        """
        at, schema = docs.columns.index("text"), docs.drop("posterior", "score").schema
        keep = [i for i, c in enumerate(docs.columns) if c not in ("posterior", "score")]
        weights, posterior = self.weights, self.posterior

        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            scores, posteriors = [], []
            for text in batch.column(at).to_pylist():
                raw = (text or "").encode()
                words = raw.split()
                posteriors.append(posterior.get(votes(statistics(raw, words)), 0.0) if words else 0.0)
                scores.append(float(1 / (1 + np.exp(-np.clip(features(words) @ weights, -500, 500)))) if words else 0.0)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in keep), pa.array(posteriors, pa.float64()), pa.array(scores, pa.float64())],
                [*(batch.schema.names[i] for i in keep), "posterior", "score"])

        return over_batches(docs, run, schema.add("posterior", "double").add("score", "double"))


def fit(docs: DataFrame, sample: int = SAMPLE) -> Quality:
    """Labellers' accuracies from all ``docs``, the scorer from about ``sample`` of them, chosen by hash of doc_id."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        numbers, index, value = [], [], []
        for chosen, text in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), strict=True):
            raw = (text or "").encode()
            words = raw.split()
            numbers.append(votes(statistics(raw, words)) if words else -1)
            own = features(words) if chosen and words else np.zeros(0)
            index.append(np.flatnonzero(own).astype(np.int32))
            value.append(own[np.flatnonzero(own)].astype(np.float32))
        yield pa.RecordBatch.from_arrays(
            [pa.array(numbers, pa.int32()), batch.column(1), pa.array(index, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32()))],
            ["votes", "chosen", "at", "value"])

    total = docs.count()
    share = F.shiftrightunsigned(F.xxhash64(F.lit("quality"), "doc_id"), 11) / float(1 << 53)
    voted = materialise(over_batches(docs.select("text", (share < sample / max(1, total)).alias("chosen")), run,
                                     "votes int, chosen boolean, at array<int>, value array<float>"), "votes").where("votes >= 0")
    rows = sorted((r["votes"], r["count"]) for r in voted.groupBy("votes").count().collect())
    numbers = [n for n, _ in rows]
    patterns = np.array([[n // 3 ** k % 3 for k in reversed(range(len(LABELLERS) + 1))] for n in numbers], np.int64).reshape(-1, len(LABELLERS) + 1)
    rates, posterior = accuracies(patterns, np.array([c for _, c in rows], float))
    labels = {n: float(p) for n, p in zip(numbers, posterior, strict=True)}
    taken = voted.where("chosen").select("votes", "at", "value").collect()
    x = np.zeros((len(taken), WIDTH), np.float32)
    for row, r in zip(x, taken, strict=True):
        row[r["at"]] = r["value"]
    return Quality(train(x, np.array([labels[r["votes"]] for r in taken])), labels, rates)
