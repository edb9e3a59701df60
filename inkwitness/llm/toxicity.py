"""Toxicity from a weighted lexicon, matched by an Aho-Corasick automaton over folded text.

Folding undoes disguise: look-alike letters of other scripts, digits and signs for letters, invisible characters, letter
case. What is no letter then separates words. The lexicon is learned from labelled documents: word beginnings and whole
words that toxic documents hold far oftener than clean ones, weighted by the logarithm of the ratio. At every word the
longest entry counts once. Phrases of two words around an entry that only clean documents hold are exceptions: in them
the entry does not count, and callers may name more. The weights found, as a sum and for each 100 words, go through a
logistic curve fitted to the same documents.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import over_batches

#: Labelled documents that the lexicon is learned from, at most about; chosen by hash of their ids.
SAMPLE = 12_000
#: Entries of the lexicon at most, the heaviest first, and characters of a word's beginning.
ENTRIES, LENGTHS = 4000, range(3, 11)
#: Documents that must hold an entry, and how many times likelier toxic ones must be to hold it.
SUPPORT, RATIO = 3, 8.0
#: Score from which a document is called toxic.
TOXIC = 0.7

# Letters of other scripts that look like Latin ones, and signs that stand for letters.
_LOOKALIKES = dict(zip("авеёкмнорстухіјѕԁԛԝһαβεικνορτυχγ", "abeekmhopctyxijsdqwhabeikvoptuxy", strict=True))
_SIGNS = dict(zip("0134579@$!|", "oieastgasii", strict=True))
_INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"


class _Fold(dict):
    """For ``str.translate``: lower-cased letters with look-alikes replaced; anything but letters and signs is a space."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        low = char.lower()
        if char in _INVISIBLE:
            out = ""
        elif low in _LOOKALIKES:
            out = _LOOKALIKES[low]
        elif "！" <= char <= "～":  # full-width forms
            out = chr(code - 0xFEE0).lower() if chr(code - 0xFEE0).isalpha() else " "
        else:
            out = low if char.isalpha() or char in _SIGNS else " "
        self[code] = out
        return out


_fold = _Fold()
_signs = str.maketrans(_SIGNS)


def folded(text: str | None) -> tuple[str, int]:
    """The folded text, words between single spaces with one before and after, and the number of its words.

    Signs become letters only inside a word that has a letter on their right; elsewhere they separate.
    """
    words = []
    for word in (text or "").translate(_fold).split():
        if word.isalpha():
            words.append(word)
            continue
        last = max((i for i, c in enumerate(word) if c.isalpha()), default=-1)
        words.extend(word[:last + 1].translate(_signs).split())
    return f" {' '.join(words)} ", len(words)


def entries(word: str) -> Iterator[str]:
    """Lexicon entries that a word could match: its beginnings, and the whole of it."""
    for size in LENGTHS:
        if size <= len(word):
            yield f" {word[:size]}"
    yield f" {word} "


@dataclass(frozen=True)
class Lexicon:
    weights: dict[str, float]
    exceptions: frozenset[str]
    curve: tuple[float, float, float]

    def score(self, text: str | None) -> float:
        """0 to 1 for a whole text; an empty one gets what no hit gets."""
        return _sigmoid(self.curve, *_measures(_matcher(self), *folded(text)))


@functools.lru_cache(maxsize=4)
def _automaton(weights: tuple, exceptions: frozenset[str]):
    found = ahocorasick.Automaton()
    for entry, weight in weights:
        found.add_word(entry, (len(entry.rstrip()) - 1, weight, 0))
    for phrase in exceptions:
        found.add_word(f" {phrase} ", (len(phrase), 0.0, len(phrase)))
    if len(found):
        found.make_automaton()
    return found


def _matcher(lexicon: Lexicon):
    return _automaton(tuple(sorted(lexicon.weights.items())), lexicon.exceptions)


def hits(automaton, text: str) -> dict[int, tuple[int, float]]:
    """Start of each word with a hit: (length, weight) of its longest entry, outside exception phrases."""
    best: dict[int, tuple[int, float]] = {}
    spared: list[tuple[int, int]] = []
    if len(automaton):
        for end, (length, weight, phrase) in automaton.iter(text):
            if phrase:
                spared.append((end - phrase, end))
                continue
            start = end - length + (0 if text[end] == " " else 1)
            if length > best.get(start, (0, 0.0))[0]:
                best[start] = (length, weight)
    if not spared:
        return best
    # one sweep: the first letter of every spared phrase, and the furthest end of the phrases begun so far
    spared.sort()
    begins = np.array([a for a, _ in spared])
    ends = np.maximum.accumulate(np.array([b for _, b in spared]))
    starts = np.fromiter(best, np.int64, len(best))
    before = np.searchsorted(begins, starts, side="right") - 1
    inside = (before >= 0) & (starts < ends[before])
    return {s: v for (s, v), skip in zip(best.items(), inside.tolist(), strict=True) if not skip}


def _measures(automaton, text: str, words: int) -> tuple[float, float]:
    total = sum(weight for _, weight in hits(automaton, text).values())
    return math.log1p(total), 100 * total / max(words, 20)


def _sigmoid(curve: tuple[float, float, float], total: float, dense: float) -> float:
    return float(1 / (1 + math.exp(-max(-500.0, min(500.0, curve[0] + curve[1] * total + curve[2] * dense)))))


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression by Newton's method with a small penalty; no slope is negative."""
    z, beta = np.column_stack([np.ones(len(x)), x]), np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        hess = (z * (p * (1 - p))[:, None]).T @ z + np.diag([1e-3, 1e-2, 1e-2])
        step = np.linalg.solve(hess, z.T @ (y - p) - np.array([1e-3, 1e-2, 1e-2]) * beta)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), max(0.0, float(beta[1])), max(0.0, float(beta[2]))


def learn(docs: DataFrame, labels: DataFrame, exceptions: Iterable[str] = (), sample: int = SAMPLE) -> Lexicon:
    """Lexicon and curve from ``labels`` (doc_id, toxic 0 or 1, others ignored) of ``docs`` (doc_id, text).

    Nulls on either side are left out; a document labelled more than once counts each time. About ``sample`` labels are
    used, by hash of doc_id. Without a toxic or a clean label the lexicon is empty and every score is the share of toxic labels.
    """
    labels = labels.where("doc_id is not null and toxic in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
    share = sample / max(1, labels.count())
    chosen = labels.where(F.shiftrightunsigned(F.xxhash64(F.lit("toxic"), "doc_id"), 11) / float(1 << 53) < share)
    train = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").join(
        F.broadcast(chosen), "doc_id").select("text", "toxic")  # bounded by the sample

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[Counter] = [Counter(), Counter()]
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = set(folded(text)[0].split())
                seen[toxic].update({e for w in words for e in entries(w)} | {""})
        names = list(seen[0].keys() | seen[1].keys())
        for at in range(0, len(names), 100_000):
            part = names[at:at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *(pa.array([s[n] for n in part], pa.int64()) for s in seen)],
                                             ["entry", "clean", "toxic"])

    counts = train.mapInArrow(held, "entry string, clean long, toxic long").groupBy("entry").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    totals = counts.where("entry = ''").collect()
    clean, toxic = (totals[0]["clean"], totals[0]["toxic"]) if totals else (0, 0)
    if not clean or not toxic:
        odds = math.log((toxic + 0.5) / (clean + 0.5))
        return Lexicon({}, frozenset(), (odds, 0.0, 0.0))
    ratio = ((F.col("toxic") + 0.5) / (toxic + 1)) / ((F.col("clean") + 0.5) / (clean + 1))
    heavy = counts.where((F.col("entry") != "") & (F.col("toxic") >= SUPPORT)).withColumn("ratio", ratio).where(F.col("ratio") >= RATIO)
    weights = {r["entry"]: math.log(r["ratio"]) for r in heavy.orderBy(F.desc("ratio"), "entry").limit(ENTRIES).collect()}
    plain = Lexicon(weights, frozenset(), (0.0, 0.0, 0.0))

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, seen = _matcher(plain), [Counter(), Counter()]
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                plain_text = folded(text)[0]
                phrases = set()
                for start in hits(automaton, plain_text):
                    word = plain_text[start:plain_text.index(" ", start)]
                    phrases.add(f"{word} {plain_text[start + len(word):].split(' ', 2)[1]}".rstrip())
                    phrases.add(f"{plain_text[:start - 1].rsplit(' ', 1)[-1]} {word}".lstrip())
                seen[label].update(p for p in phrases if " " in p)
        names = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([s[n] for n in names], pa.int64()) for s in seen)],
                                         ["phrase", "clean", "toxic"])

    spared = train.mapInArrow(around, "phrase string, clean long, toxic long").groupBy("phrase").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where(f"clean >= {SUPPORT} and toxic = 0")
    named = {folded(p)[0].strip() for p in exceptions} - {""}
    lexicon = Lexicon(weights, frozenset({r["phrase"] for r in spared.orderBy(F.desc("clean"), "phrase").limit(ENTRIES).collect()} | named), (0.0, 0.0, 0.0))

    def measured(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        automaton = _matcher(lexicon)
        both = [_measures(automaton, *folded(text)) for text in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in both], pa.float64()), pa.array([m[1] for m in both], pa.float64()), batch.column(1)],
                                         ["total", "dense", "toxic"])

    rows = over_batches(train.select("text", F.col("toxic").cast("int")), measured, "total double, dense double, toxic int").orderBy("total", "dense", "toxic").collect()
    x = np.array([(r["total"], r["dense"]) for r in rows])
    return Lexicon(weights, lexicon.exceptions, _curve(x, np.array([r["toxic"] for r in rows], float)))


def toxicity(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, score, predicted) of every row of ``docs``, whole texts; nulls and empty texts score as texts without a hit."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        scores = [lexicon.score(text) for text in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= TOXIC) for s in scores], pa.int32())],
            ["doc_id", "score", "predicted"])

    return over_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, score double, predicted int")
