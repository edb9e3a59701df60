"""Packing documents into sequences of one length by cutting-stock column generation.

Every document is cut into whole sequences and one remainder. Remainders are stock lengths: their histogram, in classes
a few tokens wide, is all the driver sees. A linear program over patterns (which classes fill one sequence) is solved
by column generation: the simplex method holds one pattern per class, and a knapsack dynamic program prices the pattern
that would help most, until none does. Rounded down, the patterns cover all but a bounded number of pieces, whatever the
corpus; first-fit decreasing gives those their own patterns. On the cluster the pieces of a class are ranked, and a
piece's rank says which copy of which pattern it fills.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .common import over_batches, running_total
from .word_tokens import word_tokenizer

#: A ranked class is counted in so many bins before it is numbered.
RANK_BINS = 1024


def token_pieces(docs: DataFrame, tokenizer: str, length: int, end_id: int) -> DataFrame:
    """Pieces of each document's ids with ``end_id`` after them: whole sequences, then the remainder."""

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        words, end = word_tokenizer(tokenizer), array("I", [end_id]).tobytes()
        rows: list[list] = [[], [], [], [], []]
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids = memoryview(words.ids(text) + end)
            total = len(ids) // 4
            for start in range(0, total, length):
                piece = ids[4 * start:4 * (start + length)]
                for column, value in zip(rows, (doc_id, start, len(piece) // 4, zlib.crc32(piece), total), strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows],
                                         ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return over_batches(docs.select(F.col("doc_id").cast("long"), "text"), cut,
                        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def _best_pattern(value: np.ndarray, size: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Knapsack by dynamic programming: how often to take each class, sizes within ``capacity``, for most value."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    useful = np.flatnonzero(value > 1e-12)
    sizes, values = size[useful], value[useful]
    for room in range(1, capacity + 1):
        fits = np.searchsorted(sizes, room, side="right")
        best[room], choice[room] = best[room - 1], -1
        if fits:
            gains = best[room - sizes[:fits]] + values[:fits]
            top = int(gains.argmax())
            if gains[top] > best[room] + 1e-12:
                best[room], choice[room] = gains[top], top
    pattern, room = np.zeros(len(size)), capacity
    while room:
        if choice[room] < 0:
            room -= 1
        else:
            pattern[useful[choice[room]]] += 1
            room -= sizes[choice[room]]
    return best[capacity], pattern


def fractional_patterns(size: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows) and how often to use each, so that ``demand`` is met with the fewest sequences; ``size`` ascending.

    Stops when no pattern helps, or when Farley's bound says the optimum is within ``gap``.
    """
    count = len(size)
    patterns = np.diag((capacity // size).astype(float))
    inverse = np.diag(1 / np.diag(patterns))
    cost, used = np.ones(count), inverse @ demand
    for _ in range(50 * count + 1000):
        dual = cost @ inverse
        worth, column = _best_pattern(dual, size, capacity)
        price = 1.0
        if dual.min() < -1e-9 and -dual.min() > worth - 1:  # more than asked for is fine
            column, price = np.zeros(count), 0.0
            column[dual.argmin()] = -1
        elif worth <= 1 + 1e-9 or (dual.min() > -1e-9 and cost @ used * (1 - 1 / worth) <= gap * (cost @ used)):
            break
        toward = inverse @ column
        ahead = np.flatnonzero(toward > 1e-10)
        leave = ahead[np.argmin(used[ahead] / toward[ahead])]
        step = max(0.0, used[leave] / toward[leave])
        used = np.maximum(used - step * toward, 0)
        used[leave] = step
        row = inverse[leave] / toward[leave]
        inverse = inverse - np.outer(toward, row)
        inverse[leave] = row
        patterns[:, leave], cost[leave] = column, price
    real = cost > 0
    return patterns.T[real], used[real]


def whole_patterns(size: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Whole numbers of patterns that hold every piece: the linear program rounded down, first-fit decreasing for the rest."""
    chosen: list[tuple[np.ndarray, int]] = []
    left = demand.astype(np.int64).copy()
    for _ in range(8):  # each pass rounds down what the last one left over
        held = np.flatnonzero(left)
        if not len(held) or left.sum() <= 2 * len(size):
            break
        patterns, used = fractional_patterns(size[held], left[held].astype(float), capacity)
        before = left.sum()
        for pattern, times in zip(patterns, np.floor(used + 1e-6).astype(np.int64), strict=True):
            full = np.zeros(len(size), np.int64)
            full[held] = np.rint(pattern).astype(np.int64)
            if times and full.any():
                chosen.append((full, int(times)))
                left = np.maximum(left - full * times, 0)
        if left.sum() == before:
            break
    bins: list[list] = []
    for index in np.flatnonzero(left)[::-1]:
        for _ in range(left[index]):
            home = next((b for b in bins if b[0] >= size[index]), None)
            if home is None:
                bins.append(home := [capacity, np.zeros(len(size), np.int64)])
            home[0] -= size[index]
            home[1][index] += 1
    return chosen + [(b[1], 1) for b in bins]


def pack(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 1, width: int = 8) -> DataFrame:
    """Every token of every document in exactly one place of one sequence.

    ``docs`` has ``doc_id`` and ``text``; other columns are ignored; ``length`` is a multiple of ``width``. Returns one
    row per piece: doc_id, start (ids of its document before it), length, ids_crc32 (of the ids as little-endian unsigned
    32-bit), doc_tokens (with ``end_id``), sequence_id, offset (its place there, without gaps from 0). A null or empty
    text is ``end_id`` alone. Repeated rows are packed as often as they come; a null id stays null. An empty table gives
    no row. Sequences are numbered from 0 by pattern.
    """
    spark = docs.sparkSession
    pieces = materialise(token_pieces(docs, tokenizer, length, end_id), "pieces")
    classed = pieces.withColumn("class", F.ceil(F.col("length") / width).cast("int"))
    held = sorted((r["class"], r["count"]) for r in classed.groupBy("class").count().collect())
    size = np.array([c for c, _ in held], np.int64)
    patterns = whole_patterns(size, np.array([n for _, n in held], np.int64), length // width)

    # by class and rank: the first rank that a pattern takes, copies of the class in it, its first sequence
    taken, first, spans = np.zeros(len(size), np.int64), 0, []
    for pattern, times in patterns:
        for index in np.flatnonzero(pattern):
            spans.append((int(size[index]) << 48 | int(taken[index]), int(pattern[index]), first, int(taken[index])))
            taken[index] += pattern[index] * times
        first += times
    spans.sort()
    key, copies, base, low = (np.array(c, np.int64) for c in zip(*spans, strict=True)) if spans else (np.zeros(0, np.int64),) * 4

    def place(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own = (batch.column("class").to_numpy().astype(np.int64) << 48) | batch.column("rank").to_numpy()
        at = np.searchsorted(key, own, side="right") - 1
        sequence = base[at] + (batch.column("rank").to_numpy() - low[at]) // copies[at]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequence)], [*batch.schema.names, "sequence_id"])

    ranked = running_total(classed, ["class"], ["doc_id", "start", "ids_crc32", "doc_tokens"], F.lit(1),
                           F.pmod(F.xxhash64("doc_id", "start"), F.lit(RANK_BINS)), "rank")
    placed = over_batches(ranked, place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class int, "
                                         "rank long, sequence_id long") if spans else spark.createDataFrame(
        [], "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class int, rank long, sequence_id long")
    before = Window.partitionBy("sequence_id").orderBy(F.desc("class"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
                         F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"))
