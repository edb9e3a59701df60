"""Document fingerprints from closed syncmers.

A run of ``K`` characters is an anchor when the smallest of its inner runs of ``S`` characters is its first or its last.
That depends on those characters alone, so an anchor stays one wherever its text goes. A text is framed by ``K - 1``
boundary characters, so short texts have anchors as well. The fingerprint keeps the ``KEPT`` anchors with the smallest
hash values and where they stand, all in hexadecimal; it covers the whole text. Two fingerprints are likened on the
smallest anchors of both together: those in common that also follow each other in the same order, as a Dice share.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of an anchor and of its inner runs; anchors in a fingerprint; characters worked on at a time.
K, S, KEPT, STRETCH = 16, 5, 64, 1 << 20
_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> _U(31)
    x *= _U(0x9E3779B97F4A7C15)
    x ^= x >> _U(29)
    return x


def _anchors(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """32-bit names and places of the closed syncmers of a stretch of code points."""
    inner = codes[:len(codes) - S + 1].astype(_U)
    for i in range(1, S):
        inner *= _U(0x100000001B3)
        inner += codes[i:len(codes) - S + 1 + i]
    inner = _mixed(inner)
    width = K - S + 1  # 12 inner runs: minima of 2, 4, 8, then two of 8 that overlap
    low = inner
    for step in (1, 2, 4):
        low = np.minimum(low[:-step], low[step:])
    low = np.minimum(low[:len(inner) - width + 1], low[width - 8:width - 8 + len(inner) - width + 1])
    count = len(low)
    at = np.flatnonzero((inner[:count] == low) | (inner[width - 1:width - 1 + count] == low))
    name = inner[at].copy()
    for place in (5, 10, 11):  # inner runs that cover the anchor
        name *= _U(0xD6E8FEB86659FD93)
        name ^= inner[at + place]
    return (_mixed(name) >> _U(32)).astype(np.uint32), at


def fingerprint(text: str) -> np.ndarray:
    """Rows (name, place) of the kept anchors, by name; none for an empty text. Of equal anchors the first place counts."""
    if not text:
        return np.zeros((0, 2), np.uint32)
    codes = np.concatenate([np.full(K - 1, 0x110000, np.uint32), np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32),
                            np.full(K - 1, 0x110001, np.uint32)]).astype(_U)
    names, places = np.zeros(0, np.uint32), np.zeros(0, np.int64)
    for start in range(0, len(codes) - K + 1, STRETCH):
        name, at = _anchors(codes[start:start + STRETCH + K - 1])
        names, first = np.unique(np.concatenate([names, name]), return_index=True)
        places = np.concatenate([places, at + start])[first][:KEPT]
        names = names[:KEPT]
    return np.column_stack([names, places.astype(np.uint32)])


def printed(own: np.ndarray) -> str:
    return own.astype(">u4").tobytes().hex()


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    """0 to 1; 1 for equal fingerprints (two empty ones as well)."""
    if np.array_equal(x, y):
        return 1.0
    if not len(x) or not len(y):
        return 0.0
    union = np.union1d(x[:, 0], y[:, 0])
    # a full fingerprint says nothing about names beyond its last
    least = min([own[-1, 0] for own in (x, y) if len(own) == KEPT], default=union[-1])
    union = union[union <= least]
    both, at, other = np.intersect1d(x[:, 0], y[:, 0], assume_unique=True, return_indices=True)
    near = both <= least
    order = y[other[near], 1][np.argsort(x[at[near], 1], kind="stable")]
    tails: list[int] = []
    for place in order.tolist():
        spot = bisect_left(tails, place)
        tails[spot:spot + 1] = [place]
    share = len(tails) / len(union)
    return 2 * share / (1 + share)


def edited(text: str, following: str) -> str:
    """``text`` with its last half given way to as many characters, or all, of ``following``."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and what they are like.

    ``docs`` has doc_id and text; other columns are ignored; null texts are empty. The next document is the one with the
    next doc_id (null ids come last, rows of the same id by text; the first follows the last). Returns doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Documents are dealt out by ranges of ids that begin at ids in the table, so the first document of each range, copied
    to the range before, is all that a range needs of others. A range is read as a stream, one document in hand.
    """
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    count = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = own.agg(F.min("doc_id").alias("low"), F.percentile_approx("doc_id", [i / count for i in range(1, count)], 100 * count).alias("cuts")).first()
    bounds = np.array(sorted({found["low"], *(found["cuts"] or [])} - {None}), np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            known = ~np.array(ids.is_null())
            value = np.where(known, ids.fill_null(0).to_numpy(zero_copy_only=False), 0)
            home = np.where(known, np.searchsorted(bounds, value, side="right") - 1, max(0, len(bounds) - 1)).astype(np.int32)
            guest = np.flatnonzero(known & np.isin(value, bounds))
            at = np.concatenate([np.arange(len(home)), guest])
            part = np.concatenate([home, (home[guest] - 1) % max(1, len(bounds))]).astype(np.int32)
            rows = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.arange(len(at)) >= len(home)), *rows.columns],
                                             ["part", "guest", "doc_id", "text"])

    dealt = (own.mapInArrow(deal, "part int, guest boolean, doc_id long, text string").repartition("part")
             .sortWithinPartitions("part", "guest", F.col("doc_id").isNull(), "doc_id", "text"))

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, held, out = None, None, None, []

        def describe(doc, following):
            doc_id, text, print_ = doc
            changed = edited(text, following[1])
            other = print_ if changed == text else fingerprint(changed)
            return (doc_id, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), printed(print_), printed(other),
                    likeness(print_, other), likeness(print_, following[2]))

        def batch_of(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        for batch in batches:
            for of, guest, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if of != part:
                    if held is not None:
                        out.append(describe(held, first))
                    part, first, held = of, None, None
                if guest and held is None:
                    continue  # its follower was given already, or the range has no document
                here = (doc_id, text, held[2] if held is not None and held[1] == text else fingerprint(text))
                first = first or here
                if held is not None:
                    out.append(describe(held, here))
                held = None if guest else here
            if len(out) >= 500:
                yield batch_of(out)
                out = []
        if held is not None:
            out.append(describe(held, first))
        if out:
            yield batch_of(out)

    return dealt.mapInArrow(follow, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
                                    "near_edited double, near_next double")
