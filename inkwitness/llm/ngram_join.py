"""N-gram Jaccard join: groups of documents whose word n-gram sets overlap almost wholly.

A document is the set of its distinct word n-grams, each named by 64 bits. Two sets of Jaccard ``percent / 100`` or more
must share an n-gram among the first ``n - ceil(n * percent / 100) + 1`` of either, under any one order of all n-grams;
with rare n-grams first, few documents meet there. How rare an n-gram is comes from a counter table of fixed size over
the whole corpus; a shared counter only makes the order less rare-first, never the answer wrong.

1. ``counters`` adds up the table. 2. ``signatures`` writes each document's prefix and the histogram of its set; equal
sets are one class from here on. 3. Prefix n-grams that only one class has are dropped. 4. Every class proposes itself to
a leader: the class with the fewest rarer n-grams ahead of a shared one. Accepted proposals are links, and components
are formed. 5. What can still join components, i.e. pairs that share a prefix n-gram across two components, passes the
length, positional and suffix filters and is verified, each pair once; then the components are final.

Steps 4 and 5 leave out only pairs inside one component, which change no component; a thousand near copies of one text
cost a thousand proposals, not a million pairs. No n-gram, however common, is cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialise
from .common import components, over_batches, thinned

#: log2 of the number of counters: 8 MB in the driver, 1 MB of ranks in each task, whatever the corpus.
COUNTER_BITS = 20
#: Longs of the bitmap (2 MB) that keeps n-grams of one class out of the shuffle; where it fills up, it keeps out fewer.
FILTER_WORDS = 1 << 18
#: Classes with one n-gram that are compared inside one join key.
BLOCK = 1024
#: Parts of a set whose sizes the suffix filter compares.
PARTS = 16

_U = np.uint64
_CACHE_WORDS = 500_000


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = _WordHashes()


def ngram_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit names of the word ``n``-grams of a text.

    Words are runs of characters other than ASCII white space with A-Z lower-cased (what ``bytes.lower`` and
    ``bytes.split`` do). A text with fewer words has its whole sequence as its only member; no word, no member.
    """
    words = np.fromiter(map(_words.__getitem__, (text or "").encode().lower().split()), dtype=_U)
    width = min(n, len(words))
    if not width:
        return words
    size = len(words) - width + 1
    name = words[:size] + _U(width)
    for at in range(1, width):
        name *= _U(0x9E3779B97F4A7C15)
        name ^= name >> _U(29)
        name += words[at:at + size]
    name ^= name >> _U(30)
    name *= _U(0xBF58476D1CE4E5B9)
    name ^= name >> _U(27)
    name.sort()
    return name[np.concatenate([[True], name[1:] != name[:-1]])]


def counters(docs: DataFrame, n: int) -> np.ndarray:
    """Rank 0 (rare) to 255 (frequent) of every counter, from the number of documents that hold its n-grams.

    Each task counts what it reads; counters are summed in groups of 64 columns before and after the shuffle.
    """
    width, lanes = 1 << COUNTER_BITS, 64

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(width, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                np.add.at(held, (ngram_set(text, n) >> _U(64 - COUNTER_BITS)).astype(np.int64), 1)
        by_lane = held.reshape(-1, lanes)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(by_lane), dtype=np.int32)), *(pa.array(np.ascontiguousarray(by_lane[:, i])) for i in range(lanes))],
            ["slot", *(f"c{i}" for i in range(lanes))])

    parts = docs.select("text").mapInArrow(count, "slot int, " + ", ".join(f"c{i} long" for i in range(lanes)))
    rows = parts.groupBy("slot").agg(*(F.sum(f"c{i}").alias(f"c{i}") for i in range(lanes))).toPandas()
    held = np.zeros((width // lanes, lanes))
    if len(rows):
        held[rows["slot"].to_numpy()] = rows[[f"c{i}" for i in range(lanes)]].to_numpy()
    return np.minimum(255, 8 * np.log2(1 + held.reshape(-1))).astype(np.uint8)


def signatures(docs: DataFrame, ranks: np.ndarray, n: int, percent: int) -> DataFrame:
    """Per document: size of its set, a 128-bit name of the set, its prefix in rare-first order, its histogram."""

    def sign(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sizes, names, prefixes, parts = [], [], [], []
        for text in batch.column(1).to_pylist():
            own = ngram_set(text, n)
            size = len(own)
            sizes.append(size)
            names.append(xxhash.xxh3_128_hexdigest(own.tobytes()))
            order = (ranks[(own >> _U(64 - COUNTER_BITS)).astype(np.int64)].astype(_U) << _U(56)) | (own >> _U(8))
            length = size - -(-size * percent // 100) + 1 if size else 0
            prefixes.append(own[np.argsort(order, kind="stable")[:length]].view(np.int64))
            parts.append(np.bincount((own >> _U(60)).astype(np.int64), minlength=PARTS).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(names, pa.string()),
             pa.array(prefixes, pa.list_(pa.int64())), pa.array(parts, pa.list_(pa.int32()))],
            ["doc_id", "n_shingles", "set_name", "prefix", "parts"])

    return over_batches(docs.select(F.col("doc_id").cast("long"), "text"), sign,
                        "doc_id long, n_shingles long, set_name string, prefix array<long>, parts array<int>")


def _need(percent: int) -> str:
    """The least overlap of linked sets of sizes n and m: percent * (n + m - overlap) <= 100 * overlap."""
    return f"(({percent} * (n + m) + {99 + percent}) div {100 + percent})"


def _in_reach(percent: int) -> Column:
    """Length and positional filter on a meeting of (n, pos) with (m, at)."""
    return F.expr(f"100 * least(n, m) >= {percent} * greatest(n, m) and least(n - pos, m - at) >= {_need(percent)}")


def _alike(pairs: DataFrame, stands: DataFrame, percent: int) -> DataFrame:
    """The pairs that pass the suffix filter, which compares the histograms of the two sets."""
    side = lambda key, size, parts: stands.select(F.col("doc_id").alias(key), F.col("n_shingles").cast("int").alias(size), F.col("parts").alias(parts))
    both = pairs.join(side("a", "n", "parts"), "a").join(side("b", "m", "others"), "b")
    apart = F.aggregate(F.zip_with("parts", "others", lambda x, y: F.abs(x - y)), F.lit(0), lambda total, x: total + x)
    return both.where(apart <= F.expr(f"n + m - 2 * {_need(percent)}")).select(pairs.columns)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link, compared once each."""

    def compare(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        linked = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            x, y = np.frombuffer(x, _U), np.frombuffer(y, _U)
            both = len(np.intersect1d(x, y, assume_unique=True))
            linked.append(100 * both >= percent * (len(x) + len(y) - both))
        yield batch.select([0, 1]).filter(pa.array(linked, pa.bool_()))

    first = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("members").alias("x")), "a")
    both = first.join(sets.select(F.col("doc_id").alias("b"), F.col("members").alias("y")), "b")
    return over_batches(both.select("a", "b", "x", "y"), compare, "a long, b long")


def ngram_groups(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """Components of documents linked by the Jaccard similarity of their word ``n``-gram sets.

    ``docs`` has ``doc_id`` and ``text``; other columns are ignored. Two documents link when
    ``100 * intersection >= percent * union``. Returns (doc_id, n_shingles, component_id), one row per input row.
    A null or empty text has no n-grams and links with nothing; its component is its own id. Rows with the same id are
    one node: each row keeps its own size, and links of any of them count. A null id stays null and links with nothing.
    """
    signed = materialise(signatures(docs, counters(docs, n), n, percent), "signatures")
    filled = signed.where("n_shingles > 0 and doc_id is not null")
    classes = materialise(filled.groupBy("set_name").agg(F.min("doc_id").alias("first")), "classes")
    same = filled.select("doc_id", "set_name").join(classes, "set_name").where("doc_id <> first")
    same = materialise(same.select(F.col("doc_id").alias("a"), F.col("first").alias("b")).distinct(), "same")

    # one document of each class stands for it; prefix n-grams that another class has as well move once
    stands = materialise(
        filled.join(classes.select("set_name", F.col("first").alias("doc_id")), ["set_name", "doc_id"], "left_semi")
        .select("doc_id", "n_shingles", "prefix", "parts"), "stands")
    discard(classes)
    rows = stands.select("doc_id", F.col("n_shingles").cast("int").alias("n"), F.posexplode("prefix").alias("pos", "gram"))
    shared = materialise(rows.groupBy("gram").agg(F.count("*").alias("held")).where("held > 1"), "shared")
    meeting = materialise(thinned(rows, "gram", shared, FILTER_WORDS).join(shared, "gram"), "meeting")
    discard(shared)

    # proposals: each class to the leaders of the n-grams it shares
    leaders = meeting.groupBy("gram").agg(F.min(F.struct("pos", "doc_id", "n")).alias("lead")).select(
        "gram", F.col("lead.doc_id").alias("leader"), F.col("lead.n").alias("m"), F.col("lead.pos").alias("at"))
    proposals = (meeting.join(leaders, "gram").where("doc_id <> leader").where(_in_reach(percent))
                 .select(F.least("doc_id", "leader").alias("a"), F.greatest("doc_id", "leader").alias("b")).distinct())
    proposals = materialise(_alike(proposals, stands, percent), "proposals")
    sets = _sets(docs, proposals.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), n)
    links = materialise(_verified(proposals, sets, percent), "links")
    discard(sets)
    led = components(links)

    # what may still join two components; an n-gram that many classes have is cut into blocks
    left = materialise(
        meeting.join(led.select(F.col("id").alias("doc_id"), "component"), "doc_id", "left")
        .withColumn("component", F.coalesce("component", "doc_id")), "left")
    discard(meeting, led)
    mixed = left.groupBy("gram").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("gram")
    crowds = left.join(mixed, "gram").withColumn("blocks", F.expr(f"cast((held + {BLOCK - 1}) div {BLOCK} as int)")).withColumn(
        "own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    one = crowds.select("gram", "doc_id", "n", "pos", "component", F.col("own").alias("x"), every.alias("y"))
    other = crowds.select("gram", F.col("doc_id").alias("other"), F.col("n").alias("m"), F.col("pos").alias("at"), F.col("component").alias("its"),
                          F.col("own").alias("y"), every.alias("x"))
    rest = (one.join(other, ["gram", "x", "y"]).where("doc_id < other and component <> its").where(_in_reach(percent))
            .select(F.col("doc_id").alias("a"), F.col("other").alias("b")).distinct()
            .join(proposals, ["a", "b"], "left_anti"))
    rest = materialise(_alike(rest, stands, percent), "rest")
    discard(left, stands, proposals)
    if not rest.isEmpty():
        more = _sets(docs, rest.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), n)
        links = links.unionByName(materialise(_verified(rest, more, percent), "links"))
        discard(more)

    final = components(links.unionByName(same))
    return signed.select("doc_id", "n_shingles").join(final.select(F.col("id").alias("doc_id"), "component"), "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def _sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """The n-gram sets of the wanted documents, as sorted 64-bit names; a repeated id has one for each of its rows."""

    def gather(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([ngram_set(text, n).tobytes() for text in batch.column(1).to_pylist()], pa.binary())],
            ["doc_id", "members"])

    own = thinned(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", wanted).join(wanted, "doc_id", "left_semi")
    return materialise(over_batches(own, gather, "doc_id long, members binary"), "sets")
