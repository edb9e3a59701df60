"""Prefix trie of conversations, held as a node table under minimal perfect hashes.

Every conversation is a path of turns (role, text). A prefix is named by a digest of 128 bits: the sum, over its turns,
of hashes of (depth, role, text), so that prefixes come from running sums and no text is shuffled. Distinct digests are
the nodes; members, ends and children are counted by plain aggregates, which combine before they shuffle.

Sums over subtrees are made in shards. A node with more than ``SHARD`` members is a top node; below the last top node of
a path hangs one shard, which therefore holds whole subtrees. In its task a shard's digests get the slots of a minimal
perfect hash. A slot keeps its digest, and a look-up counts only if the digest is the one asked for, so a parent outside
the shard is told from one inside. Counts are scattered into flat arrays by slot, and added to the parents' slots from
the deepest nodes up. The sums of the shards' roots go to the top nodes, which are treated alike. Every
visit counts at one node, so fewer than ``TOP`` nodes are top nodes, whatever the table. Nodes with one member need no
sum: they are one branch without anything saved.

The digest of the members that end at a node is one hash over their ids in order; ids of a node run through it in a
stream, so that no list is held, however many they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .common import running_total

#: A top node has more than ``SHARD`` members and more than the ``TOP``-th part of all visits.
SHARD, TOP = 4096, 100_000
#: Shared nodes a task accumulates at a time, about.
NODES = 20_000
#: Turns summed in one window; longer conversations are summed bin by bin.
BIN = 256
_LANES = 4


def turn_facts(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, h1, h2, chars): hashes of (role, text) and the text's code points; null role or text is empty.

    Rows with a null conv_id belong to no conversation and are left out.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.xxhash64(role, text).alias("h1"), F.xxhash64(F.lit(1), role, text).alias("h2"), F.length(text).cast("long").alias("chars"))


def numbered(facts: DataFrame) -> DataFrame:
    """``facts`` with ``depth`` (from 1) in the order of turn, null first; equal turns in the order of their hashes."""
    placed = running_total(facts, ["conv_id"], ["turn", "h1", "h2"], F.lit(1), F.expr(f"floor(turn / {BIN})"), "before")
    return placed.select("conv_id", (F.col("before") + 1).alias("depth"), "h1", "h2", "chars")


def rebuilt(steps: DataFrame) -> DataFrame:
    """Each conversation c begins with the first h turns of conversation c - c % 100, then has its own after its first h.

    h is the checksum of c modulo 6; ``steps`` is what ``numbered`` returns.
    """
    base = F.col("conv_id") - F.col("conv_id") % 100
    lengths = steps.groupBy("conv_id").agg(F.count("*").alias("n"))
    convs = lengths.select("conv_id", base.alias("base"), (F.crc32(F.col("conv_id").cast("string")) % 6).alias("h"))
    donors = lengths.select(F.col("conv_id").alias("base"), F.col("n").alias("lent"))
    convs = materialise(convs.join(donors, "base", "left").withColumn("lent", F.least("h", F.coalesce("lent", F.lit(0)))), "convs")
    lending = steps.where("conv_id % 100 = 0 and depth <= 5").select(F.col("conv_id").alias("base"), "depth", "h1", "h2", "chars")
    begun = convs.join(lending, "base").where("depth <= h").select("conv_id", "depth", "h1", "h2", "chars")
    own = steps.join(convs, "conv_id").where("depth > h").select("conv_id", (F.col("depth") - F.col("h") + F.col("lent")).alias("depth"), "h1", "h2", "chars")
    return begun.unionByName(own)


def _visits(steps: DataFrame) -> DataFrame:
    """(conv_id, depth, d1, d2, p1, p2, chars): the node a conversation reaches with each turn, and the node before."""
    lanes = [F.xxhash64(F.lit(i), "depth", "h1", "h2").bitwiseAND(F.lit(0xFFFFFFFF)).alias(f"x{i}") for i in range(_LANES)]
    rows = steps.select("conv_id", "depth", "chars", F.floor(F.col("depth") / BIN).alias("bin"), *lanes)
    sums = rows.groupBy("conv_id", "bin").agg(*(F.sum(f"x{i}").alias(f"s{i}") for i in range(_LANES)))
    before = Window.partitionBy("conv_id").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("conv_id", "bin", *(F.coalesce(F.sum(f"s{i}").over(before), F.lit(0)).alias(f"s{i}") for i in range(_LANES)))
    upto = Window.partitionBy("conv_id", "bin").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    inner = rows.select("*", *(F.sum(f"x{i}").over(upto).alias(f"t{i}") for i in range(_LANES)))
    whole = inner.join(starts, ["conv_id", "bin"])
    digest = lambda value: [F.shiftleft(value(i).bitwiseAND(F.lit(0xFFFFFFFF)), 32).bitwiseOR(value(i + 1).bitwiseAND(F.lit(0xFFFFFFFF))) for i in (0, 2)]
    here = digest(lambda i: F.col(f"s{i}") + F.col(f"t{i}"))
    parent = digest(lambda i: F.col(f"s{i}") + F.col(f"t{i}") - F.col(f"x{i}"))
    return whole.select("conv_id", "depth", here[0].alias("d1"), here[1].alias("d2"), parent[0].alias("p1"), parent[1].alias("p2"), "chars")


class PerfectHash:
    """Minimal perfect hash of distinct 128-bit digests: each level places the keys that are alone in their spot."""

    def __init__(self, high: np.ndarray, low: np.ndarray) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        pending, placed = np.arange(high.size), 0
        while pending.size:
            if len(self.levels) > 200:
                raise ValueError("digests repeat")
            size = 2 * pending.size + 1
            spot = self._spot(high[pending], low[pending], len(self.levels), size)
            alone = np.bincount(spot, minlength=size) == 1
            self.levels.append((alone, placed + np.cumsum(alone) - alone))
            placed += int(alone.sum())
            pending = pending[~alone[spot]]

    @staticmethod
    def _spot(high: np.ndarray, low: np.ndarray, level: int, size: int) -> np.ndarray:
        x = high.astype(np.uint64) ^ (low.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64((level + 1) * 0xD6E8FEB86659FD93 % (1 << 64))
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        return (x % np.uint64(size)).astype(np.int64)

    def slots(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Slot of each digest; one that was not among the keys gets any slot or -1, so compare what the slot holds."""
        out, open_ = np.full(high.size, -1), np.arange(high.size)
        for level, (alone, rank) in enumerate(self.levels):
            spot = self._spot(high[open_], low[open_], level, alone.size)
            hit = alone[spot]
            out[open_[hit]] = rank[spot[hit]]
            open_ = open_[~hit]
        return out


def accumulate(nodes: pd.DataFrame) -> pd.DataFrame:
    """Sums of ``leaves`` and ``saved`` over the subtrees of a set of nodes (d1, d2, p1, p2, depth, leaves, saved).

    ``root`` marks nodes whose parent is not in the set.
    """
    high, low = nodes.d1.to_numpy(np.int64), nodes.d2.to_numpy(np.int64)
    up, up_low = nodes.p1.to_numpy(np.int64), nodes.p2.to_numpy(np.int64)
    table = PerfectHash(high, low)
    slot = table.slots(high, low)
    keys, keys_low = np.empty_like(high), np.empty_like(low)
    keys[slot], keys_low[slot] = high, low
    if not (np.array_equal(np.sort(slot), np.arange(high.size)) and np.array_equal(keys[slot], high) and np.array_equal(keys_low[slot], low)):
        raise ValueError("slots collide")
    parent = table.slots(up, up_low)
    inside = (parent >= 0) & (keys[parent] == up) & (keys_low[parent] == up_low) & (nodes.depth.to_numpy() > 0)
    leaves, saved, above = (np.zeros(high.size, np.int64) for _ in range(3))
    leaves[slot], saved[slot], above[slot] = nodes.leaves.to_numpy(), nodes.saved.to_numpy(), np.where(inside, parent, -1)
    depth = np.empty(high.size, np.int64)
    depth[slot] = nodes.depth.to_numpy()
    order = np.argsort(-depth, kind="stable")
    for same in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1):
        same = same[above[same] >= 0]
        np.add.at(leaves, above[same], leaves[same])
        np.add.at(saved, above[same], saved[same])
    return pd.DataFrame({"d1": high, "d2": low, "p1": up, "p2": up_low, "leaves": leaves[slot], "saved": saved[slot], "root": ~inside})


_SUMS = "d1 long, d2 long, p1 long, p2 long, leaves long, saved long, root boolean"


def _ends_hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("d1", pa.int64()), ("d2", pa.int64()), ("ends_sha256", pa.string())])
    out, current, running = [], None, None
    for batch in batches:
        for d1, d2, conv in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if current != (d1, d2):
                if current is not None:
                    out.append((*current, running.hexdigest()))
                current, running = (d1, d2), hashlib.sha256(str(conv).encode())
            else:
                running.update(f",{conv}".encode())
        if len(out) >= 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out = []
    if current is not None:
        out.append((*current, running.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def _with_parents(nodes: DataFrame, total: int) -> DataFrame:
    """``nodes`` with ``parent_conv_id``. A parent of more than a thousandth of all nodes, of which there are fewer than
    a thousand, is sent to its children; the others meet theirs by a join."""
    parents = nodes.select(F.col("d1").alias("p1"), F.col("d2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), "n_children").where("n_children > 0")
    crowded = F.col("n_children") * 1000 > total
    hot = F.broadcast(parents.where(crowded).drop("n_children"))
    own = nodes.where("depth > 0")
    met = own.join(hot, ["p1", "p2"]).unionByName(
        own.join(hot, ["p1", "p2"], "left_anti").join(parents.where(~crowded).drop("n_children"), ["p1", "p2"]))
    return met.unionByName(nodes.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))


def trie_of(steps: DataFrame, members: DataFrame) -> DataFrame:
    """The node table of ``steps`` (conv_id, depth, h1, h2, chars); ``members`` (conv_id) names every conversation.

    Per node: conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256. Without members there is no node, not even the root.
    """
    visits = materialise(_visits(steps), "visits")
    ids = members.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    zero = F.lit(0).cast("long")
    root = ids.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(
        zero.alias("d1"), zero.alias("d2"), F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"),
        "conv_id", zero.alias("depth"), "n_convs", zero.alias("chars"))
    met = visits.groupBy("d1", "d2").agg(
        F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"),
        F.count("*").alias("n_convs"), F.min("chars").alias("chars"))
    bare = materialise(met.unionByName(root.select(met.columns)), "nodes")
    lasts = visits.groupBy("conv_id").agg(F.max_by(F.struct("d1", "d2"), "depth").alias("at"))
    ends = ids.join(lasts, "conv_id", "left").select(F.coalesce("at.d1", zero).alias("d1"), F.coalesce("at.d2", zero).alias("d2"), "conv_id")
    hashes = ends.repartition("d1", "d2").sortWithinPartitions("d1", "d2", "conv_id").mapInArrow(_ends_hashed, "d1 long, d2 long, ends_sha256 string")
    children = bare.where("depth > 0").groupBy(F.col("p1").alias("d1"), F.col("p2").alias("d2")).agg(
        F.count("*").alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("n_single"))
    nodes = materialise(
        bare.join(hashes, ["d1", "d2"], "left").join(children, ["d1", "d2"], "left")
        .na.fill(0, ["n_children", "n_single"]).withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256))), "linked-nodes")

    total, visited, shared_count = nodes.agg(F.count("*"), F.sum("n_convs"), F.count_if((F.col("n_convs") > 1) | (F.col("depth") == 0))).first()
    limit = max(SHARD, (visited or 0) // TOP)
    is_top = (F.col("n_convs") > limit) | (F.col("depth") == 0)
    shared = nodes.where("n_convs > 1 or depth = 0").select(
        "d1", "d2", "p1", "p2", "conv_id", "depth", "n_convs",
        F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_single")).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    top = shared.where(is_top)
    shards = visits.join(F.broadcast(top.select("d1", "d2")), ["d1", "d2"], "left_anti").groupBy("conv_id").agg(
        F.min_by(F.struct("d1", "d2"), "depth").alias("shard"))
    below = shared.where(~is_top).join(shards, "conv_id").withColumn("bucket", F.expr(f"pmod(xxhash64(shard), {max(1, shared_count // NODES)})"))
    needed = ["d1", "d2", "p1", "p2", "depth", "leaves", "saved"]
    sums = materialise(below.select("bucket", *needed).groupBy("bucket").applyInPandas(
        accumulate, _SUMS), "sums")
    handed = sums.where("root").groupBy(F.col("p1").alias("d1"), F.col("p2").alias("d2")).agg(F.sum("leaves").alias("more"), F.sum("saved").alias("more_saved"))
    loaded = top.join(handed, ["d1", "d2"], "left").select(
        "d1", "d2", F.coalesce("p1", zero).alias("p1"), F.coalesce("p2", zero).alias("p2"), "depth",
        (F.col("leaves") + F.coalesce("more", zero)).alias("leaves"), (F.col("saved") + F.coalesce("more_saved", zero)).alias("saved"))
    top_sums = loaded.withColumn("bucket", F.lit(0)).groupBy("bucket").applyInPandas(accumulate, _SUMS)
    added = sums.unionByName(top_sums).select("d1", "d2", "leaves", "saved")
    return _with_parents(nodes, total).join(added, ["d1", "d2"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"),
        F.coalesce("saved", zero).alias("saved_tokens"), "ends_sha256")


def prefix_trie(turns: DataFrame) -> DataFrame:
    """The node table of conversations as they are: ``turns`` has conv_id, turn, role, text; other columns are ignored."""
    return trie_of(numbered(turn_facts(turns)), turns.select("conv_id"))
