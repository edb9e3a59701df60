"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern, the set of sources that hold them. Each pattern supplies its words once
for nothing and again at a cost that grows with each repetition; each source takes up to its target. Min-cost flow over
this small network decides how many words of each pattern go to each source. Documents stand in a seeded order inside
their pattern, and the flow takes words from its front; what a source takes beyond all of them starts again at the front.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import running_total

#: Weights of the sources in their order, repeating.
WEIGHTS = (5, 2, 1)
#: A pattern's documents are counted in so many bins of their seeded order.
ORDER_BINS = 4096
#: Rows of a plan that may be sent to every task.
SENT = 100_000


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, repeats: int = 2) -> dict[str | None, float]:
    """Words asked of each source: ``share`` of all words by weight, at most ``repeats`` times its own.

    Sources stand by code point, null last, and take the weights in turn. What a source cannot take goes to the others by
    weight, again and again, until none is above its limit.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    rest, out = dict.fromkeys(order), dict.fromkeys(order, 0.0)
    left = share * sum(sizes.values())
    while rest:
        whole = sum(weight[s] for s in rest)
        part = {s: left * weight[s] / whole for s in rest}
        above = [s for s in rest if part[s] > repeats * sizes[s]]
        if not above:
            return out | part
        for s in above:
            out[s] = float(repeats * sizes[s])
            left -= out[s]
            del rest[s]
    return out


def route(supply: list[int], members: list[list[int]], demand: list[int], repeats: int) -> list[dict[int, int]]:
    """Min-cost flow: words of each pattern for each source.

    Arcs: start to pattern, one per repetition with capacity ``supply`` and cost 0, 1, 4, ... ; pattern to its member
    sources; source to end with capacity ``demand``. Cheapest augmenting paths with potentials, as whole numbers.
    """
    patterns, sources = len(supply), len(demand)
    end = 1 + patterns + sources
    to, room, cost, arcs = [], [], [], [[] for _ in range(end + 1)]

    def arc(a: int, b: int, capacity: int, price: int) -> int:
        for x, y, c, p in ((a, b, capacity, price), (b, a, 0, -price)):
            arcs[x].append(len(to))
            to.append(y), room.append(c), cost.append(p)
        return len(to) - 2

    between = {}
    for p in range(patterns):
        for again in range(repeats):
            arc(0, 1 + p, supply[p], again * again)
        for s in members[p]:
            between[p, s] = arc(1 + p, 1 + patterns + s, repeats * supply[p], 0)
    for s in range(sources):
        arc(1 + patterns + s, end, demand[s], 0)
    potential = [0] * (end + 1)
    while True:
        far, via, heap = [None] * (end + 1), [-1] * (end + 1), [(0, 0)]
        far[0] = 0
        while heap:
            d, x = heapq.heappop(heap)
            if d > far[x]:
                continue
            for a in arcs[x]:
                y = to[a]
                if room[a] and (far[y] is None or d + cost[a] + potential[x] - potential[y] < far[y]):
                    far[y], via[y] = d + cost[a] + potential[x] - potential[y], a
                    heapq.heappush(heap, (far[y], y))
        if far[end] is None:
            break
        top = max(f for f in far if f is not None)
        potential = [p + (top if f is None else f) for p, f in zip(potential, far, strict=True)]
        path, x = [], end
        while x:
            path.append(via[x])
            x = to[via[x] ^ 1]
        amount = min(room[a] for a in path)
        for a in path:
            room[a] -= amount
            room[a ^ 1] += amount
    flow: list[dict[int, int]] = [{} for _ in range(patterns)]
    for (p, s), a in between.items():
        if room[a ^ 1]:
            flow[p][s] = room[a ^ 1]
    return flow


def settle(supply: list[int], members: list[list[int]], demand: list[int], repeats: int) -> list[dict[int, int]]:
    """``route``, with sources that share no document settled in closed form, so that the network has overlaps only."""
    overlapping = {s for held in members if len(held) > 1 for s in held}
    inner = [p for p, held in enumerate(members) if any(s in overlapping for s in held)]
    names = sorted(overlapping)
    number = {s: i for i, s in enumerate(names)}
    flow: list[dict[int, int]] = [{held[0]: min(demand[held[0]], repeats * supply[p])} if len(held) == 1 else {} for p, held in enumerate(members)]
    found = route([supply[p] for p in inner], [[number[s] for s in members[p]] for p in inner], [demand[s] for s in names], repeats)
    for p, part in zip(inner, found, strict=True):
        flow[p] = {names[s]: words for s, words in part.items()}
    return flow


ADDED = ("size", "source_size", "target", "taken", "whole")


def mix(docs: DataFrame, members: Column, size: Column, asked: dict[str | None, float] | None = None, repeats: int = 2,
        seed: str = "mix") -> DataFrame:
    """``docs`` with what a mix takes of each document.

    ``members`` is the array of sources that hold a document (a null entry is a source of its own; a null or empty array
    is in no source and nothing of it is taken); ``size`` its words, null counting 0. ``asked`` are the words wanted of each
    source, by default ``targets`` of the sizes. Adds: size; source_size and target, of the first member; taken, words the
    mix takes (a document is taken whole, or repeated, except the one at which a pattern's share ends); ``whole``, how many
    whole copies that makes, the last one rounded. A column of ``docs`` with one of these names gives way; all others stay,
    whatever their names. Every row is a document, also where ids repeat or are null; rows of equal id and size stand next
    to each other in the seeded order, which depends on ids and ``seed`` alone, so that reruns agree. The driver holds one
    row per membership pattern.
    """
    spark = docs.sparkSession
    held = F.coalesce(F.array_sort(F.array_distinct(members)), F.array().cast("array<string>"))
    own = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in ADDED), F.col("doc_id").alias("_id"))
    known = docs.select(own.alias("_row"), held.alias("members"), F.coalesce(size.cast("long"), F.lit(0)).alias("size"))
    found = known.groupBy("members").agg(F.sum("size").alias("size")).collect()
    found = sorted(((list(r["members"]), r["size"]) for r in found), key=lambda r: [(s is None, s or "") for s in r[0]])
    sizes: dict[str | None, int] = {}
    for held, total in found:
        for s in held:
            sizes[s] = sizes.get(s, 0) + total
    asked = targets(sizes, repeats=repeats) if asked is None else {s: asked.get(s, 0.0) for s in sizes}
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    number = {s: i for i, s in enumerate(names)}
    flow = settle([t for _, t in found], [[number[s] for s in held] for held, _ in found], [int(asked[s] + 0.5) for s in names], repeats)
    plan = spark.createDataFrame(
        [(held, total, sum(part.values()), sizes[held[0]] if held else None, asked[held[0]] if held else None)
         for (held, total), part in zip(found, flow, strict=True)],
        "members array<string>, supply long, flow long, source_size long, target double")

    # a small plan is sent to the rows, whose hot sources then stay where they are; a large one meets them by a join
    joined = known.join(F.broadcast(plan) if len(found) <= SENT else plan, "members").withColumn("_mark", F.md5(F.concat_ws(":", F.lit(seed), F.col("_row._id").cast("string"))))
    joined = joined.withColumn("_id", F.col("_row._id"))
    width = len(f"{ORDER_BINS - 1:x}")
    placed = running_total(joined, ["members"], ["_mark", "_id", "size"], F.col("size"),
                           F.conv(F.substring("_mark", 1, width), 16, 10).cast("int"), "_at")
    part = lambda copy: F.least(F.greatest(F.col("flow") - copy * F.col("supply") - F.col("_at"), F.lit(0)), F.col("size"))
    taken = sum((part(copy) for copy in range(1, repeats)), part(0))
    placed = placed.withColumn("taken", taken.cast("long"))
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0).cast("int")
    kept = [F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c not in ADDED]
    return placed.withColumn("whole", whole).select(*kept, *ADDED)
