import random

from pyspark.sql import functions as F

from inkwitness.llm.mixing import mix, route, settle, targets


def brute_targets(sizes, share=1.5):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    low, high = 0.0, 2.0 * sum(sizes.values()) + 1
    for _ in range(200):  # the level at which weights times it, under the limits, give the whole
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(2 * sizes[s], mid * weight[s]) for s in order) < share * sum(sizes.values()) else (low, mid)
    return {s: min(2 * sizes[s], high * weight[s]) for s in order}


def test_targets_fill_by_weight():
    draw = random.Random(3)
    for _ in range(50):
        sizes = {s: draw.choice([0, 1, 50, 400, 9000]) for s in ["b", "a", "ä", "z", None, "", "c"][: draw.randint(1, 7)]}
        got, want = targets(sizes), brute_targets(sizes)
        assert all(abs(got[s] - want[s]) < 1e-6 * (1 + want[s]) for s in sizes)
    assert targets({}) == {} and targets({"a": 0}) == {"a": 0.0}


def test_flow_is_cheapest():
    # both sources can be met, and 5 words have to come twice; three sources leave one pattern no choice
    flow = route([10, 10], [[0], [0, 1]], [15, 10], 2)
    assert flow[0].get(0, 0) + flow[1].get(0, 0) == 15 and flow[1][1] == 10
    # the shared pattern would be free for source 0, but only it can meet source 1
    assert route([10, 10], [[0], [0, 1]], [10, 10], 2) == [{0: 10}, {1: 10}]
    # asked for less than there is: nothing is repeated
    flow = route([10, 10, 4], [[0], [0, 1], [1]], [12, 8], 2)
    assert [sum(f.values()) for f in flow] <= [10, 10, 4] and sum(f.get(0, 0) for f in flow) == 12 and sum(f.get(1, 0) for f in flow) == 8
    # asked for too much: all of it, twice
    assert route([3], [[0]], [100], 2) == [{0: 6}] and route([], [], [], 2) == [] and route([5], [[]], [], 2) == [{}]


def rows_of(n):
    draw = random.Random(9)
    return [(i, ["hot", "hot", "b", None, ""][draw.randrange(5)], draw.choice([0, 1, 7, 300])) for i in range(n)] + [(7, "b", 5), (7, "b", 5), (None, "b", 4)]


def test_mix_meets_targets_and_reruns_agree(spark):
    rows = rows_of(400)
    df = spark.createDataFrame(rows, "doc_id long, source string, words long").withColumn("target", F.lit("clash"))
    out = mix(df, F.array("source"), F.col("words")).collect()
    again = mix(df.repartition(5), F.array("source"), F.col("words")).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.source or "", r.taken)
    assert [tuple(r) for r in sorted(out, key=key)] == [tuple(r) for r in sorted(again, key=key)] and len(out) == len(rows)
    sizes = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    for s, t in targets(sizes).items():
        mine = [r for r in out if r.source == s]
        # three rows of one id and size share a place in the order, so the cut may differ by one of them
        assert abs(sum(r.taken for r in mine) - t) <= 11 and all(r.target == t and r.source_size == sizes[s] for r in mine)
    assert all(0 <= r.taken <= 2 * r.size for r in out)


def test_mix_of_overlapping_sources(spark):
    rows = [(i, ["a"] if i < 10 else ["a", "b"] if i < 20 else None, 10) for i in range(25)]
    out = mix(spark.createDataFrame(rows, "doc_id long, held array<string>, words long"), F.col("held"), F.col("words"),
              asked={"a": 150.0, "b": 100.0}).collect()
    # 250 words are asked of 200, and only documents of "b" can give it its hundred
    assert sum(r.taken for r in out) == 250 and sum(r.taken for r in out if 10 <= r.doc_id < 20) >= 100
    assert sum(max(0, r.taken - r.size) for r in out) == 50 and all(r.taken <= 2 * r.size for r in out)
    assert all(r.taken == 0 for r in out if r.doc_id >= 20)


def test_empty_table(spark):
    assert mix(spark.createDataFrame([], "doc_id long, source string, words long"), F.array("source"), F.col("words")).collect() == []


def test_null_and_empty_memberships_and_names_that_clash(docs):
    rows = [(1, None, 4, "a", 1), (2, [], 5, "b", 2), (3, ["s"], 6, "c", 3), (3, ["s"], 6, "d", 4)]
    table = docs(rows, "doc_id long, members array<string>, words long, flow string, supply int")
    out = mix(table, F.col("members"), F.col("words")).collect()
    assert sorted((r.doc_id, r.flow, r.supply, r.size) for r in out) == [(1, "a", 1, 4), (2, "b", 2, 5), (3, "c", 3, 6), (3, "d", 4, 6)]
    assert all(r.taken == 0 for r in out if r.doc_id < 3) and all(r.members == ["s"] for r in out if r.doc_id == 3)


def test_sources_apart_are_settled_like_the_network():
    supply, members, demand = [10, 7, 5, 9, 4], [[0], [1], [1, 2], [2], [3]], [25, 9, 12, 3]
    assert [sum(f.values()) for f in settle(supply, members, demand, 2)] == [sum(f.values()) for f in route(supply, members, demand, 2)]


def test_more_sources_than_any_network_takes(spark):
    table = spark.range(120_000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("source"))
    assert mix(table, F.array("source"), F.lit(3)).where("taken > 0").count() > 60_000
