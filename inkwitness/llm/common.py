"""Pieces that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import discard, materialise

#: One word: what stands between ASCII white space.
WORD_GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters other than ASCII white space; null counts 0."""
    inner = F.regexp_replace(text, rf"^{WORD_GAP}|{WORD_GAP}$", "")
    return F.when(text.isNull() | (inner == ""), 0).otherwise(F.size(F.split(inner, WORD_GAP))).cast("long")


def over_batches(df: DataFrame, kernel: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """``kernel`` on every Arrow batch of ``df``: rows stay where they are, memory stays with the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from kernel(batch)

    return df.mapInArrow(run, schema)


def running_total(df: DataFrame, group: list[str], order: list[str], amount: Column, bins: Column, name: str) -> DataFrame:
    """``df`` with the sum of ``amount`` over the rows of the same group that come before, in ``bins``, then ``order``.

    ``bins`` has to grow with the order and to cut a group into many bins of bounded size. A bin's sum is aggregated
    first, so that even a group with a third of all rows is spread over the tasks bin by bin; the sums of the bins are
    as many as groups times bins.
    """
    binned = df.withColumn("_bin", bins).withColumn("_amount", amount.cast("long"))
    sums = binned.groupBy(*group, "_bin").agg(F.sum("_amount").alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*group, "_bin", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*group, "_bin").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    left = binned.withColumn("_inside", F.coalesce(F.sum("_amount").over(inside), F.lit(0))).alias("l")
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (*group, "_bin")]
    kept = [F.col(f"l.{c}").alias(c) for c in df.columns]
    return left.join(starts.alias("r"), same).select(*kept, (F.col("_start") + F.col("_inside")).alias(name))


def thinned(df: DataFrame, key: str, wanted: DataFrame, words: int = 1 << 16) -> DataFrame:
    """Rows of ``df`` whose key may be among ``wanted``: at least all of those, ahead of a join that would shuffle ``df``.

    The wanted keys set bits in a bitmap of fixed size (64 bits in each of ``words`` rows), which is small enough to send
    to every task whatever the table. With very many keys it fills up and thins less.
    """
    spot = f"pmod(xxhash64({key}), {64 * words})"
    word, bit = F.expr(f"cast({spot} div 64 as int)"), F.expr(f"shiftleft(1L, cast({spot} % 64 as int))")
    bits = wanted.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    return df.withColumn("_word", word).join(F.broadcast(bits), "_word").where(F.col("_bits").bitwiseAND(bit) != 0).select(df.columns)


def components(edges: DataFrame) -> DataFrame:
    """Union-find over ``edges`` (a, b): one row (id, component) per node that has an edge, component the smallest id.

    Every round hooks each node to its smallest neighbour, follows the pointer once more, and renames the edges by it;
    edges inside one tree vanish. The smallest node of a component always keeps its own name, so when no edge is left
    every node has been led to it. A round is a plain aggregate and two joins, written to the shared folder: hubs are
    combined before the shuffle, and nothing is gathered in one place. Null ends and loops are left out.
    """
    spark = edges.sparkSession
    current = materialise(
        edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    steps: list[DataFrame] = []
    while not current.isEmpty():
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooked = materialise(
            both.groupBy("a").agg(F.min("b").alias("p")).select(F.col("a").alias("id"), F.least("a", "p").alias("p")), "hooks")
        onward = hooked.select(F.col("id").alias("p"), F.col("p").alias("to"))
        step = materialise(hooked.join(onward, "p").select("id", "to"), "steps")
        renamed = (current.join(step.select(F.col("id").alias("a"), F.col("to").alias("x")), "a")
                   .join(step.select(F.col("id").alias("b"), F.col("to").alias("y")), "b")
                   .where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        following = materialise(renamed, "edges")
        discard(current, hooked)
        current = following
        steps.append(step)
    if not steps:
        return spark.createDataFrame([], "id long, component long")
    led = steps[0].select("id", F.col("to").alias("component"))
    for step in steps[1:]:
        led = led.join(step.select(F.col("id").alias("component"), "to"), "component", "left").select(
            "id", F.coalesce("to", "component").alias("component"))
    return materialise(led, "components")
