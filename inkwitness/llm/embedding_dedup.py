"""Embedding near-duplicates by an inverted multi-index.

Unit vectors are cut into two halves, and each half has its own codebook, so that few codewords make a large grid of
cells. A vector is a member of one cell. As a query it visits cells in multi-sequence order, nearest first: the distance
that a half must at least move to reach a codeword's part of space, squared and added over both halves, is the order, and
a vector of cosine c is at squared distance ``2 - 2c``. Full recall visits every cell nearer than that; a lower target
recall stops where the share of sampled close pairs found reaches it. Found pairs are verified in double precision.

Equal vectors are one class first. A cell's members and its visitors are dealt into blocks of bounded size; a task
multiplies one block of members with one block of visitors and returns sums and smallest ids, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import components, over_batches

#: Vectors that train the codebooks, about, chosen by hash; codewords in a half at most; members of a cell aimed at.
SAMPLE, WORDS, CELL = 8192, 256, 512
#: Members and visitors in one block.
BLOCK = 512


def _kmeans(x: np.ndarray, count: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's method from rows spread evenly over the sample; empty codewords keep their place."""
    centre = x[np.linspace(0, len(x) - 1, count).astype(int)].copy()
    for _ in range(rounds):
        near = _apart(x, centre).argmin(1)
        held = np.bincount(near, minlength=count)
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        centre[held > 0] = total[held > 0] / held[held > 0, None]
    return np.unique(centre, axis=0)


def _apart(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centre.T + (centre * centre).sum(1), 0)


def _moves(x: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Home codeword of each row, and the squared distance to each codeword's half-space at least."""
    far = _apart(x, centre)
    home = far.argmin(1)
    between = np.sqrt(_apart(centre[home], centre))
    with np.errstate(divide="ignore", invalid="ignore"):
        move = (far - far[np.arange(len(x)), home, None]) / (2 * between)
    move[np.arange(len(x)), home] = 0
    return home, np.nan_to_num(move, nan=0.0, posinf=0.0) ** 2


def visits(unit: np.ndarray, books: tuple[np.ndarray, np.ndarray], radius: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """Home cell of each row, and the cells it visits (home first) in multi-sequence order up to squared distance ``radius``."""
    half, grid = unit.shape[1] // 2, len(books[1])
    (home1, move1), (home2, move2) = _moves(unit[:, :half], books[0]), _moves(unit[:, half:], books[1])
    cells = []
    for a, b in zip(move1, move2, strict=True):
        first, second = np.flatnonzero(a <= radius), np.flatnonzero(b <= radius)
        total = a[first][:, None] + b[second]
        i, j = np.nonzero(total <= radius)
        cells.append((first[i] * grid + second[j])[np.argsort(total[i, j], kind="stable")])
    return home1 * grid + home2, cells


def _radius(sample: np.ndarray, books: tuple, least: float, recall: float) -> float:
    """Squared distance at which the sample's close pairs, and steps to exactly ``least``, are found often enough."""
    bound = 2 - 2 * least + 1e-9
    if recall >= 1 or not len(sample):
        return bound
    draw = np.random.default_rng(7)
    x = sample[:2048]
    step = draw.normal(size=x.shape)
    step -= (step * x).sum(1)[:, None] * x
    step /= np.maximum(np.linalg.norm(step, axis=1), 1e-300)[:, None]
    y = least * x + np.sqrt(1 - least * least) * step
    a, b = np.nonzero(np.triu(x @ x.T >= least, 1))
    left, right = np.concatenate([x, x[a[:20000]]]), np.concatenate([y, x[b[:20000]]])
    half = x.shape[1] // 2
    need = sum(_moves(left[:, s], book)[1][np.arange(len(left)), _moves(right[:, s], book)[0]]
               for s, book in ((slice(0, half), books[0]), (slice(half, None), books[1])))
    return float(min(bound, np.quantile(need, recall)))


def _linked_block(close: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest id that each row, then each column of a link matrix is led to inside it."""
    rows, columns = left.copy(), right.copy()
    top = np.iinfo(np.int64).max
    while True:
        new_rows = np.minimum(rows, np.where(close, columns[None, :], top).min(1, initial=top))
        new_columns = np.minimum(columns, np.where(close, new_rows[:, None], top).min(0, initial=top))
        if (new_rows == rows).all() and (new_columns == columns).all():
            return np.concatenate([rows, columns])
        rows, columns = new_rows, new_columns


def _meet(visitors: pd.DataFrame, members: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """Links between one block of a cell's visitors and one of its members: per id a count, and the id it is led to.

    A visitor counts its links with members. A member counts its links as a visitor of the other's home cell; only where
    it does not go there are they counted for it here.
    """
    none = pd.DataFrame({"id": np.zeros(0, np.int64), "links": np.zeros(0, np.int64), "led": np.zeros(0, np.int64)})
    if visitors.empty or members.empty:
        return none
    vid, mid = visitors["id"].to_numpy(), members["id"].to_numpy()
    close = np.stack(visitors["v"].to_list()) @ np.stack(members["v"].to_list()).T >= cosine
    close &= vid[:, None] != mid[None, :]
    if not close.any():
        return none
    home, here = visitors["home"].to_numpy(), members["home"].to_numpy()[0]
    goes = np.stack([np.isin(home, cells) for cells in members["cells"]], axis=1)
    counted = close & (home != here)[:, None] & ~goes
    links = np.concatenate([close @ members["copies"].to_numpy(), visitors["copies"].to_numpy() @ counted]).astype(np.int64)
    out = pd.DataFrame({"id": np.concatenate([vid, mid]), "links": links, "led": _linked_block(close, vid, mid)})
    return out[(out["links"] > 0) | (out["led"] != out["id"])]


def near_duplicates(vectors: DataFrame, cosine: float = 0.98, recall: float = 0.999) -> DataFrame:
    """Links between vectors of the same label whose cosine is at least ``cosine``, and their components.

    ``vectors`` has vec_id, embedding (array of numbers) and label; other columns are ignored. Returns one row per row:
    vec_id, n_links (other vectors linked directly), component_id (smallest vec_id reachable, itself included), kept
    (vec_id = component_id). A vector that is null, empty, zero or holds a null or non-finite component, or whose label
    is null, links with nothing, as do vectors of different length; a null vec_id links with nothing and is not kept.
    Repeated rows link with each other; rows of one vec_id with different vectors are one node.

    ``recall`` is the share of links just at ``cosine`` that one visit of either vector has to find; a link is missed only
    if both miss, and closer vectors are found more surely. 1.0 visits every cell that can hold a link, which is exact but
    visits many cells of a fine grid.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("v"))
    sound = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    usable = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & sound, F.lit(False))

    def name(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        names = [xxhash.xxh3_128_hexdigest((np.array(v, float) + 0.0).tobytes()) for v in batch.column("v").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string())], [*batch.schema.names, "name"])

    label = dict(vectors.dtypes)["label"]
    named = materialise(over_batches(rows.where(usable), name, f"vec_id long, label {label}, v array<double>, name string"), "vectors")
    classes = materialise(
        named.groupBy("label", "name").agg(F.count("*").alias("copies"), F.min("vec_id").alias("id"), F.any_value("v").alias("v"))
        .withColumn("h", F.xxhash64("label", "name")), "classes")
    total = classes.count()
    share = F.shiftrightunsigned("h", 11) / float(1 << 53)
    picked = classes.where(share < SAMPLE / max(1, total)).orderBy("h", "name").select("v").collect()
    books = {}
    for width in {len(r["v"]) for r in picked}:
        x = _units([r["v"] for r in picked if len(r["v"]) == width])
        count = int(np.clip(round((total / CELL) ** 0.5), 1, min(WORDS, len(x))))
        both = tuple(_kmeans(part, count) if part.shape[1] else np.zeros((1, 0)) for part in (x[:, :width // 2], x[:, width // 2:]))
        books[width] = (both, _radius(x, both, cosine, recall))

    def place(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        frame = batch.to_pandas()
        frame["width"] = frame["v"].map(len).astype("int32")
        for width, part in frame.groupby("width"):
            x = _units(part["v"].to_list())
            # a length that the sample lacks has one cell
            home, cells = visits(x, *books[width]) if width in books else (np.zeros(len(x), int), [np.zeros(1, int)] * len(x))
            part = part.assign(home=home, cells=[c.tolist() for c in cells], v=[r.tolist() for r in x])
            yield pa.RecordBatch.from_pandas(part[["label", "width", "h", "id", "copies", "home", "cells", "v"]], schema=pa.schema([
                ("label", batch.schema.field("label").type), ("width", pa.int32()), ("h", pa.int64()), ("id", pa.int64()),
                ("copies", pa.int64()), ("home", pa.int64()), ("cells", pa.list_(pa.int64())), ("v", pa.list_(pa.float64()))]), preserve_index=False)

    placed = materialise(over_batches(classes.select("label", "h", "id", "copies", "v"), place,
                                      f"label {label}, width int, h long, id long, copies long, home long, cells array<long>, v array<double>"), "cells")

    # a cell's members and visitors in as many blocks as its size asks for; each block of one meets each of the other
    key = ["label", "width", "cell"]
    coming = placed.select("label", "width", F.explode("cells").alias("cell"), "home")
    sizes = (coming.groupBy(*key).agg(F.count("*").alias("come"), F.count_if(F.col("cell") == F.col("home")).alias("live")).where("live > 0")
             .select(*key, F.ceil(F.col("live") / BLOCK).cast("int").alias("m"), F.ceil(F.col("come") / BLOCK).cast("int").alias("q")))
    sizes = materialise(sizes, "sizes")
    blocks = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    members = (placed.withColumn("cell", F.col("home")).join(sizes, key).withColumn("mb", F.pmod("h", "m").cast("int"))
               .withColumn("qb", blocks("q")).select(*key, "mb", "qb", "id", "copies", "home", "cells", "v"))
    visitors = (placed.withColumn("cell", F.explode("cells")).drop("cells").join(sizes, key).withColumn("qb", F.pmod("h", "q").cast("int"))
                .withColumn("mb", blocks("m")).select(*key, "mb", "qb", "id", "copies", "home", "v"))
    block = [*key, "mb", "qb"]
    visitors, members = (side.toDF(*side.columns) for side in (visitors, members))  # both come from one table: names of their own
    found = materialise(visitors.groupBy(*block).cogroup(members.groupBy(*block)).applyInPandas(
        lambda q, m: _meet(q, m, cosine), "id long, links long, led long"), "found")

    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    led = components(found.select(F.col("id").alias("a"), F.col("led").alias("b")))
    told = (named.select("vec_id", "label", "name").join(classes.select("label", "name", "copies", "id"), ["label", "name"])
            .join(links, "id", "left").join(led, "id", "left")
            .select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")))
    alone = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return told.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _units(vectors: list) -> np.ndarray:
    x = np.stack([np.asarray(v, float) for v in vectors])
    x = x / np.abs(x).max(1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]
