"""From items that share keys to verified links and their components, without all pairs of a key's items as rows.

crowded() finds the keys that several items hold, by one sort over ranges of keys and items. classed() puts items of a key
together only if their sizes allow a link. What is left of a key is compared in cells: of a key with up to BLOCK items there
is one cell; the items of a hot key are dealt to blocks, and each two blocks are a cell, so that every two items meet in one
cell and no task holds more than two blocks. In a cell pairs are compared as numbers in arrays and are never rows; only links
leave it, and of these no more than join what is alike (spanning()). So a big group of copies costs little, and no pair that
shares a key is left out unless its items are in one component already.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release, trimmed

#: Items of a block.
BLOCK = 4096
CELL = ["key", "class", "i", "j"]


def components(links: DataFrame) -> DataFrame:
    """item, root: of each item in links (a, b: longs), the smallest item of its component. Alternates large-star and
    small-star steps until every item but roots has one link, to a root; each step is an aggregation and a join."""

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        near = both if large else both.filter("v < u")
        least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        joined = near.join(least.hint("merge"), "u")
        if large:
            out = joined.filter("v > u and v != m").select(F.col("m").alias("a"), F.col("v").alias("b"))
        else:
            out = joined.filter("v != m").select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b")).filter("a != b"))
        return out.distinct()

    edges = cut(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a != b").distinct())
    while True:
        roles = edges.select(F.col("a").alias("v"), F.lit(0).alias("below")).unionByName(edges.select(F.col("b").alias("v"), F.lit(1).alias("below")))
        roles = roles.groupBy("v").agg(F.min("below").alias("least"), F.max("below").alias("most"), F.sum("below").alias("n"))
        if not roles.agg(F.count_if(F.expr("least != most or n > 1")).alias("n")).first().n:
            break
        edges = cut(star(star(edges, True), False))
        release(edges.sparkSession)
    return edges.select(F.col("b").alias("item"), F.col("a").alias("root")).unionByName(edges.select(F.col("a").alias("item"), F.col("a").alias("root")).distinct())


def size_class(size: np.ndarray, like: float) -> np.ndarray:
    """Sizes of which the smaller is at least like of the larger are in one class or in two that follow one another."""
    return np.floor(np.log(np.maximum(size, 1)) / -math.log(like) + 1e-9)


def crowded(held: DataFrame) -> DataFrame:
    """The rows of held (key, item, ...; an item holds a key once) whose key another item holds too, and at most two more for
    each partition, which counted() drops. The rows are sorted by ranges of key and item, so that a hot key is dealt to
    several partitions, and a row stays if a neighbour has its key; the first and last rows of a partition stay."""
    names = held.columns

    @trimmed
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, met = None, True  # the last row, and whether it stays whatever follows
        for batch in batches:
            if not batch.num_rows:
                continue
            if kept is not None:
                columns = [pa.concat_arrays([kept.column(c), batch.column(c)]) for c in names]
                batch = pa.RecordBatch.from_arrays(columns, names)
            key = batch.column("key").to_numpy(zero_copy_only=False)
            same = key[1:] == key[:-1]
            stays = np.r_[met, same]
            stays[:-1] |= same
            kept, met = batch.slice(len(key) - 1), bool(stays[-1])
            yield batch.slice(0, len(key) - 1).filter(pa.array(stays[:-1]))
        if kept is not None:
            yield kept

    return held.repartitionByRange("key", "item").sortWithinPartitions("key", "item").mapInArrow(work, held.schema)


def classed(rows: DataFrame, like: float) -> DataFrame:
    """rows (key, item, size, ...), each once for its class of size and once for the next, with the column class: two items
    are alike only if the smaller size is at least like of the larger, and then they share a key and a class."""
    own = F.floor(F.log(F.greatest("size", F.lit(1))) / F.lit(-math.log(like)) + F.lit(1e-9)).cast("int")
    return rows.withColumn("class", F.explode(F.array(own, own + 1)))


def cells(rows: DataFrame) -> DataFrame:
    """rows (key, class, item, n: the number of rows of this key and class, ...) dealt to cells and sorted by them, with i and
    j, the blocks that meet in a cell, and side, the block that the row is of."""
    parts = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    dealt = rows.withColumn("side", F.pmod(F.xxhash64("item"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    dealt = dealt.withColumns({"i": F.least("side", "other"), "j": F.greatest("side", "other")}).drop("n", "other")
    return dealt.repartition(*CELL).sortWithinPartitions(*CELL, "item")


def each_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The columns of successive cells, as arrays, or lists of what is no number."""
    kept: dict | None = None

    def joined(a: dict, b: dict) -> dict:
        return {c: np.concatenate([a[c], b[c]]) if isinstance(a[c], np.ndarray) else a[c] + b[c] for c in a}

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = {}
        for name, column in zip(batch.schema.names, batch.columns, strict=True):
            columns[name] = column.to_numpy(zero_copy_only=False) if pa.types.is_integer(column.type) else column.to_pylist()
        new = np.zeros(batch.num_rows, bool)
        for c in CELL:
            new[1:] |= columns[c][1:] != columns[c][:-1]
        edges = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            part = {c: v[a:b] for c, v in columns.items()}
            if kept is not None and all(kept[c][0] == part[c][0] for c in CELL):
                kept = joined(kept, part)
            else:
                if kept is not None:
                    yield kept
                kept = part
    if kept is not None:
        yield kept


def partners(cell: dict, labels: np.ndarray, x: int) -> np.ndarray:
    """The rows after x of a cell that x has to be compared with: of another label, and of the other block where two meet."""
    y = np.flatnonzero(labels[x + 1 :] != labels[x]) + x + 1
    return y if cell["i"][0] == cell["j"][0] else y[cell["side"][y] != cell["side"][x]]


def spanning(cell: dict, labels: np.ndarray, near: Callable[[int, np.ndarray], np.ndarray], alike: Callable[[int, int], bool]) -> list[tuple[int, int]]:
    """Links (rows of the cell) that join what is alike and not of one label yet. near leaves out rows that can't be alike."""
    out = []
    for x in range(len(labels) - 1):
        y = partners(cell, labels, x)
        if len(y):
            for k in near(x, y).tolist():
                if labels[k] != labels[x] and alike(x, k):
                    labels[labels == labels[k]] = labels[x]
                    out.append((x, k))
    return out


def counted(rows: DataFrame) -> DataFrame:
    """The rows (key, class, ...) whose key and class others have too, with n, their number."""
    many = rows.groupBy("key", "class").agg(F.count("*").alias("n")).filter("n > 1")
    return rows.join(many.hint("merge"), ["key", "class"])
