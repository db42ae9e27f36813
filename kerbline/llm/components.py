"""Connected components of a link table by alternating large-star and small-star steps (Kiveris et al., 2014).

Before and after these steps each task replaces blocks of the links that it holds by stars of the blocks' components, so that few rounds
of shuffles are needed: a driver keeps a thread for a minute for each shuffle that it starts. No step lets the sum of all ends grow, and
one that changes links lowers it or their number, so the rounds end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Links that a task holds at a time.
LINKS = 1 << 17


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node that these links connect with a smaller one, and the smallest that it can reach by them."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends.reshape(2, -1)
    label = own = np.arange(len(nodes))
    while ((p := label[x]) != (q := label[y])).any():
        low, label = np.minimum(p, q), label.copy()
        np.minimum.at(label, p, low)
        np.minimum.at(label, q, low)
        while ((further := label[label]) != label).any():
            label = further
    return nodes[label != own], nodes[label[label != own]]


def contracted(links: DataFrame) -> DataFrame:
    """Links (a, b), b smaller, that connect the same nodes: a star for each component of each block of a task's links."""

    def run(batches):
        kept, held = [], 0
        for batch in batches:
            kept.append(tuple(batch.column(c).to_numpy() for c in ("a", "b")))
            held += batch.num_rows
            if held >= LINKS:
                kept = [forest(*map(np.concatenate, zip(*kept)))]
                if len(kept[0][0]) > LINKS // 2:  # else the next links join them
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in kept.pop()], names=["a", "b"])
                held = sum(len(x) for x, _ in kept)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in forest(*map(np.concatenate, zip(*kept)))], names=["a", "b"])

    return links.mapInArrow(common.releasing(run), "a bigint, b bigint")


def settled(links: DataFrame) -> bool:
    """Whether each node has one smaller neighbour at most, and no such neighbour has one."""
    ends = links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(links.select("b", F.lit(None)))
    nodes = ends.groupBy("node").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count_if(F.col("root").isNull()).alias("met"))
    return not nodes.agg(F.count_if((F.col("low") < F.col("high")) | (F.col("low").isNotNull() & (F.col("met") > 0)))).first()[0]


def components(links: DataFrame, files: int = 0) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the smallest node reachable. Nulls and loops are dropped.
    `files`: of each table written on the way, at most, if any number."""

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.union(pairs.select("b", "a")).where("a > b") if not large else pairs.union(pairs.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        joined = both.join(least, "a")
        kept = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if large else joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        return kept.where("a <> b").distinct()

    now = links.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = common.written_few(contracted(contracted(now).distinct()), "links", files)
    while not settled(now):
        now = common.written_few(contracted(star(star(now, True), False)), "links", files)
    roots = now.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    return roots.union(now.select("b", "b").distinct())
