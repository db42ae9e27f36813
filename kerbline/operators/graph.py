"""Graph work over all areas at once; the area is part of every key."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Tables and files of this session.
TABLES: list[str] = []


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of spark.checkpoint.dir (on one machine a temporary folder, where that is unset)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-scratch-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    TABLES.append(path)
    return path


def drop_tables(spark: SparkSession) -> int:
    """Remove the tables made so far, once no result that reads them is wanted any more; how many were there."""
    found = 0
    while TABLES:
        path = spark._jvm.org.apache.hadoop.fs.Path(TABLES.pop())
        found += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return found


def saved(df: DataFrame) -> DataFrame:
    """Cut lineage by a table in the shared folder."""
    path = folder(df.sparkSession, "graph")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def both_ways(edges: DataFrame) -> DataFrame:
    """(area_id, u, v, w) in both directions."""
    return edges.select("area_id", "u", "v", "w").union(edges.select("area_id", F.col("v").alias("u"), F.col("u").alias("v"), "w"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(area_id, node_id, label): smallest node of each component; smallest labels spread, with one jump to the label's label a round."""
    adj = saved(both_ways(edges).select("area_id", "u", "v").distinct())
    labels = adj.groupBy("area_id", F.col("u").alias("node_id")).agg(F.least("node_id", F.min("v")).alias("label"))
    total = None
    while True:
        labels = saved(labels)
        now = labels.agg(F.sum(F.col("label").cast("decimal(38,0)")), F.count("*")).first()
        if tuple(now) == total:
            return labels
        total = tuple(now)
        seen = labels.select("area_id", F.col("node_id").alias("v"), F.col("label").alias("l"))
        near = adj.join(seen, ["area_id", "v"]).groupBy("area_id", F.col("u").alias("node_id")).agg(F.min("l").alias("l"))
        spread = labels.join(near, ["area_id", "node_id"]).select("area_id", "node_id", F.least("label", "l").alias("label"))
        jump = spread.select("area_id", F.col("node_id").alias("label"), F.col("label").alias("further"))
        labels = spread.join(jump, ["area_id", "label"]).select("area_id", "node_id", F.least("label", "further").alias("label"))


def shortest_paths(edges: DataFrame, sources: DataFrame, most: float = float("inf")) -> DataFrame:
    """(area_id, source, node_id, dist, prev): distances within `most`, for each source on its own; only improved rows go on."""
    adj = saved(both_ways(edges).groupBy("area_id", "u", "v").agg(F.min("w").alias("w")))
    first = sources.select("area_id", F.col("node_id").alias("source"), "node_id", F.lit(0.0).alias("dist"), F.lit(None).cast("bigint").alias("prev"))
    known = frontier = saved(first)
    keys = ["area_id", "source", "node_id"]
    while True:
        step = frontier.select("area_id", "source", F.col("node_id").alias("u"), "dist").join(adj, ["area_id", "u"]).select("area_id", "source", F.col("v").alias("node_id"), (F.col("dist") + F.col("w")).alias("dist"), F.col("u").alias("prev")).where(F.col("dist") <= most)
        best = step.groupBy(*keys).agg(F.min(F.struct("dist", "prev")).alias("b"))
        old = known.select(*keys, F.col("dist").alias("old"))
        frontier = saved(best.join(old, keys, "left").where("old is null or b.dist < old - 1e-9").select(*keys, "b.dist", "b.prev"))
        if frontier.isEmpty():
            return known
        known = saved(known.join(frontier.select(*keys), keys, "left_anti").unionByName(frontier))


def mutual_pairs(distances: DataFrame) -> DataFrame:
    """(area_id, u, v, dist): greedy pairing by ascending (dist, u, v), in rounds of pairs that are nearest for both."""
    left = saved(distances.where("u < v").select("area_id", "u", "v", "dist"))
    out = None
    while not left.isEmpty():
        key = F.struct("dist", "u", "v").alias("k")
        best = left.select("area_id", F.explode(F.array("u", "v")).alias("n"), key).groupBy("area_id", "n").agg(F.min("k").alias("k"))
        chosen = saved(best.groupBy("area_id", "k").agg(F.count("*").alias("c")).where("c = 2").select("area_id", "k.u", "k.v", "k.dist"))
        out = chosen if out is None else out.unionByName(chosen)
        gone = chosen.select("area_id", F.explode(F.array("u", "v")).alias("n"))
        for c in ("u", "v"):
            left = left.join(gone.withColumnRenamed("n", c), ["area_id", c], "left_anti")
        left = saved(left.select("area_id", "u", "v", "dist"))
    return out if out is not None else left
