"""Searches over street networks, many at once: nearest sources with costs of each request, pairing, paths between two nodes, traced paths.

A request r looks at the streets of one area (edges: area_id, u, v, w, both directions alike, w > 0). A label says that a source (origin)
is `dist` away from a node, by its neighbour `prev`. Labels are relaxed in buckets of `delta`, each request in its own: edges of at most
delta (light ones) for `hops` hops in one job, until the bucket's labels rest, then the heavy ones once. So a round is one job however
many requests there are, and there are fewer rounds than hops. Ties go to the smallest origin, then to the smallest `prev`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kerbline.operators.graph import both_ways, saved

DELTA, HOPS = 20_000.0, 4
LABEL = ["r", "area_id", "node_id", "origin", "dist", "prev"]


def labels(sources: DataFrame) -> DataFrame:
    """Open labels of the sources (r, area_id, node_id) at themselves."""
    return sources.select("r", "area_id", "node_id", F.col("node_id").alias("origin"), F.lit(0.0).alias("dist"), F.lit(None).cast("bigint").alias("prev"), F.lit(True).alias("light"), F.lit(True).alias("heavy"))


def nearest(edges: DataFrame, start: DataFrame, costs: DataFrame | None = None, k: int = 1, delta: float = DELTA, hops: int = HOPS, most: float | None = None, prune: Callable[[DataFrame, DataFrame], DataFrame] | None = None, rounds: list | None = None) -> DataFrame:
    """r, area_id, node_id, origin, dist, prev: the k nearest sources of every node, within `most`.

    `start` holds labels, of which those marked light or heavy are yet to be sent on. `costs` (r, u, v, times; u < v) multiplies edges for a request.
    `prune` (labels, open labels) returns the open labels worth sending on. `rounds` gets an entry for each job.
    """
    return _nearest(neighbours(edges), start, costs, k, delta, hops, most, prune, rounds)


def neighbours(edges: DataFrame) -> DataFrame:
    """(area_id, u, v, w) in both directions, the cheapest of parallel edges."""
    return saved(both_ways(edges).groupBy("area_id", "u", "v").agg(F.min("w").alias("w")))


def _nearest(adj: DataFrame, start: DataFrame, costs: DataFrame | None, k: int, delta: float, hops: int, most: float | None = None, prune: Callable | None = None, rounds: list | None = None) -> DataFrame:
    priced = None if costs is None else saved(costs.select("r", F.col("u").alias("p"), F.col("v").alias("q"), "times"))
    top = adj.agg(F.max("w")).first()[0] or 0.0
    times = 1.0 if priced is None else max(1.0, priced.agg(F.max("times")).first()[0] or 1.0)
    heavy = F.col("heavy") & F.lit(top * times > delta)  # where no edge is heavy, none is looked for
    known = saved(start.select(*LABEL, "light", heavy.alias("heavy")))
    while True:
        going = known.where("light or heavy")
        going = going if prune is None else prune(known, going)
        if going.isEmpty():
            return known.select(*LABEL)
        known = saved(_round(adj, priced, known, going, k, delta, hops, most).withColumn("heavy", heavy))
        if rounds is not None:
            rounds.append(len(rounds))


def _round(adj: DataFrame, costs: DataFrame | None, known: DataFrame, going: DataFrame, k: int, delta: float, hops: int, most: float | None) -> DataFrame:
    low = going.groupBy("r").agg(F.min("dist").alias("lo"), F.min(F.when(F.col("light"), F.col("dist"))).alias("lo_light"))
    end = (F.floor(F.col("lo") / delta) + 1) * delta
    turn = low.select("r", end.alias("end"), F.coalesce(F.col("lo_light") < end, F.lit(False)).alias("first"))
    now = going.join(turn, "r").where("dist < end")

    def step(rows: DataFrame, light: bool) -> DataFrame:
        to = rows.select("r", "area_id", F.col("node_id").alias("u"), "origin", "dist", "end").join(adj, ["area_id", "u"])
        w: Column = F.col("w")
        if costs is not None:
            to = to.withColumn("p", F.least("u", "v")).withColumn("q", F.greatest("u", "v")).join(costs, ["r", "p", "q"], "left")
            w = F.col("w") * F.coalesce("times", F.lit(1.0))
        to = to.where(w <= delta if light else w > delta)
        to = to.select("r", "area_id", F.col("v").alias("node_id"), "origin", (F.col("dist") + w).alias("dist"), F.col("u").alias("prev"), "end")
        return to if most is None else to.where(F.col("dist") <= most)

    found = step(now.where("not first and heavy"), False).withColumn("hop", F.lit(hops - 1))
    rows = now.where("first and light")
    for hop in range(hops):
        out = step(rows, True)
        rows = out.groupBy("r", "area_id", "node_id", "origin", "end").agg(F.min(F.struct("dist", "prev")).alias("x")).select("r", "area_id", "node_id", "origin", "x.dist", "x.prev", "end")
        found = found.unionByName(rows.withColumn("hop", F.lit(hop)))
        rows = rows.where("dist < end")
    sent = F.coalesce(F.col("dist") < F.col("end"), F.lit(False)) & ~F.col("gone")
    before = known.withColumn("gone", ~(F.col("light") | F.col("heavy"))).join(turn, "r", "left")
    before = before.select(*LABEL, (F.col("light") & ~(sent & F.col("first"))).alias("light"), (F.col("heavy") & ~(sent & ~F.col("first"))).alias("heavy"), F.lit(None).cast("double").alias("end"), F.lit(-1).alias("hop"))
    every = before.unionByName(found.withColumns({"light": F.lit(True), "heavy": F.lit(True)}))
    old = F.col("hop") < 0
    keys = ["r", "area_id", "node_id"] + (["origin"] if k > 1 else [])
    best = every.groupBy(*keys).agg(
        F.min(F.struct("dist", "origin", "prev")).alias("x"), F.min(F.struct("dist", "origin", F.when(old, hops).otherwise(F.col("hop")).alias("hop"))).alias("y"),
        F.min(F.when(old, F.struct("dist", "origin"))).alias("old"), F.max(F.when(old, F.col("light"))).alias("light"), F.max(F.when(old, F.col("heavy"))).alias("heavy"), F.max("end").alias("end"),
    )
    same = F.coalesce(F.col("old") == F.struct("x.dist", "x.origin"), F.lit(False))
    # A new label was sent on over light edges already if it came in the bucket before the last hop.
    done = (F.col("y.hop") < hops - 1) & (F.col("x.dist") < F.col("end"))
    out = best.select("r", "area_id", "node_id", "x.origin", "x.dist", "x.prev", F.when(same, F.col("light")).otherwise(~done).alias("light"), F.when(same, F.col("heavy")).otherwise(True).alias("heavy"))
    if k == 1:
        return out
    place = F.row_number().over(W.partitionBy("r", "node_id").orderBy("dist", "origin"))
    return out.withColumn("place", place).where(F.col("place") <= k).drop("place")


def others(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """r, area_id, node_id, other, dist: the nearest other of the searched nodes (r, node_id) to each of them, of labels with k = 2."""
    own = found.join(nodes.select("r", "node_id"), ["r", "node_id"], "left_semi").where("origin <> node_id")
    return own.groupBy("r", "area_id", "node_id").agg(F.min(F.struct("dist", "origin")).alias("x")).select("r", "area_id", "node_id", F.col("x.origin").alias("other"), "x.dist")


def pairing(edges: DataFrame, nodes: DataFrame, delta: float = DELTA, hops: int = HOPS) -> tuple[DataFrame, DataFrame]:
    """Greedy pairs by ascending (dist, u, v) of the nodes (r, area_id, node_id), as r, area_id, u, v, dist; and each node's nearest other.

    Every node of the network knows its two nearest of those left. Two that are nearest to each other are a pair (no other pair of
    either comes before it) and leave; then only places that knew one of them are searched again, from the labels around them. No table
    is larger than twice the network, whatever the number of nodes.
    """
    adj = neighbours(edges)
    found, left, out, first = _nearest(adj, labels(nodes), None, 2, delta, hops), saved(nodes.select("r", "area_id", "node_id")), None, None
    while True:
        near = saved(others(found, left))
        first = near if first is None else first
        pair = near.groupBy("r", "area_id", F.least("node_id", "other").alias("u"), F.greatest("node_id", "other").alias("v")).agg(F.count("*").alias("n"), F.min("dist").alias("dist"))
        chosen = saved(pair.where("n = 2").select("r", "area_id", "u", "v", "dist"))
        out = chosen if out is None else out.unionByName(chosen)
        if chosen.isEmpty():
            return out, first
        gone = saved(chosen.select("r", F.explode(F.array("u", "v")).alias("origin")))
        left = saved(left.join(gone.withColumnRenamed("origin", "node_id"), ["r", "node_id"], "left_anti"))
        freed = found.join(gone, ["r", "origin"], "left_semi").select("r", "area_id", F.col("node_id").alias("u"))
        around = freed.join(adj, ["area_id", "u"]).select("r", F.col("v").alias("node_id")).distinct().withColumn("open", F.lit(True))
        stay = found.join(gone, ["r", "origin"], "left_anti").join(around, ["r", "node_id"], "left")
        again = F.coalesce("open", F.lit(False))
        found = _nearest(adj, stay.select(*LABEL, again.alias("light"), again.alias("heavy")), None, 2, delta, hops)


def traced(tree: DataFrame, ends: DataFrame, rounds: list | None = None) -> DataFrame:
    """r, node_id, hop: every node on the way from `ends` (r, node_id; one for each r) back to its source along `prev` of `tree` (r, node_id,
    prev). Pointers double: after round n the 2^n last nodes are known, and from each the node 2^n hops before it."""
    jump = saved(tree.where("prev is not null").select("r", "node_id", F.col("prev").alias("to")))
    path = saved(ends.select("r", "node_id", F.lit(0).cast("bigint").alias("hop")))
    reach = 1
    while True:
        more = saved(path.join(jump, ["r", "node_id"]).select("r", F.col("to").alias("node_id"), (F.col("hop") + reach).alias("hop")))
        if rounds is not None:
            rounds.append(reach)
        if more.isEmpty():
            return path
        path, reach = path.unionByName(more), reach * 2
        ahead = jump.select("r", F.col("node_id").alias("to"), F.col("to").alias("further"))
        jump = saved(jump.join(ahead, ["r", "to"]).select("r", "node_id", F.col("further").alias("to")))


def closest(edges: DataFrame, sources: DataFrame, targets: DataFrame, costs: DataFrame | None = None, delta: float = DELTA, hops: int = HOPS) -> tuple[DataFrame, DataFrame]:
    """(r, target, origin, dist) of the target (r, node_id) nearest to any source (r, area_id, node_id), sources themselves not counted, and
    (r, node_id, hop) of the way back from it. Labels beyond a request's best target so far are not sent on."""
    goal = saved(targets.select("r", "node_id").join(sources.select("r", "node_id"), ["r", "node_id"], "left_anti"))

    def best(known: DataFrame) -> DataFrame:
        x = known.join(goal, ["r", "node_id"], "left_semi").groupBy("r").agg(F.min(F.struct("dist", "node_id", "origin")).alias("x"))
        return x.select("r", F.col("x.node_id").alias("target"), "x.origin", F.col("x.dist").alias("best"))

    def prune(known: DataFrame, going: DataFrame) -> DataFrame:
        return going.join(best(known).select("r", "best"), "r", "left").where("best is null or dist < best").drop("best")

    tree = saved(nearest(edges, labels(sources), costs, delta=delta, hops=hops, prune=prune))
    end = saved(best(tree).withColumnRenamed("best", "dist"))
    return end, traced(tree, end.select("r", F.col("target").alias("node_id")))


def between(edges: DataFrame, pairs: DataFrame, delta: float = DELTA, hops: int = HOPS) -> DataFrame:
    """r, dist, k, node_id: the nodes of a shortest way from s to t (k from 0) of each pair (r, area_id, s, t) that has one.

    Both ends search at once (as requests 2 r and 2 r + 1). A pair rests when its nearest open labels of both sides are together no
    nearer than the best node that both have met, so each looks no farther than it must.
    """
    side = lambda c, b: pairs.select((F.col("r") * 2 + b).alias("r"), "area_id", F.col(c).alias("node_id"))
    half = lambda: F.floor(F.col("r") / 2)

    def met(known: DataFrame) -> DataFrame:
        part = lambda b, d: known.where(F.pmod("r", F.lit(2)) == b).select(half().alias("pair"), "node_id", F.col("dist").alias(d))
        both = part(0, "d0").join(part(1, "d1"), ["pair", "node_id"])
        return both.groupBy("pair").agg(F.min(F.struct((F.col("d0") + F.col("d1")).alias("dist"), "node_id")).alias("x")).select("pair", "x.dist", "x.node_id")

    def prune(known: DataFrame, going: DataFrame) -> DataFrame:
        odd = F.pmod("r", F.lit(2)) == 1
        low = going.groupBy(half().alias("pair")).agg(F.min(F.when(~odd, F.col("dist"))).alias("lo0"), F.min(F.when(odd, F.col("dist"))).alias("lo1"))
        done = met(known).select("pair", F.col("dist").alias("best")).join(low, "pair").where("lo0 is null or lo1 is null or lo0 + lo1 >= best")
        return going.withColumn("pair", half()).join(done.select("pair"), "pair", "left_anti").drop("pair")

    tree = saved(nearest(edges, labels(side("s", 0).union(side("t", 1))), delta=delta, hops=hops, prune=prune))
    end = saved(met(tree))
    back = saved(traced(tree, end.select((F.col("pair") * 2).alias("r"), "node_id").union(end.select(F.col("pair") * 2 + 1, "node_id"))))
    there = back.where(F.pmod("r", F.lit(2)) == 0).select(half().alias("pair"), "node_id", (-F.col("hop")).alias("at"))
    onward = back.where((F.pmod("r", F.lit(2)) == 1) & (F.col("hop") > 0)).select(half().alias("pair"), "node_id", F.col("hop").alias("at"))
    whole = there.union(onward)
    first = whole.groupBy("pair").agg(F.min("at").alias("lo"))
    return whole.join(first, "pair").join(end.select("pair", "dist"), "pair").select(F.col("pair").alias("r"), "dist", (F.col("at") - F.col("lo")).alias("k"), "node_id")
