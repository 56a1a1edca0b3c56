"""Similarity graphs: statistics, neighbourhoods, paths, label propagation, betweenness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import Parts, cut


def both_ways(edges: DataFrame) -> DataFrame:
    """``v, w`` in both directions, once."""
    pair = F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("w")), F.struct(F.col("b").alias("v"), F.col("a").alias("w")))
    return edges.select(F.explode(pair).alias("e")).select("e.v", "e.w").distinct()


def stats(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, mean and greatest degree."""
    d = both_ways(edges).groupBy("v").agg(F.count("*").alias("d"))
    return d.agg(F.count("*").alias("nodes"), (F.sum("d") / 2).cast("long").alias("edges"), F.round(F.avg("d"), 6).alias("mean_degree"), F.max("d").alias("max_degree"))


def neighbourhood(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """``start, id, distance`` of everything within ``depth`` links of each start (breadth first)."""
    two = cut(both_ways(edges))
    seen = starts.select(F.col("id").alias("start"), "id", F.lit(0).alias("distance"))
    front = seen
    for d in range(1, depth + 1):
        step = front.join(two, F.col("id") == F.col("v")).select("start", F.col("w").alias("id")).distinct()
        front = cut(step.join(seen.select("start", "id"), ["start", "id"], "left_anti").withColumn("distance", F.lit(d)))
        seen = seen.unionByName(front)
    return seen


def label_propagation(edges: DataFrame, rounds: int = 20) -> DataFrame:
    """``v, label``: each round every vertex takes its neighbours' most frequent label, ties to the smallest.

    Ends when no label changes, or after ``rounds``: all vertices move at once, so two halves of a
    graph may swap labels for ever.
    """
    two = cut(both_ways(edges))
    labels = two.select("v").distinct().withColumn("label", F.col("v"))
    for _ in range(rounds):
        votes = two.join(labels.select(F.col("v").alias("w"), "label"), "w").groupBy("v", "label").agg(F.count("*").alias("n"))
        new = votes.groupBy("v").agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("b")).select("v", F.col("b.label").alias("label"))
        parts = Parts(edges.sparkSession)
        moved = parts.add(new.join(labels.withColumnRenamed("label", "old"), "v"), n=F.count_if(F.col("label") != F.col("old")))["n"]
        labels = parts.frame().select("v", "label")
        if not moved:
            break
    return labels


def betweenness(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """``v, score``: dependency sums over the shortest paths from the sampled ``sources`` (``id``), level by level.

    Path counts spread breadth first and dependencies flow back along the same levels, as joins on
    (source, vertex); all sources advance together.
    """
    two = cut(both_ways(edges))
    front = cut(sources.select(F.col("id").alias("s"), F.col("id").alias("v"), F.lit(1.0).alias("paths")))
    levels, seen = [front], front.select("s", "v")
    while True:
        step = levels[-1].join(two, "v").select("s", F.col("w").alias("v"), "paths").groupBy("s", "v").agg(F.sum("paths").alias("paths"))
        step = cut(step.join(seen, ["s", "v"], "left_anti"))
        if step.isEmpty():
            break
        levels.append(step)
        seen = seen.unionByName(step.select("s", "v"))
    flow, out = None, None
    for depth in range(len(levels) - 1, 0, -1):
        here = levels[depth] if flow is None else levels[depth].join(flow, ["s", "v"], "left")
        here = here.withColumn("d", F.coalesce("d", F.lit(0.0)) if flow is not None else F.lit(0.0))
        out = here.select("v", "d") if out is None else out.unionByName(here.select("v", "d"))
        back = here.join(two, "v").select("s", F.col("w").alias("p"), ((1 + F.col("d")) / F.col("paths")).alias("share"))
        up = levels[depth - 1].select("s", F.col("v").alias("p"), F.col("paths").alias("pp"))
        flow = cut(back.join(up, ["s", "p"]).groupBy("s", F.col("p").alias("v")).agg(F.sum(F.col("share") * F.col("pp")).alias("d")))
    if out is None:
        return two.select("v", F.lit(0.0).alias("score")).limit(0)
    return out.groupBy("v").agg(F.round(F.sum("d"), 6).alias("score"))


def shortest_path(edges: DataFrame, start, end) -> list:
    """The shortest path as a list of vertices (of several the smallest by ids), or an empty list.

    Distances to ``end`` spread level by level until ``start`` is reached or nothing is new; the
    frontier stays distributed.  The path is then read off from ``start``: each step takes the
    smallest neighbour that is one link nearer.
    """
    two = cut(both_ways(edges))
    kind = two.schema["v"].dataType.simpleString()
    parts, depth = Parts(edges.sparkSession), 0
    step = edges.sparkSession.createDataFrame([(end, 0)], f"v {kind}, d int")
    while True:
        got = parts.add(step, n=F.count("*"), hit=F.count_if(F.col("v") == F.lit(start)))
        if got["hit"]:
            break
        if not got["n"]:
            return []
        seen = parts.frame()
        step = seen.where(F.col("d") == depth).join(two, "v").select(F.col("w").alias("v")).distinct().join(seen.select("v"), "v", "left_anti").withColumn("d", F.lit(depth + 1))
        depth += 1
    path, far = [start], parts.frame().withColumnRenamed("v", "w")
    for d in range(depth - 1, -1, -1):
        path.append(two.where(F.col("v") == F.lit(path[-1])).join(far.where(F.col("d") == d), "w").agg(F.min("w")).first()[0])
    return path


def cluster_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: pairs together in both, in ``a`` only, in ``b`` only (``id, c``); from contingency counts, no pairs are formed."""
    n = a.select("id", F.col("c").alias("x")).join(b.select("id", F.col("c").alias("y")), "id").groupBy("x", "y").agg(F.count("*").alias("n"))
    c2 = lambda c: F.sum(c * (c - 1) / 2)
    both = n.agg(c2(F.col("n")).alias("both"))
    xa = n.groupBy("x").agg(F.sum("n").alias("n")).agg(c2(F.col("n")).alias("pa"))
    yb = n.groupBy("y").agg(F.sum("n").alias("n")).agg(c2(F.col("n")).alias("pb"))
    return both.join(xa).join(yb).select(F.col("both").cast("long").alias("both"), (F.col("pa") - F.col("both")).cast("long").alias("only_a"), (F.col("pb") - F.col("both")).cast("long").alias("only_b"))


def latest_version(rows: DataFrame, keys: str | list[str], version: str) -> DataFrame:
    """One row a key: that of the greatest version (null last); of several the one with the greatest other values."""
    keys = [keys] if isinstance(keys, str) else keys
    rest = [c for c in rows.columns if c not in (*keys, version)]
    best = F.max(F.struct(F.col(version), *[F.col(c) for c in rest])).alias("_b")
    return rows.groupBy(*keys).agg(best).select(*keys, f"_b.{version}", *[f"_b.{c}" for c in rest])
