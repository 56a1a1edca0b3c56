"""Consolidating pairwise matches into groups: deterministic Boruvka hooking.

Joins of the loops carry a merge hint: small rounds would otherwise turn into dozens of broadcasts,
all of which pass through the driver's memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.keys import key
from quern.session import Parts


def _roots(hooks: DataFrame) -> DataFrame:
    """``v, root`` from ``v, up``; trees collapse by pointer doubling.

    Vertices whose pointer ends at a root are set aside and only serve as steps for the others, so
    each step joins the rest only and the number of partitions grows by addition, not by doubling.
    """
    moving, parts, step = hooks.select("v", "up", (F.col("v") == F.col("up")).alias("done")), Parts(hooks.sparkSession), 0
    while True:
        count = parts.add(moving.withColumn("step", F.lit(step)), left=F.count_if(~F.col("done")))
        every = parts.frame()
        left = every.where((F.col("step") == step) & ~F.col("done"))
        if not count["left"]:
            return every.where("done").select("v", F.col("up").alias("root"))
        ahead = every.where(F.col("done") | (F.col("step") == step)).select(F.col("v").alias("x"), F.col("up").alias("xx"))
        moving = left.join(ahead.hint("merge"), F.col("up") == F.col("x")).select("v", F.col("xx").alias("up"), (F.col("xx") == F.col("up")).alias("done"))
        step += 1


def _written(df: DataFrame) -> tuple[DataFrame, int]:
    parts = Parts(df.sparkSession)
    count = parts.add(df, n=F.count("*"))
    return parts.frame(), count["n"]


def components(edges: DataFrame) -> DataFrame:
    """``v, group``: every vertex of ``edges`` (``a, b`` strings) with the smallest vertex of its component.

    Each round every component selects its smallest outgoing edge, edges being ordered by their
    smaller, then their larger end; the order is total, so hooks form trees whose only cycles are
    mutual pairs, and the smaller of such a pair is the tree's smallest vertex and becomes its
    root.  Trees collapse by pointer doubling, edges are relabelled and deduplicated until none
    remain.  Rounds are logarithmic in the number of vertices; nothing is collected.  Null ends and
    self links are ignored; an empty table gives no rows.
    """
    live, n = _written(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    levels = []
    while n:
        ends = live.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("w")), F.struct(F.col("b").alias("v"), F.col("a").alias("w")))).alias("e")).select("e.v", "e.w")
        best = ends.groupBy("v").agg(F.min(F.struct(F.least("v", "w").alias("lo"), F.greatest("v", "w").alias("hi"))).alias("m"))
        hooks = best.select("v", F.when(F.col("v") == F.col("m.lo"), F.col("m.hi")).otherwise(F.col("m.lo")).alias("up"))
        back = hooks.select(F.col("v").alias("x"), F.col("up").alias("xx"))
        # of a mutual pair the smaller end becomes the root
        hooks = hooks.join(back.hint("merge"), F.col("up") == F.col("x")).select("v", F.when((F.col("xx") == F.col("v")) & (F.col("v") < F.col("up")), F.col("v")).otherwise(F.col("up")).alias("up"))
        roots = _roots(hooks)
        levels.append(roots)
        at_a = roots.select(F.col("v").alias("a"), F.col("root").alias("ra"))
        at_b = roots.select(F.col("v").alias("b"), F.col("root").alias("rb"))
        live, n = _written(
            live.join(at_a.hint("merge"), "a").join(at_b.hint("merge"), "b")
            .where("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
            .distinct()
        )
    if not levels:
        return edges.sparkSession.createDataFrame([], "v string, group string")
    out = levels[0].select("v", F.col("root").alias("group"))
    for roots in levels[1:]:
        up = roots.select(F.col("v").alias("x"), "root")
        out = out.join(up.hint("merge"), F.col("group") == F.col("x"), "left").select("v", F.coalesce("root", "group").alias("group"))
    return out


def accepted_edges(pairs: DataFrame, id_a: str = "id_a", id_b: str = "id_b", accepted: str = "accepted") -> DataFrame:
    """``a, b``: pairs of different records, in either order, that no row refuses.

    Ids are compared without case and surrounding blanks; null and empty ids and self pairs drop
    out; ``accepted`` null counts as not refused.
    """
    p = pairs.select(key(F.col(id_a)).alias("x"), key(F.col(id_b)).alias("y"), F.coalesce(F.col(accepted), F.lit(True)).alias("ok"))
    p = p.where("x IS NOT NULL AND y IS NOT NULL AND x <> y")
    return p.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.bool_and("ok").alias("ok")).where("ok").select("a", "b")
