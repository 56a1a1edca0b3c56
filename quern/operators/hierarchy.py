"""Parent-child links to full hierarchies: tree contraction and its reversal.

A round rakes leaves (nodes without children leave together with their links) and compresses unary
chains (an independent set of nodes with one parent and one child is spliced out; the new link
remembers the way it stands for).  Each round of a tree removes a fixed share of it, so depth does
not set the number of rounds.  The contractions are recorded and undone in reverse order, which
recovers ancestors, descendants, roots, depths and paths.

Nodes may have several parents.  What no longer contracts (a round removes less than an eighth of
the links) is a core of cycles and layers with several parents; it is closed by doubling the length
of its ways, in a logarithmic number of rounds as well.  Nodes on cycles come out as their own
ancestors.  Everything is joins on node keys; no graph is gathered in one place.

Joins of the loops carry a merge hint: small rounds would otherwise turn into dozens of broadcasts,
all of which pass through the driver's memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.keys import key
from quern.session import Parts, cut


def latest_nodes(nodes: DataFrame) -> DataFrame:
    """``g, n, graph_id, id, up array<string>``: the latest version of each node, keys without case and blanks.

    Of versions with the same ``updated_at`` (or none) one is chosen by its content; null and empty
    prerequisites and repeated ones drop out; rows without id drop out, a null graph is one of its own.
    """
    up = F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce("prerequisites", F.array().cast("array<string>")), lambda p: key(p)), lambda p: p.isNotNull())))
    rows = nodes.select(F.coalesce(key(F.col("graph_id")), F.lit("")).alias("g"), key(F.col("id")).alias("n"), "updated_at", up.alias("up"), F.trim("graph_id").alias("graph_id"), F.trim("id").alias("id"))
    best = rows.where("n IS NOT NULL").groupBy("g", "n").agg(F.max(F.struct("updated_at", "up", "graph_id", "id")).alias("b"))
    return best.select("g", "n", "b.graph_id", "b.id", "b.up")


def links(nodes: DataFrame) -> DataFrame:
    """``g, p, c``: parent and child of the same graph, both known; unknown parents don't count."""
    e = nodes.select("g", F.col("n").alias("c"), F.explode("up").alias("p"))
    return e.join(nodes.select("g", F.col("n").alias("p")).hint("merge"), ["g", "p"]).select("g", "p", "c")


def spelled(nodes: DataFrame) -> DataFrame:
    """The same links as ``graph_id, p, c`` with ids spelled as in ``id`` and one spelling a graph."""
    graph = nodes.groupBy("g").agg(F.min("graph_id").alias("graph_id"))
    named = nodes.select("g", F.col("n").alias("k"), F.col("id").alias("p"))
    e = nodes.select("g", F.col("id").alias("c"), F.explode("up").alias("k")).join(named.hint("merge"), ["g", "k"])
    return e.join(graph, "g").select("graph_id", "p", "c")


SHRINKS = 0.75  #: a round that leaves more of the links than this ends the contraction
_WAY = "array<string>"


def _shortest(length: F.Column, way: F.Column) -> F.Column:
    """Aggregate: the shortest way, the smallest by node key of several."""
    return F.min(F.struct(length.alias("k"), way.alias("way")))["way"]


def _round(live: DataFrame, salt: int) -> DataFrame:
    """One round: ``kind, g, p, c, via`` with the kinds

    rake   a leaf c and a link above it
    hang   a spliced node c and its link above
    under  a spliced node p and its link below
    live   what is left, with a link for each spliced node; ``via`` lists the nodes it jumps over
    Links may repeat with different ways; a single parent or child is told by its name, not by counts.
    """
    ends = F.array(F.struct(F.col("c").alias("n"), F.col("p").alias("up"), F.lit(None).cast("string").alias("down"), "via"), F.struct(F.col("p").alias("n"), F.lit(None).cast("string").alias("up"), F.col("c").alias("down"), F.lit(None).cast(_WAY).alias("via")))
    sides = live.select("g", F.inline(ends))
    way = F.min(F.when(F.col("via").isNotNull(), F.struct(F.size("via").alias("k"), F.col("via").alias("way"))))["way"]
    node = sides.groupBy("g", "n").agg(F.min("up").alias("up"), F.max("up").alias("up2"), F.min("down").alias("down"), F.max("down").alias("down2"), way.alias("upvia"))
    coin = lambda n: F.xxhash64(F.lit(salt), "g", n)  # noqa: E731 - of two neighbours the one with the greater coin may leave
    unary = (F.col("up") == F.col("up2")) & (F.col("down") == F.col("down2")) & (F.col("up") != F.col("n")) & (F.col("down") != F.col("n")) & (F.col("up") != F.col("down"))
    leaves = F.col("down").isNull()
    going = node.where(leaves | (unary & (coin("n") > coin("up")) & (coin("n") > coin("down")))).select("g", "n", leaves.alias("leaf"), "up", "upvia")
    child = going.select("g", F.col("n").alias("c"), F.col("leaf").alias("c_leaf"))
    parent = going.where("NOT leaf").select("g", F.col("n").alias("p"), "up", "upvia")
    both = live.join(child.hint("merge"), ["g", "c"], "left").join(parent.hint("merge"), ["g", "p"], "left")
    row = lambda kind, p, via: F.struct(F.lit(kind).alias("kind"), p.alias("p"), F.col("c"), via.alias("via"))
    p, via = F.col("p"), F.col("via")
    spliced = F.array(row("under", p, via), row("live", F.col("up"), F.concat("upvia", F.array("p"), "via")))
    rows = F.when(F.col("c_leaf"), F.array(row("rake", p, via))).when(F.col("c_leaf").isNotNull(), F.array(row("hang", p, via))).when(F.col("up").isNotNull(), spliced).otherwise(F.array(row("live", p, via)))
    return both.select("g", F.inline(rows))


def _written(df: DataFrame, **measures: F.Column) -> tuple[DataFrame, dict]:
    parts = Parts(df.sparkSession)
    counts = parts.add(df, **measures)
    return parts.frame(), counts


def contract(edges: DataFrame) -> tuple[list[dict[str, DataFrame]], DataFrame | None]:
    """The recorded rounds, in order, and the links ``g, p, c, via`` of the core (None if nothing is left)."""
    live, counts = _written(edges.select("g", "p", "c").distinct().withColumn("via", F.array().cast(_WAY)), n=F.count("*"))
    size, log = counts["n"], []
    while size:
        frame, counts = _written(_round(live, len(log)), **{kind: F.count_if(F.col("kind") == kind) for kind in ("rake", "hang", "under", "live")})
        log.append({kind: frame.where(F.col("kind") == kind).select("g", "p", "c", "via") for kind in ("rake", "hang", "under") if counts.get(kind)})
        live, before, size = frame.where("kind = 'live'").select("g", "p", "c", "via"), size, counts.get("live", 0)
        if size > SHRINKS * before:
            return log, live
    return log, None


def _closed(core: DataFrame) -> DataFrame:
    """Transitive closure ``g, a, d`` of the core: ways of up to 2, 4, 8, ... links until no pair is new."""
    step = cut(core.select("g", F.col("p").alias("a"), F.col("c").alias("d")).distinct())
    pairs, size = step, None
    while True:
        on = step.select("g", F.col("a").alias("m"), F.col("d").alias("e"))
        reach = lambda left: left.select("g", "a", F.col("d").alias("m")).join(on.hint("merge"), ["g", "m"]).select("g", "a", F.col("e").alias("d"))
        pairs, now = _written(pairs.unionByName(reach(pairs)).distinct(), n=F.count("*"))
        if now == size:
            return pairs
        size, step = now, cut(reach(step).distinct())


def ancestors(edges: DataFrame, contracted: tuple[list[dict[str, DataFrame]], DataFrame | None] | None = None) -> DataFrame:
    """``g, a, d``: each node ``d`` once with each node ``a`` it hangs below, directly or not; on a cycle also itself."""
    log, core = contracted or contract(edges)
    parts = Parts(edges.sparkSession)
    if core is not None:
        parts.add(_closed(core))

    def below(step: DataFrame) -> DataFrame:
        """The nodes c of ``step`` with their parents and their parents' ancestors."""
        new = step.select("g", F.col("p").alias("a"), F.col("c").alias("d"))
        if not parts:
            return new
        above = parts.frame().select("g", "a", F.col("d").alias("p"))
        return new.unionByName(step.select("g", "p", "c").join(above.hint("merge"), ["g", "p"]).select("g", "a", F.col("c").alias("d")))

    for step in reversed(log):
        if "hang" in step:
            # a restored node takes its parent's ancestors and becomes one of its child's descendants'
            new = below(step["hang"])
            if "under" in step:
                under = step["under"].select("g", F.col("p").alias("a"), F.col("c").alias("d"))
                if parts:
                    down = parts.frame().select("g", F.col("a").alias("c"), "d")
                    under = under.unionByName(step["under"].select("g", "p", "c").join(down.hint("merge"), ["g", "c"]).select("g", F.col("p").alias("a"), "d"))
                # and of each node restored beside it whose parent it is above; on a cycle that is itself
                beside = under.join(step["hang"].select("g", F.col("p").alias("d"), "c").hint("merge"), ["g", "d"]).select("g", "a", F.col("c").alias("d"))
                new = new.unionByName(under).unionByName(beside)
            parts.add(new.distinct())
        if "rake" in step:
            parts.add(below(step["rake"]).distinct())
    return parts.frame() if parts else edges.select("g", F.col("p").alias("a"), F.col("c").alias("d")).limit(0)


def _core_ways(tops: DataFrame, core: DataFrame) -> DataFrame:
    """``g, root, n, way`` of the core's nodes by the shortest way from each root, by doubling the ways' length.

    ``way`` holds the nodes after the root.  A shortest way's beginning is one too, so once longer
    ways bring nothing new no longer ones will.
    """
    step = cut(core.select("g", "p", "c", F.concat("via", F.array("c")).alias("way")))
    ways = cut(tops.join(core.select("g", F.col("p").alias("n")).distinct().hint("merge"), ["g", "n"], "left_semi").select("g", "root", "n", F.array().cast(_WAY).alias("way")))
    mark = None
    while True:
        more = ways.select("g", "root", F.col("n").alias("p"), F.col("way").alias("head")).join(step.hint("merge"), ["g", "p"]).select("g", "root", F.col("c").alias("n"), F.concat("head", "way").alias("way"))
        best = ways.unionByName(more).groupBy("g", "root", "n").agg(_shortest(F.size("way"), F.col("way")).alias("way"))
        ways, now = _written(best, n=F.count("*"), h=F.sum(F.xxhash64("g", "root", "n", "way").cast("decimal(38,0)")))
        if now == mark:
            return ways
        mark = now
        left = step.select("g", "p", F.col("c").alias("m"), F.col("way").alias("head"))
        step = cut(left.join(step.withColumnRenamed("p", "m").hint("merge"), ["g", "m"]).groupBy("g", "p", "c").agg(_shortest(F.size("head") + F.size("way"), F.concat("head", "way")).alias("way")))


def ways_from_roots(nodes: DataFrame, edges: DataFrame, contracted: tuple[list[dict[str, DataFrame]], DataFrame | None]) -> DataFrame:
    """``g, root, n, way``: the shortest way (nodes after the root) from each root of a node, by undoing the contractions.

    A root has no parents; it leads to itself by an empty way.  Of several shortest ways the
    smallest by node keys is given.
    """
    log, core = contracted
    tops = nodes.select("g", "n").join(edges.select("g", F.col("c").alias("n")).hint("merge"), ["g", "n"], "left_anti").select("g", F.col("n").alias("root"), "n")
    parts = Parts(nodes.sparkSession)
    parts.add(tops.select("g", "root", "n", F.array().cast(_WAY).alias("way")))
    if core is not None:
        tops = parts.frame().select("g", "root", "n")
        parts.add(_core_ways(tops, core).where("n <> root"))
    for step in reversed(log):
        for kind in ("hang", "rake"):
            if kind in step:
                above = parts.frame().select("g", "root", F.col("n").alias("p"), F.col("way").alias("head"))
                got = step[kind].join(above.hint("merge"), ["g", "p"]).select("g", "root", F.col("c").alias("n"), F.concat("head", "via", F.array("c")).alias("way"))
                parts.add(got.groupBy("g", "root", "n").agg(_shortest(F.size("way"), F.col("way")).alias("way")))
    return parts.frame()


def hierarchy(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``g, n, depth, path, paths, roots, n_ancestors, n_descendants, cyclic`` of every node.

    ``roots`` are the ancestors (or the node) without parents, sorted; ``depth`` counts the links of
    the shortest way from a root and ``path`` is that way, the smallest by node keys if there are
    several; both are null where no root leads to the node.  ``paths`` holds the same for each of its
    roots, as structs (root, depth, path) by root.  ``cyclic``: the node lies on a cycle.
    """
    contracted = contract(edges)
    closure = cut(ancestors(edges, contracted))
    up = closure.groupBy("g", F.col("d").alias("n")).agg(F.count("*").alias("n_ancestors"), F.max((F.col("a") == F.col("d")).cast("int")).alias("c"))
    down = closure.where("a <> d").groupBy("g", F.col("a").alias("n")).agg(F.count("*").alias("n_descendants"))
    ways = ways_from_roots(nodes, edges, contracted).select("g", "n", "root", F.size("way").alias("depth"), F.concat(F.array("root"), "way").alias("way"))
    by_root = F.transform(F.array_sort(F.collect_list(F.struct("root", "depth", "way"))), lambda w: F.struct(w["root"].alias("root"), w["depth"].alias("depth"), F.concat_ws(" > ", w["way"]).alias("path")))
    of_node = ways.groupBy("g", "n").agg(F.min(F.struct("depth", "way")).alias("w"), by_root.alias("paths"))
    of_node = of_node.select("g", "n", "w.depth", F.concat_ws(" > ", "w.way").alias("path"), "paths", F.concat_ws(",", F.transform("paths", lambda w: w["root"])).alias("roots"))
    out = nodes.select("g", "n").join(of_node.hint("merge"), ["g", "n"], "left").join(up.hint("merge"), ["g", "n"], "left").join(down.hint("merge"), ["g", "n"], "left")
    return out.select(
        "g", "n", "depth", "path", F.coalesce("paths", F.array().cast("array<struct<root: string, depth: int, path: string>>")).alias("paths"), F.coalesce("roots", F.lit("")).alias("roots"),
        F.coalesce("n_ancestors", F.lit(0)).alias("n_ancestors"), F.coalesce("n_descendants", F.lit(0)).alias("n_descendants"), (F.coalesce("c", F.lit(0)) == 1).alias("cyclic"),
    )
