"""Most similar vectors for every vector: sharded robust-pruned graphs.

Plan.  Centroids are fitted on a bounded hash sample (``CENTROIDS`` of them over all spaces, at
most).  One pass turns every vector into a unit vector, names its class of exact copies, and routes
it to its nearest centroid (home shard) and the ``probes`` next ones.  A shard of more than
``max_rows`` vectors is cut into cells by the signs of fixed random projections around
its centroid, as many as its size calls for; a query visits its cell and those beyond the
``FLIPS`` nearest cuts.  So the number of shards grows with the data, and what a query visits
doesn't.  A cell above ``max_rows`` vectors is split by class hash and every query of it searches all
parts, so no task holds an unbounded group and no row is dropped.  Inside a task the graph of the
cell is built; insertion itself proposes the neighbours at home, other visits are beam searches.

Exact copies are one class.  As neighbours a class keeps its six smallest keys: with ties broken by
key, only those can be among the five nearest of any other key, so nothing is lost.  Queries of
``nearest`` are never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.session import cut, spread

from .graph_index import NEG, ShardGraph

SHARD_ROWS = 4000  #: vectors a shard is planned for
MAX_ROWS = 8000  #: vectors a task indexes at most
CENTROIDS = 4096  #: centroids of all spaces together, about (one a space at least)
PER_CENTROID = 16  #: sampled rows for a centroid; 1,000 for a space at least
FLIPS = 3  #: cells that a query visits beside its own, where a shard has cells


def _unit(column: pd.Series, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the usable vectors and their unit vectors, rounded so that copies agree."""
    at = np.array([i for i, v in enumerate(column) if v is not None and len(v) == dim], dtype=np.int64)
    if not len(at):
        return at, np.zeros((0, dim), np.float32)
    x = np.stack([np.asarray(column.iloc[i], dtype=np.float64) for i in at])
    norm = np.linalg.norm(x, axis=1)
    ok = np.isfinite(norm) & (norm > 0)
    at, x, norm = at[ok], x[ok], norm[ok]
    return at, np.round(x / norm[:, None], 5).astype(np.float32) + np.float32(0)  # + 0: one zero only


def _kmeans(x: np.ndarray, k: int, rounds: int = 4) -> np.ndarray:
    centre = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = np.concatenate([np.argmax(x[i : i + 4096] @ centre.T, axis=1) for i in range(0, len(x), 4096)])
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centre = np.where(norm > 0, total / np.maximum(norm, 1e-9), centre).astype(np.float32)
    return centre


def fit_centroids(vectors: DataFrame, dim: int, shard_rows: int = SHARD_ROWS, most: int = CENTROIDS) -> dict[str, np.ndarray]:
    """Centroids of every space, each space fitted in a task of its own on a sample chosen by key hash."""
    size = vectors.groupBy("space").agg(F.count("*").alias("n"))
    total = size.agg(F.sum("n")).first()[0]
    if not total:
        return {}
    k = F.greatest(F.lit(1), F.least(F.ceil(F.col("n") / shard_rows), F.ceil(F.col("n") * most / total))).cast("int")
    size = size.withColumn("k", k).withColumn("share", F.greatest(F.lit(1000), PER_CENTROID * F.col("k")) / F.col("n"))
    chosen = vectors.join(F.broadcast(size), "space").where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < F.col("share") * (1 << 20))

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        _, x = _unit(part["embedding"], dim)
        x = x[np.lexsort(x.T[:4])] if len(x) else x  # not the order of arrival
        centre = _kmeans(x, max(1, min(int(part["k"].iloc[0]), max(1, len(x) // 8)))) if len(x) else x
        return pd.DataFrame({"space": part["space"].iloc[:1], "centre": [centre.astype(np.float32).tobytes()]})

    rows = chosen.select("space", "k", "embedding").groupBy("space").applyInPandas(fit, "space string, centre binary").collect()
    return {r["space"]: np.frombuffer(r["centre"], dtype=np.float32).reshape(-1, dim) for r in rows if r["centre"]}


def route(vectors: DataFrame, centroids: dict[str, np.ndarray], dim: int, probes: int, copies: int | None = 6) -> DataFrame:
    """``space, key, cls, shards array<int>, vec binary``; the first shard is home.

    Of each class a batch passes on its ``copies`` smallest keys only (see the module's note), or all.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for space, part in batch.groupby("space"):
                centre = shared.value.get(space)
                at, x = _unit(part["embedding"], dim)
                if not len(at):
                    continue
                frame = pd.DataFrame({"space": space, "key": part["key"].to_numpy()[at], "vec": [v.tobytes() for v in x]})
                if centre is None:
                    frame["shards"] = [[0]] * len(frame)
                else:
                    m = min(1 + probes, len(centre))
                    s = x @ centre.T
                    top = np.argpartition(-s, m - 1, axis=1)[:, :m]
                    top = np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable"), 1)
                    frame["shards"] = list(top.astype(np.int32))
                frame = frame.drop_duplicates(["key", "vec"]).sort_values("key", kind="stable")
                yield frame if copies is None else frame[frame.groupby("vec").cumcount() < copies]

    out = vectors.mapInPandas(run, "space string, key string, vec binary, shards array<int>")
    return out.withColumn("cls", F.xxhash64("vec"))


def cells(routed: DataFrame, centroids: dict[str, np.ndarray], bits: dict[tuple[str, int], int], dim: int) -> DataFrame:
    """``space, key, cls, vec, shard, cell, place``: every visit of a vector; place 0 is its home, cells beside it follow.

    A shard of b bits is cut by the signs of b fixed projections around its centroid.
    """
    shared = routed.sparkSession.sparkContext.broadcast((centroids, bits))
    planes = np.random.default_rng(11).normal(size=(dim, 32)).astype(np.float32)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centre, size = shared.value
        for batch in batches:
            out = batch.drop(columns="shards").loc[batch.index.repeat(batch["shards"].map(len))].reset_index(drop=True)
            out["shard"] = np.concatenate(batch["shards"].to_list() or [[]]).astype(np.int32)
            out["place"] = np.concatenate([np.arange(len(s)) for s in batch["shards"]] or [[]]).astype(np.int32)
            out["cell"] = np.zeros(len(out), np.int64)
            yield out
            for (space, shard), part in out.groupby(["space", "shard"]):
                b = size.get((space, int(shard)), 0)
                if not b:
                    continue
                side = (_matrix(part["vec"], dim) - centre[space][shard]) @ planes[:, :b]
                code = (side > 0) @ (1 << np.arange(b, dtype=np.int64))
                out.loc[part.index, "cell"] = code
                near = np.argsort(np.abs(side), axis=1)[:, :FLIPS]
                for j in range(near.shape[1]):
                    yield part.assign(cell=code ^ (1 << near[:, j].astype(np.int64)), place=np.maximum(part["place"].to_numpy(), 1000))

    def in_order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["space", "key", "cls", "vec", "shard", "cell", "place"]
        for batch in batches:
            made = list(run(iter([batch])))  # the first frame gets its cells while the others are made
            yield from (x[names] for x in made)

    return routed.mapInPandas(in_order, "space string, key string, cls long, vec binary, shard int, cell long, place int")


def _visits(routed: DataFrame, asked: DataFrame, centroids: dict[str, np.ndarray], dim: int, max_rows: int, both: bool) -> DataFrame:
    """Index rows and query rows of every task: ``space, shard, cell, part, key, vec, query``.

    ``asked`` are the routed queries; with ``both`` they are the indexed rows themselves, which needn't
    ask their own part.
    """
    size = routed.groupBy("space", F.col("shards")[0].alias("shard")).agg(F.count("*").alias("n")).where(F.col("n") > max_rows)
    bits = {(r["space"], r["shard"]): min(30, int(np.ceil(np.log2(r["n"] / max_rows)))) for r in size.collect()}
    every = cells(routed, centroids, bits, dim)
    index = every.where("place = 0")
    parts = index.groupBy("space", "shard", "cell").agg(F.ceil(F.count("*") / max_rows).cast("int").alias("parts"))
    query = every if both else cells(asked, centroids, bits, dim)
    own = F.pmod(F.col("cls"), F.col("parts")).cast("int")
    everywhere = F.sequence(F.lit(0), F.col("parts") - 1)
    there = F.filter(everywhere, lambda p: (F.col("place") > 0) | (p != own)) if both else everywhere
    at = ["space", "shard", "cell"]
    left = index.join(parts, at).select(*at, own.alias("part"), "key", "vec", F.lit(False).alias("query"))
    right = query.join(parts, at).select(*at, F.explode(there).alias("part"), "key", "vec", F.lit(True).alias("query"))
    return left.unionByName(right)


def _matrix(vec: pd.Series, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(vec), dtype=np.float32).reshape(-1, dim)


def _classes(frame: pd.DataFrame) -> tuple[pd.DataFrame, list[list[str]]]:
    """One row a class, and its six smallest keys."""
    frame = frame.drop_duplicates("key").sort_values(["vec", "key"], kind="stable")
    keys = [k[:6] for k in frame.groupby("vec", sort=False)["key"].agg(list)]
    return frame.drop_duplicates("vec"), keys


def similar_pairs(vectors: DataFrame, dim: int, min_cos: float = 0.9, k: int = 5, probes: int = 1, degree: int = 16, beam: int = 24, alpha: float = 1.2, shard_rows: int = SHARD_ROWS, max_rows: int = MAX_ROWS, centroids_most: int = CENTROIDS) -> DataFrame:
    """Pairs ``space, key_a, key_b, cos`` with cos >= ``min_cos``, each among the other's ``k`` nearest (k <= 5).

    vectors  ``space, key, embedding``; spaces are never compared with each other.
    Null, all-zero, non-finite and wrongly sized vectors have no neighbours; a null key is left out;
    a key seen twice counts once; ties go to the smaller key; an empty table gives no rows.
    """
    vectors = vectors.where(F.col("key").isNotNull() & (F.size("embedding") == dim)).select("space", "key", "embedding")
    centroids = fit_centroids(vectors, dim, shard_rows, centroids_most)
    routed = cut(route(spread(vectors), centroids, dim, probes))
    everything = _visits(routed, routed, centroids, dim, max_rows, True)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        space = group["space"].iloc[0]
        reps, keys = _classes(group[~group["query"]])
        pairs: list[tuple[str, str, float]] = []
        if len(reps):
            x = _matrix(reps["vec"], dim)
            for own_keys in keys:
                pairs += [(a, b, 1.0) for i, a in enumerate(own_keys) for b in own_keys[i + 1 :]]
            graph = ShardGraph(x, degree, beam, alpha)
            ids, sims = graph.build(collect=k + 1)
            for i, j in zip(*np.nonzero(sims >= min_cos)):
                pairs += [(a, b, float(sims[i, j])) for a in keys[i] for b in keys[ids[i, j]]]
            asked, asked_keys = _classes(group[group["query"]])
            if len(asked):
                ids, sims = graph.search(_matrix(asked["vec"], dim), k + 1)
                for i, j in zip(*np.nonzero(sims >= min_cos)):
                    pairs += [(a, b, float(sims[i, j])) for a in asked_keys[i] for b in keys[ids[i, j]]]
        out = pd.DataFrame(pairs, columns=["a", "b", "cos"]).astype({"cos": float})
        swap = out["a"] > out["b"]
        return pd.DataFrame({"space": space, "key_a": out["b"].where(swap, out["a"]), "key_b": out["a"].where(swap, out["b"]), "cos": out["cos"].round(6)})

    found = everything.groupBy("space", "shard", "cell", "part").applyInPandas(run, "space string, key_a string, key_b string, cos double")
    found = found.where("key_a <> key_b").groupBy("space", "key_a", "key_b").agg(F.max("cos").alias("cos"))
    return mutual(found, k)


def mutual(pairs: DataFrame, k: int) -> DataFrame:
    """Pairs in which each is among the other's ``k`` nearest, ties to the smaller key."""
    ends = F.array(F.struct(F.col("key_a").alias("me"), F.col("key_b").alias("other")), F.struct(F.col("key_b").alias("me"), F.col("key_a").alias("other")))
    both = pairs.select("*", F.explode(ends).alias("e")).select("space", "key_a", "key_b", "cos", "e.me", "e.other")
    place = F.row_number().over(Window.partitionBy("space", "me").orderBy(F.desc("cos"), "other"))
    near = both.withColumn("place", place).where(F.col("place") <= k)
    return near.groupBy("space", "key_a", "key_b").agg(F.max("cos").alias("cos"), F.count("*").alias("n")).where("n = 2").drop("n")


def nearest(vectors: DataFrame, queries: DataFrame, dim: int, k: int = 5, probes: int = 15, degree: int = 24, beam: int = 48, alpha: float = 1.2, shard_rows: int = SHARD_ROWS, max_rows: int = MAX_ROWS, centroids_most: int = CENTROIDS) -> DataFrame:
    """``space, key, place, neighbour, cos``: the ``k`` (at most 5) nearest of each query; beam search in its ``1 + probes`` nearest shards.

    vectors, queries  ``space, key, embedding``; a query is no neighbour of its own key.
    Unusable vectors are neither queries nor neighbours; equal query vectors are all answered; a key
    asked twice is answered once; ties go to the smaller key.
    """
    vectors = vectors.where(F.col("key").isNotNull() & (F.size("embedding") == dim)).select("space", "key", "embedding")
    queries = queries.where(F.col("key").isNotNull() & (F.size("embedding") == dim)).select("space", "key", "embedding")
    centroids = fit_centroids(vectors, dim, shard_rows, centroids_most)
    routed = cut(route(spread(vectors), centroids, dim, 0))
    everything = _visits(routed, route(queries, centroids, dim, probes, None), centroids, dim, max_rows, False)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        space = group["space"].iloc[0]
        reps, keys = _classes(group[~group["query"]])
        asked_rows = group[group["query"]].drop_duplicates("key")
        if not len(reps) or not len(asked_rows):
            return pd.DataFrame(columns=["space", "key", "neighbour", "cos"])
        graph = ShardGraph(_matrix(reps["vec"], dim), degree, beam, alpha)
        graph.build()
        ids, sims = graph.search(_matrix(asked_rows["vec"], dim), k + 1)
        rows = []
        names = asked_rows["key"].to_numpy()
        for i, j in zip(*np.nonzero(sims > NEG)):
            rows += [(names[i], b, float(sims[i, j])) for b in keys[ids[i, j]] if b != names[i]]
        out = pd.DataFrame(rows, columns=["key", "neighbour", "cos"]).astype({"cos": float}).sort_values(["key", "cos", "neighbour"], ascending=[True, False, True])
        out = out[out.groupby("key").cumcount() < k]
        return pd.DataFrame({"space": space, "key": out["key"], "neighbour": out["neighbour"], "cos": out["cos"].round(6)})

    found = everything.groupBy("space", "shard", "cell", "part").applyInPandas(run, "space string, key string, neighbour string, cos double")
    found = found.groupBy("space", "key", "neighbour").agg(F.max("cos").alias("cos"))
    place = F.row_number().over(Window.partitionBy("space", "key").orderBy(F.desc("cos"), "neighbour"))
    return found.withColumn("place", place).where(F.col("place") <= k).select("space", "key", "place", "neighbour", "cos")
