"""Pairs of similar vectors, novelty, relation labels, clusters and document similarity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions.vectors import cosine, norm, unit, weighted
from quern.operators.retrieval import block_topk, top
from quern.session import cut

BLOCK = 1000  #: vectors a block is planned for
SAMPLE = 4096  #: vectors the block centres are taken from, at most


def blocks(vectors: DataFrame) -> DataFrame:
    """``id, u, block``: unit vectors gathered around centres taken from a bounded hash sample."""
    units = vectors.where("embedding IS NOT NULL").select("id", unit(F.col("embedding")).alias("u")).where(F.exists("u", lambda x: x != 0))
    n = max(1, units.count())
    count = max(1, min(SAMPLE, -(-n // BLOCK)))
    sample = units.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.lit(int(min(1.0, 4 * count / n) * (1 << 20)) + 1)).orderBy("id").limit(count).collect()
    centres = np.array([r["u"] for r in sample]) if sample else np.zeros((1, 1))

    @F.pandas_udf("int")
    def nearest(u: pd.Series) -> pd.Series:
        return pd.Series(np.argmax(np.stack(u.to_numpy()) @ centres.T, axis=1)) if len(u) and len(centres) > 1 else pd.Series(np.zeros(len(u), int))

    return units.withColumn("block", nearest("u"))


def cosine_pairs(vectors: DataFrame, threshold: float) -> DataFrame:
    """``a, b, score``: all pairs ``a < b`` with cosine >= ``threshold``, exactly.

    Vectors lie in blocks, each inside a cone around its mean.  Two blocks are compared only if
    their cones can hold a pair within the angle of the threshold (triangle inequality on angles),
    so a high threshold leaves each block to itself and few neighbours.  A block above ``BLOCK``
    vectors is cut into parts of that size, and a task multiplies two parts and emits the pairs
    above the threshold only.  Zero vectors pair with nothing.
    """
    placed = cut(blocks(vectors))
    size = placed.groupBy("block").agg(F.count("*").alias("n"))
    parts = placed.join(F.broadcast(size), "block").select("id", "u", "block", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / BLOCK)).cast("int").alias("part"))
    parts = cut(parts)

    def cone(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["u"].to_numpy())
        m = x.mean(axis=0)
        m = m / (np.linalg.norm(m) or 1.0)
        radius = float(np.arccos(np.clip(x @ m, -1, 1)).max())
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "part": [pdf["part"].iloc[0]], "m": [m.tolist()], "r": [radius]})

    cones = cut(parts.groupBy("block", "part").applyInPandas(cone, "block int, part int, m array<double>, r double"))
    left = cones.select(F.struct("block", "part").alias("l"), F.col("m").alias("lm"), F.col("r").alias("lr"))
    right = cones.select(F.struct("block", "part").alias("k"), F.col("m").alias("km"), F.col("r").alias("kr"))
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.aggregate(F.zip_with("lm", "km", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x))))
    meet = left.join(right, (F.col("l") <= F.col("k")) & (angle - F.col("lr") - F.col("kr") <= float(np.arccos(threshold)) + 1e-9)).select("l", "k")
    meet = cut(meet)
    at = F.struct("block", "part")
    a = parts.select(at.alias("l"), "id", "u").join(meet, "l").select("l", "k", "id", "u")
    b = parts.select(at.alias("k"), F.col("id").alias("id2"), F.col("u").alias("u2")).join(meet.select(F.col("l").alias("l2"), F.col("k").alias("k2")), F.col("k") == F.col("k2")).select("l2", "k2", "id2", "u2")

    def compare(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame(columns=["a", "b", "score"])
        s = np.stack(x["u"].to_numpy()) @ np.stack(y["u2"].to_numpy()).T
        i, j = np.nonzero(s >= threshold)
        p, q = x["id"].to_numpy()[i], y["id2"].to_numpy()[j]
        same = x["l"].iloc[0] == x["k"].iloc[0]
        keep = p < q if same else p != q
        p, q, v = p[keep], q[keep], s[i, j][keep]
        return pd.DataFrame({"a": np.minimum(p, q), "b": np.maximum(p, q), "score": v.round(6)})

    kind = vectors.schema["id"].dataType.simpleString()
    return a.groupBy("l", "k").cogroup(b.groupBy("l2", "k2")).applyInPandas(compare, f"a {kind}, b {kind}, score double")


def cross_group(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs whose ends lie in different groups (``id, grp``); two null groups are the same."""
    a = groups.select(F.col("id").alias("a"), F.col("grp").alias("ga"))
    b = groups.select(F.col("id").alias("b"), F.col("grp").alias("gb"))
    return pairs.join(a, "a").join(b, "b").where(~F.col("ga").eqNullSafe(F.col("gb"))).drop("ga", "gb")


def centroid(vectors: DataFrame, *by: str) -> DataFrame:
    """Mean of the unit vectors (of each group): ``*by, i, x`` in long form, ``i`` from 0."""
    return vectors.where("embedding IS NOT NULL").select(*by, F.posexplode(unit(F.col("embedding"))).alias("i", "x")).groupBy(*by, "i").agg(F.avg("x").alias("x"))


def adaptive_k(n: int) -> int:
    """Neighbours that count for novelty, by the size of the index."""
    return 1 if n <= 50 else 3 if n <= 200 else 5 if n <= 1000 else 10


def decayed_mean(score: Column, age_days: Column, decay: float) -> Column:
    """Aggregate: mean of the scores, weighted by exp(-decay * age); plain where decay or the weights vanish."""
    if decay <= 0:
        return F.avg(score)
    w = F.exp(-decay * F.coalesce(age_days, F.lit(0.0)))
    return F.when(F.sum(w) < 1e-8, F.avg(score)).otherwise(F.sum(score * w) / F.sum(w))


def novelty(index: DataFrame, queries: DataFrame, k: int | None = None, decay: float = 0.0, local: bool = False, specific: bool = False, mode: str = "library", own: bool = False) -> DataFrame:
    """``qid, novelty, global, local``: how far each query lies from its nearest neighbours in the index.

    index    ``id, embedding, category, age`` (days); queries ``qid, q, category, specificity``
    global   1 - (decay-weighted) mean of the top k cosines; an empty index gives 1
    local    the same within the query's category; nothing in it leaves the global value
    specific blends 30 % of the distance to the corpus centroid and scales by the label
    mode     ``premultiply`` ranks cosine * decay instead of weighting after the ranking
    own      the queries are rows of the index: each leaves out its own row (``id = qid``) when ranking
    The result is cut to [0, 1].
    """
    k = k or adaptive_k(index.count())
    corpus = index.select("id", "embedding", F.col("category").alias("c"), F.col("age").cast("double").alias("age"))
    asked = queries.select("qid", "q", F.col("category").alias("qc"), "specificity")
    early = decay if mode == "premultiply" else 0.0
    decay = 0.0 if mode == "premultiply" else decay

    def one(name: str, within: bool) -> DataFrame:
        def adjust(s, rows, asking):
            if early:
                s = s * np.exp(-early * rows["age"].fillna(0.0).to_numpy())
            if own:
                s = np.where(asking["qid"].to_numpy()[:, None] == rows["id"].to_numpy()[None, :], np.nan, s)
            if within:
                s = np.where(asking["qc"].to_numpy()[:, None] == rows["c"].to_numpy()[None, :], s, np.nan)
            return s

        best = top(block_topk(corpus, queries.select("qid", "q", F.col("category").alias("qc")), k, adjust), k).withColumnRenamed("score", "s")
        return best.groupBy("qid").agg((1 - decayed_mean(F.col("s"), F.col("age"), decay)).alias(name))

    asked = asked.withColumn("qu", unit(F.col("q"))).drop("q")
    out = asked.join(one("global", False), "qid", "left").withColumn("global", F.coalesce("global", F.lit(1.0)))
    value = F.col("global")
    if local:
        out = out.join(one("local", True), "qid", "left")
        value = F.when(F.col("local").isNull(), value).otherwise(0.4 * value + 0.6 * F.col("local"))
    else:
        out = out.withColumn("local", F.lit(None).cast("double"))
    if specific:
        mean = centroid(index).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("m"))
        out = out.join(F.broadcast(mean))
        inner = F.aggregate(F.zip_with("qu", "m", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        value = 0.7 * value + 0.3 * (1 - inner / (F.greatest(norm(F.col("qu")), F.lit(1e-8)) * F.greatest(norm(F.col("m")), F.lit(1e-8))))
        value = value * F.when(F.col("specificity") == "concrete", 0.8).when(F.col("specificity") == "vague", 0.3).otherwise(1.0)
    return out.select("qid", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)), 6).alias("novelty"), F.round("global", 6).alias("global"), F.round("local", 6).alias("local"))


def relation(score: Column, nli: Column, known: float = 0.85, extends: float = 0.7) -> Column:
    """KNOWN, EXTENDS or NEW from cosine and entailment label.

    Below ``extends`` a pair is NEW whatever the label; at ``known`` or more only a contradiction
    keeps it from KNOWN; between, the label decides and an unknown one extends.
    """
    middle = F.when(nli == "entailment", "KNOWN").when(nli == "contradiction", "NEW").otherwise("EXTENDS")
    return F.when(score < extends, "NEW").when(score >= known, F.when(nli == "contradiction", "NEW").otherwise("KNOWN")).otherwise(middle)


def triage(score: Column, accept: float = 0.75, reject: float = 0.30, labels: tuple[str, str] = ("duplicate", "distinct")) -> tuple[Column, Column]:
    """Label and confidence of a scored pair: accepted, rejected, or uncertain by its distance from the middle."""
    if len(labels) < 2:
        raise ValueError("two labels are needed")
    half, mid = (accept - reject) / 2, (accept + reject) / 2
    label = F.when(score >= accept, labels[0]).when(score < reject, labels[1]).otherwise("uncertain")
    unsure = F.abs(score - mid) / half if half > 0 else F.lit(0.0)
    return label, F.when(score >= accept, score).when(score < reject, 1 - score).otherwise(unsure)


def document_similarity(docs: DataFrame, weights: dict[str, float], threshold: float = 0.52, max_pairs: int | None = None) -> DataFrame:
    """``id_a, id_b, score`` of documents with one vector a field (columns named as in ``weights``).

    A null field takes the first field that isn't; a document without any drops out.  Compared
    unrounded, reported with four digits.  ``max_pairs`` keeps the most similar pairs, ties to the smaller ids.
    """
    names = list(weights)
    spare = F.coalesce(*[F.col(n) for n in names])
    merged = docs.where(spare.isNotNull()).select("id", weighted([(F.coalesce(F.col(n), spare), w) for n, w in weights.items()]).alias("embedding"))
    out = cosine_pairs(merged, threshold).select(F.col("a").alias("id_a"), F.col("b").alias("id_b"), F.round("score", 4).alias("score"))
    return out if max_pairs is None else out.orderBy(F.desc("score"), "id_a", "id_b").limit(max_pairs)


def field_scores(pairs: DataFrame, docs: DataFrame, names: list[str]) -> DataFrame:
    """Adds to pairs (``id_a, id_b``) the cosine of each field, four digits; null where a document lacks it."""
    a = docs.select(F.col("id").alias("id_a"), *[F.col(n).alias(f"_a_{n}") for n in names])
    b = docs.select(F.col("id").alias("id_b"), *[F.col(n).alias(f"_b_{n}") for n in names])
    both = pairs.join(a, "id_a").join(b, "id_b")
    return both.select(*pairs.columns, *[(F.round(cosine(F.col(f"_a_{n}"), F.col(f"_b_{n}")), 4) + 0.0).alias(n) for n in names])


def recency_truth(vectors: DataFrame, asked: DataFrame, window: float = 7.0, known: float = 0.70, novel: float = 0.45) -> DataFrame:
    """``qid, recent, old, label``: the greatest similarity of each asked row (``id, embedding, day``) to earlier ones.

    Earlier rows (smaller id) of the last ``window`` days and older ones are looked at apart; without
    any the similarity is 0.  KNOWN from ``known`` on, NOVEL up to ``novel``, else AMBIGUOUS.
    """
    queries = asked.select(F.col("id").alias("qid"), F.col("embedding").alias("q"), F.col("day").alias("today"))

    def greatest(name: str, recent: bool) -> DataFrame:
        def adjust(s, rows, q):
            age = q["today"].to_numpy()[:, None] - rows["day"].to_numpy()[None, :]
            earlier = rows["id"].to_numpy()[None, :] < q["qid"].to_numpy()[:, None]
            return np.where(earlier & ((age <= window) if recent else (age > window)), s, np.nan)

        return top(block_topk(vectors.select("id", "embedding", "day"), queries, 1, adjust), 1).select("qid", F.col("score").alias(name))

    out = queries.select("qid").join(greatest("recent", True), "qid", "left").join(greatest("old", False), "qid", "left")
    out = out.select("qid", *[F.round(F.coalesce(c, F.lit(0.0)), 4).alias(c) for c in ("recent", "old")])
    return out.withColumn("label", F.when(F.col("recent") >= known, "KNOWN").when(F.col("recent") <= novel, "NOVEL").otherwise("AMBIGUOUS"))


def connected(edges: DataFrame) -> DataFrame:
    """``id, component`` (smallest id) of the ends of ``a, b`` by large-star and small-star steps.

    Labels converge in a logarithmic number of rounds; each is a join on the vertex.
    """
    both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("w")), F.struct(F.col("b").alias("v"), F.col("a").alias("w")))).alias("e")).select("e.v", "e.w")
    star, mark = cut(both.distinct()), None
    while True:
        least = star.groupBy("v").agg(F.least(F.min("w"), F.col("v")).alias("m"))
        seen = star.join(least.hint("merge"), "v")
        down = seen.select(F.inline(F.array(F.struct(F.when(F.col("w") > F.col("v"), F.col("w")).alias("v"), F.col("m").alias("w")), F.struct(F.when(F.col("v") > F.col("m"), F.col("v")).alias("v"), F.col("m").alias("w"))))).where("v IS NOT NULL AND v <> w").distinct()
        small = down.groupBy("v").agg(F.min("w").alias("m"))
        step = down.join(small.hint("merge"), "v").where("w <> m").select(F.col("w").alias("v"), F.col("m").alias("w")).union(small.select("v", F.col("m").alias("w")))
        step = cut(step.select(F.inline(F.array(F.struct("v", "w"), F.struct(F.col("w").alias("v"), F.col("v").alias("w"))))).distinct())
        # nothing changed if the links are the same ones: their number and two sums of hashes
        now = step.agg(F.count("*"), F.sum(F.xxhash64("v", "w").cast("decimal(38,0)")), F.sum(F.xxhash64("w", "v").cast("decimal(38,0)"))).first()
        star, same, mark = step, now == mark, now
        if same:
            break
    return star.groupBy("v").agg(F.least(F.min("w"), F.col("v")).alias("component")).select(F.col("v").alias("id"), "component")


def _per_component(edges: DataFrame, threshold: float, cap: int, complete: bool) -> DataFrame:
    live = edges.where(F.col("score") >= threshold)
    labelled = live.join(connected(live.select("a", "b")).select(F.col("id").alias("a"), "component"), "a")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict = {}
        for a, b in zip(pdf["a"], pdf["b"]):
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        taken: set = set()
        rows = []
        for seed in sorted(near, key=lambda v: (-len(near[v]), v)):
            if seed in taken:
                continue
            members = [seed]
            for j in sorted(near[seed]):
                if len(members) >= cap:
                    break
                if j not in taken and (not complete or all(m in near[j] for m in members)):
                    members.append(j)
            if len(members) > 1:
                taken.update(members)
                rows += [(seed, m, i) for i, m in enumerate(members)]
        return pd.DataFrame(rows, columns=["seed", "member", "place"])

    kind = edges.schema["a"].dataType.simpleString()
    return labelled.groupBy("component").applyInPandas(run, f"seed {kind}, member {kind}, place int")


def greedy_clusters(edges: DataFrame, threshold: float = 0.85, cap: int = 50) -> DataFrame:
    """``seed, member, place``: seeds by degree, then id; members in id order until the cap; singletons left out.

    All decisions use edges inside one connected component, so components are clustered apart.
    """
    return _per_component(edges, threshold, cap, False)


def complete_clusters(edges: DataFrame, threshold: float = 0.78, cap: int = 50) -> DataFrame:
    """The same, a member joining only if it is similar to all members so far."""
    return _per_component(edges, threshold, cap, True)


class CentroidClusters:
    """Incremental clustering: a vector joins the most similar centroid at or above the threshold, else opens one.

    The centroid becomes the renormalised running mean.  The result depends on the order of arrival.
    """

    def __init__(self, threshold: float = 0.85):
        self.threshold, self.centroids, self.sizes, self.members = threshold, [], [], []

    def add(self, key, vector) -> int:
        v = np.asarray(vector, dtype=float)
        v = v / (np.linalg.norm(v) or 1.0)
        if self.centroids:
            s = np.stack(self.centroids) @ v
            i = int(s.argmax())
            if s[i] >= self.threshold:
                self.sizes[i] += 1
                n = self.sizes[i]
                c = self.centroids[i] * (n - 1) / n + v / n
                self.centroids[i] = c / (np.linalg.norm(c) or 1.0)
                self.members[i].append(key)
                return i
        self.centroids.append(v)
        self.sizes.append(1)
        self.members.append([key])
        return len(self.centroids) - 1

    def clusters(self, least: int = 2) -> list[list]:
        return [m for m in self.members if len(m) >= least]


def incremental_clusters(vectors: DataFrame, threshold: float = 0.85, shard: Column | None = None) -> DataFrame:
    """``shard, cluster, id``: incremental clustering in id order within each shard.

    Without ``shard`` the order of arrival is one sequence, which only one task can follow; a shard
    column (such as a language or an LSH bucket) makes it parallel and is an approximation.
    """
    kind = vectors.schema["id"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        c = CentroidClusters(threshold)
        pdf = pdf.sort_values("id")
        return pd.DataFrame({"shard": pdf["shard"], "cluster": [c.add(k, v) for k, v in zip(pdf["id"], pdf["embedding"])], "id": pdf["id"]})

    rows = vectors.where("embedding IS NOT NULL").select("id", "embedding", (shard if shard is not None else F.lit(0)).cast("long").alias("shard"))
    return rows.groupBy("shard").applyInPandas(run, f"shard long, cluster int, id {kind}")


def covariance(vectors: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of rows, mean and population covariance by distributed partial sums (one small matrix a task)."""
    rows = vectors.where("embedding IS NOT NULL").select("embedding")

    def run(batches):
        for b in batches:
            x = np.stack(b["embedding"].to_numpy()).astype(float)
            yield pd.DataFrame({"n": [len(x)], "s": [x.sum(axis=0).tolist()], "q": [(x.T @ x).ravel().tolist()]})

    part = rows.mapInPandas(run, "n long, s array<double>, q array<double>")
    d = rows.select(F.size("embedding").alias("d")).first()
    if d is None:
        raise ValueError("no vectors")
    d = d["d"]
    got = part.agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[i]) for i in range(d)]).alias("s")).first()
    square = part.select(F.posexplode("q").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()
    n, mean = got["n"], np.array(got["s"]) / got["n"]
    return n, mean, np.array([r["x"] for r in square]).reshape(d, d) / n - np.outer(mean, mean)


def whitening(vectors: DataFrame, mode: str = "zca", eps: float = 0.1, k: int | None = None, drop: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection: soft ZCA, ``abt`` (all but the top ``drop`` directions) or PCA to ``k`` dimensions."""
    _, mean, cov = covariance(vectors)
    values, axes = np.linalg.eigh(cov)
    values, axes = np.maximum(values[::-1], 0), axes[:, ::-1]
    if mode == "abt":
        top = axes[:, : min(drop, len(values))]
        return mean, np.eye(len(mean)) - top @ top.T
    if mode == "zca":
        return mean, axes @ np.diag(1 / np.sqrt(values + eps)) @ axes.T
    if mode == "pca":
        m = min(k or len(values), len(values))
        return mean, axes[:, :m] @ np.diag(1 / np.sqrt(values[:m] + 1e-8))
    raise ValueError(f"unknown mode {mode}")


def whiten(vectors: DataFrame, mean: np.ndarray, projection: np.ndarray) -> DataFrame:
    """``id, embedding``: centred, projected and renormalised vectors."""
    kind = vectors.schema["id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            x = (np.stack(b["embedding"].to_numpy()).astype(float) - mean) @ projection
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-8)
            yield pd.DataFrame({"id": b["id"], "embedding": list(x)})

    return vectors.where("embedding IS NOT NULL").select("id", "embedding").mapInPandas(run, f"id {kind}, embedding array<double>")
