"""Similarity, novelty, clustering and similarity-graph queries over ``embeddings``."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import graphs, metrics, retrieval, similarity
from quern.session import cut, table

from .registry import register
from .search import ASKED, topk, units, vector_queries, vectors

THETA = 0.35  #: on these vectors the usual thresholds find nothing
PAIRS = f"{units()}, pairs AS (SELECT x.id AS a, y.id AS b, x.label AS la, y.label AS lb, round(list_inner_product(x.u, y.u), 6) AS score FROM u x JOIN u y ON x.id < y.id WHERE list_inner_product(x.u, y.u) >= {THETA})"


def pairs(spark, d):
    return similarity.cosine_pairs(vectors(spark, d), THETA)


@register(f"WITH {PAIRS} SELECT a, b, score FROM pairs")
def cosine_pairs(spark, d):
    return pairs(spark, d)


@register(f"WITH {PAIRS} SELECT a, b, score FROM pairs WHERE la IS DISTINCT FROM lb")
def cosine_pairs_cross_group(spark, d):
    return similarity.cross_group(pairs(spark, d), vectors(spark, d).select("id", F.col("label").alias("grp")))


_MIX = f"{units()}, w AS (SELECT id, u[1:32] AS h, u[33:64] AS t FROM u)"


def _half(c: str) -> str:
    return f"list_transform({c}, lambda x: x / CASE WHEN sqrt(list_inner_product({c}, {c})) = 0 THEN 1 ELSE sqrt(list_inner_product({c}, {c})) END)"


@register(
    f"WITH {_MIX}, n AS (SELECT id, {_half('h')} AS h, {_half('t')} AS t FROM w), m AS (SELECT id, list_transform(list_zip(h, t), lambda p: 0.7 * p[1] + 0.3 * p[2]) AS v FROM n), k AS (SELECT id, {_half('v')} AS v FROM m) "
    "SELECT x.id AS id_a, y.id AS id_b, round(round(list_inner_product(x.v, y.v), 6), 4) AS score FROM k x JOIN k y ON x.id < y.id WHERE list_inner_product(x.v, y.v) >= 0.52"
)
def doc_similarity_weighted(spark, d):
    v = vectors(spark, d).select("id", F.slice("embedding", 1, 32).alias("head"), F.slice("embedding", 33, 32).alias("tail"))
    return similarity.document_similarity(v, {"head": 0.7, "tail": 0.3})


_TRIAGE = "CASE WHEN score >= 0.42 THEN 'duplicate' WHEN score < 0.38 THEN 'distinct' ELSE 'uncertain' END"


@register(f"WITH {PAIRS} SELECT a, b, {_TRIAGE} AS label, round(CASE WHEN score >= 0.42 THEN score WHEN score < 0.38 THEN 1 - score ELSE abs(score - 0.4) / 0.02 END, 6) AS confidence FROM pairs")
def pair_triage(spark, d):
    label, confidence = similarity.triage(F.col("score"), 0.42, 0.38)
    return pairs(spark, d).select("a", "b", label.alias("label"), F.round(confidence, 6).alias("confidence"))


@register(f"WITH {PAIRS} SELECT concat('pair_', a, '_', b) AS id, concat(coalesce(p.text, ''), chr(10), '---', chr(10), coalesce(q.text, '')) AS content, printf('cosine=%.3f', score) AS output, {_TRIAGE} AS label FROM pairs LEFT JOIN documents p ON p.doc_id = a LEFT JOIN documents q ON q.doc_id = b")
def eval_harness_rows(spark, d):
    t = table(spark, d, "documents").select(F.col("doc_id").alias("i"), "text")
    label, _ = similarity.triage(F.col("score"), 0.42, 0.38)
    both = pairs(spark, d).join(t.select(F.col("i").alias("a"), F.col("text").alias("ta")), "a", "left").join(t.select(F.col("i").alias("b"), F.col("text").alias("tb")), "b", "left")
    return both.select(
        F.concat(F.lit("pair_"), "a", F.lit("_"), "b").alias("id"), F.concat_ws("\n", F.coalesce("ta", F.lit("")), F.lit("---"), F.coalesce("tb", F.lit(""))).alias("content"),
        F.format_string("cosine=%.3f", "score").alias("output"), label.alias("label"),
    )


@register(f"WITH {PAIRS}, l AS (SELECT *, CASE (a + b) % 4 WHEN 0 THEN 'entailment' WHEN 1 THEN 'contradiction' WHEN 2 THEN 'neutral' END AS nli FROM pairs) SELECT a, b, CASE WHEN score < 0.37 THEN 'NEW' WHEN score >= 0.41 THEN CASE WHEN nli = 'contradiction' THEN 'NEW' ELSE 'KNOWN' END WHEN nli = 'entailment' THEN 'KNOWN' WHEN nli = 'contradiction' THEN 'NEW' ELSE 'EXTENDS' END AS relation FROM l")
def pair_cascade(spark, d):
    """The entailment label stands in as (a + b) mod 4."""
    m = (F.col("a") + F.col("b")) % 4
    nli = F.when(m == 0, "entailment").when(m == 1, "contradiction").when(m == 2, "neutral")
    return pairs(spark, d).select("a", "b", similarity.relation(F.col("score"), nli, 0.41, 0.37).alias("relation"))


def _novelty_parts(spark, d):
    v = vectors(spark, d)
    index = v.select("id", "embedding", F.col("label").alias("category"), (F.col("id") % 90).cast("double").alias("age"))
    spec = F.when(F.col("label") < 3, "measurable").when(F.col("label") < 6, "concrete").when(F.col("label") < 8, "vague")
    return index, v.where(ASKED).select(F.col("id").alias("qid"), F.col("embedding").alias("q"), F.col("label").alias("category"), spec.alias("specificity"))


_NOV = f"""{units()}, k AS (SELECT CASE WHEN count(*) <= 50 THEN 1 WHEN count(*) <= 200 THEN 3 WHEN count(*) <= 1000 THEN 5 ELSE 10 END AS k FROM u),
s AS (SELECT q.id AS qid, q.label AS qc, c.id, c.label AS c, c.id % 90 AS age, round(list_inner_product(q.u, c.u), 6) AS s FROM u q, u c WHERE q.id % 50 = 0 AND c.id <> q.id),
g AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS r FROM s), l AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS r FROM s WHERE c = qc),
gm AS (SELECT qid, 1 - avg(s) AS g, 1 - sum(s * exp(-0.02 * age)) / sum(exp(-0.02 * age)) AS gd FROM g, k WHERE r <= k.k GROUP BY qid), lm AS (SELECT qid, 1 - avg(s) AS l FROM l, k WHERE r <= k.k GROUP BY qid)"""
_CUT = "round(greatest(0, least(1, {})), 6)"


@register(f"WITH {_NOV} SELECT qid, {_CUT.format('g')} AS novelty FROM gm")
def novelty_global(spark, d):
    return similarity.novelty(*_novelty_parts(spark, d), own=True).select("qid", "novelty")


@register(f"WITH {_NOV} SELECT qid, {_CUT.format('CASE WHEN l IS NULL THEN g ELSE 0.4 * g + 0.6 * l END')} AS novelty FROM gm LEFT JOIN lm USING (qid)")
def novelty_local(spark, d):
    return similarity.novelty(*_novelty_parts(spark, d), own=True, local=True).select("qid", "novelty")


@register(f"WITH {_NOV} SELECT qid, {_CUT.format('gd')} AS novelty FROM gm")
def novelty_decay(spark, d):
    return similarity.novelty(*_novelty_parts(spark, d), own=True, decay=0.02).select("qid", "novelty")


@register(f"WITH {_NOV}, p AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY m DESC, id) AS r2 FROM (SELECT qid, id, round(s * exp(-0.02 * age), 6) AS m FROM s)) SELECT qid, {_CUT.format('1 - avg(m)')} AS novelty FROM p, k WHERE r2 <= k.k GROUP BY qid")
def novelty_premultiplied(spark, d):
    return similarity.novelty(*_novelty_parts(spark, d), own=True, decay=0.02, mode="premultiply").select("qid", "novelty")


@register(
    f"WITH {_NOV}, e AS (SELECT generate_subscripts(u, 1) AS i, unnest(u) AS x FROM u), m AS (SELECT list(x ORDER BY i) AS m FROM (SELECT i, avg(x) AS x FROM e GROUP BY i)) "
    f"SELECT qid, {_CUT.format('(0.7 * (CASE WHEN l IS NULL THEN g ELSE 0.4 * g + 0.6 * l END) + 0.3 * (1 - list_inner_product(u.u, m.m) / (greatest(sqrt(list_inner_product(u.u, u.u)), 1e-8) * greatest(sqrt(list_inner_product(m.m, m.m)), 1e-8)))) * CASE WHEN label < 3 THEN 1 WHEN label < 6 THEN 0.8 WHEN label < 8 THEN 0.3 ELSE 1 END')} AS novelty FROM gm LEFT JOIN lm USING (qid) JOIN u ON u.id = qid, m"
)
def novelty_specific(spark, d):
    return similarity.novelty(*_novelty_parts(spark, d), own=True, local=True, specific=True).select("qid", "novelty")


_TWO = "two AS (SELECT a AS v, b AS w FROM pairs UNION SELECT b, a FROM pairs)"


@register(f"WITH RECURSIVE {PAIRS}, {_TWO}, reach AS (SELECT v, v AS w FROM two UNION SELECT r.v, t.w FROM reach r JOIN two t ON t.v = r.w) SELECT v AS id, min(w) AS component FROM reach GROUP BY v")
def sim_components(spark, d):
    return similarity.connected(pairs(spark, d))


@register(f"WITH {PAIRS}, {_TWO}, g AS (SELECT v, count(*) AS d FROM two GROUP BY v) SELECT count(*) AS nodes, CAST(sum(d) / 2 AS BIGINT) AS edges, round(avg(d), 6) AS mean_degree, max(d) AS max_degree FROM g")
def sim_graph_stats(spark, d):
    return graphs.stats(pairs(spark, d))


@register(f"WITH {PAIRS}, {_TWO}, s(id) AS (SELECT DISTINCT v FROM two WHERE v % 50 = 0), d1 AS (SELECT DISTINCT s.id AS start, w AS id FROM s JOIN two ON v = s.id WHERE w <> s.id), d2 AS (SELECT DISTINCT start, w AS id FROM d1 JOIN two ON v = d1.id WHERE w <> start EXCEPT SELECT start, id FROM d1) SELECT id AS start, id, 0 AS distance FROM s UNION ALL SELECT *, 1 FROM d1 UNION ALL SELECT *, 2 FROM d2")
def sim_bfs(spark, d):
    p = cut(pairs(spark, d))
    starts = graphs.both_ways(p).where("v % 50 = 0").select(F.col("v").alias("id")).distinct()
    return graphs.neighbourhood(p, starts, 2)


def _label_rounds(rounds: int) -> str:
    one = "l{i} AS MATERIALIZED (SELECT v, label FROM (SELECT t.v, l.label, count(*) AS n FROM two t JOIN l{j} l ON l.v = t.w GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY v ORDER BY n DESC, label) = 1)"
    return "l0 AS (SELECT DISTINCT v, v AS label FROM two), " + ", ".join(one.format(i=i, j=i - 1) for i in range(1, rounds + 1)) + f" SELECT v, label FROM l{rounds}"


@register(f"WITH {PAIRS}, {_TWO}, {_label_rounds(20)}")
def label_propagation(spark, d):
    return graphs.label_propagation(pairs(spark, d))


@register()
def betweenness(spark, d):
    p = cut(pairs(spark, d))
    return graphs.betweenness(p, graphs.both_ways(p).where("v % 50 = 0").select(F.col("v").alias("id")).distinct())


@register()
def clusters_greedy(spark, d):
    return similarity.greedy_clusters(pairs(spark, d), THETA)


@register()
def clusters_complete(spark, d):
    return similarity.complete_clusters(pairs(spark, d), THETA)


@register()
def clusters_incremental(spark, d):
    """Sharded by label; within a shard in id order."""
    return similarity.incremental_clusters(vectors(spark, d), THETA, F.col("label"))


def _whitened(spark, d, mode, **kw):
    v = vectors(spark, d).select("id", "embedding")
    return similarity.whiten(v, *similarity.whitening(v, mode, **kw))


@register()
def whiten_zca(spark, d):
    return _whitened(spark, d, "zca")


@register()
def whiten_abt(spark, d):
    return _whitened(spark, d, "abt", drop=2)


@register()
def whiten_pca(spark, d):
    return _whitened(spark, d, "pca", k=16)


@register(f"WITH {units()}, rel AS (SELECT q.id AS qid, c.id, 1 AS rel FROM u q JOIN u c ON c.label = q.label WHERE q.id % 50 = 0), scored AS (SELECT q.id AS qid, c.id, round(list_inner_product(q.u, c.u), 6) AS score FROM u q, u c WHERE q.id % 50 = 0), ranked AS ({topk('scored', 10)}), hit AS (SELECT qid, sum(1 / log2(rank + 1)) AS dcg, min(rank) AS first, count(*) AS found FROM ranked JOIN rel USING (qid, id) GROUP BY qid), ideal AS (SELECT qid, count(*) AS n, sum(CASE WHEN r <= 10 THEN 1 / log2(r + 1) END) AS idcg FROM (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY id) AS r FROM rel) GROUP BY qid) SELECT qid, round(coalesce(dcg / idcg, 0), 6) AS ndcg, round(coalesce(1.0 / first, 0), 6) AS mrr, round(coalesce(found / n, 0), 6) AS recall FROM ideal LEFT JOIN hit USING (qid)")
def retrieval_metrics(spark, d):
    """Rows of the query's label count as relevant."""
    v = vectors(spark, d)
    q = vector_queries(spark, d)
    labels = v.where(ASKED).select(F.col("id").alias("qid"), "label")
    relevant = labels.join(v.select("id", "label"), "label").select("qid", "id", F.lit(1).alias("rel"))
    return metrics.retrieval(retrieval.vector_topk(v, q), relevant)


@register(f"WITH {PAIRS} SELECT count(*) AS n, round(avg(score), 4) AS mean_cosine, round(avg(CASE WHEN la = lb THEN score END), 4) AS same_label, round(avg(CASE WHEN la <> lb THEN score END), 4) AS other_label FROM pairs")
def pair_cosine_stats(spark, d):
    g = vectors(spark, d).select("id", "label")
    p = pairs(spark, d).join(g.select(F.col("id").alias("a"), F.col("label").alias("la")), "a").join(g.select(F.col("id").alias("b"), F.col("label").alias("lb")), "b")
    return p.agg(F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("mean_cosine"), F.round(F.avg(F.when(F.col("la") == F.col("lb"), F.col("score"))), 4).alias("same_label"), F.round(F.avg(F.when(F.col("la") != F.col("lb"), F.col("score"))), 4).alias("other_label"))
