"""Registered queries of the training-data operators (pN_...) and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.session import table

from . import components, leakage, names, neighbours, ranking, stuffing, tokens


def p1_found(spark, d):
    return ranking.rank_items(table(spark, d, "search_results"), top=5).select("query_id", "id")


def p1_ranking(spark, d):
    return ranking.rank_items(table(spark, d, "search_results"))


def p6_found(spark, d):
    edges = components.accepted_edges(table(spark, d, "match_pairs"))
    return components.components(edges).select(F.col("v").alias("record_id"), F.col("group").alias("group_id"))


def _vectors(spark, d):
    chunks = table(spark, d, "chunks").select(F.lit("chunks").alias("space"), F.lpad(F.col("id").cast("string"), 12, "0").alias("key"), "embedding")
    cache = table(spark, d, "embedding_cache").select(
        F.concat(F.lit("embedding_cache/"), F.coalesce(F.lower(F.trim("model_name")), F.lit(""))).alias("space"), F.col("text_hash").alias("key"), "embedding"
    )
    return chunks.unionByName(cache)


def p7_found(spark, d):
    pairs = neighbours.similar_pairs(_vectors(spark, d), 64)
    return pairs.select(F.substring_index("space", "/", 1).alias("table_name"), "key_a", "key_b").distinct()


def p7_knn(spark, d):
    """The five nearest of every chunk and cached vector whose id is divisible by 50, against all of its table (and model).

    A cached vector has no number; its hash's stands for it.
    """
    v = _vectors(spark, d)
    number = F.when(F.col("space") == "chunks", F.col("key").cast("long")).otherwise(F.xxhash64("key"))
    return neighbours.nearest(v, v.where(number % 50 == 0), 64).select(F.col("space").alias("table_name"), "key", "place", "neighbour", "cos")


def p2_found(spark, d):
    linked = names.link(table(spark, d, "resolutions"), table(spark, d, "kb_candidates"))
    return linked.select("res_id", "qid")


def p8_ids(spark, d):
    return tokens.encode(table(spark, d, "documents"), "doc_id", "text")


def p9_found(spark, d):
    return leakage.leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "passage").select("doc_id", "item_id")


def p9_items(spark, d):
    """How many documents leak each item."""
    found = leakage.leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "passage")
    return found.groupBy("item_id").agg(F.count("*").alias("documents"), F.round(F.max("coverage"), 4).alias("most"))


def p10_found(spark, d):
    return stuffing.stuffed(table(spark, d, "documents"), "doc_id", "text", "lang").select("doc_id")


def p10_scores(spark, d):
    out = stuffing.stuffed(table(spark, d, "documents"), "doc_id", "text", "lang")
    return out.select("doc_id", "direction", F.round("deviation", 3).alias("deviation"), F.round("distance", 3).alias("distance"))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_ranking, p2_found, p6_found, p7_found, p7_knn, p8_ids, p9_found, p9_items, p10_found, p10_scores)
}

_K = "coalesce(nullif(lower(trim({c})), ''), '')"
_RANKED = f"""
WITH r AS (
  SELECT query_id, concat({_K.format(c='list_label')}, chr(1), {_K.format(c='source')}) AS list, {_K.format(c='source')} AS source, trim(id) AS id, CASE WHEN isnan(score) THEN NULL ELSE score END AS score,
         CAST(rank AS DOUBLE) AS rank, logged_at
  FROM search_results WHERE query_id IS NOT NULL AND trim(id) <> ''),
w AS (SELECT query_id, list, source, covar_pop(rank, score) AS cov, count(*) FILTER (WHERE rank IS NULL) AS gaps, coalesce(min(rank), 0) AS first, coalesce(max(rank), 0) AS last FROM r GROUP BY 1, 2, 3),
b AS (SELECT source, sum(sign(cov)) AS c FROM w GROUP BY 1),
y AS (SELECT query_id, list, gaps, first, last, CASE WHEN coalesce(nullif(sign(cov), 0), sign(c), -1) > 0 THEN 1 ELSE -1 END AS sg FROM w JOIN b USING (source)),
c AS (SELECT r.*, gaps, first, last, score * sg AS cost FROM r JOIN y USING (query_id, list)),
g AS (
  SELECT *, last_value(CASE WHEN cost IS NOT NULL THEN rank END IGNORE NULLS) OVER (PARTITION BY query_id, list ORDER BY cost NULLS LAST, rank NULLS LAST, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s_rank,
         last_value(rank IGNORE NULLS) OVER (PARTITION BY query_id, list ORDER BY logged_at NULLS LAST, rank NULLS LAST, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS l_rank FROM c),
p AS (SELECT query_id, list, id, min(coalesce(rank, CASE WHEN cost IS NOT NULL THEN coalesce(s_rank, first - 1) ELSE coalesce(l_rank, last) END + 0.5) - first) AS place FROM g GROUP BY 1, 2, 3),
n AS (SELECT query_id, list, greatest(count(*), floor(max(place)) + 1) AS n FROM p GROUP BY 1, 2),
q AS (SELECT query_id, id, greatest(1e-9, least(1.0, 1 - place / n)) AS pct FROM p JOIN n USING (query_id, list)),
l AS (SELECT query_id, count(*) AS lists FROM n GROUP BY 1),
v AS (SELECT query_id, id, list_concat(list_transform(range(any_value(lists) - count(*)), lambda x: CAST(0 AS DOUBLE)), list_sort(list(CAST(pct AS DOUBLE)))) AS vector, count(*) AS lists_in FROM q JOIN l USING (query_id) GROUP BY 1, 2),
o AS (SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY vector DESC, id) AS INTEGER) AS place, CAST(lists_in AS INTEGER) AS lists_in, vector[1] AS weakest FROM v)"""

SQL: dict[str, str] = {
    "p1_found": _RANKED + " SELECT query_id, id FROM o WHERE place <= 5",
    "p1_ranking": _RANKED + " SELECT * FROM o",
    "p6_found": """
WITH RECURSIVE r AS (SELECT nullif(lower(trim(id_a)), '') AS a, nullif(lower(trim(id_b)), '') AS b, accepted FROM match_pairs),
k AS (SELECT least(a, b) AS a, greatest(a, b) AS b FROM r WHERE a <> b GROUP BY 1, 2 HAVING bool_and(coalesce(accepted, true))),
e AS (SELECT a AS v, b AS w FROM k UNION SELECT b, a FROM k),
t AS (SELECT v, v AS w FROM e UNION SELECT t.v, e.w FROM t JOIN e ON e.v = t.w)
SELECT v AS record_id, min(w) AS group_id FROM t GROUP BY v""",
}
