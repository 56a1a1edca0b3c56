"""Queries p3, p4 and p5 over the project's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import hierarchy, incremental, orphans
from quern.session import cut, table

from .registry import register

_OK = "(SELECT run_id FROM index_runs WHERE lower(trim(status)) = 'ok')"


def _ms(c: str) -> str:
    return f"(CASE WHEN {c} IS NULL OR isnan({c}) OR {c} <= 0 THEN NULL WHEN {c} >= 1e14 THEN round({c} / 1e3) WHEN {c} >= 1e11 THEN round({c}) ELSE round({c} * 1e3) END)"


@register(
    f"""
SELECT 'documents' AS table_name, CAST(doc_id AS VARCHAR) AS record_key FROM documents
WHERE deleted_at IS NULL AND ({_ms('indexed_at')} IS NULL OR {_ms('mtime')} > {_ms('indexed_at')} OR run_id IS NULL OR run_id NOT IN {_OK})
UNION
SELECT 'items', k FROM (
  SELECT lower(trim(item_id)) AS k,
         arg_max(lower(trim(status)), (ts, seq)) FILTER (WHERE run_id IS NULL OR run_id IN {_OK}) AS s
  FROM items GROUP BY 1)
WHERE s IS NULL OR s NOT IN ('done', 'verified', 'applied', 'skipped')
"""
)
def p3_found(spark, d):
    runs = table(spark, d, "index_runs")
    states = incremental.document_states(table(spark, d, "documents"), runs).unionByName(incremental.item_states(table(spark, d, "items"), runs))
    return incremental.pending(states)


def _graph(spark, d):
    nodes = cut(hierarchy.latest_nodes(table(spark, d, "knowledge_nodes")))
    return nodes, hierarchy.links(nodes)


_EDGES = """
last AS (
  SELECT lower(trim(graph_id)) AS g, lower(trim(id)) AS n, max({'u': updated_at, 'p': list_sort(list_distinct(list_transform(coalesce(prerequisites, []), lambda x: lower(trim(x)))))}) AS b
  FROM knowledge_nodes GROUP BY 1, 2),
edges AS (
  SELECT DISTINCT e.g, e.n AS c, e.p FROM (SELECT g, n, unnest(b.p) AS p FROM last) e JOIN last l ON l.g = e.g AND l.n = e.p),
up AS (
  SELECT g, p AS a, c AS d FROM edges UNION SELECT up.g, up.a, e.c FROM up JOIN edges e ON e.g = up.g AND e.p = up.d)
"""


@register(f"WITH RECURSIVE {_EDGES} SELECT g AS graph_id, a AS ancestor_id, d AS node_id FROM up")
def p4_found(spark, d):
    edges = hierarchy.spelled(cut(hierarchy.latest_nodes(table(spark, d, "knowledge_nodes"))))
    pairs = hierarchy.ancestors(edges.withColumnRenamed("graph_id", "g"))
    return pairs.select(F.col("g").alias("graph_id"), F.col("a").alias("ancestor_id"), F.col("d").alias("node_id"))


@register(
    f"""
WITH RECURSIVE {_EDGES},
ways(g, root, n, way) USING KEY (g, root, n) AS (
  SELECT g, n, n, [n] FROM last WHERE n IS NOT NULL AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.g = last.g AND e.c = last.n)
  UNION
  SELECT w.g, w.root, e.c, min(list_append(w.way, e.c)) FROM ways w JOIN edges e ON e.g = w.g AND e.p = w.n
  WHERE NOT EXISTS (SELECT 1 FROM recurring.ways r WHERE r.g = w.g AND r.root = w.root AND r.n = e.c) GROUP BY 1, 2, 3),
best AS (
  SELECT g, n, min({{'k': len(way) - 1, 'way': way}}) AS w, list({{'root': root, 'depth': CAST(len(way) - 1 AS INTEGER), 'path': array_to_string(way, ' > ')}} ORDER BY root) AS paths,
         string_agg(root, ',' ORDER BY root) AS roots FROM ways GROUP BY g, n),
above AS (SELECT g, d AS n, count(*) AS k, bool_or(a = d) AS cyclic FROM up GROUP BY 1, 2),
below AS (SELECT g, a AS n, count(*) AS k FROM up WHERE a <> d GROUP BY 1, 2)
SELECT l.g AS graph_id, l.n AS node_id, CAST(coalesce(b.w.k, -1) AS INTEGER) AS depth, array_to_string(b.w.way, ' > ') AS path, {{paths}} AS paths, coalesce(b.roots, '') AS roots,
       coalesce(u.k, 0) AS n_ancestors, coalesce(d.k, 0) AS n_descendants, coalesce(u.cyclic, false) AS cyclic
FROM last l LEFT JOIN best b USING (g, n) LEFT JOIN above u USING (g, n) LEFT JOIN below d USING (g, n) WHERE l.n IS NOT NULL
""".replace("{paths}", "array_to_string(list_transform(coalesce(b.paths, []), lambda p: concat_ws(':', p.root, p.depth, p.path)), ' | ')")
)
def p4_hierarchy(spark, d):
    """Depth, nearest path, a path from each root, roots and counts of every node; cycles are reported in ``cyclic``, depth -1 where no root leads."""
    nodes, edges = _graph(spark, d)
    out = hierarchy.hierarchy(nodes, cut(edges))
    paths = F.concat_ws(" | ", F.transform("paths", lambda w: F.concat_ws(":", w["root"], w["depth"], w["path"])))
    return out.select(F.col("g").alias("graph_id"), F.col("n").alias("node_id"), F.coalesce("depth", F.lit(-1)).alias("depth"), "path", paths.alias("paths"), "roots", "n_ancestors", "n_descendants", "cyclic")


def _references(spark, d):
    parents = orphans.parent_keys(table(spark, d, "documents"), table(spark, d, "items"), table(spark, d, "kb_candidates"))
    return parents, orphans.references(table(spark, d, "chunks"), table(spark, d, "entity_refs"))


def _path(c: str) -> str:
    return f"regexp_replace(regexp_replace(replace(lower(trim(replace({c}, '%20', ' '))), '\\', '/'), '/+', '/', 'g'), '^(\\./)+|^/|/$', '', 'g')"


_REFS = f"""
refs AS (
  SELECT 'chunks' AS table_name, id AS row_id, 'document' AS kind, {_path('doc_path')} AS target, added_at AS seen FROM chunks
  UNION ALL
  SELECT 'entity_refs', ref_id, lower(trim(target_type)), CASE WHEN lower(trim(target_type)) = 'document' THEN {_path('target_id')} ELSE lower(trim(target_id)) END, seen_at FROM entity_refs),
parents AS (
  SELECT 'document' AS kind, {_path('path')} AS target FROM documents WHERE deleted_at IS NULL
  UNION SELECT 'item', lower(trim(item_id)) FROM items
  UNION SELECT 'entity', lower(trim(qid)) FROM kb_candidates
  UNION SELECT 'entity', lower(trim(redirect_from)) FROM kb_candidates WHERE redirect_from IS NOT NULL),
lost AS (
  SELECT r.* FROM refs r LEFT JOIN parents p ON p.kind = r.kind AND p.target = r.target WHERE p.target IS NULL AND r.target <> '')
"""


@register(f"WITH {_REFS} SELECT table_name, row_id FROM lost")
def p5_found(spark, d):
    return orphans.orphans(*_references(spark, d)).select("table_name", "row_id")


@register(f"WITH {_REFS} SELECT table_name, kind, strftime(seen, '%Y-%m') AS month, count(*) AS orphans, count(DISTINCT target) AS targets FROM lost GROUP BY 1, 2, 3")
def p5_report(spark, d):
    return orphans.orphan_report(*_references(spark, d))
