"""Queries of index and cache upkeep, of evaluation helpers and of single column kernels."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import temporal
from quern.operators import entities, graphs, knowledge, metrics, resolution, retrieval, similarity, upkeep
from quern.operators import operations as ops
from quern.session import table

from .knowledge_queries import _PARSED, _SQL_DATES, DATES
from .records import _CAND, _candidates
from .registry import register
from .records import _COSTS, _costs
from .search import _TOKENS, ASKED, BM25, docs, text_queries, topk, units, vectors

NOW = 1_750_000_000  #: the moment that the cache queries look from


@register(f"WITH {units()} SELECT id, round(u[1], 6) AS first, len(u) AS dim FROM u")
def index_append(spark, d):
    """Half of the vectors are indexed, the others appended."""
    v = vectors(spark, d)
    index = upkeep.append_vectors(None, v.where("label < 5"), 64)
    out = upkeep.append_vectors(index, v.where("label >= 5 OR label IS NULL"), 64)
    return out.select("id", F.round(F.col("u")[0], 6).alias("first"), F.size("u").alias("dim"))


@register("SELECT doc_path, content FROM chunks WHERE doc_path IS NULL OR doc_path NOT IN (SELECT path FROM documents WHERE doc_id % 3 = 0) UNION ALL SELECT path, text FROM documents WHERE doc_id % 3 = 0")
def chunks_replaced(spark, d):
    """Every third document has changed and comes as one chunk."""
    fresh = table(spark, d, "documents").where("doc_id % 3 = 0").select(F.col("path").alias("doc_path"), F.col("text").alias("content"))
    return upkeep.replace_chunks(table(spark, d, "chunks").select("doc_path", "content"), fresh, fresh)


@register("SELECT doc_path, content, collection FROM chunks UNION ALL SELECT concat('claim:', item_id), max(question), 'claims' FROM eval_items GROUP BY item_id")
def claims_upserted(spark, d):
    """The evaluation questions become claims, twice: the second time replaces the first."""
    c = table(spark, d, "eval_items").select(F.col("item_id").alias("id"), F.col("question").alias("content"), F.lit(None).cast("string").alias("metadata"))
    documents = table(spark, d, "documents").select("path", "mtime", "collection", "metadata", "indexed_at")
    chunks = table(spark, d, "chunks").select("doc_path", "content", "metadata", "collection")
    documents, chunks = upkeep.upsert_claims(documents, chunks, c.withColumn("content", F.lit("earlier")), NOW)
    return upkeep.upsert_claims(documents, chunks, c, NOW + 1)[1].select("doc_path", "content", "collection")


_NEWTEXT = "CASE WHEN doc_id % 10 = 0 THEN concat(text, ' late addendum') ELSE text END"


@register(f"WITH t AS (SELECT doc_id AS id, {_NEWTEXT} AS text FROM documents WHERE text IS NOT NULL AND doc_id % 10 <> 1), p AS (SELECT id, len({_TOKENS}) AS dl, unnest({_TOKENS}) AS term FROM t) SELECT id, term, count(*) AS tf, any_value(dl) AS dl FROM p GROUP BY id, term")
def postings_updated(spark, d):
    """Every tenth document has a new text, every tenth other one is gone."""
    c = docs(spark, d).select("id", "content").where("content IS NOT NULL")
    changed = c.where("id % 10 = 0").withColumn("content", F.concat("content", F.lit(" late addendum")))
    return upkeep.update_postings(retrieval.postings(c), changed, c.where("id % 10 = 1"))


_CACHE = "cache AS (SELECT text_hash AS key, model_name AS source, concat('v', length(text_hash)) AS payload, CAST(floor(created_at) AS BIGINT) AS fetched_at, CASE WHEN text_hash < '8' THEN 100000000 ELSE 40000000 END AS ttl_seconds FROM embedding_cache)"


def _cache(spark, d):
    ttl = F.when(F.col("text_hash") < "8", 100_000_000).otherwise(40_000_000).cast("long")
    return table(spark, d, "embedding_cache").select(F.col("text_hash").alias("key"), F.col("model_name").alias("source"), F.concat(F.lit("v"), F.length("text_hash")).alias("payload"), F.floor("created_at").cast("long").alias("fetched_at"), ttl.alias("ttl_seconds"))


def _hashes(spark, d):
    return table(spark, d, "embedding_cache").where("text_hash >= '4'").select(F.col("text_hash").alias("key")).distinct()


@register(f"WITH {_CACHE}, k AS (SELECT DISTINCT key FROM cache WHERE key >= '4') SELECT key, source, payload, fetched_at, ttl_seconds FROM cache WHERE NOT (source = 'mini-64' AND key IN (SELECT key FROM k)) UNION ALL SELECT key, 'mini-64', concat('new ', key), {NOW}, 2592000 FROM k")
def payload_put(spark, d):
    return upkeep.put_many(_cache(spark, d), _hashes(spark, d).withColumn("payload", F.concat(F.lit("new "), "key")), "mini-64", NOW)


@register(f"WITH {_CACHE} SELECT key, payload FROM cache WHERE source = 'mini-64' AND key >= '4' AND {NOW} - fetched_at <= ttl_seconds")
def payload_get(spark, d):
    return upkeep.get_many(_cache(spark, d), _hashes(spark, d), "mini-64", NOW)


@register(f"WITH {_CACHE} SELECT key, payload FROM cache WHERE source = 'mini-64' AND key >= '4'")
def payload_get_stale(spark, d):
    return upkeep.get_many(_cache(spark, d), _hashes(spark, d), "mini-64", NOW, allow_stale=True)


@register(f"WITH {_CACHE} SELECT source, count(*) AS total, count(*) FILTER (WHERE {NOW} - fetched_at <= ttl_seconds) AS fresh, count(*) FILTER (WHERE {NOW} - fetched_at > ttl_seconds) AS expired FROM cache WHERE NOT (source = 'mini-64' AND key >= '4') AND NOT (source = 'multi-64' AND fetched_at < {NOW - 30_000_000}) GROUP BY source")
def payload_invalidated(spark, d):
    """Statistics after a deletion of keys in one source and an invalidation by time in the other."""
    c = upkeep.delete_keys(_cache(spark, d), _hashes(spark, d), "mini-64")
    return upkeep.cache_stats(upkeep.invalidate_before(c, "multi-64", NOW - 30_000_000)[0], NOW)


_RECENT = f"{units()}, s AS (SELECT q.id AS qid, (q.id - c.id) / 20.0 AS age, round(list_inner_product(q.u, c.u), 6) AS s FROM u q JOIN u c ON c.id < q.id WHERE q.id % 50 = 0)"


@register(f"WITH {_RECENT}, m AS (SELECT q.id AS qid, round(coalesce(max(s) FILTER (WHERE age <= 7), 0), 4) AS recent, round(coalesce(max(s) FILTER (WHERE age > 7), 0), 4) AS old FROM u q LEFT JOIN s ON s.qid = q.id WHERE q.id % 50 = 0 GROUP BY q.id) SELECT qid, recent, old, CASE WHEN recent >= 0.4 THEN 'KNOWN' WHEN recent <= 0.3 THEN 'NOVEL' ELSE 'AMBIGUOUS' END AS label FROM m")
def recency_truth(spark, d):
    """Ground truth of novelty: the greatest similarity to rows of the last seven days and to older ones."""
    v = vectors(spark, d).select("id", "embedding", (F.col("id") / 20.0).alias("day"))
    return similarity.recency_truth(v, v.where(ASKED), known=0.4, novel=0.3)


@register(f"WITH {units()}, s AS (SELECT q.id AS qid, c.id, round(list_inner_product(q.u, c.u), 6) AS s FROM u q, u c WHERE q.id % 50 = 0 AND c.id <> q.id), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS r FROM s) SELECT qid, round(max(s) FILTER (WHERE r = 1) - max(s) FILTER (WHERE r = 2), 6) AS gap FROM r WHERE r <= 2 GROUP BY qid")
def neighbour_gap(spark, d):
    """How clear each asked vector's nearest neighbour is of the second."""
    v = vectors(spark, d)
    two = retrieval.vector_topk(v, v.where(ASKED).select(F.col("id").alias("qid"), F.col("embedding").alias("q")), 2, own=False)
    best, second = (F.max(F.when(F.col("rank") == r, F.col("score"))) for r in (1, 2))
    return two.groupBy("qid").agg(F.round(best - second, 6).alias("gap"))


@register("WITH s AS (SELECT CAST(n_chars AS DOUBLE) AS score, lang = 'en' AS truth FROM documents WHERE n_chars IS NOT NULL AND lang IS NOT NULL), m AS (SELECT min(score) AS lo, max(score) AS hi FROM s), b AS (SELECT floor((score - lo) / (hi - lo) * 199 + 1e-9) AS step, lo, hi, count(*) AS n, count(*) FILTER (WHERE truth) AS p FROM s, m GROUP BY 1, 2, 3), r AS (SELECT lo, hi, step, sum(n) OVER (ORDER BY step DESC) AS said, sum(p) OVER (ORDER BY step DESC) AS tp, sum(p) OVER () AS pos, sum(n) OVER () AS every FROM b) SELECT round(lo + (hi - lo) * step / 199, 6) AS threshold, round((tp + every - pos - (said - tp)) / every, 6) AS accuracy FROM r ORDER BY accuracy DESC, threshold LIMIT 1")
def best_accuracy(spark, d):
    t = table(spark, d, "documents").select(F.col("n_chars").cast("double").alias("score"), (F.col("lang") == "en").alias("truth"))
    return metrics.best_accuracy(t)


def _half(c: str) -> str:
    return f"list_transform({c}, lambda x: x / CASE WHEN sqrt(list_inner_product({c}, {c})) = 0 THEN 1 ELSE sqrt(list_inner_product({c}, {c})) END)"


@register(
    f"WITH {units()}, w AS (SELECT id, u[1:32] AS h, u[33:64] AS t FROM u), n AS (SELECT id, {_half('h')} AS h, {_half('t')} AS t FROM w), m AS (SELECT id, h, t, list_transform(list_zip(h, t), lambda p: 0.7 * p[1] + 0.3 * p[2]) AS v FROM n), k AS (SELECT id, h, t, {_half('v')} AS v FROM m) "
    "SELECT x.id AS id_a, y.id AS id_b, round(round(list_inner_product(x.v, y.v), 6), 4) AS score, round(list_inner_product(x.h, y.h), 4) + 0.0 AS head, round(list_inner_product(x.t, y.t), 4) + 0.0 AS tail FROM k x JOIN k y ON x.id < y.id WHERE list_inner_product(x.v, y.v) >= 0.52"
)
def doc_similarity_fields(spark, d):
    """Similar documents with the similarity of each field."""
    v = vectors(spark, d).select("id", F.slice("embedding", 1, 32).alias("head"), F.slice("embedding", 33, 32).alias("tail"))
    return similarity.field_scores(similarity.document_similarity(v, {"head": 0.7, "tail": 0.3}), v, ["head", "tail"])


@register(f"WITH {_SQL_DATES}, p AS (SELECT text, {_PARSED} AS r FROM dates) SELECT text, (r.s + r.e) / 2 AS middle, CAST(r.e - r.s + 1 AS INTEGER) AS years, r.s <= 1905 AND r.e >= 1905 AS holds FROM p WHERE r.s IS NOT NULL")
def date_years(spark, d):
    t = spark.createDataFrame([(x,) for x in DATES], "text string").withColumn("r", temporal.parse_date(F.col("text"))).where("r IS NOT NULL")
    r = F.col("r")
    return t.select("text", temporal.midpoint(r).cast("double").alias("middle"), temporal.span_years(r).cast("int").alias("years"), temporal.contains(r, F.lit(1905)).alias("holds"))


_LITERAL = "CASE doc_id % 5 WHEN 0 THEN metadata WHEN 1 THEN CAST(n_chars AS VARCHAR) WHEN 2 THEN CASE WHEN n_chars > 500 THEN 'True' ELSE 'none' END ELSE source END"


@register(f"WITH l AS (SELECT doc_id, {_LITERAL} AS t FROM documents) SELECT doc_id, CASE WHEN regexp_matches(trim(t), '^[\\[{{]') THEN 'json' WHEN regexp_full_match(trim(t), '[+-]?\\d+') THEN 'int' WHEN lower(trim(t)) IN ('true', 'false') THEN 'bool' WHEN lower(trim(t)) IN ('null', 'none') THEN 'null' ELSE 'string' END AS kind FROM l")
def typed_literals(spark, d):
    m = F.col("doc_id") % 5
    t = F.when(m == 0, F.col("metadata")).when(m == 1, F.col("n_chars").cast("string")).when(m == 2, F.when(F.col("n_chars") > 500, "True").otherwise("none")).otherwise(F.col("source"))
    return table(spark, d, "documents").select("doc_id", entities.parse_value(t)["kind"].alias("kind"))


@register("WITH c AS (SELECT c_custkey AS id, lower(c_mktsegment) AS s FROM customer) SELECT a.id AS id_a, b.id AS id_b, NOT ((a.s = 'building' AND b.s = 'machinery') OR (a.s = 'machinery' AND b.s = 'building')) AS accepted FROM c a JOIN c b ON b.id = a.id + 1")
def veto_first_words(spark, d):
    """Neighbouring customers whose first words belong to opposite lists are refused."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.struct(F.col("c_mktsegment").alias("word")).alias("s"))
    pairs = c.select(F.col("id").alias("id_a"), F.col("s").alias("a")).join(c.select((F.col("id") - 1).alias("id_a"), F.col("id").alias("id_b"), F.col("s").alias("b")), "id_a")
    return entities.veto(pairs, [entities.gender_check("word", ["building"], ["machinery"])]).select("id_a", "id_b", "accepted")


@register("SELECT seq, CASE lower(trim(status)) WHEN 'verified' THEN 'done' WHEN 'flagged' THEN 'needs_review' ELSE lower(trim(status)) END AS state FROM items")
def result_states(spark, d):
    return table(spark, d, "items").select("seq", ops.result_status(F.lower(F.trim("status"))).alias("state"))


@register("SELECT event_id, CAST(least(greatest(event_id % 100, floor(event_id % 100 * 1.5)), 120) AS DOUBLE) AS seconds FROM events")
def tier_timeouts(spark, d):
    base = F.col("event_id") % 100
    return table(spark, d, "events").select("event_id", ops.tier_timeout(base, F.lit(1.5), F.lit(120)).cast("double").alias("seconds"))


@register("SELECT event_id AS response_id, m AS model, CAST(t AS BIGINT) AS input_tokens, CAST(t * 2 AS BIGINT) AS output_tokens FROM (SELECT event_id, unnest(CASE WHEN event_id % 3 = 0 THEN ['plain'] WHEN event_id % 3 = 1 THEN ['x'] ELSE ['x', 'y'] END) AS m, event_id % 500 AS t FROM events)")
def usage_by_model(spark, d):
    """Every third response names no models and counts under its own."""
    t = (F.col("event_id") % 500).cast("long")
    u = F.struct(t.alias("input_tokens"), (t * 2).alias("output_tokens"), F.lit(0.5).alias("cost"))
    kind = F.col("event_id") % 3
    usage = F.when(kind == 1, F.create_map(F.lit("x"), u)).when(kind == 2, F.create_map(F.lit("x"), u, F.lit("y"), u))
    r = table(spark, d, "events").select(F.col("event_id").alias("response_id"), usage.alias("model_usage"), F.lit("plain").alias("model"), t.alias("input_tokens"), (t * 2).alias("output_tokens"), F.lit(0.5).alias("cost"))
    return ops.usage_rows(r).select("response_id", "model", "input_tokens", "output_tokens")


@register("SELECT graph_id, id, updated_at, coalesce(level, 0) AS level FROM (SELECT graph_id, id, updated_at, level, row_number() OVER (PARTITION BY graph_id, id ORDER BY updated_at DESC NULLS LAST, level DESC NULLS LAST) AS r FROM (SELECT lower(trim(graph_id)) AS graph_id, lower(trim(id)) AS id, updated_at, level FROM knowledge_nodes)) WHERE r = 1")
def latest_nodes(spark, d):
    n = table(spark, d, "knowledge_nodes").select(F.lower(F.trim("graph_id")).alias("graph_id"), F.lower(F.trim("id")).alias("id"), "updated_at", "level")
    return graphs.latest_version(n, ["graph_id", "id"], "updated_at").withColumn("level", F.coalesce("level", F.lit(0)))


@register("WITH n AS (SELECT lang, source, CAST(count(*) AS HUGEINT) AS n FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY 1, 2), b AS (SELECT sum(n * (n - 1) // 2) AS v FROM n), x AS (SELECT sum(n * (n - 1) // 2) AS v FROM (SELECT sum(n) AS n FROM n GROUP BY lang)), y AS (SELECT sum(n * (n - 1) // 2) AS v FROM (SELECT sum(n) AS n FROM n GROUP BY source)) SELECT CAST(b.v AS BIGINT) AS \"both\", CAST(x.v - b.v AS BIGINT) AS only_a, CAST(y.v - b.v AS BIGINT) AS only_b FROM b, x, y")
def cluster_agreement(spark, d):
    t = table(spark, d, "documents").where("lang IS NOT NULL AND source IS NOT NULL")
    return graphs.cluster_agreement(t.select(F.col("doc_id").alias("id"), F.col("lang").alias("c")), t.select(F.col("doc_id").alias("id"), F.col("source").alias("c")))


@register("SELECT event_id, CASE WHEN event_id % 11 < 3 THEN 'recognition' WHEN event_id % 11 % 4 = 0 AND event_id % 5 >= 2 THEN 'comparison' WHEN event_id % 100 / 100.0 > 0.6 THEN 'scoping' ELSE 'recognition' END AS kind FROM events")
def probe_kinds(spark, d):
    asked, candidates, belief = F.col("event_id") % 11, F.col("event_id") % 5, (F.col("event_id") % 100) / 100.0
    return table(spark, d, "events").select("event_id", knowledge.probe_kind(asked, candidates, belief).alias("kind"))


_FIRST = "b AS (SELECT lower(trim(graph_id)) AS g, lower(trim(id)) AS n, round(greatest(0.05, 0.5 - 0.08 * coalesce(max(obscurity), 3)), 6) AS belief, max(level) > 2 AS asked FROM knowledge_nodes WHERE trim(id) <> '' GROUP BY 1, 2)"


@register(f"WITH {_FIRST} SELECT g, n, belief, coalesce(asked, false) AS asked FROM b")
def beliefs_round_trip(spark, d):
    """Beliefs packed as one state a graph and read back."""
    n = table(spark, d, "knowledge_nodes").where("trim(id) <> ''").groupBy(F.lower(F.trim("graph_id")).alias("g"), F.lower(F.trim("id")).alias("n"))
    b = n.agg(F.round(knowledge.prior(F.max("obscurity")), 6).alias("belief"), F.coalesce(F.max("level") > 2, F.lit(False)).alias("asked"))
    return upkeep.beliefs_from_json(upkeep.beliefs_to_json(b))


_GUARD = f"{_CAND}, k2 AS (SELECT qid, type_hint, 1000 + 10 * rank AS y FROM kb_candidates), g AS (SELECT s.res_id, s.qid, c.hint, round(s.total + 0.15 * (w.w - 1), 6) AS total, c.hint IS NOT NULL AND CASE WHEN c.hint = '' OR k2.type_hint IS NULL THEN 0.5 WHEN c.hint = k2.type_hint THEN 1 ELSE 0.3 END < 0.5 AND w.w < 0.5 AS weak FROM scored s JOIN cand c USING (res_id, qid) JOIN k2 USING (qid), LATERAL (SELECT CASE WHEN k2.y IS NULL THEN 1.0 ELSE exp(-abs(k2.y - (1000 + s.res_id % 900)) / 100.0) END AS w) w)"


@register(f"WITH {_GUARD}, r AS (SELECT *, row_number() OVER (PARTITION BY res_id ORDER BY total DESC, qid) AS r FROM g), b AS (SELECT res_id, max(total) FILTER (WHERE r = 1) AS t, max(qid) FILTER (WHERE r = 1) AS q, bool_or(weak) FILTER (WHERE r = 1) AS weak, coalesce(max(total) FILTER (WHERE r = 2), 0) AS s FROM r WHERE r <= 2 GROUP BY res_id), d AS (SELECT *, t >= 0.55 AND (s = 0 OR t >= 1.25 * s) AS clear FROM b) SELECT res_id, CASE WHEN clear AND NOT weak THEN 'resolved' ELSE 'ambiguous' END AS status, CASE WHEN clear AND NOT weak THEN q END AS qid FROM d")
def resolver_guarded(spark, d):
    """Decisions with a date score (a year stands for each entity and mention) and the veto of weak matches."""
    k = table(spark, d, "kb_candidates").select("qid", "type_hint", (1000 + 10 * F.col("rank")).alias("y"))
    hint = table(spark, d, "resolutions").select("res_id", F.lower("type_hint").alias("hint"))
    c = _candidates(spark, d).join(k, "qid").join(hint, "res_id")
    year = 1000 + F.col("res_id") % 900
    date = resolution.date_score(F.col("y"), F.col("y"), year, year)
    type_ = resolution.type_score(F.col("hint"), F.col("type_hint"))
    c = c.withColumn("total", F.round(F.col("total") + resolution.WEIGHTS["date"] * (date - 1), 6)).withColumn("weak", resolution.weak_structural(F.col("hint"), type_, date))
    return resolution.decide_guarded(c, "res_id").select("res_id", "status", "qid")


@register()
def resolver_retry(spark, d):
    """Mentions that equal no name are tried again under the spellings of rulers' names."""
    m = table(spark, d, "resolutions").select("res_id", "mention")
    return resolution.retry(m, table(spark, d, "kb_candidates"))


@register(f"WITH {BM25}, c AS (SELECT s.* FROM scored s JOIN documents d ON d.doc_id = s.id WHERE d.collection = 'notes') {topk('c', 10)}")
def bm25_topk_by_collection(spark, d):
    """Statistics stay global; the collection filters the hits."""
    hits = retrieval.bm25(docs(spark, d), text_queries(spark)).join(docs(spark, d).where("collection = 'notes'").select("id"), "id", "left_semi")
    return retrieval.top(hits, 10)


@register(f"WITH {_COSTS} SELECT id, ts FROM costs WHERE ts >= '2024-01-25T00:00:00'")
def cost_last_days(spark, d):
    """Costs of the five days before a moment."""
    return ops.cost_filter(_costs(spark, d), days=5, now="2024-01-30 00:00:00").select("id", "ts")


@register("SELECT model_name, count(*) AS entries FROM (SELECT text_hash, model_name FROM embedding_cache UNION SELECT text_hash, 'mini-64' FROM embedding_cache WHERE text_hash >= '8') GROUP BY 1")
def embedding_cache_put(spark, d):
    """Vectors of half of the hashes are stored under one model again; an entry stays one."""
    c = table(spark, d, "embedding_cache").select("text_hash", "model_name", "embedding", "created_at")
    return upkeep.model_counts(upkeep.put_embeddings(c, c.where("text_hash >= '8'"), "mini-64", NOW))


@register(
    f"WITH {units()}, w AS (SELECT id, u[1:32] AS h, u[33:64] AS t FROM u), n AS (SELECT id, {_half('h')} AS h, {_half('t')} AS t FROM w), m AS (SELECT id, list_transform(list_zip(h, t), lambda p: 0.7 * p[1] + 0.3 * p[2]) AS v FROM n), k AS (SELECT id, {_half('v')} AS v FROM m) "
    "SELECT x.id AS id_a, y.id AS id_b, round(round(list_inner_product(x.v, y.v), 6), 4) AS score FROM k x JOIN k y ON x.id < y.id WHERE list_inner_product(x.v, y.v) >= 0.52 ORDER BY score DESC, id_a, id_b LIMIT 20"
)
def doc_similarity_top(spark, d):
    """The twenty most similar pairs."""
    v = vectors(spark, d).select("id", F.slice("embedding", 1, 32).alias("head"), F.slice("embedding", 33, 32).alias("tail"))
    return similarity.document_similarity(v, {"head": 0.7, "tail": 0.3}, max_pairs=20)
