"""Entity, validation, batch, audit, cost, cache, agreement and resolution queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import entities as ent
from quern.operators import metrics
from quern.operators import operations as ops
from quern.operators import resolution as res
from quern.session import table

from .registry import register

NOW = 1_740_000_000.0


def _customers(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").cast("double").alias("balance"))


def _orders(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))


def _lines(spark, d):
    """Orders with their lines as an array of structs."""
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.struct(F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part_id")).alias("s"))
    return l.groupBy("id").agg(F.array_sort(F.collect_list("s")).alias("lines"))


ORDER_CUSTOMER = ent.Reference("orders", "customer_id", "customer")
LINE_PART = ent.Reference("lines", "lines", "part", array=True, sub_field="part_id")
LINE_PART_KEEP = ent.Reference("lines", "lines", "part", array=True, sub_field="part_id", keep_both=True)
_LINES = "lines AS (SELECT l_orderkey AS id, list({'line': l_linenumber, 'part_id': l_partkey} ORDER BY l_linenumber, l_partkey) AS lines FROM lineitem GROUP BY 1)"


@register("SELECT CAST(o_custkey AS VARCHAR) AS target_id, 'orders' AS source_type, 'customer_id' AS field, CAST(o_orderkey AS VARCHAR) AS id FROM orders UNION SELECT CAST(l_partkey AS VARCHAR), 'lines', 'lines', CAST(l_orderkey AS VARCHAR) FROM lineitem")
def find_refs(spark, d):
    """Who refers to each customer and each part."""
    c = _customers(spark, d).select(F.lit("customer").alias("target_type"), F.col("id").alias("target_id"))
    p = table(spark, d, "part").select(F.lit("part").alias("target_type"), F.col("p_partkey").alias("target_id"))
    return ent.find_references({"orders": _orders(spark, d), "lines": _lines(spark, d)}, [ORDER_CUSTOMER, LINE_PART], c.unionByName(p))


def _merges(df, key):
    """Every record whose key leaves 3 modulo 10 is merged into the one before; a chain leads on to the one before that."""
    a = df.where(F.col(key) % 10 == 3).select(F.col(key).alias("source"), (F.col(key) - 1).alias("target"))
    b = df.where(F.col(key) % 10 == 2).select(F.col(key).alias("source"), (F.col(key) - 1).alias("target"))
    return ent.resolve_merges(a.unionByName(b))


_MOVE = "CASE WHEN {c} % 10 = 3 THEN {c} - 2 WHEN {c} % 10 = 2 THEN {c} - 1 ELSE {c} END"


@register(f"SELECT o_orderkey AS id, {_MOVE.format(c='o_custkey')} AS customer_id FROM orders")
def merge_relink_scalar(spark, d):
    return ent.relink(_orders(spark, d), ORDER_CUSTOMER, _merges(_customers(spark, d), "id")).select("id", "customer_id")


_HELD = "list_transform(lines, lambda s: s.part_id)"


@register(f"WITH {_LINES} SELECT id, list_aggregate(list_transform(list_filter(lines, lambda s: NOT (s.part_id % 10 IN (2, 3) AND list_contains({_HELD}, {_MOVE.format(c='s.part_id')}))), lambda s: concat(s.line, ':', {_MOVE.format(c='s.part_id')})), 'string_agg', ',') AS parts FROM lines")
def merge_relink_array_drop(spark, d):
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("id"))
    out = ent.relink(_lines(spark, d), LINE_PART, _merges(parts, "id"))
    return out.select("id", F.concat_ws(",", F.transform("lines", lambda s: F.concat_ws(":", s["line"], s["part_id"]))).alias("parts"))


@register(f"WITH {_LINES} SELECT id, list_aggregate(list_transform(lines, lambda s: concat(s.line, ':', {_MOVE.format(c='s.part_id')})), 'string_agg', ',') AS parts FROM lines")
def merge_relink_array_keep(spark, d):
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("id"))
    out = ent.relink(_lines(spark, d), LINE_PART_KEEP, _merges(parts, "id"))
    return out.select("id", F.concat_ws(",", F.transform("lines", lambda s: F.concat_ws(":", s["line"], s["part_id"]))).alias("parts"))


@register("SELECT CAST(c_custkey AS VARCHAR) AS id, count(*) AS refs FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal < 0 GROUP BY 1")
def delete_guard(spark, d):
    """Customers to be deleted (negative balance) that orders still refer to."""
    c = _customers(spark, d).select(F.col("id").cast("string").alias("id"), "balance")
    refs = ent.reference_ids(_orders(spark, d), ORDER_CUSTOMER).withColumnRenamed("id", "source_id")
    return ent.guarded_delete(c, c.where("balance < 0").select("id"), refs)[1].select("id", F.col("references").alias("refs"))


@register("SELECT qid AS target_id, count(*) AS n FROM (SELECT lower(trim(target_id)) AS t FROM entity_refs WHERE lower(trim(target_type)) = 'entity') JOIN kb_candidates ON lower(qid) = t GROUP BY qid")
def reference_counts(spark, d):
    r = table(spark, d, "entity_refs").where("lower(trim(target_type)) = 'entity'").select(F.lower(F.trim("target_id")).alias("t"))
    return r.join(table(spark, d, "kb_candidates").select("qid", F.lower("qid").alias("t")), "t").groupBy(F.col("qid").alias("target_id")).agg(F.count("*").alias("n"))


_VETO = """c AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, c_nationkey AS nation, coalesce(n, 0) AS ref_count FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey),
p AS (SELECT a.id AS id_a, b.id AS id_b, a.segment AS sa, b.segment AS sb, a.nation AS na, b.nation AS nb, a.ref_count AS ra, b.ref_count AS rb FROM c a JOIN c b ON b.id = a.id + 1)"""


@register(f"""WITH {_VETO} SELECT id_a, id_b, coalesce(
CASE WHEN id_a % 97 = 0 THEN 'excluded' END,
CASE WHEN sa <> sb THEN concat('exact_field: segment: ', sa, ' vs ', sb) END,
CASE WHEN na <> nb THEN concat('no_conflict: nation: ', na, ' vs ', nb) END,
CASE WHEN NOT ((greatest(ra, rb) >= 3 AND least(ra, rb) <= 1) OR (least(ra, rb) > 0 AND greatest(ra, rb) / least(ra, rb) >= 3.0)) THEN concat('reference_ratio: references ', greatest(ra, rb), ' vs ', least(ra, rb)) END,
'passed all gates') AS reason FROM p""")
def veto_gates(spark, d):
    """Neighbouring customers as candidate pairs; every 97th pair is on the exclusion list."""
    n = _orders(spark, d).groupBy(F.col("customer_id").alias("id")).agg(F.count("*").alias("ref_count"))
    c = _customers(spark, d).join(n, "id", "left").withColumn("ref_count", F.coalesce("ref_count", F.lit(0)))
    side = F.struct("name", "segment", "nation", "ref_count")
    a = c.select(F.col("id").alias("id_a"), side.alias("a"))
    b = c.select((F.col("id") - 1).alias("id_a"), F.col("id").alias("id_b"), side.alias("b"))
    pairs = a.join(b, "id_a")
    excluded = pairs.where("id_a % 97 = 0").select(F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b"))
    gates = [ent.exact_field("segment"), ent.no_conflict("nation"), ent.initial_match("name"), ent.reference_ratio()]
    return ent.veto(pairs, gates, excluded).select("id_a", "id_b", "reason")


@register("SELECT kind, CASE WHEN accepted IS NULL THEN 'not judged' WHEN accepted THEN 'accepted' ELSE reason END AS verdict, count(*) AS n FROM match_pairs GROUP BY 1, 2")
def veto_outcomes(spark, d):
    v = F.when(F.col("accepted").isNull(), "not judged").when(F.col("accepted"), "accepted").otherwise(F.col("reason"))
    return table(spark, d, "match_pairs").groupBy("kind", v.alias("verdict")).agg(F.count("*").alias("n"))


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE"]
_RULES = {
    "valid_segment": ("error", "customer", "SELECT CAST(c_custkey AS VARCHAR) AS id, concat('segment=', c_mktsegment, ' not in AUTOMOBILE, BUILDING, FURNITURE') AS message FROM customer WHERE c_mktsegment <> '' AND c_mktsegment NOT IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE')"),
    "required_lang": ("error", "document", "SELECT CAST(doc_id AS VARCHAR), 'missing lang' FROM documents WHERE lang IS NULL OR lang = ''"),
    "conditional_collection": ("warning", "document", "SELECT CAST(doc_id AS VARCHAR), 'missing collection' FROM documents WHERE lang = 'en' AND (collection IS NULL OR collection = '')"),
    "reference_doc_path": ("error", "chunk", "SELECT CAST(id AS VARCHAR), concat('doc_path -> unknown ', doc_path) FROM chunks WHERE doc_path <> '' AND doc_path NOT IN (SELECT path FROM documents)"),
    "orphan_customer": ("warning", "customer", "SELECT CAST(c_custkey AS VARCHAR), 'never referenced' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"),
}
_VIOLATIONS = " UNION ALL ".join(f"SELECT '{n}' AS rule, '{s}' AS severity, '{e}' AS entity_type, id, message FROM ({q}) t(id, message)" for n, (s, e, q) in _RULES.items())


def _violations(spark, d):
    data = {
        "customer": _customers(spark, d),
        "orders": _orders(spark, d),
        "document": table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang", "collection"),
        "path": table(spark, d, "documents").select(F.col("path").alias("id")),
        "chunk": table(spark, d, "chunks").select("id", "doc_path"),
    }
    rules = [
        ent.valid_values("customer", "segment", SEGMENTS), ent.required_field("document", "lang"),
        ent.conditional_required("document", "collection", F.col("lang") == "en", "warning"),
        ent.reference_exists(ent.Reference("chunk", "doc_path", "path")), ent.no_orphans("customer", [ORDER_CUSTOMER]),
    ]
    return ent.validate(data, rules)


@register(_VIOLATIONS)
def validate_all(spark, d):
    return _violations(spark, d)


@register(f"SELECT count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warning') AS warnings, count(*) FILTER (WHERE severity = 'error') = 0 AS ok FROM ({_VIOLATIONS})")
def validation_summary(spark, d):
    return ent.validation_summary(_violations(spark, d))


@register("SELECT c_custkey AS id, concat(CASE WHEN lower(c_mktsegment) IS DISTINCT FROM c_mktsegment THEN concat('segment:', c_mktsegment, '>', lower(c_mktsegment), ';') ELSE '' END, CASE WHEN c_acctbal < 0 THEN 'flag:>negative;' ELSE '' END) AS changes FROM customer WHERE lower(c_mktsegment) IS DISTINCT FROM c_mktsegment OR c_acctbal < 0")
def proposal_diff(spark, d):
    c = _customers(spark, d).select("id", "segment", "balance", F.lit("").alias("flag"))
    new = c.select("id", F.lower("segment").alias("segment"), F.when(F.col("balance") < 0, "negative").otherwise("").alias("flag"))
    out = ent.modify_proposals(c, new, ["segment", "flag"])
    return out.select("id", F.concat_ws("", F.transform("changes", lambda s: F.concat(s["field"], F.lit(":"), s["old"], F.lit(">"), s["new"], F.lit(";")))).alias("changes"))


_LOG = "log AS (SELECT user_id AS proposal_id, event_id AS seq, ['pending', 'approved', 'applied', 'rejected'][CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INTEGER) % 4 + 1] AS status FROM events)"


@register(f"WITH {_LOG}, s AS (SELECT *, concat(coalesce(lag(status) OVER (PARTITION BY proposal_id ORDER BY seq), ''), '>', status) AS step FROM log) SELECT proposal_id, arg_max(status, seq) AS status, bool_and(step IN ('>pending', 'pending>approved', 'pending>rejected', 'approved>applied')) AS legal FROM s GROUP BY proposal_id")
def proposal_status(spark, d):
    from pyspark.sql.window import Window

    n = (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1) % 4
    log = table(spark, d, "events").select(F.col("user_id").alias("proposal_id"), F.col("event_id").alias("seq"), F.element_at(F.array(*[F.lit(s) for s in ("pending", "approved", "applied", "rejected")]), n + 1).alias("status"))
    return ent.proposal_status(log)


_STATE = "state AS (SELECT item_id, arg_max(lower(trim(status)), (ts, seq)) AS status, arg_max(coalesce(cost, 0), (ts, seq)) AS cost, max(seq) AS seq FROM items GROUP BY item_id)"


def _state(spark, d):
    i = table(spark, d, "items").select("item_id", "ts", "seq", F.lower(F.trim("status")).alias("status"), F.coalesce("cost", F.lit(0.0)).alias("cost"))
    return ops.latest(i, "item_id", "ts", "seq")


@register(f"WITH {_STATE} SELECT status, count(*) AS n FROM state GROUP BY status")
def status_counts(spark, d):
    return ops.status_counts(_state(spark, d))


@register(f"WITH {_STATE} SELECT i.seq, i.item_id FROM items i JOIN state s USING (item_id) WHERE s.status NOT IN ('done', 'verified', 'applied', 'skipped')")
def pending_items(spark, d):
    return ops.pending_items(table(spark, d, "items").select("seq", "item_id"), _state(spark, d))


@register("WITH r AS (SELECT seq, item_id, coalesce(cost, 0) AS cost, round(sum(coalesce(cost, 0)) OVER (ORDER BY seq), 6) AS total FROM items) SELECT seq, item_id, cost, total FROM r WHERE total <= 5.0")
def budget_prefix(spark, d):
    return ops.budget_prefix(table(spark, d, "items"), 5.0)


@register("SELECT coalesce(CAST(run_id AS VARCHAR), 'hand') AS tier, lower(trim(status)) AS status, count(*) AS n FROM items GROUP BY 1, 2")
def tier_status(spark, d):
    return ops.tier_report(table(spark, d, "items").select(F.coalesce(F.col("run_id").cast("string"), F.lit("hand")).alias("tier"), F.lower(F.trim("status")).alias("status")))


@register(f"WITH {_STATE} SELECT item_id, 'pending' AS status, 0.0 AS cost FROM state WHERE status = 'needs_review'")
def escalated_items(spark, d):
    return ops.escalated(_state(spark, d).withColumn("tier", F.lit("1")), "1").select("item_id", "status", "cost")


_AUDIT = "log AS (SELECT event_id AS seq, ts, CAST(user_id AS VARCHAR) AS item_id, event_type AS action, coalesce(value, 0) AS cost, CASE event_id % 4 WHEN 0 THEN '' ELSE concat('tier', event_id % 4) END AS tier, event_type = 'error' OR value > 90 AS failed FROM events)"


def _audit(spark, d):
    e = table(spark, d, "events")
    tier = F.when(F.col("event_id") % 4 == 0, "").otherwise(F.concat(F.lit("tier"), (F.col("event_id") % 4).cast("string")))
    return e.select(F.col("event_id").alias("seq"), "ts", F.col("user_id").cast("string").alias("item_id"), F.col("event_type").alias("action"), F.coalesce("value", F.lit(0.0)).alias("cost"), tier.alias("tier"), ((F.col("event_type") == "error") | (F.col("value") > 90)).alias("failed"))


@register(f"WITH {_AUDIT}, l AS (SELECT coalesce(action, '') AS action, coalesce(nullif(tier, ''), 'unknown') AS tier, item_id, cost, failed FROM log) SELECT action, tier, count(*) AS n, round(sum(cost), 4) AS cost, count(DISTINCT item_id) AS items, count(*) FILTER (WHERE failed) AS errors FROM l GROUP BY GROUPING SETS ((), (action), (tier))")
def audit_summary(spark, d):
    return ops.audit_summary(_audit(spark, d))


@register(f"WITH {_AUDIT} SELECT item_id AS key, arg_max(action, (ts, seq)) AS type, max(ts) AS ts, arg_max(seq, (ts, seq)) AS seq, min(seq) AS first_seq FROM log WHERE action IN ('click', 'purchase', 'view', 'signup') GROUP BY item_id")
def audit_ops_latest(spark, d):
    log = _audit(spark, d).select(F.col("item_id").alias("key"), F.col("action").alias("type"), "ts", "seq")
    return ops.latest_operations(log, ["click", "purchase", "view", "signup"])


@register("SELECT seq, item_id FROM items WHERE ts >= TIMESTAMP '2025-01-15 00:00:00'")
def audit_since(spark, d):
    return table(spark, d, "items").where("ts >= TIMESTAMP_NTZ '2025-01-15 00:00:00'").select("seq", "item_id")


_COSTS = "costs AS (SELECT event_id AS id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts, concat('project', user_id % 5) AS project, concat('host', user_id % 3) AS host, CASE event_id % 4 WHEN 0 THEN 'gemini-2.5-flash' WHEN 1 THEN 'gemini/gemini-2.0-flash' WHEN 2 THEN 'gemini-2.5-pro' ELSE 'other' END AS model, event_id % 1000 AS prompt_tokens, event_id % 300 AS completion_tokens, event_id % 70 AS cached_tokens, round(coalesce(value, 0) / 1000, 6) AS cost_usd FROM events)"


def _costs(spark, d):
    m = F.col("event_id") % 4
    return table(spark, d, "events").select(
        F.col("event_id").alias("id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), F.concat(F.lit("project"), F.col("user_id") % 5).alias("project"), F.concat(F.lit("host"), F.col("user_id") % 3).alias("host"),
        F.when(m == 0, "gemini-2.5-flash").when(m == 1, "gemini/gemini-2.0-flash").when(m == 2, "gemini-2.5-pro").otherwise("other").alias("model"), (F.col("event_id") % 70).alias("cached_tokens"),
        (F.col("event_id") % 1000).alias("prompt_tokens"), (F.col("event_id") % 300).alias("completion_tokens"), F.round(F.coalesce("value", F.lit(0.0)) / 1000, 6).alias("cost_usd"),
    )


@register(f"WITH {_COSTS} SELECT project, model, host, count(*) AS calls, sum(prompt_tokens) AS prompt_tokens, sum(completion_tokens) AS completion_tokens, sum(cached_tokens) AS cached_tokens, round(sum(cost_usd), 4) AS cost_usd, min(ts) AS first_ts, max(ts) AS last_ts FROM costs GROUP BY GROUPING SETS ((project), (model), (host))")
def cost_summary_sets(spark, d):
    return ops.cost_summary(_costs(spark, d), "project", "model", "host")


@register(f"WITH {_COSTS} SELECT round(coalesce(sum(cost_usd), 0), 4) AS cost_usd FROM costs")
def cost_total(spark, d):
    return _costs(spark, d).agg(F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 4).alias("cost_usd"))


@register(f"WITH {_COSTS} SELECT substr(ts, 1, 10) AS day, project, round(sum(cost_usd), 6) AS cost_usd FROM costs GROUP BY 1, 2")
def cost_daily(spark, d):
    return ops.cost_daily(_costs(spark, d)).select(F.col("day").cast("string").alias("day"), "project", "cost_usd")


@register(f"WITH {_COSTS} SELECT id, ts, project, model FROM costs WHERE project = 'project1' AND model ILIKE '%2.0-FLASH%'")
def cost_filter_like(spark, d):
    return ops.cost_filter(_costs(spark, d), project="project1", model_like="2.0-FLASH").select("id", "ts", "project", "model")


@register(f"WITH {_COSTS}, l AS (SELECT id, project FROM costs WHERE id % 3 <> 0) SELECT id, project FROM l UNION ALL SELECT id, 'remote' FROM costs WHERE id % 2 = 0 AND id NOT IN (SELECT id FROM l)")
def cost_merge_ignore(spark, d):
    c = _costs(spark, d).select("id", "project")
    return ops.merge_ignoring(c.where("id % 3 <> 0"), c.where("id % 2 = 0").withColumn("project", F.lit("remote")))


@register(f"WITH {_COSTS} SELECT id, round(CASE model WHEN 'gemini-2.5-flash' THEN (prompt_tokens * 0.3 + completion_tokens * 2.5) / 1e6 WHEN 'gemini/gemini-2.0-flash' THEN (prompt_tokens * 0.1 + completion_tokens * 0.4) / 1e6 WHEN 'gemini-2.5-pro' THEN (prompt_tokens * 1.25 + completion_tokens * 10.0) / 1e6 END, 9) AS computed FROM costs")
def cost_compute(spark, d):
    return ops.cost_of(_costs(spark, d)).select("id", "computed")


@register("WITH t AS (SELECT sha256(text) AS h FROM documents WHERE text IS NOT NULL), c AS (SELECT text_hash FROM embedding_cache WHERE model_name = 'mini-64') SELECT count(*) AS asked, count(*) FILTER (WHERE h IN (SELECT text_hash FROM c)) AS hits, count(DISTINCT h) FILTER (WHERE h NOT IN (SELECT text_hash FROM c)) AS missing FROM t")
def cache_hits_misses(spark, d):
    t = table(spark, d, "documents").select("text")
    hits, misses = ops.cache_split(t, table(spark, d, "embedding_cache"), "mini-64")
    asked = t.agg(F.count("text").alias("asked"))
    return asked.join(hits.agg(F.count("*").alias("hits"))).join(misses.agg(F.count("*").alias("missing")))


@register(f"SELECT model_name AS source, count(*) AS entries, count(*) FILTER (WHERE {NOW} - created_at <= 1000000) AS fresh FROM embedding_cache GROUP BY 1")
def payload_fresh_stats(spark, d):
    c = table(spark, d, "embedding_cache")
    return c.groupBy(F.col("model_name").alias("source")).agg(F.count("*").alias("entries"), F.count_if(ops.fresh(F.col("created_at"), F.lit(1_000_000), NOW)).alias("fresh"))


@register("SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(DISTINCT collection) FROM documents) AS collections, count(*) AS chunks, count(embedding) AS embedded FROM chunks")
def index_stats(spark, d):
    return ops.index_stats(table(spark, d, "documents"), table(spark, d, "chunks"))


@register("SELECT path FROM documents WHERE doc_id % 3 = 0")
def reindex_needed(spark, d):
    """A later listing in which every third file has changed."""
    docs = table(spark, d, "documents").select("doc_id", "path", "mtime")
    return ops.stale_documents(docs, docs.select("path", (F.col("mtime") + F.when(F.col("doc_id") % 3 == 0, 5.0).otherwise(0.0)).alias("mtime")))


@register("WITH o AS (SELECT o_custkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS ord, concat('order ', o_orderkey, ' ', o_orderstatus) AS line FROM orders), l AS (SELECT id, string_agg(concat('- ', line), chr(10) ORDER BY ord) AS lines FROM o GROUP BY id) SELECT c_custkey AS id, concat_ws(chr(10), concat('## ', c_name), concat('**segment**: ', c_mktsegment), lines) AS context FROM customer LEFT JOIN l ON l.id = c_custkey")
def context_markdown(spark, d):
    lines = _orders(spark, d).select(F.col("customer_id").alias("id"), F.col("id").alias("ord"), F.concat_ws(" ", F.lit("order"), F.col("id"), "status").alias("line"))
    return ops.context_markdown(_customers(spark, d), lines, "name", ["segment"])


_PAIR = "SELECT o_orderkey AS id, o_orderstatus AS a, CASE WHEN o_orderpriority < '2' THEN 'F' WHEN o_orderpriority < '4' THEN 'O' ELSE 'P' END AS b FROM orders"


def _labels(spark, d):
    b = F.when(F.col("priority") < "2", "F").when(F.col("priority") < "4", "O").otherwise("P")
    return _orders(spark, d).select("id", F.col("status").alias("label_a"), b.alias("label_b"))


_KAPPA = f"c AS (SELECT a, b, count(*) AS n FROM ({_PAIR}) GROUP BY 1, 2), t AS (SELECT sum(n) AS n, sum(CASE WHEN a = b THEN n ELSE 0 END) AS same FROM c), x AS (SELECT a AS l, sum(n) AS x FROM c GROUP BY 1), y AS (SELECT b AS l, sum(n) AS y FROM c GROUP BY 1), k AS (SELECT t.n, same / t.n AS po, coalesce((SELECT sum(x * y) FROM x JOIN y USING (l)), 0) / (t.n * t.n) AS pe FROM t), r AS (SELECT CAST(n AS BIGINT) AS n, round(po, 6) AS agreement, round(CASE WHEN pe = 1 THEN 0 ELSE (po - pe) / (1 - pe) END, 6) AS kappa FROM k)"


@register(f"WITH {_KAPPA} SELECT * FROM r")
def kappa(spark, d):
    return metrics.kappa(_labels(spark, d))


@register(f"WITH {_KAPPA} SELECT *, CASE WHEN kappa > 0.7 THEN 'trustworthy' WHEN kappa >= 0.5 THEN 'moderate' ELSE 'unreliable' END AS recommendation FROM r")
def judge_validation(spark, d):
    return metrics.judge(_labels(spark, d))


@register(f"WITH {_KAPPA} SELECT r.*, CASE WHEN kappa > 0.8 THEN 'excellent' WHEN kappa >= 0.6 THEN 'acceptable' ELSE 'concerning' END AS quality, w.* FROM r, (SELECT count(*) AS disagreements, min(id) AS first_disagreement FROM ({_PAIR}) WHERE a <> b) w")
def intra_rater(spark, d):
    return metrics.intra_rater(_labels(spark, d), "id")


@register(f"WITH p AS ({_PAIR}), l AS (SELECT a AS label FROM p UNION SELECT b FROM p), g AS (SELECT label, count(*) FILTER (WHERE a = label AND b = label) AS tp, count(*) FILTER (WHERE a = label) AS support, count(*) FILTER (WHERE b = label) AS said FROM l, p GROUP BY label), m AS (SELECT label, CASE WHEN said > 0 THEN tp / said ELSE 0 END AS p, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS r, support FROM g) SELECT label, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1, support FROM m")
def per_label_prf(spark, d):
    return metrics.per_label(_labels(spark, d))


@register(f"SELECT a, b, count(*) AS n FROM ({_PAIR}) GROUP BY CUBE (a, b)")
def confusion_cube(spark, d):
    return _labels(spark, d).select(F.col("label_a").alias("a"), F.col("label_b").alias("b")).cube("a", "b").agg(F.count("*").alias("n"))


_SCORED = "s AS (SELECT source, CAST(n_chars AS DOUBLE) AS score, lang = 'en' AS truth FROM documents WHERE n_chars IS NOT NULL AND lang IS NOT NULL)"


def _scored(spark, d):
    return table(spark, d, "documents").select("source", F.col("n_chars").cast("double").alias("score"), (F.col("lang") == "en").alias("truth"))


@register(f"WITH {_SCORED}, v AS (SELECT source, score, count(*) AS n, count(*) FILTER (WHERE truth) AS p FROM s GROUP BY 1, 2), r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY source ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM v), g AS (SELECT source, sum(p * (below + (n + 1) / 2)) AS ranks, CAST(sum(p) AS DOUBLE) AS pos, CAST(sum(n - p) AS DOUBLE) AS neg FROM r GROUP BY source) SELECT source, round(CASE WHEN pos > 0 AND neg > 0 THEN (ranks - pos * (pos + 1) / 2) / (pos * neg) END, 6) AS auc FROM g")
def auc_by_source(spark, d):
    return metrics.auc(_scored(spark, d), "source")


@register(f"WITH {_SCORED}, m AS (SELECT min(score) AS lo, max(score) AS hi FROM s), b AS (SELECT floor((score - lo) / (hi - lo) * 199 + 1e-9) AS step, lo, hi, count(*) AS n, count(*) FILTER (WHERE truth) AS p FROM s, m GROUP BY 1, 2, 3), r AS (SELECT lo, hi, step, CAST(sum(n) OVER (ORDER BY step DESC) AS DOUBLE) AS said, CAST(sum(p) OVER (ORDER BY step DESC) AS DOUBLE) AS tp, CAST(sum(p) OVER () AS DOUBLE) AS pos FROM b) SELECT round(lo + (hi - lo) * step / 199, 6) AS threshold, round(tp / said, 6) AS precision, round(tp / pos, 6) AS recall, round(CASE WHEN tp > 0 THEN 2 * (tp / said) * (tp / pos) / (tp / said + tp / pos) ELSE 0 END, 6) AS f1 FROM r ORDER BY f1 DESC, threshold LIMIT 1")
def best_f1(spark, d):
    return metrics.best_f1(_scored(spark, d))


_RANK = "SELECT {c}, coalesce(sum(k) OVER (ORDER BY {c} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (k + 1) / 2 AS r{c} FROM (SELECT {c}, count(*) AS k FROM p GROUP BY 1)"


@register(f"WITH p AS (SELECT CAST(n_chars AS DOUBLE) AS x, CAST(length(regexp_replace(text, '[ \\t\\n\\x0b\\f\\r]', '', 'g')) AS DOUBLE) AS y FROM documents WHERE text IS NOT NULL AND n_chars IS NOT NULL), a AS ({_RANK.format(c='x')}), b AS ({_RANK.format(c='y')}) SELECT count(*) AS n, round(corr(p.x, p.y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman, round(avg(abs(p.x - p.y)), 6) AS mae FROM p JOIN a USING (x) JOIN b ON b.y = p.y")
def corr_metrics(spark, d):
    t = table(spark, d, "documents").select(F.col("n_chars").alias("x"), F.length(F.regexp_replace("text", "[ \\t\\n\\x0b\\f\\r]", "")).alias("y"))
    return metrics.correlations(t, "x", "y")


_V = "c AS (SELECT lang AS t, source AS c, CAST(count(*) AS DOUBLE) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1, 2), g AS (SELECT c.*, sum(n) OVER () AS N1, sum(n) OVER (PARTITION BY t) AS nt, sum(n) OVER (PARTITION BY c) AS nc FROM c), e AS (SELECT sum(-n / N1 * ln(n / nc)) AS htc, sum(-n / N1 * ln(n / nt)) AS hct, sum(-n / N1 * ln(nt / N1)) AS ht, sum(-n / N1 * ln(nc / N1)) AS hc FROM g), m AS (SELECT CASE WHEN ht > 1e-12 THEN 1 - htc / ht ELSE 1 END AS h, CASE WHEN hc > 1e-12 THEN 1 - hct / hc ELSE 1 END AS k FROM e)"


@register(f"WITH {_V} SELECT round(h, 6) AS homogeneity, round(k, 6) AS completeness, round(CASE WHEN h + k > 0 THEN 2 * h * k / (h + k) ELSE 0 END, 6) AS v FROM m")
def v_measure(spark, d):
    return metrics.v_measure(table(spark, d, "documents").where("lang IS NOT NULL"), "lang", "source")


_NAMES = "names AS (SELECT DISTINCT qid, lower(trim(name)) AS name FROM (SELECT qid, unnest(list_concat([label], coalesce(aliases, []))) AS name FROM kb_candidates) WHERE name <> ''), one AS (SELECT name, min(qid) AS qid FROM names GROUP BY name HAVING count(*) = 1)"


@register(f"WITH {_NAMES} SELECT res_id, qid FROM resolutions JOIN one ON one.name = lower(trim(mention))")
def resolver_known(spark, d):
    """Mentions that equal one entity's label or alias; the others go on to scoring."""
    return res.known_first(table(spark, d, "resolutions").select("res_id", "mention"), table(spark, d, "kb_candidates"))[0]


_CAND = f"{_NAMES}, parts AS (SELECT DISTINCT qid, unnest(string_split(name, ' ')) AS part FROM names), asked AS (SELECT DISTINCT res_id, lower(type_hint) AS hint, unnest(string_split(lower(trim(mention)), ' ')) AS part FROM resolutions WHERE mention IS NOT NULL), cand AS (SELECT DISTINCT a.res_id, a.hint, p.qid FROM asked a JOIN parts p USING (part)), anchor AS (SELECT DISTINCT lower(trim(target_id)) AS q FROM entity_refs WHERE lower(trim(target_type)) = 'entity'), scored AS (SELECT c.res_id, c.qid, round(0.25 * CASE WHEN c.hint IS NULL OR c.hint = '' THEN 0.5 WHEN c.hint = k.type_hint THEN 1 ELSE 0.3 END + 0.15 + 0.2 * 0.5 + 0.3 * CASE WHEN a.q IS NULL THEN 0.3 ELSE 1 END + 0.1 * exp(-k.rank / 10.0), 6) AS total FROM cand c JOIN kb_candidates k USING (qid) LEFT JOIN anchor a ON a.q = lower(c.qid))"


def _candidates(spark, d):
    """Scored candidates: all entities that share a name part with the mention; anchors are the entities referred to elsewhere."""
    k = table(spark, d, "kb_candidates")
    names = k.select("qid", F.explode(F.concat(F.array("label"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name")).where("name <> ''")
    parts = names.select("qid", F.explode(F.split(F.lower(F.trim("name")), " ")).alias("part")).distinct()
    asked = table(spark, d, "resolutions").where("mention IS NOT NULL").select("res_id", F.lower("type_hint").alias("hint"), F.explode(F.split(F.lower(F.trim("mention")), " ")).alias("part")).distinct()
    cand = asked.join(parts, "part").select("res_id", "hint", "qid").distinct()
    anchors = table(spark, d, "entity_refs").where("lower(trim(target_type)) = 'entity'").select(F.lower(F.trim("target_id")).alias("q")).distinct()
    both = cand.join(k.select("qid", "type_hint", "rank"), "qid").join(anchors, F.lower("qid") == F.col("q"), "left")
    scores = {
        "type": res.type_score(F.col("hint"), F.col("type_hint")), "date": F.lit(1.0), "description": res.description_score(F.lit(None).cast("double")),
        "coherence": F.when(F.col("q").isNull(), 0.3).otherwise(1.0), "rank": res.rank_score(F.col("rank")),
    }
    return both.select("res_id", "qid", F.round(res.total(scores), 6).alias("total"))


@register(f"WITH {_CAND} SELECT res_id, qid, total FROM scored")
def resolver_scores(spark, d):
    return _candidates(spark, d)


@register(f"WITH {_CAND}, r AS (SELECT *, row_number() OVER (PARTITION BY res_id ORDER BY total DESC, qid) AS r FROM scored), b AS (SELECT res_id, max(total) FILTER (WHERE r = 1) AS t, max(qid) FILTER (WHERE r = 1) AS q, coalesce(max(total) FILTER (WHERE r = 2), 0) AS s FROM r WHERE r <= 2 GROUP BY res_id) SELECT res_id, CASE WHEN t >= 0.55 AND (s = 0 OR t >= 1.25 * s) THEN 'resolved' ELSE 'ambiguous' END AS status, CASE WHEN t >= 0.55 AND (s = 0 OR t >= 1.25 * s) THEN q END AS qid, round(t, 6) AS score FROM b")
def resolver_decision(spark, d):
    return res.decide(_candidates(spark, d), "res_id")
