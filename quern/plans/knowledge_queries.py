"""Temporal and knowledge-map queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import temporal
from quern.operators import hierarchy, knowledge
from quern.session import cut, table

from .data import _EDGES
from .registry import register

# Written dates and the intervals that they stand for are tested separately.
DATES = ["940s", "10th century", "4th century BC", "c. 1450", "1890-1910", "44 BC", "AD 79", "1987", "the 19th century", "1984~", "2004-06-01", "196x", "someday", "", "21st century CE"]
_SQL_DATES = "dates(text) AS (VALUES " + ", ".join(f"('{d}')" for d in DATES) + ")"
_T = "lower(trim(text))"


def _case(*branches: tuple[str, str, str, str]) -> str:
    return " ".join(f"WHEN regexp_full_match({_T}, '{p}') THEN {{'s': {a}, 'e': {b}, 'q': {q}}}" for p, a, b, q in branches)


def _n(p: str, g: int = 1) -> str:
    return f"CAST(nullif(regexp_extract({_T}, '{p}', {g}), '') AS INTEGER)"


_CB, _C = "(?:the )?(\\d{1,2})(?:st|nd|rd|th) century (?:bc|bce)", "(?:the )?(\\d{1,2})(?:st|nd|rd|th) century(?: (?:ad|ce))?"
_D, _CI, _S = "(?:the )?(\\d{1,3}0)s", "(?:c\\.|ca\\.|circa|about|approx\\.?)\\s*(\\d{1,4})", "(\\d{1,4})\\s*[-–—/]\\s*(\\d{1,4})"
_BC, _AD, _E, _EP, _X = "(\\d{1,4})\\s*(?:bc|bce)", "(?:ad\\s*)?(\\d{1,4})(?:\\s*(?:ad|ce))?", "(\\d{4})[~?%]", "(\\d{4})-\\d{2}(?:-\\d{2})?", "(\\d{3})x"
_PARSED = "CASE " + _case(
    (_CB, f"-100 * {_n(_CB)}", f"-(100 * ({_n(_CB)} - 1) + 1)", "false"), (_C, f"100 * ({_n(_C)} - 1) + 1", f"100 * {_n(_C)}", "false"), (_D, _n(_D), f"{_n(_D)} + 9", "false"),
    (_CI, _n(_CI), _n(_CI), "true"), (_S, _n(_S), _n(_S, 2), "false"), (_BC, f"-{_n(_BC)}", f"-{_n(_BC)}", "false"), (_AD, _n(_AD), _n(_AD), "false"),
    (_E, _n(_E), _n(_E), "true"), (_EP, _n(_EP), _n(_EP), "false"), (_X, f"{_n(_X)} * 10", f"{_n(_X)} * 10 + 9", "false"),
) + " END"


@register(f"WITH {_SQL_DATES}, p AS (SELECT text, {_PARSED} AS r FROM dates) SELECT text, r.s AS start_year, r.e AS end_year, r.q AS approximate FROM p")
def parse_dates(spark, d):
    t = spark.createDataFrame([(x,) for x in DATES], "text string").withColumn("r", temporal.parse_date(F.col("text")))
    return t.select("text", F.col("r.start").alias("start_year"), F.col("r.end").alias("end_year"), F.col("r.approximate").alias("approximate"))


_SPANS = "s AS (SELECT source AS k, CAST(min(year(added_at)) * 12 + min(month(added_at)) AS INTEGER) AS a, CAST(min(year(added_at)) * 12 + min(month(added_at)) + count(*) % 9 AS INTEGER) AS b FROM documents GROUP BY source)"


def _spans(spark, d):
    """An interval a source, in months, for interval relations between all sources (a fixed, small set)."""
    start = F.min(F.year("added_at")) * 12 + F.min(F.month("added_at"))
    return table(spark, d, "documents").groupBy(F.col("source").alias("k")).agg(F.struct(start.alias("start"), (start + F.count("*") % 9).cast("int").alias("end")).alias("r"))


def _relations(spark, d):
    s = _spans(spark, d)
    a, b = s.select(F.col("k").alias("x"), F.col("r").alias("p")), s.select(F.col("k").alias("y"), F.col("r").alias("q"))
    return a.join(b, F.col("x") < F.col("y"))


@register(f"WITH {_SPANS} SELECT x.k AS x, y.k AS y, x.b < y.a AS before, x.a > y.b AS after, x.a >= y.a AND x.b <= y.b AS during, x.a <= y.b AND y.a <= x.b AS overlaps, x.b + 1 = y.a AS meets, x.a = y.a AND x.b = y.b AS equals FROM s x JOIN s y ON x.k < y.k")
def allen_relations(spark, d):
    p, q = F.col("p"), F.col("q")
    return _relations(spark, d).select("x", "y", *[getattr(temporal, n)(p, q).alias(n) for n in ("before", "after", "during", "overlaps", "meets", "equals")])


@register(f"WITH {_SPANS} SELECT x.k AS x, y.k AS y, round(CASE WHEN x.a <= y.b AND y.a <= x.b THEN 1 ELSE exp(-(CASE WHEN x.b < y.a THEN y.a - x.b ELSE x.a - y.b END) / 12.0) END, 6) AS score FROM s x JOIN s y ON x.k < y.k")
def plausibility(spark, d):
    return _relations(spark, d).select("x", "y", F.round(temporal.plausibility(F.col("p"), F.col("q"), 12.0), 6).alias("score"))


def _nodes(spark, d):
    latest = hierarchy.latest_nodes(table(spark, d, "knowledge_nodes"))
    full = table(spark, d, "knowledge_nodes").select(F.lower(F.trim("graph_id")).alias("g"), F.lower(F.trim("id")).alias("n"), "title", "description", "level", "obscurity", "prerequisites", "updated_at")
    best = full.groupBy("g", "n").agg(F.max(F.struct("updated_at", F.coalesce("level", F.lit(-1)).alias("level"), "obscurity", F.coalesce("description", F.lit("")).alias("description"), F.size(F.coalesce("prerequisites", F.array().cast("array<string>"))).alias("k"))).alias("b"))
    return cut(latest), cut(best.select("g", "n", F.nullif("b.level", F.lit(-1)).alias("level"), "b.obscurity", "b.description", "b.k"))


_LATEST = "best AS (SELECT lower(trim(graph_id)) AS g, lower(trim(id)) AS n, max({'u': updated_at, 'level': coalesce(level, -1), 'obscurity': obscurity, 'description': coalesce(description, ''), 'k': len(coalesce(prerequisites, []))}) AS b FROM knowledge_nodes GROUP BY 1, 2)"


@register(f"WITH {_LATEST} SELECT g, n, round(greatest(0.05, 0.5 - 0.08 * coalesce(b.obscurity, 3)), 6) AS prior FROM best")
def kg_priors(spark, d):
    return _nodes(spark, d)[1].select("g", "n", F.round(knowledge.prior(F.col("obscurity")), 6).alias("prior"))


_BELIEF = f"{_LATEST}, beliefs AS (SELECT g, n, nullif(b.level, -1) AS level, round(greatest(0.05, 0.5 - 0.08 * coalesce(b.obscurity, 3)) + CASE WHEN b.obscurity <= 2 THEN 0.4 ELSE 0 END, 6) AS belief, b.obscurity <= 2 AS assessed FROM best)"


def _beliefs(spark, d):
    _, n = _nodes(spark, d)
    return n.select("g", "n", "level", F.round(knowledge.prior(F.col("obscurity")) + F.when(F.col("obscurity") <= 2, 0.4).otherwise(0.0), 6).alias("belief"), (F.col("obscurity") <= 2).alias("assessed"))


_H = "CASE WHEN belief <= 0 OR belief >= 1 THEN 0 ELSE -belief * log2(belief) - (1 - belief) * log2(1 - belief) END"
_COVER = f"count(*) AS nodes, count(*) FILTER (WHERE belief >= 0.7) AS known, count(*) FILTER (WHERE belief <= 0.2) AS unknown, count(*) FILTER (WHERE belief > 0.2 AND belief < 0.7) AS uncertain, round(sum({_H}), 4) AS entropy, round(100.0 * count(*) FILTER (WHERE assessed) / count(*), 1) AS pct"


@register(f"WITH {_BELIEF} SELECT level, {_COVER} FROM beliefs GROUP BY level")
def kg_coverage(spark, d):
    return knowledge.coverage(_beliefs(spark, d), "level").withColumn("entropy", F.round("entropy", 4))


@register(f"WITH {_BELIEF} SELECT g, count(*) FILTER (WHERE belief > 0.2 AND belief < 0.8) <= 3 AS converged FROM beliefs GROUP BY g")
def kg_converged(spark, d):
    return knowledge.converged(_beliefs(spark, d), "g")


@register(f"WITH RECURSIVE {_EDGES}, {_BELIEF}, e AS (SELECT edges.*, p.belief >= 0.7 AS pk, c.belief >= 0.7 AS ck FROM edges JOIN beliefs p ON p.g = edges.g AND p.n = edges.p JOIN beliefs c ON c.g = edges.g AND c.n = edges.c) SELECT DISTINCT g, p AS n, 'inner' AS fringe FROM e WHERE pk AND NOT ck UNION ALL SELECT g, n, 'outer' FROM beliefs b WHERE belief < 0.7 AND NOT EXISTS (SELECT 1 FROM e WHERE e.g = b.g AND e.c = b.n AND NOT e.pk)")
def kg_fringes(spark, d):
    latest, _ = _nodes(spark, d)
    return knowledge.fringes(_beliefs(spark, d), hierarchy.links(latest))


@register(f"WITH {_LATEST} SELECT g, n, 'several sentences' AS issue FROM best WHERE len(regexp_split_to_array(b.description, '[.!?]+\\s+')) >= 3 UNION ALL SELECT g, n, 'obscure without prerequisites' FROM best WHERE b.k = 0 AND b.obscurity >= 4 UNION ALL SELECT g, n, 'thin description' FROM best WHERE length(b.description) < 10")
def kg_lint(spark, d):
    _, n = _nodes(spark, d)
    return knowledge.lint(n.withColumn("prerequisites", F.array_repeat(F.lit("x"), F.col("k"))))


@register(f"WITH RECURSIVE {_EDGES} SELECT DISTINCT g, a AS n FROM up WHERE a = d")
def kg_cycles(spark, d):
    """Nodes that lie on a cycle of prerequisites."""
    latest, _ = _nodes(spark, d)
    return hierarchy.ancestors(hierarchy.links(latest)).where("a = d").select("g", F.col("a").alias("n"))


@register(f"WITH {_BELIEF} SELECT g, n, round(CASE WHEN assessed THEN belief * 0.95 / (belief * 0.95 + (1 - belief) * 0.15) ELSE belief * 0.05 / (belief * 0.05 + (1 - belief) * 0.85) END, 6) AS posterior, round(CASE WHEN belief > 0.5 THEN 0.5 + (belief - 0.5) * 0.8 ELSE belief END, 6) AS calibrated FROM beliefs")
def kg_noisy_update(spark, d):
    b = _beliefs(spark, d)
    return b.select("g", "n", F.round(knowledge.noisy_update(F.col("belief"), F.col("assessed")), 6).alias("posterior"), F.round(knowledge.calibrate(F.col("belief"), F.lit(0.8)), 6).alias("calibrated"))


_FAM = "['none', 'heard_of', 'basic', 'solid', 'deep'][CAST(event_id % 5 AS INTEGER) + 1]"


@register(f"SELECT user_id AS learner, round(1 - avg(CASE WHEN {_FAM} IN ('basic', 'solid', 'deep') THEN 1.0 ELSE 0 END), 6) AS factor FROM events GROUP BY user_id")
def foil_calibration(spark, d):
    fam = F.element_at(F.array(*[F.lit(f) for f in knowledge.FAMILIARITY]), (F.col("event_id") % 5 + 1).cast("int"))
    return knowledge.foil_factor(table(spark, d, "events").select(F.col("user_id").alias("learner"), fam.alias("familiarity")), "learner")


def _learning(spark, d):
    """Each graph is one learner's; the nodes of little obscurity were answered, by title length."""
    latest, n = _nodes(spark, d)
    fam = F.element_at(F.array(*[F.lit(f) for f in knowledge.FAMILIARITY]), (F.pmod(F.length("n"), F.lit(5)) + 1).cast("int"))
    responses = n.where("obscurity <= 2").select(F.col("g").alias("learner"), "g", "n", fam.alias("familiarity"), F.length("n").alias("seq"))
    return n, hierarchy.links(latest), responses


@register()
def beliefs_bayes(spark, d):
    return knowledge.learners(*_learning(spark, d))


@register()
def beliefs_heuristic(spark, d):
    return knowledge.learners(*_learning(spark, d), mode="heuristic")


@register()
def next_probe(spark, d):
    """The next probe of every learner of a graph small enough for exact simulation (all of them are)."""
    return knowledge.learners(*_learning(spark, d), mode="heuristic", probe_count=1)
