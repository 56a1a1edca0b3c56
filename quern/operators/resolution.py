"""Entity resolution: candidate scores, margins, decisions in two passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Weights of the scores and the decision margins.
WEIGHTS = {"type": 0.25, "date": 0.15, "description": 0.20, "coherence": 0.30, "rank": 0.10}
LEAST, RATIO = 0.55, 1.25


def type_score(hint: Column, kind: Column) -> Column:
    return F.when(hint.isNull() | kind.isNull() | (hint == ""), 0.5).when(hint == kind, 1.0).otherwise(0.3)


def rank_score(rank: Column) -> Column:
    return F.exp(-rank.cast("double") / 10)


def description_score(cosine: Column) -> Column:
    return F.coalesce((cosine + 1) / 2, F.lit(0.5))


def coherence(candidates: DataFrame, claims: DataFrame, anchors: DataFrame, properties: list[str]) -> DataFrame:
    """Adds ``coherence``: 1 where the candidate has a claim of these properties to an anchor, else 0.3."""
    linked = claims.where(F.col("property").isin(*properties)).join(anchors.select(F.col("qid").alias("value")).distinct(), "value", "left_semi").select("qid", F.lit(1.0).alias("coherence")).distinct()
    return candidates.join(linked, "qid", "left").withColumn("coherence", F.coalesce("coherence", F.lit(0.3)))


def total(scores: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    w = weights or WEIGHTS
    out = F.lit(0.0)
    for name, s in scores.items():
        out = out + s * F.lit(w[name])
    return out


def cheap_first(scored: DataFrame, cheap: str, keep: int = 5, by: str = "mention_id") -> DataFrame:
    """The ``keep`` best candidates of each mention by a cheap score; only they get the costly one."""
    order = Window.partitionBy(by).orderBy(F.desc(cheap), "qid")
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= keep)


def decide(scored: DataFrame, by: str = "mention_id") -> DataFrame:
    """``by, status, qid, score``: resolved if the best total is high and clear of the second, else ambiguous."""
    order = Window.partitionBy(by).orderBy(F.desc("total"), "qid")
    two = scored.withColumn("r", F.row_number().over(order)).where("r <= 2")
    best = two.groupBy(by).agg(F.max(F.when(F.col("r") == 1, F.struct("qid", "total"))).alias("a"), F.coalesce(F.max(F.when(F.col("r") == 2, F.col("total"))), F.lit(0.0)).alias("second"))
    clear = (F.col("a.total") >= LEAST) & ((F.col("second") == 0) | (F.col("a.total") >= RATIO * F.col("second")))
    return best.select(by, F.when(clear, "resolved").otherwise("ambiguous").alias("status"), F.when(clear, F.col("a.qid")).alias("qid"), F.round("a.total", 6).alias("score"))


def decide_guarded(scored: DataFrame, by: str = "mention_id") -> DataFrame:
    """Decisions of ``decide`` without those whose chosen candidate is ``weak``; they are ambiguous."""
    made = decide(scored, by).join(scored.select(by, "qid", F.col("weak").alias("_w")), [by, "qid"], "left")
    vetoed = F.coalesce("_w", F.lit(False))
    return made.select(by, F.when(vetoed, "ambiguous").otherwise(F.col("status")).alias("status"), F.when(~vetoed, F.col("qid")).alias("qid"), "score")


def retry(mentions: DataFrame, catalogue: DataFrame) -> DataFrame:
    """``res_id, qid, tried``: mentions that equal one entity's name, and of the rest those that do in another spelling of a ruler's name.

    A mention whose spellings lead to several entities stays open.
    """
    first, rest = known_first(mentions, catalogue)
    variants = rest.where("mention IS NOT NULL").select("res_id", F.explode(F.slice(regnal_variants(F.col("mention")), 2, 100)).alias("mention"))
    again = known_first(variants, catalogue)[0].groupBy("res_id").agg(F.min("qid").alias("qid"), F.max("qid").alias("q2")).where("qid = q2").drop("q2")
    return first.select("res_id", "qid", F.lit(1).alias("tried")).unionByName(again.select("res_id", "qid", F.lit(2).alias("tried")))


def weak_structural(hint: Column, type_: Column, date: Column) -> Column:
    """A decision with a hint, but neither type nor dates behind it, is vetoed."""
    return hint.isNotNull() & (type_ < 0.5) & (date < 0.5)


def guard(chosen: Column, candidates: Column) -> Column:
    """A chosen id must be empty or one of the candidates."""
    return chosen.isNull() | (chosen == "") | F.array_contains(candidates, chosen)


def date_score(start: Column, end: Column, hint_start: Column, hint_end: Column, scale: float = 100.0) -> Column:
    """Plausibility of the candidate's life dates for the hinted years; missing dates score 1."""
    from quern.functions.temporal import plausibility

    known = start.isNotNull() & hint_start.isNotNull()
    a = F.struct(start.alias("start"), F.coalesce(end, start).alias("end"))
    b = F.struct(hint_start.alias("start"), F.coalesce(hint_end, hint_start).alias("end"))
    return F.when(known, plausibility(a, b, scale)).otherwise(1.0)


def known_first(mentions: DataFrame, catalogue: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mentions equal to a label or alias of exactly one entity (``res_id, qid``), and the rest."""
    fold = lambda c: F.lower(F.trim(c))
    names = catalogue.select("qid", F.explode(F.concat(F.array("label"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name"))
    names = names.select("qid", fold(F.col("name")).alias("name")).where("name <> ''").distinct()
    one = names.groupBy("name").agg(F.min("qid").alias("qid"), F.count("*").alias("n")).where("n = 1").select("name", "qid")
    asked = mentions.withColumn("name", fold(F.col("mention")))
    return asked.join(one, "name").select("res_id", "qid"), asked.join(one, "name", "left_anti").drop("name")


# Properties of birth or inception, and of death or dissolution.
STARTS, ENDS = ("P569", "P571"), ("P570", "P576")


def life_dates(claims: DataFrame) -> DataFrame:
    """``qid, start, end`` (years) from ``qid, property, rank, value``: the earliest start, the latest end; deprecated claims don't count."""
    year = F.try_to_number(F.nullif(F.regexp_extract("value", r"^\+?(-?\d{1,5})", 1), F.lit("")), F.lit("S99999")).cast("int")
    c = claims.where(~F.coalesce(F.col("rank") == "deprecated", F.lit(False))).withColumn("y", year)
    start, end = F.min(F.when(F.col("property").isin(*STARTS), F.col("y"))), F.max(F.when(F.col("property").isin(*ENDS), F.col("y")))
    return c.groupBy("qid").agg(start.alias("start"), end.alias("end"))


def claim_values(claims: DataFrame, prop: str) -> DataFrame:
    """``qid, values, first``: values of a property in order (``ord``), deprecated ones left out, and the first of them."""
    c = claims.where((F.col("property") == prop) & ~F.coalesce(F.col("rank") == "deprecated", F.lit(False)))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ord", "value"))), lambda s: s["value"])
    return c.groupBy("qid").agg(ordered.alias("values"), F.min_by("value", "ord").alias("first"))


# Names of rulers in several languages.
REGNAL = ["charles carl karl carlos carlo", "john jean johann juan giovanni", "henry henri heinrich enrique", "william guillaume wilhelm guillermo", "philip philippe philipp felipe", "louis ludwig luis luigi", "frederick friedrich federico frederik"]


def regnal_variants(mention: Column) -> Column:
    """Spellings of a ruler's name, the typed one first; other names give themselves only."""
    t = F.split(F.trim(mention), r"\s+")
    first, rest = F.lower(t[0]), F.array_join(F.slice(t, 2, 100), " ")
    regnal = F.trim(mention).rlike(r"(?i)^\S+\s+([ivx]+\b|of\b)")
    pairs = [x for row in REGNAL for n in row.split() for x in (F.lit(n), F.array(*[F.lit(m.capitalize()) for m in row.split() if m != n]))]
    siblings = F.coalesce(F.create_map(*pairs)[first], F.array().cast("array<string>"))
    return F.when(regnal, F.concat(F.array(F.trim(mention)), F.transform(siblings, lambda n: F.concat_ws(" ", n, rest)))).otherwise(F.array(F.trim(mention)))


def two_pass(candidates: DataFrame, claims: DataFrame, properties: list[str], by: str = "mention_id") -> DataFrame:
    """Decisions in two passes over ``by, qid, base`` (total without coherence): entities resolved first anchor the ambiguous ones.

    The second pass looks at the ambiguous mentions only; what the first resolved stays.
    """
    first = decide(candidates.withColumn("total", F.col("base") + WEIGHTS["coherence"] * 0.3), by)
    anchors = first.where("status = 'resolved'").select("qid").distinct()
    open_ = candidates.join(first.where("status = 'ambiguous'").select(by), by, "left_semi")
    again = coherence(open_, claims, anchors, properties)
    second = decide(again.withColumn("total", F.col("base") + WEIGHTS["coherence"] * F.col("coherence")), by)
    return first.where("status = 'resolved'").unionByName(second)
