"""Entity change management: references, merges, deletes, veto gates, validation, proposals."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.session import Parts


@dataclass(frozen=True)
class Reference:
    """A field of ``source`` that holds ids of ``target``: scalar, array, or a sub-field of an array of structs."""

    source: str
    field: str
    target: str
    array: bool = False
    sub_field: str | None = None
    keep_both: bool = False


def reference_ids(source: DataFrame, ref: Reference, key: str = "id") -> DataFrame:
    """``id, target_id`` (strings): every reference of the field; nulls drop out."""
    value = F.col(ref.field)
    if ref.array:
        value = F.explode(F.transform(value, lambda x: (x[ref.sub_field] if ref.sub_field else x).cast("string")))
        return source.select(F.col(key).cast("string").alias("id"), value.alias("target_id")).where("target_id IS NOT NULL")
    return source.select(F.col(key).cast("string").alias("id"), value.cast("string").alias("target_id")).where("target_id IS NOT NULL")


def find_references(sources: dict[str, DataFrame], refs: list[Reference], targets: DataFrame) -> DataFrame:
    """``target_id, source_type, field, id``: who refers to each of ``targets`` (``target_type, target_id``), once a field and entity."""
    out = None
    for r in refs:
        rows = reference_ids(sources[r.source], r).withColumn("source_type", F.lit(r.source)).withColumn("field", F.lit(r.field)).withColumn("target_type", F.lit(r.target))
        out = rows if out is None else out.unionByName(rows)
    wanted = targets.select("target_type", F.col("target_id").cast("string").alias("target_id")).distinct()
    return out.join(wanted, ["target_type", "target_id"], "left_semi").select("target_id", "source_type", "field", "id").distinct()


def resolve_merges(merges: DataFrame) -> DataFrame:
    """``source, target`` with chains followed to their end (a into b, b into c gives a into c) by pointer doubling.

    A record merged into two others or a cycle is an error.  Each round settles the records next to
    an end, so rounds without one leave nothing but cycles.
    """
    m = merges.select(F.col("source").cast("string").alias("source"), F.col("target").cast("string").alias("target")).distinct()
    if not m.groupBy("source").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        raise ValueError("a record is merged into several others")
    before = None
    while True:
        ahead = m.select(F.col("source").alias("s"), F.col("target").alias("t"))
        parts = Parts(merges.sparkSession)
        still = parts.add(m.join(ahead, F.col("target") == F.col("s"), "left").select("source", "target", "t"), n=F.count("t"))["n"]
        step = parts.frame()
        if not still:
            return step.select("source", "target")
        if still == before:
            raise ValueError("merges form a cycle")
        m, before = step.select("source", F.coalesce("t", "target").alias("target")), still


def relink(source: DataFrame, ref: Reference, merges: DataFrame) -> DataFrame:
    """``source`` with its references moved to the merge targets; ids keep their type.

    In an array the merged id is rewritten; if the target is there already the rewritten one is
    dropped (structs with ``keep_both`` stay).
    """
    kind = source.schema[ref.field].dataType
    if not ref.array:
        m = merges.select(F.col("source").alias("_s"), F.col("target").alias("_t"))
        moved = source.join(m, F.col(ref.field).cast("string") == F.col("_s"), "left")
        return moved.withColumn(ref.field, F.coalesce(F.col("_t").cast(kind), F.col(ref.field))).drop("_s", "_t")
    item = kind.elementType
    get = (lambda x: x[ref.sub_field]) if ref.sub_field else (lambda x: x)
    ids = source.select(F.explode(F.transform(ref.field, lambda x: get(x).cast("string"))).alias("_s"))
    used = ids.distinct().join(merges.select(F.col("source").alias("_s"), F.col("target").alias("_t")), "_s")
    rows = source.withColumn("_ids", F.array_distinct(F.transform(ref.field, lambda x: get(x).cast("string"))))
    pairs = rows.select("id", F.explode("_ids").alias("_s")).join(used, "_s").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("_s", "_t"))).alias("_m"))
    rows = rows.join(pairs, "id", "left")
    present = F.col("_ids")

    def rewrite(x: Column) -> Column:
        new = F.coalesce(F.col("_m")[get(x).cast("string")], get(x).cast("string"))
        return x.withField(ref.sub_field, new.cast(item[ref.sub_field].dataType)) if ref.sub_field else new.cast(item)

    def stays(x: Column) -> Column:
        to = F.col("_m")[get(x).cast("string")]
        return to.isNull() | ~F.array_contains(present, to)

    kept = F.col(ref.field) if ref.keep_both else F.filter(ref.field, stays)
    return rows.withColumn(ref.field, F.when(F.col("_m").isNull(), F.col(ref.field)).otherwise(F.transform(kept, rewrite))).drop("_ids", "_m")


def guarded_delete(entities: DataFrame, doomed: DataFrame, references: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities left after deleting ``doomed`` (``id``), and the refused ids with their number of references.

    An id that something refers to is not deleted.
    """
    refused = doomed.join(references.groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("references")), "id")
    free = doomed.join(refused.select("id"), "id", "left_anti")
    return entities.join(free, "id", "left_anti"), refused


@dataclass(frozen=True)
class Gate:
    """A veto: ``reason`` is null where the pair passes."""

    name: str
    reason: Column


def exact_field(f: str) -> Gate:
    a, b = F.col(f"a.{f}"), F.col(f"b.{f}")
    return Gate("exact_field", F.when(a.isNotNull() & b.isNotNull() & (a != b), F.concat(F.lit(f"{f}: "), a.cast("string"), F.lit(" vs "), b.cast("string"))))


def no_conflict(f: str) -> Gate:
    return Gate("no_conflict", exact_field(f).reason)


def initial_match(f: str) -> Gate:
    a, b = (F.lower(F.substring(F.trim(F.col(f"{s}.{f}")), 1, 1)) for s in "ab")
    return Gate("initial_match", F.when(~a.eqNullSafe(b), F.concat(F.lit("initials "), F.coalesce(a, F.lit("?")), F.lit(" vs "), F.coalesce(b, F.lit("?")))))


def gender_check(f: str, male: list[str], female: list[str]) -> Gate:
    a, b = (F.lower(F.split(F.trim(F.col(f"{s}.{f}")), r"\s+")[0]) for s in "ab")
    clash = (a.isin(*male) & b.isin(*female)) | (a.isin(*female) & b.isin(*male))
    return Gate("gender_check", F.when(clash, F.concat(F.lit("names "), a, F.lit(" vs "), b)))


def reference_ratio(f: str = "ref_count", ratio: float = 3.0, minor: int = 1) -> Gate:
    hi, lo = F.greatest(F.col(f"a.{f}"), F.col(f"b.{f}")), F.least(F.col(f"a.{f}"), F.col(f"b.{f}"))
    fine = ((hi >= 3) & (lo <= minor)) | ((lo > 0) & (hi / lo >= ratio))
    return Gate("reference_ratio", F.when(~F.coalesce(fine, F.lit(False)), F.concat(F.lit("references "), hi.cast("string"), F.lit(" vs "), lo.cast("string"))))


def unordered(a: str, b: str) -> Column:
    """Key of a pair in either order."""
    return F.array_sort(F.array(F.col(a).cast("string"), F.col(b).cast("string")))


def veto(pairs: DataFrame, gates: list[Gate], excluded: DataFrame | None = None) -> DataFrame:
    """Adds ``accepted, reason`` to pairs with structs ``a`` and ``b``; the first failing gate names the reason.

    ``excluded`` (``id_a, id_b``) is looked at first, in either order.
    """
    reasons = [F.when(g.reason.isNotNull(), F.concat(F.lit(f"{g.name}: "), g.reason)) for g in gates]
    if excluded is not None:
        known = excluded.select(unordered("id_a", "id_b").alias("_k"), F.lit(True).alias("_x")).distinct()
        pairs = pairs.withColumn("_k", unordered("id_a", "id_b")).join(known, "_k", "left")
        reasons.insert(0, F.when(F.col("_x"), F.lit("excluded")))
    out = pairs.withColumn("reason", F.coalesce(*reasons, F.lit("passed all gates"))).withColumn("accepted", F.col("reason") == "passed all gates")
    return out.drop("_k", "_x")


@dataclass(frozen=True)
class Rule:
    """A validation rule over entity frames; ``find`` gives ``id, message`` of the violations."""

    name: str
    entity: str
    find: Callable[[dict[str, DataFrame]], DataFrame]
    severity: str = "error"
    tags: tuple[str, ...] = field(default=())


def _absent(f: str) -> Column:
    return F.col(f).isNull() | (F.col(f).cast("string") == "")


def required_field(entity: str, f: str, severity: str = "error") -> Rule:
    return Rule(f"required_{f}", entity, lambda e: e[entity].where(_absent(f)).select(F.col("id").cast("string").alias("id"), F.lit(f"missing {f}").alias("message")), severity)


def valid_values(entity: str, f: str, allowed: list[str], severity: str = "error") -> Rule:
    text = F.concat(F.lit(f"{f}="), F.col(f).cast("string"), F.lit(" not in " + ", ".join(sorted(allowed))))
    return Rule(f"valid_{f}", entity, lambda e: e[entity].where(~_absent(f) & ~F.col(f).isin(*allowed)).select(F.col("id").cast("string").alias("id"), text.alias("message")), severity)


def conditional_required(entity: str, f: str, when: Column, severity: str = "error") -> Rule:
    return Rule(f"conditional_{f}", entity, lambda e: e[entity].where(when & _absent(f)).select(F.col("id").cast("string").alias("id"), F.lit(f"missing {f}").alias("message")), severity)


def reference_exists(ref: Reference, severity: str = "error") -> Rule:
    def find(e: dict[str, DataFrame]) -> DataFrame:
        known = e[ref.target].select(F.col("id").cast("string").alias("target_id"))
        lost = reference_ids(e[ref.source], ref).where("target_id <> ''").join(known, "target_id", "left_anti")
        return lost.select("id", F.concat(F.lit(f"{ref.field} -> unknown "), "target_id").alias("message"))

    return Rule(f"reference_{ref.field}", ref.source, find, severity)


def no_orphans(entity: str, refs: list[Reference], severity: str = "warning") -> Rule:
    def find(e: dict[str, DataFrame]) -> DataFrame:
        used = None
        for r in refs:
            rows = reference_ids(e[r.source], r).select(F.col("target_id").alias("id"))
            used = rows if used is None else used.unionByName(rows)
        return e[entity].select(F.col("id").cast("string").alias("id")).join(used.distinct(), "id", "left_anti").withColumn("message", F.lit("never referenced"))

    return Rule(f"orphan_{entity}", entity, find, severity)


def validate(entities: dict[str, DataFrame], rules: list[Rule]) -> DataFrame:
    """``rule, severity, entity_type, id, message`` of all violations."""
    out = None
    for r in rules:
        rows = r.find(entities).select(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), F.lit(r.entity).alias("entity_type"), "id", "message")
        out = rows if out is None else out.unionByName(rows)
    return out


def validation_summary(violations: DataFrame) -> DataFrame:
    """One row ``errors, warnings, ok``."""
    errors = F.count_if(F.col("severity") == "error")
    return violations.agg(errors.alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"), (errors == 0).alias("ok"))


def modify_proposals(current: DataFrame, proposed: DataFrame, fields: list[str]) -> DataFrame:
    """``id, changes array<struct<field, old, new>>`` of the entities that a proposal changes."""
    p = proposed.select("id", *[F.col(f).alias(f"_new_{f}") for f in fields])
    diff = F.filter(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("old"), F.col(f"_new_{f}").cast("string").alias("new")) for f in fields]), lambda s: ~s["old"].eqNullSafe(s["new"]))
    return current.join(p, "id").select("id", diff.alias("changes")).where(F.size("changes") > 0)


# The life cycle of a proposal.
TRANSITIONS = {("", "pending"), ("pending", "approved"), ("pending", "rejected"), ("approved", "applied")}


def proposal_status(log: DataFrame) -> DataFrame:
    """``proposal_id, status, legal``: latest status of an append-only log ``proposal_id, seq, status``; every step is checked."""
    w = Window.partitionBy("proposal_id").orderBy("seq")
    step = F.concat_ws(">", F.coalesce(F.lag("status").over(w), F.lit("")), "status")
    legal = [f"{a}>{b}" for a, b in sorted(TRANSITIONS)]
    return log.withColumn("ok", step.isin(*legal)).groupBy("proposal_id").agg(F.max_by("status", "seq").alias("status"), F.bool_and("ok").alias("legal"))


def parse_value(text: Column) -> Column:
    """Kind of a typed literal: int, bool, null, json or string, with its canonical text."""
    t = F.trim(text)
    kind = (
        F.when(t.rlike(r"^[\[{]"), "json")
        .when(t.rlike(r"^[+-]?\d+$"), "int")
        .when(F.lower(t).isin("true", "false"), "bool")
        .when(F.lower(t).isin("null", "none"), "null")
        .otherwise("string")
    )
    return F.struct(kind.alias("kind"), F.when(kind == "string", text).when(kind == "null", F.lit(None)).when(kind == "json", t).otherwise(F.lower(t)).alias("value"))
