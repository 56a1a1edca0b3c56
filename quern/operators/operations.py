"""Batch runs, tiers, audit logs, costs, caches and contexts over append-only tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.session import cut

# States that end an item, and what results mean for it.
DONE = ("done", "verified", "applied", "skipped")
RESULT_STATUS = {"verified": "done", "flagged": "needs_review", "error": "error"}


def latest(ledger: DataFrame, key: str, *order: str) -> DataFrame:
    """Latest row a key of an append-only ledger; no window, so a hot key combines map-side."""
    names = [c for c in ledger.columns if c != key]
    return ledger.groupBy(key).agg(F.max(F.struct(*order, *[c for c in names if c not in order])).alias("_l")).select(key, *[F.col(f"_l.{c}").alias(c) for c in names])


def pending_items(wanted: DataFrame, state: DataFrame, done: tuple[str, ...] = DONE) -> DataFrame:
    """``wanted`` (``item_id``) without the items whose state is done; repeated ids stay."""
    return wanted.join(state.where(F.col("status").isin(*done)).select("item_id"), "item_id", "left_anti")


def status_counts(state: DataFrame) -> DataFrame:
    return state.groupBy("status").agg(F.count("*").alias("n"))


def budget_prefix(items: DataFrame, budget: float, per_range: int = 100_000) -> DataFrame:
    """``seq, item_id, cost, total``: the items committed in ``seq`` order until the first that would exceed the budget.

    Costs are summed by ranges of ``seq`` first, as many as the number of items calls for; only the
    running sum inside a range sorts rows, so no single task holds them all.  Null costs count as 0; negative ones are an error of the caller.
    """
    rows = items.select("seq", "item_id", F.coalesce("cost", F.lit(0.0)).alias("cost"))
    span = rows.agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"), F.ceil(F.count("*") / per_range).alias("ranges"))
    at = F.floor((F.col("seq") - F.col("lo")) * F.col("ranges") / (F.col("hi") - F.col("lo") + 1))
    placed = rows.join(F.broadcast(span)).select("seq", "item_id", "cost", at.alias("range"))
    sums = placed.groupBy("range").agg(F.sum("cost").alias("s"))
    head = sums.select("range", F.coalesce(F.sum("s").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("before"))
    run = F.sum("cost").over(Window.partitionBy("range").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = placed.withColumn("own", run).join(F.broadcast(head), "range").select("seq", "item_id", "cost", F.round(F.col("own") + F.col("before"), 6).alias("total"))
    return total.where(F.col("total") <= budget)


def run_batches(items: DataFrame, process: Callable[[DataFrame], DataFrame], batch_size: int, budget: float | None = None, spent: float = 0.0) -> tuple[DataFrame | None, float]:
    """Processes ``items`` (``item_id, seq``) in batches; stops at the first item that would exceed the budget.

    The loop runs on the driver, one job a batch; results (``item_id, seq, status, cost``) stay
    distributed.  A batch that raises marks all its items as errors.
    """
    out, total = None, spent
    bounds = items.agg(F.min("seq"), F.max("seq")).first()
    if bounds[0] is None:
        return None, total
    for start in range(bounds[0], bounds[1] + 1, batch_size):
        if budget is not None and total >= budget:
            break
        batch = items.where(F.col("seq").between(start, start + batch_size - 1))
        try:
            got = cut(process(batch))
            cost = got.agg(F.coalesce(F.sum("cost"), F.lit(0.0))).first()[0]
        except Exception as e:  # noqa: BLE001 - a failed batch is a result
            got = batch.select("item_id", "seq", F.lit("error").alias("status"), F.lit(0.0).alias("cost"), F.lit(str(e)[:200]).alias("error"))
            cost = 0.0
        full = budget is not None and total + cost > budget
        if full:
            kept = budget_prefix(got, budget - total).select("seq")
            got = got.join(kept, "seq", "left_semi")
            cost = got.agg(F.coalesce(F.sum("cost"), F.lit(0.0))).first()[0]
        total += cost
        out = got if out is None else out.unionByName(got, allowMissingColumns=True)
        if full:
            break
    return out, total


def result_status(result: Column) -> Column:
    """Item state of a verification result; unknown ones pass through."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in RESULT_STATUS.items() for x in kv])[result], result)


def tier_report(history: DataFrame) -> DataFrame:
    """``tier, status, n`` from ``tier, status`` rows of all tiers an item went through."""
    return history.groupBy("tier", "status").agg(F.count("*").alias("n"))


def escalated(state: DataFrame, tier: str) -> DataFrame:
    """Items of the tier that need review, back to pending for the next one, their cost reset."""
    return state.where((F.col("status") == "needs_review") & (F.col("tier") == tier)).withColumn("status", F.lit("pending")).withColumn("cost", F.lit(0.0))


def tier_timeout(base: Column, factor: Column, most: Column) -> Column:
    return F.least(F.greatest(base, F.floor(base * factor)), most)


def audit_summary(log: DataFrame) -> DataFrame:
    """``action, tier, n, cost, items, errors``: total, by action and by tier in one pass (grouping sets); an empty tier is unknown."""
    rows = log.select(F.coalesce("action", F.lit("")).alias("action"), F.coalesce(F.nullif("tier", F.lit("")), F.lit("unknown")).alias("tier"), "item_id", F.coalesce("cost", F.lit(0.0)).alias("cost"), "failed")
    g = rows.groupingSets([[], ["action"], ["tier"]], "action", "tier")
    return g.agg(F.count("*").alias("n"), F.round(F.sum("cost"), 4).alias("cost"), F.count_distinct("item_id").alias("items"), F.count_if("failed").alias("errors"))


def latest_operations(log: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """``key, type, ts, seq, first_seq`` of the latest operation a key; the kinds are filtered before; places keep the order of first sight."""
    rows = log.where(F.col("type").isin(*kinds)) if kinds else log
    best = rows.groupBy("key").agg(F.max(F.struct("ts", "seq", "type")).alias("b"), F.min("seq").alias("first_seq"))
    return best.select("key", F.col("b.type").alias("type"), F.col("b.ts").alias("ts"), F.col("b.seq").alias("seq"), "first_seq")


def cost_filter(costs: DataFrame, since: str | None = None, project: str | None = None, host: str | None = None, model_like: str | None = None, days: int | None = None, now: str | None = None) -> DataFrame:
    """Rows that meet all given conditions; times compare as text, models by a case-insensitive part.

    ``days`` keeps the rows of the last so many days before ``now`` (a time as text; the present one if not given).
    """
    out = costs
    if days:
        moment = F.to_timestamp(F.lit(now)) if now else F.current_timestamp()
        out = out.where(F.col("ts") >= F.date_format(moment - F.expr(f"INTERVAL {int(days)} DAYS"), "yyyy-MM-dd'T'HH:mm:ss"))
    for cond in (F.col("ts") >= since if since else None, F.col("project") == project if project else None, F.col("host") == host if host else None, F.col("model").ilike(f"%{model_like}%") if model_like else None):
        out = out if cond is None else out.where(cond)
    return out


SUMMARY_KEYS = ("project", "model", "host", "api_key_hint", "script")


def cost_summary(costs: DataFrame, *by: str) -> DataFrame:
    """Calls, tokens, cost and time span by each of the given keys, in one pass; other keys are errors."""
    if any(b not in SUMMARY_KEYS for b in by):
        raise ValueError(f"can be grouped by {', '.join(SUMMARY_KEYS)}")
    g = costs.groupingSets([[b] for b in by], *by)
    return g.agg(
        F.count("*").alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), *([F.sum("cached_tokens").alias("cached_tokens")] if "cached_tokens" in costs.columns else []),
        F.round(F.sum("cost_usd"), 4).alias("cost_usd"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    )


def cost_daily(costs: DataFrame) -> DataFrame:
    return costs.groupBy(F.to_date("ts").alias("day"), "project").agg(F.round(F.sum("cost_usd"), 6).alias("cost_usd"))


# Dollars for a million prompt and completion tokens.
PRICES = {
    "gemini-2.0-flash": (0.10, 0.40),
    "gemini-2.0-flash-lite": (0.075, 0.30),
    "gemini-2.5-flash": (0.30, 2.50),
    "gemini-2.5-flash-lite": (0.15, 0.60),
    "gemini-2.5-pro": (1.25, 10.00),
    "gemini-3-flash-preview": (0.30, 2.50),
    "gemini-3.1-flash-lite-preview": (0.15, 0.60),
    "claude-sonnet-4-20250514": (3.00, 15.00),
    "claude-haiku-4-5-20241022": (0.80, 4.00),
}


def cost_of(calls: DataFrame, prices: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Adds ``computed``: dollars by the price of the model (a ``gemini/`` prefix is dropped); null for an unknown model."""
    table = prices or PRICES
    m = F.regexp_replace("model", "^gemini/", "")
    price = [F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, v[i])])[m] for i in (0, 1)]
    return calls.withColumn("computed", F.round((F.col("prompt_tokens") * price[0] + F.col("completion_tokens") * price[1]) / 1e6, 9))


def merge_ignoring(local: DataFrame, remote: DataFrame, key: str = "id") -> DataFrame:
    """Union by key; the local row wins."""
    return local.unionByName(remote.join(local.select(key), key, "left_anti"))


def cache_split(texts: DataFrame, cache: DataFrame, model: str) -> tuple[DataFrame, DataFrame]:
    """Hits (with ``embedding``) and distinct missing hashes of ``text`` under ``model`` (key: sha256 of the text)."""
    asked = texts.where("text IS NOT NULL").withColumn("text_hash", F.sha2("text", 256))
    have = cache.where(F.col("model_name") == model).select("text_hash", "embedding").dropDuplicates(["text_hash"])
    return asked.join(have, "text_hash"), asked.select("text_hash").distinct().join(have, "text_hash", "left_anti")


def fresh(fetched_at: Column, ttl: Column, now: float) -> Column:
    """Inclusive freshness of a cached payload."""
    return F.lit(now) - fetched_at <= ttl


def stale_documents(documents: DataFrame, listing: DataFrame) -> DataFrame:
    """``path`` of the listed files (``path, mtime``) whose time differs from the indexed one or that aren't indexed."""
    old = documents.select("path", F.col("mtime").alias("_old"))
    return listing.join(old, "path", "left").where(~F.col("mtime").eqNullSafe(F.col("_old"))).select("path")


def index_stats(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: documents, chunks, chunks with a vector, collections."""
    d = documents.agg(F.count("*").alias("documents"), F.count_distinct("collection").alias("collections"))
    return d.join(chunks.agg(F.count("*").alias("chunks"), F.count("embedding").alias("embedded")))


def context_markdown(entities: DataFrame, related: DataFrame, title: str, fields: list[str]) -> DataFrame:
    """``id, context``: a markdown block of each entity with its related lines (``id, ord, line``) in order."""
    lines = related.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("ord", "line"))).alias("l")).select("id", F.concat_ws("\n", F.transform("l", lambda s: F.concat(F.lit("- "), s["line"]))).alias("lines"))
    head = F.concat_ws("\n", F.concat(F.lit("## "), F.col(title)), *[F.concat(F.lit(f"**{f}**: "), F.col(f).cast("string")) for f in fields])
    return entities.join(lines, "id", "left").select("id", F.concat_ws("\n", head, "lines").alias("context"))


def usage_rows(responses: DataFrame) -> DataFrame:
    """One cost row a model from ``response_id, model_usage map, model, input_tokens, output_tokens, cost``; without a map the top-level usage."""
    per = responses.where(F.size("model_usage") > 0).select("response_id", F.explode("model_usage").alias("model", "u")).select("response_id", "model", F.col("u.input_tokens").alias("input_tokens"), F.col("u.output_tokens").alias("output_tokens"), F.col("u.cost").alias("cost"))
    rest = responses.where(F.coalesce(F.size("model_usage"), F.lit(0)) <= 0).select("response_id", "model", "input_tokens", "output_tokens", "cost")
    return per.unionByName(rest)


def structured_text(text: Column) -> Column:
    """JSON of a model's answer: a code fence is stripped."""
    inner = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    return F.when(inner != "", inner).otherwise(F.trim(text))
