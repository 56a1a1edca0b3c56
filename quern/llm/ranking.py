"""One ranking from several differently scaled scores: leximin over percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions.keys import key, strip
from quern.session import cut


def places(results: DataFrame) -> DataFrame:
    """``query_id, list, id, place``: each result's place in its list, 0 the first.

    A list is named by ``query_id, list_label, source`` without case and blanks.  ``rank`` tells the
    place; where it is null, the score does: it is compared in the direction that the list's own
    ranks show (their covariance), else the one of its source, else the larger the better, and the
    row follows the last ranked row that is not behind it.  Without a usable score the order of
    logging stands in.  Rows without id or query drop out; of repeated rows the best place counts;
    NaN counts as null.
    """
    rows = results.select(
        "query_id",
        F.concat_ws("\u0001", F.coalesce(key(F.col("list_label")), F.lit("")), F.coalesce(key(F.col("source")), F.lit(""))).alias("list"),
        F.coalesce(key(F.col("source")), F.lit("")).alias("source"),
        F.nullif(strip(F.col("id").cast("string")), F.lit("")).alias("id"),
        F.nanvl("score", F.lit(None).cast("double")).alias("score"),
        F.col("rank").cast("double").alias("rank"),
        F.col("logged_at"),
    ).where("query_id IS NOT NULL AND id IS NOT NULL")
    way = rows.groupBy("query_id", "list", "source").agg(
        F.covar_pop("rank", "score").alias("cov"), F.count_if(F.col("rank").isNull()).alias("gaps"), F.min("rank").alias("first"), F.max("rank").alias("last")
    )
    by_source = way.groupBy("source").agg(F.sum(F.signum("cov")).alias("source_cov"))
    way = way.join(by_source, "source").select(
        "query_id", "list", "gaps", F.coalesce("first", F.lit(0.0)).alias("first"), F.coalesce("last", F.lit(0.0)).alias("last"),
        F.when(F.coalesce(F.nullif(F.signum("cov"), F.lit(0.0)), F.signum("source_cov"), F.lit(-1.0)) > 0, 1.0).otherwise(-1.0).alias("sign"),
    )
    rows = rows.join(way, ["query_id", "list"]).withColumn("cost", F.col("score") * F.col("sign"))
    full = rows.where("gaps = 0")
    # only lists with a gap in their ranks are sorted
    by_score = Window.partitionBy("query_id", "list").orderBy(F.asc_nulls_last("cost"), F.asc_nulls_last("rank"), "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    by_log = Window.partitionBy("query_id", "list").orderBy(F.asc_nulls_last("logged_at"), F.asc_nulls_last("rank"), "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gap = rows.where("gaps > 0")
    gap = gap.withColumn("s_rank", F.last(F.when(F.col("cost").isNotNull(), F.col("rank")), True).over(by_score))
    gap = gap.withColumn("l_rank", F.last("rank", True).over(by_log))
    guess = F.when(F.col("cost").isNotNull(), F.coalesce("s_rank", F.col("first") - 1)).otherwise(F.coalesce("l_rank", F.col("last")))
    gap = gap.withColumn("rank", F.coalesce("rank", guess + 0.5)).drop("s_rank", "l_rank")
    every = full.unionByName(gap)
    return every.groupBy("query_id", "list", "id").agg(F.min(F.col("rank") - F.col("first")).alias("place"))


def percentiles(placed: DataFrame) -> DataFrame:
    """Adds ``pct`` in (0, 1]: the share of the list that a result isn't behind; lists only aggregated."""
    size = placed.groupBy("query_id", "list").agg(F.greatest(F.count("*"), F.floor(F.max("place")) + 1).cast("double").alias("n"))
    return placed.join(size, ["query_id", "list"]).withColumn("pct", F.greatest(F.lit(1e-9), F.least(F.lit(1.0), 1 - F.col("place") / F.col("n"))))


def leximin(pct: DataFrame) -> DataFrame:
    """``query_id, id, vector, lists``: each item's percentiles over all lists of its query, weakest first.

    A list that lacks the item adds 0, behind every result in it, so a strong score can't mask it.
    """
    lists = pct.select("query_id", "list").distinct().groupBy("query_id").agg(F.count("*").cast("int").alias("lists"))
    item = pct.groupBy("query_id", "id").agg(F.sort_array(F.collect_list("pct")).alias("have"))
    item = item.join(lists, "query_id")
    zeros = F.array_repeat(F.lit(0.0), F.col("lists") - F.size("have"))
    return item.select("query_id", "id", F.concat(zeros, F.col("have")).alias("vector"), "lists")


def _places(v: DataFrame) -> DataFrame:
    """Adds ``place`` within each query without gathering one: vectors are range-partitioned, and a range counts on from those before it."""
    order = ["query_id", F.desc("vector"), "id"]
    ranged = cut(v.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    size = ranged.groupBy("query_id", "range").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("query_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))  # at most one row a range and query
    size = size.select("query_id", "range", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("query_id", "range").orderBy(F.desc("vector"), "id"))
    return ranged.withColumn("own", own).join(size, ["query_id", "range"]).withColumn("place", (F.col("own") + F.col("before")).cast("int"))


def rank_items(results: DataFrame, top: int | None = None) -> DataFrame:
    """``query_id, id, place, lists_in, weakest``: the leximin ranking, ``top`` places of it or all.

    Vectors are compared like arrays: the weakest percentile first, then the next.  Equal vectors
    are ordered by id.  With ``top`` Spark keeps only so many rows a query before the shuffle; without,
    a query of any size is ranked in ranges.
    """
    v = leximin(percentiles(places(results)))
    if top is None:
        out = _places(v)
    else:
        out = v.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("vector"), "id"))).where(F.col("place") <= top)
    return out.select("query_id", "id", "place", F.size(F.filter("vector", lambda x: x > 0)).alias("lists_in"), F.col("vector")[0].alias("weakest"))
