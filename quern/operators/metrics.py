"""Agreement, retrieval and ranking metrics, all as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def confusion(labels: DataFrame, a: str = "label_a", b: str = "label_b") -> DataFrame:
    """``a, b, n`` of two raters' labels; rows with a null label are left out."""
    return labels.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count("*").alias("n"))


def kappa(labels: DataFrame, a: str = "label_a", b: str = "label_b") -> DataFrame:
    """``n, agreement, kappa``: Cohen's kappa; 0 where chance agreement is complete; no rows if there are none."""
    c = confusion(labels, a, b)
    total = c.agg(F.sum("n").cast("double").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same")).where("n > 0")
    one = c.groupBy(F.col("a").alias("l")).agg(F.sum("n").alias("x"))
    two = c.groupBy(F.col("b").alias("l")).agg(F.sum("n").alias("y"))
    chance = one.join(two, "l").agg(F.coalesce(F.sum(F.col("x").cast("double") * F.col("y")), F.lit(0.0)).alias("xy"))
    po, pe = F.col("same") / F.col("n"), F.col("xy") / (F.col("n") * F.col("n"))
    return total.join(chance).select(F.col("n").cast("long").alias("n"), F.round(po, 6).alias("agreement"), F.round(F.when(pe == 1, 0.0).otherwise((po - pe) / (1 - pe)), 6).alias("kappa"))


def per_label(labels: DataFrame, a: str = "label_a", b: str = "label_b") -> DataFrame:
    """``label, precision, recall, f1, support`` with ``a`` as truth; 0 where a denominator is 0."""
    c = confusion(labels, a, b)
    rows = c.select(F.explode(F.array(F.struct(F.col("a").alias("l"), F.lit("a").alias("s")), F.struct(F.col("b").alias("l"), F.lit("b").alias("s")))).alias("e"), "a", "b", "n")
    g = rows.groupBy(F.col("e.l").alias("label")).agg(
        F.sum(F.when((F.col("e.s") == "a") & (F.col("a") == F.col("b")), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("e.s") == "a", F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(F.col("e.s") == "b", F.col("n")).otherwise(0)).alias("said"),
    )
    p, r = F.when(F.col("said") > 0, F.col("tp") / F.col("said")).otherwise(0.0), F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    return g.select("label", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 6).alias("f1"), "support")


def judge(labels: DataFrame, a: str = "label_a", b: str = "label_b") -> DataFrame:
    """Kappa with a recommendation: trustworthy above .7, moderate from .5, else unreliable."""
    return kappa(labels, a, b).withColumn("recommendation", F.when(F.col("kappa") > 0.7, "trustworthy").when(F.col("kappa") >= 0.5, "moderate").otherwise("unreliable"))


def intra_rater(labels: DataFrame, key: str, a: str = "label_a", b: str = "label_b") -> DataFrame:
    """Kappa of one rater's two passes with its quality and the number of disagreements."""
    wrong = labels.where(F.col(a) != F.col(b)).agg(F.count("*").alias("disagreements"), F.min(key).alias("first_disagreement"))
    return kappa(labels, a, b).withColumn("quality", F.when(F.col("kappa") > 0.8, "excellent").when(F.col("kappa") >= 0.6, "acceptable").otherwise("concerning")).join(wrong)


def retrieval(ranked: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """``qid, ndcg, mrr, recall`` at ``k`` of ``qid, id, rank`` against ``qid, id, rel`` (graded); queries without relevant ids drop out."""
    hits = ranked.where(F.col("rank") <= k).join(relevant.where("rel > 0"), ["qid", "id"])
    got = hits.groupBy("qid").agg(F.sum(F.col("rel") / F.log2(F.col("rank") + 1)).alias("dcg"), F.min("rank").alias("first"), F.count("*").alias("found"))
    ideal = relevant.where("rel > 0").withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("rel"), "id")))
    best = ideal.groupBy("qid").agg(F.sum(F.when(F.col("r") <= k, F.col("rel") / F.log2(F.col("r") + 1))).alias("idcg"), F.count("*").alias("all"))
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return best.join(got, "qid", "left").select("qid", F.round(z(F.col("dcg") / F.col("idcg")), 6).alias("ndcg"), F.round(z(1 / F.col("first")), 6).alias("mrr"), F.round(z(F.col("found") / F.col("all")), 6).alias("recall"))




def auc(scored: DataFrame, by: str) -> DataFrame:
    """``by, auc`` (area under the ROC curve) of ``score, truth``: rank sum with average ranks of ties.

    Scores are counted by value first, so the window runs over distinct values only.
    """
    v = scored.where("score IS NOT NULL AND truth IS NOT NULL").groupBy(by, "score").agg(F.count("*").alias("n"), F.count_if(F.col("truth")).alias("p"))
    w = Window.partitionBy(by).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    r = v.withColumn("below", F.coalesce(F.sum("n").over(w), F.lit(0)))
    g = r.groupBy(by).agg(F.sum(F.col("p") * (F.col("below") + (F.col("n") + 1) / 2)).alias("ranks"), F.sum("p").cast("double").alias("pos"), F.sum(F.col("n") - F.col("p")).cast("double").alias("neg"))
    area = (F.col("ranks") - F.col("pos") * (F.col("pos") + 1) / 2) / (F.col("pos") * F.col("neg"))
    return g.select(by, F.round(F.when((F.col("pos") > 0) & (F.col("neg") > 0), area), 6).alias("auc"))


def best_f1(scored: DataFrame, steps: int = 200) -> DataFrame:
    """``threshold, precision, recall, f1`` of the best of ``steps`` thresholds over the range of the scores (>= is positive).

    Rows are counted into the step they reach once; the sweep is a running sum over the steps.
    """
    s = scored.where("score IS NOT NULL AND truth IS NOT NULL")
    span = s.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    step = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo")) * (steps - 1) + F.lit(1e-9))).otherwise(0)
    b = s.join(F.broadcast(span)).groupBy(step.cast("long").alias("step"), "lo", "hi").agg(F.count("*").alias("n"), F.count_if(F.col("truth")).alias("p"))
    w = Window.orderBy(F.desc("step"))
    total = F.sum("p").over(Window.partitionBy())
    r = b.select("step", "lo", "hi", F.sum("n").over(w).cast("double").alias("said"), F.sum("p").over(w).cast("double").alias("tp"), total.cast("double").alias("pos"))
    p, q = F.col("tp") / F.col("said"), F.when(F.col("pos") > 0, F.col("tp") / F.col("pos")).otherwise(0.0)
    f = F.when(p + q > 0, 2 * p * q / (p + q)).otherwise(0.0)
    out = r.select(F.round(F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("step") / (steps - 1), 6).alias("threshold"), F.round(p, 6).alias("precision"), F.round(q, 6).alias("recall"), F.round(f, 6).alias("f1"))
    return out.orderBy(F.desc("f1"), "threshold").limit(1)


def best_accuracy(scored: DataFrame, steps: int = 200) -> DataFrame:
    """``threshold, accuracy`` of the most accurate of ``steps`` thresholds over the range of the scores (>= is positive), the smallest of several."""
    s = scored.where("score IS NOT NULL AND truth IS NOT NULL")
    span = s.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    step = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo")) * (steps - 1) + F.lit(1e-9))).otherwise(0)
    b = s.join(F.broadcast(span)).groupBy(step.cast("long").alias("step"), "lo", "hi").agg(F.count("*").alias("n"), F.count_if(F.col("truth")).alias("p"))
    w, every = Window.orderBy(F.desc("step")), Window.partitionBy()  # at most ``steps`` rows
    r = b.select("step", "lo", "hi", F.sum("n").over(w).alias("said"), F.sum("p").over(w).alias("tp"), F.sum("p").over(every).alias("pos"), F.sum("n").over(every).alias("n"))
    right = (F.col("tp") + F.col("n") - F.col("pos") - (F.col("said") - F.col("tp"))) / F.col("n")
    out = r.select(F.round(F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("step") / (steps - 1), 6).alias("threshold"), F.round(right, 6).alias("accuracy"))
    return out.orderBy(F.desc("accuracy"), "threshold").limit(1)


def correlations(df: DataFrame, x: str, y: str) -> DataFrame:
    """``n, pearson, spearman, mae``; ranks of ties are averaged; a constant column has no correlation."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))

    def ranked(c: str) -> DataFrame:
        n = rows.groupBy(c).agg(F.count("*").alias("k"))
        w = Window.orderBy(c).rowsBetween(Window.unboundedPreceding, -1)
        return n.select(c, (F.coalesce(F.sum("k").over(w), F.lit(0)) + (F.col("k") + 1) / 2).alias(f"r{c}"))

    both = rows.join(ranked("x"), "x").join(ranked("y"), "y")
    return both.agg(F.count("*").alias("n"), F.round(F.corr("x", "y"), 6).alias("pearson"), F.round(F.corr("rx", "ry"), 6).alias("spearman"), F.round(F.avg(F.abs(F.col("x") - F.col("y"))), 6).alias("mae"))


def v_measure(labels: DataFrame, truth: str, cluster: str) -> DataFrame:
    """``homogeneity, completeness, v`` of a clustering against classes."""
    c = labels.groupBy(F.col(truth).alias("t"), F.col(cluster).alias("c")).agg(F.count("*").cast("double").alias("n"))
    total = c.agg(F.sum("n").alias("every"))
    t = c.groupBy("t").agg(F.sum("n").alias("nt"))
    k = c.groupBy("c").agg(F.sum("n").alias("nc"))
    x = c.join(F.broadcast(total)).join(t, "t").join(k, "c")
    cond = x.agg(F.sum(-F.col("n") / F.col("every") * F.log(F.col("n") / F.col("nc"))).alias("htc"), F.sum(-F.col("n") / F.col("every") * F.log(F.col("n") / F.col("nt"))).alias("hct"))
    ht = t.join(total).agg(F.sum(-F.col("nt") / F.col("every") * F.log(F.col("nt") / F.col("every"))).alias("ht"))
    hc = k.join(total).agg(F.sum(-F.col("nc") / F.col("every") * F.log(F.col("nc") / F.col("every"))).alias("hc"))
    h = F.when(F.col("ht") > 1e-12, 1 - F.col("htc") / F.col("ht")).otherwise(1.0)
    m = F.when(F.col("hc") > 1e-12, 1 - F.col("hct") / F.col("hc")).otherwise(1.0)
    return cond.join(ht).join(hc).select(F.round(h, 6).alias("homogeneity"), F.round(m, 6).alias("completeness"), F.round(F.when(h + m > 0, 2 * h * m / (h + m)).otherwise(0.0), 6).alias("v"))
