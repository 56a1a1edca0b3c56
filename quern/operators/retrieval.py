"""Vector and full-text retrieval, rank fusion and re-ranking."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions.text import query_terms, tokens
from quern.functions.vectors import cosine, unit
from quern.session import spread

K1, B = 1.2, 0.75


QUERY_BLOCK = 8192  #: queries that one pass over the corpus answers; bounds what is collected and broadcast
ROWS = 512  #: rows of the corpus that are scored at once


def block_topk(corpus: DataFrame, queries: DataFrame, k: int, adjust: Callable | None = None, block: int = QUERY_BLOCK) -> DataFrame:
    """``qid, id, score, *others of corpus``: the ``k`` best rows of ``corpus`` (``id, embedding, ...``) for each of ``queries`` (``qid, q, ...``).

    Queries come in blocks of a bounded number; each block is one pass over the corpus, which scores
    whole Arrow batches by a matrix product and keeps ``k`` rows a query and task, so little is
    shuffled and no pair is formed.  ``adjust(scores, rows, queries)`` may change the scores (queries
    x rows); NaN leaves a pair out.  Scores are rounded to 6 digits and ties go to the smaller id;
    vectors of other lengths than a query's are not compared; a zero vector scores 0 everywhere.
    """
    others = [c for c in corpus.columns if c not in ("id", "embedding")]
    fields = {f.name: f.dataType.simpleString() for f in corpus.schema}
    schema = ", ".join([f"qid {queries.schema['qid'].dataType.simpleString()}", f"id {fields['id']}", "score double", *[f"`{c}` {fields[c]}" for c in others]])
    rows = corpus.where("embedding IS NOT NULL AND id IS NOT NULL")
    asked = queries.where("q IS NOT NULL AND qid IS NOT NULL")
    blocks = max(1, -(-asked.count() // block))
    out = None
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b).toPandas()
        got = rows.mapInPandas(_best_of(part, k, adjust, others), schema)
        out = got if out is None else out.unionByName(got)
    return out


def _units(column) -> np.ndarray:
    x = np.array([np.asarray(v, dtype=float) for v in column], dtype=float).reshape(len(column), -1)
    n = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(n == 0, 1.0, n)


def _best_of(part: pd.DataFrame, k: int, adjust: Callable | None, others: list[str]) -> Callable:
    by_size = [(d, g.reset_index(drop=True)) for d, g in part.groupby(part["q"].map(len))] if len(part) else []
    sides = [(d, g.drop(columns="q"), _units(g["q"])) for d, g in by_size if d]

    def better(best: pd.DataFrame | None, new: pd.DataFrame) -> pd.DataFrame:
        both = new if best is None else pd.concat([best, new])
        both = both.sort_values(["_q", "score", "id"], ascending=[True, False, True], kind="stable")
        return both[both.groupby("_q").cumcount() < k]

    def run(batches):
        best: list = [None] * len(sides)
        floor = [np.full(len(g), -np.inf) for _, g, _ in sides]
        for batch in batches:
            size = batch["embedding"].map(len)
            for n, (d, g, q) in enumerate(sides):
                same = batch[size == d]
                for at in range(0, len(same), ROWS):
                    chunk = same.iloc[at : at + ROWS]
                    s = q @ _units(chunk["embedding"]).T
                    s = np.round(s, 6) if adjust is None else np.round(adjust(np.round(s, 6), chunk, g), 6)
                    s = np.where(np.isnan(s), -np.inf, s)
                    least = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), -np.inf)
                    i, j = np.nonzero((s >= np.maximum(least, floor[n])[:, None]) & (s > -np.inf))
                    if not len(i):
                        continue
                    new = chunk[["id", *others]].iloc[j].assign(_q=i, score=s[i, j])
                    best[n] = better(best[n], new)
                    full = best[n].groupby("_q")["score"].agg(["size", "min"])
                    full = full[full["size"] >= k]
                    floor[n][full.index] = full["min"]
        for (_, g, _), got in zip(sides, best):
            if got is not None:
                yield got.assign(qid=g["qid"].to_numpy()[got["_q"]])[["qid", "id", "score", *others]]

    return run


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int = 10, allowed: DataFrame | None = None, own: bool = True) -> DataFrame:
    """``qid, id, score, rank``: the ``k`` most similar of ``vectors`` (``id, embedding``) for each of ``queries`` (``qid, q``).

    ``allowed`` (``id``) is applied before ranking; ``own=False`` leaves out the row that is the query
    itself (``id = qid``).  See ``block_topk``.
    """
    if allowed is not None:
        vectors = vectors.join(allowed.select("id").distinct(), "id", "left_semi")
    other = None if own else lambda s, rows, asked: np.where(asked["qid"].to_numpy()[:, None] == rows["id"].to_numpy()[None, :], np.nan, s)
    return top(block_topk(vectors.select("id", "embedding"), queries.select("qid", "q"), k, other), k)


def top(scored: DataFrame, k: int, score: str = "score") -> DataFrame:
    """Best ``k`` rows a ``qid`` by score, ties to the smaller id, with their ``rank`` from 1."""
    order = Window.partitionBy("qid").orderBy(F.desc(score), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def postings(docs: DataFrame, stem: Callable[[Column], Column] | None = None) -> DataFrame:
    """``id, term, tf, dl``: the inverted index of ``docs`` (``id, content``)."""
    words = tokens(F.col("content"))
    t = docs.select("id", (stem(words) if stem else words).alias("w"))
    return t.select("id", F.size("w").alias("dl"), F.explode("w").alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def bm25(docs: DataFrame, queries: DataFrame, stem: Callable[[Column], Column] | None = None) -> DataFrame:
    """``qid, id, score`` of every document that holds a term of the query (``qid, query``); terms are alternatives.

    Corpus statistics are global: number of texts that aren't null, mean length over them, document
    frequencies.  A term whose weight isn't positive counts 1e-6.  A query without usable terms finds
    nothing.
    """
    words = F.flatten(F.transform(query_terms(F.col("query")), lambda w: tokens(w)))
    asked = queries.select("qid", F.explode(F.array_distinct(stem(words) if stem else words)).alias("term"))
    spoken = spread(docs.where("content IS NOT NULL").select("id", "content")).select("id", tokens(F.col("content")).alias("w"))
    stats = spoken.agg(F.count("*").cast("double").alias("n"), F.avg(F.size("w")).alias("avgdl"))
    terms = spoken.select("id", F.size("w").alias("dl"), F.explode(stem(F.col("w")) if stem else "w").alias("term"))
    # only postings of asked terms leave the scan; they are spread by id once, for all that follows
    hit = terms.join(asked.select("term").distinct(), "term", "left_semi").repartition("id").groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    df = hit.groupBy("term").agg(F.count("*").cast("double").alias("df"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.greatest(idf, F.lit(1e-6)) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    weighed = hit.join(df, "term").join(F.broadcast(stats)).select("term", "id", part.alias("part"))
    return weighed.join(asked, "term").groupBy("qid", "id").agg(F.round(F.sum("part"), 6).alias("score"))


def grep(docs: DataFrame, pattern: str, limit: int | None = None, exact: bool = False) -> DataFrame:
    """``id, score``: texts containing the pattern, without case; ``%`` and ``_`` are wildcards unless ``exact``.

    A blank pattern finds nothing; every hit scores 1.
    """
    if not pattern.strip():
        return docs.select("id", F.lit(1.0).alias("score")).limit(0)
    if exact:
        hit = F.contains(F.lower("content"), F.lit(pattern.lower()))
    else:
        hit = F.col("content").ilike(f"%{pattern}%")
    found = docs.where(hit).select("id", F.lit(1.0).alias("score"))
    return found if limit is None else found.orderBy("id").limit(limit)


def rrf(lists: DataFrame, k: int = 60, bonus: bool = True, ids: str = "id") -> DataFrame:
    """``qid, id, score, best, traces``: reciprocal rank fusion of ``qid, list_label, rank, id`` (ranks from 1).

    Each list adds 1/(k + rank); with ``bonus`` a best rank of 1 adds 0.05 and one up to 3 adds 0.02.
    Rows without id are skipped.  ``traces`` keeps each list's rank and contribution.
    """
    part = F.lit(1.0) / (F.lit(k) + F.col("rank"))
    rows = lists.where(F.col(ids).isNotNull()).select("qid", F.col(ids).alias("id"), F.struct("list_label", "rank", part.alias("contribution")).alias("t"))
    extra = F.when(F.col("best") == 1, 0.05).when(F.col("best") <= 3, 0.02).otherwise(0.0) if bonus else F.lit(0.0)
    fused = rows.groupBy("qid", "id").agg(F.sum("t.contribution").alias("s"), F.min("t.rank").alias("best"), F.sort_array(F.collect_list("t")).alias("traces"))
    return fused.select("qid", "id", F.round(F.col("s") + extra, 6).alias("score"), "best", "traces")


def hybrid(vectors: DataFrame, docs: DataFrame, vector_queries: DataFrame, text_queries: DataFrame, limit: int = 10, factor: int = 5, allowed: DataFrame | None = None) -> DataFrame:
    """``qid, id, score, rank, content``: vector and BM25 lists fused by reciprocal rank without bonus.

    ``factor * limit`` hits are fetched from each side.  ``allowed`` filters the vectors before their
    ranking but the text hits after theirs; contents are looked up last, missing ones are empty.
    """
    v = vector_topk(vectors, vector_queries, factor * limit, allowed).select("qid", F.lit("vec").alias("list_label"), "rank", "id")
    t = top(bm25(docs, text_queries), factor * limit)
    if allowed is not None:
        t = t.join(allowed.select("id").distinct(), "id", "left_semi")
    t = t.select("qid", F.lit("fts").alias("list_label"), F.row_number().over(Window.partitionBy("qid").orderBy("rank")).alias("rank"), "id")
    fused = top(rrf(v.unionByName(t), bonus=False), limit)
    return hydrate(fused.select("qid", "id", "score", "rank"), docs)


def hydrate(ranked: DataFrame, docs: DataFrame, keep_missing: bool = True) -> DataFrame:
    """Adds ``content`` to ranked ids; missing ids get an empty one or drop out."""
    out = ranked.join(docs.select("id", "content"), "id", "left" if keep_missing else "inner")
    return out.withColumn("content", F.coalesce("content", F.lit("")))


def first_by(scored: DataFrame, group: str) -> DataFrame:
    """Best row a group: greatest score, then smallest id."""
    order = Window.partitionBy(group).orderBy(F.desc("score"), "id")
    return scored.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def convex(a: DataFrame, b: DataFrame, alpha: float) -> DataFrame:
    """``qid, id, score``: alpha * a + (1 - alpha) * b after min-max scaling within each query; a constant list scales to 0."""

    def scaled(df: DataFrame, name: str) -> DataFrame:
        w = Window.partitionBy("qid")
        low, high = F.min("score").over(w), F.max("score").over(w)
        return df.select("qid", "id", F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(0.0).alias(name))

    both = scaled(a, "a").join(scaled(b, "b"), ["qid", "id"], "full_outer")
    return both.select("qid", "id", F.round(alpha * F.coalesce("a", F.lit(0.0)) + (1 - alpha) * F.coalesce("b", F.lit(0.0)), 6).alias("score"))


def strong_signal(ranked: DataFrame, least: float = 0.82, gap: float = 0.12) -> DataFrame:
    """``qid, strong``: the best score is high and clear of the second; one score alone is never strong."""
    two = top(ranked, 2)
    best, second = F.max(F.when(F.col("rank") == 1, F.col("score"))), F.max(F.when(F.col("rank") == 2, F.col("score")))
    return two.groupBy("qid").agg(F.coalesce((best >= least) & (F.round(best - second, 9) >= gap), F.lit(False)).alias("strong"))


def feedback_queries(vectors: DataFrame, queries: DataFrame, n: int = 3, alpha: float = 0.9) -> DataFrame:
    """``qid, q``: queries moved towards the mean of their ``n`` best hits (Rocchio)."""
    hits = vector_topk(vectors, queries, n).join(vectors.select("id", unit(F.col("embedding")).alias("u")), "id")
    parts = hits.select("qid", F.posexplode("u").alias("i", "x")).groupBy("qid", "i").agg(F.avg("x").alias("m"))
    mean = parts.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("m"))
    return queries.join(mean, "qid").select("qid", unit(F.zip_with(unit(F.col("q")), "m", lambda a, b: alpha * a + (1 - alpha) * b)).alias("q"))


def rerank(ranked: DataFrame, scorer: Callable[[DataFrame], DataFrame], top_n: int) -> DataFrame:
    """Rescores the first ``top_n`` of each query with ``scorer`` (adds ``new_score``); the tail follows unchanged.

    The frame is split before scoring, so the costly scorer sees the head only.
    """
    head = scorer(ranked.where(F.col("rank") <= top_n))
    tail = ranked.where(F.col("rank") > top_n).withColumn("new_score", F.lit(None).cast("double"))
    both = head.unionByName(tail, allowMissingColumns=True)
    order = Window.partitionBy("qid").orderBy(F.desc_nulls_last("new_score"), "rank", "id")
    return both.withColumn("new_rank", F.row_number().over(order))


def expansion_lines(text: Column) -> Column:
    """Typed search variants of a model's answer: lines ``lex: ...``, ``vec: ...`` or ``hyde: ...`` as structs (type, query)."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda s: s.rlike(r"(?i)^\s*(?:\d+\.\s*)?(lex|vec|hyde):\s*\S"))
    pattern = r"(?i)^\s*(?:\d+\.\s*)?(lex|vec|hyde):\s*(.+?)\s*$"
    return F.transform(lines, lambda s: F.struct(F.lower(F.regexp_extract(s, pattern, 1)).alias("type"), F.regexp_extract(s, pattern, 2).alias("query")))


def cosine_of(a: str, b: str) -> Column:
    return cosine(F.col(a), F.col(b))


def expanded_hybrid(vectors: DataFrame, docs: DataFrame, originals: DataFrame, expansions: DataFrame, limit: int = 10, factor: int = 5) -> DataFrame:
    """``qid, id, score, rank, traces``: the original query and its variants, fused with traces and bonus.

    originals   ``qid, query, q`` (text and vector); each gives a vector and a text list
    expansions  ``qid, seq, type, query, q``: ``lex`` variants search the text, ``vec`` and ``hyde`` the vectors
    """
    variant = F.concat_ws("#", F.col("qid").cast("string"), F.col("seq").cast("string"))
    every = originals.select("qid", F.lit(0).alias("seq"), F.lit("both").alias("type"), "query", "q").unionByName(expansions.select("qid", "seq", "type", "query", "q"))
    every = every.withColumn("vid", variant)
    label = F.when(F.col("type") == "lex", F.concat(F.lit("fts:"), F.substring("query", 1, 30))).otherwise(F.concat(F.lit("vec:"), "type", F.lit(":"), F.substring("query", 1, 25)))
    names = every.select("vid", F.col("qid").alias("owner"), "type", label.alias("label"))
    v = vector_topk(vectors, every.where("type <> 'lex'").select(F.col("vid").alias("qid"), "q"), factor * limit)
    t = top(bm25(docs, every.where("type IN ('both', 'lex')").select(F.col("vid").alias("qid"), "query")), factor * limit)
    lists = v.select("qid", "id", "rank", F.lit("vec").alias("side")).unionByName(t.select("qid", "id", "rank", F.lit("fts").alias("side")))
    named = lists.join(F.broadcast(names), lists.qid == names.vid)
    shown = F.when(F.col("type") == "both", F.concat(F.col("side"), F.lit(":original"))).otherwise(F.col("label"))
    return top(rrf(named.select(F.col("owner").alias("qid"), shown.alias("list_label"), "rank", "id")), limit)
