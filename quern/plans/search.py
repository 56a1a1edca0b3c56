"""Retrieval and fusion queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text
from quern.functions.vectors import truncate
from quern.operators import retrieval, similarity
from quern.session import table

from .registry import register

ASKED = "id % 50 = 0"  #: the rows that searches ask for
TEXTS = ((0, "missing whitening matrix"), (1, "novelty score and NOT the ledger"), (2, "Archivkasten Zwischenspeicher"), (3, "postings list 42"), (4, "zzzz nothing here qqqq"))

# SQL fragments shared by the twins
UNIT = "CASE WHEN sqrt(list_sum(list_transform({v}, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) = 0 THEN list_transform({v}, lambda x: CAST(x AS DOUBLE)) ELSE list_transform({v}, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform({v}, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE))))) END"


def units(name: str = "u") -> str:
    return f"{name} AS (SELECT vec_id AS id, label, {UNIT.format(v='embedding')} AS u FROM embeddings)"


SCORES = f"""{units()},
scored AS (SELECT q.id AS qid, c.id, c.label, round(list_inner_product(q.u, c.u), 6) AS score FROM u q, u c WHERE q.id % 50 = 0)"""


def topk(source: str, k: int, extra: str = "") -> str:
    return f"SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM {source} {extra} QUALIFY rank <= {k}"


def vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def vector_queries(spark, d):
    return vectors(spark, d).where(ASKED).select(F.col("id").alias("qid"), F.col("embedding").alias("q"))


def docs(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), "lang", "source", "collection")


def text_queries(spark):
    return spark.createDataFrame(list(TEXTS), "qid int, query string")


def doc_queries(spark, d):
    """Texts of the asked documents; in hybrid searches a row's text goes with its vector."""
    return docs(spark, d).where(ASKED).where("content IS NOT NULL").select(F.col("id").alias("qid"), F.col("content").alias("query"))


@register(f"WITH {SCORES} {topk('scored', 10)}")
def vec_topk(spark, d):
    return retrieval.vector_topk(vectors(spark, d), vector_queries(spark, d))


@register(f"WITH {SCORES} {topk('scored', 10, 'WHERE label IN (1, 3)')}")
def vec_topk_filtered(spark, d):
    v = vectors(spark, d)
    return retrieval.vector_topk(v, vector_queries(spark, d), allowed=v.where("label IN (1, 3)"))


@register(f"WITH {units()}, scored AS (SELECT q.id AS qid, c.id, round(list_inner_product(q.u, c.u), 6) AS score FROM u q, u c WHERE q.id % 50 = 0 AND c.id <> q.id) {topk('scored', 5)}")
def vec_topk_batch(spark, d):
    """Queries are the rows whose id is divisible by 50, against all rows."""
    return retrieval.vector_topk(vectors(spark, d), vector_queries(spark, d), 5, own=False)


@register(f"WITH u AS (SELECT vec_id AS id, {UNIT.format(v='embedding[1:32]')} AS u FROM embeddings), scored AS (SELECT q.id AS qid, c.id, round(list_inner_product(q.u, c.u), 6) AS score FROM u q, u c WHERE q.id % 50 = 0) {topk('scored', 10)}")
def matryoshka_topk(spark, d):
    v = vectors(spark, d).select("id", truncate(F.col("embedding"), 32).alias("embedding"))
    return retrieval.vector_topk(v, v.where(ASKED).select(F.col("id").alias("qid"), F.col("embedding").alias("q")))


@register(f"WITH {units()}, e AS (SELECT unnest(u) AS x, generate_subscripts(u, 1) - 1 AS i FROM u) SELECT CAST(i AS INTEGER) AS i, round(avg(x), 6) AS x FROM e GROUP BY i")
def corpus_centroid(spark, d):
    return similarity.centroid(vectors(spark, d)).select(F.col("i").cast("int").alias("i"), F.round("x", 6).alias("x"))


_TOKENS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"
_QUERIES = "queries(qid, query) AS (VALUES " + ", ".join(f"({i}, '{q}')" for i, q in TEXTS) + ")"
BM25 = f"""{_QUERIES},
asked AS (SELECT DISTINCT qid, lower(t) AS term FROM (SELECT qid, unnest(regexp_extract_all(query, '[\\p{{L}}\\p{{N}}_]+')) AS t FROM queries) WHERE length(t) > 1 AND NOT regexp_full_match(t, '\\p{{N}}+')),
spoken AS (SELECT doc_id AS id, lang, {_TOKENS} AS w FROM documents WHERE text IS NOT NULL),
stats AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(w)) AS avgdl FROM spoken),
post AS (SELECT id, lang, len(w) AS dl, unnest(w) AS term FROM spoken),
tf AS (SELECT id, lang, dl, term, count(*) AS tf FROM post WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
df AS (SELECT term, CAST(count(*) AS DOUBLE) AS df FROM tf GROUP BY term),
scored AS (
  SELECT a.qid, t.id, t.lang, round(sum(greatest(ln((s.n - d.df + 0.5) / (d.df + 0.5)), 1e-6) * t.tf * 2.2 / (t.tf + 1.2 * (0.25 + 0.75 * t.dl / s.avgdl))), 6) AS score
  FROM tf t JOIN df d USING (term) JOIN asked a USING (term), stats s GROUP BY a.qid, t.id, t.lang)"""


@register(f"WITH {BM25} {topk('scored', 10)}")
def bm25_topk(spark, d):
    return retrieval.top(retrieval.bm25(docs(spark, d), text_queries(spark)), 10)


@register(f"WITH {BM25} {topk('scored', 10, chr(10) + '''WHERE lang = 'de' ''')}")
def bm25_topk_by_lang(spark, d):
    """Statistics stay global; the language filters the hits."""
    hits = retrieval.bm25(docs(spark, d), text_queries(spark)).join(docs(spark, d).where("lang = 'de'").select("id"), "id", "left_semi")
    return retrieval.top(hits, 10)


@register("SELECT doc_id AS id, 1.0 AS score FROM documents WHERE text ILIKE '%whitening matrix%'")
def grep_docs(spark, d):
    return retrieval.grep(docs(spark, d), "Whitening Matrix")


@register("SELECT doc_id AS id, 1.0 AS score FROM documents WHERE contains(lower(text), 'merge_')")
def grep_exact(spark, d):
    return retrieval.grep(docs(spark, d), "merge_", exact=True)


_BM25_DOCS = BM25[BM25.index("asked AS") :].replace("FROM queries)", "FROM (SELECT doc_id AS qid, text AS query FROM documents WHERE doc_id % 50 = 0 AND text IS NOT NULL))")
_BM25_DOCS = _BM25_DOCS.replace("SELECT DISTINCT qid, lower(t) AS term FROM (", "SELECT DISTINCT qid, unnest(regexp_extract_all(lower(t), '[\\p{L}\\p{N}]+')) AS term FROM (").replace("scored AS", "ftscored AS")
_HYBRID = f"""{units()}, {_BM25_DOCS},
vscored AS (SELECT q.id AS qid, c.id, round(list_inner_product(q.u, c.u), 6) AS score FROM u q, u c WHERE q.id % 50 = 0),
vlist AS ({topk('vscored', 50)}), flist AS ({topk('ftscored', 50)}),
lists AS (SELECT qid, id, rank FROM vlist UNION ALL SELECT qid, id, rank FROM flist),
fused AS (SELECT qid, id, round(sum(1.0 / (60 + rank)), 6) AS score FROM lists GROUP BY qid, id)"""


@register(f"WITH {_HYBRID} SELECT f.qid, f.id, f.score, f.rank, coalesce(d.text, '') AS content FROM ({topk('fused', 10)}) f LEFT JOIN documents d ON d.doc_id = f.id")
def hybrid_rrf(spark, d):
    return retrieval.hybrid(vectors(spark, d), docs(spark, d), vector_queries(spark, d), doc_queries(spark, d))


_LISTS = """lists AS (
  SELECT query_id AS qid, list_label, CAST(rank - min(rank) OVER (PARTITION BY query_id, list_label) + 1 AS INTEGER) AS rank, id
  FROM (SELECT query_id, lower(trim(list_label)) AS list_label, trim(id) AS id, min(rank) AS rank FROM search_results WHERE rank IS NOT NULL GROUP BY 1, 2, 3))"""


def result_lists(spark, d):
    s = table(spark, d, "search_results").where("rank IS NOT NULL")
    s = s.groupBy(F.col("query_id").alias("qid"), F.lower(F.trim("list_label")).alias("list_label"), F.trim("id").alias("id")).agg(F.min("rank").alias("rank"))
    first = s.groupBy("qid", "list_label").agg(F.min("rank").alias("first"))
    return s.join(first, ["qid", "list_label"]).select("qid", "list_label", (F.col("rank") - F.col("first") + 1).cast("int").alias("rank"), "id")


_RRF = "SELECT qid, id, round(sum(1.0 / (60 + rank)){bonus}, 6) AS score, min(rank) AS best{more} FROM lists WHERE id IS NOT NULL GROUP BY qid, id"


@register(f"WITH {_LISTS} " + _RRF.format(bonus=" + CASE WHEN min(rank) = 1 THEN 0.05 WHEN min(rank) <= 3 THEN 0.02 ELSE 0 END", more=", string_agg(list_label || ':' || rank, ' ' ORDER BY list_label, rank) AS traces"))
def multi_rrf_traced(spark, d):
    out = retrieval.rrf(result_lists(spark, d))
    return out.withColumn("traces", F.concat_ws(" ", F.transform("traces", lambda t: F.concat_ws(":", t["list_label"], t["rank"]))))


@register(f"WITH {_LISTS} " + _RRF.format(bonus="", more=""))
def rrf_no_bonus(spark, d):
    return retrieval.rrf(result_lists(spark, d), bonus=False).drop("traces")


_CONVEX = f"""{units()}, {_BM25_DOCS},
vscored AS (SELECT q.id AS qid, c.id, round(list_inner_product(q.u, c.u), 6) AS score FROM u q, u c WHERE q.id % 50 = 0),
vlist AS ({topk('vscored', 50)}), flist AS ({topk('ftscored', 50)}),
a AS (SELECT qid, id, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 0 END AS a FROM vlist WINDOW w AS (PARTITION BY qid)),
b AS (SELECT qid, id, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 0 END AS b FROM flist WINDOW w AS (PARTITION BY qid))"""


@register(f"WITH {_CONVEX} SELECT qid, id, round(0.3 * coalesce(a, 0) + 0.7 * coalesce(b, 0), 6) AS score FROM a FULL JOIN b USING (qid, id)")
def convex_fusion(spark, d):
    v = retrieval.vector_topk(vectors(spark, d), vector_queries(spark, d), 50).select("qid", "id", "score")
    t = retrieval.top(retrieval.bm25(docs(spark, d), doc_queries(spark, d)), 50).select("qid", "id", "score")
    return retrieval.convex(v, t, 0.3)


@register(f"WITH {BM25} SELECT source, id, score FROM (SELECT d.source, s.id, max(s.score) AS score FROM scored s JOIN documents d ON d.doc_id = s.id GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY source ORDER BY score DESC, id) = 1")
def dedup_by_source(spark, d):
    hits = retrieval.bm25(docs(spark, d), text_queries(spark)).groupBy("id").agg(F.max("score").alias("score"))
    return retrieval.first_by(hits.join(docs(spark, d).select("id", "source"), "id"), "source").select("source", "id", "score")


@register("SELECT qid, coalesce(max(score) FILTER (WHERE r = 1) >= 0.82 AND round(max(score) FILTER (WHERE r = 1) - max(score) FILTER (WHERE r = 2), 9) >= 0.12, false) AS strong FROM (SELECT query_id AS qid, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM (SELECT query_id, trim(id) AS id, max(score) AS score FROM search_results WHERE lower(trim(source)) = 'vector' AND score IS NOT NULL AND NOT isnan(score) AND id IS NOT NULL GROUP BY 1, 2)) GROUP BY qid")
def strong_signal(spark, d):
    s = table(spark, d, "search_results").where("lower(trim(source)) = 'vector' AND score IS NOT NULL AND NOT isnan(score) AND id IS NOT NULL")
    return retrieval.strong_signal(s.groupBy(F.col("query_id").alias("qid"), F.trim("id").alias("id")).agg(F.max("score").alias("score")))


_PRF = f"""WITH {SCORES}, hits AS ({topk('scored', 3)}),
m AS (SELECT qid, i, avg(x) AS x FROM (SELECT h.qid, generate_subscripts(u.u, 1) AS i, unnest(u.u) AS x FROM hits h JOIN u ON u.id = h.id) GROUP BY qid, i),
mean AS (SELECT qid, list(x ORDER BY i) AS m FROM m GROUP BY qid),
blend AS (SELECT mean.qid, list_transform(list_zip(u.u, m), lambda p: 0.9 * p[1] + 0.1 * p[2]) AS q FROM mean JOIN u ON u.id = mean.qid),
moved AS (SELECT qid, {UNIT.format(v='q')} AS q FROM blend),
again AS (SELECT moved.qid, u.id, round(list_inner_product(moved.q, u.u), 6) AS score FROM moved, u)"""


@register(f"{_PRF} {topk('again', 10)}")
def prf_topk(spark, d):
    v = vectors(spark, d)
    return retrieval.vector_topk(v, retrieval.feedback_queries(v, vector_queries(spark, d)))


@register()
def genericize_text(spark, d):
    """All texts and passages; tested against Python's own regular expressions (those of SQL have no Unicode word edges)."""
    both = table(spark, d, "documents").select(F.lit("documents").alias("kind"), F.col("doc_id").alias("id"), "text")
    both = both.unionByName(table(spark, d, "eval_items").select(F.lit("eval_items").alias("kind"), F.col("item_id").alias("id"), F.col("passage").alias("text")))
    return both.select("kind", "id", text.genericise(F.col("text")).alias("generic"))


@register("SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(" + _TOKENS + ") AS dl, unnest(" + _TOKENS + ") AS term FROM documents WHERE text IS NOT NULL) GROUP BY doc_id, term")
def inverted_index(spark, d):
    return retrieval.postings(docs(spark, d).where("content IS NOT NULL")).withColumnRenamed("id", "doc_id")


@register()
def bm25_stemmed(spark, d):
    """BM25 over Porter stems; the stems are tested against known pairs."""
    return retrieval.top(retrieval.bm25(docs(spark, d), text_queries(spark), text.stems), 10)


_WORDS = "words AS (SELECT qid, list_filter(regexp_extract_all(lower(query), '[\\p{L}\\p{N}_]+'), lambda t: length(t) > 1 AND NOT regexp_full_match(t, '\\p{N}+')) AS w FROM queries)"
_RERANK = f"""WITH {BM25}, {_WORDS}, hits AS ({topk('scored', 20)}),
new AS (SELECT h.*, CASE WHEN rank <= 5 THEN round(len(list_intersect(w.w, {_TOKENS})) / greatest(len(w.w), 1), 6) END AS new_score FROM hits h JOIN words w USING (qid) JOIN documents d ON d.doc_id = h.id)
SELECT qid, id, rank, new_score, row_number() OVER (PARTITION BY qid ORDER BY new_score DESC NULLS LAST, rank, id) AS new_rank FROM new"""


@register(_RERANK)
def rerank_head(spark, d):
    """The first five hits rescored by the share of query words they hold (a stand-in scorer), the tail unchanged."""
    hits = retrieval.top(retrieval.bm25(docs(spark, d), text_queries(spark)), 20)

    def scorer(head):
        words = text_queries(spark).select("qid", text.query_terms(F.lower("query")).alias("w"))
        both = retrieval.hydrate(head, docs(spark, d)).join(F.broadcast(words), "qid")
        held = F.size(F.array_intersect("w", text.tokens(F.col("content"))))
        return both.withColumn("new_score", F.round(held / F.greatest(F.size("w"), F.lit(1)), 6)).select("qid", "id", "score", "rank", "new_score")

    return retrieval.rerank(hits, scorer, 5).select("qid", "id", "rank", "new_score", "new_rank")
