"""Incremental upkeep of indexes and caches: appends, replacements, upserts, deletions, expiry.

Tables are never changed in place: each function gives the new state as a DataFrame, which the caller
writes.  Anti joins on keys keep what is untouched; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.vectors import unit
from quern.operators.retrieval import postings

CLAIM = "claim:"
TTL = 30 * 86400  #: seconds that a payload stays fresh unless said otherwise


def append_vectors(index: DataFrame | None, new: DataFrame, dim: int) -> DataFrame:
    """``id, u``: the index with the unit vectors of ``new`` (``id, embedding``) added.

    A vector without id or of another length than ``dim`` is an error, as is one id more or less
    than vectors; repeated ids stay, as every append is kept.  A zero vector stays zero.
    """
    bad = new.where(F.col("id").isNull() | F.col("embedding").isNull() | (F.size("embedding") != dim))
    if not bad.isEmpty():
        raise ValueError(f"each id needs one vector of length {dim}")
    added = new.select("id", unit(F.col("embedding")).alias("u"))
    return added if index is None else index.unionByName(added)


def replace_chunks(chunks: DataFrame, changed: DataFrame, fresh: DataFrame) -> DataFrame:
    """Chunks without those of the ``changed`` documents (``doc_path``), and the ``fresh`` ones; a document without any loses its own."""
    gone = changed.select("doc_path").distinct()
    return chunks.join(gone, "doc_path", "left_anti").unionByName(fresh.join(gone, "doc_path", "left_semi"), allowMissingColumns=True)


def upsert_claims(documents: DataFrame, chunks: DataFrame, claims: DataFrame, now: float, collection: str = "claims") -> tuple[DataFrame, DataFrame]:
    """Documents (``path, mtime, collection, metadata, indexed_at``) and chunks with the claims (``id, content, metadata``) under ``claim:{id}``.

    Adding a claim again replaces it; of a claim given twice one row, the greatest by content, counts.
    """
    one = claims.where("id IS NOT NULL").groupBy("id").agg(F.max(F.struct("content", "metadata")).alias("c"))
    rows = one.select(F.concat(F.lit(CLAIM), F.col("id").cast("string")).alias("doc_path"), "c.content", F.coalesce("c.metadata", F.lit("{}")).alias("metadata"), F.lit(collection).alias("collection"))
    doc = rows.select(F.col("doc_path").alias("path"), F.lit(now).alias("mtime"), "collection", "metadata", F.lit(now).alias("indexed_at"))
    docs = documents.join(rows.select(F.col("doc_path").alias("path")), "path", "left_anti").unionByName(doc, allowMissingColumns=True)
    return docs, replace_chunks(chunks, rows, rows)


def update_postings(index: DataFrame, changed: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """Postings after ``changed`` documents (``id, content``) were added again and ``deleted`` ones (``id``) left; no stale posting stays."""
    gone = changed.select("id") if deleted is None else changed.select("id").unionByName(deleted.select("id"))
    left = index.join(gone.distinct(), "id", "left_anti")
    return left.unionByName(postings(changed.where("content IS NOT NULL")))


def put_many(cache: DataFrame, items: DataFrame, source: str, now: int, ttl: int | None = None) -> DataFrame:
    """Payload cache (``key, source, payload, fetched_at, ttl_seconds``) after storing ``items`` (``key, payload``); an entry is replaced.

    A source must be named; of a key given twice the greatest payload counts; other sources stay.
    """
    if not source:
        raise ValueError("a payload needs a source")
    new = items.where("key IS NOT NULL").groupBy("key").agg(F.max("payload").alias("payload"))
    new = new.select("key", F.lit(source).alias("source"), "payload", F.lit(now).cast("long").alias("fetched_at"), F.lit(TTL if ttl is None else ttl).cast("long").alias("ttl_seconds"))
    return cache.join(new.select("key", "source"), ["key", "source"], "left_anti").unionByName(new)


def is_fresh(now: int) -> Column:
    return F.lit(now) - F.col("fetched_at") <= F.col("ttl_seconds")


def get_many(cache: DataFrame, keys: DataFrame, source: str, now: int, allow_stale: bool = False) -> DataFrame:
    """``key, payload`` of the asked keys that are stored, and fresh unless stale entries are allowed."""
    own = cache.where(F.col("source") == source)
    own = own if allow_stale else own.where(is_fresh(now))
    return own.join(keys.select("key").distinct(), "key", "left_semi").select("key", "payload")


def delete_keys(cache: DataFrame, keys: DataFrame, source: str) -> DataFrame:
    return cache.join(keys.select("key", F.lit(source).alias("source")).distinct(), ["key", "source"], "left_anti")


def clear_source(cache: DataFrame, source: str) -> DataFrame:
    return cache.where(~F.col("source").eqNullSafe(F.lit(source)))


def invalidate_before(cache: DataFrame, source: str, cutoff: int) -> tuple[DataFrame, DataFrame]:
    """The cache without the source's entries fetched before ``cutoff``, and one row ``removed``."""
    old = (F.col("source") == source) & (F.col("fetched_at") < cutoff)
    return cache.where(~F.coalesce(old, F.lit(False))), cache.agg(F.count_if(old).alias("removed"))


def cache_stats(cache: DataFrame, now: int) -> DataFrame:
    """``source, total, fresh, expired``."""
    n = F.count_if(is_fresh(now))
    return cache.groupBy("source").agg(F.count("*").alias("total"), n.alias("fresh"), (F.count("*") - n).alias("expired"))


def put_embeddings(cache: DataFrame, new: DataFrame, model: str, now: float) -> DataFrame:
    """Embedding cache (``text_hash, model_name, embedding, created_at``) with ``new`` (``text_hash, embedding``) of one model; an entry is replaced.

    Of a hash given twice one row counts, the greatest by its vector.
    """
    one = new.where("text_hash IS NOT NULL AND embedding IS NOT NULL").groupBy("text_hash").agg(F.max("embedding").alias("embedding"))
    one = one.select("text_hash", F.lit(model).alias("model_name"), "embedding", F.lit(now).cast("double").alias("created_at"))
    return cache.join(one.select("text_hash", "model_name"), ["text_hash", "model_name"], "left_anti").select(*one.columns).unionByName(one)


def clear_model(cache: DataFrame, model: str | None = None) -> DataFrame:
    """The cache without one model's entries, or empty."""
    return cache.limit(0) if model is None else cache.where(~F.col("model_name").eqNullSafe(F.lit(model)))


def model_counts(cache: DataFrame) -> DataFrame:
    return cache.groupBy("model_name").agg(F.count("*").alias("entries"))


def beliefs_to_json(beliefs: DataFrame, by: str = "g") -> DataFrame:
    """``by, state``: the beliefs of a map (``n, belief, asked``) as one JSON text, nodes in order."""
    rows = F.array_sort(F.collect_list(F.struct("n", "belief", "asked")))
    return beliefs.groupBy(by).agg(F.to_json(rows).alias("state"))


def beliefs_from_json(states: DataFrame, by: str = "g") -> DataFrame:
    """The rows that ``beliefs_to_json`` packed; a text that isn't such a state gives none."""
    rows = F.from_json("state", "array<struct<n: string, belief: double, asked: boolean>>")
    return states.select(by, F.inline(rows))


def parse_payload(payload: Column, lang: str = "en") -> Column:
    """An entity's JSON as ``qid, label, aliases, description, claims`` (property, ord, rank, datatype, value); null if it isn't one.

    Values are ids of entities, times or plain texts; labels fall back to any language.
    """
    kind = "struct<id: string, labels: map<string, struct<value: string>>, aliases: map<string, array<struct<value: string>>>, descriptions: map<string, struct<value: string>>, claims: map<string, array<struct<rank: string, mainsnak: struct<datatype: string, datavalue: struct<value: string>>>>>>"
    p = F.from_json(payload, kind)
    text = lambda m: F.coalesce(m[lang]["value"], F.map_values(m)[0]["value"])
    value = lambda v: F.coalesce(F.get_json_object(v, "$.id"), F.get_json_object(v, "$.time"), v)
    claims = F.flatten(
        F.transform(
            F.array_sort(F.map_entries(F.coalesce(p["claims"], F.create_map().cast("map<string, array<struct<rank: string, mainsnak: struct<datatype: string, datavalue: struct<value: string>>>>>")))),
            lambda e: F.transform(e["value"], lambda s, i: F.struct(e["key"].alias("property"), i.alias("ord"), s["rank"].alias("rank"), s["mainsnak"]["datatype"].alias("datatype"), value(s["mainsnak"]["datavalue"]["value"]).alias("value"))),
        )
    )
    made = F.struct(p["id"].alias("qid"), text(p["labels"]).alias("label"), F.transform(F.coalesce(p["aliases"][lang], F.array().cast("array<struct<value: string>>")), lambda a: a["value"]).alias("aliases"), text(p["descriptions"]).alias("description"), claims.alias("claims"))
    return F.when(p["id"].isNotNull(), made)
