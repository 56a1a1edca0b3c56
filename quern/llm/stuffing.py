"""Keyword-stuffed and link-list pages: robust Mahalanobis distance of text features per language.

1. Function words are learned: the words that a large part of a language's documents hold.
2. Every whole text is cut into words, links and tags, and the features (diversity, entropy,
   repetition, function words, density of links and of tags) are computed on whole
   Arrow batches of encoded words, without a loop over texts or words.
3. Per language the centre of each feature is its median, its scale the median absolute deviation,
   and the scatter that of the winsorised robust scores; a language with few documents leans on the
   statistics of all.
4. A page is flagged when its Mahalanobis distance lies far beyond the distances of its language
   (``FAR`` times their upper quartile) and its deviation points in a spam-directed direction: all
   features of the direction deviate to its side by ``DIRECTED`` robust units and more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.keys import key as lower_key
from quern.session import cut, spread

#: Features, and the side of a spam-directed deviation.
SPAM = {"diversity": -1, "entropy": -1, "repeat": 1, "function": -1, "links": 1, "tags": 1}
FEATURES = tuple(SPAM)
#: Spam-directed directions: the features that deviate together.
DIRECTIONS = {"keywords": ("diversity", "entropy", "repeat"), "links": ("links", "function"), "tags": ("tags", "function")}
COMMON = 0.25  #: share of a language's documents that hold a function word; so at most 1 / COMMON times a document's words are kept
WINDOW = 40  #: words over which diversity is averaged
TOP = 8  #: words whose repetition counts
FLOOR = 0.05  #: least scale of a feature: a feature that never varies must not decide alone
WINSOR = 6.0  #: robust scores are cut there for the scatter
DIRECTED = 3.0  #: robust units by which each feature of a direction deviates at least
FAR = 3.25  #: distance that flags, in upper quartiles of the language's distances
LEAST = 50  #: documents of a language with statistics of its own
SHRINK = 200  #: documents at which a language weighs as much as the whole corpus

_LINK = r"(?:\b[a-z][a-z0-9+.-]*://|\bwww\.)[^\s<>()\[\]\"'|,]+|(?:[\p{L}\p{N}-]+\.)+\p{L}{2,}/[^\s<>()\[\]\"'|,]*"
_MARKUP = r"<[^<>]*>"
_TAG = r"(?m)(?:^|[^\p{L}\p{N}_&#])#\p{L}|\b\p{Lu}{2,}-?\p{N}{2,}\b|(?i:^\s*(?:tags?|keywords?|labels?)\s*:)"
_NO_WORD = r"[^\p{L}\p{M}]+"


def _lists(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Non-empty strings of a list column, one row after another, and where each row's start."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, offsets = column.flatten(), np.asarray(column.offsets)
    kept = pc.greater(pc.binary_length(flat), 0)
    before = np.concatenate([[0], np.cumsum(kept.to_numpy(zero_copy_only=False))])
    return flat.filter(kept), before[offsets - offsets[0]]


def bare(text: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Lower-cased texts without links, and also without mark-up."""
    linkless = pc.replace_substring_regex(pc.utf8_lower(text), _LINK, "\u0001")
    return linkless, pc.replace_substring_regex(linkless, _MARKUP, " ")


def words_of(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of each text (letter runs, lower case), and where each text's start."""
    return _lists(pc.split_pattern_regex(bare(text)[1], _NO_WORD))


def counts_of(text: pa.Array) -> dict[str, np.ndarray]:
    """Sizes of each text's links, tags and signs."""
    linkless, _ = bare(text)
    n_links = pc.subtract(pc.count_substring(linkless, "\u0001"), pc.count_substring(text, "\u0001"))
    out = {
        "n_links": n_links,
        "link_chars": pc.add(pc.subtract(pc.utf8_length(text), pc.utf8_length(linkless)), n_links),
        "n_tags": pc.count_substring_regex(text, _TAG),
        "signs": pc.utf8_length(pc.replace_substring_regex(text, r"\s+", "")),
    }
    return {k: v.to_numpy(zero_copy_only=False).astype(np.int64) for k, v in out.items()}


def function_words(named: DataFrame, common: float = COMMON) -> dict[str, frozenset[str]]:
    """Words held by at least the share ``common`` of a language's documents; counted over all documents.

    A document of w words adds at most w to the sum of document frequencies, so a language keeps at
    most (mean words of a document) / ``common`` words, whatever the size of the corpus.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            flat, start = words_of(b.column("t"))
            coded, langs = flat.dictionary_encode(), b.column("g").dictionary_encode()
            v = max(1, len(coded.dictionary))
            doc = np.repeat(np.arange(b.num_rows), np.diff(start))
            held = np.unique(doc * v + coded.indices.to_numpy(zero_copy_only=False))
            lang = langs.indices.to_numpy(zero_copy_only=False)
            pair, df = np.unique(lang[held // v].astype(np.int64) * v + held % v, return_counts=True)
            n = np.bincount(lang, minlength=len(langs.dictionary))
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([langs.dictionary.take(pa.array(pair // v)), langs.dictionary]), pa.concat_arrays([coded.dictionary.take(pa.array(pair % v)), pa.nulls(len(n), pa.string())]), pa.array(np.concatenate([df, n]))],
                names=["g", "w", "df"],
            )

    counted = named.select("g", "t").mapInArrow(run, "g string, w string, df long").groupBy("g", "w").agg(F.sum("df").alias("df"))
    counted = cut(counted)
    size = counted.where("w IS NULL").select("g", F.col("df").alias("n"))
    kept = counted.join(size, "g").where(F.col("w").isNull() | (F.col("df") >= F.greatest(F.lit(2.0), common * F.col("n"))))
    words: dict[str, set[str]] = {}
    for r in kept.select("g", "w").collect():
        words.setdefault(r["g"], set()).update([] if r["w"] is None else [r["w"]])
    return {g: frozenset(w) for g, w in words.items()}


def features(codes: np.ndarray, start: np.ndarray, common: np.ndarray, numbers: dict[str, np.ndarray]) -> np.ndarray:
    """Rows of ``FEATURES``, one a document.

    codes    number of each word, documents one after another; document i holds start[i]:start[i + 1]
    common   languages x word numbers: is it a function word there?
    numbers  the sizes of ``counts_of``
    """
    docs = len(start) - 1
    n = np.diff(start)
    doc = np.repeat(np.arange(docs), n)
    hits = np.stack([np.bincount(doc, weights=c[codes], minlength=docs) for c in common]) if len(common) else np.zeros((1, docs))
    function = hits.max(axis=0) / np.maximum(n, 1)
    c, d, m = codes.astype(np.int64), doc, n
    at = np.arange(len(c)) - np.asarray(start)[d]
    # diversity: a word counts in each window that holds it and not its last occurrence before
    pair = d * (int(codes.max()) + 1 if len(codes) else 1) + c
    order = np.argsort(pair, kind="stable")
    before = np.full(len(c), -1, np.int64)
    same = pair[order][1:] == pair[order][:-1]
    before[order[1:][same]] = at[order[:-1][same]]
    wide = np.minimum(WINDOW, m)
    last_start = (m - wide)[d]
    windows = np.minimum(at, last_start) - np.maximum(before + 1, np.maximum(at - wide[d] + 1, 0)) + 1
    total = np.bincount(d, weights=np.maximum(windows, 0), minlength=docs)
    enough = m >= 4
    diversity = np.where(enough, total / np.maximum(1, (m - wide + 1) * wide), 1.0)
    # entropy and repetition from the counts of each document's words
    values, counts = np.unique(pair, return_counts=True)
    owner = d[order][np.concatenate([[0], np.cumsum(counts)])[:-1]] if len(values) else np.zeros(0, int)
    plogp = np.bincount(owner, weights=counts * np.log2(np.maximum(counts, 1)), minlength=docs)
    size = np.maximum(m, 2)
    entropy = np.where(enough, (np.log2(size) - plogp / size) / np.log2(size), 1.0)
    rank = np.lexsort((-counts, owner))
    place = np.arange(len(rank)) - np.searchsorted(owner[rank], owner[rank])
    top = (place < TOP) & (counts[rank] > 2)
    repeat = np.where(enough, np.bincount(owner[rank][top], weights=counts[rank][top], minlength=docs) / np.maximum(m, 1), 0.0)
    units = np.maximum(1, n + 4 * numbers["n_links"])
    parts = {
        "diversity": diversity, "entropy": entropy, "repeat": repeat, "function": function,
        "links": np.minimum(1.0, numbers["link_chars"] / np.maximum(1, numbers["signs"])),
        "tags": np.minimum(1.0, 2 * numbers["n_tags"] / units),
    }
    return np.stack([parts[f] for f in FEATURES], axis=1)


def extract(named: DataFrame, words: dict[str, frozenset[str]]) -> DataFrame:
    """``key, lang, <features>`` of every text (``k, g, t``); one pass, no shuffle."""
    kind = named.schema["k"].dataType.simpleString()
    schema = f"key {kind}, lang string, " + ", ".join(f"{f} double" for f in FEATURES)
    lists = list(words.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            text = b.column("t")
            flat, start = words_of(text)
            coded = flat.dictionary_encode()
            known = coded.dictionary.to_pylist()
            common = np.array([[w in fw for w in known] for fw in lists], dtype=bool).reshape(len(lists), len(known))
            x = features(coded.indices.to_numpy(zero_copy_only=False), start, common, counts_of(text))
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("g"), *[pa.array(x[:, i]) for i in range(len(FEATURES))]], names=["key", "lang", *FEATURES])

    return named.select("k", "g", "t").mapInArrow(run, schema)


def _shrunk(n: dict, values: dict) -> dict:
    """Each language's value, drawn towards the corpus's (under None) by the number of its documents."""
    return {g: v if g is None else (v * n[g] + values[None] * SHRINK) / (n[g] + SHRINK) for g, v in values.items()}


def _quantiles(df: DataFrame, names: tuple[str, ...], share: float = 0.5) -> tuple[dict, dict]:
    """Number of documents and quantiles of all and of each language of at least ``LEAST`` documents."""
    columns = [F.count("*").alias("n"), *[F.percentile_approx(f, share, 1000).alias(f) for f in names]]
    rows = [(r["lang"], r) for r in df.groupBy("lang").agg(*columns).where(F.col("n") >= LEAST).collect()] + [(None, df.agg(*columns).first())]
    return {g: r["n"] for g, r in rows}, {g: np.array([r[f] for f in names], dtype=float) for g, r in rows}


def _robust(batch: pd.DataFrame, centre: dict, scale: dict) -> Iterator[tuple[pd.DataFrame, str | None, np.ndarray]]:
    """Robust scores of a batch by language; a language without own statistics takes the corpus's."""
    for lang, part in batch.groupby("lang"):
        g = lang if lang in centre else None
        yield part, g, (part[list(FEATURES)].to_numpy(dtype=float) - centre[g]) / scale[g]


def judged(feats: DataFrame) -> tuple[DataFrame, dict]:
    """``key, lang, direction, deviation, distance`` of every page, and the distance that flags in each language.

    ``direction`` is the spam-directed direction of the greatest ``deviation``, which is the least
    of its features' deviations to that side.  Only records a language reach the driver.
    """
    kind = feats.schema["key"].dataType.simpleString()
    n, medians = _quantiles(feats, FEATURES)
    centre = _shrunk(n, medians)
    names, size = list(FEATURES), len(FEATURES)
    schema = f"key {kind}, lang string, " + ", ".join(f"{f} double" for f in FEATURES)
    one = {g: np.ones(size) for g in centre}

    def away(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part, _, z in _robust(b, centre, one):
                yield part.assign(**dict(zip(names, np.abs(z).T)))

    _, spread = _quantiles(feats.mapInPandas(away, schema), FEATURES)
    scale = {g: np.maximum(1.4826 * v, FLOOR) for g, v in _shrunk(n, spread).items()}

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part, g, z in _robust(b, centre, scale):
                w = np.clip(z, -WINSOR, WINSOR)
                yield pd.DataFrame({"lang": [g], "n": [len(part)], "m": [(w.T @ w).ravel()]})

    sums = feats.mapInPandas(moments, "lang string, n long, m array<double>")
    sums = sums.groupBy("lang").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("m")[i]) for i in range(size * size)]).alias("m")).collect()
    total = {r["lang"]: (r["n"], np.array(r["m"]).reshape(size, size)) for r in sums}
    every = sum(m for _, m in total.values()) / sum(k for k, _ in total.values())
    scatter = _shrunk(n, {g: total[g][1] / total[g][0] if g is not None and g in total else every for g in centre})
    inverse = {g: np.linalg.inv(m + 0.1 * np.eye(size)) for g, m in scatter.items()}
    side = np.array(list(SPAM.values()))
    within = [[names.index(f) for f in d] for d in DIRECTIONS.values()]
    titles = np.array(list(DIRECTIONS))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part, g, z in _robust(b, centre, scale):
                distance = np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", z, inverse[g], z), 0))
                along = np.stack([(z * side)[:, d].min(axis=1) for d in within], axis=1)
                best = along.argmax(axis=1)
                yield pd.DataFrame({"key": part["key"], "lang": part["lang"], "direction": titles[best], "deviation": along[np.arange(len(part)), best], "distance": distance})

    out = feats.mapInPandas(judge, f"key {kind}, lang string, direction string, deviation double, distance double")
    n, upper = _quantiles(out, ("distance",), 0.75)
    return out, {g: float(v[0]) for g, v in _shrunk(n, upper).items()}


def stuffed(df: DataFrame, key: str, text: str, lang: str, far: float = FAR, directed: float = DIRECTED) -> DataFrame:
    """``key, direction, deviation, distance`` of the flagged pages; ``distance`` in upper quartiles of the language's.

    Texts of any length are judged; null and empty ones are never flagged, blank ones have no links
    or repetition and aren't either; a null language counts as one of its own; a document listed
    twice counts once; an empty table gives no rows.  Statistics come from all documents.
    """
    named = df.where(F.length(text) > 0).select(F.col(key).alias("k"), F.coalesce(lower_key(F.col(lang)), F.lit("")).alias("g"), F.col(text).alias("t"))
    named = spread(named)
    feats = cut(extract(named, function_words(named)))
    if feats.isEmpty():
        return feats.select(F.col("key").alias(key), F.lit("").alias("direction"), F.lit(0.0).alias("deviation"), F.lit(0.0).alias("distance"))
    pages, upper = judged(feats)
    own = feats.sparkSession.createDataFrame([(g, v) for g, v in upper.items() if g is not None] or [("", upper[None])], "lang string, upper double")
    pages = pages.where(F.col("deviation") >= directed).join(F.broadcast(own), "lang", "left")
    pages = pages.withColumn("distance", F.col("distance") / F.greatest(F.coalesce("upper", F.lit(upper[None])), F.lit(1e-9))).where(F.col("distance") >= far)
    return pages.groupBy(F.col("key").alias(key)).agg(F.max("direction").alias("direction"), F.max("deviation").alias("deviation"), F.max("distance").alias("distance"))
