"""Evaluation passages inside a training corpus: prefix-filtered set join with exact verification.

1. Passages come in blocks of a bounded number of words; each block is one dictionary of shingles
   (runs of ``SHINGLE`` words) that every task holds.  A larger evaluation set has more blocks.
2. A pass over the corpus counts in how many documents each of these shingles occurs; each passage
   orders its shingles by rarity.
3. A document that shares at least T of a passage's n shingles holds one of its n - T + 1 rarest, so
   only this necessary prefix is joined with the corpus's shingles.  The join happens where the
   document is read; nothing but found pairs is shuffled.
4. Candidates must hold T shingles (length), inside at most two item-sized windows (position).
5. The rest are verified: words matched in the passage's order inside at most two item-sized windows,
   as a share of the passage's words.

Wording may change slightly, so shingles are shorter than for near-duplicates, and T lower: half a
passage with one word in ten changed keeps 35 % of its three-word shingles, less some at its edges.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import spread

SHINGLE = 3  #: words; a changed word breaks three shingles, not five
SHARE = 0.30  #: share of a passage's shingles that a candidate holds at least
COVER = 0.40  #: share of a passage's words, in order and close together, that makes a leak ("about half")
WINDOW = 1.5  #: length of a window in passages
BLOCK_CHARS = 6_000_000  #: characters of passages in one dictionary, about; bounds what tasks hold (at most a million different words)

_TAG = re.compile(r"<[^<>]{0,200}>")
_TAG_IN_NUMBER = re.compile(r"(?<=\d\.)<[^<>]{0,200}>(?=\d)")
_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})")
_WORD = re.compile(r"[^\W_]+")
_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
_HYPHEN = re.compile(r"(?<=[^\W\d_])-\s*\n\s*(?:>\s*)*(?=[^\W\d_])")


def words(text: str | None) -> list[str]:
    """Words without case, accents, mark-up, layout and joining characters."""
    if not text:
        return []
    t = html.unescape(text) if "&" in text else text
    t = _ESCAPE.sub(lambda m: chr(int(m[1], 16)), t) if "\\u" in t else t
    t = _TAG.sub(" ", _TAG_IN_NUMBER.sub("", t)) if "<" in t else t
    t = _HYPHEN.sub("", t) if "-" in t else t
    if not t.isascii():
        t = _INVISIBLE.sub("", unicodedata.normalize("NFKD", t))
        t = "".join(ch for ch in t if not unicodedata.combining(ch))
    # joiners inside a word vanish: code names are written with and without them
    return _WORD.findall(re.sub(r"(?<=\w)[_`.,'’](?=\w)", "", t.casefold()))


class Passages:
    """Dictionary of one block of passages: shingles as numbers, their passages, and the prefix of each passage.

    Plain arrays and dicts: a broadcast names classes by module, which executors needn't have.
    """

    def __init__(self, texts: list[str]):
        self.vocabulary: dict[str, int] = {}
        number = self.vocabulary
        self.words = [np.array([number.setdefault(w, len(number)) for w in words(t)], dtype=np.int64) for t in texts]
        self.codes = np.unique(np.concatenate([self._code(w) for w in self.words] or [np.zeros(0, np.int64)]))
        self.shingles = [np.searchsorted(self.codes, self._code(w)) for w in self.words]
        self.own = [np.unique(s) for s in self.shingles]
        self.need = np.array([max(1, ceil(len(o) * SHARE)) for o in self.own], dtype=np.int64)
        self.length = np.array([len(w) for w in self.words], dtype=np.int64)

    def _code(self, ids: np.ndarray) -> np.ndarray:
        """Shingle codes at each place; words unknown to the passages (-1) spoil their shingles."""
        if len(ids) < SHINGLE:
            return np.zeros(0, np.int64)
        size = max(1, len(self.vocabulary))
        parts = [ids[k : len(ids) - SHINGLE + 1 + k] for k in range(SHINGLE)]
        code = parts[0]
        for q in parts[1:]:
            code = code * size + q
        return np.where(np.min(parts, axis=0) < 0, -1, code)

    def hits(self, texts: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, place and shingle of every shingle of the block in ``texts``, and each text's words."""
        get = self.vocabulary.get
        lists = [words(t) for t in texts]
        size = np.array([len(w) for w in lists], dtype=np.int64)
        # texts are kept apart by unknown words
        ids = np.full(int(size.sum()) + SHINGLE * len(lists), -1, dtype=np.int64)
        first = np.cumsum(size + SHINGLE) - size - SHINGLE
        for at, w in zip(first, lists):
            ids[at : at + len(w)] = [get(x, -1) for x in w]
        code = self._code(ids)
        sid = np.searchsorted(self.codes, code)
        sid[sid == len(self.codes)] = 0
        place = np.flatnonzero((code >= 0) & (self.codes[sid] == code)) if len(self.codes) else np.zeros(0, np.int64)
        text = np.searchsorted(first, place, side="right") - 1
        return text, place - first[text], sid[place], size

    def order(self, frequency: np.ndarray) -> None:
        """Prefixes by the document frequency of every shingle, and the passages of every shingle."""
        rank = np.lexsort((np.arange(len(frequency)), frequency)).argsort()
        prefix = [o[np.argsort(rank[o])][: max(0, len(o) - n + 1)] for o, n in zip(self.own, self.need)]
        self.of_prefix, self.of_shingle = self._owners(prefix), self._owners(self.own)

    def _owners(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        shingle = np.concatenate(sets or [np.zeros(0, np.int64)]).astype(np.int64)
        passage = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        by = np.argsort(shingle, kind="stable")
        return np.searchsorted(shingle[by], np.arange(len(self.codes) + 1)), passage[by]


def _joined(owners: tuple[np.ndarray, np.ndarray], shingle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and passage of each shingle's passages."""
    start, passage = owners
    n = start[shingle + 1] - start[shingle]
    row = np.repeat(np.arange(len(shingle)), n)
    return row, passage[start[shingle][row] + np.arange(len(row)) - (np.cumsum(n) - n)[row]]


def candidates(block: Passages, text: np.ndarray, place: np.ndarray, shingle: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Text, passage, places and shingles of the pairs that pass the prefix join and the bounds."""
    count = len(block.need)
    row, passage = _joined(block.of_prefix, shingle)
    pairs = np.unique(text[row] * count + passage)
    pairs = pairs[size[pairs // count] >= block.need[pairs % count] + SHINGLE - 1]
    if not len(pairs):
        return
    row, passage = _joined(block.of_shingle, shingle)
    pair = text[row] * count + passage
    at = np.searchsorted(pairs, pair)
    at[at == len(pairs)] = 0
    kept = pairs[at] == pair
    row, pair, passage = row[kept], pair[kept], passage[kept]
    # length: different shingles held; position: those of the two fullest pairs of neighbouring blocks of a window's length
    reach = np.maximum(1, (WINDOW * block.length[passage]).astype(np.int64)) + SHINGLE
    cell = place[row] // reach
    seen = np.unique(np.stack([np.concatenate([pair, pair]), np.concatenate([cell, cell + 1]), np.concatenate([shingle[row], shingle[row]])]), axis=1)
    cells, held = np.unique(seen[:2], axis=1, return_counts=True)
    by = np.lexsort((-held, cells[0]))
    first = np.searchsorted(cells[0][by], pairs)
    second = np.minimum(first + 1, len(by) - 1)
    two = held[by[first]] + np.where((second > first) & (cells[0][by[second]] == pairs), held[by[second]], 0)
    by_pair = np.argsort(pair, kind="stable")
    lo, hi = np.searchsorted(pair[by_pair], pairs), np.searchsorted(pair[by_pair], pairs, side="right")
    for k in np.flatnonzero(two >= block.need[pairs % count]):
        rows = row[by_pair[lo[k] : hi[k]]]
        if len(np.unique(shingle[rows])) >= block.need[pairs[k] % count]:
            yield int(pairs[k] // count), int(pairs[k] % count), place[rows], shingle[rows]


def coverage(passage: np.ndarray, n: int, place: np.ndarray, shingle: np.ndarray, window: float = WINDOW) -> float:
    """Share of the passage's ``n`` words found in its order inside at most two item-sized windows of a text.

    passage  shingle at each place of the passage; place, shingle  those of the text, by place.
    A chain of equal shingles that rises in both texts is chosen in each window, the better window
    first, then the best other one over the rest.  Windows are sought in pairs of neighbouring
    blocks of their length; one that can't beat the best so far is left out, so the work grows with
    the text's length.
    """
    where: dict[int, list[int]] = defaultdict(list)
    for i, s in enumerate(passage.tolist()):
        where[s].append(i)
    span = int(window * n) + SHINGLE
    blocks: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for j, s in zip(place.tolist(), shingle.tolist()):
        for i in where.get(s, ()):
            blocks[j // span].append((j, i))
            blocks[j // span - 1].append((j, i))
    covered: set[int] = set()
    for _ in range(2):
        best: set[int] = set()
        for b in sorted(blocks):
            hits = [h for h in blocks[b] if not covered or any(h[1] + k not in covered for k in range(SHINGLE))]
            if len({i + k for _, i in hits for k in range(SHINGLE)} - covered) <= len(best - covered):
                continue
            for got in _windows(hits, span, covered, len(best - covered)):
                if len(got - covered) > len(best - covered):
                    best = got
        if not best - covered:
            break
        covered |= best
        if len(covered) == n:
            break
    return len(covered) / n


def _windows(hits: list[tuple[int, int]], span: int, covered: set[int], least: int) -> Iterator[set[int]]:
    """Chains of the windows of two blocks; one chain if all hits lie in one window."""
    if hits[-1][0] - hits[0][0] <= span - SHINGLE:
        yield _chain(hits)
        return
    hi = 0
    for lo, (j, _) in enumerate(hits):
        if lo and hits[lo - 1][0] == j:
            continue
        while hi < len(hits) and hits[hi][0] <= j + span - SHINGLE:
            hi += 1
        if hi - lo + SHINGLE - 1 > least:
            got = _chain(hits[lo:hi])
            least = max(least, len(got - covered))
            yield got
        if hi == len(hits):  # later windows hold parts of this one
            return


def _chain(hits: list[tuple[int, int]]) -> set[int]:
    """Passage positions covered by the longest chain of anchors rising in document and passage."""
    tails: list[int] = []
    tail_at: list[int] = []
    back = [-1] * len(hits)
    order = sorted(range(len(hits)), key=lambda x: (hits[x][0], -hits[x][1]))
    for x in order:
        i = hits[x][1]
        k = bisect_left(tails, i)
        back[x] = tail_at[k - 1] if k else -1
        if k == len(tails):
            tails.append(i)
            tail_at.append(x)
        else:
            tails[k], tail_at[k] = i, x
    out: set[int] = set()
    x = tail_at[-1] if tail_at else -1
    while x >= 0:
        out.update(range(hits[x][1], hits[x][1] + SHINGLE))
        x = back[x]
    return out


def leaks(corpus: DataFrame, key: str, text: str, items: DataFrame, item: str, passage: str, cover: float = COVER, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``key, item, coverage``: one row for each document and each item whose passage it holds.

    Items with equal passages share their documents.  Null and empty texts and passages, and
    passages shorter than a shingle, match nothing; a document listed twice counts once; an empty
    table gives no rows.  Whole texts are read; no corpus row is collected or broadcast.  An
    evaluation set of more than ``block_chars`` characters is searched for in several blocks.
    """
    passages = items.where(F.length(passage) > 0).select(F.col(item).alias("item"), F.col(passage).alias("passage")).distinct()
    total = passages.agg(F.coalesce(F.sum(F.length("passage")), F.lit(0))).first()[0]
    docs = spread(corpus.where(F.length(text) > 0).select(F.col(key).alias("doc"), F.col(text).alias("text")))
    blocks = max(1, ceil(total / block_chars))
    found = None
    for b in range(blocks):
        part = passages.where(F.pmod(F.xxhash64("passage"), F.lit(blocks)) == b)
        got = _leaks_of(docs, part.toPandas(), cover)
        found = got if found is None else found.unionByName(got)
    names = passages.select("item", F.xxhash64("passage").alias("p"))
    found = found.join(names if blocks > 1 else F.broadcast(names), "p")
    return found.groupBy(F.col("doc").alias(key), F.col("item").alias(item)).agg(F.max("coverage").alias("coverage"))


def _leaks_of(docs: DataFrame, rows: pd.DataFrame, cover: float) -> DataFrame:
    """``doc, p, coverage`` for one block of passages; ``p`` is the passage's hash."""
    spark = docs.sparkSession
    kind = docs.schema["doc"].dataType.simpleString()
    distinct = sorted(set(rows["passage"]))
    block = Passages(distinct)
    schema = f"doc {kind}, passage int, coverage double"
    if not len(block.codes):
        return spark.createDataFrame([], f"doc {kind}, p long, coverage double")
    plain = spark.sparkContext.broadcast(vars(block))

    def held() -> Passages:
        mine = Passages.__new__(Passages)
        vars(mine).update(plain.value)
        return mine

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine = held()
        df = np.zeros(len(mine.codes), dtype=np.int64)
        for batch in batches:
            doc, _, shingle, _ = mine.hits(batch["text"])
            df += np.bincount(np.unique(doc * len(df) + shingle) % len(df), minlength=len(df))
        at = np.flatnonzero(df)
        yield pd.DataFrame({"shingle": at, "df": df[at]})

    counted = docs.select("text").mapInPandas(count, "shingle long, df long").groupBy("shingle").agg(F.sum("df").alias("df")).toPandas()
    frequency = np.zeros(len(block.codes), dtype=np.int64)
    frequency[counted["shingle"]] = counted["df"]
    block.order(frequency)
    owners = spark.sparkContext.broadcast((block.of_prefix, block.of_shingle))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine = held()
        mine.of_prefix, mine.of_shingle = owners.value
        for batch in batches:
            docs_in, out = batch["doc"].to_numpy(), []
            for d, p, place, shingle in candidates(mine, *mine.hits(batch["text"])):
                c = coverage(mine.shingles[p], int(mine.length[p]), place, shingle)
                if c >= cover:
                    out.append((docs_in[d], p, c))
            yield pd.DataFrame(out, columns=["doc", "passage", "coverage"])

    found = docs.mapInPandas(search, schema)
    hashes = spark.createDataFrame([(i, t) for i, t in enumerate(distinct)], "passage int, t string").select("passage", F.xxhash64("t").alias("p"))
    return found.join(F.broadcast(hashes), "passage").select("doc", "p", "coverage")
