"""Pluggable models: embeddings, entailment and text.  Deterministic stand-ins work offline.

A provider is called with a batch inside a task; callers split the frame before a costly provider,
since ``when`` does not keep a Python function from seeing every row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.text import genericise


def hashed_embedding(texts: list[str], dim: int = 64) -> np.ndarray:
    """Unit vectors of hashed character trigrams: a deterministic stand-in, not a model."""
    out = np.zeros((len(texts), dim))
    for i, t in enumerate(texts):
        padded = f"  {t.casefold()} "
        for j in range(len(padded) - 2):
            h = int.from_bytes(hashlib.blake2b(padded[j : j + 3].encode(), digest_size=8).digest(), "big")
            out[i, h % dim] += 1.0 if h >> 63 else -1.0
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm == 0, 1.0, norm)


def embed(texts: DataFrame, encode: Callable[[list[str]], np.ndarray] = hashed_embedding, generic: bool = False, cache: DataFrame | None = None, model: str = "hashed-64") -> DataFrame:
    """``id, text_hash, embedding``: each distinct text is encoded once; hits of ``cache`` (``text_hash, model_name, embedding``) aren't.

    Null texts have no embedding; ``generic`` prepares the text first and the hash is of the prepared text.
    """
    t = texts.where("text IS NOT NULL").select("id", (genericise(F.col("text")) if generic else F.col("text")).alias("text"))
    t = t.withColumn("text_hash", F.sha2("text", 256))
    asked = t.select("text_hash", "text").dropDuplicates(["text_hash"])
    known = None
    if cache is not None:
        known = cache.where(F.col("model_name") == model).select("text_hash", F.col("embedding").cast("array<double>").alias("embedding")).dropDuplicates(["text_hash"])
        asked = asked.join(known, "text_hash", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"text_hash": b["text_hash"], "embedding": list(encode(b["text"].tolist()))})

    made = asked.mapInPandas(run, "text_hash string, embedding array<double>")
    if known is not None:
        made = made.unionByName(known)
    return t.select("id", "text_hash").join(made, "text_hash")


def overlap_nli(premises: list[str], hypotheses: list[str]) -> np.ndarray:
    """Scores (contradiction, entailment, neutral) from shared words and negations: a stand-in, not a model."""
    rows = []
    for p, h in zip(premises, hypotheses):
        a, b = set(p.casefold().split()), set(h.casefold().split())
        share = len(a & b) / max(1, len(b))
        clash = bool({"no", "not", "never"} & (a ^ b)) and share > 0.5
        rows.append((0.8, 0.1, 0.1) if clash else (0.1, share * 0.9, 0.9 - share * 0.9))
    return np.array(rows, dtype=float).reshape(-1, 3)


def classify_nli(pairs: DataFrame, score: Callable[[list[str], list[str]], np.ndarray] = overlap_nli) -> DataFrame:
    """Adds ``nli`` to ``premise, hypothesis``: the label of the greatest score, the earlier one of equal ones."""
    names = np.array(["contradiction", "entailment", "neutral"])
    fields = pairs.schema.simpleString()[len("struct<") : -1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            s = score(b["premise"].fillna("").tolist(), b["hypothesis"].fillna("").tolist())
            yield b.assign(nli=names[s.argmax(axis=1)] if len(b) else pd.Series(dtype=str))

    return pairs.mapInPandas(run, f"{fields},nli:string")


def generate(prompts: DataFrame, model: Callable[[list[str]], list[str]], batch: int = 50) -> DataFrame:
    """``id, answer, error`` of ``id, prompt``; a failing batch gives errors, not a failed job."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), batch):
                part = b.iloc[at : at + batch]
                try:
                    answers, error = model(part["prompt"].tolist()), None
                except Exception as e:  # noqa: BLE001 - a failed batch is a result
                    answers, error = [None] * len(part), str(e)[:500]
                yield pd.DataFrame({"id": part["id"], "answer": answers, "error": error})

    kind = prompts.schema["id"].dataType.simpleString()
    return prompts.select("id", "prompt").mapInPandas(run, f"id {kind}, answer string, error string")
