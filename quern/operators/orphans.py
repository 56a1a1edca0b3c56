"""References to records that do not exist.

Parent keys and the distinct targets of references are partitioned together by ranges of the key
(the boundaries come from a sample of both sides, so few parents with many targets make as many ranges
as many parents do) and sorted inside their range.  A range streams by in batches: each holds a
sorted array of parents, in which its targets are looked up by one vectorised binary search.  A target
that holds a third of all references is one probe.  The misses go back to the referring rows or into
counts per table and month.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.keys import key, path_key
from quern.session import cut


def probe(parents: DataFrame, targets: DataFrame) -> DataFrame:
    """``kind, target`` of the targets without a parent; both sides ``kind, target`` and distinct.

    Equal keys share a range, a parent before its target, so memory holds a batch and the last parent
    before it.
    """
    name = F.concat_ws("\u0001", "kind", "target").alias("k")
    both = parents.select(name, F.lit(False).alias("asked"), "kind", "target").unionByName(targets.select(name, F.lit(True).alias("asked"), "kind", "target"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for batch in batches:
            asked = batch["asked"].to_numpy(dtype=bool)
            names = batch["k"].to_numpy(dtype=object)
            have = names[~asked] if last is None else np.concatenate([[last], names[~asked]])
            wanted = names[asked]
            if len(have):
                place = np.searchsorted(have, wanted, side="right") - 1
                lost = (place < 0) | (have[np.maximum(place, 0)] != wanted)
                last = have[-1]
            else:
                lost = np.ones(len(wanted), dtype=bool)
            yield batch.loc[asked, ["kind", "target"]][lost]

    return both.repartitionByRange("k").sortWithinPartitions("k", "asked").mapInPandas(run, "kind string, target string")


def parent_keys(documents: DataFrame, items: DataFrame, candidates: DataFrame) -> DataFrame:
    """``kind, target`` of all records that can be referred to: live documents, items, entities and redirected ids."""
    d = documents.where("deleted_at IS NULL").select(F.lit("document").alias("kind"), path_key(F.col("path")).alias("target"))
    i = items.select(F.lit("item").alias("kind"), key(F.col("item_id")).alias("target"))
    e = candidates.select(F.lit("entity").alias("kind"), F.explode(F.array(key(F.col("qid")), key(F.col("redirect_from")))).alias("target"))
    return d.unionByName(i).unionByName(e).where("target IS NOT NULL").distinct()


def references(chunks: DataFrame, refs: DataFrame) -> DataFrame:
    """``table_name, row_id, kind, target, at``; null and empty targets are no references."""
    c = chunks.select(F.lit("chunks").alias("table_name"), F.col("id").alias("row_id"), F.lit("document").alias("kind"), path_key(F.col("doc_path")).alias("target"), F.col("added_at").alias("at"))
    kind = key(F.col("target_type"))
    target = F.when(kind == "document", path_key(F.col("target_id"))).otherwise(key(F.col("target_id")))
    r = refs.select(F.lit("entity_refs").alias("table_name"), F.col("ref_id").alias("row_id"), kind.alias("kind"), target.alias("target"), F.col("seen_at").alias("at"))
    return c.unionByName(r).where("target IS NOT NULL AND kind IN ('document', 'item', 'entity')")


def missing_targets(parents: DataFrame, refs: DataFrame) -> DataFrame:
    """``kind, target`` of distinct targets without a parent."""
    return probe(parents, refs.select("kind", "target").distinct())


def orphans(parents: DataFrame, refs: DataFrame) -> DataFrame:
    """``table_name, row_id, kind, target, at`` of the references without a parent.

    A deleted document is no parent; one added after the reference is.  A row given twice counts
    once.  Empty tables give no rows; without parents every reference is an orphan.
    """
    lost = cut(missing_targets(parents, refs))
    return refs.join(lost, ["kind", "target"]).select("table_name", "row_id", "kind", "target", "at").distinct()


def orphan_report(parents: DataFrame, refs: DataFrame) -> DataFrame:
    """``table_name, kind, month, orphans, targets``: per table, kind and month of the reference (null: no time)."""
    lost = cut(missing_targets(parents, refs))
    month = F.date_format("at", "yyyy-MM")
    counted = refs.groupBy("table_name", "kind", "target", month.alias("month")).agg(F.count("*").alias("n"))
    return counted.join(lost, ["kind", "target"]).groupBy("table_name", "kind", "month").agg(F.sum("n").alias("orphans"), F.count("*").alias("targets"))
