"""Structured Streaming: audit summaries, latest per key, incremental clusters, idempotent batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def daily_summary(events: DataFrame, late: str = "1 day") -> DataFrame:
    """``day, action, n, cost`` over tumbling days of event time; rows later than ``late`` are dropped."""
    t = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    g = t.groupBy(F.window("ts", "1 day").alias("w"), "action").agg(F.count("*").alias("n"), F.sum("cost").alias("cost"))
    return g.select(F.col("w.start").alias("day"), "action", "n", "cost")


def latest_per_key(rows: DataFrame) -> DataFrame:
    """``key, ts, value`` of the latest row a key so far (``key string, ts double, value string``); older rows change nothing."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = state.get if state.exists else None
        for b in batches:
            for ts, value in zip(b["ts"], b["value"]):
                if best is None or ts >= best[0]:
                    best = (float(ts), value)
        state.update(best)
        yield pd.DataFrame({"key": [key[0]], "ts": [best[0]], "value": [best[1]]})

    return rows.groupBy("key").applyInPandasWithState(run, "key string, ts double, value string", "ts double, value string", "update", GroupStateTimeout.NoTimeout)


def incremental_clusters(vectors: DataFrame, threshold: float) -> DataFrame:
    """``shard, id, cluster``: each shard keeps its centroids as state; see the batch operator for the rule."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        centroids, sizes = [], []
        if state.exists:
            flat, sizes = list(state.get[0]), list(state.get[1])
            d = len(flat) // max(1, len(sizes))
            centroids = [np.array(flat[i * d : (i + 1) * d]) for i in range(len(sizes))]
        for b in batches:
            out = []
            for vector in b.sort_values("id")["embedding"]:
                v = np.asarray(vector, dtype=float)
                v = v / (np.linalg.norm(v) or 1.0)
                s = np.stack(centroids) @ v if centroids else np.array([-2.0])
                i = int(s.argmax())
                if s[i] >= threshold:
                    sizes[i] += 1
                    c = centroids[i] * (sizes[i] - 1) / sizes[i] + v / sizes[i]
                    centroids[i] = c / (np.linalg.norm(c) or 1.0)
                else:
                    centroids.append(v)
                    sizes.append(1)
                    i = len(sizes) - 1
                out.append(i)
            yield pd.DataFrame({"shard": key[0], "id": b.sort_values("id")["id"], "cluster": out})
        state.update((np.concatenate(centroids).tolist() if centroids else [], sizes))

    return vectors.groupBy("shard").applyInPandasWithState(
        run, "shard long, id long, cluster int", "centroids array<double>, sizes array<int>", "append", GroupStateTimeout.NoTimeout
    )


def process_once(stream: DataFrame, ledger: str, process: Callable[[DataFrame], DataFrame], key: str = "item_id"):
    """Writer that appends ``process`` of the rows whose key the ledger folder doesn't hold yet; a repeated batch changes nothing."""

    def each(batch: DataFrame, _: int) -> None:
        spark: SparkSession = batch.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(ledger)
        fresh = batch.dropDuplicates([key])
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            fresh = fresh.join(spark.read.parquet(ledger).select(key), key, "left_anti")
        process(fresh).write.mode("append").parquet(ledger)

    return stream.writeStream.foreachBatch(each)
