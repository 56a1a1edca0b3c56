"""Readers and sinks: JSON-lines audit logs, YAML entity folders, graph files, legacy state files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AUDIT = "ts string, item_id string, action string, details string, cost double, tier string"


def append_audit(log: DataFrame, folder: str) -> None:
    """Appends entries as JSON lines, one folder a day."""
    log.withColumn("date", F.substring("ts", 1, 10)).write.mode("append").partitionBy("date").json(folder)


def read_audit(spark: SparkSession, folder: str, since: str | None = None) -> DataFrame:
    """Entries of all days; blank and malformed lines are skipped; a missing folder gives no rows; times compare as text."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], AUDIT)
    df = spark.read.schema(AUDIT + ", _bad string").option("recursiveFileLookup", "true").option("columnNameOfCorruptRecord", "_bad").json(folder)
    df = df.where("_bad IS NULL AND (ts IS NOT NULL OR item_id IS NOT NULL)").drop("_bad")
    return df if since is None else df.where(F.col("ts") >= since)


def read_yaml(spark: SparkSession, folder: str) -> DataFrame:
    """``entity_type, entity_id, data`` (JSON text) of ``<folder>/<type>/<id>.yaml``; unreadable files are skipped."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.yaml").option("recursiveFileLookup", "true").load(folder).select("path", "content")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        import yaml

        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"]):
                try:
                    data = yaml.safe_load(bytes(content).decode())
                except (yaml.YAMLError, UnicodeDecodeError):
                    continue
                if isinstance(data, dict):
                    kind, name = path.rstrip("/").split("/")[-2:]
                    rows.append((kind, name[: -len(".yaml")], json.dumps(data, default=str, sort_keys=True)))
            yield pd.DataFrame(rows, columns=["entity_type", "entity_id", "data"])

    return files.mapInPandas(parse, "entity_type string, entity_id string, data string")


def write_yaml(entities: DataFrame, folder: str, backup: bool = False) -> int:
    """Writes ``entity_type, entity_id, data`` as YAML files, each by an atomic rename; returns the number written.

    ``folder`` is a path that all executors share.  A file is written under a lock of its own
    (another writer waits for it, up to 30 seconds); with ``backup`` the file before is kept as ``.bak``.
    """
    return _each_file(entities, folder, backup, False)


def delete_yaml(entities: DataFrame, folder: str, backup: bool = False) -> int:
    """Deletes the files of ``entity_type, entity_id`` (kept as ``.bak`` with ``backup``); returns the number that were there."""
    return _each_file(entities.select("entity_type", "entity_id", F.lit(None).cast("string").alias("data")), folder, backup, True)


def _each_file(entities: DataFrame, folder: str, backup: bool, delete: bool) -> int:
    def store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json
        import os
        import time
        import uuid
        from contextlib import contextmanager

        import yaml

        @contextmanager
        def locked(target: str):
            lock, until = f"{target}.lock", time.monotonic() + 30
            while True:
                try:
                    os.close(os.open(lock, os.O_CREAT | os.O_EXCL))
                    break
                except FileExistsError:
                    if time.monotonic() > until:
                        raise
                    time.sleep(0.02)
            try:
                yield
            finally:
                os.unlink(lock)

        for b in batches:
            done = 0
            for kind, name, data in zip(b["entity_type"], b["entity_id"], b["data"]):
                home = os.path.join(folder, kind)
                os.makedirs(home, exist_ok=True)
                target = os.path.join(home, f"{name}.yaml")
                with locked(os.path.join(home, f".{name}")):
                    there = os.path.exists(target)
                    if there and backup:
                        os.replace(target, f"{target}.bak")
                    if delete:
                        if there and not backup:
                            os.unlink(target)
                        done += there
                        continue
                    draft = os.path.join(home, f".{name}.{uuid.uuid4().hex}")
                    with open(draft, "w", encoding="utf8") as f:
                        yaml.safe_dump(json.loads(data), f, allow_unicode=True, sort_keys=False)
                    os.replace(draft, target)
                    done += 1
            yield pd.DataFrame({"n": [done]})

    return entities.mapInPandas(store, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    """``id, title, description, level, obscurity, prerequisites`` of a JSON graph file."""
    schema = "nodes array<struct<id:string,title:string,description:string,level:int,obscurity:int,prerequisites:array<string>>>"
    return spark.read.schema(schema).option("multiLine", "true").json(path).select(F.explode("nodes").alias("n")).select("n.*")


def read_legacy_state(spark: SparkSession, path: str) -> DataFrame:
    """``item_id, status, cost`` of an old state file, whose items are under ``items`` or ``productions``."""
    entry = "map<string,struct<status:string,cost:double>>"
    df = spark.read.schema(f"items {entry}, productions {entry}").option("multiLine", "true").json(path)
    return df.select(F.explode(F.coalesce("items", "productions")).alias("item_id", "s")).select("item_id", "s.status", F.coalesce("s.cost", F.lit(0.0)).alias("cost"))


class ProviderError(Exception):
    """A provider's refusal: HTTP status, the seconds it asks to wait, or that its replicas lag behind."""

    def __init__(self, message: str, status: int | None = None, retry_after: float | None = None, lagging: bool = False):
        super().__init__(message)
        self.status, self.retry_after, self.lagging = status, retry_after, lagging


def fetch_missing(keys: DataFrame, fetch: Callable[[list[str]], dict], batch: int = 50, rate: float | None = None, tries: int = 3, workers: int = 4, wait: float = 0.01, longest: float = 60.0) -> DataFrame:
    """``key, payload, error`` from a provider called with at most ``batch`` keys; ``rate`` keys a second over all ``workers`` together.

    Refusals with status 429 or 5xx, lagging replicas and errors without a status are tried again,
    after the time the provider asks for or a growing wait (both at most ``longest``); other
    statuses are final.  A payload given as ``("redirect", key)`` is looked up under that key, once;
    a redirect to another redirect stays without payload.
    """
    own = rate / workers if rate else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        def ask(part: list[str]) -> tuple[dict, str | None]:
            error = None
            for attempt in range(tries):
                began = time.monotonic()
                try:
                    return fetch(part), None
                except Exception as e:  # noqa: BLE001 - a failed batch is a result
                    error, status = str(e), getattr(e, "status", None)
                    again = status is None or status == 429 or status >= 500 or getattr(e, "lagging", False)
                    if not again or attempt == tries - 1:
                        break
                    asked = getattr(e, "retry_after", None)
                    time.sleep(min(longest, wait * 4**attempt if asked is None else asked))
                finally:
                    if own:  # each call takes as long as its keys are worth
                        time.sleep(max(0.0, len(part) / own - (time.monotonic() - began)))
            return {}, error

        for b in batches:
            ks = b["key"].drop_duplicates().tolist()
            for at in range(0, len(ks), batch):
                part = ks[at : at + batch]
                got, error = ask(part)
                moved = {k: v[1] for k, v in got.items() if isinstance(v, tuple) and v[0] == "redirect"}
                if moved:
                    there, error = ask(sorted(set(moved.values())))
                    got = {**got, **{k: there.get(t) for k, t in moved.items()}}
                payload = [None if isinstance(got.get(k), tuple) else got.get(k) for k in part]
                yield pd.DataFrame({"key": part, "payload": payload, "error": [error if p is None else None for p in payload]})

    return keys.where("key IS NOT NULL").select("key").distinct().repartition(workers, "key").mapInPandas(run, "key string, payload string, error string")
