"""Processing only new or changed records: Merkle tree over key ranges.

Records are spread over the hashed key space; a leaf is a range of it and its digest covers the
set of its record digests, a node's digest covers its children's.  The current tree is compared with
the saved one from the root, descending only where digests differ; records are compared in changed
leaves only, and of the saved records only the ranges that hold such leaves are read.  Output,
record states and tree are published together by one row in the log of commits, so a run that
fails before it leaves the earlier state in force and nothing is skipped or repeated.
"""

from __future__ import annotations

import json
import uuid
from math import ceil, log2

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.keys import key
from quern.session import Parts, checkpoint_dir, cut

FAN = 4  #: bits a level of the tree resolves
LEAF = 512  #: records a leaf is planned for
RANGE = 1  #: levels that a stored range of records resolves; 16 ranges


def levels_for(records: int, leaf: int = LEAF) -> int:
    """Levels below the root so that a leaf holds about ``leaf`` records."""
    return max(RANGE, ceil(log2(max(2, records / leaf)) / FAN))


def leaf_of(keys: list[str], levels: int) -> Column:
    """The key range (leaf) of a record key: the top bits of its hash."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 64 - FAN * levels)


def _digest(*parts: Column) -> Column:
    """128 bits of a record's values."""
    return F.concat(F.hex(F.xxhash64(*parts)), F.hex(F.xxhash64(F.lit("second"), *parts)))


def tree(records: DataFrame, keys: list[str], state: str, levels: int) -> DataFrame:
    """``level, node, digest`` of the whole tree; level 0 is the root.  A leaf's digest doesn't depend on order."""
    one = _digest(*keys, F.coalesce(F.col(state), F.lit("\u0000")), F.col(state).isNull())
    leaves = records.groupBy(leaf_of(keys, levels).alias("node")).agg(F.sha2(F.array_join(F.sort_array(F.collect_set(one)), ","), 256).alias("digest"))
    nodes = Parts(records.sparkSession)
    nodes.add(leaves.withColumn("level", F.lit(levels)))
    here = nodes.frame()
    out = None
    for level in range(levels - 1, -1, -1):
        child = F.concat_ws(":", F.col("node").cast("string"), "digest")
        here = here.groupBy(F.shiftright("node", FAN).alias("node")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(child)), ","), 256).alias("digest"))
        one = here.select("node", "digest", F.lit(level).alias("level"))
        out = one if out is None else out.unionByName(one)
    nodes.add(out)
    return nodes.frame()


def changed_leaves(now: DataFrame, saved: DataFrame, levels: int) -> DataFrame:
    """Leaves whose digests differ, found by descending from the root only where nodes differ."""
    frontier = None
    for level in range(levels + 1):
        a, b = now.where(F.col("level") == level), saved.where(F.col("level") == level)
        if frontier is not None:
            up = F.shiftright("node", FAN) == F.col("up")
            edge = frontier.select(F.col("node").alias("up"))
            a, b = a.join(edge, up, "left_semi"), b.join(edge, up, "left_semi")
        other = b.select("node", F.col("digest").alias("saved"))
        frontier = a.join(other, "node", "full_outer").where(~F.col("digest").eqNullSafe(F.col("saved"))).select("node")
    return frontier.select(F.col("node").alias("leaf"))


def _one_row(records: DataFrame, keys: list[str], state: str) -> DataFrame:
    """One row a key; of several that with the greatest state, then the greatest hash of its values."""
    plain = [c.name for c in records.schema if c.dataType.typeName() not in ("map", "variant") and c.name not in keys]
    rest = [c for c in records.columns if c not in keys]
    live = records.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    best = F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.struct(F.col(state).isNotNull(), F.col(state), F.xxhash64(*[F.col(f"`{c}`") for c in plain])))
    return live.groupBy(*keys).agg(best.alias("_b")).select(*keys, *[F.col(f"_b.`{c}`").alias(c) for c in rest])


def changes(records: DataFrame, saved: DataFrame | None, saved_tree: DataFrame | None, keys: list[str], state: str, levels: int) -> tuple[DataFrame, DataFrame]:
    """The rows of ``records`` to take (with ``change``: added, changed, removed) and the current tree.

    saved, saved_tree  records (keys and state) and tree of the last published run; None at first.
    Null states are states of their own; a record whose key is null is no record; of rows with the
    same key the greatest state counts.  A removed record has nulls but for its keys.  Without
    changes nothing but tree nodes of the saved side is read.
    """
    return _compare(cut(_one_row(records, keys, state)), saved, saved_tree, keys, state, levels)


def _compare(live: DataFrame, saved: DataFrame | None, saved_tree: DataFrame | None, keys: list[str], state: str, levels: int) -> tuple[DataFrame, DataFrame]:
    now = tree(live, keys, state, levels)
    if saved is None or saved_tree is None:
        return live.withColumn("change", F.lit("added")), now
    touched = cut(changed_leaves(now, saved_tree, levels)).withColumnRenamed("leaf", "_leaf")
    ranges = [r[0] for r in touched.select(F.shiftright("_leaf", FAN * (levels - RANGE)).alias("r")).distinct().collect()]  # at most 16
    if "_range" in saved.columns:
        saved = saved.where(F.col("_range").isin(ranges) if ranges else F.lit(False))
    mine = live.withColumn("_leaf", leaf_of(keys, levels)).join(touched, "_leaf", "left_semi").drop("_leaf").withColumn("_live", F.lit(True))
    old = saved.withColumn("_leaf", leaf_of(keys, levels)).join(touched, "_leaf", "left_semi")
    old = old.select(*keys, F.col(state).alias("_saved"), F.lit(True).alias("_known"))
    out = mine.join(old, keys, "full_outer").where(F.col("_known").isNull() | F.col("_live").isNull() | ~F.col(state).eqNullSafe(F.col("_saved")))
    change = F.when(F.col("_known").isNull(), "added").when(F.col("_live").isNull(), "removed").otherwise("changed")
    return out.withColumn("change", change).drop("_saved", "_known", "_live"), now


class Ledger:
    """Published runs in a shared folder: ``runs/<id>/{output,records,tree}`` and the log ``commits``.

    A run counts from the moment its row lies in the log.  The row is written by one task, whose one
    file the job's commit moves into place: the only step that makes a run count.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _commits(self) -> list:
        try:
            rows = self.spark.read.schema("n long, run string, levels int, schema string").parquet(f"{self.folder}/commits")
        except AnalysisException:  # no run yet
            return []
        return rows.orderBy(F.desc("n"), "run").limit(1).collect()

    def current(self) -> str | None:
        """Folder of the last published run."""
        last = self._commits()
        return f"{self.folder}/runs/{last[0]['run']}" if last else None

    def levels(self) -> int | None:
        last = self._commits()
        return last[0]["levels"] if last else None

    def load(self, part: str) -> DataFrame | None:
        last = self._commits()
        if not last:
            return None
        reader = self.spark.read.schema(T.StructType.fromJson(json.loads(last[0]["schema"]))) if part == "records" else self.spark.read  # no range, no file
        return reader.parquet(f"{self.folder}/runs/{last[0]['run']}/{part}")

    def publish(self, output: DataFrame, records: DataFrame, merkle: DataFrame, keys: list[str], state: str, levels: int) -> str:
        """Writes output, record states (by key range) and tree, then the commit; a crash before that changes nothing."""
        run = uuid.uuid4().hex
        last = self._commits()
        output.write.parquet(f"{self.folder}/runs/{run}/output")
        states = records.select(*keys, state, F.shiftright(leaf_of(keys, levels), FAN * (levels - RANGE)).alias("_range"))
        states.repartition("_range").write.partitionBy("_range").parquet(f"{self.folder}/runs/{run}/records")
        merkle.write.parquet(f"{self.folder}/runs/{run}/tree")
        self._commit(last[0]["n"] + 1 if last else 1, run, levels, states.schema.json())
        return run

    def _commit(self, n: int, run: str, levels: int, schema: str) -> None:
        self.spark.createDataFrame([(n, run, levels, schema)], "n long, run string, levels int, schema string").coalesce(1).write.mode("append").parquet(f"{self.folder}/commits")

    def take(self, records: DataFrame, keys: list[str], state: str) -> DataFrame:
        """One run: the changes of ``records`` since the last published run, published with the new states and tree.

        A tree keeps its levels until the number of records calls for more or fewer by one and more;
        then the saved records' tree is built anew at the new levels.
        """
        saved, saved_tree, levels = self.load("records"), self.load("tree"), self.levels()
        live = cut(_one_row(records, keys, state))
        fit = levels_for(live.count())
        if levels is None or abs(fit - levels) > 1:
            levels = fit
            saved_tree = None if saved is None else tree(saved, keys, state, levels)
            saved = None if saved is None else saved.drop("_range")  # ranges are those of the earlier levels
        out, now = _compare(live, saved, saved_tree, keys, state, levels)
        self.publish(out, live, now, keys, state, levels)
        return self.load("output")


# The states that end an item's processing, and the status of a successful run.
DONE = ("done", "verified", "applied", "skipped")
SUCCESS = "ok"


def seconds(col: Column) -> Column:
    """Epoch numbers in one unit (milliseconds as long); writers used seconds, milli- or microseconds.

    Null, NaN, zero and negative numbers mean never and give null.
    """
    ms = F.when(col >= 1e14, col / 1e3).when(col >= 1e11, col).otherwise(col * 1e3)
    return F.when(col.isNotNull() & ~F.isnan(col) & (col > 0), F.round(ms).cast("long"))


def document_states(documents: DataFrame, runs: DataFrame) -> DataFrame:
    """``table_name, record_key, now, saved``: a live document's version, and the one a successful run has indexed (null: none)."""
    ok = runs.where(key(F.col("status")) == SUCCESS).select(F.col("run_id").alias("ok_run")).distinct()
    d = documents.where("deleted_at IS NULL AND doc_id IS NOT NULL").select("doc_id", seconds(F.col("mtime")).alias("changed"), seconds(F.col("indexed_at")).alias("indexed"), "run_id")
    d = d.join(ok, F.col("run_id") == F.col("ok_run"), "left")
    now = F.concat(F.lit("v"), F.coalesce(F.col("changed").cast("string"), F.lit("?")))
    done = F.col("ok_run").isNotNull() & F.col("indexed").isNotNull()
    saved = F.when(done & F.coalesce(F.col("changed") > F.col("indexed"), F.lit(False)), F.concat(F.lit("before "), F.col("indexed").cast("string"))).when(done, now)
    return d.select(F.lit("documents").alias("table_name"), F.col("doc_id").cast("string").alias("record_key"), now.alias("now"), saved.alias("saved"))


def item_states(items: DataFrame, runs: DataFrame) -> DataFrame:
    """The same for items: wanted is a finished state; saved is the latest state that counts (null: none).

    Rows entered by hand or by a successful run count; the latest is that with the greatest ``ts``,
    of equal ones that with the greatest ``seq``.
    """
    ok = runs.where(key(F.col("status")) == SUCCESS).select(F.col("run_id").alias("ok_run")).distinct()
    i = items.select(key(F.col("item_id")).alias("record_key"), F.col("item_id"), key(F.col("status")).alias("status"), "ts", "seq", "run_id").where("record_key IS NOT NULL")
    i = i.join(ok, F.col("run_id") == F.col("ok_run"), "left")
    counts = F.col("run_id").isNull() | F.col("ok_run").isNotNull()
    g = i.groupBy("record_key").agg(F.max(F.when(counts, F.struct("ts", "seq", "status"))).alias("last"))
    saved = F.when(F.col("last.status").isin(*DONE), F.lit("finished")).otherwise(F.col("last.status"))
    return g.select(F.lit("items").alias("table_name"), F.col("record_key"), F.lit("finished").alias("now"), saved.alias("saved"))


def pending(states: DataFrame, ledger: Ledger | None = None) -> DataFrame:
    """``table_name, record_key`` of the records whose wanted and recorded states differ.

    What earlier runs recorded in the tables is published as a run of ``ledger`` (a new one in the
    shared folder, if none is given), with its tree; the next run then takes the changes of the
    wanted states by descending both trees, and publishes them with the new tree.
    """
    spark, keys = states.sparkSession, ["table_name", "record_key"]
    ledger = ledger or Ledger(spark, f"{checkpoint_dir(spark)}/ledger-{uuid.uuid4().hex}")
    states = cut(states.groupBy(*keys).agg(F.max("now").alias("now"), F.min(F.coalesce("saved", F.lit("-"))).alias("saved")))
    levels = levels_for(states.count())
    done = states.where("saved <> '-'").select(*keys, F.col("saved").alias("state"))
    ledger.publish(done.limit(0), done, tree(done, keys, "state", levels), keys, "state", levels)
    return ledger.take(states.select(*keys, F.col("now").alias("state")), keys, "state").where("change <> 'removed'").select(*keys)
