"""Session builder, table loader and the two ways of cutting lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """Local session used by tests and the bench; a cluster brings its own session."""
    builder = (
        SparkSession.builder.master(master)
        .appName("quern")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; column pruning and filters reach the parquet scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows in as many pieces as there are cores, if they come in fewer (one file of a small table).

    For costly work on each row; tables of many pieces are left as they are, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``.

    Only a local session may do without: it gets a folder of its own.  On a cluster each executor
    would write to its own disk, so a missing setting is an error there.
    """
    named = spark.conf.get(CHECKPOINT_KEY, None)
    if not named and spark.conf.get("spark.master", "").startswith("local"):
        named = tempfile.mkdtemp(prefix="quern-checkpoint-")
        spark.conf.set(CHECKPOINT_KEY, named)
    if not named:
        raise ValueError(f"{CHECKPOINT_KEY} names no shared folder")
    return named.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Runs the plan once and goes on from the written rows: survives lost executors, forgets the lineage.

    The rows are a table in the shared folder.  Its real size is known to the planner; a checkpointed
    frame would keep the estimate of its plan, a product over joins whose digits double each round
    of a loop until they fill the driver.
    """
    parts = Parts(df.sparkSession)
    parts.add(df)
    return parts.frame()


class Parts:
    """Written tables of one schema that grow part by part and are read in one scan."""

    def __init__(self, spark: SparkSession):
        self.spark, self.schema, self.paths = spark, None, []

    def add(self, df: DataFrame, **measures: Column) -> dict:
        """Writes one part; the aggregates ``measures`` are taken while it is written, without a job of their own."""
        target = f"{checkpoint_dir(self.spark)}/quern-{uuid.uuid4().hex}"
        self.schema = self.schema or df.schema
        seen = Observation() if measures else None
        if seen is not None:
            df = df.observe(seen, *[c.alias(name) for name, c in measures.items()])
        df.write.parquet(target)
        self.paths.append(target)
        return {} if seen is None else seen.get

    def frame(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*self.paths)

    def __bool__(self) -> bool:
        return bool(self.paths)
