"""Session helpers: a tuned session for local work and a lineage cut for iterative jobs."""
from __future__ import annotations

import contextlib
import os
import tempfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Estimated bytes up to which a checkpointed table keeps its estimate; far above any limit that the planner compares it with.
LARGEST = 1 << 62


def build_session(app: str = "vacantia", master: str | None = None, **conf: str) -> SparkSession:
    """A session with AQE on and the clock in UTC; cluster settings win when already present."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster; a fresh scratch folder only for a local master with none set."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not sc.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="vacantia-ckpt-"))
    return sc.getCheckpointDir()


@contextlib.contextmanager
def _shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Queries made and run within leave no shuffle files; otherwise these stay until the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder and drop its lineage."""
    checkpoint_dir(df.sparkSession)
    with _shuffles_freed(df.sparkSession):
        done = df.select("*").checkpoint(eager=True)  # a query of its own, so that the setting holds for it
    return _bounded(done)


def _bounded(df: DataFrame) -> DataFrame:
    """A checkpointed ``df`` that the planner takes to be of unknown size where its estimate is above ``LARGEST``.

    A checkpoint keeps the estimate of its plan, in which a join multiplies those of its sides. Over the rounds of an iterative job that
    grew to numbers of millions of digits, which filled the driver."""
    plan = df._jdf.queryExecution().logical()
    if plan.stats().sizeInBytes() <= LARGEST:
        return df
    session, jvm = df._jdf.sparkSession(), df.sparkSession._jvm
    unknown, known = jvm.scala.Option.empty(), jvm.scala.Option.apply(plan.constraints())
    held = jvm.org.apache.spark.sql.execution.LogicalRDD(
        plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), plan.isStreaming(), plan.stream(), session, unknown, known)
    return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(session, held), df.sparkSession)


def stored(df: DataFrame, name: str, *parts: str) -> DataFrame:
    """``df`` written to the checkpoint folder as a table and read back, which cuts the lineage of wide rows.

    Unlike a checkpoint it is compressed, and later steps read only the columns (and, by ``parts``, the folders) that they need."""
    path = scratch_path(df.sparkSession, name)
    with _shuffles_freed(df.sparkSession):
        df.select("*").write.option("compression", "zstd").partitionBy(*parts).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def wide(spark: SparkSession) -> int:
    """Partition count for CPU-heavy steps on few bytes, which AQE would pack into too few tasks."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the checkpoint folder, for tables written and read back within one job."""
    return os.path.join(checkpoint_dir(spark), f"{name}-{os.urandom(6).hex()}")
