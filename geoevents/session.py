"""Session helpers: building a session, cutting lineage, joins."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "geoevents", master: str = "local[8]", **conf) -> SparkSession:
    """A session with the settings the operators assume (UTC, AQE with skew handling)."""
    b = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        b = b.config(key.replace("__", "."), value)
    return b.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named in spark.checkpoint.dir; make one only for a local session."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="geoevents-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder, so loops keep a short lineage and a
    lost executor costs a re-read, not a re-run."""
    ensure_checkpoint_dir(df.sparkSession)
    out = sized(df.checkpoint(eager=True))
    out._materialised = True
    return out


def sized(df: DataFrame) -> DataFrame:
    """The frame of a checkpoint with the bytes written as its size for the planner.

    A checkpoint hands on the size that was guessed for its plan, and the guess for a join is the product of its sides: in a loop
    of joins its digits multiply each round, until the driver's memory holds little else."""
    spark, plan, size = df.sparkSession, df._jdf.logicalPlan(), written_bytes(df)
    jvm = spark.sparkContext._jvm
    stats = spark.range(-(-size // 8)).select("id")._jdf.logicalPlan().stats()  # py4j can not pass a size itself; a long has 8 bytes
    known = plan.copy(plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), plan.isStreaming(), plan.stream(),
                      spark._jsparkSession, jvm.scala.Option.apply(stats), jvm.scala.Option.apply(plan.constraints()))
    out = type(df)(jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, known), spark)
    out._bytes = size
    return out


def written_bytes(df: DataFrame) -> int:
    """Size of a frame made by ``cut``: what its checkpoint files hold, asked of the file system, without a job.
    Kept on the frame, so one frame used in several joins is measured once."""
    if not hasattr(df, "_bytes"):
        sc = df.sparkSession.sparkContext
        folder = sc._jvm.org.apache.hadoop.fs.Path(df._jdf.logicalPlan().rdd().getCheckpointFile().get())
        df._bytes = folder.getFileSystem(sc._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()
    return df._bytes


def broadcast_limit(spark: SparkSession) -> int:
    """The session's own bound for broadcasts, in bytes (-1: none are made)."""
    text = spark.conf.get("spark.sql.autoBroadcastJoinThreshold").lower()
    units = {"b": 0, "k": 10, "kb": 10, "m": 20, "mb": 20, "g": 30, "gb": 30, "": 0}
    number = text.rstrip("bkmg")
    return int(number) << units[text[len(number):]] if not number.startswith("-") else -1


def hashed_join(
    big: DataFrame, side: DataFrame, on: list[str], how: str = "left", condition: Column | None = None
) -> DataFrame:
    """Equi-join whose physical form is Spark's choice, where a key of ``big`` may be hot.

    A side that is already written out is measured in bytes and hinted for broadcast within the
    session's own bound; any other side is left to the adaptive planner, which broadcasts by the
    size it meets and splits skewed partitions. The rows are the same either way.
    ``condition`` (on columns of both sides) may be given for inner, left_semi and left_anti.
    """
    if getattr(side, "_materialised", False) and written_bytes(side) <= broadcast_limit(side.sparkSession):
        side = F.broadcast(side)
    if condition is None:
        return big.join(side, on, how)
    if how == "inner":
        return big.join(side, on, "inner").filter(condition)
    renamed = side.select(*[F.col(k).alias(f"_k_{k}") for k in on], *[c for c in side.columns if c not in on])
    for k in on:
        condition = (F.col(k) == F.col(f"_k_{k}")) & condition
    return big.join(renamed, condition, how)
