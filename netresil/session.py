"""Session settings and the helpers every iterative job shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "netresil", folder: str | None = None) -> SparkSession:
    """A single-machine session for tests and the bench, which name a folder for intermediate tables."""
    builder = SparkSession.builder
    if folder:
        builder = builder.config("spark.checkpoint.dir", folder)
    return (
        builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared folder named by ``spark.checkpoint.dir``.

    Where it is unset, a folder of this application's own in the warehouse is
    taken, which driver and executors share as well; never a machine's own
    temporary folder, which would be lost with its executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_rounds-{sc.applicationId}"
    sc.setCheckpointDir(configured)
    return configured


def _table(df: DataFrame) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/netresil-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and read them back.

    Like a reliable checkpoint this survives the loss of executors. A written
    table is used because a checkpointed frame keeps the size estimates of the
    plan it came from, which multiply from round to round of an iterative job;
    a table's size is known, so the planner also knows what is small enough to
    broadcast.
    """
    return _table(df)[0]


class Scratch:
    """Written tables that are removed when the block ends; what outlives it must be written on its own."""

    def __init__(self):
        self.held: list[tuple[SparkSession, str]] = []

    def cut(self, df: DataFrame) -> DataFrame:
        out, path = _table(df)
        self.held.append((df.sparkSession, path))
        return out

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for spark, path in self.held:
            _remove(spark, path)


class Rounds:
    """Tables of an iterative job: each round's is kept until the one after the next is written.

    A round reads the table of the round before, so two are enough, also when
    an executor is lost and tasks run again. Only for loops whose later rounds
    and result read nothing older.
    """

    def __init__(self):
        self.held: list[list[str]] = []

    def cut(self, *frames: DataFrame) -> list[DataFrame]:
        out = [_table(df) for df in frames]
        self.held.append([path for _, path in out])
        if len(self.held) > 2:
            for path in self.held.pop(0):
                _remove(frames[0].sparkSession, path)
        return [df for df, _ in out]


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
