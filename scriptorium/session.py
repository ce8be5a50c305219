"""Session settings and the shared folder for lineage cuts.

Nothing here fixes a cluster's sizing: `build_session` is for tests and the
bench, and a job on a cluster brings its own session.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

ROCKSDB_PROVIDER = (
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
)

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(
    master: str = "local[8]",
    app: str = "scriptorium",
    shuffle_partitions: int = 8,
    driver_memory: str = "12g",
) -> SparkSession:
    """A local session with the settings the library is tested under."""
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    session = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", driver_memory)
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by `spark.checkpoint.dir`.

    A local session may leave it unset; then, and only then, a temporary folder is
    set. Without a shared folder a cluster job is refused instead.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    made = tempfile.mkdtemp(prefix="scriptorium-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path in the shared folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    Iterated joins call this per round: the plan stays one round long and a lost
    executor costs a re-read, not a replay of every round before it.
    """
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def written_once(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """`df` as a table in the shared folder, for a result several branches read.

    Columnar, so each branch scans only the columns it needs, with sizes the planner
    can see; a lost executor re-reads files.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def kept_meanwhile(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A `written_once` whose tables go when the block ends: nothing made from them may be read later."""
    paths = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        paths.append(scratch_path(spark, name))
        df.write.parquet(paths[-1])
        return spark.read.schema(df.schema).parquet(paths[-1])

    try:
        yield keep
    finally:
        for path in paths:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
