"""Session defaults."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


TARGET_PARTITION_BYTES = 128 * 1024**2
# Without a stated input size, shuffles start with partitions for this much; AQE merges the small ones.
DEFAULT_INPUT_BYTES = 256 * 1024**3


def shuffle_partitions(input_bytes: int) -> int:
    """Shuffle partitions that stay near 128 MiB if a whole input is shuffled.

    AQE merges small ones afterwards but cannot make more, so a large input has to start
    with many: 100 TB give about 800,000.
    """
    return max(8, -(-input_bytes // TARGET_PARTITION_BYTES))


def build_session(
    app: str = "bazaarlens", master: str | None = None, input_bytes: int = DEFAULT_INPUT_BYTES, **conf: str
) -> SparkSession:
    """A session with the settings the operators rely on.

    AQE does three jobs here: it turns a join into a broadcast join only once the
    measured size of a side is under ``autoBroadcastJoinThreshold``, it splits skewed
    join partitions, and it coalesces small shuffle partitions. Timestamps are
    interpreted in UTC so that day, week and month boundaries do not depend on the host.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # Recording the Python call site of every column expression doubles planning time.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(shuffle_partitions(input_bytes)),
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder for written intermediate tables: ``spark.checkpoint.dir``, or what
    ``setCheckpointDir`` was given. There is no default, on any master: a folder of one
    machine would be lost with it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to a fresh place in the shared folder and returns the written table, for
    rows that a plan reads several times. A lost executor costs its running tasks only."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
