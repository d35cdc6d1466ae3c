"""Session set-up and the two run-time checks the operators need."""

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def prepare(spark: SparkSession) -> SparkSession:
    """Settings the results depend on (UTC clock) and the adaptive ones that matter at scale."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    _plain_unions(spark)
    return spark


def _plain_unions(spark: SparkSession) -> None:
    """Spark 4.1 lets a union keep the partitioning of its children.  Together with adaptive
    re-planning that gave wrong rows here (a distinct over a union left out its shuffle while
    one side was read differently), so the shuffle is asked for."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def union_all(*frames: DataFrame) -> DataFrame:
    """Union by name, safe to group afterwards whatever the session's settings were."""
    _plain_unions(frames[0].sparkSession)
    out = frames[0]
    for nxt in frames[1:]:
        out = out.unionByName(nxt)
    return out


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and staged tables: the cluster's own, or a new one in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if "memspark.local.dir" not in _local:
        _local["memspark.local.dir"] = tempfile.mkdtemp(prefix="memspark-")
    return _local["memspark.local.dir"]


_local: dict[str, str] = {}


def new_folder(spark: SparkSession, what: str) -> str:
    """A new folder name below the shared one."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through a reliable checkpoint, which survives lost executors."""
    spark = df.sparkSession
    spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def has_at_most(df: DataFrame, rows: int) -> bool:
    """Counts no further than ``rows + 1`` rows."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint behind a row count; a bigger side is left to a shuffled join."""
    return F.broadcast(df) if has_at_most(df, rows) else df


def spread(scan: DataFrame) -> DataFrame:
    """Spread a file scan that comes in fewer pieces than there are cores.

    A file with a single row group cannot be split, so costly work per row (tokenising text)
    would run in one task.  A scan with enough pieces is returned as it is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


TASK_ROWS = 250_000  # rows of a piece; just below 2^18, where Spark doubles the table of a grouping


def dealt(scan: DataFrame, *keys: str) -> DataFrame:
    """A file scan dealt by ``keys`` into pieces of about TASK_ROWS rows, one per core at least.

    The number of shuffle partitions is a setting that does not follow the input, so what a task holds to group by
    nearly unique keys would grow with the table.  The rows are counted from the files' footers.  Rows of one key meet
    unsummed; use it for keys that few rows share.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(max(cores, -(-scan.count() // TASK_ROWS)), *keys)
