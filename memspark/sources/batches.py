"""Append-only tables with atomic batches.

A batch is written into its own partition and counts only once its commit row exists, so a job
that is lost halfway leaves nothing visible and a retry with the same batch id replaces its own
half-written files.  Several tables of one step share a batch id and one commit.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memspark.sources import schemas

COMMITS = "_commits"
_COMMIT_SCHEMA = "batch_id bigint, committed_at timestamp"


def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def exists(spark: SparkSession, path: str) -> bool:
    fs, jpath = _fs(spark, path)
    return fs.exists(jpath)


def committed(spark: SparkSession, root: str) -> DataFrame:
    if not exists(spark, f"{root}/{COMMITS}"):
        return spark.createDataFrame([], _COMMIT_SCHEMA)
    return spark.read.schema(_COMMIT_SCHEMA).parquet(f"{root}/{COMMITS}").dropDuplicates(["batch_id"])


def is_committed(spark: SparkSession, root: str, batch_id: int) -> bool:
    return not committed(spark, root).where(F.col("batch_id") == batch_id).isEmpty()


def append(spark: SparkSession, root: str, batch_id: int, tables: dict[str, DataFrame]) -> bool:
    """Write all tables of a batch, then commit it; a batch that is already committed is skipped."""
    if is_committed(spark, root, batch_id):
        return False
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}/batch_id={batch_id}")
    spark.range(1).select(F.lit(batch_id).cast("bigint").alias("batch_id"), F.current_timestamp().alias("committed_at")).coalesce(
        1
    ).write.mode("append").parquet(f"{root}/{COMMITS}")
    return True


def read(spark: SparkSession, root: str, name: str, schema: T.StructType | None = None) -> DataFrame:
    """Rows of the committed batches, with their ``batch_id``."""
    known = schema or {**schemas.TABLES, **schemas.STORES}.get(name)
    if not exists(spark, f"{root}/{name}"):
        if known is None:
            raise ValueError(f"no such table: {name}")
        return spark.createDataFrame([], known).withColumn("batch_id", F.lit(None).cast("bigint"))
    reader = spark.read.option("basePath", f"{root}/{name}")
    if known is not None:
        reader = reader.schema(T.StructType([*known.fields, T.StructField("batch_id", T.LongType())]))
    else:
        reader = reader.option("mergeSchema", "true")
    rows = reader.parquet(f"{root}/{name}")
    done = committed(spark, root).select("batch_id")
    return rows.withColumn("batch_id", F.col("batch_id").cast("bigint")).join(done, "batch_id", "left_semi")


def bootstrap(spark: SparkSession, root: str) -> dict[str, bool]:
    """Create the table folders that are missing; a second call changes nothing."""
    created = {}
    for name in (*schemas.TABLES, *schemas.STORES):
        path = f"{root}/{name}"
        created[name] = not exists(spark, path)
        if created[name]:
            fs, jpath = _fs(spark, path)
            fs.mkdirs(jpath)
    return created
