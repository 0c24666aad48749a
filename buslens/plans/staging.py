"""Where intermediate tables live, and the size checks that decide how a step is planned."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

# Rows of one group that a single task may hold. Groups beyond it take the blocked plans.
MAX_GROUP_ROWS = 2_000_000
# Rows of a side that may be broadcast, however well its files are packed.
MAX_SIDE_ROWS = 100_000

_LOCAL_DIRS: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """Shared folder for written tables: spark.checkpoint.dir, or an own one on a local master."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        return shared.rstrip("/")
    app = spark.sparkContext.applicationId
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = "file://" + tempfile.mkdtemp(prefix="buslens-")
    return _LOCAL_DIRS[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str = "stage", **options: str) -> DataFrame:
    """Write the table to the shared folder and read it back: lineage ends at durable files. Options go to the writer."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sized(df: DataFrame) -> DataFrame:
    """Write a small side before a join.

    The planner then knows the size of its files and broadcasts it only below
    spark.sql.autoBroadcastJoinThreshold; a larger side gets a shuffle join. Packed files
    can be a hundredth of the rows in memory, so a side of many rows always gets one.
    """
    seen = Observation()
    side = staged(df.observe(seen, F.count(F.lit(1)).alias("rows")), "side")
    return side.hint("merge") if seen.get.get("rows", 0) > MAX_SIDE_ROWS else side


def keep_where(df: DataFrame, test: Column) -> DataFrame:
    """Filter on a column that was costly to work out.

    A plain filter is moved below the steps that made its columns, which repeats
    their expressions; a generated flag is not.
    """
    return df.withColumn("__keep", F.explode_outer(F.array(F.when(test, True)))).where("__keep").drop("__keep")


def is_large(df: DataFrame, keys: list[str], max_group_rows: int = MAX_GROUP_ROWS) -> bool:
    """True if some group holds more rows than one task should order or buffer."""
    counts = df.groupBy(*keys).count() if keys else df.agg(F.count(F.lit(1)).alias("count"))
    biggest = counts.agg(F.max("count")).first()[0]
    return (biggest or 0) > max_group_rows


def same_keys_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi join on key columns in which NULL equals NULL, as in grouping."""
    renamed = right.select(*[F.col(c).alias(f"__{c}") if c in keys else F.col(c) for c in right.columns])
    cond = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys])
    return left.join(renamed, cond, how).drop(*[f"__{c}" for c in keys])
