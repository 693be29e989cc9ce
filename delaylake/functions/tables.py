"""Written tables in the shared folder, and dense numbers without a single task."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where unset, a temporary folder in local mode, else one below the warehouse."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if spark.sparkContext.master.startswith("local["):
        base = tempfile.mkdtemp(prefix="delaylake-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
        return base
    return f"{spark.conf.get('spark.sql.warehouse.dir')}/_delaylake"


def session_folder(spark: SparkSession) -> str:
    """The application's own part of the shared folder; it can be deleted when the application has ended."""
    return f"{shared_folder(spark)}/delaylake-{spark.sparkContext.applicationId}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` in the shared folder and read it back: lineage ends there."""
    path = f"{session_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list, name: str, label: str = "numbered") -> DataFrame:
    """``df`` with dense numbers 0, 1, ... in ``order``.

    A range sort gives each task a run of the order; the tasks' counts, one row a task, give
    the offsets. No window over all rows.
    """
    rows = cut(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), label)
    task, place = F.shiftrightunsigned("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    counts = rows.groupBy(task.alias("_task")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("_task", F.coalesce(before, F.lit(0)).alias("_before"))
    joined = rows.withColumn("_task", task).join(F.broadcast(offsets), "_task")
    return joined.withColumn(name, F.col("_before") + place).drop("_task", "_at", "_before")


def positions(df: DataFrame, groups: list[str], order: list, name: str, size: str | None = None) -> DataFrame:
    """``df`` with places 0, 1, ... inside each group (nulls equal) in ``order``, and the group's size; no group is one task's."""
    ranked = numbered(df, [*groups, *order], "_rank", "positions")
    spans = ranked.groupBy(*groups).agg(F.min("_rank").alias("_first"), F.count(F.lit(1)).alias("_count"))
    out = null_safe(ranked, spans, groups, "inner").withColumn(name, F.col("_rank") - F.col("_first"))
    if size:
        out = out.withColumn(size, F.col("_count"))
    return out.drop("_rank", "_first", "_count")


def medians(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Exact medians (mean of the middle two, nulls ignored) of ``values`` for each group, nulls in keys equal.

    One range sort of all values; a group of any size is spread over tasks.
    """
    names = F.array(*[F.struct(F.lit(v).alias("_name"), F.col(v).alias("_value")) for v in values])
    long = rows.select(*keys, F.explode(names).alias("_v")).select(*keys, "_v._name", "_v._value").filter("_value is not null")
    group = [*keys, "_name"]
    ranked = numbered(long, [*group, "_value"], "_rank", "medians")
    spans = ranked.groupBy(*group).agg(F.min("_rank").alias("_first"), F.count(F.lit(1)).alias("_n"))
    named = spans.select(*[F.col(g).alias(f"_g_{g}") for g in group], "_first", "_n")
    same = F.lit(True)
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    inside = ranked.join(named, same)
    low, high = F.col("_first") + F.floor((F.col("_n") - 1) / 2), F.col("_first") + F.floor(F.col("_n") / 2)
    middle = inside.filter((F.col("_rank") == low) | (F.col("_rank") == high)).groupBy(*keys).pivot("_name", values).agg(F.avg("_value"))
    return middle


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join in which nulls in keys are equal; the keys come from the left."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") if k in keys else F.col(k) for k in right.columns])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])
