"""Global positions without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.plans.runtime import materialize


def with_global_index(df: DataFrame, order: list[Column], name: str = "global_index") -> DataFrame:
    """Add a 0-based dense position of each row in ``order``.

    Rows are dealt by range, numbered inside each range, and shifted by the
    row counts of the ranges before; only one count per partition meets in
    one place. Ties get neighbouring numbers; an empty table stays empty.
    """
    ranged = materialize(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = ranged.groupBy("__range").count().select("__range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__shift"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1
    return ranged.join(F.broadcast(shifts), "__range").withColumn(name, inside.cast("long") + F.col("__shift")).drop("__range", "__shift")


def running_total(df: DataFrame, order: list[Column], weight: str, before: str = "before", upto: str = "upto") -> DataFrame:
    """Adds the sums of ``weight`` over all rows earlier in ``order`` (total, without ties), without and with the row's own."""
    ranged = materialize(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    ahead = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = ranged.groupBy("__range").agg(F.sum(weight).alias("__sum")).select("__range", F.coalesce(F.sum("__sum").over(ahead), F.lit(0)).alias("__shift"))
    inside = F.sum(weight).over(Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    out = ranged.join(F.broadcast(shifts), "__range").withColumn(upto, inside + F.col("__shift"))  # one row for each partition
    return out.withColumn(before, F.col(upto) - F.col(weight)).drop("__range", "__shift")


def zip_rows(left: DataFrame, right: DataFrame, left_order: list[Column], right_order: list[Column], name: str = "position") -> DataFrame:
    """Rows of both sides that have the same position, by explicit orders; rows beyond the shorter side stay with nulls."""
    return with_global_index(left, left_order, name).join(with_global_index(right, right_order, name), name, "full")
