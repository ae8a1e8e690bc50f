"""The next row of an entity in time, with hot entities split by period."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_next(df: DataFrame, entity: list[str], order: list[str], period: Column, take: str, first: str | None = None) -> DataFrame:
    """Add `next_<take>`: the value of `take` in the entity's next row by `order`, null for its last.

    `first` names a boolean column that tells the entity's first row, where one is wanted.  Rows are sorted within (entity, period), so no task sorts more than one period of one entity; only one row per
    (entity, period) is looked at across periods.  `period` must not decrease along `order`.
    """
    rows = df.withColumn("__period", period)
    within = Window.partitionBy(*entity, "__period").orderBy(*order)
    rows = rows.withColumn("__next", F.lead(take).over(within))
    if first:
        rows = rows.withColumn("__head", F.row_number().over(within) == 1)
    firsts = rows.groupBy(*entity, "__period").agg(F.min_by(take, F.struct(*order)).alias("__first"))
    across = Window.partitionBy(*entity).orderBy("__period")
    firsts = firsts.withColumn("__after", F.lead("__first").over(across)).withColumn("__opens", F.row_number().over(across) == 1).select(*entity, "__period", "__after", "__opens")
    joined = rows.join(firsts, [*entity, "__period"], "left")
    if first:
        joined = joined.withColumn(first, F.col("__head") & F.coalesce("__opens", F.lit(True))).drop("__head")
    return joined.withColumn(f"next_{take}", F.coalesce("__next", "__after")).drop("__period", "__next", "__after", "__opens")


def with_sum_before(df: DataFrame, entity: list[str], order: list[str], period: Column, value: Column, name: str) -> DataFrame:
    """Add `name`: the sum of `value` over the entity's rows before this one by `order`, 0 for its first.

    Rows are sorted within (entity, period) only; what earlier periods add up to comes from one row per period.
    `period` must not decrease along `order`.
    """
    rows = df.withColumns({"__period": period, "__value": value})
    keys = [*entity, "__period"]
    before = lambda *k: Window.partitionBy(*k)
    sums = rows.groupBy(*keys).agg(F.sum("__value").alias("__sum"))
    carried = sums.withColumn("__carried", F.sum("__sum").over(before(*entity).orderBy("__period").rowsBetween(Window.unboundedPreceding, -1))).select(*keys, "__carried")
    inside = rows.withColumn("__inside", F.sum("__value").over(before(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)))
    same = [inside[k].eqNullSafe(carried[k]) for k in keys]
    joined = inside.join(carried, reduce(lambda a, b: a & b, same), "left").select(*[inside[c] for c in inside.columns], "__carried")
    zero = F.lit(0)
    return joined.withColumn(name, F.coalesce("__carried", zero) + F.coalesce("__inside", zero)).drop("__period", "__value", "__inside", "__carried")
