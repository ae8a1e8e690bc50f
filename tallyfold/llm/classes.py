"""Classes of equal records, expanded to their members where a result asks for every pair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARE = 10_000  # members of a class that one task expands


def expanded(pairs: DataFrame, side: str, members: DataFrame, sizes: DataFrame, out: str) -> DataFrame:
    """`pairs` once for each member of the class `side`, as `out`; a large class is expanded by several tasks."""
    salts = F.ceil(F.coalesce("n", F.lit(1)) / SHARE)
    asking = pairs.join(sizes.withColumnRenamed("class", side), side, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("n")
    holding = members.join(sizes, "class", "left").select(F.col("class").alias(side), F.col("id").alias(out), F.pmod(F.xxhash64("id"), salts).alias("salt"))
    return asking.join(holding, [side, "salt"]).drop("salt")
