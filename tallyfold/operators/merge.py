"""Keyed merges: what a sequence of writes to one key leaves, as one partial aggregation.

Writes carry their order, so first and last are explicit and a second run over the same writes changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POLICIES = {
    "first": lambda c, o: F.min_by(c, o),
    "last": lambda c, o: F.max_by(c, o),
    "last_known": lambda c, o: F.max_by(c, F.when(F.col(c).isNotNull(), o)),
    "first_known": lambda c, o: F.min_by(c, F.when(F.col(c).isNotNull(), o)),
    "least": lambda c, o: F.min(c),
    "greatest": lambda c, o: F.max(c),
    "total": lambda c, o: F.sum(c),
    "set": lambda c, o: F.sort_array(F.collect_set(c)),
}


def upserted(writes: DataFrame, keys: list[str], order: list[str], policies: dict[str, str], counted: str | None = None) -> DataFrame:
    """One row per key; each column by its policy over the key's writes in `order`."""
    at: Column = F.struct(*order)
    aggs = [POLICIES[p](c, at).alias(c) for c, p in policies.items()]
    if counted:
        aggs.append(F.count("*").alias(counted))
    return writes.groupBy(*keys).agg(*aggs)


def inserted_if_absent(writes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first write of each key; nulls of a key are equal."""
    rest = [c for c in writes.columns if c not in keys]
    return writes.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*").select(*writes.columns)


def changed_deliveries(writes: DataFrame, key: str, digest: str, order: list[str]) -> DataFrame:
    """Deliveries whose content differs from the key's delivery before: what an ingest has to process."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(*order)  # one key's deliveries: a handful
    return writes.withColumn("__before", F.lag(digest).over(w)).where(~F.col(digest).eqNullSafe(F.col("__before"))).drop("__before")


def replaced(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """`existing` with all rows of the keys in `new` replaced by those of `new`."""
    return existing.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def dropped_marked(entities: DataFrame, newest: DataFrame, company: str, kind: str) -> DataFrame:
    """Active entities of a kind not seen in their company's newest filing, as dropped."""
    rows = entities.join(newest, company, "left")
    gone = (F.col("entity_type") == kind) & (F.col("latest_seen") < F.col("newest"))
    return rows.withColumn("status", F.when(gone, "dropped").otherwise("active")).drop("newest")


def observations(rows: DataFrame) -> DataFrame:
    """Metric observations of (cik, metric, period, document_id), each once, with whether an earlier document gave that period.

    A null period is one nobody can match, so it restates nothing.
    """
    from pyspark.sql import Window

    once = inserted_if_absent(rows, ["cik", "metric", "period", "document_id"], ["filed_at", "mention_id"])
    w = Window.partitionBy("cik", "metric", "period").orderBy("filed_at", "document_id")  # a period's documents: a few
    return once.withColumn("restated", F.col("period").isNotNull() & (F.row_number().over(w) > 1))
