"""What changed between consecutive full snapshots of an entity's records.

Keys are bucketed into hash ranges, the leaves of a Merkle tree per snapshot.  Digests are compared from the root down;
only the rows of leaves whose digests differ are compared key by key.  Every step is a partial aggregation on
(entity, snapshot, node), so an entity that holds a third of all rows is spread over its snapshots and nodes.

A snapshot meets its successor without a join: its digests are counted once for the comparison it ends and once for the
one it begins.  Digests are combined by exclusive or, so the two cancel exactly if they are equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.operators.ordering import with_next
from tallyfold.storage import written

FACTS = "array<struct<key:string,value:string,status:string>>"
NUMBER = r"^[+-]?(\d{1,3}(,\d{3})+|\d+)(\.\d*)?([eE][+-]?\d{1,2})?$"
FANOUT = 4  # children of a node
LEAF = 4  # records of the largest snapshot that share a leaf, about


def same_number(value: Column) -> Column:
    """A text that is equal for equal numbers however written, and for equal trimmed texts; null stays null."""
    text = F.trim(value)
    number = F.when(text.rlike(NUMBER), F.regexp_replace(text, ",", "").try_cast("decimal(38,12)"))
    return F.when(number.isNotNull(), F.concat(F.lit("n"), number.cast("string"))).otherwise(F.concat(F.lit("t"), text))


def tree_depth(rows: DataFrame, snapshot: list[str], fanout: int = FANOUT) -> int:
    """Levels below the root such that a leaf of the largest snapshot holds about `LEAF` records."""
    most = rows.groupBy(*snapshot).count().agg(F.max("count")).first()[0] or 0
    depth = 1
    while LEAF * fanout**depth < most:
        depth += 1
    return depth


def sides(rows: DataFrame, snapshot: str, following: str, opening: str) -> DataFrame:
    """Each row once for the comparison its snapshot ends (`new` 1) and once for the one it begins (`new` 0)."""
    side = lambda c, new: F.struct(F.col(c).alias("s"), F.lit(new).alias("new"))
    ends, begins = F.when(~F.col(opening), side(snapshot, 1)), F.when(F.col(following).isNotNull(), side(following, 0))
    rest = [c for c in rows.columns if c not in (snapshot, following, opening)]
    return rows.select(*rest, F.explode(F.array_compact(F.array(ends, begins))).alias("side")).select(*rest, F.col("side.s").alias(snapshot), F.col("side.new").alias("new"))


def changes(
    records: DataFrame, entity: list[str], snapshot: str, following: str, key: str, compared: list[str],
    first: str | None = None, fanout: int = FANOUT, depth: int | None = None,
) -> DataFrame:
    """entity columns, `snapshot` (the later one), `key`, change.

    `records` has one row per snapshot and key; rows with a null key stand for an empty snapshot, which still ends and
    begins comparisons.  `following` names the entity's next snapshot, null for the last.  `first` names the column
    that tells the records of an entity's first snapshot, which is compared with none and gives no row; without it
    those records count as added.  The tree has `fanout ** depth` leaves, by default as `tree_depth` says.
    """
    opening = F.col(first) if first else F.lit(False)
    rows = written(
        records.where(F.col(key).isNotNull()).select(
            *entity, snapshot, following, key, F.coalesce(opening, F.lit(False)).alias("__opening"),
            F.xxhash64(key).alias("__place"), F.xxhash64(key, *[F.coalesce(F.col(c), F.lit("\x00null")) for c in compared]).alias("__digest"),
        ),
        "snapshot-rows",
    )
    depth = depth or tree_depth(rows, [*entity, snapshot], fanout)
    rows = rows.withColumn("__node", F.pmod("__place", F.lit(fanout**depth)).cast("bigint")).drop("__place")
    leaf = rows.groupBy(*entity, snapshot, following, "__opening", "__node").agg(F.bit_xor("__digest").alias("__digest"))
    levels = [written(sides(leaf, snapshot, following, "__opening"), "snapshot-leaves")]
    up = F.floor(F.col("__node") / fanout).cast("bigint")
    for _ in range(depth):
        levels.append(levels[-1].groupBy(*entity, snapshot, "new", up.alias("__node")).agg(F.bit_xor(F.xxhash64("__node", "__digest")).alias("__digest")))
    differing = None
    for at in reversed(levels):
        if differing is not None:
            at = at.withColumn("__parent", up).join(differing.withColumnRenamed("__node", "__parent"), [*entity, snapshot, "__parent"], "left_semi")
        differing = at.groupBy(*entity, snapshot, "__node").agg(F.bit_xor("__digest").alias("d")).where(F.col("d") != 0).drop("d")
    both = sides(rows, snapshot, following, "__opening").join(differing, [*entity, snapshot, "__node"], "left_semi")
    diff = both.groupBy(*entity, snapshot, key).agg(F.max("new").alias("later"), F.min("new").alias("earlier"), F.bit_xor("__digest").alias("d"))
    change = F.when(F.col("earlier") == 1, "added").when(F.col("later") == 0, "removed").when(F.col("d") != 0, "changed")
    return diff.select(*entity, snapshot, key, change.alias("change")).where(F.col("change").isNotNull())


def card_snapshots(df: DataFrame) -> DataFrame:
    """One row per card, document and fact of the cards' snapshots, with the card's following document.

    A row whose facts are null, broken JSON or no JSON array is no snapshot; of several deliveries of a document for a
    card, the latest readable one counts.  Of facts with one key the last in the list counts; facts without a key count
    for nothing.  A null as_of sorts before every date; equal dates are ordered by document_id.  `is_first` tells a
    card's first snapshot.
    """
    fine = df.where(F.json_array_length("facts").isNotNull() & F.col("card_id").isNotNull() & F.col("document_id").isNotNull())
    head = fine.groupBy("card_id", "document_id").agg(
        F.max_by(F.struct("as_of", "facts"), F.struct(F.coalesce("created_at", F.lit("0001-01-01").cast("timestamp_ntz")), F.coalesce("revision", F.lit(-1)), F.coalesce("revision_id", F.lit(-1)))).alias("r")
    ).select("card_id", "document_id", F.coalesce("r.as_of", F.lit("0001-01-01").cast("date")).alias("as_of"), "r.facts")
    head = written(head, "card-heads")
    order = with_next(head.select("card_id", "document_id", "as_of"), ["card_id"], ["as_of", "document_id"], F.trunc("as_of", "quarter"), "document_id", first="is_first")
    parsed = head.select("card_id", "document_id", F.from_json("facts", FACTS).alias("f"))
    facts = parsed.select("card_id", "document_id", F.posexplode_outer("f").alias("pos", "fact")).select(
        "card_id", "document_id", "pos", F.col("fact.key").alias("fact_key"), same_number(F.col("fact.value")).alias("value"), F.trim("fact.status").alias("status")
    )
    last = facts.groupBy("card_id", "document_id", "fact_key").agg(F.max_by(F.struct("value", "status"), F.coalesce("pos", F.lit(0))).alias("f"))
    return last.select("card_id", "document_id", "fact_key", "f.value", "f.status").join(order.select("card_id", "document_id", "next_document_id", "is_first"), ["card_id", "document_id"])


def found(df: DataFrame) -> DataFrame:
    """card_id, document_id, fact_key, change for the rows of card_revisions.

    A card's first snapshot is compared with none, so it gives no row; what follows an empty snapshot is added.
    """
    return changes(card_snapshots(df), ["card_id"], "document_id", "next_document_id", "fact_key", ["value", "status"], first="is_first")
