"""Summary cards: which parts of a filing feed which card, the facts of each, and the card's revisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.functions import text as T
from tallyfold.operators.snapshots import changes
from tallyfold.operators.timeline import ANNUAL

#: By rule, the card and what a fragment must match; an empty field matches anything.
RULES = (
    ("revenue", "10-K|10-Q", "", "", ""),
    ("products", "", "earnings_call", "", ""),
    ("guidance", "", "", "", "CEO"),
    ("risks", "", "", r"item\s*1a|risk\s*factors", ""),
    ("capex", "", "", r"cash\s*flow|capital\s*expend", ""),
    ("litigation", "", "", r"item\s*3|legal\s*proceedings", ""),
)


def routed(fragments: DataFrame, form: str, kind: str, section: str, role: str) -> DataFrame:
    """`cards`: the cards that a fragment updates, in the order of the rules.

    The rules are a fixed few, so they are an expression on each row, not a join.
    """

    def matches(rule: tuple[str, str, str, str, str]):
        _, forms, kinds, pattern, roles = rule
        ok = F.lit(True)
        for value, column in ((forms, form), (kinds, kind), (roles, role)):
            if value:
                ok = ok & F.coalesce(F.col(column).isin(*value.split("|")), F.lit(False))
        return ok & F.coalesce(F.col(section).rlike("(?i)" + pattern), F.lit(False)) if pattern else ok

    hits = F.array_compact(F.array(*[F.when(matches(r), F.lit(r[0])) for r in RULES]))
    return fragments.withColumn("cards", F.array_distinct(hits))


def projected(mentions: DataFrame, paragraphs: DataFrame, sections: DataFrame) -> DataFrame:
    """Facts of the risk and litigation cards of annual filings: card, filing, topic, paragraphs, first citation in reading order."""
    titles = sections.groupBy("document_id", F.col("ordinal").alias("section_ordinal")).agg(F.min("title").alias("title"))
    places = paragraphs.groupBy("document_id", "paragraph_id").agg(F.min("section_ordinal").alias("section_ordinal"))
    rows = mentions.where(F.col("form_type").isin(*ANNUAL)).join(places, ["document_id", "paragraph_id"]).join(titles, ["document_id", "section_ordinal"], "left")
    rows = rows.withColumns({"doc_kind": F.lit(None).cast("string"), "role": F.lit(None).cast("string")})
    rows = routed(rows, "form_type", "doc_kind", "title", "role").select("*", F.explode("cards").alias("card")).where(F.col("card").isin("risks", "litigation"))
    order = F.struct(T.reading_order(F.col("paragraph_id"), F.lit(None).cast("int"), F.lit(0)).alias("o"), F.col("mention_id"))
    return rows.groupBy("cik", "card", "document_id", "filed_at", "slug").agg(F.count_distinct(T.base_paragraph(F.col("paragraph_id"))).alias("paragraphs"), F.min_by("mention_id", order).alias("mention_id"))


def revisions(facts: DataFrame) -> DataFrame:
    """Revision numbers of the filings that gave a card facts, oldest first."""
    w = Window.partitionBy("cik", "card").orderBy("filed_at", "document_id")
    rows = facts.groupBy("cik", "card", "document_id", "filed_at").agg(F.count("*").alias("facts"))
    return rows.select("cik", "card", "document_id", "filed_at", "facts", F.row_number().over(w).alias("revision"), F.lead("document_id").over(w).alias("following"))


def card_changes(facts: DataFrame) -> DataFrame:
    """Topics added to and removed from a card by each of its revisions."""
    r = revisions(facts).select("cik", "card", "document_id", "following")
    rows = facts.join(r, ["cik", "card", "document_id"]).withColumn("present", F.lit("yes"))
    return changes(rows, ["cik", "card"], "document_id", "following", "slug", ["present"])
