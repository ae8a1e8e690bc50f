"""Extractions checked before they are kept, and a tagger that makes them from rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.functions import text as T
from tallyfold.functions.sentences import anchors

#: The kinds of entities, and the most words of a topic's name.
KINDS = ("company", "executive", "geography", "metric", "product", "risk", "segment", "strategy")
MOST_WORDS = 7


def checked(rows: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Each extraction with the first reason to refuse it, null if there is none."""
    known = paragraphs.groupBy("document_id", "paragraph_id").agg(F.min_by("text", "block_id").alias("paragraph"))
    at = rows.join(known, ["document_id", "paragraph_id"], "left")
    name = T.collapsed(F.col("name"))
    reason = (
        F.when(F.coalesce(F.length(name), F.lit(0)) == 0, "no name").when(~F.coalesce(F.col("entity_type").isin(*KINDS), F.lit(False)), "unknown kind")
        .when(F.col("confidence").isNull() | F.isnan("confidence") | ~F.col("confidence").between(0, 1), "confidence out of range")
        .when(F.col("paragraph").isNull(), "no such paragraph").when(F.coalesce(F.length(F.trim("quote")), F.lit(0)) == 0, "no quote")
        .when(F.size(F.split(name, " ")) > MOST_WORDS, "a phrase, not a name").when(~T.quote_located(F.col("quote"), F.col("paragraph")), "the quote is not in the paragraph")
    )
    return at.select("extracted_id", "document_id", "paragraph_id", reason.alias("reason"))


def with_sentences(rows: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Extractions whose quote is found, with the sentence of the paragraph that holds it."""
    known = paragraphs.groupBy("document_id", "paragraph_id").agg(F.min_by("text", "block_id").alias("paragraph"))
    at = rows.where("quote is not null").join(known, ["document_id", "paragraph_id"])
    return at.select("extracted_id", anchors()("quote", "paragraph").alias("sentence")).where("sentence is not null")


def tagged(paragraphs: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """block_id, name, entity_type for each rule (pattern, name, kind) that a paragraph's prose matches.

    The rules are a fixed few: they are an expression on each row.  Short lines without a full stop are headings.
    """
    prose = ~((F.size(F.split(F.trim("text"), r"\s+")) < 12) & ~F.rtrim("text").rlike(r"[.?!]$"))
    hits = F.array_compact(F.array(*[F.when(F.col("text").rlike("(?i)" + p), F.struct(F.lit(n).alias("name"), F.lit(k).alias("entity_type"))) for p, n, k in rules]))
    return paragraphs.where(prose).select("block_id", F.explode(hits).alias("h")).select("block_id", "h.name", "h.entity_type")
