"""Text functions on literals."""

import pytest
from pyspark.sql import functions as F

from tallyfold.functions import sentences
from tallyfold.functions import text as T


def one(spark, build, *values):
    names = [f"c{i}" for i in range(len(values))]
    df = spark.range(1).select(*[F.lit(v).alias(n) for n, v in zip(names, values)])
    return df.select(build(*[F.col(n) for n in names]).alias("r")).first().r


@pytest.mark.parametrize(
    "label, key",
    [("AI Infrastructure", "ai_infrastructure"), ("A.I. infrastructure", "ai_infrastructure"), ("artificial intelligence infrastructure", "ai_infrastructure"), ("Accelerated Computing", "ai_infrastructure"), ("The R&D", "rd"),
     ("U.S. export restrictions", "united_states_export_restrictions"), ("Export Restrictions", "export_controls"), ("CapEx", "capex"), ("our  ML & AI", "machine_learning_ai"), ("!!!", "unknown"), ("", "unknown")],
)
def test_entity_keys(spark, label, key):
    assert one(spark, T.entity_key, label) == key


@pytest.mark.parametrize("name", ["Mr. Jane Roe", "Jane Roe", "JANE ROE", "Roe, Jane", "Dr Jane Roe, PhD", "Jane Roe Jr."])
def test_one_person(spark, name):
    assert one(spark, T.person, name) == "jane roe"


def test_small_ones(spark):
    assert one(spark, T.normalised, "  A\xa0 b\n C ") == "a b c"
    assert one(spark, T.slug, " Export -- Controls! ") == "export-controls"
    assert one(spark, T.metric, "Net Revenue") == "revenue" and one(spark, T.metric, "Total cost") == "total cost"
    assert one(spark, lambda a: T.paragraph_page(a, F.lit(9)), "16_4#2") == 16 and one(spark, lambda a: T.paragraph_page(a, F.lit(9)), "t_1") == 9 and one(spark, lambda a: T.paragraph_page(a, F.lit(9)), "0_1") == 9
    assert [one(spark, T.direction, *p) for p in (("$1,200", "1300"), ("5", "4"), ("5", "5.0"), ("five", "6"), (None, "1"))] == ["rose", "fell", "held", "changed", "changed"]
    assert one(spark, lambda t: T.shingles(T.said(t)), "a b c d e a b c d") == ["a b c d", "b c d e", "c d e a", "d e a b", "e a b c"]
    assert one(spark, lambda t: T.shingles(T.said(t)), "a b") == ["a b"] and one(spark, lambda t: T.shingles(T.said(t)), "") == []
    assert one(spark, T.has_name, "the U.S. government", "U.S.") and not one(spark, T.has_name, "Chinatown", "China") and not one(spark, T.has_name, "x", "")
    assert one(spark, T.quote_located, "the “board” said", 'THE "BOARD"  said so') and not one(spark, T.quote_located, " ", "text")
    assert one(spark, T.chunk_hash, "c", "a", 1, "T") != one(spark, T.chunk_hash, "c", "a", 2, "T") and one(spark, T.chunk_hash, "c", "a", 1, "T ") == one(spark, T.chunk_hash, "c", "a", 1, " t")


def test_sentences():
    text = 'The U.S. unit of Acme Inc. grew. "It did!" No. 4 was sold? J. Roe left. yes'
    assert [text[a:b] for a, b in sentences.spans(text)] == ["The U.S. unit of Acme Inc. grew.", '"It did!"', "No. 4 was sold?", "J. Roe left. yes"]
    assert sentences.spans("") == [] and sentences.spans("  one  ") == [(2, 5)]


def test_quotes_in_place():
    p = "We sell chips. Exports of certain chips to China, and to Russia, are barred—today. More."
    assert sentences.placed("exports of  certain", p) == (15, 33)
    assert sentences.anchored("certain chips ... Russia", p) == "Exports of certain chips to China, and to Russia, are barred—today."
    assert sentences.anchored("barred-today", p).startswith("Exports") and sentences.anchored("nothing", p) is None and sentences.anchored(None, p) is None
    long = "word " * 200 + "needle " + "word " * 50
    assert sentences.anchored("needle", long) == "needle"
