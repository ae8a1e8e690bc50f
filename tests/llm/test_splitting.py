"""Pieces of oversized texts: limits, overlap, whole coverage."""

from datetime import datetime

from hypothesis import given, settings
from hypothesis import strategies as st

from tallyfold.llm import splitting


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab .,\n!é́—x", max_size=400), st.integers(5, 60), st.integers(0, 4))
def test_pieces_cover_the_text_under_the_limit(text, limit, overlap):
    rows = splitting.pieces(text, limit, overlap)
    if not text:
        assert rows == []
        return
    assert rows[0][0] == 0 and rows[-1][1] == len(text)
    for (a, b, _), (c, d, _) in zip(rows, rows[1:]):
        assert a < c <= b < d and b - c <= overlap
    assert all(0 < b - a <= limit for a, b, _ in rows)


def test_stronger_boundaries_are_preferred():
    text = "One two three. Four five, six seven eight nine ten."
    assert [(text[a:b], k) for a, b, k in splitting.pieces(text, 27, 0)] == [("One two three. ", "sentence"), ("Four five, six seven eight ", "word"), ("nine ten.", "end")]
    assert [text[a:b] for a, b, _ in splitting.pieces(text, 27, 10)][1].startswith("three. ")
    assert splitting.pieces("x" * 10, 4, 1) == [(0, 4, "hard"), (4, 8, "hard"), (8, 10, "end")]


def test_a_letter_keeps_its_marks():
    text = "é" * 30
    assert all(text[a] == "e" for a, _, _ in splitting.pieces(text, 7, 0))


def test_another_measure():
    size = lambda s: len(s.split())
    text = " ".join(f"w{i}" for i in range(50))
    assert all(size(text[a:b]) <= 8 for a, b, _ in splitting.pieces(text, 8, 2, size))


BLOCKS = "block_id bigint, document_id bigint, accession string, section_ordinal int, paragraph_id string, text string, ingested_at timestamp_ntz"


def test_blocks_with_sections(spark):
    t = datetime(2025, 1, 1)
    long = "Sätze enden hier. " * 400
    blocks = [(1, 1, "a", 0, "1_1", long, t), (1, 1, "a", 0, "1_1", long, t), (2, 1, "a", None, "1_2", "x" * 2400, t), (3, 1, "a", None, "1_3", "é" * 2401, t), (4, 2, "b", 7, None, None, None), (5, 2, "b", 7, "2_1", "", t), (None, 2, None, 1, "9_9", "y" * 5000, None)]
    df = spark.createDataFrame(blocks, BLOCKS).selectExpr("*", "'z' as piece", "'z' as path", "'z' as title")
    sections = spark.createDataFrame([(1, 0, ["Part I", "Item 1"]), (1, 0, ["Item 1"]), (9, 9, None)], "document_id bigint, ordinal int, path array<string>").selectExpr("*", "'z' as text")
    rows = splitting.paragraph_pieces(df, sections).collect()
    one = sorted((r for r in rows if r.block_id == 1), key=lambda r: r.piece)
    assert [r.path for r in one] == [["Part I", "Item 1"]] * len(one) and all(len(r.piece_text) <= 2400 for r in rows)
    assert all(r.piece_text == long[r.piece_start : r.piece_end] for r in one) and {r.piece_cut for r in one} == {"sentence", "end"}
    assert {tuple(r) for r in splitting.found(df, sections).collect()} == {("a", "1_1"), ("a", "1_3"), (None, "9_9")}
    assert splitting.found(df.where("false"), sections.where("false")).count() == 0
