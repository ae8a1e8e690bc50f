"""The consistent form, and texts that are equal in it."""

import random

from tallyfold.llm import classes, consistent

SCHEMA = "doc_id bigint, text string"


def forms(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    return {r.doc_id: r.consistent for r in consistent.consistent(df, "doc_id", "text").collect()}


CASES = [
    ("ｆｕｌｌ　ｗｉｄｔｈ１", "full width1"), ("ﬁle oﬀer", "file offer"), ("café", "café"), ("a​b­c﻿", "abc"), ("a b c", "a b c"),
    ("соре", "cope"), ("q̣̇", "q̣̇"), ("x²", "x²"), ("Part Ⅱ", "Part II"), ("tab\tand\nline", "tab\tand\nline"), ("‘quoted’", "‘quoted’"), ("𝒳", "𝒳"), ("한국", "한국"),
    ("Հօսո", "Հoun"), ("ᎢᎬᎪ", "TEA"), ("ⲤⲞⲆⲈ", "COⲆE"), ("ɡɑp", "gap"), ("αυρ", "aup"),
]


def test_form_of_each_sort_of_difference(spark):
    got = forms(spark, [a for a, _ in CASES])
    assert got == {i: b for i, (_, b) in enumerate(CASES)}
    assert [consistent.consistent_text(a) for a, _ in CASES] == [b for _, b in CASES]
    assert forms(spark, [b for _, b in CASES]) == got  # the form of a form is itself


def test_null_empty_and_long_texts(spark):
    long = "é" * 30000 + "ｘ" * 100
    assert forms(spark, [None, "", long]) == {0: None, 1: "", 2: "é" * 30000 + "x" * 100}


def test_repeated_rows_and_texts_of_one_key(spark):
    df = spark.createDataFrame([(1, "é"), (1, "é"), (1, "ｘé"), (2, "e\u0301")], SCHEMA)
    assert sorted((r.doc_id, r.consistent) for r in consistent.consistent(df, "doc_id", "text").collect()) == [(1, "xé"), (1, "é"), (1, "é"), (2, "é")]
    assert [tuple(r) for r in consistent.found(df).collect()] == [(1, 2)]


def test_found_pairs(spark, monkeypatch):
    texts = {1: "file é", 2: "ﬁle é", 3: "ﬁle é", 4: "file é", 5: "file e", 6: "File é", 7: "", 8: None, 9: "file é", 10: "x2", 11: "x²"}
    df = spark.createDataFrame(list(texts.items()), SCHEMA).selectExpr("*", "'z' as form", "'z' as raw", "'z' as k")
    got = {tuple(r) for r in consistent.found(df).collect()}
    same = [(1, 2), (1, 3), (1, 4), (2, 4), (3, 4), (2, 9), (3, 9), (4, 9)]
    assert got == set(same)
    monkeypatch.setattr(classes, "SHARE", 1)  # every class is split
    assert {tuple(r) for r in consistent.found(df).collect()} == set(same)
    assert consistent.found(df.where("false")).count() == 0


def test_every_mapped_character_is_stable():
    for ch, to in consistent.mapping().items():
        once = consistent.consistent_text(ch)
        assert consistent.consistent_text(once) == once, (hex(ord(ch)), to)


def test_ordering_and_composing_are_those_of_the_database(spark):
    rng = random.Random(7)
    pool = ["a", "e", "q", "é", "ậ", "ὄ", "가", "ᄀ", "ᅡ", "ᆨ", "か", "ﾊ", "ﾞ", "゛", "\u09c7", "\u09be", "क", "़", "ﬁ", " ", "\u00a0", "\u200b", "е", "\n", "文", "\u0344", "\u2126", "\u212b", "\ufb1f", "\ufe0f"]
    marks = [chr(c) for c in range(0x300, 0x370)] + [chr(c) for c in (0x591, 0x5B0, 0x64B, 0x670, 0x0E38, 0x0F71, 0x302A, 0x3099, 0x20D0)]
    texts = ["".join(rng.choice(pool if rng.random() < 0.5 else marks) for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    every = [chr(c) + rest for c in (*range(0x80, 0x3100), *range(0xF900, 0xFFFE), *range(0x1D100, 0x1D200)) for rest in ("", "\u0301")]
    df = spark.createDataFrame(list(enumerate(texts + every)), SCHEMA)
    got = {r.doc_id: r.consistent for r in consistent.consistent(df, "doc_id", "text").collect()}
    bad = [(t, got[i], consistent.consistent_text(t)) for i, t in enumerate(texts + every) if got[i] != consistent.consistent_text(t)]
    assert not bad, bad[:5]
