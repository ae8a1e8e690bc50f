"""Leaked passages, against a search for every window of words."""

import random

import pytest

from tallyfold.llm import leaks

WORDS = [f"w{i}" for i in range(60)]


def frames(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "'z' as part", "'z' as words", "'z' as item_id")
    return d, spark.createDataFrame(items, "item_id bigint, passage string, question string").selectExpr("*", "'z' as doc_id", "'z' as text")


def brute(docs, items, n=15):
    out = set()
    for i, passage, _ in items:
        p = leaks.words_of(passage or "")
        mine = {tuple(p[k : k + n]) for k in range(len(p) - n + 1)}
        for d, text in docs:
            w = leaks.words_of(text or "")
            if any(tuple(w[k : k + n]) in mine for k in range(len(w) - n + 1)):
                out.add((d, i))
    return out


def test_against_brute_force(spark):
    random.seed(5)
    items = [(i, " ".join(random.choices(WORDS, k=random.randint(15, 60))), None) for i in range(12)] + [(98, None, None), (99, "", "")]
    docs = [(0, None), (1, "")]
    for d in range(2, 80):
        p = random.choice(items[:12])[1].split()
        k, n = random.randint(0, len(p) - 1), random.randint(10, 20)
        docs.append((d, " ".join(random.choices(WORDS, k=20)) + ", " + "; ".join(p[k : k + n]).upper() + ". " + " ".join(random.choices(WORDS, k=20))))
    d, i = frames(spark, docs, items)
    got = {tuple(r) for r in leaks.found(d, i).collect()}
    assert got == brute(docs, items) and len(got) > 10
    assert {tuple(r) for r in leaks.leaks(d, i, block=100).where("part = 'passage'").select("doc_id", "item_id").distinct().collect()} == got
    assert leaks.found(d.where("false"), i).count() == 0
    assert leaks.found(d, i.where("false")).count() == 0


def test_offsets_point_into_the_original(spark):
    passage = " ".join(f"café{i}" for i in range(20))
    hidden = "Ｘｘ ﬁ … ­" + " ".join(f"CAFÉ​{i}" for i in range(2, 19)) + "! tail é"
    d, i = frames(spark, [(1, hidden)], [(7, passage, "what is café5")])
    rows = leaks.leaks(d, i).collect()
    (row,) = [r for r in rows if r.part == "passage"]
    assert row.words == 17
    assert hidden[row.start : row.end].startswith("CAFÉ​2") and hidden[row.start : row.end].endswith("18")


@pytest.mark.parametrize("n", [14, 15])
def test_the_least_run(spark, n):
    passage = " ".join(f"p{i}" for i in range(40))
    d, i = frames(spark, [(1, "x " + " ".join(f"p{k}" for k in range(9, 9 + n)) + " y")] * 2, [(1, passage, None)] * 2)
    assert leaks.found(d, i).count() == (n == 15)


def test_a_question_counts_as_a_whole(spark):
    d, i = frames(spark, [(1, "So: what is the LEVEL of tax? Yes"), (2, "what is the level of")], [(1, None, "What is the level of tax?")])
    assert [(r.doc_id, r.part) for r in leaks.leaks(d, i).collect()] == [(1, "question")]


def test_a_passage_under_the_least_run_is_no_case(spark):
    short = "one two three four five six seven eight nine ten"
    d, i = frames(spark, [(1, f"So {short} it goes."), (2, "İSTANBUL " * 20)], [(1, short, None), (2, "i̇stanbul " * 16, None), (3, "istanbul " * 16, None)])
    assert {tuple(r) for r in leaks.found(d, i).collect()} == brute([(2, "İSTANBUL " * 20)], [(2, "i̇stanbul " * 16, None), (3, "istanbul " * 16, None)])
    assert {(r.item_id, r.words) for r in leaks.leaks(d, i).where("item_id = 1").collect()} == {(1, 10)}
