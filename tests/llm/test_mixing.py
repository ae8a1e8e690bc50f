"""Mixing to target shares."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyfold.llm import mixing


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.floats(0.01, 0.99), st.integers(1, 500)), min_size=1, max_size=80), st.integers(0, 99))
def test_flight_keeps_both_totals(units, seed):
    pi, x = np.array([u[0] for u in units]), np.array([float(u[1]) for u in units])
    out = mixing.flight(pi, x, np.random.default_rng(seed))
    assert ((out > mixing.EPS) & (out < 1 - mixing.EPS)).sum() <= 2
    assert abs(out.sum() - pi.sum()) < 1e-6 and abs((out * x).sum() - (pi * x).sum()) < 1e-3
    landed = mixing.landing(out, x)
    assert set(np.unique(landed)) <= {0.0, 1.0}


def test_inclusion_probabilities_hold():
    pi, x = np.full(12, 0.3), np.arange(1.0, 13.0)
    rng = np.random.default_rng(1)
    seen = sum(mixing.flight(pi, x, rng) for _ in range(4000)) / 4000  # the landing moves the last two only
    assert np.abs(seen - 0.3).max() < 0.03


def documents(spark):
    rows = [(i, "alpha beta gamma " * (1 + i % 7), ["Big_Source", "big-source ", "small", "unlisted", None][i % 5 if i % 10 else 2]) for i in range(3000)]
    rows += [(9001, None, "small"), (9002, "", "small"), (None, "alpha", "small"), (0, rows[0][1], rows[0][2])]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("*", "'z' as tokens", "'z' as pi", "'z' as rate", "'z' as blk")


TARGETS = [("big_source", 0.6, 1), ("small", 0.3, 4), ("absent", 0.1, 2), (None, 0.5, 1)]


def test_shares_caps_and_levels(spark):
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    for block in (4096, 64):
        chosen, plan = mixing.mixed(documents(spark), targets, block=block)
        rows = chosen.collect()
        assert len(rows) == len({r.doc_id for r in rows}) and {r.source for r in rows} == {"big_source", "small"}
        report = {r.source: r for r in mixing.shares(chosen, plan).collect()}
        assert report["absent"].tokens == 0 and report["absent"].planned_share == 0
        for r in report.values():
            assert r.most_repeats <= r.max_repeats and abs(r.actual_share - r.planned_share) < 0.003
        assert abs(report["small"].actual_share - 1 / 3) < 0.003


def test_the_same_again(spark):
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    one, two = (sorted(map(tuple, mixing.mixed(documents(spark).repartition(n), targets)[0].collect())) for n in (1, 7))
    assert one == two


@pytest.mark.parametrize("none", ["documents", "targets"])
def test_empty_tables(spark, none):
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    docs = documents(spark)
    chosen, plan = mixing.mixed(docs.where("false") if none == "documents" else docs, targets.where("false") if none == "targets" else targets)
    assert chosen.count() == 0 and mixing.shares(chosen, plan).where("tokens > 0").count() == 0


def test_tokens_of_the_public_vocabulary(spark):
    row = spark.createDataFrame([("Hello world",), (None,), ("",)], "text string").select(mixing.token_count(spark)("text").alias("n")).collect()
    assert [r.n for r in row] == [2, None, 0]
