"""Changes between consecutive snapshots, against a plain comparison."""

import json
import random
from datetime import date, datetime, timedelta

from tallyfold.operators import snapshots

SCHEMA = "revision_id bigint, card_id bigint, kind string, revision int, as_of date, document_id bigint, source_note string, facts string, delta string, created_at timestamp_ntz"


def frame(spark, rows):
    """rows: (card, document, as_of, facts)"""
    data = [(i, c, "risks", i, day, doc, None, facts, None, datetime(2025, 1, 1) + timedelta(hours=i)) for i, (c, doc, day, facts) in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA)


def result(df):
    rows = [tuple(r) for r in snapshots.found(df).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def fact(key, **rest):
    return {"key": key, "label": key.title(), **rest}


def test_what_is_a_change(spark):
    rows = [
        (1, 10, date(2020, 1, 1), json.dumps([fact("a", value="4,815.00", status="open"), fact("b", value="x"), fact("c", value=1), fact("d", status="met")])),
        (1, 11, date(2021, 1, 1), json.dumps([fact("c", value="1.000", status=None), fact("a", status="open", value=4815, unit="USD", evidence={"page": 3}), fact("b", value="y"), fact("e"), fact("d", status="open")])),
    ]
    # the first snapshot is compared with none
    assert result(frame(spark, rows)) == {(1, 11, "b", "changed"), (1, 11, "d", "changed"), (1, 11, "e", "added")}


def test_null_broken_repeated_late_and_empty_deliveries(spark):
    a, b = json.dumps([fact("a", value="1")]), json.dumps([fact("a", value="2")])
    rows = [
        (1, 12, date(2022, 1, 1), "[]"),
        (1, 10, date(2020, 1, 1), a),
        (1, 13, date(2023, 1, 1), None),
        (1, 14, date(2023, 2, 1), a[:-3]),
        (1, 15, date(2023, 3, 1), '{"key": "a"}'),
        (1, 11, date(2021, 1, 1), b),
        (1, 10, date(2020, 1, 1), a),
        (1, 11, date(2021, 1, 1), None),
        (None, 11, date(2021, 1, 1), a),
        (1, None, date(2021, 1, 1), a),
        (2, 11, None, a),
    ]
    assert result(frame(spark, rows)) == {(1, 11, "a", "changed"), (1, 12, "a", "removed")}
    assert result(frame(spark, rows).where("false")) == set()


def test_extra_columns_and_repeated_keys(spark):
    rows = [(1, 9, date(2019, 1, 1), "[]"), (1, 10, date(2020, 1, 1), json.dumps([fact("a", value="1"), fact("a", value="2"), {"label": "no key"}]))]
    df = frame(spark, rows).selectExpr("*", "'z' as leaf", "'z' as node", "'z' as digest", "'z' as side", "'z' as fact_key")
    assert result(df) == {(1, 10, "a", "added")}


def test_against_a_plain_comparison(spark):
    random.seed(3)
    rows, by_card = [], {}
    for card in range(6):
        state = {}
        for n in range(12):
            for key in random.sample("abcdefghijklmnop", 3):
                if random.random() < 0.4:
                    state.pop(key, None)
                else:
                    state[key] = (random.choice(["1", "2", None]), random.choice(["open", None]))
            doc, day = card * 100 + n, date(2020, 1, 1) + timedelta(days=40 * n)
            by_card.setdefault(card, []).append((doc, dict(state)))
            rows.append((card, doc, day, json.dumps([fact(k, value=v, status=s) for k, (v, s) in state.items()])))
    expected = set()
    for card, versions in by_card.items():
        before = versions[0][1]
        for doc, now in versions[1:]:
            expected |= {(card, doc, k, "added") for k in now.keys() - before.keys()} | {(card, doc, k, "removed") for k in before.keys() - now.keys()}
            expected |= {(card, doc, k, "changed") for k in now.keys() & before.keys() if now[k] != before[k]}
            before = now
    random.shuffle(rows)
    assert result(frame(spark, rows)) == expected


def test_a_deeper_tree_gives_the_same(spark):
    rows = spark.createDataFrame([(1, 1, 2, f"k{i}", "v") for i in range(50)] + [(1, 2, None, f"k{i}", "v" if i % 7 else "w") for i in range(1, 51)], "e int, s int, n int, k string, v string")
    expect = {("k0", "removed"), ("k50", "added")} | {(f"k{i}", "changed") for i in range(7, 50, 7)}
    for fanout, depth in ((2, 6), (4, 2), (8, 1), (4, None)):
        got = snapshots.changes(rows, ["e"], "s", "n", "k", ["v"], fanout=fanout, depth=depth).where("s = 2").select("k", "change").collect()
        assert {tuple(r) for r in got} == expect


def test_a_first_snapshot_is_compared_with_none(spark):
    one, two = json.dumps([fact("a", value="1"), fact("b")]), json.dumps([fact("a", value="1"), fact("c")])
    first_unreadable = [(1, 9, date(2019, 1, 1), "[{"), (1, 10, date(2020, 1, 1), one), (1, 11, date(2021, 1, 1), two)]
    first_empty = [(2, 9, date(2019, 1, 1), "[]"), (2, 10, date(2020, 1, 1), one)]
    delivered_late = [(3, 21, date(2021, 1, 1), one), (3, 20, date(2018, 1, 1), two)]
    alone = [(4, 30, date(2021, 1, 1), one)]
    got = result(frame(spark, first_unreadable + first_empty + delivered_late + alone))
    assert got == {(1, 11, "b", "removed"), (1, 11, "c", "added"), (2, 10, "a", "added"), (2, 10, "b", "added"), (3, 21, "b", "added"), (3, 21, "c", "removed")}


def test_the_tree_grows_with_the_snapshots(spark):
    df = spark.createDataFrame([(1, k) for k in range(300)] + [(2, 0)], "s int, k int")
    assert snapshots.tree_depth(df, ["s"]) == 4 and snapshots.tree_depth(df.where("s = 2"), ["s"]) == 1 and snapshots.tree_depth(df.where("false"), ["s"]) == 1
