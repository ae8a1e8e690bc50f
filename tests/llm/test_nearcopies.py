"""Near-duplicate texts, against all pairs."""

import random
from datetime import datetime
from itertools import combinations

import numpy as np
import regex

from tallyfold.llm import classes as classes_of
from tallyfold.llm import nearcopies

SCHEMA = "block_id bigint, text string, ingested_at timestamp_ntz"
VOCABULARY = [a + b for a in "kalmetoriusnavepo" for b in ("ra", "té", "ON", "im", "ul", "7", "ße", "öd")]


def edited(words, n):
    words = list(words)
    for _ in range(n):
        k = random.randrange(len(words))
        what = random.choice("rid")
        if what == "r":
            words[k] = random.choice(VOCABULARY)
        elif what == "i":
            words.insert(k, random.choice(VOCABULARY))
        else:
            words.pop(k)
    return words


def sets(rows):
    out = {}
    for i, text, _ in rows:
        w = [x.lower() for x in regex.findall(r"[\p{L}\p{N}]+", text or "")]
        if len(w) >= 20:
            out[i] = frozenset(zip(w, w[1:], w[2:]))
    return out


def found(df):
    rows = [tuple(r) for r in nearcopies.found(df).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_against_all_pairs(spark):
    random.seed(2)
    t, rows = datetime(2025, 1, 1), []
    boiler = random.choices(VOCABULARY, k=12)
    for _ in range(60):
        base = random.choices(VOCABULARY, k=random.randint(18, 150))
        for _ in range(random.randint(1, 5)):
            rows.append((len(rows), ", ".join(boiler + edited(base, random.randint(0, len(base) // 12))), t))
    rows += [(900, None, t), (901, "", t), (902, "short text", t), (903, "word " * 30000, t), (904, "WORD; " * 25, t), rows[5]]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'z' as id", "'z' as key", "'z' as sketch", "'z' as a", "'z' as size")
    s = sets(rows)
    expected = {(a, b) for a, b in combinations(sorted(s), 2) if len(s[a] & s[b]) >= 0.6 * len(s[a] | s[b])}
    assert found(df) == expected and len(expected) > 40 and (903, 904) in expected
    assert found(df.where("false")) == set()


def moved(words, pieces):
    """The pieces of a text in another order, none after the piece it stood after."""
    cuts = [0, *sorted(random.sample(range(3, len(words) - 3, 3), pieces - 1)), len(words)]
    order = list(range(pieces))
    while any(b == a + 1 for a, b in zip(order, order[1:])):
        random.shuffle(order)
    return [w for k in order for w in words[cuts[k] : cuts[k + 1]]]


def test_no_isolated_pair_with_moved_passages_is_lost(spark):
    random.seed(5)
    t, rows = datetime(2025, 1, 1), []
    for k in range(1500):
        base = [f"w{k}x{i}" for i in range(60)]  # of no other pair
        rows += [(2 * k, " ".join(base), t), (2 * k + 1, " ".join(moved(base, 8)), t)]  # 44 windows of 72 in common
    assert found(spark.createDataFrame(rows, SCHEMA)) == {(2 * k, 2 * k + 1) for k in range(1500)}


def test_similar_texts_with_unlike_least_hashes_are_a_pair(spark):
    t, rows, cuts = datetime(2025, 1, 1), [], [0, 9, 17, 25, 33, 41, 47, 53, 60]
    for k in (9385, 1):  # 44 windows of 72 in common; of the first pair more than 45 of 120 bits of least hashes differ
        base = [f"w{k}x{i}" for i in range(60)]
        turned = [w for a, b in reversed(list(zip(cuts, cuts[1:]))) for w in base[a:b]]
        rows += [(2 * k, " ".join(base), t), (2 * k + 1, " ".join(turned), t)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == {(a, a + 1) for a, _, _ in rows[::2]}


def test_classes_of_copies_and_pairs_between_them(spark):
    random.seed(4)
    t = datetime(2025, 1, 1)
    base = random.choices(VOCABULARY, k=60)
    rows = [(i, " ".join(base), t) for i in range(30)] + [(100, " ".join(edited(base, 2)), t)]
    pairs, classes = nearcopies.near_copies(spark.createDataFrame(rows, SCHEMA), "block_id", "text", "ingested_at")
    assert [(r.a, r.b) for r in pairs.collect()] == [(0, 100)]
    assert {(r.id, r["class"]) for r in classes.collect()} == {(i, 0) for i in range(30)} | {(100, 100)}


def test_the_latest_delivery_counts(spark):
    old, new = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, old, datetime(2025, 1, 1)), (1, new, datetime(2025, 1, 2)), (2, old, datetime(2025, 1, 1)), (3, new, None), (None, new, None)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == {(1, 3)}


def test_thresholds_are_those_of_the_dynamic_programme():
    rng = np.random.default_rng(0)
    for n in (4, 9, 21, 40):
        level = rng.integers(0, 16, n)
        units = int(nearcopies.asked(np.array([n]), 0.6)[0])
        key, wanted = nearcopies.allocated(level, rng.permutation(n).astype(np.uint32), np.zeros(n, np.int64), np.array([0, n]), np.array([units]))
        cost = nearcopies.LEVELS[(key >> np.uint64(32) & np.uint64(15)).astype(int)][wanted].sum()
        assert wanted.sum() == units
        best = {0: 0}  # units -> least cost, partition by partition, with any number of its windows
        for at in range(0, n, 3):
            counts = np.sort(nearcopies.LEVELS[level[at : at + 3]])
            options = [(t, counts[:t].sum()) for t in range(len(counts) + 1)]
            best = {u: min(best[u - t] + c for t, c in options if u - t in best) for u in {v + t for v in best for t, _ in options}}
        assert best[units] == cost


def test_hot_windows_meet_in_cells(spark, monkeypatch):
    random.seed(6)
    t, rows = datetime(2025, 1, 1), []
    base = random.choices(VOCABULARY, k=60)
    for i in range(120):  # all windows of all texts are common
        rows.append((i, " ".join(edited(base, random.randint(0, 4))), t))
    df = spark.createDataFrame(rows, SCHEMA)
    s = sets(rows)
    expected = {(a, b) for a, b in combinations(sorted(s), 2) if len(s[a] & s[b]) >= 0.6 * len(s[a] | s[b])}
    assert found(df) == expected and len(expected) > 3000
    keys = np.arange(1000, dtype=np.int64)
    row, cell = nearcopies._cells(keys, np.full(1000, 5))
    assert len(row) == 5000 and len(set(cell.tolist())) == 15
    where = {}
    for r, c in zip(row.tolist(), cell.tolist()):
        where.setdefault(r, set()).add(c)
    assert all(where[a] & where[b] for a, b in combinations(range(60), 2))

    class Low:  # every window counts as hot
        value = type("V", (), {"level": staticmethod(lambda keys: np.full(len(keys), 15))})
    monkeypatch.setattr(nearcopies, "LEVELS", np.array([0] * 15 + [4 * nearcopies.HOT]))
    prefix = spark.createDataFrame([(i, 7, 20 + i % 3, 0, np.array([5, 9], np.uint32).tobytes()) for i in range(50)], "id bigint, h1 bigint, size int, first int, windows binary").toPandas()
    parts = next(iter([list(nearcopies.dealt(4, Low)(iter([prefix])))]))
    pairs = {}
    for p in parts:
        for r in p.itertuples(index=False):
            for m in nearcopies._met([r], 0.6, Low):
                for q in m.itertuples(index=False):
                    pairs[q.a, q.b] = pairs.get((q.a, q.b), 0) + q.n
    assert pairs == {(a, b): 2 for a, b in combinations(range(50), 2)}


def test_large_classes_are_expanded_by_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(classes_of, "SHARE", 4)
    random.seed(4)
    t = datetime(2025, 1, 1)
    base = random.choices(VOCABULARY, k=60)
    near = " ".join(edited(base, 2))
    rows = [(i, " ".join(base), t) for i in range(30)] + [(i, near, t) for i in range(100, 110)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(df) == set(combinations([r[0] for r in rows], 2))
    assert {tuple(r) for r in nearcopies.classes_and_links(df).collect()} == {(r[0], 0 if r[0] < 30 else 100, 1) for r in rows}
    assert [(r.class_a, r.class_b) for r in nearcopies.class_pairs(df).collect()] == [(0, 100)]


def test_word_hashes_are_those_of_the_words():
    texts = ["Grün, GRÜN x_y 12", "", "İstanbul it's", "\x00 zero", "a" * 500]
    hashes, counts = nearcopies.word_hashes(texts)
    assert counts.tolist()[:3] == [5, 0, 3]
    assert hashes[0] == hashes[1] and len(set(hashes.tolist()[1:5])) == 4
