"""Markup, listings, chunks, timeline, graph, merges on literals."""

import json
import random
from datetime import date, datetime
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyfold.operators import carried, chunks, evidence, extraction, graph, merge, ordering, retrieval, timeline
from tallyfold.operators import cards as cards_of
from tallyfold.plans import streams
from tallyfold.sources import markup, submissions, tables
from tallyfold.streaming import ledger

PAGE = """<html><head><title>no</title></head><body><ix:header><p>machine</p></ix:header>
<p>PART I</p><h2>Item 1A. Risk Factors</h2><p>First <b>bold</b> words &amp; more.</p>
<p>Item 7 of this report describes at great length what the management of the company thinks of its results and of the market in general.</p>
<div style="page-break-after: always"></div><div>Second page.<br/>Broken line.</div>
<div style="display:none"><p>hidden</p></div>
<table><tr><td>Only</td></tr><tr><td>layout</td></tr></table>
<table><tr><th>Year</th><th>Sales</th></tr><tr><td></td><td> </td></tr><tr><td>2024</td><td>1 <table><tr><td>x</td></tr></table></td></tr></table>
<p>ITEM 2. Properties</p><p>Last"""


def test_markup(spark):
    rows = markup.parsed(spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, "plain < text")], "document_id bigint, html string")).collect()
    one = [r for r in rows if r.document_id == 1]
    assert [(r.level, r.title, list(r.path), r.page, r.end_page) for r in one if r.kind == "section"] == [
        (1, "PART I", ["PART I"], 1, 1), (2, "Item 1A. Risk Factors", ["PART I", "Item 1A. Risk Factors"], 1, 2), (2, "ITEM 2. Properties", ["PART I", "ITEM 2. Properties"], 2, 2)]
    blocks = [(r.paragraph_id, r.text, r.section) for r in one if r.kind == "block"]
    assert [b for b in blocks if b[1] != blocks[1][1]] == [("1_1", "First bold words & more.", 1), ("2_1", "Second page.", 1), ("2_2", "Broken line.", 1), ("2_3", "Only layout", 1), ("2_4", "Last", 2)]
    assert blocks[1][1].startswith("Item 7 of this report")
    (table,) = [r for r in one if r.kind == "table"]
    assert table.cells[0] == ["Year", "Sales"]
    assert [(r.document_id, r.text) for r in rows if r.document_id > 1] == [(4, "plain < text")]


def test_listings(spark, tmp_path):
    listing = {"cik": "7", "name": "N", "tickers": ["N"], "sic": "1", "filings": {"recent": {"accessionNumber": ["a3", "a2", "a1"], "form": ["10-K", "8-K", "10-K"], "filingDate": ["2024-02-01", "2023-05-05", "2023-02-01"], "reportDate": ["2023-12-31", "", "2022-12-31"], "acceptanceDateTime": ["2024-02-01T16:01:02.000Z", None, None], "primaryDocument": ["k.htm", "e.htm", "j.htm"]}}}
    (tmp_path / "s.json").write_text(json.dumps(listing))
    (tmp_path / "t.json").write_text(json.dumps({"0": {"cik_str": 1045, "ticker": "nn", "title": "N N"}}))
    rows = submissions.recent_filings(submissions.submissions(spark, str(tmp_path / "s.json")), ["10-K"], 1).collect()
    assert [(r.accession, r.filed_at, r.accepted_at) for r in rows] == [("a3", date(2024, 2, 1), datetime(2024, 2, 1, 16, 1, 2))]
    assert submissions.recent_filings(submissions.submissions(spark, str(tmp_path / "s.json"))).count() == 3
    assert [tuple(r) for r in submissions.tickers(spark, str(tmp_path / "t.json")).collect()] == [("NN", "0000001045", "N N")]
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.htm").write_bytes(b"<p>x</p>")
    (tmp_path / "raw" / "b.bin").write_bytes(b"%PDF-1.7")
    raw = submissions.raw_documents(spark, str(tmp_path / "raw"))
    assert sorted(r.is_pdf for r in raw.collect()) == [False, True]
    assert submissions.new_documents(raw, raw.where("is_pdf")).count() == 1


def test_packing():
    random.seed(1)
    for _ in range(300):
        sizes = [random.choice([40, 300, 900, 2400, 3000]) for _ in range(random.randint(0, 30))]
        out = list(chunks.packed(sizes))
        covered = [i for a, b in out for i in range(a, b)]
        assert sorted(set(covered)) == list(range(len(sizes)))
        for (a, b), (c, d) in zip(out, out[1:]):
            # a paragraph that would break the ceiling ends the chunk before it, even one of the overlap alone
            assert a <= c <= b and (d > b or (d == b and c > a and sizes[d] + sizes[d - 1] + 2 > 2400))
            assert b - c <= 1
        for a, b in out:
            assert sum(sizes[a:b]) + 2 * (b - a - 1) <= 2400 or b - a == 1


def test_oversized_paragraphs_are_split_before_packing(spark):
    rows = [(1, 1, 0, 1, "1_1", 1, "A risk sentence stands here. " * 200), (2, 1, 0, 2, "1_2", 1, "word " * 1000), (3, 1, None, 3, "2_1", 2, "Short."), (4, 1, 0, 0, "1_0", 1, ""), (5, 1, 0, 4, "2_2", 2, None), (6, 1, 1, 5, "2_3", 2, "x" * 2403), (7, 1, 1, 6, "2_4", None, "y" * 2404)]
    df = spark.createDataFrame(rows, "block_id bigint, document_id bigint, section_ordinal int, ordinal int, paragraph_id string, page_number int, text string")
    got = chunks.chunks(df).collect()
    assert max(r.tokens for r in got) == 600
    ids = {p for r in got for p in r.paragraph_ids}
    assert {"1_1#1", "1_1#2", "1_2#1", "2_1", "2_3", "2_4#1", "2_4#2"} <= ids and not {"1_1", "1_2", "1_0", "2_2", "2_4"} & ids
    tables = spark.createDataFrame([(1, 0, "Cap", [["h", "v"], ["a", "b"]]), (2, 0, None, [["h"]] + [["x" * 100]] * 60)], "document_id bigint, ordinal int, caption string, cells array<array<string>>")
    filings = spark.createDataFrame([(1, "acc"), (2, "other")], "document_id bigint, accession string")
    every = chunks.document_chunks(df, tables, filings).collect()
    assert sorted(r.ordinal for r in every if r.document_id == 1) == list(range(len(got) + 1)) and len({r.chunk_id for r in every}) == len(every)
    assert [r.text for r in every if r.document_id == 1 and r.kind == "table"] == ["Cap\nh | v\na | b"]
    parts = sorted((r.ordinal, r.text) for r in every if r.document_id == 2)
    assert [n for n, _ in parts] == [0, 1, 2] and all(t.startswith("h\nx") and len(t) <= 2400 for _, t in parts) and sum(t.count("\n") for _, t in parts) == 60


def test_tables_are_split_with_their_header(spark):
    cells = [["h", "v"]] + [[f"r{i}", "x" * 20] for i in range(10)]
    parts = chunks.table_parts(spark.createDataFrame([(1, 0, cells), (1, 1, [["only", "head"]])], "document_id bigint, ordinal int, cells array<array<string>>"), 80).collect()
    first = [r.text for r in parts if r.ordinal == 0]
    assert len(first) > 2 and all(p.startswith("h | v\n") and len(p) <= 80 for p in first) and sum(p.count("\n") for p in first) == 10
    assert [r.text for r in parts if r.ordinal == 1] == ["only | head"]


FILING = "document_id bigint, cik string, accession string, form_type string, filed_at date"
MENTION = "mention_id bigint, document_id bigint, cik string, accession string, form_type string, filed_at date, paragraph_id string, name string, entity_type string, confidence double, quote string, description string, slug string"


def world(spark):
    filed = [(1, "c", "a1", "10-K", date(2022, 1, 1)), (2, "c", "a2", "10-Q", date(2022, 6, 1)), (3, "c", "a3", "10-K", date(2023, 1, 1)), (4, "c", "a4", "10-K/A", date(2023, 2, 1)), (5, "c", "a5", "10-K", date(2024, 1, 1)), (6, "c", "a6", "10-Q", date(2024, 3, 1))]
    cited = {"old": {1: 2}, "back": {1: 1, 5: 1}, "more": {1: 2, 3: 5, 5: 2}, "early": {2: 1, 3: 1}, "same": {1: 1, 3: 1, 5: 1}, "quarter": {2: 3}}
    by_id = {f[0]: f for f in filed}
    rows, n = [], 0
    for slug, places in cited.items():
        for doc, times in places.items():
            for k in range(times):
                n += 1
                f = by_id[doc]
                rows.append((n, doc, f[1], f[2], f[3], f[4], f"{k + 1}_1", slug, "risk", 0.9, f"quote of {slug}", None, slug))
                if k == 0:  # another part of the same paragraph is the same paragraph
                    n += 1
                    rows.append((n, *rows[-1][1:6], "1_1#2", *rows[-1][7:]))
    return spark.createDataFrame(filed, FILING), spark.createDataFrame(rows, MENTION)


def test_timeline(spark):
    filings, mentions = world(spark)
    got = {(r.accession, r.slug, r.kind, r.paragraphs, r.previous_paragraphs, r.named_earlier_in) for r in timeline.changes(filings, mentions).collect()}
    assert got == {
        ("a3", "old", "no_longer_disclosed", 0, 2, ""), ("a3", "back", "no_longer_disclosed", 0, 1, ""), ("a3", "more", "expanded", 5, 2, ""), ("a3", "early", "newly_disclosed", 1, 0, "10-Q"),
        ("a5", "back", "disclosed_again", 1, 0, ""), ("a5", "more", "narrowed", 2, 5, ""), ("a5", "early", "no_longer_disclosed", 0, 1, ""),
    }
    assert {r.accession: r.coverage for r in timeline.coverage(filings).collect()} == {"a1": "baseline", "a2": "baseline", "a3": "compared", "a4": "not compared", "a5": "compared", "a6": "compared"}
    assert timeline.events(filings, mentions).where("kind = 'filed'").count() == 6
    told = {1: {"1_1": "we sell machines to a few large customers", "2_1": "nothing new is said here at all"}, 3: {"1_1": "we sell machines to a few large customers", "2_1": "we sell machines to a few large customers", "3_1": "since spring the new plant makes them in Asia", "4_1": "so much for now and for later", "5_1": "we sell machines"}, 5: {"1_1": "we sell machines to a few large customers", "2_1": "so much for now and for later"}}
    texts = spark.createDataFrame([(10 * d + i, d, p, t) for d, ps in told.items() for i, (p, t) in enumerate(ps.items())], "block_id bigint, document_id bigint, paragraph_id string, text string")
    first = {r.key: (r.cited_in, r.paragraph_id, r.new_paragraph) for r in timeline.evidence(timeline.changes(filings, mentions), mentions.where("paragraph_id not like '%#%'"), texts).collect()}
    assert first == {
        "a3:no_longer_disclosed:old": (1, "1_1", None), "a3:no_longer_disclosed:back": (1, "1_1", None), "a5:no_longer_disclosed:early": (3, "1_1", None),
        "a3:expanded:more": (3, "3_1", True),  # the first paragraph that the filing before does not have
        "a3:newly_disclosed:early": (3, "1_1", True),  # nothing was said of the topic before
        "a5:disclosed_again:back": (5, "1_1", True),
        "a5:narrowed:more": (5, "1_1", False),  # all of it was said before
    }
    unknown = texts.where("paragraph_id <> '3_1'")
    got = {r.key: (r.paragraph_id, r.new_paragraph) for r in timeline.evidence(timeline.changes(filings, mentions), mentions.where("paragraph_id not like '%#%'"), unknown).collect()}
    assert got["a3:expanded:more"] == ("1_1", None)


def test_carried_over_text(spark):
    quotes = spark.createDataFrame([(1, 9, "we depend on a few suppliers in Asia"), (2, 9, "a completely different sentence about nothing at all"), (3, 9, "we depend on a few suppliers in Asia and since this spring also on Mars"), (4, 9, "few words")], "mention_id bigint, before_id bigint, quote string")
    texts = spark.createDataFrame([(9, "As before, we depend on a few suppliers in Asia. Nothing else.")], "before_id bigint, text string")
    share = {r.mention_id: r.share for r in carried.overlaps(quotes, texts, "mention_id", "before_id").collect()}
    assert share[1] == 1.0 and share[2] == 0.0 and share[4] == 0.0
    fresh = {r.mention_id: (r.new, r.longest) for r in carried.new_words(quotes, texts, "mention_id", "before_id").collect()}
    assert fresh == {1: (0, 0), 2: (8, 8), 3: (7, 7)}
    assert [r.mention_id for r in carried.already_said(quotes, texts, "mention_id", "before_id").collect()] == [1]


def test_graph(spark):
    _, mentions = world(spark)
    edges = graph.co_occurrence(mentions)
    row = edges.where("source = 'more' and target = 'same'").first()
    assert row.weight == 3 and row.documents == [1, 3, 5] and row.first_seen == date(2022, 1, 1)
    assert edges.where("source >= target").count() == 0
    known = mentions.select("cik", "slug").distinct()
    links = spark.createDataFrame([("c", "old", "back", "owns", 1, date(2022, 1, 1)), ("c", "old", "old", "owns", 1, date(2022, 1, 1)), ("c", "old", "nobody", "owns", 1, date(2022, 1, 1))], "cik string, source string, target string, relationship string, document_id bigint, filed_at date")
    assert [(r.source, r.target) for r in graph.asserted(links, known).collect()] == [("old", "back")]
    entities = mentions.groupBy("cik", "slug").agg(F.first("name").alias("name"), F.first("entity_type").alias("entity_type"), F.count("*").alias("mention_count"), F.count_distinct("document_id").alias("documents"), F.min("filed_at").alias("first_seen"), F.max("filed_at").alias("latest_seen"))
    scores = {r.slug: r for r in graph.scored(entities, mentions, edges).collect()}
    assert scores["more"].frequency == 1.0 and scores["more"].centrality == 1.0 and 0 <= min(r.importance for r in scores.values()) and max(r.importance for r in scores.values()) <= 100
    top = graph.nodes(graph.scored(entities, mentions, edges), limit=2)
    assert [r.id for r in top.orderBy(F.desc("importance")).collect()] == ["more", "same"]
    kept = graph.kept_edges(edges, top).collect()
    assert [(r.source, r.target, r.strength) for r in kept] == [("more", "same", 1.0)]
    doc = json.loads(graph.contract(top, graph.kept_edges(edges, top)).first().graph)
    assert [n["id"] for n in doc["nodes"]] == ["more", "same"] and doc["edges"][0]["relationship"] == "mentioned_with"


def test_merges_change_nothing_the_second_time(spark):
    writes = spark.createDataFrame([(1, 1, "a", None, 5), (1, 2, "b", "t", 3), (1, 3, "c", None, 9), (2, 1, None, None, None)], "k int, seq int, name string, note string, v int")
    policies = {"name": "last", "note": "last_known", "v": "greatest"}
    once = merge.upserted(writes, ["k"], ["seq"], policies).orderBy("k")
    assert [tuple(r) for r in once.collect()] == [(1, "c", "t", 9), (2, None, None, None)]
    twice = merge.upserted(writes.union(writes), ["k"], ["seq"], policies).orderBy("k")
    assert once.collect() == twice.collect()
    assert merge.inserted_if_absent(writes.union(writes), ["k"], ["seq"]).count() == 2
    assert merge.replaced(writes, writes.where("k = 1 and seq = 1"), "k").count() == 2
    deliveries = spark.createDataFrame([("x", 1, "s"), ("x", 2, "s"), ("x", 3, "t"), ("y", 1, None)], "k string, seq int, sha string")
    assert sorted((r.k, r.seq) for r in merge.changed_deliveries(deliveries, "k", "sha", ["seq"]).collect()) == [("x", 1), ("x", 3)]


def test_next_row_across_periods(spark):
    rows = spark.createDataFrame([(e, date(2020 + i // 4, 1 + 3 * (i % 4), 1), i) for e in "ab" for i in range(0, 16, 3)], "e string, d date, i int")
    got = {(r.e, r.i): r.next_i for r in ordering.with_next(rows, ["e"], ["d", "i"], F.trunc("d", "year"), "i").collect()}
    assert got == {(e, i): (i + 3 if i < 15 else None) for e in "ab" for i in range(0, 16, 3)}


def test_citations_and_checks(spark):
    paragraphs = spark.createDataFrame([(1, 1, "1_1", "The Board met.", 1, 0), (2, 1, "1_2", "Sales rose.", None, 0)], "block_id bigint, document_id bigint, paragraph_id string, text string, page_number int, section_ordinal int")
    cited = spark.createDataFrame([(1, 1, "1_1", "the board"), (2, 1, "1_1", "no"), (3, 1, "9_9", "x"), (4, None, None, None), (1, 1, "1_1", "the board")], "mention_id bigint, document_id bigint, paragraph_id string, quote string")
    rows = evidence.resolved(cited, paragraphs).collect()
    assert len(rows) == 5 and {(r.mention_id, r.error) for r in rows} == {(1, None), (2, "the quote is not in the paragraph"), (3, "no such paragraph"), (4, "no such paragraph")}
    raw = spark.createDataFrame([(1, 1, "1_2", "Sales", "metric", 0.5, "Sales rose."), (2, 1, "1_2", " ", "metric", 0.5, "x"), (3, 1, "1_2", "n", "odd", 0.5, "x"), (4, 1, "1_2", "n", "risk", float("nan"), "x"), (5, 1, "7_7", "n", "risk", 0.1, "x"), (6, 1, "1_2", "n", "risk", 0.1, ""), (7, 1, "1_2", "a b c d e f g h", "risk", 0.1, "Sales")],
                                "extracted_id bigint, document_id bigint, paragraph_id string, name string, entity_type string, confidence double, quote string")
    assert {r.extracted_id: r.reason for r in extraction.checked(raw, paragraphs).collect()} == {1: None, 2: "no name", 3: "unknown kind", 4: "confidence out of range", 5: "no such paragraph", 6: "no quote", 7: "a phrase, not a name"}


def test_nearest_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.1]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, 0.0, 0.0]), (6, [-1.0, 0.0])]
    v = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = retrieval.nearest(v, v.where("vec_id in (0, 2)"), 2, block=1)
    assert {(r.query_id, r.vec_id, r.place) for r in got.collect()} == {(0, 1, 1), (0, 2, 2), (2, 1, 1), (2, 0, 2)}
    hits = got.where("query_id = 0").withColumn("filed_at", F.date_add(F.lit("2020-01-01").cast("date"), F.col("vec_id").cast("int")))
    assert [r.vec_id for r in retrieval.reranked(hits, 0.9, 5).orderBy("rank").collect()] == [2, 1]
    assert retrieval.nearest(v, v.where("false"), 2).count() == 0


def test_routing(spark):
    df = spark.createDataFrame([("10-K", None, "Item 1A. Risk Factors", None), ("8-K", "earnings_call", "x", "CEO"), (None, None, None, None)], "form string, kind string, title string, role string")
    assert [r.cards for r in cards_of.routed(df, "form", "kind", "title", "role").collect()] == [["revenue", "risks"], ["products", "guidance"], []]


def test_a_chunk_that_cannot_be_split_stays_whole(spark):
    rows = [(1, 0, 0, ["1_1", "1_2"], "a\n\nb"), (1, 0, 1, ["1_2", "1_3"], "b\n\nc\n\nd"), (1, None, 0, ["2_1"], "e\n\nf")]
    df = spark.createDataFrame(rows, "document_id bigint, section_ordinal int, chunk int, paragraph_ids array<string>, text string")
    got = {(r.paragraph_id, r.text) for r in chunks.paragraphs_of(df).collect()}
    assert got == {("1_1", "a"), ("1_2", "b"), ("c-0-1", "b\n\nc\n\nd"), ("c--0", "e\n\nf")}


def test_streamed_days_count_rows_far_behind_the_newest(spark, tmp_path):
    schema = "usage_id bigint, created_at timestamp_ntz, provider string, estimated_cost_usd decimal(12,6), status string"
    parts = [[(1, datetime(2025, 10, 1), "x", None, "ok")], [(2, datetime(2025, 1, 1), "x", None, "failed"), (1, datetime(2025, 10, 1), "x", None, "ok")], [(3, datetime(2025, 1, 1), "x", None, "ok")]]
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "ai_usage_logs.parquet"))
    result = ledger.drained(ledger.daily(ledger.once(ledger.attempts(spark, str(tmp_path)))), f"file://{tmp_path}", "late_rows")
    assert {(r.day, r.attempts, r.failed) for r in result.collect()} == {(date(2025, 1, 1), 2, 1), (date(2025, 10, 1), 1, 0)}


def test_published_tables_are_replaced_as_a_whole(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    first = tables.published(spark.range(3), path)
    second = tables.published(spark.range(5, 7), path)
    assert sorted(r.id for r in second.collect()) == [5, 6] and tables.current(spark, path).count() == 2
    assert first.count() == 3  # a reader of the old version keeps it
    with pytest.raises(Exception, match="no more"):
        tables.published(spark.range(2).select(F.raise_error(F.lit("no more")).cast("bigint").alias("id")), path)
    assert tables.current(spark, path).count() == 2


def test_sums_before_and_names_in_texts(spark):
    rows = spark.createDataFrame([(e, i, i % 4) for e in ("a", None) for i in range(12)], "e string, i int, v int")
    got = {(r.e, r.i): r.s for r in ordering.with_sum_before(rows, ["e"], ["i"], F.floor(F.col("i") / 5), F.col("v"), "s").collect()}
    assert got == {(e, i): sum(k % 4 for k in range(i)) for e in ("a", None) for i in range(12)}
    texts = spark.createDataFrame([(1, "c", "The New York plant and new york"), (2, "c", "newyork"), (3, "d", "New York"), (4, "c", None), (5, "c", "Energy of New")], "k int, cik string, text string")
    names = spark.createDataFrame([("c", "ny", "New  York"), ("c", "nyp", "new york plant"), ("c", "e", "Energy"), ("c", "none", "--"), ("c", "nn", None)], "cik string, slug string, name string")
    assert {(r.k, r.slug) for r in evidence.names_in(texts, names, "k").collect()} == {(1, "ny"), (1, "nyp"), (5, "e")}


def sent(spark):
    """Bytes that all tasks have written for shuffles so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    return sc.statusStore().executorList(True).head().totalShuffleWrite()


def test_texts_are_not_sent_with_each_of_their_words(spark):
    random.seed(3)
    words = [f"{random.getrandbits(40):x}" for _ in range(3000)]
    texts = spark.createDataFrame([(i, "c", " ".join(words[i:] + words[:i])) for i in range(4)], "k int, cik string, text string")
    names = spark.createDataFrame([("c", "two", " ".join(words[10:12])), ("c", "five", " ".join(words[100:105])), ("d", "other", words[7]), ("c", "turned", " ".join([words[-1], *words[:2]]))], "cik string, slug string, name string")
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        before = sent(spark)
        got = {(r.k, r.slug) for r in evidence.names_in(texts, names, "k").collect()}
        assert sent(spark) - before < 4 * 3000 * 11  # no more than the texts themselves
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    assert got == {(k, s) for k in range(4) for s in ("two", "five")} | {(2, "turned"), (3, "turned")}


@pytest.mark.parametrize("slots", [1, 2, 1 << 21])
def test_names_that_share_a_slot_are_told_apart(spark, monkeypatch, slots):
    monkeypatch.setattr(evidence, "SLOTS", slots)
    texts = spark.createDataFrame([(1, "c", "Net sales rose; net sales of new plants fell. Net"), (2, "d", "net sales of new plants"), (3, "c", "sales of"), (4, "c", ""), (5, None, "net sales")], "k int, cik string, text string")
    names = spark.createDataFrame([("c", "all", "net sales of new plants"), ("c", "net", "NET"), ("c", "ns", "net-sales"), ("c", "over", "fell net sales"), ("c", "end", "fell. Net"), ("d", "d", "of new plants"), (None, "none", "net")], "cik string, slug string, name string")
    assert {(r.k, r.slug) for r in evidence.names_in(texts, names, "k").collect()} == {(1, "all"), (1, "net"), (1, "ns"), (1, "end"), (2, "d")}


def test_the_replayed_ledger_keeps_no_state_and_the_last_delivery(spark, tmp_path, monkeypatch):
    schema = "usage_id bigint, received_at timestamp_ntz, created_at timestamp_ntz, provider string, estimated_cost_usd decimal(12,6), status string"
    day, one, two = datetime(2025, 3, 1, 23, 59), Decimal("1.5"), Decimal("2.25")
    parts = [
        [(1, datetime(2025, 3, 3), day, "x", one, "failed"), (2, None, day, "x", one, "ok"), (4, day, None, None, None, None)],
        [(1, datetime(2025, 3, 4), day, "x", two, "ok"), (2, datetime(2025, 3, 2), day, "y", two, "failed"), (1, datetime(2025, 3, 1), day, "z", one, "ok")],
        [(3, day, datetime(2025, 3, 2), "x", one, "ok"), (3, day, datetime(2025, 3, 2), "x", one, "ok"), (5, day, None, "x", two, "failed")],
    ]
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "ai_usage_logs.parquet"))
    monkeypatch.setattr(streams, "shared_folder", lambda s: f"file://{tmp_path}/shared")
    result = streams.QUERIES["ext_streamed_days"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW ai_usage_logs AS SELECT * FROM '{tmp_path}/ai_usage_logs.parquet/*.parquet'")
    got = {tuple(r) for r in result.select("day", "provider", "cost", "attempts", "failed").collect()}
    assert got == set(con.execute(streams.SQL["ext_streamed_days"]).fetchall()) and len(got) == 5
    assert list(tmp_path.glob("shared/*/checkpoint/commits/2")) and not list(tmp_path.glob("shared/*/checkpoint/state/*"))


def test_a_replay_of_nothing_is_empty(spark, tmp_path):
    spark.range(0).write.parquet(str(tmp_path / "ai_usage_logs.parquet"))
    for f in (tmp_path / "ai_usage_logs.parquet").glob("part*"):
        f.rename(tmp_path / f.name)
    stream = spark.readStream.schema("id bigint").parquet(str(tmp_path / "ai_usage_logs.parquet"))
    assert ledger.arrived(stream, f"file://{tmp_path}", "none").count() == 0
