"""Lines, paragraphs and boxes from where text was drawn."""

from pyspark.sql import functions as F

from tallyfold.operators import geometry

RUN = "document_id bigint, page int, run int, text string, x0 double, x1 double, baseline double, size double, rotated boolean, begins boolean"


def run(n, text, x0, baseline, size=10.0, rotated=False, begins=True, page=1):
    return (1, page, n, text, float(x0), x0 + 5.0 * len(text), float(baseline), size, rotated, begins)


def read(spark, rows, rotated=False):
    df = spark.createDataFrame(rows, RUN)
    pages = spark.createDataFrame([(1, p, 612.0, 792.0, rotated) for p in (1, 2)], "document_id bigint, page int, width double, height double, rotated boolean")
    return {(r.page, r.paragraph): r for r in geometry.paragraphs(geometry.lines(df), pages).collect()}


def test_runs_become_lines(spark):
    rows = [run(0, "one", 72, 100), run(1, "two", 95, 100, begins=False), run(2, "three", 110.5, 100, begins=False), run(3, "  ", 72, 114), run(4, "side", 72, 128, rotated=True), run(5, "last", 130, 128, begins=False)]
    got = geometry.lines(spark.createDataFrame(rows, RUN)).orderBy("line").collect()
    assert [(r.text, r.x0, r.x1, r.measurable) for r in got] == [("one twothree", 72.0, 135.5, True), ("sidelast", 130.0, 150.0, False)]


def test_what_begins_a_paragraph(spark):
    rows = [run(i, f"line {i}", 72, 100 + 14 * i) for i in range(4)]  # one paragraph
    rows += [run(4, "far below", 72, 100 + 14 * 3 + 20)]  # more than 1.35 leadings
    rows += [run(5, "indented", 81, 100 + 14 * 3 + 34), run(6, "goes on", 72, 100 + 14 * 3 + 48)]
    rows += [run(7, "• item", 72, 100 + 14 * 3 + 62), run(8, "Larger", 72, 100 + 14 * 3 + 76, size=12.0)]
    rows += [run(9, "column", 300, 100)]  # moved up
    rows += [run(10, "Item 1A. Risk Factors", 300, 140), run(11, "prose", 300, 180), run(0, "next page", 72, 100, page=2)]
    got = read(spark, rows)
    assert [got[k].text for k in sorted(got)] == ["line 0 line 1 line 2 line 3", "far below", "indented goes on", "• item", "Larger", "column", "Item 1A. Risk Factors", "prose", "next page"]
    assert [got[k].paragraph_id for k in sorted(got)] == ["1_1", "1_2", "1_3", "1_4", "1_5", "1_6", None, "1_7", "2_1"]
    assert got[1, 7].level == 2
    first = got[1, 1]
    assert (first.x0, first.y0, first.x1, first.y1) == (72.0, 92.5, 102.0, 144.5)


def test_boxes_stay_within_the_page_and_rotated_text_has_none(spark):
    got = read(spark, [run(0, "w" * 200, -5, 3), run(1, "turned", 72, 100, rotated=True)])
    assert (got[1, 1].text[-6:], got[1, 1].x0, got[1, 1].y0) == ("turned", None, None)  # one paragraph with a rotated line
    got = read(spark, [run(0, "w" * 200, -5, 3)])
    assert (got[1, 1].x0, got[1, 1].y0, got[1, 1].x1, got[1, 1].y1) == (0.0, 0.0, 612.0, 5.5)
    assert read(spark, [run(0, "text", 72, 100)], rotated=True)[1, 1].x0 is None
    assert read(spark, [run(0, " ", 72, 100)]) == {}


def test_placements_compose(spark):
    lit = lambda m: [F.lit(float(x)) for x in m]
    row = spark.range(1).select(*[c.alias(n) for c, n in zip(geometry.composed(lit((2, 0, 0, 2, 10, 20)), lit((1, 0, 0, 1, 5, 7))), "abcdef")]).first()
    assert tuple(row) == (2.0, 0.0, 0.0, 2.0, 20.0, 34.0)
