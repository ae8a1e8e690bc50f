"""Quantities in different units."""

from datetime import datetime

import pytest

from tallyfold.operators import units

SCHEMA = "extracted_id bigint, document_id bigint, paragraph_id string, name string, entity_type string, confidence double, quote string, description string, period string, value double, unit string, created_at timestamp_ntz"


def frame(spark, rows):
    """rows: (id, name, quote, description, period, value, unit)"""
    data = [(i, 1, "1_1", name, "metric", 0.9, quote, description, period, value, unit, datetime(2025, 1, 1)) for i, name, quote, description, period, value, unit in rows]
    return spark.createDataFrame(data, SCHEMA)


#: abbreviations, and a source each stands in a known relation to: (unit, phrase, value of the phrase's figure in the unit)
HOUSE = [("ha", "acres", 0.40468564224), ("acre", "square feet", 1 / 43560), ("lbs", "kg", 1 / 0.45359237), ("pct", "basis points", 0.01), ("fraction", "percent", 0.01), ("kusd", "USD million", 1000), ("GJ", "kWh", 0.0036), ("TWh", "GWh", 0.001), ("GWh", "kWh", 1e-6), ("wks", "hours", 1 / 168), ("€ m", "EUR", 1e-6), ("JPY billion", "¥ bn", 1.0), ("USD billion", "USD bn", 1.0), ("k€", "euros", 0.001)]
EARLIER = 1000


def house_style(spark, pairs=HOUSE):
    """Rows of other filings in which both sides of each pair stand: what the graph knows the abbreviations by."""
    rows = []
    for i, (unit, phrase, factor) in enumerate(pairs):
        for k in range(1, 6):
            rows.append((EARLIER + 10 * i + k, "Item", f"The item was {k * 1234567.891:.3f} {phrase}.", None, None, k * 1234567.891 * factor, unit))
    return frame(spark, rows)


def result(df, **rest):
    return {r.extracted_id: (r.common_unit, r.common_value) for r in units.found(df, **rest).collect() if r.extracted_id < EARLIER}


def test_every_way_of_telling_a_unit(spark):
    rows = [
        (1, "Inventory", "Inventory was $0.635 billion.", None, "Q3 2024", 0.635, "billion dollars"),
        (2, "Inventory", "Inventory of USD 145,823.974 thousand was recorded.", None, "FY2018", 145823974.0, "$"),
        (3, "Inventory", "We reported inventory of USD 10,888 thousand.", None, "fiscal 2022", 10888.0, "usd"),
        (4, "Inventory", "Inventory came to 8,666.", None, "Q1 2024 (EUR in millions)", 8666.0, None),
        (5, "Net result (billions)", "Net result: 0.992 (the first quarter of fiscal 2022).", None, "1Q22", -0.992, "US dollars"),
        (6, "Headcount", "Headcount came to 817.", "as presented, items, thousands", "FY21", 817.0, "n/a"),
        (7, "Margin", "Margin came to a ratio of 0.0571.", None, "2025", 0.0571, "see text"),
        (8, "Waste", "At 416,984 lbs, packaging waste was in line.", None, None, 416984.0, "pounds"),
        (9, "Energy", "Energy came to 189,245.61 gigajoules.", None, None, 189245.61, None),
        (10, "Space", "Leased space came to 0.946 acres.", None, None, 0.383, "ha"),
        (11, "Subscribers", "Active subscribers came to 4,248 people.", None, None, 354.0, "dozen"),
        (12, "Revenue", "Revenue came to ¥0.992 bn in fiscal year 2021.", None, None, 992323664.0, "yen"),
        (13, "Area", "The area is 12,910 m2 at the close.", None, None, 12910.0, ""),
        (14, "Inventory", "Inventory moved from USD 0.443 bn to USD 0.372 billion.", None, None, 0.372, "US dollars"),
    ]
    assert result(frame(spark, rows).unionByName(house_style(spark))) == {
        1: ("USD", 635000000), 2: ("USD", 145823974), 3: ("USD", 10888000), 4: ("EUR", 8666000000), 5: ("USD", -992000000), 6: ("count", 817000), 7: ("bp", 571),
        8: ("kg", 189141), 9: ("kwh", 52568225), 10: ("m2", 3830), 11: ("count", 4248), 12: ("JPY", 992323664), 13: ("m2", 12910), 14: ("USD", 372000000),
    }


def test_no_cases(spark):
    rows = [
        (1, "Earnings per share", "Earnings per share of $3.20 per share.", None, None, 3.2, None),
        (2, "Score", "The score was 66.5.", None, None, 66.5, "index points"),
        (3, "Revenue", "Revenue: 12,585 (fiscal year 2024).", None, "FY2024", 12585.0, None),
        (4, "Revenue", "Revenue was USD 5.", None, None, None, "USD"),
        (5, "Revenue", "Revenue was USD 5.", None, None, float("nan"), "USD"),
        (6, None, None, None, None, 5.0, None),
        (7, "EPS", "It was 2.", None, None, 2.0, "EUR per share"),
    ]
    assert result(frame(spark, rows)) == {}


def test_a_spelling_no_dictionary_has_is_sized_by_its_links(spark):
    rows = [(i, "Inventory", f"Inventory was EUR {i + 10}.5 million.", None, None, (i + 10.5) * 1000, "kilofunds") for i in range(8)]
    assert result(frame(spark, rows)) == {i: ("EUR", (2 * i + 21) * 500000) for i in range(8)}


def test_repeated_rows_extra_columns_empty_and_long_texts(spark):
    rows = [(1, "Revenue", "word " * 20000 + "Revenue was USD 5 million.", "", "", 5.0, "USD")] * 2
    df = frame(spark, rows)
    for c in ("u", "w", "h", "kind", "node", "id", "x"):
        df = df.selectExpr("*", f"'odd' as {c}")
    assert result(df) == {1: ("USD", 5000000)}
    assert units.found(df).count() == 1
    assert result(frame(spark, []).where("false")) == {}


def test_halves_round_away_from_zero_and_huge_values_do_not_fail(spark):
    rows = [(1, "M", "It was 1.335 percent.", None, None, 1.335, "percent"), (2, "M", "It was USD 9.", None, None, 1e200, "USD"), (3, "M", "", None, None, -0.5, "USD")]
    assert result(frame(spark, rows)) == {1: ("bp", 134), 3: ("USD", -1)}


def test_sizes_reach_spellings_many_links_away(spark):
    links = []
    for k in range(5):  # eur million - s0 - w0 - s1 - w1 - ...
        links += [(f"s{k}", f"w{k - 1}" if k else "eur million", x, 1000.0 * x if not k else x, None) for x in (3.0, 4.5, 7.0)]
        links += [(f"s{k}", f"w{k}", x, x, None) for x in (3.0, 4.5, 7.0)]
    got = {r.id: (r.kind, r.scale) for r in units.sources(spark.createDataFrame(links, "u string, w string, x double, value double, entity string")).collect()}
    assert got == {"W:eur million": ("EUR", "1000000")} | {f"{side}:{side.lower().replace('r', 's')}{k}": ("EUR", "1000") for k in range(5) for side in "RW"}


def test_the_graph_decides(spark):
    df = frame(spark, [(1, "Power", "Power came to 2.5 TWh.", None, None, 2.5, "TWh"), (2, "Space", "Space came to 3 ha.", None, None, None, "ha"), (3, "Space", "Space came to 3 ha.", None, None, 3.0, "ha")]).unionByName(house_style(spark))
    assert result(df) == {1: ("kwh", 2500000000), 3: ("m2", 30000)}
    alone = {r.extracted_id for r in units.harmonised(df, graph=False).collect()}
    assert not alone & {1, 3}  # no anchor names these spellings


@pytest.mark.parametrize("hidden", range(4))
def test_a_quarter_of_the_anchors_hidden(spark, hidden):
    """Every unit's full name is linked to two others, so the rest of the anchors size what is hidden."""
    kinds = {"bp": [("basis points", 1.0), ("percent", 0.01), ("ratio", 0.0001)], "kwh": [("kilowatt hours", 1.0), ("megawatt hours", 1e-3), ("gigawatt hours", 1e-6), ("gigajoules", 0.0036)], "m2": [("square feet", 1 / 0.09290304), ("square metres", 1.0), ("acres", 1 / 4046.8564224)], "kg": [("short tons", 1 / 907.18474), ("tonnes", 0.001), ("pounds", 1 / 0.45359237), ("kilograms", 1.0)], "hour": [("hours", 1.0), ("days", 1 / 24), ("weeks", 1 / 168)]}
    rows, expected = [], {}
    for names in kinds.values():
        for i, (unit, of_unit) in enumerate(names):
            for phrase, of_phrase in (names[(i + 1) % len(names)], names[(i + 2) % len(names)]):
                rows += [(EARLIER + len(rows) + k, "Item", f"The item was {k * 7654321.5 * of_phrase:.6f} {phrase}.", None, None, k * 7654321.5 * of_unit, unit) for k in range(1, 5)]
    for kind, names in kinds.items():
        for unit, of_unit in names:
            expected[len(expected) + 1] = (kind, 50000)
            rows.append((len(expected), "Item", f"The item was {50000 * of_unit:.8f} {unit}.", None, None, 50000 * of_unit, unit))
    some = tuple(u for i, u in enumerate(units.UNITS) if i % 4 != hidden)
    got = {r.extracted_id: (r.common_unit, r.common_value) for r in units.harmonised(frame(spark, rows), units=some).collect() if r.extracted_id < EARLIER}
    assert got == expected


def test_figures_of_one_entity_link_filings(spark):
    filings = spark.createDataFrame([(d, f"c{d % 5}") for d in range(1, 11)], "document_id bigint, cik string")
    rows = []
    for d in range(1, 11):  # filings 1-5 state the figure in tonnes, 6-10 in quills, which no row writes beside a known unit
        value = (d % 5 + 1) * 1000.0
        unit, phrase, v = ("tonnes", "tonnes", value) if d <= 5 else ("quills", "", value * 1000 / 907.18474)
        rows.append((d, d, "1_1", "Steel", "metric", 0.9, f"Steel came to {v:.4f} {phrase} in the year 2020.".replace("  ", " "), None, "FY2020", v, unit, datetime(2025, 1, 1)))
    df = spark.createDataFrame(rows, SCHEMA)
    assert result(df, filings=filings) == {d: ("kg", (d % 5 + 1) * 1000000) for d in range(1, 11)}
    assert set(result(df)) == {1, 2, 3, 4, 5}  # without companies nothing links the two


def test_scale_and_offset_are_applied(spark):
    warm = [10.0, 14.5, 21.0, 25.5, 30.0, 38.0, 40.5, 55.0]
    rows = [(EARLIER + i, "Hall", f"The hall was at {c} degrees Celsius.", None, None, round(c * 1.8 + 32, 4), "fahr") for i, c in enumerate(warm)] + [(1, "Hall", "It was warm.", None, None, 212.0, "fahr")]
    got = {r.extracted_id: (r.common_unit, r.common_value) for r in units.harmonised(frame(spark, rows)).collect()}
    assert got[1] == ("celsius", 100) and got[EARLIER] == ("celsius", 10)
    assert result(frame(spark, rows)) == {}  # no common unit of p1_found
