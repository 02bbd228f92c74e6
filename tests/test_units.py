from pyspark.sql import functions as F

from pagelode.operators import units as U
from pagelode.session import with_small

COLUMNS = "candidate_id bigint, report_name string, kpi string, raw_number string, page_heading string, snippet string, normalized_value double, ticker string"


def number(spark, text):
    return spark.createDataFrame([(text,)], "t string").select(U.read_number(F.col("t"))).first()[0]


def test_numbers(spark):
    cases = {
        "1,234.5": 1234.5, "1.234,5": 1234.5, "1'014'440": 1014440.0, "100 297": 100297.0, "0,24": 0.24, "1,549": 1549.0, "1.006.090": 1006090.0,
        "(14,950)": -14950.0, "−0.18": -0.18, "$ (5.2)": -5.2, "Rs 9,9 lakhs": 9.9, "£100'613k": 100613.0, "12": 12.0, "n/a": None, "": None, "—": None, "see note": None,
    }
    for text, value in cases.items():
        assert number(spark, text) == value, text
    assert number(spark, None) is None


def test_unit_words(spark):
    heads = ["Balance Sheets (in thousands, except per share data)", "£'000", "US$mm", "£m", "$000", "000s omitted", "in crore of rupees", "Rs. lakh", "€ billion", "Segment results", "pence per share", None]
    got = [r[0] for r in spark.createDataFrame([(i, h) for i, h in enumerate(heads)], "i int, h string").orderBy("i").select(U.unit_word(F.col("h"))).collect()]
    assert got == ["thousands", "000", "mm", "m", "000", "000s", "crore", "lakh", "billion", None, "pence", None]


def rows():
    note = [("R", "All amounts are presented in millions unless otherwise stated."), ("R", None), (None, "in thousands")]
    body = [
        (1, "R", "revenue", "5 k", None, None, 5000.0, None),
        (2, "R", "revenue", "5", None, "Total revenues (in thousands) 5 4", 5000.0, "A"),
        (3, "R", "revenue", "5", "Statement (in crores)", "Total revenues 5 4", 5e7, "A"),
        (4, "R", "revenue", "5", None, "Total revenues 5 4", 5e6, "A"),
        (5, "R", "eps_basic", "250", "Statement (in crores)", "EPS (pence) 250 1", 2.5, "A"),
        (6, "R", "shares_outstanding", "7", "Sheet (in thousands, except share and per share data)", "Shares 7 8", 7.0, "A"),
        (7, "R", "shares_outstanding", "7", "Sheet (in thousands, except per share data)", "Shares 7 8", 7000.0, "A"),
        (8, "X", "revenue", "1.234,5", None, None, 1.0, "A"),
        (9, "R", "revenue", "nil", None, None, None, "A"),
        (10, "R", "revenue", "9", "x", "y", None, "A"),
        (10, "R", "revenue", "9", "x", "y", None, "A"),
    ]
    return body, note


def test_common_units_by_known_readings(spark):
    body, note = rows()
    values = U.common_units(spark.createDataFrame(body, COLUMNS), spark.createDataFrame(note, "report_name string, units_note string"))
    got = {r.candidate_id: r.common_value for r in values.collect()}
    assert got == {1: 5000.0, 2: 5000.0, 3: 5e7, 4: 5e6, 5: 2.5, 6: 7.0, 7: 7000.0, 8: 1234.5, 9: None, 10: 9e6}
    assert sorted(r[0] for r in U.misscaled(values).collect()) == [8, 10]


def test_scale_is_estimated_from_linked_rows(spark):
    """A unit word with many linked rows gets the factor that the rows show, bad rows notwithstanding."""
    body = [(i, "R", "revenue", f"{i + 10}", "in lots (lakhs)", None, (i + 10) * (1e5 if i % 5 else 1.0), "A") for i in range(60)]
    values = U.common_units(spark.createDataFrame(body, COLUMNS), spark.createDataFrame([], "report_name string, units_note string"))
    assert all(r.common_value == r.number * 1e5 for r in values.collect())
    assert U.misscaled(values).count() == 12


def test_graph_propagates(spark):
    links = [("a", "stored", 1.0 + i, (1.0 + i) * 1000) for i in range(9)] + [("b", "a", 2.0 + i, (2.0 + i) * 1e3) for i in range(9)] + [("c", "stored", 1.0, 2.0)]
    edges = U.pairwise_scales(spark.createDataFrame(links, "a string, b string, va double, vb double"))
    known = U.propagate(edges, "stored")
    assert {k: v[0] for k, v in known.items()} == {"stored": 1.0, "a": 1000.0, "b": 1e6} and not any(v[1] for v in known.values())


def test_offsets_are_carried_along(spark):
    """stored = a + 30 and a = 1000 b + 20, so stored = 1000 b + 50; an offset under a hundredth is rounding."""
    links = [("a", "stored", 1e3 + i, 1e3 + i + 30.0) for i in range(-4, 5)] + [("b", "a", 1.0 + i / 1e3, 1e3 + i + 20.0) for i in range(-4, 5)] + [("d", "stored", 1e3 + i, 1e3 + i + 1.0) for i in range(9)]
    known = U.propagate(U.pairwise_scales(spark.createDataFrame(links, "a string, b string, va double, vb double"), min_agreement=0), "stored")
    assert known["a"] == (1.0, 30.0) and known["d"] == (1.0, 0.0)
    assert known["b"][0] == 1000.0 and abs(known["b"][1] - 50.0) < 1e-6


def test_notes_beyond_the_broadcast_and_two_notes(spark):
    """Of several notes of a report the first unit word counts, in every run."""
    body, note = rows()
    twice = [*note, *[(n[0], "figures in thousands") for n in note[:1]]]
    one, two = (
        {r.candidate_id: r.common_value for r in U.common_units(spark.createDataFrame(b, COLUMNS), spark.createDataFrame(twice, "report_name string, units_note string")).collect()} for b in (body, body[::-1])
    )
    assert one == two


def test_salted_notes_stay_out_of_the_driver(spark):
    """Beyond the bound the notes aren't broadcast, however small Spark takes the files they come from to be."""
    rows = spark.range(2000).select("id", (F.col("id") % 500).cast("string").alias("report_name"))
    notes = spark.range(300).select(F.col("id").cast("string").alias("report_name"), (F.col("id") * 2).alias("note"))
    out = with_small(rows, notes, "report_name", ["id"], most=100)
    assert sorted((r.id, r.note) for r in out.collect()) == [(i, 2 * (i % 500) if i % 500 < 300 else None) for i in range(2000)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_empty(spark):
    values = U.common_units(spark.createDataFrame([], COLUMNS + ", source string"), spark.createDataFrame([], "report_name string, units_note string"))
    assert values.count() == 0
