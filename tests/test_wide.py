import datetime

from pyspark.sql import functions as F

from pagelode.operators import wide as W

COLUMNS = "ticker string, year int, kpi string, value string, loaded_at int, signature string"


TYPES = {"employees": "bigint", "restated": "boolean", "fiscal_year_end": "date", "reporting_currency": "string"}


def table(spark, rows, **more):
    more.setdefault("types", lambda a: TYPES.get(a, "double"))
    entity = {"ticker": F.upper(F.trim("ticker")), "year": F.col("year").cast("bigint")}
    return W.wide_from_long(spark.createDataFrame(rows, COLUMNS), entity, F.col("kpi"), F.col("value"), recency=[F.col("loaded_at")], **more)


def test_types_spellings_and_contradictions(spark):
    rows = [
        ("ab", 2020, "Total Assets", "1,234.0", 1, "x"),
        ("AB ", 2020, "total-assets", "1.234E3", 2, "x"),
        ("AB", 2020, "revenue", "(5)", 1, "x"),
        ("AB", 2020, "REVENUE", "6", 2, "x"),
        ("AB", 2020, "revenue", "N/A", 3, "x"),
        ("AB", 2020, "employees", "12.0", 1, "x"),
        ("AB", 2020, "restated", "Y", 1, "x"),
        ("AB", 2020, "restated", "true", 1, "x"),
        ("AB", 2020, "fiscal_year_end", "12/31/2020", 1, "x"),
        ("AB", 2020, "fiscal_year_end", "31 Dec 2020", 1, "x"),
        ("AB", 2020, "reporting_currency", "usd ", 1, "x"),
        ("CD", 2021, "revenue", "None", 1, "x"),
        ("CD", 2021, "employees", "x1", 1, "x"),
        (None, 2021, "revenue", "1", 1, "x"),
        ("EF", None, "revenue", "1", 1, "x"),
        ("GH", 2021, None, "1", 1, "x"),
        ("GH", 2021, " -- ", "1", 1, "x"),
    ]
    got = {(r.ticker, r.year): r for r in table(spark, rows).collect()}
    assert set(got) == {("AB", 2020), ("CD", 2021)}
    r = got["AB", 2020]
    assert (r.total_assets, r.revenue, r.employees, r.restated, r.reporting_currency) == (1234.0, 6.0, 12, True, "USD")
    assert r.fiscal_year_end == datetime.date(2020, 12, 31)
    assert r.contradicted == ["revenue"]
    assert got["CD", 2021].revenue is None and got["CD", 2021].signature == ["employees", "revenue"] and got["CD", 2021].contradicted == []


def test_repeats_ties_and_one_hot_entity(spark):
    rows = [("A", 2020, f"k{i % 40}", "1", 1, None) for i in range(4000)] + [("B", 2020, "k0", "2", 1, None), ("B", 2020, "k0", "3", 1, None)]
    got = {r.ticker: r for r in table(spark, rows).collect()}
    assert len(got["A"].signature) == 40 and got["A"].contradicted == []
    assert got["B"].k0 == 3.0 and got["B"].k1 is None and got["B"].contradicted == ["k0"]


def test_clashing_names_and_empty(spark):
    got = table(spark, [("A", 2020, "year", "7", 1, None), ("A", 2020, "signature", "8", 1, None)]).first()
    assert got.year == 2020 and got.year_value == 7.0 and got.signature == ["signature", "year"] and got.signature_value == 8.0
    assert table(spark, []).count() == 0


def test_signatures(spark):
    rows = [("A", 1, "x", "1", 1, None), ("B", 1, "x", "2", 1, None), ("C", 1, "y", "1", 1, None)]
    got = {tuple(r.signature): (r.entities, r.attributes) for r in W.characteristic_sets(table(spark, rows)).collect()}
    assert got == {("x",): (2, 1), ("y",): (1, 1)}


def test_types_from_values(spark):
    values = {"money": ["1,234.5", "(7)", "$3"], "staff": ["12", "1,000", "7.0"], "flag": ["Y", "false"], "day": ["2020-01-02", "12/31/2020"], "code": ["USD", "12x"], "gone": ["N/A", None]}
    rows = [("A", 2020, a, v, 1, None) for a, vs in values.items() for v in vs]
    got = dict(table(spark, rows, types=None).dtypes)
    assert [got[a] for a in ("money", "staff", "flag", "day", "code", "gone")] == ["double", "bigint", "boolean", "date", "string", "string"]


def test_frequent_sets_are_tables_of_their_own(spark):
    """Whether a set has its own table or not changes no row; many spellings are named row by row."""
    rows = [(f"E{i}", 2020, a, str(i), 1, None) for i in range(30) for a in (("x", "y") if i % 2 else ("x", "z") if i % 3 else (f"k{i}", "x"))]
    want = {r.ticker: r.asDict() for r in table(spark, rows, tables=0).collect()}
    for tables in (1, 16):
        assert {r.ticker: r.asDict() for r in table(spark, rows, tables=tables).collect()} == want
    assert want["E1"]["x"] == 1.0 and want["E1"]["z"] is None and len(want) == 30
    df = spark.createDataFrame(rows, COLUMNS)
    assert W.attribute_spellings(df, F.col("kpi"), most=2) is None
    a, b = ({tuple(r) for r in W.cells(df, {"ticker": F.col("ticker")}, F.col("kpi"), F.col("value"), {a: "double" for a in want["E0"] if a[0] in "xyzk"}, [], s).collect()} for s in (None, W.attribute_spellings(df, F.col("kpi"))))
    assert a == b and len(a) == 60
