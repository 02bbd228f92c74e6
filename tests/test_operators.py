import json

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from pagelode.operators import facts, match, scoring, search, series, stats
from pagelode.operators import text as T


def one(spark, expr, **values):
    kinds = {int: "bigint", float: "double", str: "string", bool: "boolean", type(None): "double"}
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items())).select(expr).first()[0]


def test_statuses(spark):
    s = scoring.cell_status(F.col("p"), F.col("t"), 0.01)
    cases = [(100.9, 100.0, "matched"), (102.0, 100.0, "wrong"), (None, 100.0, "missing"), (5.0, None, "extra"), (None, None, "absent"), (0.45, 0.12, "matched"), (0.0, 0.0, "matched")]
    for p, t, want in cases:
        assert one(spark, s, p=p, t=t) == want


def test_relative_errors(spark):
    for kind, want in (("floored", 0.5), ("absolute_at_zero", 0.5), ("larger", 1.0)):
        assert one(spark, scoring.relative_error(F.col("p"), F.col("t"), kind), p=0.5, t=0.0) == want


def test_fiscal_years(spark):
    for day, january, march in (("2020-01-31", 2019, 2019), ("2020-02-01", 2020, 2019), ("2020-03-31", 2020, 2019), ("2020-12-31", 2020, 2020)):
        assert one(spark, facts.fiscal_year(F.to_date("d")), d=day) == january
        assert one(spark, facts.fiscal_year(F.to_date("d"), 3), d=day) == march


def test_year_windows_tie_goes_to_the_latest(spark):
    years = spark.createDataFrame([("a", 2010), ("a", 2011), ("b", 2015), ("b", 2016), ("b", 2016)], "e string, y int")
    got = {r["size"]: (r.first_year, r.entities) for r in facts.year_windows(years, "e", "y", [1, 2, 3]).collect()}
    assert got == {1: (2016, 1), 2: (2015, 1)}


def test_pages(spark):
    df = spark.createDataFrame([(1, "a<--- Page Split --->  <---Page split--->b"), (2, "")], "i int, t string")
    assert [(r.raw_page, r.dense_page, r.page_text) for r in T.split_pages(df, "t").orderBy("raw_page").collect()] == [(0, 0, "a"), (2, 1, "b")]


def test_number_tokens(spark):
    """Values as written, with their own unit beside them; bare years, percentages, ranges and parts of words don't count."""
    cases = {
        "Revenue $ (1,234.5) million in 2020, 12% and -7k; <td>3,400</td>": [("(1,234.5)", -1234.5, None), ("-7k", -7.0, 1e3), ("3,400", 3400.0, None)],
        "$1.5 million and 5 billion": [("$1.5 million", 1.5, 1e6), ("5 billion", 5.0, 1e9)],
        "(2019) 2100 $2020 1899 2101 2,020": [("1899", 1899.0, None), ("2101", 2101.0, None), ("2,020", 2020.0, None)],
        "10-12 a3 3b/4 7.": [],
        "(5) (6mm) - $8 12 %": [("(5)", -5.0, None), ("(6mm)", -6.0, 1e6), ("- $8", -8.0, None)],
        "1,234,567.89 units": [("1,234,567.89", 1234567.89, None)],
        "": [],
    }
    for line, want in cases.items():
        got = [tuple(x) for x in one(spark, T.number_tokens(F.col("t")), t=line)]
        assert got == want, (line, got)
    assert one(spark, T.number_tokens(F.lit(None).cast("string")), t="") is None


def test_unit_hints(spark):
    cases = {"($ in millions)": [1e6, 1e6], "sales of 3 million cars": [], "dollars in thousands": [1e3, 1e3], "(in billions, except per share data)": [1e9, 1e9], "All dollar amounts are stated in millions": [1e6, 1e6], "": []}
    for t, want in cases.items():
        assert one(spark, T.unit_hints(F.col("t")), t=t) == want, t


def test_page_candidates(spark):
    pages = spark.createDataFrame([("R", 0, "Balance (in thousands)\nTotal assets 5,000 | 4,000\nOther 5,000"), ("R", 1, "Cash 5.0 million"), ("S", 0, "Cash 5,000"), ("R", 2, None)], "report string, page int, text string")
    targets = spark.createDataFrame([("R", "total_assets", 5e6, 0), ("R", "cash", 5e6, 1), ("S", "cash", 5e6, 0)], "report string, kpi string, target double, offset_years int")
    got = {(r.report, r.page, r.kpi): (r.match_type, r.alias, r.raw, r.unit_source) for r in match.page_candidates(pages, targets, {"total_assets": ["total assets"], "cash": ["cash"]}).collect()}
    assert got == {
        ("R", 0, "total_assets"): ("alias+value", "total assets", "5,000", "line"),
        ("R", 1, "total_assets"): ("value-only", None, "5.0 million", "inline"),
        ("R", 1, "cash"): ("alias+value", "cash", "5.0 million", "inline"),
    }


def test_text_functions(spark):
    assert one(spark, T.plain_marks(F.col("t")), t="“a” – \\(b\\)") == '"a" - (b)'
    assert one(spark, T.snippet(F.col("t"), 10), t="aaaa  bbbb cccc") == "aaaa bb..."
    assert one(spark, T.strip_html(F.col("t")), t="<p>a &amp; b</p><script>x</script>") == "a & b"
    assert one(spark, T.tolerant_json(F.col("t"), "a INT"), t='```json\n{"a": 3}\n```').a == 3
    assert one(spark, T.tolerant_json(F.col("t"), "a INT"), t='Sure: {"a": 4} ok').a == 4
    assert one(spark, T.fill_template(F.lit("What did ABC earn in X?"), F.col("n"), F.lit(2020)), n="Xeno") == "What did Xeno earn in 2020?"
    assert one(spark, T.fill_template(F.lit("ABC X"), F.col("n"), F.lit(2020), safe=False), n="Xeno") == "2020eno 2020"
    assert one(spark, T.dollar_marks(F.col("t")), t="cost \\( 5,000") == "cost $ 5,000"
    assert one(spark, T.short_amount(F.col("v")), v=-1234567.0) == "-$1.2M"
    assert one(spark, T.first_alias(F.col("t"), ["net debt", "long-term debt"]), t="Longterm  debt") == "long-term debt"
    assert one(spark, T.first_alias(F.col("t"), ["long-term debt"]), t="the LONG TERM  debt,") == "long-term debt"
    assert one(spark, T.report_name(F.col("t")), t="NYSE_VLQ_2012_1a2b").hash == "1a2b"
    assert one(spark, T.report_name(F.col("t")), t="bad") is None
    assert one(spark, T.table_size(F.col("t")), t="<table><tr><td>1</td><td>2</td></tr><tr><th>x</th></tr></table>") == (2, 2)
    assert T.name_similarity_of("The Acme Group plc", "ACME") == 1.0 and T.name_similarity_of("Acme", "Zenith") < 0.6
    assert one(spark, T.locate_loosely("t", F.lit("b  c")), t="a b\nc d") == (2, 5)


def test_detection_blocks(spark):
    t = "x<|ref|>text<|/ref|><|det|>[[1,2,3,4],[0,5,2,9]]<|/det|>hello\n<|ref|>table<|/ref|><|det|>[[1,1,1,1]]<|/det|>"
    got = T.detection_blocks(spark.createDataFrame([(1, t)], "k int, t string"), "k", "t").withColumn("u", T.union_box(F.col("boxes"))).orderBy("block").collect()
    assert [(r.kind, r.payload, list(r.u)) for r in got] == [("text", "hello", [0, 2, 3, 9]), ("table", "", [1, 1, 1, 1])]


def test_headings(spark):
    pages = spark.createDataFrame([("r", 0, "Contents\nLetter to holders .... 4"), ("r", 3, "## Letter to holders\nDear"), ("r", 5, "Letter to holders"), ("r", 9, "*Letter*")], "r string, p int, t string")
    got = T.heading_sections(pages, "r", "p", "t", ["Letter", "Letter to holders"]).orderBy("p").collect()
    assert [(r.p, r.heading) for r in got] == [(3, "letter to holders"), (9, "letter")]


def test_exclusive_deciles(spark):
    import statistics

    values = [5, 1, 9, 9, 2, 7, 3, 8, 8, 4, 6, 10, 11]
    assert np.allclose(T.exclusive_deciles(values), statistics.quantiles(values, n=10))
    got = T.length_stats(spark.createDataFrame([("a", v) for v in values], "s string, v bigint"), ["s"], "v").first()
    assert np.allclose([got[f"d{i}"] for i in range(1, 10)], statistics.quantiles(values, n=10))


def test_value_bands(spark):
    n = spark.createDataFrame([("k", 1, 100.0), ("k", 2, 102.0), ("k", 3, 0.0), ("k", 4, -100.5), ("k", 5, None)], "k string, i int, v double")
    t = spark.createDataFrame([("k", 100.6), ("k", 0.0)], "k string, t double")
    assert sorted(r.i for r in match.within(n, t, ["k"], "v", "t", 0.01).collect()) == [1, 3]
    rng = np.random.default_rng(0)
    a, b = np.exp(rng.normal(0, 2, 300)), np.exp(rng.normal(0, 2, 300))
    left = spark.createDataFrame([("k", i, float(x)) for i, x in enumerate(a)], "k string, i int, v double")
    right = spark.createDataFrame([("k", float(x)) for x in b], "k string, t double")
    assert match.within(left, right, ["k"], "v", "t", 0.02).count() == int((np.abs(a[:, None] - b[None, :]) <= 0.02 * b[None, :]).sum())


def test_rolling_needs_all_rows(spark):
    s = spark.createDataFrame([("a", i, float(i * i)) for i in range(21)], "k string, t int, v double")
    got = [r.sd for r in series.rolling_sd(s, ["k"], "t", "v", 20, "sd").orderBy("t").collect()]
    assert got[:19] == [None] * 19 and np.isclose(got[20], np.std([i * i for i in range(1, 21)], ddof=1))


def test_sessions(spark):
    """Sessions on the exchange's clock; holidays are the days that the calendar lacks."""
    days = ["2020-01-02", "2020-01-03", "2020-01-06", "2020-01-07", "2020-01-08", "2020-01-09", "2020-01-10", "2020-03-06", "2020-03-09"]
    calendar = spark.createDataFrame([("A", d) for d in days], "k string, day string")
    utc = {
        "2020-01-06 14:29:00": ("pre_market", "2020-01-03", "2020-01-06", "2020-01-10"), "2020-01-06 14:30:00": ("intraday", "2020-01-03", "2020-01-06", "2020-01-10"), "2020-01-06 21:00:00": ("intraday", "2020-01-03", "2020-01-06", "2020-01-10"),
        "2020-01-06 21:01:00": ("after_hours", "2020-01-06", "2020-01-07", "2020-03-06"), "2020-01-04 15:00:00": ("non_trading_day", "2020-01-03", "2020-01-06", "2020-01-10"), "2020-03-09 13:30:00": ("intraday", "2020-03-06", "2020-03-09", None),
        "2020-01-02 15:00:00": (None, None, None, None), "2020-03-09 20:30:00": (None, None, None, None),
    }
    filings = spark.createDataFrame([("A", i, t) for i, t in enumerate(utc)] + [("A", 99, None), ("B", 98, "2020-01-06 15:00:00")], "k string, i int, t string").withColumn("t", F.to_timestamp("t"))
    got = {r.i: tuple(None if x is None else str(x) for x in (r.filing_window_class, r.t0, r.t1, r.t5)) for r in series.filing_windows(filings, calendar, ["k"], "i", "t", "day").collect()}
    assert got == dict(enumerate(utc.values())) | {98: (None,) * 4}


def test_verdicts(spark):
    rows = [("matched", "matched", 0.2, 0.1), ("matched", "matched", 0.1, None), ("ambiguous", "matched", None, None), ("ambiguous", "x", None, 0.1), ("x", "y", None, 0.1), ("x", "y", 0.1, 0.1)]
    v = match.verdict(F.col("f"), F.col("r"), F.col("fe"), F.col("re"), F.col("f"), F.col("r"))
    got = [tuple(r.v) for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, f string, r string, fe double, re double").orderBy("i").select(v.alias("v")).collect()]
    assert got == [
        ("matched", "both-matched", "reverse"), ("matched", "both-matched", "forward"), ("matched", "reverse-only-match", "reverse"), ("ambiguous", "forward-ambiguous", "forward"), ("unmatched", "forward:x|reverse:y", "reverse"), ("unmatched", "forward:x|reverse:y", "forward"),
    ]


def test_kappas(spark):
    same = spark.createDataFrame([("a", "a"), ("b", "b"), ("a", "a")], "x string, y string")
    assert stats.cohen_kappa(same, [], "x", "y", ["a", "b"]).first().kappa == 1.0
    constant = spark.createDataFrame([("a", "a"), ("a", "a")], "x string, y string")
    assert stats.cohen_kappa(constant, [], "x", "y", ["a", "b"]).first().kappa is None
    votes = spark.createDataFrame([(i, "a") for i in (1, 1, 2, 2)], "i int, l string")
    assert stats.fleiss_kappa(votes, ["i"], "l", 2).first().kappa is None


def test_stratified_sample_is_exact(spark):
    df = spark.createDataFrame([(i, "abc"[i % 3 if i < 30 else 0]) for i in range(100)], "i int, s string")
    got = stats.stratified_sample(df, "s", [F.col("i")], 17).groupBy("s").count().collect()
    assert sum(r["count"] for r in got) == 17


def test_bm25_against_brute_force(spark):
    docs = {1: "net debt fell", 2: "net profit and net debt", 3: "weather"}
    d = spark.createDataFrame(list(docs.items()), "d int, t string")
    q = spark.createDataFrame([("q", "Net debt of the net")], "q string, t string")
    got = {r.d: r.score for r in search.bm25(d, q, "d", "t", "q", "t", k1=1.2, b=0.75).collect()}
    words = {k: [w for w in v.split() if w not in search.STOPWORDS] for k, v in docs.items()}
    avg = np.mean([len(w) for w in words.values()])
    for k, w in words.items():
        want = 0.0
        for term, weight in (("net", 2), ("debt", 1)):
            df, tf = sum(term in x for x in words.values()), w.count(term)
            want += weight * np.log(1 + (3 - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * len(w) / avg))
        assert np.isclose(got.get(k, 0.0), want)


def test_max_sim(spark):
    df = spark.createDataFrame([([[1.0, 0.0], [0.0, 1.0]], [[0.5, 0.5], [1.0, 0.0]])], "q array<array<float>>, d array<array<float>>")
    assert df.select(search.max_sim("q", "d")).first()[0] == 1.5


def test_recorded_answers(spark):
    df = spark.createDataFrame([("a", "1"), ("b", "x")], "key string, prompt string")
    ask = lambda p: json.dumps({"n": int(p)})
    got = df.mapInPandas(lambda b: T.recorded_answers(b, ask), "key string, status string, answer string").orderBy("key").collect()
    assert got[0].answer == '{"n": 1}' and got[1].status.startswith("error")


def test_series_in_blocks(spark, monkeypatch):
    """A series cut into blocks gives what an uncut one gives, gaps across blocks, null keys and repeated runs included."""
    rng = np.random.default_rng(4)
    rows = [(k, int(t), None if rng.random() < 0.3 or 20 < t < 60 else float(rng.integers(1, 9))) for k, n in (("hot", 150), ("small", 5), (None, 30)) for t in rng.permutation(n)]
    df = spark.createDataFrame(rows, "k string, t int, v double")
    steps = {
        "pct": lambda: series.pct_change(df, ["k"], "t", "v", "x"), "sd": lambda: series.rolling_sd(df, ["k"], "t", "v", 3, "x"), "shift": lambda: series.shifted_return(df, ["k"], "t", "v", [-2, 1, 3]),
        "central": lambda: series.central_change(df, ["k"], "t", "v", "x"), "forward": lambda: series.forward_mean(df, ["k"], "t", "v", 1, 5, "x"), "band": lambda: series.band(df, ["k"], "t", "v", 4), "ordinal": lambda: series.with_ordinal(df, ["k"], "t"),
    }
    fixed = lambda d: sorted(tuple("None" if x is None else repr(round(x, 9)) if isinstance(x, float) else str(x) for x in r) for r in d.collect())
    whole = {n: fixed(f()) for n, f in steps.items()}
    assert all(len(r) == len(rows) for r in whole.values())
    w = pd.DataFrame(rows, columns=["k", "t", "v"])
    hot = w[w.k == "hot"].sort_values("t").v.ffill()
    got = {r.t: r.x for r in steps["pct"]().where("k = 'hot'").collect()}
    assert all(np.isclose(got[i], x) for i, x in enumerate(hot.pct_change(fill_method=None)) if x == x)
    monkeypatch.setattr(series, "BLOCK", 7)
    for n, f in steps.items():
        assert fixed(f()) == whole[n], n
