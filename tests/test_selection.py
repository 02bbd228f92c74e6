"""Operators without a query of their own, and cases that the tables lack."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pagelode.operators import facts, models, stats
from pagelode.operators import text as T
from pagelode.sources import readers as R
from pagelode.sources import sinks as K


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first().x


def test_letters_under_a_heading(spark):
    mark = "<--- Page Split --->"
    text = mark.join(["Contents\nLetter to Acme shareholders ..... 3\n", "", "# Dear Acme Corp. shareholders\nHello", "more\nDear shareholders", "x", "y", "**Dear shareholders**, again", "end"])
    df = spark.createDataFrame([("R", text), ("S", "no letter"), ("T", None)], "r string, t string")
    got = [tuple(x) for x in T.letter_sections(df, "r", "t", ["Dear shareholders", "Dear <company_name> shareholders", "Letter to Acme shareholders"], 4).orderBy("start_page").collect()]
    assert [(g[1], g[2], g[3]) for g in got] == [("Dear Acme Corp. shareholders", 2, 5), ("Dear shareholders", 6, 7)]
    assert got[0][4].startswith("Dear Acme Corp. shareholders\nHello\n\n<--- Page Split --->\n\nmore") and got[1][4].endswith("end")
    assert T.letter_sections(df.limit(0), "r", "t", ["x"]).count() == 0


def test_dollar_repair(spark):
    at = lambda t, s: one(spark, T.dollar_repair(F.col("t"), s), t=t)
    assert at(r"cost \( 5,000 and \(x^2\) <td>\(</td>", "money") == r"cost $ 5,000 and \(x^2\) <td>$</td>"
    assert at(r"\( 5 to \) 7 but \( {5} \)", "overlap") == r"$ 5 to $ 7 but \( {5} \)"
    assert at(r"<td>\( 12</td><td>\( \leq 3</td>", "td_prefix") == r"<td>$ 12</td><td>\( \leq 3</td>"
    with pytest.raises(ValueError):
        T.dollar_repair(F.lit(""), "other")
    assert tuple(one(spark, T.marker_sets(F.array(F.lit(1), F.lit(2)), F.array(F.lit(9)), F.array(F.lit(2))), t="")) == ([1, 2, 9], [2, 9])


def test_cut_letter_and_prompts(spark):
    text = "Dear all\n\n<--- Page Split --->\n---\nNext"
    assert one(spark, T.cut_letter(F.col("t"), F.lit(len(text) - 4)), t=text) == "Dear all\n"
    assert one(spark, T.cut_letter(F.col("t"), F.lit(None).cast("int")), t=text) is None
    assert one(spark, T.cut_letter(F.col("t"), F.lit(None).cast("int"), F.lit(8)), t=text) == "Dear all\n"
    pages = "a<--- Page Split --->  <--- Page Split --->bb<--- page split --->ccc"
    assert one(spark, T.page_prompt(F.col("t")), t=pages) == "[Page 1]\na\n\n[Page 2]\nbb\n\n[Page 3]\nccc"
    assert one(spark, T.page_prompt(F.col("t"), 23), t=pages) == "[Page 1]\na\n\n[Page 2]\nbb"
    assert one(spark, T.page_prompt(F.col("t"), 1), t=pages) == "[Page 1]\na"


def test_blocks_and_names(spark):
    rows = [("p", i, k, t) for i, (k, t) in enumerate([("text", "a"), ("text", "b"), ("text", " "), ("text", "c"), ("table", "T"), ("title", "d"), ("table", "U")])]
    got = {r.t: (r.before, r.after) for r in T.neighbouring_texts(spark.createDataFrame(rows, "p string, i int, k string, t string"), ["p"], "i", "k", "t").collect()}
    assert got == {"T": (["b", "c"], ["d"]), "U": (["c", "d"], [])}
    assert [one(spark, T.name_verdict(F.col("v").cast("double")), v=v) for v in ("0.6", "0.59", None)] == ["verified", "unverified", "unknown"]
    assert one(spark, T.short_name(F.col("n")), n=" Acme Holdings Inc. ") == "Acme Holdings" and one(spark, T.short_name(F.col("n")), n=None) is None
    assert T.name_similarity_of("Acme Water plc", "The Acme Water Company") == 1.0 and T.name_similarity_of("plc", "x") == 0.0
    q = lambda v, q, t=None: one(spark, T.question_parts_by(F.col("q"), v, F.array(F.lit("A"), F.lit("A_B"))), q=q)
    assert tuple(q("last", "A_B_kpi_2020")) == ("A_B", "kpi", 2020) and tuple(q("report", "A_B_net_debt_2020")) == ("A_B", "net_debt", 2020) and q("report", "C_x_2020") is None


def test_years_and_look_up(spark):
    assert facts.parse_years(" 2012-2014,2018, 2013 ") == [2012, 2013, 2014, 2018] and facts.parse_years("") == []
    known = spark.createDataFrame([("A", "x"), ("B.L", "y"), ("A.L", "z"), ("C", None), ("C.L", "w")], "k string, v string")
    got = {r.k: r.v for r in facts.looked_up(spark.createDataFrame([("A",), ("B",), ("C",), ("D",), (None,)], "k string"), known, "k", ["v"]).collect()}
    assert got == {"A": "x", "B": "y", "C": None, "D": None, None: None}


def test_calendar_statements_and_sinks(spark, tmp_path):
    (tmp_path / "e.csv").write_text("ticker,date,estimate,actual,surprise\nA,2020-01-02,1.0,n/a,\nA,2020-01-02,0.5,2,3\nB,,1,1,1\n")
    assert [tuple(r) for r in R.earnings_calendar(spark, str(tmp_path / "e.csv")).collect()] == [("A", dt.date(2020, 1, 2), 0.5, 2.0, 3.0)]
    frame = spark.createDataFrame([("A", "Sales", 1.0, None), ("A", "Revenue", 3.0, 4.0), ("A", "Else", 5.0, 5.0)], "e string, l string, `2020-12-31` double, `2021-01-15` double")
    got = {tuple(r) for r in R.statement_facts(frame, "e", "l", ["2020-12-31", "2021-01-15"], {"Sales": "rev", "Revenue": "rev"}).collect()}
    assert got == {("A", "rev", 2020, 1.0)}
    all_ = K.all_sessions({"b": spark.range(1), "a": spark.range(2).withColumn("x", F.lit(1))})
    assert sorted((r.session, r.id, r.x) for r in all_.collect() if r.x) == [("a", 0, 1), ("a", 1, 1)] and all_.count() == 3


def test_spread_rank_and_classifiers(spark):
    df = spark.range(5000).withColumn("g", F.when(F.col("id") % 3 == 0, "a").otherwise("b"))
    ranked = stats.spread_rank(df, ["g"], F.xxhash64("id"), "id", "n").orderBy("g", "n").collect()
    for g in "ab":
        assert [r.n for r in ranked if r.g == g] == list(range(sum(r.g == g for r in ranked)))
    data = spark.createDataFrame([(i, [float(i % 2), float(i % 5)], float(i % 2)) for i in range(60)], "id bigint, v array<double>, y double")
    for method in ("l2", "l1", "gaussian", "multinomial"):
        out = models.cross_validated(data, "id", "v", "y", folds=3, method=method).collect()
        assert len(out) == 3 and all(r.accuracy > 0.4 for r in out)
    with pytest.raises(ValueError):
        models.cross_validated(data, "id", "v", "y", method="other")


def test_even_slots_and_templates(spark):
    got = stats.balanced_slots(spark.range(1003), "id", 7, 0.2, 3).toPandas()
    assert got.groupby("id").slot.nunique().value_counts().to_dict() == {1: 803, 3: 200}
    own = got[got.expected_votes == 1].slot.value_counts()
    assert len(own) == 7 and got.slot.value_counts().max() - got.slot.value_counts().min() <= 40
    picks = spark.range(3000).select(T.choose_template(F.col("id").cast("string"), ["a", "b", "c"]).alias("t")).groupBy("t").count().collect()
    assert {r.t for r in picks} == {"a", "b", "c"} and all(850 < r["count"] < 1150 for r in picks)
