import json

import pytest

from pyspark.sql import functions as F

from pagelode.sources import readers as R
from pagelode.sources import sinks as K
from pagelode.streaming import logs


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text if isinstance(text, str) else json.dumps(text))
    return str(path)


def test_report_folders(spark, tmp_path):
    write(tmp_path / "NYSE_AB_2020" / "NYSE_AB_2020.mmd", "one\ntwo")
    write(tmp_path / "NYSE_AB_2020" / "a.mmd", "no")
    write(tmp_path / "LSE_C.D_2019_0a" / "x_det.mmd", "det")
    write(tmp_path / "LSE_C.D_2019_0a" / "x.mmd", "plain")
    got = {r.report: (r.ticker, r.year, r.text) for r in R.report_texts(spark, str(tmp_path)).collect()}
    assert got == {"NYSE_AB_2020": ("AB", 2020, "one\ntwo"), "LSE_C.D_2019_0a": ("C.D", 2019, "plain")}
    years, bad = R.inventory(spark.createDataFrame([("NYSE_A_2020",), ("NYSE_A_2018",), ("x",)], "n string"), "n")
    assert years.first().years == [2018, 2020] and bad.first().n == "x"


def test_truth_and_qrels(spark, tmp_path):
    p = write(tmp_path / "t.csv", "ticker,year,kpi,value\nA,2020,revenue,1\nA,2020,revenue,2\nB,x,revenue,3\nC,2020,revenue,nan\n")
    assert [r.value for r in R.truth_csv(spark, p).collect()] == [2.0]
    assert [r.value for r in R.truth_csv(spark, p, "first").collect()] == [1.0]
    good, bad = R.qrels(spark, write(tmp_path / "q.txt", "q1\t0\td1\t2\nq1 0 d2 0\nbad line\n"))
    assert good.count() == 2 and bad.count() == 1


def test_topics_and_lines(spark, tmp_path):
    got = R.topics(spark, write(tmp_path / "t.txt", "a\tWhat?\nbare text\n")).collect()
    assert [(r.query_id, r.query_text) for r in got] == [("a", "What?"), ("q2", "bare text")]
    p = write(tmp_path / "r.jsonl", '{"id": "a", "v": 1}\nbroken\n{"id": "a", "v": 2}\n')
    assert [r.v for r in R.json_lines(spark, p, "id string, v int", "id").collect()] == [2]


def test_nested_sources(spark, tmp_path):
    facts = {"cik": 1, "entityName": "A", "facts": {"us-gaap": {"Revenues": {"label": "x", "units": {"USD": [{"end": "2020-12-31", "val": 5.0, "form": "10-K", "fp": "FY", "fy": 2020}]}}}}}
    r = R.company_facts(spark, write(tmp_path / "f.json", facts)).first()
    assert (r.tag, r.unit, r.val, r.form) == ("Revenues", "USD", 5.0, "10-K")
    sub = {"cik": "1", "filings": {"recent": {"accessionNumber": ["a", "b"], "form": ["10-K", "10-K/A"], "acceptanceDateTime": ["2021-02-01", "2021-03-01"], "reportDate": ["2020-12-31"]}}}
    rows = R.filings(spark, write(tmp_path / "s.json", sub))
    assert rows.count() == 2 and R.original_filings(rows).first().accessionNumber == "a"
    pay = {"symbol": "A", "annualReports": [{"fiscalDateEnding": "2020-12-31", "totalRevenue": "7", "ebit": "None"}]}
    got = {x.tag: x.value for x in R.statement_payload(spark, write(tmp_path / "p.json", pay), ["totalRevenue", "ebit"]).collect()}
    assert got == {"totalRevenue": 7.0, "ebit": None}
    assert R.dictionary(spark, write(tmp_path / "d.json", {"revenue": ["sales", "turnover"]})).count() == 2
    assert R.nested_labels(spark, write(tmp_path / "n.json", {"i": {"t": {"2020": "pos", "2021": None}}})).count() == 1
    assert R.selected_companies(spark, write(tmp_path / "c.json", {"i": {"LSE": [{"ticker": "A", "name": "B"}]}})).first().exchange == "LSE"


def test_predictions_letters_sessions(spark, tmp_path):
    cell = {"ticker": "A", "year": 2020, "status": "ok", "model": "m", "extraction": {"kpis": [{"kpi": "revenue", "fiscal_year": 2020, "value": 1.0}, {"kpi": "revenue", "fiscal_year": 2020, "value": 2.0}]}}
    write(tmp_path / "raw" / "a.json", cell)
    write(tmp_path / "raw" / "b.json", cell | {"status": "failed"})
    assert [r.value for r in R.predictions(spark, str(tmp_path / "raw")).collect()] == [1.0]
    write(tmp_path / "l" / "NYSE_A_2020__02_b.md", "head\n---\nsecond")
    write(tmp_path / "l" / "NYSE_A_2020__01_a.md", "head\n---\nfirst")
    assert R.letters(spark, str(tmp_path / "l")).first().text == "first\n\nsecond"
    for s, t in (("s1", "2020"), ("s2", "2021")):
        write(tmp_path / "s" / s / "metadata.json", {"slot": "x", "updated_at_utc": t})
        write(tmp_path / "s" / s / "current_annotations.json", {"i": {"status": s}})
    assert [r.session for r in R.sessions(spark, str(tmp_path / "s")).collect()] == ["s2"]


def test_small_readers(spark):
    names = spark.createDataFrame([("NYSE_A_B_2020",), ("x_y",)], "n string")
    assert [(r.exchange, r.ticker) for r in R.tickers_of(names, "n").collect()] == [("NYSE", "A_B")]
    frame = spark.createDataFrame([("Revenue", 1.0, None)], "label string, `2020` double, `2021` double")
    assert R.unpivoted(frame, "label", ["2020", "2021"]).count() == 1
    prices = spark.createDataFrame([("A", "2020-01-02"), ("A", "2020-12-31")], "t string, d string").withColumn("d", F.to_date("d"))
    assert R.covers(prices, "t", "d", "2020-01-01", "2020-12-31").first().hit
    assert spark.createDataFrame([("a.ax",)], "t string").select(R.exchange_of(F.col("t"))).first()[0] == "ASX"


def test_sinks(spark, tmp_path):
    run = spark.createDataFrame([("q", "d2", 2, 0.5), ("q", "d1", 1, 1.25)], "query_id string, doc_id string, rank int, score double")
    K.write_run(run, str(tmp_path / "run"), "x")
    assert [r.value for r in spark.read.text(str(tmp_path / "run")).collect()] == ["q Q0 d1 1 1.250000 x", "q Q0 d2 2 0.500000 x"]
    assert [h.doc_id for h in K.nested_hits(run).first().hits] == ["d1", "d2"]
    K.write_qrels(spark.createDataFrame([("q", "d", 1), ("q", "d", 2)], "query_id string, doc_id string, relevance int"), str(tmp_path / "qrels"))
    assert R.qrels(spark, str(tmp_path / "qrels"))[0].first().relevance == 2
    K.write_audit(run, str(tmp_path / "audit"), ["query_id", "missing"])
    assert spark.read.option("header", "true").csv(str(tmp_path / "audit")).columns == ["query_id", "missing"]
    K.write_shards(spark.range(25), str(tmp_path / "shards"), 10)
    assert spark.read.parquet(str(tmp_path / "shards")).count() == 25
    assert K.markdown(run.orderBy("rank")).count("\n") == 4


def test_log_stream(spark, tmp_path):
    for i, rows in enumerate(([("a", 1, 1, "x")], [("a", 2, 2, "y"), ("b", 1, 3, "z")])):
        write(tmp_path / "log" / f"{i}.json", "\n".join(json.dumps(dict(zip(("k", "t", "n", "v"), r))) for r in rows))
    stream = logs.log_stream(spark, str(tmp_path / "log"), "k string, t int, n int, v string")
    logs.upsert(stream, ["k"], "t", "n", str(tmp_path / "store"), str(tmp_path / "state")).awaitTermination()
    state = lambda: {r.k: (r.v, r.revisions) for r in logs.current_state(spark, str(tmp_path / "store"), ["k"], "t", "n").collect()}
    assert state() == {"a": ("y", 2), "b": ("z", 1)}
    write(tmp_path / "log" / "2.json", json.dumps({"k": "b", "t": 9, "n": 4, "v": "w"}))
    logs.upsert(stream, ["k"], "t", "n", str(tmp_path / "store"), str(tmp_path / "state")).awaitTermination()
    assert state() == {"a": ("y", 2), "b": ("w", 2)} and (tmp_path / "store" / "batch=1").exists()
    logs.compact(spark, str(tmp_path / "store"), ["k"], "t", "n", str(tmp_path / "one"))
    assert logs.current_state(spark, str(tmp_path / "one"), ["k"], "t", "n").count() == 2
    next((tmp_path / "store" / "batch=0").glob("*.parquet")).write_bytes(b"broken")
    with pytest.raises(Exception):
        state()
