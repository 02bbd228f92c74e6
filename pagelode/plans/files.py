"""Queries that write a table in one of the file formats and read it back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder, table
from ..sources import readers as R
from ..sources import sinks as K


def _place(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


def file_qrels(spark: SparkSession, sf: str) -> DataFrame:
    """Judgements written and read: the first of each pair counts."""
    e = table(spark, sf, "eval_items").select("query_id", F.concat(F.lit("d"), F.col("item_id") % 50).alias("doc_id"), (F.col("item_id") % 3).cast("int").alias("relevance"), "item_id")
    K.write_qrels(e.unionByName(e.withColumns({"relevance": F.lit(9), "item_id": F.col("item_id") + 10**9})), place := _place(spark), "item_id")
    good, _ = R.qrels(spark, place)
    return good.select("query_id", "doc_id", F.col("relevance").cast("bigint"))


def file_run(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of a ranking of suppliers by balance per nation."""
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").cast("string").alias("query_id"), F.col("s_suppkey").cast("string").alias("doc_id"), F.col("s_acctbal").alias("score"), F.col("s_suppkey").alias("rank"))
    K.write_run(s, place := _place(spark), "balance")
    return spark.read.text(place).select(F.col("value").alias("line"))


def file_topics(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "eval_items").where("query_text <> ''").groupBy("query_id").agg(F.min("query_text").alias("t"))
    e.select(F.concat("query_id", F.lit("\t"), F.regexp_replace("t", r"[\t\r\n]+", " "))).write.text(place := _place(spark))
    return R.topics(spark, place)


def file_responses(spark: SparkSession, sf: str) -> DataFrame:
    """Responses of JSON lines: the last line of a question wins, unreadable lines are skipped."""
    e = table(spark, sf, "eval_items").select("item_id", "kpi").withColumn("version", F.explode(F.array(F.lit(1), F.lit(2))))
    line = F.when(F.col("version") == 1, F.concat(F.lit("{broken "), "kpi")).otherwise(F.to_json(F.struct("item_id", "kpi", "version")))
    lines = e.select("version", "item_id", line.alias("value")).unionByName(e.where("version = 1").select("version", "item_id", F.to_json(F.struct("item_id", F.lit("old").alias("kpi"), F.lit(0).alias("version"))).alias("value")))
    lines.coalesce(1).sortWithinPartitions("version", "item_id").select("value").write.text(place := _place(spark))
    return R.json_lines(spark, place, "item_id bigint, kpi string, version int", "item_id").select("item_id", "kpi", F.col("version").cast("bigint"))


def file_truth(spark: SparkSession, sf: str) -> DataFrame:
    """Truth of a CSV: rows that lack a part or a number are left out, the last of repeated keys counts."""
    c = table(spark, sf, "customer").select(F.concat(F.lit("T"), F.col("c_custkey") % 300).alias("ticker"), F.lit(2020).alias("year"), F.col("c_mktsegment").alias("kpi"), F.when(F.col("c_custkey") % 11 == 0, "n/a").otherwise(F.col("c_acctbal").cast("string")).alias("value"), "c_custkey")
    c.coalesce(1).sortWithinPartitions("c_custkey").drop("c_custkey").write.option("header", "true").csv(place := _place(spark))
    return R.truth_csv(spark, place).select("ticker", F.col("year").cast("bigint"), "kpi", "value")


def file_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Facts written long, wide and as coverage; the coverage read back."""
    o = table(spark, sf, "orders").groupBy("o_custkey", F.col("o_orderpriority").alias("kpi")).agg(F.max("o_totalprice").alias("value"))
    K.write_facts(o, place := _place(spark), ["o_custkey"], "kpi", "value", ["1-URGENT", "2-HIGH"])
    wide = spark.read.parquet(f"{place}/wide").agg(F.count("1-URGENT").alias("urgent"), F.count("2-HIGH").alias("high"))
    coverage = spark.read.option("header", "true").csv(f"{place}/coverage").select("kpi", F.col("filled").cast("bigint").alias("filled"), F.col("entities").cast("bigint").alias("entities"))
    return coverage.join(wide.select(F.explode(F.create_map(F.lit("1-URGENT"), F.col("urgent"), F.lit("2-HIGH"), F.col("high"))).alias("kpi", "in_wide")), "kpi", "left")


def file_prices(spark: SparkSession, sf: str) -> DataFrame:
    """Stored prices by ticker and whether they span the years 1996 to 1999."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    o.groupBy(F.concat(F.lit("N"), "c_nationkey").alias("ticker"), F.col("o_orderdate").cast("date").alias("date")).agg(F.avg("o_totalprice").alias("close"), F.count(F.lit(1)).alias("volume")).write.partitionBy("ticker").parquet(place := _place(spark))
    return R.covers(R.daily_prices(spark, place), "ticker", "date", "1996-01-01", "1999-12-31").select("ticker", "first", "last", "hit")


def file_calendar(spark: SparkSession, sf: str) -> DataFrame:
    """Earnings days of a CSV; unreadable figures are null."""
    f = table(spark, sf, "filing_returns").where("ticker IS NOT NULL").select("ticker", F.col("report_date").alias("date"), F.col("r_1d").cast("string").alias("estimate"), F.lit("n/a").alias("actual"), F.col("year").cast("string").alias("surprise"))
    f.write.option("header", "true").option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(place := _place(spark))
    out = R.earnings_calendar(spark, place)
    return out.groupBy(F.year("date").cast("bigint").alias("year")).agg(F.count(F.lit(1)).alias("days"), F.count("actual").alias("actuals"))


def file_shards(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a table written in shards, and whether any shard has more than the 10,000 allowed."""
    K.write_shards(table(spark, sf, "orders"), place := _place(spark), 10_000)
    files = spark.read.parquet(place).groupBy(F.col("_metadata.file_path").alias("f")).agg(F.count(F.lit(1)).alias("n"))
    return files.agg(F.sum("n").alias("rows"), (F.max("n") > 10_000).alias("too_large"))


def file_log(spark: SparkSession, sf: str) -> DataFrame:
    """Events appended to a log in two parts and read to the latest of each user."""
    e = table(spark, sf, "events").where("user_id IS NOT NULL").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id", "event_type")
    place = _place(spark)
    for part in (0, 1):
        K.append_log(e.where(F.pmod("event_id", F.lit(2)) == part), place)
    log = spark.read.schema("user_id bigint, at bigint, event_id bigint, event_type string").json(place)
    return K.current_records(log, ["user_id"], "at", "event_id").select("user_id", "event_id", "event_type", "revisions")


def file_docstore(spark: SparkSession, sf: str) -> DataFrame:
    K.docstore(table(spark, sf, "report_pages").where("text IS NOT NULL").groupBy("docid").agg(F.min("text").alias("text")), place := _place(spark))
    return spark.read.parquet(place).select("docid", F.char_length("snippet").cast("bigint").alias("chars"))


def statement_cells(spark: SparkSession, sf: str) -> DataFrame:
    """A label-by-period frame of order totals as facts by fiscal year."""
    o = table(spark, sf, "orders").withColumn("m", F.month("o_orderdate"))
    frame = o.groupBy("o_custkey", F.col("o_orderpriority").alias("label")).agg(*[F.sum(F.when(F.year("o_orderdate") == y, F.col("o_totalprice"))).alias(f"{y}-01-31") for y in (1996, 1997)])
    out = R.statement_facts(frame, "o_custkey", "label", ["1996-01-31", "1997-01-31"], {"1-URGENT": "sales", "2-HIGH": "sales", "5-LOW": "other"})
    return out.select("o_custkey", "kpi", F.col("fiscal_year").cast("bigint"), F.round("value", 4).alias("value"))


QUERIES = {f.__name__: f for f in (file_qrels, file_run, file_topics, file_responses, file_truth, file_facts, file_prices, file_calendar, file_shards, file_log, file_docstore, statement_cells)}
ORACLES = {
    "file_qrels": "SELECT query_id, 'd' || item_id % 50 AS doc_id, arg_min(item_id % 3, item_id) AS relevance FROM eval_items GROUP BY 1, 2",
    "file_run": "SELECT s_nationkey || ' Q0 ' || s_suppkey || ' ' || s_suppkey || ' ' || printf('%.6f', s_acctbal) || ' balance' AS line FROM supplier",
    "file_topics": r"SELECT query_id, regexp_replace(min(query_text), '[\t\r\n]+', ' ', 'g') AS query_text FROM eval_items WHERE query_text <> '' GROUP BY 1",
    "file_responses": "SELECT item_id, kpi, 2 AS version FROM eval_items",
    "file_truth": "SELECT 'T' || c_custkey % 300 AS ticker, 2020 AS year, c_mktsegment AS kpi, arg_max(c_acctbal, c_custkey) AS value FROM customer WHERE c_custkey % 11 <> 0 GROUP BY 1, 3",
    "file_facts": "SELECT o_orderpriority AS kpi, count(DISTINCT o_custkey) AS filled, count(DISTINCT o_custkey) AS entities, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN count(DISTINCT o_custkey) END AS in_wide FROM orders GROUP BY 1",
    "file_prices": "SELECT 'N' || c_nationkey AS ticker, min(CAST(o_orderdate AS DATE)) AS first, max(CAST(o_orderdate AS DATE)) AS last, min(CAST(o_orderdate AS DATE)) <= DATE '1996-01-06' AND max(CAST(o_orderdate AS DATE)) >= DATE '1999-12-26' AS hit FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1",
    "file_calendar": "SELECT CAST(year(d) AS BIGINT) AS year, count(*) AS days, 0 AS actuals FROM (SELECT DISTINCT ticker, report_date AS d FROM filing_returns WHERE ticker IS NOT NULL AND report_date IS NOT NULL) GROUP BY 1",
    "file_shards": "SELECT count(*) AS rows, false AS too_large FROM orders",
    "file_log": "SELECT user_id, max({'t': ts, 'e': event_id}).e AS event_id, max({'t': ts, 'e': event_id, 'y': event_type}).y AS event_type, count(*) AS revisions FROM events WHERE user_id IS NOT NULL GROUP BY 1",
    "file_docstore": r"SELECT docid, least(length(trim(regexp_replace(min(text), '\s+', ' ', 'g'))), 220) AS chars FROM report_pages WHERE text IS NOT NULL GROUP BY 1",
    "statement_cells": """WITH f AS (SELECT o_custkey, o_orderpriority AS l, year(o_orderdate) - 1 AS fy, sum(o_totalprice) AS v FROM orders WHERE year(o_orderdate) IN (1996, 1997) AND o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW') GROUP BY 1, 2, 3)
SELECT o_custkey, CASE WHEN l = '5-LOW' THEN 'other' ELSE 'sales' END AS kpi, fy AS fiscal_year, round(arg_min(v, l), 4) AS value FROM f GROUP BY 1, 2, 3""",
}
