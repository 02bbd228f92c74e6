"""Queries that audit candidates, indexes and budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import facts as A
from ..operators import match as M
from ..operators import series as W
from ..session import table


def index_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Pages, reports and null texts of the extract index by mapping status."""
    p = table(spark, sf, "page_items")
    return p.groupBy("mapping_status").agg(F.count(F.lit(1)).alias("items"), F.countDistinct("report_name").alias("reports"), F.count_if(F.col("page_text").isNull()).alias("without_text"), F.countDistinct("industry_slug").alias("industries"))


def mapping_warnings(spark: SparkSession, sf: str) -> DataFrame:
    """Warnings of each extract: text missing, counted otherwise, page numbers apart."""
    w = F.array_compact(
        F.array(
            F.when(F.col("page_text").isNull(), "no_text"),
            F.when(F.char_length("page_text") != F.col("page_text_chars"), "other_length"),
            F.when(F.col("page_number") != F.col("page_index") + 1, "page_number_apart"),
            F.when(F.col("industry_slug").isNull(), "no_industry"),
        )
    )
    return table(spark, sf, "page_items").select(F.explode(w).alias("warning")).groupBy("warning").agg(F.count(F.lit(1)).alias("n"))


def unit_crosstab(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates by unit source and whether stored and inline multipliers agree."""
    c = table(spark, sf, "candidates")
    state = F.when(F.col("chosen_multiplier").isNull(), "unset").when(F.col("inline_multiplier").isNull(), "no_inline").when(F.col("inline_multiplier") == F.col("chosen_multiplier"), "agree").otherwise("differ")
    return c.groupBy("unit_source", state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def unit_disagreements(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose inline multiplier is stated but wasn't chosen, though no conflict is marked."""
    c = table(spark, sf, "candidates").where("inline_multiplier IS NOT NULL AND chosen_multiplier IS NOT NULL AND inline_multiplier <> chosen_multiplier AND NOT unit_conflict AND unit_source IN ('page', 'line', 'inline', 'document')")
    return c.select("candidate_id", "unit_source")


def best_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """The best candidate of each (report, kpi): inline before line before page, without conflict, smallest id."""
    c = table(spark, sf, "candidates").where("report_name IS NOT NULL AND kpi IS NOT NULL AND normalized_value IS NOT NULL")
    place = F.when(F.col("unit_source") == "inline", 0).when(F.col("unit_source") == "line", 1).when(F.col("unit_source") == "page", 2).otherwise(3)
    return M.best_candidate(c, ["report_name", "kpi"], [place, F.coalesce("unit_conflict", F.lit(False)).cast("int")], ["candidate_id"])


def check_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Verdict of two checks per order: its total against its lines, and its lines against its total."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    li = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("s"), F.max("l_extendedprice").alias("m"))
    both = o.join(li, "o_orderkey", "left")
    error = lambda v: F.abs(v - F.col("o_totalprice")) / F.col("o_totalprice")
    status = lambda e: F.when(e.isNull(), "absent").when(e <= 0.3, "matched").when(e <= 0.6, "ambiguous").otherwise("far")
    f, r = error(F.col("s")), error(F.col("m") * 3)
    v = M.verdict(status(f), status(r), f, r, status(f), status(r))
    return both.select(v.alias("v")).groupBy("v.status", "v.reason", "v.winner").agg(F.count(F.lit(1)).alias("n"))


def question_reach(spark: SparkSession, sf: str) -> DataFrame:
    """Items met with reports of their year and the two following ones of any company."""
    q = table(spark, sf, "eval_items").select("item_id", F.regexp_extract("query_id", "([0-9]{4})$", 1).cast("int").alias("year"))
    reached = M.years_reached(q, "year", 2)
    r = table(spark, sf, "report_notes").groupBy(F.col("year").alias("report_year")).agg(F.count(F.lit(1)).alias("reports"))
    return reached.join(r, "report_year").groupBy("item_id").agg(F.sum("reports").alias("reports"))


def token_guard(spark: SparkSession, sf: str) -> DataFrame:
    """Documents over a token budget by the words-and-marks proxy, by language."""
    size = F.regexp_count("text", F.lit(r"[A-Za-z0-9]+|[^A-Za-z0-9\s]"))
    d = table(spark, sf, "documents").where("text IS NOT NULL")
    return d.groupBy(F.when(size > 800, "skipped_too_long").otherwise("kept").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.sum(size).cast("bigint").alias("tokens"))


def rekeyed_facts(spark: SparkSession, sf: str) -> DataFrame:
    """What a change of the fiscal-year rule does to each customer's yearly facts."""
    o = table(spark, sf, "orders")
    keyed = lambda cut: o.groupBy("o_custkey", A.fiscal_year(F.col("o_orderdate"), cut).alias("fy")).agg(F.count(F.lit(1)).alias(f"n{cut}"))
    both = keyed(3).join(keyed(1), ["o_custkey", "fy"], "full")
    outcome = F.when(F.col("n3").isNull(), "added").when(F.col("n1").isNull(), "removed").when(F.col("n1") == F.col("n3"), "same").otherwise("changed")
    return both.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def year_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Reports wanted by a range of years, and those there."""
    want = table(spark, sf, "report_notes").select("exchange").where("exchange IS NOT NULL").distinct().select("exchange", F.explode(F.sequence(F.lit(2012), F.lit(2016))).alias("year"))
    have = table(spark, sf, "report_notes").groupBy("exchange", "year").agg(F.count(F.lit(1)).alias("n"))
    return want.join(have, ["exchange", "year"], "left").select("exchange", F.col("year").cast("bigint"), F.coalesce("n", F.lit(0)).alias("n"))


def before_event_means(spark: SparkSession, sf: str) -> DataFrame:
    """Mean daily volume on the days 10 to 7 before each user's purchases, by user."""
    e = table(spark, sf, "events").select("user_id", F.col("ts").cast("date").alias("day"), "event_type", "value")
    daily = e.groupBy("user_id", "day").agg(F.sum("value").alias("v"))
    anchors = e.where("event_type = 'purchase'").select("user_id", F.col("day").alias("anchor")).distinct()
    spread = anchors.withColumn("day", F.explode(F.transform(F.sequence(F.lit(7), F.lit(10)), lambda d: F.date_sub("anchor", d.cast("int")))))
    return spread.join(daily, ["user_id", "day"]).groupBy("user_id").agg(F.round(F.avg("v"), 8).alias("mean"), F.count(F.lit(1)).alias("n"))


def fiscal_curves(spark: SparkSession, sf: str) -> DataFrame:
    """One curve per year for a single nation, and the mean over the years, by trading day of the year."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer").where("c_nationkey = 7"), F.col("o_custkey") == F.col("c_custkey"))
    daily = o.groupBy(F.year("o_orderdate").alias("year"), F.col("o_orderdate").cast("date").alias("day")).agg(F.avg("o_totalprice").alias("price"))
    rows = W.with_ordinal(daily, ["year"], "day").where("ordinal < 30")
    mean = rows.groupBy("ordinal").agg(F.avg("price").alias("mean"))
    return rows.join(mean, "ordinal").select(F.col("year").cast("bigint"), F.col("ordinal").cast("bigint"), F.round("price", 5).alias("price"), F.round("mean", 5).alias("mean"))


QUERIES = {
    f.__name__: f
    for f in (index_summary, mapping_warnings, unit_crosstab, unit_disagreements, best_candidates, check_verdicts, question_reach, token_guard, rekeyed_facts, year_ranges, before_event_means, fiscal_curves)
}
ORACLES = {
    "index_summary": "SELECT mapping_status, count(*) AS items, count(DISTINCT report_name) AS reports, count(*) FILTER (WHERE page_text IS NULL) AS without_text, count(DISTINCT industry_slug) AS industries FROM page_items GROUP BY 1",
    "mapping_warnings": """SELECT w AS warning, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN page_text IS NULL THEN 'no_text' END, CASE WHEN length(page_text) <> page_text_chars THEN 'other_length' END,
CASE WHEN page_number <> page_index + 1 THEN 'page_number_apart' END, CASE WHEN industry_slug IS NULL THEN 'no_industry' END], lambda x: x IS NOT NULL)) AS w FROM page_items) GROUP BY 1""",
    "unit_crosstab": "SELECT unit_source, CASE WHEN chosen_multiplier IS NULL THEN 'unset' WHEN inline_multiplier IS NULL THEN 'no_inline' WHEN inline_multiplier = chosen_multiplier THEN 'agree' ELSE 'differ' END AS state, count(*) AS n FROM candidates GROUP BY 1, 2",
    "unit_disagreements": "SELECT candidate_id, unit_source FROM candidates WHERE inline_multiplier <> chosen_multiplier AND NOT unit_conflict AND unit_source IN ('page', 'line', 'inline', 'document')",
    "best_candidates": """SELECT report_name, kpi, candidate_id, n AS candidates FROM (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY report_name, kpi) AS n FROM candidates
WHERE report_name IS NOT NULL AND kpi IS NOT NULL AND normalized_value IS NOT NULL
WINDOW w AS (PARTITION BY report_name, kpi ORDER BY CASE unit_source WHEN 'inline' THEN 0 WHEN 'line' THEN 1 WHEN 'page' THEN 2 ELSE 3 END, coalesce(unit_conflict, false), candidate_id)) WHERE i = 1""",
    "check_verdicts": """WITH l AS (SELECT l_orderkey, sum(l_extendedprice) AS s, max(l_extendedprice) AS m FROM lineitem GROUP BY 1),
e AS (SELECT abs(s - o_totalprice) / o_totalprice AS fe, abs(m * 3 - o_totalprice) / o_totalprice AS re FROM orders LEFT JOIN l ON l_orderkey = o_orderkey),
b AS (SELECT *, CASE WHEN fe IS NULL THEN 'absent' WHEN fe <= 0.3 THEN 'matched' WHEN fe <= 0.6 THEN 'ambiguous' ELSE 'far' END AS f, CASE WHEN re IS NULL THEN 'absent' WHEN re <= 0.3 THEN 'matched' WHEN re <= 0.6 THEN 'ambiguous' ELSE 'far' END AS r,
  CASE WHEN re IS NULL OR fe <= re THEN 'forward' ELSE 'reverse' END AS nearer FROM e)
SELECT CASE WHEN 'matched' IN (f, r) THEN 'matched' WHEN 'ambiguous' IN (f, r) THEN 'ambiguous' ELSE 'unmatched' END AS status,
  CASE WHEN f = 'matched' AND r = 'matched' THEN 'both-matched' WHEN f = 'matched' THEN 'forward-only-match' WHEN r = 'matched' THEN 'reverse-only-match' WHEN f = 'ambiguous' AND r = 'ambiguous' THEN 'both-ambiguous'
    WHEN f = 'ambiguous' THEN 'forward-ambiguous' WHEN r = 'ambiguous' THEN 'reverse-ambiguous' ELSE 'forward:' || f || '|reverse:' || r END AS reason,
  CASE WHEN f = 'matched' AND r <> 'matched' THEN 'forward' WHEN r = 'matched' AND f <> 'matched' THEN 'reverse' WHEN f = 'ambiguous' AND r NOT IN ('matched', 'ambiguous') THEN 'forward' WHEN r = 'ambiguous' AND f NOT IN ('matched', 'ambiguous') THEN 'reverse' ELSE nearer END AS winner,
  count(*) AS n FROM b GROUP BY ALL""",
    "question_reach": "WITH q AS (SELECT item_id, CAST(regexp_extract(query_id, '([0-9]{4})$', 1) AS INT) AS y FROM eval_items) SELECT item_id, count(*) AS reports FROM q JOIN report_notes r ON r.year BETWEEN y AND y + 2 GROUP BY 1",
    "token_guard": r"""WITH d AS (SELECT len(regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9\s]')) AS n FROM documents WHERE text IS NOT NULL) SELECT CASE WHEN n > 800 THEN 'skipped_too_long' ELSE 'kept' END AS status, count(*) AS n, CAST(sum(n) AS BIGINT) AS tokens FROM d GROUP BY 1""",
    "rekeyed_facts": """WITH a AS (SELECT o_custkey, year(o_orderdate) - (month(o_orderdate) <= 3)::INT AS fy, count(*) AS n3 FROM orders GROUP BY 1, 2), b AS (SELECT o_custkey, year(o_orderdate) - (month(o_orderdate) <= 1)::INT AS fy, count(*) AS n1 FROM orders GROUP BY 1, 2)
SELECT CASE WHEN n3 IS NULL THEN 'added' WHEN n1 IS NULL THEN 'removed' WHEN n1 = n3 THEN 'same' ELSE 'changed' END AS outcome, count(*) AS n FROM a FULL JOIN b USING (o_custkey, fy) GROUP BY 1""",
    "year_ranges": "SELECT e.exchange, y.y AS year, count(r.report_name) AS n FROM (SELECT DISTINCT exchange FROM report_notes WHERE exchange IS NOT NULL) e CROSS JOIN (SELECT unnest(range(2012, 2017)) AS y) y LEFT JOIN report_notes r ON r.exchange = e.exchange AND r.year = y.y GROUP BY 1, 2",
    "before_event_means": """WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, sum(value) AS v FROM events GROUP BY 1, 2), a AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS anchor FROM events WHERE event_type = 'purchase')
SELECT user_id, round(avg(v), 8) AS mean, count(*) AS n FROM a JOIN d USING (user_id) WHERE day BETWEEN anchor - 10 AND anchor - 7 GROUP BY 1""",
    "fiscal_curves": """WITH d AS (SELECT year(o_orderdate) AS year, CAST(o_orderdate AS DATE) AS day, avg(o_totalprice) AS price FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 7 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY day) - 1 AS ordinal FROM d) SELECT year, ordinal, round(price, 5) AS price, round(avg(price) OVER (PARTITION BY ordinal), 5) AS mean FROM r WHERE ordinal < 30""",
}
