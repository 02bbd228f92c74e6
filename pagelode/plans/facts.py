"""Queries that build and cover fact tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import facts as A
from ..session import table

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _tagged(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.groupBy("o_custkey", F.year("o_orderdate").cast("bigint").alias("year"), F.col("o_orderpriority").alias("tag")).agg(F.min("o_totalprice").alias("value"))


_TAGGED = "WITH f AS (SELECT o_custkey, year(o_orderdate) AS year, o_orderpriority AS tag, min(o_totalprice) AS value FROM orders GROUP BY 1, 2, 3) "
_KEYS = ["o_custkey", "year"]
_ORDER = ["3-MEDIUM", "1-URGENT", "5-LOW"]
_CHOSEN = ", c AS (SELECT o_custkey, year, value, tag FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, year ORDER BY CASE tag WHEN '3-MEDIUM' THEN 1 WHEN '1-URGENT' THEN 2 ELSE 3 END) AS n FROM f WHERE tag IN ('3-MEDIUM', '1-URGENT', '5-LOW')) WHERE n = 1) "


def tag_waterfall(spark: SparkSession, sf: str) -> DataFrame:
    return A.waterfall(_tagged(spark, sf), _KEYS, "tag", "value", _ORDER)


def signed_sum_fallback(spark: SparkSession, sf: str) -> DataFrame:
    facts = _tagged(spark, sf)
    out = A.signed_sum(facts, _KEYS, "tag", "value", [(1, "2-HIGH"), (-1, "4-NOT SPECIFIED")], tag_waterfall(spark, sf))
    return out.withColumn("value", F.round("value", 4))


def ambiguous_tags(spark: SparkSession, sf: str) -> DataFrame:
    facts = _tagged(spark, sf)
    return A.ambiguous(facts, A.waterfall(facts, _KEYS, "tag", "value", _ORDER), _KEYS, "tag", "value").select(*_KEYS, "tag", "value", "chosen_tag", "chosen_value")


def gap_fill(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").withColumn("year", F.year("o_orderdate").cast("bigint"))
    part = lambda s: o.where(F.col("o_orderstatus") == s).groupBy(*_KEYS).agg(F.max("o_totalprice").alias("value"))
    return A.gap_fill(part("F"), part("O"), _KEYS, "value", ("filed", "filled"))


def kpi_pivot(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").withColumn("year", F.year("o_orderdate").cast("bigint"))
    out = A.pivot_first(o, _KEYS, "o_orderpriority", "o_totalprice", PRIORITIES, [F.col("o_orderkey")])
    return out.toDF(*_KEYS, "urgent", "high", "medium", "unspecified", "low")


def coverage_cells(spark: SparkSession, sf: str) -> DataFrame:
    facts = _tagged(spark, sf)
    cells = A.coverage(facts.select(*_KEYS).distinct(), PRIORITIES, facts, _KEYS, "tag")
    return cells.groupBy("year", "tag").agg(F.count(F.lit(1)).alias("cells"), F.count_if("filled").alias("filled"), F.round(F.avg(F.col("filled").cast("double")), 6).alias("fill_rate"))


def best_year_windows(spark: SparkSession, sf: str) -> DataFrame:
    years = table(spark, sf, "orders").select("o_custkey", F.year("o_orderdate").alias("year"))
    return A.year_windows(years, "o_custkey", "year", [1, 2, 3, 4, 5, 6])


def year_coverage(spark: SparkSession, sf: str) -> DataFrame:
    years = table(spark, sf, "orders").select("o_custkey", F.year("o_orderdate").cast("bigint").alias("year"))
    return years.groupBy("year").agg(F.countDistinct("o_custkey").alias("entities"), F.count(F.lit(1)).alias("documents"))


def fiscal_years(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.groupBy(A.fiscal_year(F.col("o_orderdate"), 1).cast("bigint").alias("fy"), A.fiscal_year(F.col("o_orderdate"), 3).cast("bigint").alias("fy_march")).agg(F.count(F.lit(1)).alias("n"))


def source_union(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nationkey"), F.col("s_name").alias("name"), F.lit("supplier").alias("source"))
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("nationkey"), F.col("c_name").alias("name"), F.lit("customer").alias("source"))
    return A.priority_union([s, c], ["nationkey"]).groupBy("nationkey", "source").agg(F.count(F.lit(1)).alias("n"))


def full_year_facts(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return li.groupBy("l_returnflag").agg(F.count_if(A.full_year_span(F.col("o_orderdate"), F.col("l_shipdate"), 30, 60)).alias("spans"), F.count(F.lit(1)).alias("n"))


def uncovered_years(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").withColumn("y", F.year("o_orderdate"))
    years = lambda d: d.groupBy("o_custkey").agg(F.collect_set("y").alias("years"))
    return A.uncovered(years(o), years(o.where("o_orderstatus = 'F'")), "o_custkey", "years").select("o_custkey", F.concat_ws(",", F.col("years").cast("array<string>")).alias("years"))


def industry_groups(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "lse_companies").where("sector IS NOT NULL")
    bad = F.exists(F.array("company_name", "sector", "industry"), lambda x: F.coalesce(F.trim(x), F.lit("")).isin("", "N/A", "Error"))
    return c.where(~bad).groupBy("sector", "industry").agg(F.countDistinct("ticker").alias("companies"), F.min("company_name").alias("first_name"))


def selection_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """Keep or reason to drop, per report: selected company, whole window covered, year in window."""
    reports = table(spark, sf, "report_notes").select("report_name", "ticker", "year", "exchange")
    cover = reports.where("year BETWEEN 2014 AND 2016").groupBy("ticker").agg(F.countDistinct("year").alias("k")).where("k = 3")
    out = reports.join(cover, "ticker", "left")
    reason = F.when(~F.col("exchange").isin("LSE", "NYSE", "NASDAQ"), "not_selected").when(F.col("k").isNull(), "window_not_covered").when(~F.col("year").between(2014, 2016), "year_outside").otherwise("keep")
    return out.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (tag_waterfall, signed_sum_fallback, ambiguous_tags, gap_fill, kpi_pivot, coverage_cells, best_year_windows, year_coverage, fiscal_years, source_union, full_year_facts, uncovered_years, industry_groups, selection_reasons)
}
_FIRST = ", ".join(f"min_by(o_totalprice, o_orderkey) FILTER (WHERE o_orderpriority = '{p}') AS {n}" for p, n in zip(PRIORITIES, ["urgent", "high", "medium", "unspecified", "low"]))
ORACLES = {
    "tag_waterfall": _TAGGED + _CHOSEN + "SELECT o_custkey, year, value, tag FROM c",
    "signed_sum_fallback": _TAGGED + _CHOSEN + """SELECT h.o_custkey, h.year, round(h.value - n.value, 4) AS value FROM f h JOIN f n ON h.o_custkey = n.o_custkey AND h.year = n.year AND h.tag = '2-HIGH' AND n.tag = '4-NOT SPECIFIED'
WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.o_custkey = h.o_custkey AND c.year = h.year)""",
    "ambiguous_tags": _TAGGED + _CHOSEN + """SELECT f.o_custkey, f.year, f.tag, f.value, c.tag AS chosen_tag, c.value AS chosen_value FROM f JOIN c USING (o_custkey, year)
WHERE f.tag <> c.tag AND abs(f.value - c.value) / greatest(abs(f.value), abs(c.value)) > 0.001""",
    "gap_fill": """WITH b AS (SELECT o_custkey, year(o_orderdate) AS year, max(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS b, max(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS f FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1, 2)
SELECT o_custkey, year, coalesce(b, f) AS value, CASE WHEN b IS NOT NULL THEN 'filed' ELSE 'filled' END AS source FROM b""",
    "kpi_pivot": f"SELECT o_custkey, year(o_orderdate) AS year, {_FIRST} FROM orders GROUP BY 1, 2",
    "coverage_cells": _TAGGED + """, e AS (SELECT DISTINCT o_custkey, year FROM f), t AS (SELECT DISTINCT tag FROM f),
g AS (SELECT e.year, t.tag, f.value IS NOT NULL AS filled FROM e CROSS JOIN t LEFT JOIN f ON f.o_custkey = e.o_custkey AND f.year = e.year AND f.tag = t.tag)
SELECT year, tag, count(*) AS cells, count(*) FILTER (WHERE filled) AS filled, round(avg(CAST(filled AS DOUBLE)), 6) AS fill_rate FROM g GROUP BY 1, 2""",
    "best_year_windows": """WITH y AS (SELECT DISTINCT o_custkey, year(o_orderdate) AS y FROM orders), s AS (SELECT unnest([1, 2, 3, 4, 5, 6])::INTEGER AS size),
w AS (SELECT s.size, a.y AS first_year, a.o_custkey FROM s JOIN y a ON true JOIN y b ON a.o_custkey = b.o_custkey AND b.y BETWEEN a.y AND a.y + s.size - 1 GROUP BY 1, 2, 3 HAVING count(*) = s.size),
c AS (SELECT size, first_year, count(*) AS entities FROM w GROUP BY 1, 2)
SELECT size, first_year, CAST(first_year + size - 1 AS BIGINT) AS last_year, entities FROM (SELECT *, row_number() OVER (PARTITION BY size ORDER BY entities DESC, first_year DESC) AS n FROM c) WHERE n = 1""",
    "year_coverage": "SELECT year(o_orderdate) AS year, count(DISTINCT o_custkey) AS entities, count(*) AS documents FROM orders GROUP BY 1",
    "fiscal_years": "SELECT year(o_orderdate) - (month(o_orderdate) <= 1)::INT AS fy, year(o_orderdate) - (month(o_orderdate) <= 3)::INT AS fy_march, count(*) AS n FROM orders GROUP BY 1, 2",
    "source_union": """WITH u AS (SELECT s_nationkey AS nationkey, 'supplier' AS source FROM supplier UNION ALL SELECT c_nationkey, 'customer' FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier))
SELECT nationkey, source, count(*) AS n FROM u GROUP BY 1, 2""",
    "full_year_facts": "SELECT l_returnflag, count(*) FILTER (WHERE datediff('day', o_orderdate, l_shipdate) BETWEEN 30 AND 60) AS spans, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1",
    "uncovered_years": """WITH y AS (SELECT DISTINCT o_custkey, year(o_orderdate) AS y FROM orders), d AS (SELECT DISTINCT o_custkey, year(o_orderdate) AS y FROM orders WHERE o_orderstatus = 'F')
SELECT o_custkey, string_agg(y, ',' ORDER BY y) AS years FROM (SELECT * FROM y EXCEPT SELECT * FROM d) GROUP BY 1""",
    "industry_groups": """SELECT sector, industry, count(DISTINCT ticker) AS companies, min(company_name) AS first_name FROM lse_companies
WHERE sector IS NOT NULL AND coalesce(trim(company_name), '') NOT IN ('', 'N/A', 'Error') AND coalesce(trim(sector), '') NOT IN ('', 'N/A', 'Error') AND coalesce(trim(industry), '') NOT IN ('', 'N/A', 'Error') GROUP BY 1, 2""",
    "selection_reasons": """WITH k AS (SELECT ticker FROM report_notes WHERE year BETWEEN 2014 AND 2016 GROUP BY 1 HAVING count(DISTINCT year) = 3)
SELECT CASE WHEN exchange NOT IN ('LSE', 'NYSE', 'NASDAQ') THEN 'not_selected' WHEN k.ticker IS NULL THEN 'window_not_covered' WHEN NOT year BETWEEN 2014 AND 2016 THEN 'year_outside' ELSE 'keep' END AS reason, count(*) AS n
FROM report_notes r LEFT JOIN k ON r.ticker = k.ticker GROUP BY 1""",
}
