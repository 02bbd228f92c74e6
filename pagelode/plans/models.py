"""Queries that match values to numbers, and that fit and judge models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import match as M
from ..operators import models as L
from ..session import table


def value_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Line prices within 0.1 % of the price of another order's first line of the same part; ``line_matches`` takes every line as a target."""
    li = table(spark, sf, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    t = li.where("l_linenumber = 1").select("l_partkey", F.col("l_orderkey").alias("target_order"), F.col("l_extendedprice").alias("target"))
    out = M.within(li, t, ["l_partkey"], "l_extendedprice", "target", 0.001).where("l_orderkey <> target_order")
    return out.select("l_partkey", "l_orderkey", F.col("l_linenumber").cast("bigint"), "target_order", F.round("rel_error", 8).alias("rel_error"))


def line_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Line prices within 0.1 % of another line's price of the same part.

    Order and line number don't tell lines apart in these tables, so lines
    that share them are numbered by their other columns; lines that agree in
    all columns may change places.
    """
    li = table(spark, sf, "lineitem")
    own = ["l_partkey", "l_orderkey", "l_linenumber"]
    rest = [c for c in li.columns if c not in own]
    li = li.withColumn("copy", F.row_number().over(Window.partitionBy(*own).orderBy(*rest))).select(*own, "copy", "l_extendedprice")
    t = li.select("l_partkey", F.col("l_orderkey").alias("target_order"), F.col("l_linenumber").cast("bigint").alias("target_line"), F.col("copy").alias("target_copy"), F.col("l_extendedprice").alias("target"))
    same = F.col("l_orderkey").eqNullSafe(F.col("target_order")) & F.col("l_linenumber").eqNullSafe(F.col("target_line")) & (F.col("copy") == F.col("target_copy"))
    out = M.within(li, t, ["l_partkey"], "l_extendedprice", "target", 0.001).where(~same)
    return out.select("l_partkey", "l_orderkey", F.col("l_linenumber").cast("bigint"), "target_order", "target_line", F.round("rel_error", 8).alias("rel_error"))


def scaled_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Quantities against order totals divided by round figures."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_totalprice").alias("target"))
    out = M.reverse_within(li, o, ["l_orderkey"], "l_quantity", "target", [1e3, 1e4], 0.01, ["l_linenumber"])
    return out.select("l_orderkey", F.col("l_linenumber").cast("bigint"), "target", "divisor")


def near_names(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with a number, and the figure named on them or within two lines."""
    p = table(spark, sf, "report_pages").where("text IS NOT NULL").groupBy("docid").agg(F.min("text").alias("text"))
    lines = p.select("docid", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    alias = F.coalesce(*[F.when(F.lower("t").contains(a), a) for a in ("net debt", "gross profit", "free cash flow")])
    lines = lines.select("docid", "line", F.col("t").rlike("[0-9]").alias("has_number"), alias.alias("alias"))
    out = M.nearest_alias(lines, ["docid"], "line", "has_number", "alias", 2).where("near_alias IS NOT NULL")
    return out.select("docid", F.col("line").cast("bigint"), "near_alias", F.col("offset").cast("bigint"))


def page_values(spark: SparkSession, sf: str) -> DataFrame:
    """Pages that show a candidate's value of the same report, with the unit that the page states."""
    pages = table(spark, sf, "report_pages").where("text IS NOT NULL").groupBy("report", "page").agg(F.min("text").alias("text"))
    c = table(spark, sf, "candidates").where("normalized_value IS NOT NULL AND report_name IS NOT NULL AND kpi IS NOT NULL")
    targets = c.groupBy(F.col("report_name").alias("report"), F.lower("kpi").alias("kpi")).agg(F.max("normalized_value").alias("target")).withColumn("offset_years", F.lit(0))
    names = ("revenue", "net_income", "total_assets", "total_equity", "operating_income")
    return M.page_candidates(pages, targets, {n: [n.replace("_", " ")] for n in names})


def residual_codes(spark: SparkSession, sf: str) -> DataFrame:
    return L.residual_codes(table(spark, sf, "embeddings"), "vec_id", "embedding")


def linear_probe(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").withColumn("y", (F.col("label") < 5).cast("double"))
    return L.cross_validated(e, "vec_id", "embedding", "y", folds=5)


def projected(spark: SparkSession, sf: str) -> DataFrame:
    return L.principal(table(spark, sf, "embeddings"), "vec_id", "embedding", 4)


def cluster_quality(spark: SparkSession, sf: str) -> DataFrame:
    return L.silhouette(table(spark, sf, "embeddings"), "embedding", "label")


def tfidf_terms(spark: SparkSession, sf: str) -> DataFrame:
    return L.tf_idf(table(spark, sf, "documents"), "doc_id", "text", 5)


QUERIES = {f.__name__: f for f in (value_matches, line_matches, scaled_matches, near_names, page_values, residual_codes, linear_probe, projected, cluster_quality, tfidf_terms)}
ORACLES = {
    "value_matches": """SELECT a.l_partkey, a.l_orderkey, CAST(a.l_linenumber AS BIGINT) AS l_linenumber, b.l_orderkey AS target_order, round(abs(a.l_extendedprice - b.l_extendedprice) / abs(b.l_extendedprice), 8) AS rel_error
FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey AND b.l_linenumber = 1 AND a.l_orderkey <> b.l_orderkey AND abs(a.l_extendedprice - b.l_extendedprice) / abs(b.l_extendedprice) <= 0.001""",
    "line_matches": """WITH l AS MATERIALIZED (SELECT *, row_number() OVER () AS i FROM lineitem)
SELECT a.l_partkey, a.l_orderkey, CAST(a.l_linenumber AS BIGINT) AS l_linenumber, b.l_orderkey AS target_order, CAST(b.l_linenumber AS BIGINT) AS target_line, round(abs(a.l_extendedprice - b.l_extendedprice) / abs(b.l_extendedprice), 8) AS rel_error
FROM l a JOIN l b ON a.l_partkey = b.l_partkey AND a.i <> b.i AND abs(a.l_extendedprice - b.l_extendedprice) / abs(b.l_extendedprice) <= 0.001""",
    "scaled_matches": """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, o_totalprice AS target, min(d) AS divisor FROM lineitem JOIN orders ON l_orderkey = o_orderkey CROSS JOIN (SELECT unnest([1000.0, 10000.0])::DOUBLE AS d)
WHERE abs(l_quantity - o_totalprice / d) / (o_totalprice / d) <= 0.01 GROUP BY 1, 2, 3""",
    "near_names": r"""WITH p AS (SELECT docid, min(text) AS text FROM report_pages WHERE text IS NOT NULL GROUP BY 1),
l AS (SELECT docid, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM p),
a AS (SELECT docid, line, CASE WHEN contains(lower(t), 'net debt') THEN 'net debt' WHEN contains(lower(t), 'gross profit') THEN 'gross profit' WHEN contains(lower(t), 'free cash flow') THEN 'free cash flow' END AS alias FROM l),
j AS (SELECT l.docid, l.line, a.alias, a.line - l.line AS d FROM l JOIN a ON l.docid = a.docid AND abs(a.line - l.line) <= 2 AND a.alias IS NOT NULL WHERE regexp_matches(l.t, '[0-9]'))
SELECT docid, line, alias AS near_alias, d AS offset FROM (SELECT *, row_number() OVER (PARTITION BY docid, line ORDER BY abs(d), d) AS n FROM j) WHERE n = 1""",
}
