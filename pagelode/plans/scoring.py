"""Queries that score predictions against truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scoring as S
from ..session import table


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    truth = table(spark, sf, "orders").where("o_orderstatus <> 'P'").select("o_orderkey", "o_orderpriority", "o_orderdate", F.col("o_totalprice").alias("truth"))
    charge = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    pred = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(charge).alias("pred"))
    both = S.align(truth, pred, ["o_orderkey"])
    return both.withColumns({"status": S.cell_status(F.col("pred"), F.col("truth"), 0.25), "rel_error": S.relative_error(F.col("pred"), F.col("truth"))})


_CELLS = """
WITH p AS (SELECT l_orderkey AS o_orderkey, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS pred FROM lineitem GROUP BY 1),
t AS (SELECT o_orderkey, o_orderpriority, o_orderdate, o_totalprice AS truth FROM orders WHERE o_orderstatus <> 'P'),
c AS (
  SELECT o_orderkey, o_orderpriority, o_orderdate, truth, pred,
    CASE WHEN truth IS NULL AND pred IS NULL THEN 'absent' WHEN truth IS NULL THEN 'extra' WHEN pred IS NULL THEN 'missing'
         WHEN abs(truth) < 0.5 THEN CASE WHEN abs(pred) < 0.5 THEN 'matched' ELSE 'wrong' END
         WHEN abs(pred - truth) / abs(truth) <= 0.25 THEN 'matched' ELSE 'wrong' END AS status,
    CASE WHEN truth <> 0 THEN abs(pred - truth) / abs(truth) END AS rel_error
  FROM t FULL JOIN p USING (o_orderkey)
)
"""


def score_status(spark: SparkSession, sf: str) -> DataFrame:
    return _cells(spark, sf).select("o_orderkey", "status", F.round("rel_error", 6).alias("rel_error"))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def score_by_priority(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(S.cell_metrics(_cells(spark, sf), ["o_orderpriority"]), "recall", "precision", "median_error")


_METRICS = """
count(*) FILTER (WHERE status = 'matched') AS matched, count(*) FILTER (WHERE status = 'wrong') AS wrong,
count(*) FILTER (WHERE status = 'missing') AS missing, count(*) FILTER (WHERE status = 'extra') AS extra,
round(count(*) FILTER (WHERE status = 'matched') / nullif(count(*) FILTER (WHERE status IN ('matched', 'wrong', 'missing')), 0), 6) AS recall,
round(count(*) FILTER (WHERE status = 'matched') / nullif(count(*) FILTER (WHERE status IN ('matched', 'wrong')), 0), 6) AS precision,
round(median(rel_error), 6) AS median_error
"""


def answer_slices(spark: SparkSession, sf: str) -> DataFrame:
    """Answer metrics over several slices at once."""
    cells = _cells(spark, sf).where("truth IS NOT NULL")
    outcome = S.answer_outcome(F.col("o_orderkey") % 11 != 0, F.col("o_orderkey") % 13 == 0, F.col("o_orderkey") % 7 != 0, F.col("pred"), F.col("truth"), 0.25)
    cells = cells.withColumns({"outcome": outcome, "year": F.year("o_orderdate").cast("bigint")})
    out = S.answer_metrics(cells, [["o_orderpriority"], ["year"], []])
    return _rounded(out, "accuracy", "attempt_rate", "precision_when_found")


def _buckets(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    sums = orders.groupBy("c_nationkey", F.year("o_orderdate").alias("year")).agg(F.sum("o_totalprice").alias("truth"))
    shift = lambda d: sums.select("c_nationkey", (F.col("year") - d).alias("year"), F.col("truth").alias(f"n{d}"))
    facts = sums.withColumn("n", F.col("c_nationkey") % 5)
    for d in (-1, 1, -2, 2):
        facts = facts.join(shift(d), ["c_nationkey", "year"], "left")
    kind = lambda n: F.col("n") == n
    pred = F.when(kind(0), F.when(F.col("year") % 2 == 0, F.col("n-1")).otherwise(F.col("n2"))).when(kind(1), -F.col("truth")).when(kind(2), F.col("truth") / F.pow(F.lit(1000.0), F.col("year") % 3 + 1))
    pred = pred.when(kind(3), F.col("truth") * F.when(F.col("year") % 2 == 0, 1.3).otherwise(-1.3)).otherwise(F.col("truth") * 7)
    return facts.withColumn("pred", pred)


def wrong_buckets(spark: SparkSession, sf: str) -> DataFrame:
    facts = _buckets(spark, sf).where("pred IS NOT NULL")
    bucket = S.wrong_bucket(F.col("pred"), F.col("truth"), [(k, F.col(f"n{k}")) for k in (-1, 1, -2, 2)], 0.001)
    return facts.groupBy("c_nationkey", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def resume_pending(spark: SparkSession, sf: str) -> DataFrame:
    done = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return S.pending(table(spark, sf, "orders").select("o_orderkey"), done, ["o_orderkey"])


def greedy_target(spark: SparkSession, sf: str) -> DataFrame:
    groups = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return S.greedy_prefix(groups, "n", [F.col("n").desc(), F.col("o_custkey")], 500)


def prefill_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return S.prefill_savings(table(spark, sf, "lineitem").select("l_orderkey", F.lit(100).cast("bigint").alias("t")), "l_orderkey", "t")


QUERIES = {f.__name__: f for f in (score_status, score_by_priority, answer_slices, wrong_buckets, resume_pending, greedy_target, prefill_tokens)}
ORACLES = {
    "score_status": _CELLS + "SELECT o_orderkey, status, round(rel_error, 6) AS rel_error FROM c",
    "score_by_priority": _CELLS + f"SELECT o_orderpriority, {_METRICS} FROM c GROUP BY 1",
    "answer_slices": _CELLS
    + """, a AS (SELECT o_orderpriority, year(o_orderdate) AS year,
    CASE WHEN o_orderkey % 13 = 0 THEN 'skipped' WHEN o_orderkey % 11 = 0 THEN 'no_response' WHEN o_orderkey % 7 = 0 OR pred IS NULL THEN 'not_found' ELSE status END AS o
    FROM c WHERE truth IS NOT NULL)
SELECT o_orderpriority, year, count(*) FILTER (WHERE o IN ('matched', 'wrong', 'not_found')) AS judged, count(*) FILTER (WHERE o = 'matched') AS matched,
  round(count(*) FILTER (WHERE o = 'matched') / nullif(count(*) FILTER (WHERE o IN ('matched', 'wrong', 'not_found')), 0), 6) AS accuracy,
  round(count(*) FILTER (WHERE o IN ('matched', 'wrong')) / nullif(count(*) FILTER (WHERE o IN ('matched', 'wrong', 'not_found')), 0), 6) AS attempt_rate,
  round(count(*) FILTER (WHERE o = 'matched') / nullif(count(*) FILTER (WHERE o IN ('matched', 'wrong')), 0), 6) AS precision_when_found
FROM a GROUP BY GROUPING SETS ((o_orderpriority), (year), ())""",
    "wrong_buckets": """
WITH s AS (SELECT c_nationkey, year(o_orderdate) AS y, sum(o_totalprice) AS t FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
f AS (SELECT s.*, a.t AS m1, b.t AS p1, c.t AS m2, d.t AS p2 FROM s LEFT JOIN s a ON a.c_nationkey = s.c_nationkey AND a.y = s.y - 1 LEFT JOIN s b ON b.c_nationkey = s.c_nationkey AND b.y = s.y + 1
  LEFT JOIN s c ON c.c_nationkey = s.c_nationkey AND c.y = s.y - 2 LEFT JOIN s d ON d.c_nationkey = s.c_nationkey AND d.y = s.y + 2),
q AS (SELECT *, CASE c_nationkey % 5 WHEN 0 THEN CASE WHEN y % 2 = 0 THEN m1 ELSE p2 END WHEN 1 THEN -t WHEN 2 THEN t / pow(1000.0, y % 3 + 1) WHEN 3 THEN t * CASE WHEN y % 2 = 0 THEN 1.3 ELSE -1.3 END ELSE t * 7 END AS pred FROM f),
e AS (SELECT *, lambda_ok.* FROM (SELECT *, unnest([{'f': 1e3, 'n': '+3', 'i': 1}, {'f': 1e6, 'n': '+6', 'i': 2}, {'f': 1e9, 'n': '+9', 'i': 3}, {'f': 1e-3, 'n': '-3', 'i': 4}, {'f': 1e-6, 'n': '-6', 'i': 5}, {'f': 1e-9, 'n': '-9', 'i': 6}]) AS lambda_ok FROM q WHERE pred IS NOT NULL)),
g AS (SELECT c_nationkey, y, any_value(t) AS t, any_value(pred) AS pred, any_value(m1) AS m1, any_value(p1) AS p1, any_value(m2) AS m2, any_value(p2) AS p2,
  arg_min(n, i) FILTER (WHERE CASE WHEN abs(t * f) < 0.5 THEN abs(pred) < 0.5 ELSE abs(pred - t * f) / abs(t * f) <= 0.001 END) AS scale FROM e GROUP BY 1, 2)
SELECT c_nationkey, CASE WHEN abs(pred - m1) / abs(m1) <= 0.001 THEN 'year_shift(-1)' WHEN abs(pred - p1) / abs(p1) <= 0.001 THEN 'year_shift(+1)' WHEN abs(pred - m2) / abs(m2) <= 0.001 THEN 'year_shift(-2)'
  WHEN abs(pred - p2) / abs(p2) <= 0.001 THEN 'year_shift(+2)' WHEN abs(pred + t) / abs(t) <= 0.001 THEN 'sign_error' WHEN scale IS NOT NULL THEN 'scale_error(x1e' || scale || ')'
  WHEN abs(pred / t) BETWEEN 0.5 AND 2 THEN 'scope_factor' ELSE 'other' END AS bucket, count(*) AS n FROM g GROUP BY 1, 2""",
    "resume_pending": "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')",
    "greedy_target": """
WITH g AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1),
r AS (SELECT *, coalesce(sum(n) OVER (ORDER BY n DESC, o_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM g)
SELECT o_custkey, n, CAST(least(n, 500 - b) AS BIGINT) AS taken FROM r WHERE b < 500""",
    "prefill_tokens": "WITH g AS (SELECT l_orderkey, count(*) AS q FROM lineitem GROUP BY 1) SELECT CAST(sum(100) AS BIGINT) AS cached_tokens, CAST(sum(100 * q) AS BIGINT) AS uncached_tokens FROM g",
}
