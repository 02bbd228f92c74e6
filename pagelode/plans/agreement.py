"""Queries of annotator agreement, outliers, fits and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import stats as S
from ..session import table

STATUSES = ["ok", "uncertain", "not_ok"]


def _votes(spark: SparkSession, sf: str) -> DataFrame:
    """Latest vote per annotator and item, with a status that counts."""
    a = table(spark, sf, "annotations").where("annotator IS NOT NULL AND item_id IS NOT NULL AND updated_at_utc IS NOT NULL")
    status = F.regexp_replace(F.lower(F.trim("overall_status")), "[ _-]+", "_")
    last = a.groupBy("annotator", "item_id").agg(F.max(F.struct("updated_at_utc", status.alias("s")))["s"].alias("status"))
    return last.where(F.col("status").isin(*STATUSES))


_VOTES = """WITH l AS (SELECT annotator, item_id, max({'t': updated_at_utc, 's': regexp_replace(lower(trim(overall_status)), '[ _-]+', '_', 'g')}) AS x FROM annotations
WHERE annotator IS NOT NULL AND item_id IS NOT NULL AND updated_at_utc IS NOT NULL GROUP BY 1, 2), v AS (SELECT annotator, item_id, x.s AS status FROM l WHERE x.s IN ('ok', 'uncertain', 'not_ok')),
c AS (SELECT item_id, status, count(*) AS c FROM v GROUP BY 1, 2)
"""


def majority_votes(spark: SparkSession, sf: str) -> DataFrame:
    return S.majority(_votes(spark, sf), ["item_id"], "status")


def pairwise_votes(spark: SparkSession, sf: str) -> DataFrame:
    return S.pairwise_agreement(_votes(spark, sf), ["item_id"], "status").withColumn("agreement", F.round("agreement", 6))


def fleiss_votes(spark: SparkSession, sf: str) -> DataFrame:
    return S.fleiss_kappa(_votes(spark, sf), ["item_id"], "status", 5).withColumn("kappa", F.round("kappa", 6))


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    """First and last annotator of each item by name."""
    v = _votes(spark, sf)
    return v.groupBy("item_id").agg(F.min(F.struct("annotator", "status"))["status"].alias("a"), F.max(F.struct("annotator", "status"))["status"].alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")


def vote_confusion(spark: SparkSession, sf: str) -> DataFrame:
    return S.confusion(_pairs(spark, sf), "a", "b")


def cohen_votes(spark: SparkSession, sf: str) -> DataFrame:
    p = _pairs(spark, sf)
    parts = [S.cohen_kappa(p, [], "a", "b", STATUSES, w).select(F.lit(w).alias("weights"), "n", F.round("kappa", 6).alias("kappa")) for w in ("none", "linear", "quadratic")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def vote_ratios(spark: SparkSession, sf: str) -> DataFrame:
    is_ = lambda *s: F.count_if(F.col("status").isin(*s))
    return _votes(spark, sf).groupBy("annotator").agg(F.count(F.lit(1)).alias("reviewed"), is_("ok", "not_ok").alias("decided"), F.round(F.try_divide(is_("ok"), is_("ok", "not_ok")), 6).alias("ok_share"))


def price_outliers(spark: SparkSession, sf: str) -> DataFrame:
    return S.iqr_outliers(table(spark, sf, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_extendedprice"), ["l_returnflag"], "l_extendedprice", 0.5).select("l_orderkey", F.col("l_linenumber").cast("bigint"))


def clipped_returns(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "filing_returns").where("r_1d IS NOT NULL")
    out = S.clipped(f, ["form"], "r_1d", 0.02, 0.98)
    return out.groupBy("form").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("r_1d"), 6).alias("mean"), F.round(F.min("r_1d"), 6).alias("least"), F.round(F.max("r_1d"), 6).alias("most"))


def return_fits(spark: SparkSession, sf: str) -> DataFrame:
    f = S.ols(table(spark, sf, "filing_returns"), ["form"], "spy_r_1d", "r_1d", 20)
    return f.select("form", "n", *[F.round(c, 6).alias(c) for c in ("slope", "intercept", "r2", "r", "residual_sd")])


def rank_correlation(spark: SparkSession, sf: str) -> DataFrame:
    return S.spearman(table(spark, sf, "lineitem"), ["l_returnflag"], "l_quantity", "l_discount").withColumn("spearman", F.round("spearman", 6))


def tail_labels(spark: SparkSession, sf: str) -> DataFrame:
    f = S.quantile_labels(table(spark, sf, "filing_returns").where("r_5d IS NOT NULL"), ["form"], "r_5d", 0.1)
    return f.groupBy("form").agg(F.count_if("top").alias("top"), F.count_if("bottom").alias("bottom"), F.count(F.lit(1)).alias("n"))


def class_baselines(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "filing_returns").withColumn("label", S.three_classes(F.col("r_1d"), 0.01))
    return S.class_baseline(f, ["form"], "label").withColumn("baseline", F.round("baseline", 6))


def residual_targets(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "filing_returns").where("r_1d IS NOT NULL AND spy_r_1d IS NOT NULL").select("filing_id", "form", "r_1d", "spy_r_1d")
    return S.residuals(f, ["form"], "spy_r_1d", "r_1d").select("filing_id", F.round("residual", 6).alias("residual"))


def sign_split(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "filing_returns").where("r_1d IS NOT NULL AND r_1d <> 0 AND r_5d IS NOT NULL")
    return f.groupBy(F.when(F.col("r_1d") > 0, "up").otherwise("down").alias("side")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("r_5d"), 6).alias("mean"), F.round(F.stddev_pop("r_5d"), 6).alias("sd"))


def stratified_orders(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return S.stratified_sample(o, "o_orderpriority", [(F.col("o_orderkey") * 7919) % 10007, F.col("o_orderkey")], 333).select("o_orderpriority", "o_orderkey")


def label_bias(spark: SparkSession, sf: str) -> DataFrame:
    """Means of labelled and unlabelled items."""
    labelled = table(spark, sf, "annotations").select("item_id").distinct().withColumn("labelled", F.lit(True))
    p = table(spark, sf, "page_items").join(labelled, "item_id", "left").withColumn("labelled", F.coalesce("labelled", F.lit(False)))
    return p.groupBy("labelled").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("page_text_chars"), 4).alias("mean_chars"))


def vote_slots(spark: SparkSession, sf: str) -> DataFrame:
    """Balanced assignment of items to twelve annotator slots."""
    return S.balanced_slots(table(spark, sf, "page_items").select("item_id"), "item_id", 12)


def sampled_items(spark: SparkSession, sf: str) -> DataFrame:
    return S.hash_sample(table(spark, sf, "page_items").select("item_id"), "item_id", 100, 42)


QUERIES = {
    f.__name__: f
    for f in (
        majority_votes, pairwise_votes, fleiss_votes, vote_confusion, cohen_votes, vote_ratios, price_outliers, clipped_returns, return_fits, rank_correlation,
        tail_labels, class_baselines, residual_targets, sign_split, stratified_orders, label_bias, vote_slots, sampled_items,
    )
}
_PAIRS = _VOTES + ", p AS (SELECT item_id, min_by(status, annotator) AS a, max_by(status, annotator) AS b FROM v GROUP BY 1 HAVING count(*) > 1), q AS (SELECT list_position(['ok', 'uncertain', 'not_ok'], a) AS i, list_position(['ok', 'uncertain', 'not_ok'], b) AS j FROM p)"
_KAPPA = """, w AS (SELECT unnest(['none', 'linear', 'quadratic']) AS weights),
o AS (SELECT weights, count(*) AS n, sum(CASE weights WHEN 'none' THEN (i <> j)::DOUBLE WHEN 'linear' THEN abs(i - j)::DOUBLE ELSE ((i - j) * (i - j))::DOUBLE END) AS o FROM q CROSS JOIN w GROUP BY 1),
e AS (SELECT weights, sum(CASE weights WHEN 'none' THEN (x.i <> y.j)::DOUBLE WHEN 'linear' THEN abs(x.i - y.j)::DOUBLE ELSE ((x.i - y.j) * (x.i - y.j))::DOUBLE END * x.c * y.c) AS e
  FROM (SELECT i, count(*) AS c FROM q GROUP BY 1) x CROSS JOIN (SELECT j, count(*) AS c FROM q GROUP BY 1) y CROSS JOIN w GROUP BY 1)
SELECT weights, n, round(1 - o / (e / n), 6) AS kappa FROM o JOIN e USING (weights)"""
ORACLES = {
    "majority_votes": _VOTES + "SELECT item_id, CAST(sum(c) AS BIGINT) AS votes, max(CASE WHEN 2 * c > t THEN status END) AS majority FROM (SELECT *, sum(c) OVER (PARTITION BY item_id) AS t FROM c) GROUP BY 1",
    "pairwise_votes": _VOTES + ", i AS (SELECT item_id, sum(c) AS n, sum(c * (c - 1)) AS a FROM c GROUP BY 1) SELECT CAST(sum(a) / 2 AS BIGINT) AS agreeing, CAST(sum(n * (n - 1)) / 2 AS BIGINT) AS pairs, round(sum(a) / sum(n * (n - 1)), 6) AS agreement FROM i",
    "fleiss_votes": _VOTES + ", i AS (SELECT item_id, sum(c) AS n, sum(c * (c - 1)) AS a FROM c GROUP BY 1 HAVING sum(c) = 5), s AS (SELECT status, sum(c) AS c FROM c WHERE item_id IN (SELECT item_id FROM i) GROUP BY 1), e AS (SELECT sum(c * c) / power(sum(c), 2) AS pe FROM s), p AS (SELECT count(*) AS items, avg(a / 20) AS p FROM i) SELECT items, round((p - pe) / (1 - pe), 6) AS kappa FROM p, e",
    "vote_confusion": _PAIRS + " SELECT a, b, count(*) AS n FROM p GROUP BY 1, 2",
    "cohen_votes": _PAIRS + _KAPPA,
    "vote_ratios": _VOTES + "SELECT annotator, count(*) AS reviewed, count(*) FILTER (WHERE status <> 'uncertain') AS decided, round(count(*) FILTER (WHERE status = 'ok') / nullif(count(*) FILTER (WHERE status <> 'uncertain'), 0), 6) AS ok_share FROM v GROUP BY 1",
    "price_outliers": "WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.75) AS b FROM lineitem GROUP BY 1) SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber FROM lineitem JOIN q USING (l_returnflag) WHERE l_extendedprice < a - 0.5 * (b - a) OR l_extendedprice > b + 0.5 * (b - a)",
    "clipped_returns": "WITH q AS (SELECT form, quantile_cont(r_1d, 0.02) AS a, quantile_cont(r_1d, 0.98) AS b FROM filing_returns WHERE r_1d IS NOT NULL GROUP BY 1) SELECT form, count(*) AS n, round(avg(r_1d), 6) AS mean, round(min(r_1d), 6) AS least, round(max(r_1d), 6) AS most FROM filing_returns JOIN q USING (form) WHERE r_1d BETWEEN a AND b GROUP BY 1",
    "return_fits": "SELECT form, count(*) AS n, round(regr_slope(r_1d, spy_r_1d), 6) AS slope, round(regr_intercept(r_1d, spy_r_1d), 6) AS intercept, round(regr_r2(r_1d, spy_r_1d), 6) AS r2, round(corr(spy_r_1d, r_1d), 6) AS r, round(stddev_pop(r_1d) * sqrt(1 - regr_r2(r_1d, spy_r_1d)), 6) AS residual_sd FROM filing_returns WHERE r_1d IS NOT NULL AND spy_r_1d IS NOT NULL GROUP BY 1 HAVING count(*) >= 20",
    "rank_correlation": "WITH r AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2 AS a, rank() OVER (PARTITION BY l_returnflag ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_returnflag, l_discount) - 1) / 2 AS b FROM lineitem) SELECT l_returnflag, round(corr(a, b), 6) AS spearman, count(*) AS n FROM r GROUP BY 1",
    "tail_labels": "WITH q AS (SELECT form, quantile_cont(r_5d, 0.1) AS a, quantile_cont(r_5d, 0.9) AS b FROM filing_returns WHERE r_5d IS NOT NULL GROUP BY 1) SELECT form, count(*) FILTER (WHERE r_5d >= b) AS top, count(*) FILTER (WHERE r_5d <= a) AS bottom, count(*) AS n FROM filing_returns JOIN q USING (form) WHERE r_5d IS NOT NULL GROUP BY 1",
    "class_baselines": "WITH c AS (SELECT form, CASE WHEN r_1d > 0.01 THEN 1 WHEN r_1d < -0.01 THEN -1 ELSE 0 END AS l, count(*) AS c FROM filing_returns WHERE r_1d IS NOT NULL GROUP BY 1, 2) SELECT form, count(*) AS classes, min(c) AS smallest, round(max(c) / sum(c), 6) AS baseline FROM c GROUP BY 1",
    "residual_targets": "WITH f AS (SELECT form, regr_slope(r_1d, spy_r_1d) AS s, regr_intercept(r_1d, spy_r_1d) AS i FROM filing_returns WHERE r_1d IS NOT NULL AND spy_r_1d IS NOT NULL GROUP BY 1) SELECT filing_id, round(r_1d - i - s * spy_r_1d, 6) AS residual FROM filing_returns JOIN f USING (form) WHERE r_1d IS NOT NULL AND spy_r_1d IS NOT NULL",
    "sign_split": "SELECT CASE WHEN r_1d > 0 THEN 'up' ELSE 'down' END AS side, count(*) AS n, round(avg(r_5d), 6) AS mean, round(stddev_pop(r_5d), 6) AS sd FROM filing_returns WHERE r_1d <> 0 AND r_5d IS NOT NULL GROUP BY 1",
    "stratified_orders": """WITH c AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1), x AS (SELECT *, 333 * n / sum(n) OVER () AS e FROM c), b AS (SELECT *, floor(e) AS f, row_number() OVER (ORDER BY e - floor(e) DESC, o_orderpriority) AS k, sum(floor(e)) OVER () AS t FROM x),
q AS (SELECT o_orderpriority, f + CASE WHEN k <= 333 - t THEN 1 ELSE 0 END AS take FROM b), r AS (SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY (o_orderkey * 7919) % 10007, o_orderkey) AS i FROM orders)
SELECT o_orderpriority, o_orderkey FROM r JOIN q USING (o_orderpriority) WHERE i <= take""",
    "label_bias": "SELECT item_id IN (SELECT item_id FROM annotations WHERE item_id IS NOT NULL) AS labelled, count(*) AS n, round(avg(page_text_chars), 4) AS mean_chars FROM page_items GROUP BY 1",
}
