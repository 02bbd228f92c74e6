"""Queries over time series and event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import series as W
from ..session import clean_ticker, durable, table


def _daily(spark: SparkSession, sf: str) -> DataFrame:
    """One price and volume per nation and day with orders."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.groupBy("c_nationkey", F.col("o_orderdate").cast("date").alias("day")).agg(F.avg("o_totalprice").alias("price"), F.count(F.lit(1)).cast("double").alias("volume"))


def _numbered(spark: SparkSession, sf: str) -> DataFrame:
    """The daily series with each day's ordinal, kept because every step reads it anew."""
    return durable(W.with_ordinal(_daily(spark, sf), ["c_nationkey"], "day"))


_DAILY = "WITH d AS (SELECT c_nationkey, CAST(o_orderdate AS DATE) AS day, avg(o_totalprice) AS price, CAST(count(*) AS DOUBLE) AS volume FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"
_BY = ["c_nationkey"]


def _r(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


def daily_returns(spark: SparkSession, sf: str) -> DataFrame:
    return _r(W.pct_change(_numbered(spark, sf), _BY, "day", "price", "ret"), "ret").select("c_nationkey", "day", "ret")


def rolling_volatility(spark: SparkSession, sf: str) -> DataFrame:
    d = W.pct_change(_numbered(spark, sf), _BY, "day", "price", "ret")
    return _r(W.rolling_sd(d, _BY, "day", "ret", 20, "vol20"), "vol20").select("c_nationkey", "day", "vol20")


def shifted_returns(spark: SparkSession, sf: str) -> DataFrame:
    d = W.shifted_return(_numbered(spark, sf), _BY, "day", "price", [-5, 1, 5])
    d = d.withColumn("trailing_5", W.trailing(F.col("return_m5")))
    return _r(d, "return_m5", "return_1", "return_5", "trailing_5").select("c_nationkey", "day", "return_m5", "return_1", "return_5", "trailing_5")


def abnormal_volume(spark: SparkSession, sf: str) -> DataFrame:
    """Volume against the whole sample's mean."""
    d = _daily(spark, sf)
    mean = d.groupBy(*_BY).agg(F.avg("volume").alias("m"))
    return d.join(mean, _BY).select("c_nationkey", "day", F.round(F.col("volume") / F.col("m"), 6).alias("ats"))


def region_means(spark: SparkSession, sf: str) -> DataFrame:
    groups = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").cast("bigint").alias("region"))
    return _r(W.group_means(_daily(spark, sf), groups, "c_nationkey", "region", "day", "price", "volume"), "equal_weighted", "volume_weighted")


def next_trading_day(spark: SparkSession, sf: str) -> DataFrame:
    """The first window day on or after each filing, per ticker."""
    f = table(spark, sf, "filing_returns").where("filing_date IS NOT NULL").select(clean_ticker(F.col("ticker")).alias("k"), "filing_id", "filing_date").where("k IS NOT NULL")
    w = table(spark, sf, "event_windows").where("t0 IS NOT NULL").select(clean_ticker(F.col("ticker")).alias("k"), F.col("t0").alias("day")).where("k IS NOT NULL")
    return W.as_of_next(f, w, ["k"], "filing_date", "day").select("filing_id", "next_day")


def latest_window_before(spark: SparkSession, sf: str) -> DataFrame:
    """The latest window start between 60 days before a filing and one day after."""
    f = table(spark, sf, "filing_returns").select(clean_ticker(F.col("ticker")).alias("k"), "filing_id", "filing_date").where("k IS NOT NULL")
    w = table(spark, sf, "event_windows").select(clean_ticker(F.col("ticker")).alias("k"), "t0").where("k IS NOT NULL")
    return W.latest_within(f, w, ["k"], "filing_id", "filing_date", "t0", 60, 1).select("filing_id", "other_date")


def _events(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    d = durable(W.with_ordinal(_daily(spark, sf), _BY, "day", "price"))
    days = d.groupBy(*_BY, F.year("day").alias("year")).agg(F.min("ordinal").alias("anchor"))
    n = d.groupBy(*_BY).agg(F.count(F.lit(1)).alias("n"))
    kept = days.join(n, _BY).where(W.inside(F.col("anchor"), F.col("n"), 10)).select(*_BY, "year", "anchor")
    return W.event_rows(d, kept, _BY, "year", "anchor", list(range(-5, 6)), "price"), kept


def event_curve(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = _events(spark, sf)
    out = W.event_curve(rows.withColumn("half", F.when(F.col("c_nationkey") < 12, "a").otherwise("b")), ["half"], "price")
    return _r(out.withColumn("day", F.col("day").cast("bigint")), "mean", "sem", "low", "high", places=5)


def day0_normalised(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = _events(spark, sf)
    out = W.day0_normalised(rows, [*_BY, "year"], "price")
    return out.select("c_nationkey", F.col("year").cast("bigint"), F.col("day").cast("bigint"), F.round("normalised", 6).alias("normalised"))


def group_separation(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = _events(spark, sf)
    curve = W.event_curve(rows.withColumn("half", F.when(F.col("c_nationkey") < 12, "a").otherwise("b")), ["half"], "price")
    return _r(W.separation(curve, "half", "a", "b").withColumn("day", F.col("day").cast("bigint")), "separation", places=5)


def window_gaps(spark: SparkSession, sf: str) -> DataFrame:
    rows, kept = _events(spark, sf)
    out = W.missing_days(rows.where("price < 200000"), kept, [*_BY, "year"], list(range(-5, 6)), "price")
    return out.withColumn("year", F.col("year").cast("bigint"))


def central_changes(spark: SparkSession, sf: str) -> DataFrame:
    d = W.central_change(_numbered(spark, sf), _BY, "day", "volume", "change")
    d = W.forward_mean(d, _BY, "day", "price", 1, 5, "ahead5")
    return _r(d, "ahead5").select("c_nationkey", "day", "change", "ahead5")


def _filings(spark: SparkSession, sf: str) -> DataFrame:
    """Orders read as filings accepted at a time of day that comes from their key."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    at = F.col("o_orderdate").cast("date").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("o_orderkey") * 7919 % 86400).cast("decimal(18,6)"))
    return o.select("c_nationkey", "o_orderkey", at.alias("accepted"))


def filing_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of every filing by its nation's trading days."""
    out = W.filing_windows(_filings(spark, sf), _daily(spark, sf), _BY, "o_orderkey", "accepted", "day", "UTC")
    return out.select("o_orderkey", "filing_window_class", "t0", "t1", "t5")


def filing_returns_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Returns around every filing, against all nations and against the region."""
    daily = _numbered(spark, sf)
    stock = W.shifted_return(daily, _BY, "day", "price", [1, 5])
    stock = W.rolling_sd(W.pct_change(stock, _BY, "day", "price", "ret"), _BY, "day", "ret", 20, "volatility")
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").cast("bigint").alias("region"))
    benchmark = W.pct_change(daily.groupBy("day").agg(F.avg("price").alias("price")).withColumn("one", F.lit(1)), ["one"], "day", "price", "returns").select("day", "returns")
    stock = durable(stock)  # read by nation and by region, at three days each
    industry = stock.join(F.broadcast(nations), "c_nationkey").groupBy("region", "day").agg(*[F.avg(c).alias(c) for c in ("return_1", "return_5", "volume", "volatility")])
    windows = W.filing_windows(_filings(spark, sf), daily, _BY, "o_orderkey", "accepted", "day", "UTC").where("t1 IS NOT NULL").join(F.broadcast(nations), "c_nationkey")
    out = W.filing_returns(windows, stock, benchmark, industry, _BY, ["region"], "day")
    figures = [f"{a}{b}" for a, b in (("r_", "1d"), ("r_", "5d"), ("spy_r_", "1d"), ("spy_r_", "5d"), ("a_", "1d"), ("a_", "5d"), ("unbiased_a_", "1d"), ("unbiased_a_", "5d"), ("unbiased_volume_", "t1"), ("unbiased_volume_", "t5"), ("unbiased_volatility_", "t1"), ("unbiased_volatility_", "t5"))]
    return out.select("o_orderkey", "t1", *[F.round(c, 6).alias(c) for c in figures])


QUERIES = {
    f.__name__: f
    for f in (daily_returns, rolling_volatility, shifted_returns, abnormal_volume, region_means, next_trading_day, latest_window_before, event_curve, day0_normalised, group_separation, window_gaps, central_changes, filing_sessions, filing_returns_rows)
}
_W = "OVER (PARTITION BY c_nationkey ORDER BY day)"
_EV = _DAILY + """, o AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY day) - 1 AS ordinal, count(*) OVER (PARTITION BY c_nationkey) AS n FROM d),
a AS (SELECT c_nationkey, year(day) AS year, min(ordinal) AS anchor, min(n) AS n FROM o GROUP BY 1, 2 HAVING min(ordinal) >= 10 AND min(ordinal) < min(n) - 10),
r AS (SELECT a.c_nationkey, a.year, o.ordinal - a.anchor AS day, o.price FROM a JOIN o ON o.c_nationkey = a.c_nationkey AND o.ordinal BETWEEN a.anchor - 5 AND a.anchor + 5)
"""
_KEY = r"nullif(regexp_replace(regexp_replace(upper(ticker), '\s+', '', 'g'), '\.(L|AX|TO|V)$', ''), '')"
_CURVE = "SELECT CASE WHEN c_nationkey < 12 THEN 'a' ELSE 'b' END AS half, day, avg(price) AS mean, stddev_samp(price) / sqrt(count(price)) AS sem, count(price) AS n FROM r GROUP BY 1, 2"
_FILED = _DAILY + """, o AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY day) - 1 AS ordinal FROM d),
f AS (SELECT c_nationkey, o_orderkey, CAST(o_orderdate AS DATE) AS fd, (o_orderkey * 7919 % 86400) / 60 AS m FROM orders JOIN customer ON o_custkey = c_custkey),
g AS (SELECT f.*, CASE WHEN o.day IS NULL THEN 'non_trading_day' WHEN m < 570 THEN 'pre_market' WHEN m <= 960 THEN 'intraday' ELSE 'after_hours' END AS class FROM f LEFT JOIN o ON o.c_nationkey = f.c_nationkey AND o.day = f.fd),
h AS (SELECT *, CASE WHEN class IN ('pre_market', 'intraday') THEN fd ELSE fd + 1 END AS since FROM g),
k AS (SELECT h.*, o.ordinal FROM h ASOF LEFT JOIN o ON h.c_nationkey = o.c_nationkey AND h.since <= o.day),
w AS (SELECT k.c_nationkey, o_orderkey, CASE WHEN z.day IS NOT NULL THEN class END AS filing_window_class, z.day AS t0, CASE WHEN z.day IS NOT NULL THEN x.day END AS t1, CASE WHEN z.day IS NOT NULL THEN y.day END AS t5
  FROM k LEFT JOIN o x ON x.c_nationkey = k.c_nationkey AND x.ordinal = k.ordinal LEFT JOIN o z ON z.c_nationkey = k.c_nationkey AND z.ordinal = k.ordinal - 1 LEFT JOIN o y ON y.c_nationkey = k.c_nationkey AND y.ordinal = k.ordinal + 4)
"""
ORACLES = {
    "filing_sessions": _FILED + "SELECT o_orderkey, filing_window_class, t0, t1, t5 FROM w",
    "filing_returns_rows": _FILED + f""", s0 AS (SELECT *, price / lag(price) {_W} - 1 AS ret, lead(price, 1) {_W} / price - 1 AS r1, lead(price, 5) {_W} / price - 1 AS r5 FROM d),
s AS (SELECT *, CASE WHEN count(ret) OVER v >= 20 THEN stddev_samp(ret) OVER v END AS vola FROM s0 WINDOW v AS (PARTITION BY c_nationkey ORDER BY day ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
b AS (SELECT day, p / lag(p) OVER (ORDER BY day) - 1 AS ret FROM (SELECT day, avg(price) AS p FROM d GROUP BY 1)),
i AS (SELECT n_regionkey AS region, day, avg(r1) AS r1, avg(r5) AS r5, avg(volume) AS volume, avg(vola) AS vola FROM s JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2),
x AS (SELECT w.*, n_regionkey AS region FROM w JOIN nation ON n_nationkey = c_nationkey WHERE t1 IS NOT NULL)
SELECT o_orderkey, t1, round(s0.r1, 6) AS r_1d, round(CASE WHEN t5 IS NOT NULL THEN s0.r5 END, 6) AS r_5d, round(b1.ret, 6) AS spy_r_1d, round(b5.ret, 6) AS spy_r_5d, round(s0.r1 - b1.ret, 6) AS a_1d,
  round(CASE WHEN t5 IS NOT NULL THEN s0.r5 END - b5.ret, 6) AS a_5d, round(s0.r1 - i0.r1, 6) AS unbiased_a_1d, round(CASE WHEN t5 IS NOT NULL THEN s0.r5 - i0.r5 END, 6) AS unbiased_a_5d,
  round(s1.volume - i1.volume, 6) AS unbiased_volume_t1, round(s5.volume - i5.volume, 6) AS unbiased_volume_t5, round(s1.vola - i1.vola, 6) AS unbiased_volatility_t1, round(s5.vola - i5.vola, 6) AS unbiased_volatility_t5
FROM x LEFT JOIN s s0 ON s0.c_nationkey = x.c_nationkey AND s0.day = t0 LEFT JOIN s s1 ON s1.c_nationkey = x.c_nationkey AND s1.day = t1 LEFT JOIN s s5 ON s5.c_nationkey = x.c_nationkey AND s5.day = t5
  LEFT JOIN i i0 ON i0.region = x.region AND i0.day = t0 LEFT JOIN i i1 ON i1.region = x.region AND i1.day = t1 LEFT JOIN i i5 ON i5.region = x.region AND i5.day = t5 LEFT JOIN b b1 ON b1.day = t1 LEFT JOIN b b5 ON b5.day = t5""",
    "daily_returns": _DAILY + f"SELECT c_nationkey, day, round(price / lag(price) {_W} - 1, 6) AS ret FROM d",
    "rolling_volatility": _DAILY + f", x AS (SELECT *, price / lag(price) {_W} - 1 AS ret FROM d) SELECT c_nationkey, day, round(CASE WHEN count(ret) OVER w >= 20 THEN stddev_samp(ret) OVER w END, 6) AS vol20 FROM x WINDOW w AS (PARTITION BY c_nationkey ORDER BY day ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)",
    "shifted_returns": _DAILY + f", x AS (SELECT *, lag(price, 5) {_W} / price - 1 AS m5, lead(price, 1) {_W} / price - 1 AS p1, lead(price, 5) {_W} / price - 1 AS p5 FROM d) SELECT c_nationkey, day, round(m5, 6) AS return_m5, round(p1, 6) AS return_1, round(p5, 6) AS return_5, round(1 / (m5 + 1) - 1, 6) AS trailing_5 FROM x",
    "abnormal_volume": _DAILY + "SELECT c_nationkey, day, round(volume / avg(volume) OVER (PARTITION BY c_nationkey), 6) AS ats FROM d",
    "region_means": _DAILY + """, j AS (SELECT d.*, CAST(n_regionkey AS BIGINT) AS region FROM d JOIN nation ON c_nationkey = n_nationkey), w AS (SELECT region, c_nationkey, avg(volume) AS w FROM j GROUP BY 1, 2), t AS (SELECT region, sum(w) AS t FROM w GROUP BY 1)
SELECT j.region, j.day, round(avg(price), 6) AS equal_weighted, round(sum(w / t * coalesce(price, 0)), 6) AS volume_weighted FROM j JOIN w USING (region, c_nationkey) JOIN t USING (region) GROUP BY 1, 2""",
    "next_trading_day": f"""WITH f AS (SELECT filing_id, {_KEY} AS k, CAST(filing_date AS DATE) AS d FROM filing_returns WHERE filing_date IS NOT NULL), w AS (SELECT DISTINCT {_KEY} AS k, CAST(t0 AS DATE) AS d FROM event_windows WHERE t0 IS NOT NULL)
SELECT filing_id, w.d AS next_day FROM f ASOF LEFT JOIN w ON f.k = w.k AND f.d <= w.d WHERE f.k IS NOT NULL""",
    "latest_window_before": f"""WITH f AS (SELECT filing_id, {_KEY} AS k, CAST(filing_date AS DATE) AS d FROM filing_returns WHERE filing_date IS NOT NULL), w AS (SELECT DISTINCT {_KEY} AS k, CAST(t0 AS DATE) AS d FROM event_windows WHERE t0 IS NOT NULL)
SELECT filing_id, max(w.d) AS other_date FROM f JOIN w ON f.k = w.k AND w.d BETWEEN f.d - 60 AND f.d + 1 GROUP BY filing_id""",
    "event_curve": _EV + f", c AS ({_CURVE}) SELECT half, day, round(mean, 5) AS mean, round(sem, 5) AS sem, n, round(mean - 1.96 * sem, 5) AS low, round(mean + 1.96 * sem, 5) AS high FROM c",
    "day0_normalised": _EV + "SELECT r.c_nationkey, r.year, r.day, round((r.price - z.price) / nullif(abs(z.price), 0), 6) AS normalised FROM r LEFT JOIN r z ON z.c_nationkey = r.c_nationkey AND z.year = r.year AND z.day = 0",
    "group_separation": _EV + f", c AS ({_CURVE}) SELECT day, round(abs(max(mean) FILTER (WHERE half = 'a') - max(mean) FILTER (WHERE half = 'b')), 5) AS separation FROM c GROUP BY 1",
    "window_gaps": _EV + "SELECT a.c_nationkey, a.year, 11 - count(r.price) AS missing FROM a LEFT JOIN r ON r.c_nationkey = a.c_nationkey AND r.year = a.year AND r.price < 200000 GROUP BY 1, 2",
    "central_changes": _DAILY + f"SELECT c_nationkey, day, lead(volume) {_W} - lag(volume) {_W} AS change, round(avg(price) OVER (PARTITION BY c_nationkey ORDER BY day ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), 6) AS ahead5 FROM d",
}
