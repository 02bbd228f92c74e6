"""Queries that select, look up, label and lay out rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import facts as A
from ..operators import match as M
from ..operators import series as W
from ..operators import stats as S
from ..operators import text as T
from ..session import table


def clean_companies(spark: SparkSession, sf: str) -> DataFrame:
    """Mapped companies without a missing cell."""
    rows = table(spark, sf, "lse_companies")
    return A.usable(rows, ["ticker", "company_name", "sector", "industry", "hq_city"]).select("company_id")


def exchange_allow_list(spark: SparkSession, sf: str) -> DataFrame:
    """Companies dropped by an allow-list of exchange labels."""
    allow = spark.createDataFrame([("LSE",)], "exchange_yahoo string")
    kept, dropped = A.allowed(table(spark, sf, "lse_companies"), allow, ["exchange_yahoo"])
    return kept.groupBy("exchange_yahoo").agg(F.count(F.lit(1)).alias("n")).withColumn("kept", F.lit(True)).unionByName(dropped.withColumnRenamed("dropped", "n").withColumn("kept", F.lit(False)))


def source_routes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "report_notes").groupBy("exchange", A.route(F.col("exchange")).alias("route")).agg(F.count(F.lit(1)).alias("n"))


def component_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Per customer the first of two sets of order totals by priority that is there whole."""
    facts = table(spark, sf, "orders").groupBy("o_custkey", F.col("o_orderpriority").alias("tag")).agg(F.max("o_totalprice").alias("value"))
    out = A.signed_sums(facts, ["o_custkey"], "tag", "value", [[(1, "1-URGENT"), (-1, "2-HIGH")], [(1, "3-MEDIUM"), (1, "5-LOW")]])
    return out.select("o_custkey", F.round("value", 4).alias("value"), F.col("component_set").cast("bigint"))


def answerable_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Questions with a truth and a report, counted step by step."""
    q = table(spark, sf, "eval_items").select("query_id", T.question_parts(F.col("query_id")).alias("p")).select("query_id", "p.*")
    truth = table(spark, sf, "candidates").select("ticker", "year", F.lower("kpi").alias("kpi"))
    _, steps = A.answerable(q, truth, table(spark, sf, "report_notes").select("ticker", "year"), ["ticker", "kpi", "year"], ["ticker", "year"])
    return steps


def report_packages(spark: SparkSession, sf: str) -> DataFrame:
    """Each report's figures beside the length of its text."""
    facts = table(spark, sf, "candidates").where("report_name IS NOT NULL AND kpi IS NOT NULL").groupBy(F.col("report_name").alias("report"), F.lower("kpi").alias("kpi")).agg(F.max("normalized_value").alias("value"))
    pages = table(spark, sf, "report_pages").where("text IS NOT NULL").groupBy("report", "page").agg(F.max(F.char_length("text")).alias("n"))
    out = A.with_texts(facts, pages.groupBy("report").agg(F.sum("n").alias("chars")), "report")
    return out.select("report", F.size("facts").cast("bigint").alias("figures"), F.get("facts", F.lit(0))["kpi"].alias("first_kpi"), "chars")


def ticker_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Sector of each noted report's ticker, looked up as it stands or with the exchange suffix."""
    known = table(spark, sf, "lse_companies").where("ticker IS NOT NULL").groupBy("ticker").agg(F.min("sector").alias("sector"))
    return A.looked_up(table(spark, sf, "report_notes").select("report_name", "ticker"), known, "ticker", ["sector"])


def sector_sizes(spark: SparkSession, sf: str) -> DataFrame:
    out = A.nested_groups(table(spark, sf, "lse_companies").where("sector IS NOT NULL AND industry IS NOT NULL AND ticker IS NOT NULL"), "sector", "industry", "ticker")
    largest = F.array_max(F.transform("groups", lambda g: F.size(g["members"])))
    return out.select("sector", F.size("groups").cast("bigint").alias("industries"), largest.cast("bigint").alias("largest"), "at_least_2", "at_least_5", "at_least_10")


def wanted_years(spark: SparkSession, sf: str) -> DataFrame:
    """Reports of a list of years."""
    years = A.parse_years("2012-2014, 2017")
    return table(spark, sf, "report_notes").where(F.col("year").isin(years)).groupBy(F.col("year").cast("bigint").alias("year")).agg(F.count(F.lit(1)).alias("n"))


def first_reports(spark: SparkSession, sf: str) -> DataFrame:
    """The first 25 reports by name."""
    return A.top_rows(table(spark, sf, "report_notes").select("report_name"), [F.col("report_name")], 25)


def top_days(spark: SparkSession, sf: str) -> DataFrame:
    """The ten days with the largest orders."""
    daily = table(spark, sf, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.max("o_totalprice").alias("price"))
    return A.top_rows(daily, [F.col("price").desc(), F.col("day")], 10)


def trimmed_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Mean balance by segment with the lowest customers of two segments left out."""
    _, rest = A.trimmed(table(spark, sf, "customer"), "c_mktsegment", "c_acctbal", "c_custkey", {"BUILDING": 3, "MACHINERY": 1})
    return rest.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("c_acctbal"), 5).alias("mean"))


def budgeted(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with the lowest balances whose orders fit a budget of 40 calls."""
    orders = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("calls"))
    rows = table(spark, sf, "customer").join(orders, "c_custkey").select("c_custkey", (-F.col("c_acctbal")).alias("deficit"), "calls")
    return A.within_budget(rows, "deficit", "calls", "c_custkey", 40).select("c_custkey", "calls")


def audit_cells(spark: SparkSession, sf: str) -> DataFrame:
    return _audits(spark, sf)[0]


def audit_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return _audits(spark, sf)[1]


def audit_tickers(spark: SparkSession, sf: str) -> DataFrame:
    return _audits(spark, sf)[2]


def _audits(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    c = table(spark, sf, "candidates").where("ticker IS NOT NULL AND kpi IS NOT NULL")
    reason = F.when(F.col("normalized_value").isNull(), "no value").when(F.col("chosen_multiplier").isNull(), "no multiplier").otherwise("ok")
    rows = c.select("ticker", F.col("year").cast("bigint").alias("year"), F.lower("kpi").alias("kpi"), reason.alias("reason"), F.when(reason == "ok", "matched").otherwise("unmatched").alias("status"))
    cells, reasons, tickers = M.audit_tables(rows)
    r = lambda d: d.withColumn("match_rate", F.round("match_rate", 6))
    return r(cells), reasons, r(tickers)


def confident_rejections(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates that a judge, here the parity of the id, rejects against strong evidence of value and unit."""
    c = table(spark, sf, "candidates").where("normalized_value IS NOT NULL")
    rows = c.select("candidate_id", "unit_source", F.when(F.col("snippet").isNotNull(), "alias+value").otherwise("value-only").alias("match_type"), (F.pmod("candidate_id", F.lit(7)) / 1000).alias("rel_error"), F.pmod("candidate_id", F.lit(3)).alias("grade"))
    return M.confident_rejections(rows, "match_type", "rel_error", "unit_source", "grade").select("candidate_id")


def reason_counts(spark: SparkSession, sf: str) -> DataFrame:
    """How often each reason to look at a page holds."""
    reasons = T.page_reasons(F.col("text"), ["financial review", "segment information", "accounting policies"], ["net debt", "gross profit", "working capital"])
    return table(spark, sf, "report_pages").where("text IS NOT NULL").select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def line_hints(spark: SparkSession, sf: str) -> DataFrame:
    """Lines per page whose three-line context states a unit."""
    pages = table(spark, sf, "report_pages").where("text IS NOT NULL").groupBy("docid").agg(F.min("text").alias("text"))
    lines = T.line_context(pages.select("docid", F.posexplode(F.split("text", "\n")).alias("line", "t")), ["docid"], "line", "t")
    return lines.where(F.size(T.unit_hints(F.col("context"))) > 0).groupBy("docid").agg(F.count(F.lit(1)).alias("lines"))


def grade_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """How far two grades of a line are apart, by return flag."""
    rows = table(spark, sf, "lineitem").select("l_returnflag", (F.col("l_linenumber") % 4).alias("a"), (F.col("l_quantity").cast("int") % 4).alias("b"))
    return S.off_by(rows, "a", "b", ["l_returnflag"])


def best_methods(spark: SparkSession, sf: str) -> DataFrame:
    """Best mean discount over line numbers per cell of flag and status, against the mean tax; one number's figures are not numbers."""
    rows = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus", F.concat(F.lit("m"), "l_linenumber").alias("method")).agg(F.avg("l_discount").alias("metric"), F.avg("l_tax").alias("base"))
    rows = rows.withColumn("metric", F.when(F.col("method") == "m3", F.lit(float("nan"))).otherwise(F.col("metric")))
    out = S.best_per_cell(rows, ["l_returnflag", "l_linestatus"], "method", "metric", "base")
    return out.select("l_returnflag", "l_linestatus", "method", *[F.round(c, 8).alias(c) for c in ("best", "baseline", "gain")])


def class_window_means(spark: SparkSession, sf: str) -> DataFrame:
    """Mean value by event type, over all days and over days 0 to 5 of the month."""
    e = table(spark, sf, "events").select("event_type", "value", (F.dayofmonth("ts") - 1).alias("day"))
    out = S.means_by_class(e, "event_type", "day", ["value"])
    return out.select("event_type", "n", F.round("mean_value", 6).alias("mean_value"), F.round("window_value", 6).alias("window_value"))


def selection_bias(spark: SparkSession, sf: str) -> DataFrame:
    """Mean order price of customers with and without an urgent order, by customer first."""
    o = table(spark, sf, "orders")
    flagged = o.join(o.where("o_orderpriority = '1-URGENT'").select("o_custkey").distinct().withColumn("flag", F.lit(True)), "o_custkey", "left").withColumn("flag", F.coalesce("flag", F.lit(False)))
    return S.labelled_ratio(flagged, "o_custkey", "flag", "o_totalprice").select(*[F.round(c, 5).alias(c) for c in ("labelled", "unlabelled", "ratio")])


def return_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Classes of filing returns by a threshold of two per cent, with the reason to skip them."""
    _, counts = S.threshold_labels(table(spark, sf, "filing_returns"), "r_1d", 0.02)
    return counts


def moved_anchors(spark: SparkSession, sf: str) -> DataFrame:
    """First order days of each year moved by two days of trading, with 60 days still to come."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    days = W.with_ordinal(o.select("c_nationkey", F.col("o_orderdate").cast("date").alias("day")).distinct(), ["c_nationkey"], "day")
    anchors = days.groupBy("c_nationkey", F.year("day").alias("year")).agg(F.min("ordinal").alias("anchor"))
    out = W.shifted_anchor(anchors, days.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("rows")), ["c_nationkey"], "anchor", 2, 60)
    return out.select("c_nationkey", F.col("year").cast("bigint"), F.col("anchor").cast("bigint"))


def short_names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "report_notes").select("report_name", T.short_name(F.col("company_name")).alias("name"))


def page_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as prompts of numbered pages."""
    d = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", T.page_prompt(F.col("text")).alias("p"))
    return d.select("doc_id", F.char_length("p").cast("bigint").alias("chars"), F.sha2("p", 256).alias("sha"))


QUERIES = {
    f.__name__: f
    for f in (
        clean_companies, exchange_allow_list, source_routes, component_sets, answerable_questions, report_packages, ticker_lookup, sector_sizes, wanted_years, first_reports, top_days, trimmed_groups, budgeted, audit_cells,
        audit_reasons, audit_tickers, confident_rejections, reason_counts, line_hints, grade_offsets, best_methods, class_window_means, selection_bias, return_classes, moved_anchors, short_names, page_prompts,
    )
}
_AUDIT = "WITH a AS (SELECT ticker, CAST(year AS BIGINT) AS year, lower(kpi) AS kpi, CASE WHEN normalized_value IS NULL THEN 'no value' WHEN chosen_multiplier IS NULL THEN 'no multiplier' ELSE 'ok' END AS reason FROM candidates WHERE ticker IS NOT NULL AND kpi IS NOT NULL) "
_COUNTS = "count(*) AS total, count(*) FILTER (WHERE reason = 'ok') AS matched, round(count(*) FILTER (WHERE reason = 'ok') / count(*), 6) AS match_rate"
_UNITS = (
    r"'(?i)\([^)]*?\b(?:\$|usd|us\$|u\.s\.\$)?\s*(?:in\s+)?(thousands?|millions?|billions?)\b[^)]*\)'", r"'(?i)\bdollars?\s+in\s+(thousands?|millions?|billions?)\b'",
    r"'(?i)\ball\s+dollar\s+amounts?\s+(?:are\s+)?(?:stated|presented|shown)\s+in\s+(thousands?|millions?|billions?)\b'", r"'(?i)\bin\s+(thousands?|millions?|billions?)\b'",
)
_SPLIT = r"string_split_regex(text, '(?i)<---\s*page split\s*--->')"
ORACLES = {
    "clean_companies": "SELECT company_id FROM lse_companies WHERE " + " AND ".join(f"coalesce(trim({c}), '') NOT IN ('N/A', 'Error', '')" for c in ("ticker", "company_name", "sector", "industry", "hq_city")),
    "exchange_allow_list": "SELECT exchange_yahoo, count(*) AS n, coalesce(exchange_yahoo = 'LSE', false) AS kept FROM lse_companies GROUP BY 1",
    "source_routes": "SELECT exchange, CASE WHEN upper(exchange) IN ('NYSE', 'NASDAQ', 'AMEX') THEN 'filings' ELSE 'api' END AS route, count(*) AS n FROM report_notes GROUP BY 1, 2",
    "component_sets": """WITH f AS (SELECT o_custkey, o_orderpriority AS t, max(o_totalprice) AS v FROM orders GROUP BY 1, 2),
s AS (SELECT o_custkey, max(v) FILTER (WHERE t = '1-URGENT') - max(v) FILTER (WHERE t = '2-HIGH') AS a, max(v) FILTER (WHERE t = '3-MEDIUM') + max(v) FILTER (WHERE t = '5-LOW') AS b FROM f GROUP BY 1)
SELECT o_custkey, round(coalesce(a, b), 4) AS value, CASE WHEN a IS NOT NULL THEN 0 ELSE 1 END AS component_set FROM s WHERE coalesce(a, b) IS NOT NULL""",
    "answerable_questions": r"""WITH q AS (SELECT regexp_extract(query_id, '^([^_]+)_(.+)_([0-9]{4})$', 1) AS ticker, regexp_extract(query_id, '^([^_]+)_(.+)_([0-9]{4})$', 2) AS kpi, CAST(regexp_extract(query_id, '([0-9]{4})$', 1) AS INT) AS year FROM eval_items),
f AS (SELECT EXISTS (SELECT 1 FROM candidates c WHERE c.ticker = q.ticker AND c.year = q.year AND lower(c.kpi) = q.kpi) AS t, EXISTS (SELECT 1 FROM report_notes r WHERE r.ticker = q.ticker AND r.year = q.year) AS r FROM q)
SELECT count(*) AS questions, count(*) FILTER (WHERE NOT t) AS without_truth, count(*) FILTER (WHERE t AND NOT r) AS without_report, count(*) FILTER (WHERE t AND r) AS kept FROM f""",
    "report_packages": """WITH f AS (SELECT report_name AS report, lower(kpi) AS kpi FROM candidates WHERE report_name IS NOT NULL AND kpi IS NOT NULL GROUP BY 1, 2), p AS (SELECT report, page, max(length(text)) AS n FROM report_pages WHERE text IS NOT NULL GROUP BY 1, 2),
t AS (SELECT report, CAST(sum(n) AS BIGINT) AS chars FROM p GROUP BY 1) SELECT report, count(*) AS figures, min(kpi) AS first_kpi, any_value(chars) AS chars FROM f LEFT JOIN t USING (report) GROUP BY 1""",
    "ticker_lookup": """WITH k AS (SELECT ticker, min(sector) AS sector FROM lse_companies WHERE ticker IS NOT NULL GROUP BY 1)
SELECT report_name, r.ticker, CASE WHEN a.ticker IS NOT NULL THEN a.sector ELSE b.sector END AS sector FROM report_notes r LEFT JOIN k a ON a.ticker = r.ticker LEFT JOIN k b ON b.ticker = r.ticker || '.L'""",
    "sector_sizes": """WITH g AS (SELECT sector, industry, count(DISTINCT ticker) AS n FROM lse_companies WHERE sector IS NOT NULL AND industry IS NOT NULL AND ticker IS NOT NULL GROUP BY 1, 2)
SELECT sector, count(*) AS industries, max(n) AS largest, count(*) FILTER (WHERE n >= 2) AS at_least_2, count(*) FILTER (WHERE n >= 5) AS at_least_5, count(*) FILTER (WHERE n >= 10) AS at_least_10 FROM g GROUP BY 1""",
    "wanted_years": "SELECT CAST(year AS BIGINT) AS year, count(*) AS n FROM report_notes WHERE year IN (2012, 2013, 2014, 2017) GROUP BY 1",
    "first_reports": "SELECT report_name FROM report_notes ORDER BY report_name LIMIT 25",
    "top_days": "SELECT CAST(o_orderdate AS DATE) AS day, max(o_totalprice) AS price FROM orders GROUP BY 1 ORDER BY price DESC, day LIMIT 10",
    "trimmed_groups": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS n FROM customer)
SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 5) AS mean FROM r WHERE n > CASE c_mktsegment WHEN 'BUILDING' THEN 3 WHEN 'MACHINERY' THEN 1 ELSE 0 END GROUP BY 1""",
    "budgeted": """WITH o AS (SELECT o_custkey, count(*) AS calls FROM orders GROUP BY 1), r AS (SELECT c_custkey, calls, sum(calls) OVER (ORDER BY c_acctbal, c_custkey) AS s FROM customer JOIN o ON o_custkey = c_custkey WHERE c_acctbal < 0)
SELECT c_custkey, calls FROM r WHERE s <= 40""",
    "audit_cells": _AUDIT + f"SELECT kpi, year, {_COUNTS} FROM a GROUP BY 1, 2",
    "audit_reasons": _AUDIT + "SELECT reason, count(*) AS count FROM a WHERE reason <> 'ok' GROUP BY 1",
    "audit_tickers": _AUDIT + f""", n AS (SELECT ticker, reason, count(*) AS n FROM a WHERE reason <> 'ok' GROUP BY 1, 2), t AS (SELECT ticker, reason AS top_reason FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY n DESC, reason) AS i FROM n) WHERE i = 1),
c AS (SELECT ticker, {_COUNTS} FROM a GROUP BY 1) SELECT c.*, top_reason FROM c LEFT JOIN t USING (ticker)""",
    "confident_rejections": "SELECT candidate_id FROM candidates WHERE normalized_value IS NOT NULL AND snippet IS NOT NULL AND candidate_id % 7 < 5 AND candidate_id % 3 < 2 AND unit_source IN ('page', 'line', 'inline')",
    "reason_counts": r"""WITH l AS (SELECT lower(text) AS t, list_filter(list_transform(string_split_regex(text, '\r?\n'), lambda x: trim(x)), lambda x: x <> '') AS l FROM report_pages WHERE text IS NOT NULL),
r AS (SELECT unnest([CASE WHEN len(list_filter(l, lambda x: len(regexp_extract_all(x, '\|')) >= 2)) >= 2 OR len(list_filter(l, lambda x: regexp_matches(x, '^\|?\s*:?-{3,}:?\s*(\|\s*:?-{3,}:?\s*)+\|?$'))) > 0 THEN 'markdown-table' END,
  CASE WHEN contains(t, '<table') OR contains(t, '</td>') OR contains(t, '</tr>') THEN 'html-table' END, CASE WHEN len(list_filter(l, lambda x: len(regexp_extract_all(x, '[0-9][0-9,.]*')) >= 3)) >= 3 THEN 'dense-numeric-rows' END,
  CASE WHEN contains(t, 'financial review') OR contains(t, 'segment information') OR contains(t, 'accounting policies') THEN 'financial-heading' END,
  CASE WHEN contains(t, 'net debt')::INT + contains(t, 'gross profit')::INT + contains(t, 'working capital')::INT >= 2 THEN 'kpi-aliases' END]) AS reason FROM l)
SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY 1""",
    "line_hints": f"""WITH p AS (SELECT docid, min(text) AS text FROM report_pages WHERE text IS NOT NULL GROUP BY 1), l AS (SELECT docid, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM p),
c AS (SELECT docid, concat_ws(' ', lag(t) OVER w, t, lead(t) OVER w) AS c FROM l WINDOW w AS (PARTITION BY docid ORDER BY i))
SELECT docid, count(*) AS lines FROM c WHERE {' OR '.join(f'regexp_matches(c, {u})' for u in _UNITS)} GROUP BY 1""",
    "grade_offsets": """WITH g AS (SELECT l_returnflag, l_linenumber % 4 AS a, CAST(l_quantity AS INT) % 4 AS b FROM lineitem)
SELECT l_returnflag, count(*) AS n, count(*) FILTER (WHERE a = b) AS exact, count(*) FILTER (WHERE abs(a - b) = 1) AS off_by_1, count(*) FILTER (WHERE abs(a - b) >= 2) AS off_by_2, count(*) FILTER (WHERE a > b) AS a_higher, count(*) FILTER (WHERE a < b) AS b_higher FROM g GROUP BY 1""",
    "best_methods": """WITH a AS (SELECT l_returnflag, l_linestatus, l_linenumber AS k, avg(l_discount) AS d, avg(l_tax) AS base FROM lineitem GROUP BY 1, 2, 3), m AS (SELECT *, 'm' || k AS method, CASE WHEN k <> 3 THEN d END AS metric FROM a)
SELECT l_returnflag, l_linestatus, arg_max(method, metric) AS method, round(max(metric), 8) AS best, round(max(base), 8) AS baseline, round(max(metric) - max(base), 8) AS gain FROM m GROUP BY 1, 2""",
    "class_window_means": "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean_value, round(avg(value) FILTER (WHERE day(ts) <= 6), 6) AS window_value FROM events GROUP BY 1",
    "selection_bias": """WITH c AS (SELECT o_custkey, bool_or(o_orderpriority = '1-URGENT') AS f, avg(o_totalprice) AS m FROM orders GROUP BY 1), s AS (SELECT avg(m) FILTER (WHERE f) AS a, avg(m) FILTER (WHERE NOT f) AS b FROM c)
SELECT round(a, 5) AS labelled, round(b, 5) AS unlabelled, round(a / b, 5) AS ratio FROM s""",
    "return_classes": """WITH c AS (SELECT count(*) FILTER (WHERE r_1d < -0.02) AS negative, count(*) FILTER (WHERE r_1d BETWEEN -0.02 AND 0.02) AS neutral, count(*) FILTER (WHERE r_1d > 0.02) AS positive FROM filing_returns)
SELECT *, CASE WHEN least(negative, neutral, positive) < 5 THEN 'a class has fewer than 5 rows' END AS skip_reason FROM c""",
    "moved_anchors": """WITH d AS (SELECT DISTINCT c_nationkey, CAST(o_orderdate AS DATE) AS day FROM orders JOIN customer ON o_custkey = c_custkey), o AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY c_nationkey) AS n FROM d)
SELECT c_nationkey, year(day) AS year, min(i) + 2 AS anchor FROM o GROUP BY c_nationkey, year(day), n HAVING min(i) + 62 < n""",
    "short_names": "WITH RECURSIVE r AS (SELECT report_name, trim(company_name) AS name, 1 AS i FROM report_notes UNION ALL SELECT report_name, CASE WHEN ends_with(name, e[i]) THEN left(name, length(name) - length(e[i])) ELSE name END, i + 1 FROM r, (SELECT ["
    + ", ".join(f"'{e}'" for e in T.NAME_ENDINGS)
    + f"] AS e) WHERE i <= {len(T.NAME_ENDINGS)}) SELECT report_name, trim(name) AS name FROM r WHERE i = {len(T.NAME_ENDINGS) + 1}",
    "page_prompts": rf"""WITH p AS (SELECT doc_id, list_filter(list_transform({_SPLIT}, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS p FROM documents WHERE text IS NOT NULL),
t AS (SELECT doc_id, array_to_string(list_transform(p, lambda x, i: '[Page ' || i || ']' || chr(10) || x), chr(10) || chr(10)) AS t FROM p) SELECT doc_id, length(t) AS chars, sha256(t) AS sha FROM t""",
}
