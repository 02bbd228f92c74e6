"""Queries over the text of pages and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import text as T
from ..session import table


def page_split(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", "text")
    return T.split_pages(docs, "text").select("doc_id", F.col("raw_page").cast("bigint"), F.col("dense_page").cast("bigint"), F.sha2("page_text", 256).alias("sha"))


def report_names(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "report_notes").select("report_name", T.report_name(F.col("report_name")).alias("p"))
    return r.select("report_name", "p.exchange", "p.ticker", F.col("p.year").cast("bigint").alias("year"), "p.hash")


def page_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "report_pages").where("text IS NOT NULL").select("docid", F.sha2("text", 256).alias("sha"), F.sha2("text", 256).substr(1, 12).alias("short"))


def note_units(spark: SparkSession, sf: str) -> DataFrame:
    """Unit multiplier that each report's note states."""
    hints = T.unit_hints(F.coalesce("units_note", F.lit("")))
    u = T.resolve_unit([("document", hints)])
    return table(spark, sf, "report_notes").select("report_name", u.alias("u")).select("report_name", "u.unit_source", "u.multiplier", "u.unit_conflict")


def page_reasons(spark: SparkSession, sf: str) -> DataFrame:
    reasons = T.page_reasons(F.col("text"), ["financial review", "segment information", "accounting policies"], ["net debt", "gross profit", "working capital"])
    return table(spark, sf, "report_pages").where("text IS NOT NULL").select("docid", F.concat_ws(",", reasons).alias("reasons"))


def marker_classifier(spark: SparkSession, sf: str) -> DataFrame:
    f = T.marker_flags(F.col("text"), {"covenant": r"(?i)covenant", "indenture": r"(?i)indenture", "dividend": r"(?i)dividend"})
    d = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", f.alias("f"))
    return d.select("doc_id", F.concat_ws(",", "f.markers").alias("markers"), F.col("f.first_page").cast("bigint").alias("first_page"))


def text_length_stats(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.regexp_replace(F.lower(F.trim("source")), "[ -]", "_").alias("source"), F.char_length("text").cast("bigint").alias("size"))
    out = T.length_stats(docs.where("size IS NOT NULL AND source IS NOT NULL"), ["source"], "size")
    return out.select("source", "n", *[F.round(F.col(c).cast("double"), 4).alias(c) for c in ("mean", "median", "sd", *[f"d{i}" for i in range(1, 10)])], "least", "most")


def prefix_pages(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "report_pages").where("text IS NOT NULL").groupBy("report", "page").agg(F.max(F.char_length("text")).cast("bigint").alias("size"))
    return T.budget_pages(pages, "report", "page", "size", 6000).groupBy("report").agg(F.count(F.lit(1)).alias("pages"), F.sum("size").alias("size"))


def event_props(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_type", T.tolerant_json(F.concat(F.lit("Answer: "), "props"), "k INT").alias("j"))
    return e.groupBy("event_type", F.col("j.k").cast("bigint").alias("k")).agg(F.count(F.lit(1)).alias("n"))


def question_ids(spark: SparkSession, sf: str) -> DataFrame:
    q = table(spark, sf, "eval_items").select("item_id", T.question_parts(F.col("query_id")).alias("p"), T.slug(F.col("query_text")).alias("slug"))
    return q.select("item_id", "p.ticker", F.col("p.kpi").alias("kpi"), F.col("p.year").cast("bigint").alias("year"), "slug")


def page_snippets(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "page_items").where("page_text IS NOT NULL").select("item_id", T.snippet(F.col("page_text"), 80).alias("snippet"))


def amount_labels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", T.short_amount(F.col("c_acctbal") * 1000).alias("label"))


def page_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers of every page: how many, those with a unit of their own, and their largest magnitude."""
    pages = table(spark, sf, "report_pages").where("text IS NOT NULL").select("docid", T.number_tokens(F.col("text")).alias("n"))
    with_unit = F.size(F.filter("n", lambda x: x["inline_multiplier"].isNotNull()))
    return pages.select("docid", F.size("n").cast("bigint").alias("numbers"), with_unit.cast("bigint").alias("with_unit"), F.array_max(F.transform("n", lambda x: F.abs(x["value"]))).alias("largest"))


def name_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Companies of the notes against the mapped companies of the same ticker, by name similarity."""
    a = table(spark, sf, "report_notes").select("report_name", "ticker", F.col("company_name").alias("name"))
    b = table(spark, sf, "lse_companies").select(F.regexp_replace("ticker", r"\.[A-Z]+$", "").alias("ticker"), F.col("company_name").alias("mapped"))
    return a.join(b, "ticker").withColumn("similarity", T.name_similarity("name", "mapped")).withColumn("verified", F.col("similarity") >= 0.6)


def currency_marks(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "candidates").where("snippet IS NOT NULL AND raw_number IS NOT NULL AND raw_number <> ''")
    mark = T.currency_context(F.col("snippet"), F.instr(F.col("snippet"), F.col("raw_number")) - 1)
    return c.groupBy(mark.alias("currency")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (page_split, report_names, page_hashes, note_units, page_reasons, marker_classifier, text_length_stats, prefix_pages, event_props, question_ids, page_snippets, amount_labels, page_numbers, name_matches, currency_marks)
}
_DECILE = ", ".join(
    f"round(CASE WHEN n < 2 THEN v[1] ELSE (v[greatest(1, least({i} * (n + 1) // 10, n - 1))] * (10 - ({i} * (n + 1) - greatest(1, least({i} * (n + 1) // 10, n - 1)) * 10)) "
    f"+ v[greatest(1, least({i} * (n + 1) // 10, n - 1)) + 1] * ({i} * (n + 1) - greatest(1, least({i} * (n + 1) // 10, n - 1)) * 10)) / 10.0 END, 4) AS d{i}"
    for i in range(1, 10)
)
_SPLIT = r"string_split_regex(text, '(?i)<---\s*page split\s*--->')"
ORACLES = {
    "amount_labels": """WITH a AS (SELECT c_custkey, c_acctbal * 1000 AS v FROM customer), b AS (SELECT *, abs(v) AS a FROM a)
SELECT c_custkey, CASE WHEN v < 0 THEN '-$' ELSE '$' END || CASE WHEN a >= 1e9 THEN printf('%.1fB', round(a / 1e9, 1)) WHEN a >= 1e6 THEN printf('%.1fM', round(a / 1e6, 1)) WHEN a >= 1e3 THEN printf('%.1fK', round(a / 1e3, 1)) ELSE printf('%.2f', a) END AS label FROM b""",
    "currency_marks": r"""WITH c AS (SELECT snippet, strpos(snippet, raw_number) - 1 AS i FROM candidates WHERE raw_number <> '' AND snippet IS NOT NULL), s AS (SELECT substr(snippet, greatest(i - 31, 1), 64) AS s FROM c)
SELECT CASE WHEN regexp_matches(s, '[£€¥₹]|\b(GBP|EUR|CHF|JPY|INR|CAD|AUD)\b') THEN 'non_usd' WHEN regexp_matches(s, '\$|\bUSD\b') THEN 'usd' ELSE 'unknown' END AS currency, count(*) AS n FROM s GROUP BY 1""",
    "page_split": rf"""WITH s AS (SELECT doc_id, unnest({_SPLIT}) AS t, generate_subscripts({_SPLIT}, 1) - 1 AS raw_page FROM documents WHERE text IS NOT NULL)
SELECT doc_id, raw_page, row_number() OVER (PARTITION BY doc_id ORDER BY raw_page) - 1 AS dense_page, sha256(t) AS sha FROM s WHERE trim(regexp_replace(t, '\s+', ' ', 'g')) <> ''""",
    "report_names": r"""SELECT report_name, regexp_extract(report_name, '^([A-Za-z]+)_(.+)_([0-9]{4})(?:_([0-9a-fA-F]+))?$', 1) AS exchange, regexp_extract(report_name, '^([A-Za-z]+)_(.+)_([0-9]{4})(?:_([0-9a-fA-F]+))?$', 2) AS ticker,
CAST(regexp_extract(report_name, '^([A-Za-z]+)_(.+)_([0-9]{4})(?:_([0-9a-fA-F]+))?$', 3) AS BIGINT) AS year, nullif(regexp_extract(report_name, '^([A-Za-z]+)_(.+)_([0-9]{4})(?:_([0-9a-fA-F]+))?$', 4), '') AS hash FROM report_notes""",
    "page_hashes": "SELECT docid, sha256(text) AS sha, substr(sha256(text), 1, 12) AS short FROM report_pages WHERE text IS NOT NULL",
    "note_units": r"""WITH h AS (SELECT report_name, coalesce(units_note, '') AS t FROM report_notes),
w AS (SELECT report_name, list_concat(list_concat(regexp_extract_all(t, '(?i)\([^)]*?\b(?:\$|usd|us\$|u\.s\.\$)?\s*(?:in\s+)?(thousands?|millions?|billions?)\b[^)]*\)', 1), regexp_extract_all(t, '(?i)\bdollars?\s+in\s+(thousands?|millions?|billions?)\b', 1)),
  list_concat(regexp_extract_all(t, '(?i)\ball\s+dollar\s+amounts?\s+(?:are\s+)?(?:stated|presented|shown)\s+in\s+(thousands?|millions?|billions?)\b', 1), regexp_extract_all(t, '(?i)\bin\s+(thousands?|millions?|billions?)\b', 1))) AS h FROM h),
f AS (SELECT report_name, list_transform(h, lambda x: CASE lower(x)[1] WHEN 't' THEN 1e3 WHEN 'm' THEN 1e6 ELSE 1e9 END) AS f FROM w)
SELECT report_name, CASE WHEN len(f) > 0 THEN 'document' ELSE 'default' END AS unit_source, CAST(CASE WHEN len(f) > 0 THEN list_min(f) ELSE 1 END AS DOUBLE) AS multiplier, len(f) > 0 AND len(list_distinct(f)) > 1 AS unit_conflict FROM f""",
    "page_reasons": r"""WITH l AS (SELECT docid, lower(text) AS t, list_filter(list_transform(string_split_regex(text, '\r?\n'), lambda x: trim(x)), lambda x: x <> '') AS l FROM report_pages WHERE text IS NOT NULL)
SELECT docid, concat_ws(',', CASE WHEN len(list_filter(l, lambda x: len(regexp_extract_all(x, '\|')) >= 2)) >= 2 OR len(list_filter(l, lambda x: regexp_matches(x, '^\|?\s*:?-{3,}:?\s*(\|\s*:?-{3,}:?\s*)+\|?$'))) > 0 THEN 'markdown-table' END,
  CASE WHEN contains(t, '<table') OR contains(t, '</td>') OR contains(t, '</tr>') THEN 'html-table' END,
  CASE WHEN len(list_filter(l, lambda x: len(regexp_extract_all(x, '[0-9][0-9,.]*')) >= 3)) >= 3 THEN 'dense-numeric-rows' END,
  CASE WHEN contains(t, 'financial review') OR contains(t, 'segment information') OR contains(t, 'accounting policies') THEN 'financial-heading' END,
  CASE WHEN contains(t, 'net debt')::INT + contains(t, 'gross profit')::INT + contains(t, 'working capital')::INT >= 2 THEN 'kpi-aliases' END) AS reasons FROM l""",
    "marker_classifier": rf"""WITH p AS (SELECT doc_id, list_slice({_SPLIT}, 1, 4) AS p FROM documents WHERE text IS NOT NULL)
SELECT doc_id, concat_ws(',', CASE WHEN len(list_filter(p, lambda x: regexp_matches(x, '(?i)covenant'))) > 0 THEN 'covenant' END, CASE WHEN len(list_filter(p, lambda x: regexp_matches(x, '(?i)indenture'))) > 0 THEN 'indenture' END,
  CASE WHEN len(list_filter(p, lambda x: regexp_matches(x, '(?i)dividend'))) > 0 THEN 'dividend' END) AS markers,
  CAST(nullif(coalesce(list_position(list_transform(p, lambda x: regexp_matches(x, '(?i)covenant|(?i)indenture|(?i)dividend')), true), 0), 0) - 1 AS BIGINT) AS first_page FROM p""",
    "text_length_stats": f"""WITH d AS (SELECT regexp_replace(lower(trim(source)), '[ -]', '_', 'g') AS source, length(text) AS size FROM documents WHERE text IS NOT NULL AND source IS NOT NULL),
g AS (SELECT source, count(*) AS n, avg(size) AS mean, median(size) AS median, stddev_samp(size) AS sd, min(size) AS least, max(size) AS most, list_sort(list(size)) AS v FROM d GROUP BY 1)
SELECT source, n, round(mean, 4) AS mean, round(median, 4) AS median, round(sd, 4) AS sd, {_DECILE}, least, most FROM g""",
    "prefix_pages": """WITH p AS (SELECT report, page, max(length(text)) AS size FROM report_pages WHERE text IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, sum(size) OVER (PARTITION BY report ORDER BY page) AS s FROM p) SELECT report, count(*) AS pages, CAST(sum(size) AS BIGINT) AS size FROM r WHERE s <= 6000 OR s = size GROUP BY 1""",
    "event_props": "SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2",
    "question_ids": r"""SELECT item_id, regexp_extract(query_id, '^([^_]+)_(.+)_([0-9]{4})$', 1) AS ticker, regexp_extract(query_id, '^([^_]+)_(.+)_([0-9]{4})$', 2) AS kpi, CAST(regexp_extract(query_id, '^([^_]+)_(.+)_([0-9]{4})$', 3) AS BIGINT) AS year,
regexp_replace(regexp_replace(lower(query_text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM eval_items""",
    "page_snippets": r"""WITH s AS (SELECT item_id, trim(regexp_replace(page_text, '\s+', ' ', 'g')) AS t FROM page_items WHERE page_text IS NOT NULL) SELECT item_id, CASE WHEN length(t) > 80 THEN rtrim(substr(t, 1, 77)) || '...' ELSE t END AS snippet FROM s""",
}
