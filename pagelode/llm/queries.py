"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import clean_ticker, table
from .consensus import Consensus, consensus, counted_votes
from .leaks import leaked_passages
from .linkage import link, records
from .mixture import mix
from .nearest import nearest_in_time
from .pieces import coverage, number_pieces, split_texts
from .reading import held_out_error, reading_level
from .scans import scanned_noise

#: Folder of the public vocabularies; override with the environment's own.
TOKENIZERS = os.environ.get("PAGELODE_TOKENIZERS", "/opt/tokenizers")
HOUR_US = 3_600_000_000


def p1_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Filings with the nearest window and the distance to it."""
    ticker = clean_ticker(F.col("ticker"))
    pairs = nearest_in_time(
        table(spark, sf, "filing_returns"), table(spark, sf, "event_windows"), "filing_id", "window_id", "filing_date", "t1", ticker, ticker, 72 * HOUR_US
    )
    return pairs.select(F.col("left_id").alias("filing_id"), F.col("right_id").alias("window_id"), "offset_us")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return p1_pairs(spark, sf).select("filing_id", "window_id").distinct()


def _scans(spark: SparkSession, sf: str, whole: bool) -> DataFrame:
    pages = table(spark, sf, "report_pages").select(F.lit("page").alias("src"), F.col("docid").alias("item_key"), "report", "page", "text")
    items = table(spark, sf, "page_items")
    items = items.select(F.lit("item").alias("src"), F.col("item_id").alias("item_key"), F.col("report_name").alias("report"), F.col("page_number").alias("page"), F.col("page_text").alias("text"))
    return scanned_noise(pages.unionByName(items), whole)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return _scans(spark, sf, False).select("src", "item_key", F.inline("noise"))


def p2_text(spark: SparkSession, sf: str) -> DataFrame:
    """Pages in continuous paragraphs."""
    return _scans(spark, sf, True).select("src", "item_key", "repaired")


def p4_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Pieces of the long texts of pages and documents."""
    pages = table(spark, sf, "report_pages").select(F.lit("page").alias("src"), F.col("docid").alias("item_key"), F.col("text"))
    documents = table(spark, sf, "documents").select(F.lit("document").alias("src"), F.col("doc_id").cast("string").alias("item_key"), F.col("text"))
    return split_texts(pages.unionByName(documents), ["src", "item_key"], "text")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return p4_pieces(spark, sf).where("range_no = 0 AND range_piece = 0").select("src", "item_key").distinct()


def p4_numbered(spark: SparkSession, sf: str) -> DataFrame:
    """Pieces with their number in the text."""
    return number_pieces(p4_pieces(spark, sf), ["src", "item_key"]).select("src", "item_key", "piece_no", "start", "end", "piece")


def p4_cover(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the pieces of each long text cover it within the limits."""
    return coverage(p4_pieces(spark, sf), ["src", "item_key"])


def _consensus(spark: SparkSession, sf: str) -> Consensus:
    labels = ["ok", "not_ok", "uncertain"]
    return consensus(counted_votes(table(spark, sf, "annotations"), "annotator", "item_id", "overall_status", "updated_at_utc", labels), labels)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return _consensus(spark, sf).annotators.where("low <= 0").select("annotator")


def p6_items(spark: SparkSession, sf: str) -> DataFrame:
    """Consensus status per item."""
    return _consensus(spark, sf).items.withColumnRenamed("item", "item_id")


def p6_annotators(spark: SparkSession, sf: str) -> DataFrame:
    """Reliability of each annotator."""
    return _consensus(spark, sf).annotators


def p6_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """Krippendorff's alpha of the counted votes."""
    return _consensus(spark, sf).summary.withColumn("alpha", F.round("alpha", 6))


def p7_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Candidate pairs of companies and entities with their confidence."""
    companies = records(table(spark, sf, "lse_companies"), "company_id", "company_name", None, "hq_city", "industry", "founded_year", F.col("revenue_musd") * 1e6)
    entities = records(table(spark, sf, "fetched_entities"), "entity_id", "entity_name", "former_names", "business_city", "sic_description", "incorporated_year", F.col("revenue_usd"))
    return link(companies, entities).withColumnsRenamed({"ia": "company_id", "ib": "entity_id"})


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return p7_pairs(spark, sf).where("confidence >= 0.5").select("company_id", "entity_id")


def p8_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Documents near an item in latent space, with the evidence of a leak."""
    return leaked_passages(table(spark, sf, "documents"), table(spark, sf, "eval_items"), "doc_id", "text", "item_id", "passage")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return p8_candidates(spark, sf).where("verdict = 'copy'").select("doc_id", "item_id").distinct()


def _mix(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets"), "doc_id", "source", "text", f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


def p9_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return _mix(spark, sf)[0]


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    return _mix(spark, sf)[1]


def p10_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Reading level of every document."""
    return reading_level(table(spark, sf, "documents"), "doc_id", "text")


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return p10_levels(spark, sf).where("level < 5").select("doc_id").distinct()


def p10_error(spark: SparkSession, sf: str) -> DataFrame:
    """Error of the levels against the formula, on documents held apart from the fit."""
    return held_out_error(reading_level(table(spark, sf, "documents"), "doc_id", "text", folds=2))


_TICKER = r"nullif(regexp_replace(regexp_replace(upper({0}.ticker), '\s+', '', 'g'), '\.(L|AX|TO|V)$', ''), '')"
_P1 = f"""
WITH f AS (SELECT filing_id, filing_date AS t, {_TICKER.format("filing_returns")} AS k FROM filing_returns WHERE filing_date IS NOT NULL),
w AS (SELECT window_id, t1, {_TICKER.format("event_windows")} AS k FROM event_windows WHERE t1 IS NOT NULL),
p AS (
  SELECT filing_id, window_id, datediff('microsecond', t, t1) AS offset_us,
         row_number() OVER (PARTITION BY filing_id ORDER BY abs(datediff('microsecond', t, t1)), t1, window_id) AS n
  FROM f JOIN w ON f.k = w.k AND t1 BETWEEN t - INTERVAL 72 HOUR AND t + INTERVAL 72 HOUR
)
"""

QUERIES = {f.__name__: f for f in (p1_found, p1_pairs, p2_found, p2_text, p4_found, p4_pieces, p4_numbered, p4_cover, p6_found, p6_items, p6_annotators, p6_agreement, p7_found, p7_pairs, p8_found, p8_candidates, p9_mixture, p9_shares, p10_found, p10_levels, p10_error)}
ORACLES = {
    "p6_agreement": """
WITH v AS (
  SELECT annotator, item_id, max({'t': updated_at_utc, 's': regexp_replace(lower(trim(overall_status)), '[ _-]+', '_', 'g')}) AS x
  FROM annotations WHERE annotator IS NOT NULL AND item_id IS NOT NULL AND updated_at_utc IS NOT NULL GROUP BY 1, 2
), c AS (
  SELECT item_id, count(*) FILTER (x.s = 'ok') AS a, count(*) FILTER (x.s = 'not_ok') AS b, count(*) FILTER (x.s = 'uncertain') AS c
  FROM v GROUP BY 1 HAVING count(*) FILTER (x.s IN ('ok', 'not_ok', 'uncertain')) >= 2
), t AS (
  SELECT count(*) AS items, sum(a + b + c) AS n, sum(a) AS a, sum(b) AS b, sum(c) AS c,
         sum((a * (b + c) + b * (a + c) + c * (a + b)) / (a + b + c - 1)) AS o
  FROM c
)
SELECT items, CAST(n AS BIGINT) AS votes, round(1 - o / ((a * (n - a) + b * (n - b) + c * (n - c)) / (n - 1)), 6) AS alpha FROM t""",
    "p4_found": """
SELECT DISTINCT 'page' AS src, docid AS item_key FROM report_pages WHERE length(text) > 4000
UNION ALL SELECT DISTINCT 'document', CAST(doc_id AS VARCHAR) FROM documents WHERE length(text) > 4000""",
    "p4_cover": """
SELECT DISTINCT 'page' AS src, docid AS item_key, length(text) AS chars, length(text) AS covered, true AS within_limit, true AS within_overlap FROM report_pages WHERE length(text) > 4000
UNION ALL SELECT DISTINCT 'document', CAST(doc_id AS VARCHAR), length(text), length(text), true, true FROM documents WHERE length(text) > 4000""",
    "p1_found": _P1 + "SELECT filing_id, window_id FROM p WHERE n = 1",
    "p1_pairs": _P1 + "SELECT filing_id, window_id, offset_us FROM p WHERE n = 1",
}
