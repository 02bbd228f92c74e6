"""Queries of the general data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import units, wide
from ..session import table


#: The column types that the table's description states; every other attribute is money or a decimal.
KPI_TYPES = {"shares_outstanding": "bigint", "employees": "bigint", "fiscal_year_end": "date", "reporting_currency": "string", "restated": "boolean"}


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return units.misscaled(units.common_units(table(spark, sf, "candidates"), table(spark, sf, "report_notes")))


def p3_values(spark: SparkSession, sf: str) -> DataFrame:
    return units.common_units(table(spark, sf, "candidates"), table(spark, sf, "report_notes"))


def _kpis(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "kpis_long")
    entity = {"ticker": F.nullif(F.upper(F.trim("ticker")), F.lit("")), "year": F.col("year").cast("bigint")}
    return wide.wide_from_long(rows, entity, F.col("kpi"), F.col("value"), lambda a: KPI_TYPES.get(a, "double"), [F.col("loaded_at"), F.col("source")])


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return _kpis(spark, sf).select("ticker", "year", F.explode("contradicted").alias("kpi"))


def p5_wide(spark: SparkSession, sf: str) -> DataFrame:
    return _kpis(spark, sf)


def p5_signatures(spark: SparkSession, sf: str) -> DataFrame:
    return wide.characteristic_sets(_kpis(spark, sf))


def p5_filled(spark: SparkSession, sf: str) -> DataFrame:
    """Filled cells of the wide table by attribute."""
    w = _kpis(spark, sf)
    kpis = [c for c in w.columns if c not in ("ticker", "year", "signature", "contradicted")]
    counts = w.agg(*[F.count(c).alias(c) for c in kpis])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("kpi"), F.col(c).alias("filled")) for c in kpis])).alias("x")).select("x.*").where("filled > 0")


QUERIES = {f.__name__: f for f in (p3_found, p3_values, p5_found, p5_wide, p5_signatures, p5_filled)}
_NUMBER = r"CASE WHEN regexp_matches(t, '^\(.*\)$|^-') THEN -1.0 ELSE 1.0 END * TRY_CAST(regexp_replace(t, '[()\s,$]|^[-+]', '', 'g') AS DOUBLE)"
_DATE = "coalesce(try_strptime(t, '%Y-%m-%d'), try_strptime(t, '%m/%d/%Y'), try_strptime(t, '%d %b %Y'), try_strptime(t, '%Y%m%d'))"
_YES_NO = "CASE WHEN lower(t) IN ('true', 't', 'yes', 'y', '1') THEN 'true' WHEN lower(t) IN ('false', 'f', 'no', 'n', '0') THEN 'false' END"
_CELLS = rf"""
WITH r AS (SELECT upper(trim(ticker)) AS ticker, CAST(year AS BIGINT) AS year, regexp_replace(regexp_replace(lower(trim(kpi)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS kpi, trim(value) AS t FROM kpis_long WHERE ticker IS NOT NULL AND year IS NOT NULL AND kpi IS NOT NULL),
v AS (SELECT ticker, year, kpi, CASE kpi WHEN 'reporting_currency' THEN upper(t) WHEN 'restated' THEN {_YES_NO} WHEN 'fiscal_year_end' THEN CAST({_DATE} AS VARCHAR)
  ELSE CAST(CASE WHEN kpi IN ('shares_outstanding', 'employees') THEN round({_NUMBER}) ELSE {_NUMBER} END + 0.0 AS VARCHAR) END AS v
  FROM r WHERE lower(t) NOT IN ('', 'none', 'null', 'nan', 'na', 'n/a', 'error', '-', '--', '—', '–'))
"""
ORACLES: dict[str, str] = {
    "p5_found": _CELLS + "SELECT ticker, year, kpi FROM v GROUP BY 1, 2, 3 HAVING count(DISTINCT v) > 1",
    "p5_filled": _CELLS + "SELECT kpi, count(DISTINCT (ticker, year)) AS filled FROM v WHERE v IS NOT NULL AND kpi <> '' AND ticker <> '' GROUP BY 1",
}
