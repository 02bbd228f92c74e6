"""Readers of report folders, truth files, rankings, filings, statements and sessions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.text import report_name

ENTRY = "struct<start: string, end: string, val: double, form: string, fp: string, filed: string, fy: int>"
COMPANY_FACTS = f"cik bigint, entityName string, facts map<string, map<string, struct<label: string, units: map<string, array<{ENTRY}>>>>>"
FILINGS = "accessionNumber array<string>, form array<string>, acceptanceDateTime array<string>, filingDate array<string>, reportDate array<string>, primaryDocument array<string>"


def whole_files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """Files below a folder as ``path, text``, one row each, read in parallel."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(root, wholetext=True)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def report_texts(spark: SparkSession, root: str) -> DataFrame:
    """One text per report folder: the file named as the folder, else the first plain one, else the first detection file."""
    files = whole_files(spark, root, "*.mmd")
    parts = F.split("path", "/")
    named = files.select("path", "text", F.element_at(parts, -2).alias("report"), F.regexp_replace(F.element_at(parts, -1), r"\.mmd$", "").alias("stem"))
    tier = F.when(F.col("stem") == F.col("report"), 0).when(~F.col("stem").endswith("_det"), 1).otherwise(2)
    best = named.groupBy("report").agg(F.min(F.struct(tier.alias("tier"), "path")).alias("b")).select("report", F.col("b.path").alias("path"))
    return named.select("path", "text").join(best, "path").withColumn("p", report_name(F.col("report"))).select("report", "p.exchange", "p.ticker", "p.year", "path", "text")


def inventory(names: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Years per (exchange, ticker) of report names, and the names that can't be parsed."""
    parsed = names.withColumn("p", report_name(F.col(column)))
    years = parsed.where("p IS NOT NULL").groupBy("p.exchange", "p.ticker").agg(F.sort_array(F.collect_set("p.year")).alias("years"))
    return years, parsed.where("p IS NULL").select(column)


def truth_csv(spark: SparkSession, path: str, keep: str = "last") -> DataFrame:
    """Truth rows keyed by (ticker, year, kpi); of repeated keys the last or first line of the file counts."""
    raw = spark.read.option("header", "true").csv(path)
    lines = raw.withColumn("__n", F.monotonically_increasing_id())
    rows = lines.select("ticker", F.col("year").try_cast("int").alias("year"), "kpi", F.nanvl(F.col("value").try_cast("double"), F.lit(None)).alias("value"), "__n")
    rows = rows.where("ticker IS NOT NULL AND year IS NOT NULL AND kpi IS NOT NULL AND value IS NOT NULL")
    n = F.col("__n") if keep == "last" else -F.col("__n")
    return rows.groupBy("ticker", "year", "kpi").agg(F.max(F.struct(n.alias("n"), "value"))["value"].alias("value"))


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of name -> list of strings as ``name, position, value``."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, array<string>>").alias("m"))
    return raw.select(F.explode("m").alias("name", "values")).select("name", F.posexplode("values").alias("position", "value"))


def nested_labels(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object industry -> ticker -> year -> label as rows, nulls dropped."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, map<string, map<string, string>>>").alias("m"))
    rows = raw.select(F.explode("m").alias("industry", "a")).select("industry", F.explode("a").alias("ticker", "b")).select("industry", "ticker", F.explode("b").alias("year", "label"))
    return rows.where("label IS NOT NULL").withColumn("year", F.col("year").try_cast("int"))


def json_lines(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """Records by key, the last line of each winning; lines that can't be read are skipped."""
    text = spark.read.text(path).withColumn("__n", F.monotonically_increasing_id())
    rows = text.select(F.from_json("value", schema).alias("r"), "__n").where(F.col(f"r.{key}").isNotNull())
    return rows.groupBy(F.col(f"r.{key}").alias(key)).agg(F.max(F.struct("__n", "r"))["r"].alias("r")).select("r.*")


def predictions(spark: SparkSession, root: str) -> DataFrame:
    """Cells of extraction files with status ok; of repeated cells the first file by name counts."""
    schema = "ticker string, year int, report_name string, model string, status string, extraction struct<reporting_currency: string, units_note: string, kpis: array<struct<kpi: string, fiscal_year: int, value: double>>>"
    raw = spark.read.schema(schema).option("multiLine", "true").option("pathGlobFilter", "*.json").json(root).withColumn("path", F.col("_metadata.file_path"))
    cells = raw.where("status = 'ok'").select("path", "ticker", "model", F.posexplode("extraction.kpis").alias("at", "k"))
    first = cells.groupBy("model", "ticker", F.col("k.fiscal_year").alias("year"), F.col("k.kpi").alias("kpi")).agg(F.min(F.struct("path", "at", F.col("k.value").alias("value")))["value"].alias("value"))
    return first.where("value IS NOT NULL")


def qrels(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Judgements of a four-column file split by any white space, and the lines that aren't any."""
    parts = spark.read.text(path).where("trim(value) <> ''").withColumn("p", F.split(F.trim("value"), r"\s+"))
    grade = F.get("p", F.lit(3)).try_cast("int")
    good = (F.size("p") == 4) & grade.isNotNull()
    return parts.where(good).select(F.col("p")[0].alias("query_id"), F.col("p")[2].alias("doc_id"), grade.alias("relevance")), parts.where(~good).select("value")


def topics(spark: SparkSession, path: str) -> DataFrame:
    """Questions of ``id<TAB>text`` lines; bare lines are numbered.  Repeated or empty ones raise on use."""
    raw = spark.read.text(path).withColumn("__n", F.row_number().over(Window.orderBy(F.monotonically_increasing_id())))  # a small file
    tab = F.instr("value", "\t") > 0
    rows = raw.select(F.when(tab, F.substring_index("value", "\t", 1)).otherwise(F.concat(F.lit("q"), "__n")).alias("query_id"), F.when(tab, F.regexp_replace("value", r"^[^\t]*\t", "")).otherwise(F.col("value")).alias("query_text"))
    repeated = F.count(F.lit(1)).over(Window.partitionBy("query_id")) > 1
    bad = F.coalesce(repeated | (F.trim("query_text") == "") | (F.trim("query_id") == ""), F.lit(True))
    return rows.withColumn("__bad", bad).select(F.when(F.col("__bad"), F.raise_error(F.concat(F.lit("bad topic: "), "query_id"))).otherwise(F.col("query_id")).alias("query_id"), "query_text")


def company_facts(spark: SparkSession, path: str) -> DataFrame:
    """XBRL company facts as rows of (cik, taxonomy, tag, unit) and entry."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", COMPANY_FACTS).alias("r")).select("r.*")
    tags = raw.select("cik", "entityName", F.explode("facts").alias("taxonomy", "t")).select("cik", "entityName", "taxonomy", F.explode("t").alias("tag", "u"))
    units = tags.select("cik", "entityName", "taxonomy", "tag", F.explode("u.units").alias("unit", "e"))
    return units.select("cik", "entityName", "taxonomy", "tag", "unit", F.inline("e"))


def filings(spark: SparkSession, path: str) -> DataFrame:
    """Filings from parallel arrays, with recent and sharded blocks alike; short arrays are padded with nulls."""
    schema = f"cik string, filings struct<recent: struct<{FILINGS.replace(' array', ': array')}>>, {FILINGS}"
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("r"))
    names = [x.strip().split(" ")[0] for x in FILINGS.split(",")]
    block = lambda at: F.arrays_zip(*[F.coalesce(F.col(f"{at}.{n}"), F.array().cast("array<string>")).alias(n) for n in names])
    both = raw.select(F.col("r.cik").alias("cik"), F.concat(block("r.filings.recent"), block("r")).alias("z"))
    return both.select("cik", F.inline("z").alias(*names)).where("accessionNumber IS NOT NULL")


def original_filings(rows: DataFrame, forms: Sequence[str] = ("10-K", "20-F", "40-F")) -> DataFrame:
    """The earliest accepted filing per company and report date among the forms; amendments don't count."""
    kept = rows.where(F.col("form").isin(*forms) & F.col("reportDate").isNotNull())
    return kept.groupBy("cik", "reportDate").agg(F.min(F.struct("acceptanceDateTime", "accessionNumber", "form")).alias("b")).select("cik", "reportDate", "b.*")


def statement_payload(spark: SparkSession, path: str, tags: Sequence[str]) -> DataFrame:
    """Year rows of a statement payload ``annualReports``; "None" and "-" are null."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "symbol string, annualReports array<map<string, string>>").alias("r"))
    rows = raw.select(F.col("r.symbol").alias("ticker"), F.explode("r.annualReports").alias("m"))
    rows = rows.select("ticker", F.to_date(F.col("m")["fiscalDateEnding"]).alias("period_end"), F.explode(F.map_filter("m", lambda k, v: k.isin(*tags))).alias("tag", "raw"))
    return rows.withColumn("value", F.col("raw").try_cast("double")).drop("raw")


def unpivoted(frame: DataFrame, label: str, periods: Sequence[str]) -> DataFrame:
    """A label-by-period frame as ``label, period, value`` rows without nulls."""
    return frame.unpivot([label], list(periods), "period", "value").where("value IS NOT NULL")


def covers(prices: DataFrame, ticker: str, date: str, start: str, end: str, slack: int = 5) -> DataFrame:
    """Whether the stored prices of each ticker span the dates wanted, give or take some days."""
    span = prices.groupBy(ticker).agg(F.min(date).alias("first"), F.max(date).alias("last"))
    return span.withColumn("hit", (F.col("first") <= F.date_add(F.lit(start).cast("date"), slack)) & (F.col("last") >= F.date_sub(F.lit(end).cast("date"), slack)))


def letters(spark: SparkSession, root: str) -> DataFrame:
    """Letters named EXCHANGE_TICKER_YEAR__n_slug.md without their header, joined by (ticker, year) in name order."""
    files = whole_files(spark, root, "*.md").withColumn("stem", F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.md$", ""))
    parsed = files.withColumn("p", report_name(F.substring_index("stem", "__", 1))).where("p IS NOT NULL")
    body = F.trim(F.when(F.instr("text", "\n---\n") > 0, F.regexp_replace("text", r"(?s)^.*?\n---\n", "")).otherwise(F.col("text")))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("stem", body.alias("b")))), lambda x: x["b"])
    return parsed.groupBy("p.ticker", "p.year").agg(F.concat_ws("\n\n", texts).alias("text"))


def sessions(spark: SparkSession, root: str) -> DataFrame:
    """Current annotations of session folders: ``session, item_id, record``; of two sessions of a slot the later counts."""
    meta = whole_files(spark, root, "metadata.json").select(F.element_at(F.split("path", "/"), -2).alias("session"), F.from_json("text", "slot string, updated_at_utc string").alias("m"))
    best = meta.groupBy(F.coalesce("m.slot", "session").alias("slot")).agg(F.max(F.struct("m.updated_at_utc", "session"))["session"].alias("session"))
    current = whole_files(spark, root, "current_annotations.json").select(F.element_at(F.split("path", "/"), -2).alias("session"), F.explode(F.from_json("text", "map<string, map<string, string>>")).alias("item_id", "record"))
    return current.join(best, "session").select("slot", "session", "item_id", "record")


def tickers_of(names: DataFrame, column: str) -> DataFrame:
    """Distinct (exchange, ticker) of file names with at least three parts."""
    parts = F.split(F.col(column), "_")
    rows = names.where(F.size(parts) >= 3).select(parts[0].alias("exchange"), F.concat_ws("_", F.slice(parts, 2, F.size(parts) - 2)).alias("ticker"))
    return rows.distinct()


def exchange_of(ticker: Column) -> Column:
    """Exchange by a ticker's suffix."""
    suffix = F.regexp_extract(F.upper(ticker), r"\.([A-Z]+)$", 1)
    return F.when(suffix == "L", "LSE").when(suffix == "AX", "ASX").when(suffix == "TO", "TSX").when(suffix == "V", "TSXV").otherwise("US")


def selected_companies(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object industry -> exchange -> companies as rows."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, map<string, array<struct<ticker: string, name: string>>>>").alias("m"))
    return raw.select(F.explode("m").alias("industry", "e")).select("industry", F.explode("e").alias("exchange", "c")).select("industry", "exchange", F.inline("c"))


def earnings_calendar(spark: SparkSession, path: str) -> DataFrame:
    """Earnings days from CSV: ``ticker, date, estimate, actual, surprise``; rows without a day are left out, of repeated days the first in order of figures counts."""
    raw = spark.read.option("header", "true").csv(path)
    rows = raw.select("ticker", F.to_date(F.col("date")).alias("date"), *[F.col(c).try_cast("double").alias(c) for c in ("estimate", "actual", "surprise")]).where("date IS NOT NULL AND ticker IS NOT NULL")
    return rows.groupBy("ticker", "date").agg(F.min(F.struct("estimate", "actual", "surprise")).alias("r")).select("ticker", "date", "r.*")


def statement_facts(frame: DataFrame, entity: str, label: str, periods: Sequence[str], names: dict[str, str], cutoff_month: int = 1) -> DataFrame:
    """A label-by-period frame as ``entity, kpi, fiscal_year, value``: labels by a map to kpis, the first label in the map's order with a value wins."""
    from ..operators.facts import fiscal_year

    order = {k: i for i, k in enumerate(names)}
    long = frame.unpivot([entity, label], list(periods), "period", "value").where("value IS NOT NULL")
    known = long.where(F.col(label).isin(*names))
    place = F.coalesce(*[F.when(F.col(label) == k, F.lit(i)) for k, i in order.items()])
    kpi = F.coalesce(*[F.when(F.col(label) == k, F.lit(v)) for k, v in names.items()])
    keyed = known.select(entity, kpi.alias("kpi"), fiscal_year(F.col("period").cast("date"), cutoff_month).alias("fiscal_year"), F.struct(place.alias("p"), F.col("period"), F.col("value")).alias("r"))
    return keyed.groupBy(entity, "kpi", "fiscal_year").agg(F.min("r")["value"].alias("value"))


def daily_prices(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Stored daily prices below a folder partitioned by ticker: ``ticker, date, close, volume``."""
    reader = spark.read.option("header", "true") if kind == "csv" else spark.read
    rows = reader.format(kind).load(path)
    return rows.select("ticker", F.col("date").cast("date").alias("date"), F.col("close").cast("double").alias("close"), F.col("volume").cast("double").alias("volume"))
