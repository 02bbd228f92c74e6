"""Text of reports: names, pages, numbers, units, markers and clean-up."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, IntegerType, StructType

PAGE_MARK = r"(?i)<---\s*page split\s*--->"


def report_name(name: Column, least_hash: int = 1) -> Column:
    """Struct of exchange, ticker, year and hash of EXCHANGE_TICKER_YEAR[_hash]; null when it has another form."""
    pattern = r"^([A-Za-z]+)_(.+)_([0-9]{4})(?:_([0-9a-fA-F]{" + str(least_hash) + r",}))?$"
    part = lambda i: F.nullif(F.regexp_extract(name, pattern, i), F.lit(""))
    return F.when(name.rlike(pattern), F.struct(part(1).alias("exchange"), part(2).alias("ticker"), part(3).cast("int").alias("year"), part(4).alias("hash")))


def split_pages(reports: DataFrame, text: str, mark: str = PAGE_MARK) -> DataFrame:
    """One row per page that isn't blank: ``raw_page`` counts blanks, ``dense_page`` doesn't.

    Both numbers come from the report's own array, so no window is needed.
    """
    pages = F.transform(F.split(F.col(text), mark), lambda p, i: F.struct(i.alias("raw_page"), p.alias("page_text")))
    kept = F.filter(pages, lambda p: F.trim(F.regexp_replace(p["page_text"], r"\s+", " ")) != "")
    others = [c for c in reports.columns if c != text]
    flat = reports.select(*others, F.posexplode(kept).alias("dense_page", "__p"))
    return flat.select(*others, F.col("__p.raw_page").alias("raw_page"), "dense_page", F.col("__p.page_text").alias("page_text"))


def plain_marks(text: Column) -> Column:
    """Curly quotes, long dashes and escaped parentheses in their plain forms."""
    return F.regexp_replace(F.translate(text, "‘’“”–—−‐‑", "''\"\"-----"), r"\\([()])", "$1")


def plain_line(line: Column) -> Column:
    """A line without a stray closing parenthesis before a digit, trimmed."""
    return F.trim(F.regexp_replace(line, r"(?<![0-9)])\)(?=\s*[0-9])", ""))


def snippet(text: Column, most: int = 220) -> Column:
    """Text with single blanks, cut to ``most`` characters with an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.rtrim(F.substring(flat, 1, most - 3)), F.lit("..."))).otherwise(flat)


#: Unit words of numbers and page notes with their multipliers.
UNIT_WORDS = (("thousand", 1e3), ("thousands", 1e3), ("k", 1e3), ("million", 1e6), ("millions", 1e6), ("mm", 1e6), ("m", 1e6), ("billion", 1e9), ("billions", 1e9), ("bn", 1e9), ("b", 1e9))

_GAP = r"[\s\u00a0]*"
_FIGURE = r"(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?"
_SUFFIX = r"(?:bn|billions?|mm|millions?|thousands?|k|m|b)"
_SIGNED = f"-?{_GAP}\\$?{_GAP}{_FIGURE}{_GAP}{_SUFFIX}?{_GAP}"
#: A number, in brackets or bare, that no letter, digit, slash, point or hyphen touches; a percent sign is taken along to tell percentages.
_NUMBER = f"(?i)(?<![A-Za-z0-9_/.\\-])(?:\\({_GAP}{_SIGNED}\\)|{_SIGNED})(?![A-Za-z0-9_/.\\-])%?"


def unit_multiplier(word: Column) -> Column:
    """Multiplier of a unit word, a final stop aside; null for any other word."""
    bare = F.rtrim(F.lower(word), F.lit("."))
    return F.coalesce(*[F.when(bare == w, F.lit(m)) for w, m in UNIT_WORDS], F.lit(None).cast("double"))


def number_tokens(line: Column) -> Column:
    """Numbers of a text as an array of ``raw, value, inline_multiplier``, in SQL only.

    Percentages, bare years from 1900 to 2100, both ends of ranges and digits
    within words take no part.  A number in brackets or with a minus is
    negative; a unit word behind it is its own multiplier, by which ``value``
    isn't multiplied.  Null texts give null.
    """

    def parsed(token: Column) -> Column:
        raw = F.btrim(token, F.lit(" \t\n\r\u00a0"))
        figure = F.regexp_extract(raw, _FIGURE, 0)
        suffix = F.regexp_extract(raw, f"(?i){_FIGURE}{_GAP}({_SUFFIX})", 1)
        value = F.replace(figure, F.lit(","), F.lit("")).try_cast("double")
        return F.struct(raw.alias("raw"), F.when(raw.rlike(r"^\(|^-"), -value).otherwise(value).alias("value"), unit_multiplier(suffix).alias("inline_multiplier"))

    counts = lambda t: ~F.endswith(t, F.lit("%")) & ~F.regexp_replace(t, r"[()$\-\s\u00a0]", "").rlike(r"^(19\d\d|20\d\d|2100)$")
    return F.transform(F.filter(F.regexp_extract_all(line, F.lit(_NUMBER), F.lit(0)), counts), parsed)


#: The ways in which a page or line states its unit.
UNIT_NOTES = (
    r"(?i)\([^)]*?\b(?:\$|usd|us\$|u\.s\.\$)?\s*(?:in\s+)?(thousands?|millions?|billions?)\b[^)]*\)",
    r"(?i)\bdollars?\s+in\s+(thousands?|millions?|billions?)\b",
    r"(?i)\ball\s+dollar\s+amounts?\s+(?:are\s+)?(?:stated|presented|shown)\s+in\s+(thousands?|millions?|billions?)\b",
    r"(?i)\bin\s+(thousands?|millions?|billions?)\b",
)


def unit_hints(text: Column) -> Column:
    """All unit multipliers that a text states as its unit; a unit word in running text is none."""
    words = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in UNIT_NOTES]))
    return F.coalesce(F.transform(words, unit_multiplier), F.array().cast("array<double>"))


def line_context(lines: DataFrame, page: Sequence[str], line: str, text: str, reach: int = 1) -> DataFrame:
    """Adds ``context``: each line with the lines up to ``reach`` before and after it, joined by blanks."""
    w = Window.partitionBy(*page).orderBy(line)
    around = [F.lag(text, k).over(w) for k in range(reach, 0, -1)] + [F.col(text)] + [F.lead(text, k).over(w) for k in range(1, reach + 1)]
    return lines.withColumn("context", F.concat_ws(" ", *around))


def resolve_unit(levels: Sequence[tuple[str, Column]], default: float = 1.0) -> Column:
    """The nearest level that states a unit, with the smallest of its hints, and whether they conflict."""
    source, value, conflict = F.lit("default"), F.lit(default), F.lit(False)
    for name, hints in reversed(levels):
        has = F.size(hints) > 0
        source = F.when(has, F.lit(name)).otherwise(source)
        value = F.when(has, F.array_min(hints)).otherwise(value)
        conflict = F.when(has, F.size(F.array_distinct(hints)) > 1).otherwise(conflict)
    return F.struct(source.alias("unit_source"), value.alias("multiplier"), conflict.alias("unit_conflict"))


def currency_context(text: Column, at: Column, width: int = 32) -> Column:
    """non_usd before usd before unknown, by the marks around a place (0-based)."""
    around = F.substring(text, F.greatest(at - width + 1, F.lit(1)).cast("int"), F.lit(2 * width))
    return F.when(around.rlike(r"[£€¥₹]|\b(GBP|EUR|CHF|JPY|INR|CAD|AUD)\b"), "non_usd").when(around.rlike(r"\$|\bUSD\b"), "usd").otherwise("unknown")


def alias_pattern(alias: str) -> str:
    """Pattern of an alias: any blanks, optional hyphens, no letter or digit at its edges, any case."""
    body = re.escape(alias.strip()).replace(r"\ ", r"\s+").replace(r"\-", r"[-\s]?")
    return r"(?i)(?<![A-Za-z0-9])" + body + r"(?![A-Za-z0-9])"


def first_alias(text: Column, aliases: Sequence[str]) -> Column:
    """The first alias, in list order, that a text holds."""
    return F.coalesce(*[F.when(text.rlike(alias_pattern(a)), F.lit(a)) for a in aliases])


def value_variants(value: Column) -> Column:
    """Ways to print a value: grouped, with a dollar, in thousands, millions and billions."""
    group = lambda v, d: F.format_number(v, d)
    out = [group(value, 0), F.concat(F.lit("$"), group(value, 0))]
    for factor, word in ((1e3, "thousand"), (1e6, "million"), (1e9, "billion")):
        out += [group(value / factor, 0), group(value / factor, 1), F.concat(F.lit("$"), group(value / factor, 1), F.lit(f" {word}"))]
    return F.array_distinct(F.array(*out))


def marker_flags(text: Column, markers: dict[str, str], first_pages: int = 4, mark: str = PAGE_MARK) -> Column:
    """Struct of the markers found in the first pages and the first page that has one."""
    pages = F.slice(F.split(text, mark), 1, first_pages)
    flags = []
    for name, pattern in markers.items():
        flags.append(F.when(F.exists(pages, _has(pattern)), F.lit(name)))
    found = F.array_compact(F.array(*flags))
    hits = F.transform(pages, _has("|".join(markers.values())))
    first = F.nullif(F.array_position(hits, F.lit(True)), F.lit(0)) - 1
    return F.struct(found.alias("markers"), first.alias("first_page"))


def _has(pattern: str):
    return lambda p: p.rlike(pattern)


def page_reasons(text: Column, headings: Sequence[str], aliases: Sequence[str], dense_rows: int = 3) -> Column:
    """Why a page may hold figures, in fixed order: a markdown or HTML table, rows of three or more numbers, a financial heading, two or more aliases.

    Headings and aliases count anywhere in the text, in any case.
    """
    low = F.lower(text)
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.btrim(x)), lambda x: x != "")
    rule = F.exists(lines, _has(r"^\|?\s*:?-{3,}:?\s*(\|\s*:?-{3,}:?\s*)+\|?$"))
    piped = F.size(F.filter(lines, lambda x: F.regexp_count(x, F.lit(r"\|")) >= 2)) >= 2
    dense = F.size(F.filter(lines, lambda x: F.regexp_count(x, F.lit(r"[0-9][0-9,.]*")) >= 3)) >= dense_rows
    tagged = low.contains("<table") | low.contains("</td>") | low.contains("</tr>")
    headed = F.exists(F.array(*[F.lit(h.lower()) for h in headings]), lambda h: F.contains(low, h))
    named = F.size(F.filter(F.array(*[F.lit(a.lower()) for a in dict.fromkeys(aliases)]), lambda a: F.contains(low, a))) >= 2
    checks = [("markdown-table", rule | piped), ("html-table", tagged), ("dense-numeric-rows", dense), ("financial-heading", headed), ("kpi-aliases", named)]
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks]))


def budget_pages(pages: DataFrame, report: str, page: str, size: str, budget: int) -> DataFrame:
    """The leading pages of each report that fit a budget; the first page always stays."""
    run = Window.partitionBy(report).orderBy(page).rowsBetween(Window.unboundedPreceding, 0)
    return pages.withColumn("__run", F.sum(size).over(run)).where((F.col("__run") <= budget) | (F.col("__run") == F.col(size))).drop("__run")


def tolerant_json(text: Column, schema: str) -> Column:
    """A JSON object read through code fences or surrounding prose; null when there is none."""
    bare = F.regexp_replace(F.trim(text), r"^```[A-Za-z]*\s*|\s*```$", "")
    return F.coalesce(F.when(bare.rlike(r"(?s)^\{.*\}$"), F.from_json(bare, schema)), F.from_json(F.regexp_extract(text, r"(?s)\{.*\}", 0), schema))


def strip_html(text: Column) -> Column:
    """Text without tags, with the common entities decoded."""
    out = F.regexp_replace(text, r"(?is)<(script|style)[^>]*>.*?</\1>|<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def table_size(html: Column) -> Column:
    """Rows and most columns of an HTML table."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    cells = F.array_max(F.transform(rows, lambda r: F.regexp_count(r, F.lit(r"(?i)<t[dh][\s>]"))))
    return F.struct(F.size(rows).alias("rows"), F.coalesce(cells, F.lit(0)).alias("columns"))


def slug(text: Column, glue: str = "-") -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", glue), f"^{glue}+|{glue}+$", "")


def question_parts(qid: Column) -> Column:
    """Ticker, kpi and year of TICKER_kpi_YEAR."""
    pattern = r"^([^_]+)_(.+)_([0-9]{4})$"
    return F.when(qid.rlike(pattern), F.struct(F.regexp_extract(qid, pattern, 1).alias("ticker"), F.regexp_extract(qid, pattern, 2).alias("kpi"), F.regexp_extract(qid, pattern, 3).cast("int").alias("year")))


def fill_template(template: Column, name: Column, year: Column, safe: bool = True) -> Column:
    """ABC becomes the name and X the year; unsafe replaces X inside the name too."""
    if safe:
        return F.replace(F.regexp_replace(template, r"\bX\b", year.cast("string")), F.lit("ABC"), name)
    return F.replace(F.replace(template, F.lit("ABC"), name), F.lit("X"), year.cast("string"))


def choose_template(question: Column, templates: Sequence[str], seed: int = 42) -> Column:
    """One of the templates by a seeded hash of the question: the same for the same seed, each equally often."""
    return F.get(F.array(*[F.lit(t) for t in templates]), F.pmod(F.xxhash64(F.lit(seed), question), F.lit(len(templates))).cast("int"))


def short_amount(value: Column) -> Column:
    """$1.2B, $3.4M, $5.6K or $7.00, halves rounded up."""
    a = F.abs(value)
    body = F.when(a >= 1e9, F.format_string("%.1fB", a / 1e9)).when(a >= 1e6, F.format_string("%.1fM", a / 1e6)).when(a >= 1e3, F.format_string("%.1fK", a / 1e3)).otherwise(F.format_string("%.2f", a))
    return F.concat(F.when(value < 0, "-$").otherwise("$"), body)


def detection_blocks(reports: DataFrame, key: str, text: str) -> DataFrame:
    """Blocks of detection files: kind, boxes and payload of each ``<|ref|>kind<|/ref|><|det|>boxes<|/det|>payload``."""
    parts = F.slice(F.split(F.col(text), r"<\|ref\|>"), 2, 1_000_000)
    flat = reports.select(key, F.posexplode(parts).alias("block", "__b"))
    box = F.regexp_extract("__b", r"(?s)<\|det\|>(.*?)<\|/det\|>", 1)
    return flat.select(
        key, "block", F.regexp_extract("__b", r"(?s)^(.*?)<\|/ref\|>", 1).alias("kind"), F.from_json(box, "array<array<int>>").alias("boxes"), F.regexp_extract("__b", r"(?s)<\|/det\|>\s*(.*?)\s*$", 1).alias("payload")
    )


def union_box(boxes: Column) -> Column:
    """Smallest box around all boxes."""
    at = lambda i: F.transform(boxes, lambda b: b[i])
    return F.when(F.size(boxes) > 0, F.array(F.array_min(at(0)), F.array_min(at(1)), F.array_max(at(2)), F.array_max(at(3))))


_FORMS = {"plc", "inc", "ltd", "limited", "corp", "corporation", "co", "company", "group", "holdings", "the", "international", "llc"}


def name_similarity_of(a: str, b: str) -> float:
    """Similarity of company names: sequence ratio as written and with sorted words; 1 when one holds the other."""
    wa, wb = ([w for w in re.findall(r"[a-z0-9]+", x.lower()) if w not in _FORMS] for x in (a, b))
    if not wa or not wb:
        return 0.0
    if " ".join(wa) in " ".join(wb) or " ".join(wb) in " ".join(wa):
        return 1.0
    ratio = lambda x, y: difflib.SequenceMatcher(None, " ".join(x), " ".join(y)).ratio()
    return max(ratio(wa, wb), ratio(sorted(wa), sorted(wb)))


@pandas_udf(DoubleType())
def name_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([name_similarity_of(x, y) if isinstance(x, str) and isinstance(y, str) else None for x, y in zip(a, b)], dtype="float64")


@pandas_udf(StructType().add("start", IntegerType()).add("end", IntegerType()))
def locate_loosely(text: pd.Series, quote: pd.Series) -> pd.DataFrame:
    """Where a quote stands in a text when any white space counts alike; -1 when it doesn't."""
    out = []
    for t, q in zip(text, quote):
        words = q.split() if isinstance(q, str) else []
        m = re.search(r"\s+".join(map(re.escape, words)), t) if words and isinstance(t, str) else None
        out.append((m.start(), m.end()) if m else (-1, -1))
    return pd.DataFrame(out, columns=["start", "end"])


def dollar_marks(text: Column) -> Column:
    """Escaped parentheses that stand for a dollar sign before an amount, repaired."""
    return F.regexp_replace(text, r"\\[()](?=\s*[0-9][0-9,.]*)", r"\$")


def heading_sections(pages: DataFrame, report: str, page: str, text: str, phrases: Sequence[str], span: int = 4) -> DataFrame:
    """Sections that begin under one of the phrases as a heading: start page and heading, without the texts.

    The longest phrase wins, lines of a table of contents are rejected, and a
    heading within the span of an accepted one of the same report is dropped.
    """
    ordered = sorted(phrases, key=len, reverse=True)
    pattern = r"(?im)^[ \t#*_]*(" + "|".join(map(re.escape, ordered)) + r")[ \t*_:]*$"
    hits = pages.where(F.col(text).rlike(pattern)).select(report, page, F.lower(F.regexp_extract(text, pattern, 1)).alias("heading"))
    listed = hits.groupBy(report).agg(F.sort_array(F.collect_list(F.struct(page, "heading"))).alias("h"))
    keep = F.aggregate(
        "h", F.filter("h", lambda x: F.lit(False)), lambda acc, x: F.when((F.size(acc) == 0) | (x[page] >= F.element_at(acc, -1)[page] + span), F.concat(acc, F.array(x))).otherwise(acc)
    )
    return listed.select(report, F.inline(keep))


def exclusive_deciles(values: Sequence[float]) -> list[float]:
    """Deciles at positions p(n+1), as for a sample from a larger population."""
    v, n = sorted(values), len(values)
    if n < 2:
        return [float(v[0])] * 9 if v else []
    out = []
    for i in range(1, 10):
        j = min(max(i * (n + 1) // 10, 1), n - 1)
        delta = i * (n + 1) - j * 10
        out.append((v[j - 1] * (10 - delta) + v[j] * delta) / 10)
    return out


def length_stats(df: DataFrame, by: Sequence[str], size: str) -> DataFrame:
    """Count, mean, median, sample deviation, least, most and exclusive deciles of a size per group.

    The deciles come from exact order statistics: ranks are read off the
    counts of each size, so a hot group is combined before the shuffle.
    """
    counts = df.where(F.col(size).isNotNull()).groupBy(*by, size).agg(F.count(F.lit(1)).alias("__c"))
    run = Window.partitionBy(*by).orderBy(size).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("__hi", F.sum("__c").over(run)).withColumn("__lo", F.col("__hi") - F.col("__c"))
    n = counts.groupBy(*by).agg(F.sum("__c").alias("n"))
    at = ranked.join(n, list(by)).withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(9))))
    j = F.greatest(F.lit(1), F.least(F.floor(F.col("i") * (F.col("n") + 1) / 10), F.col("n") - 1))
    delta = F.col("i") * (F.col("n") + 1) - j * 10
    hit = lambda k: F.max(F.when((F.col("__lo") < k) & (k <= F.col("__hi")), F.col(size)))
    deciles = at.withColumns({"j": j, "d": delta}).groupBy(*by, "i").agg(hit(F.col("j")).alias("a"), hit(F.col("j") + 1).alias("b"), F.max("d").alias("d"))
    value = F.when(F.col("b").isNull(), F.col("a").cast("double")).otherwise((F.col("a") * (10 - F.col("d")) + F.col("b") * F.col("d")) / 10)
    wide = deciles.groupBy(*by).agg(*[F.max(F.when(F.col("i") == i, value)).alias(f"d{i}") for i in range(1, 10)])
    plain = df.groupBy(*by).agg(F.count(size).alias("n"), F.avg(size).alias("mean"), F.median(size).alias("median"), F.stddev_samp(size).alias("sd"), F.min(size).alias("least"), F.max(size).alias("most"))
    return plain.join(wide, list(by), "left")


def recorded_answers(batches: Iterator[pd.DataFrame], ask) -> Iterator[pd.DataFrame]:
    """Answers of an injected callable, batch by batch, for ``mapInPandas``; errors become a status."""
    for batch in batches:
        rows = []
        for key, prompt in zip(batch["key"], batch["prompt"]):
            try:
                rows.append((key, "ok", ask(prompt)))
            except Exception as error:  # noqa: BLE001
                rows.append((key, f"error: {error}", None))
        yield pd.DataFrame(rows, columns=["key", "status", "answer"])


def question_parts_by(qid: Column, variant: str = "first", tickers: Column | None = None) -> Column:
    """Ticker, kpi and year of a question id: split at the first underscore, before the last two parts (``last``), or after one of the report's tickers (``report``)."""
    if variant == "first":
        return question_parts(qid)
    if variant == "last":
        pattern = r"^(.+)_([^_]+)_([0-9]{4})$"
        return F.when(qid.rlike(pattern), F.struct(F.regexp_extract(qid, pattern, 1).alias("ticker"), F.regexp_extract(qid, pattern, 2).alias("kpi"), F.regexp_extract(qid, pattern, 3).cast("int").alias("year")))
    if variant == "report" and tickers is not None:
        known = F.try_element_at(F.filter(F.reverse(F.array_sort(tickers)), lambda t: F.startswith(qid, F.concat(t, F.lit("_")))), F.lit(1))
        rest = F.substring(qid, F.length(known) + 2, F.length(qid))
        return F.when(known.isNotNull() & rest.rlike(r"^.+_[0-9]{4}$"), F.struct(known.alias("ticker"), F.regexp_extract(rest, r"^(.+)_([0-9]{4})$", 1).alias("kpi"), F.regexp_extract(rest, r"_([0-9]{4})$", 1).cast("int").alias("year")))
    raise ValueError(f"unknown variant {variant}")


#: Endings of a company name, stripped one after another in this order.
NAME_ENDINGS = (".", "Inc", "PLC", "plc", "Group", "Corporation", "Corp", "Co", "Company", "S.A", "L.P", "Ltd", "Limited", "Group", ", ")


def short_name(name: Column) -> Column:
    """A company name without its legal ending."""
    endings = F.array(*[F.lit(e) for e in NAME_ENDINGS])
    return F.trim(F.aggregate(endings, F.trim(name), lambda out, e: F.when(F.endswith(out, e), F.substring(out, F.lit(1), F.length(out) - F.length(e))).otherwise(out)))


def name_verdict(similarity: Column, threshold: float = 0.6) -> Column:
    """verified, unverified, or unknown where a name is missing."""
    return F.when(similarity.isNull(), "unknown").when(similarity >= threshold, "verified").otherwise("unverified")


def page_prompt(text: Column, most: int | None = None, mark: str = PAGE_MARK) -> Column:
    """Pages that aren't blank under ``[Page n]``, counted from 1; with ``most`` whole pages are left out at the end until the text fits, but never the first."""
    pages = F.filter(F.transform(F.split(text, mark), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    chunks = F.transform(pages, lambda p, i: F.concat(F.lit("[Page "), (i + 1).cast("string"), F.lit("]\n"), p))
    if most is not None:
        sizes = F.transform(chunks, lambda c, i: F.length(c) + F.when(i > 0, 2).otherwise(0))
        ends = F.transform(sizes, lambda s, i: F.aggregate(F.slice(sizes, 1, i + 1), F.lit(0), lambda a, x: a + x))
        fit = F.greatest(F.size(F.filter(ends, lambda e: e <= most)), F.lit(1))
        chunks = F.slice(chunks, 1, fit)
    return F.array_join(chunks, "\n\n")


def cut_letter(text: Column, end: Column, following: Column | None = None) -> Column:
    """A text up to an offset (that of what follows, where given and known), without page marks, rules and blank lines at its end; null without offset."""
    at = end if following is None else F.coalesce(following, end)
    kept = F.substring(text, F.lit(1), at.cast("int"))
    return F.when(at.isNotNull(), F.concat(F.regexp_replace(kept, r"(?i)(\s|<---\s*page split\s*--->|-{3,}|\*{3,}|_{3,})+\z", ""), F.lit("\n")))


#: What marks an amount of money behind an escaped bracket, and what marks a formula.
_MONEY = r"\s*[-(]?\s*[0-9][0-9,.]*|\s*(?:thousand|million|billion)s?\b|\s*(?:in|per)\s+(?:thousands?|millions?|billions?|share)\b"
_FORMULA = r"\s*(?:[_^{]|\\[a-zA-Z]+|[<>=])"


def dollar_repair(text: Column, strategy: str = "money") -> Column:
    """Escaped brackets that stand for a dollar sign, repaired by a strategy.

    ``money``: before an amount, or alone in a table cell; ``overlap``: before
    an amount where the bracket also pairs with the next one without braces
    between, or alone in a cell; ``td_prefix``: at the start of a table cell,
    unless a formula follows.
    """
    cell = r"(?<=<td>)\\[()](?=</td>)"
    if strategy == "money":
        return F.regexp_replace(text, cell + r"|\\[()](?!" + _FORMULA + ")(?=" + _MONEY + ")", r"\$")
    if strategy == "overlap":
        out = F.regexp_replace(text, cell, r"\$")
        out = F.regexp_replace(out, r"\\\((?!" + _FORMULA + ")(?=" + _MONEY + r")((?:(?!\\[()])[^{}])*)\\\)(?!" + _FORMULA + ")(?=" + _MONEY + ")", r"\$$1\$")
        return F.regexp_replace(out, r"\\\((?!" + _FORMULA + ")(?=" + _MONEY + r")((?:(?!\\[()])[^{}])*)(\\\))", r"\$$1$2")
    if strategy == "td_prefix":
        return F.regexp_replace(text, r"(?<=<td>)\\[()](?!" + _FORMULA + ")", r"\$")
    raise ValueError(f"unknown strategy {strategy}")


def marker_sets(chosen: Column, certain: Column, other: Column) -> Column:
    """Struct of positions to repair: ``either`` (chosen or certain) and ``both`` (chosen and other, or certain)."""
    return F.struct(F.array_sort(F.array_union(chosen, certain)).alias("either"), F.array_sort(F.array_union(F.array_intersect(chosen, other), certain)).alias("both"))


def letter_sections(reports: DataFrame, report: str, text: str, phrases: Sequence[str], window: int = 4, mark: str = PAGE_MARK) -> DataFrame:
    """Letters that begin under a heading: ``report, title, start_page, end_page, text``.

    A heading is one of the phrases, the longest first, at the start of a line
    behind marks of emphasis; ``<company_name>`` stands for up to nine words.
    A line of a table of contents (only dots, blanks and digits behind the
    phrase) is none.  The text runs from the heading over ``window`` pages;
    headings within them are part of it.  Pages count from 0 with blank ones.
    """
    wildcard = r"[\w&'.\-]+(?:\s+[\w&'.\-]+){0,8}"
    ordered = sorted(dict.fromkeys(" ".join(p.split()) for p in phrases), key=lambda p: (-len(p), p.lower()))
    words = [r"\s+".join(wildcard if w == "<company_name>" else re.escape(w) for w in p.split()) for p in ordered]
    heading = r"(?im)^[ \t]*(?:#{1,6}[ \t]*)?(?:\*{1,3}[ \t]*)?(?:_{1,3}[ \t]*)?(" + "|".join(f"(?:{w})" for w in words) + r")(?=\W|$)(?![ \t.·…]*[0-9]*[ \t.·…]*[0-9]+[ \t]*$)"
    pages = F.split(F.col(text), mark)
    marked = reports.where(F.col(text).rlike(heading)).withColumn("__pages", pages)
    found = F.transform("__pages", lambda p, i: F.struct(i.alias("page"), F.regexp_extract_all(p, F.lit(heading), F.lit(1)).alias("titles")))
    first = F.filter(found, lambda x: F.size(x["titles"]) > 0)
    keep = F.aggregate(first, F.filter(first, lambda x: F.lit(False)), lambda acc, x: F.when((F.size(acc) == 0) | (x["page"] >= F.element_at(acc, -1)["page"] + window), F.concat(acc, F.array(x))).otherwise(acc))
    rows = marked.select(report, "__pages", F.explode(keep).alias("k"))
    title = F.element_at("k.titles", 1)
    last = F.least(F.col("k.page") + window, F.size("__pages"))
    opening = F.expr("substring(element_at(__pages, k.page + 1), locate(element_at(k.titles, 1), element_at(__pages, k.page + 1)))")
    chunks = F.concat(F.array(opening), F.slice("__pages", F.col("k.page") + 2, F.greatest(last - F.col("k.page") - 1, F.lit(0))))
    body = F.array_join(F.transform(chunks, lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")), "\n\n<--- Page Split --->\n\n")
    return rows.select(report, F.trim(title).alias("title"), F.col("k.page").alias("start_page"), (last - 1).alias("end_page"), body.alias("text"))


def neighbouring_texts(blocks: DataFrame, page: Sequence[str], order: str, kind: str, text: str, reach: int = 2) -> DataFrame:
    """Table blocks with up to ``reach`` text blocks before and after them on the page."""
    w = Window.partitionBy(*page).orderBy(order)
    is_text = F.when((F.col(kind) != "table") & (F.trim(text) != ""), F.col(text))
    # the last ones before are the first ones in reverse
    first = lambda over: F.slice(F.collect_list(is_text).over(over.rowsBetween(1, Window.unboundedFollowing)), 1, reach)
    back = Window.partitionBy(*page).orderBy(F.col(order).desc())
    return blocks.withColumns({"before": F.reverse(first(back)), "after": first(w)}).where(F.col(kind) == "table")
