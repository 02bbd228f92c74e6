"""Known values and names against the numbers of pages."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T


def within(numbers: DataFrame, targets: DataFrame, keys: Sequence[str], number: str, target: str, tolerance: float) -> DataFrame:
    """Pairs of number and target of the same keys whose values differ by at most the tolerance.

    Magnitudes are cut into logarithmic bins wider than the tolerance, and a
    target meets its own and the neighbouring bins, so the join is an equi join
    however many numbers a key has.  Zeros meet zeros.
    """
    width = math.log1p(2 * tolerance)
    bin_ = lambda c: F.when(c == 0, F.lit(-(10**9))).otherwise(F.floor(F.log(F.abs(c)) / F.lit(width))).cast("int")
    n = numbers.where(F.col(number).isNotNull()).withColumn("__b", bin_(F.col(number)))
    t = targets.where(F.col(target).isNotNull()).withColumn("__b", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: bin_(F.col(target)) + d)))
    error = F.when(F.col(target) == 0, F.abs(F.col(number))).otherwise(F.abs(F.col(number) - F.col(target)) / F.abs(F.col(target)))
    return n.join(t, [*keys, "__b"]).drop("__b").withColumn("rel_error", error).where(F.col("rel_error") <= tolerance)


def reverse_within(numbers: DataFrame, targets: DataFrame, keys: Sequence[str], number: str, target: str, divisors: Sequence[float], tolerance: float, span: Sequence[str]) -> DataFrame:
    """Numbers as printed against targets divided by each divisor; a number counts once, by its smallest divisor."""
    scaled = targets.withColumn("divisor", F.explode(F.array(*[F.lit(float(d)) for d in divisors]))).withColumn("__t", F.col(target) / F.col("divisor"))
    hits = within(numbers, scaled, keys, number, "__t", tolerance)
    rest = [c for c in hits.columns if c not in (*keys, *span, "divisor", "__t")]
    best = hits.groupBy(*keys, *span, target).agg(F.min(F.struct("divisor", *[c for c in rest if c != target])).alias("__r"))
    return best.select(*keys, *span, target, "__r.*")


def nearest_alias(lines: DataFrame, page: Sequence[str], line: str, has_number: str, alias: str, reach: int) -> DataFrame:
    """For each line with a number the alias of the nearest line within reach; a line before beats one after.

    Offsets are exploded on the side of the aliases and met by an equi join.
    """
    order = [0] + [d for k in range(1, reach + 1) for d in (-k, k)]
    offsets = F.array(*[F.struct(F.lit(i).alias("preference"), F.lit(d).alias("offset")) for i, d in enumerate(order)])
    named = lines.where(F.col(alias).isNotNull()).select(*page, F.col(line).alias("__l"), F.col(alias).alias("__alias"), F.explode(offsets).alias("__o"))
    named = named.select(*page, (F.col("__l") - F.col("__o.offset")).alias(line), F.col("__o.preference").alias("preference"), F.col("__o.offset").alias("offset"), "__alias")
    best = named.groupBy(*page, line).agg(F.min(F.struct("preference", "offset", "__alias")).alias("__b"))
    return lines.where(F.col(has_number)).join(best, [*page, line], "left").withColumns({"near_alias": F.col("__b.__alias"), "offset": F.col("__b.offset")}).drop("__b")


def emission(alias: Column, value: Column, offset_years: Column) -> Column:
    """alias+value, value-only or none: a page of the target year needs the value, one of a later year alias and value."""
    return F.when(alias & value, "alias+value").when(value & (offset_years == 0), "value-only").otherwise("none")


def years_reached(questions: DataFrame, year: str, ahead: int) -> DataFrame:
    """Questions met with reports of their year and the ``ahead`` following ones, by an exploded key."""
    return questions.withColumn("report_year", F.explode(F.sequence(F.col(year), F.col(year) + ahead)))


def best_candidate(candidates: DataFrame, keys: Sequence[str], order: Sequence[Column], keep: Sequence[str]) -> DataFrame:
    """The candidate first in a lexicographic order of priorities, and how many there were."""
    out = candidates.groupBy(*keys).agg(F.min(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], *keep)).alias("b"), F.count(F.lit(1)).alias("candidates"))
    return out.select(*keys, *[F.col(f"b.{k}").alias(k) for k in keep], "candidates")


def verdict(forward: Column, backward: Column, forward_error: Column, backward_error: Column, forward_reason: Column, backward_reason: Column) -> Column:
    """Struct of ``status, reason, winner`` of the forward and the reverse check of one cell.

    A match beats an ambiguous result, which beats none.  When both checks say
    the same, the smaller relative error wins, forward on ties and when the
    reverse check has none; a missing forward error loses.
    """
    nearer = F.when(backward_error.isNull() | F.coalesce(forward_error <= backward_error, F.lit(False)), "forward").otherwise("reverse")
    said = lambda status, reason, winner: F.struct(F.lit(status).alias("status"), reason.alias("reason"), winner.alias("winner"))
    return (
        F.when((forward == "matched") & (backward == "matched"), said("matched", F.lit("both-matched"), nearer))
        .when(forward == "matched", said("matched", F.lit("forward-only-match"), F.lit("forward")))
        .when(backward == "matched", said("matched", F.lit("reverse-only-match"), F.lit("reverse")))
        .when((forward == "ambiguous") & (backward == "ambiguous"), said("ambiguous", F.lit("both-ambiguous"), nearer))
        .when(forward == "ambiguous", said("ambiguous", F.lit("forward-ambiguous"), F.lit("forward")))
        .when(backward == "ambiguous", said("ambiguous", F.lit("reverse-ambiguous"), F.lit("reverse")))
        .otherwise(said("unmatched", F.concat(F.lit("forward:"), forward_reason, F.lit("|reverse:"), backward_reason), nearer))
    )


def audit_tables(rows: DataFrame, kpi: str = "kpi", year: str = "year", ticker: str = "ticker", status: str = "status", reason: str = "reason") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three counts of an audit: by kpi and year, unmatched rows by reason, and by ticker with the most frequent reason of what didn't match."""
    matched, total = F.count_if(F.col(status) == "matched"), F.count(F.lit(1))
    rate = F.try_divide(matched, total)
    cells = rows.groupBy(kpi, year).agg(total.alias("total"), matched.alias("matched"), rate.alias("match_rate"))
    missed = rows.where(F.col(status) != "matched")
    reasons = missed.groupBy(reason).agg(total.alias("count"))
    counted = missed.groupBy(ticker, reason).agg(total.alias("__n"))
    top = counted.groupBy(ticker).agg(F.min(F.struct((-F.col("__n")).alias("n"), F.col(reason).alias("top_reason")))["top_reason"].alias("top_reason"))
    tickers = rows.groupBy(ticker).agg(total.alias("total"), matched.alias("matched"), rate.alias("match_rate")).join(top, ticker, "left")
    return cells, reasons, tickers


def confident_rejections(rows: DataFrame, match_type: str, error: str, unit_source: str, grade: str) -> DataFrame:
    """Candidates that a judge graded below 2 though alias and value match within 0.5 % in a unit stated on the page, line or number."""
    return rows.where((F.col(match_type) == "alias+value") & (F.col(error) < 0.005) & F.col(unit_source).isin("page", "line", "inline") & (F.col(grade) < 2))


def page_candidates(pages: DataFrame, targets: DataFrame, aliases: dict[str, Sequence[str]], tolerance: float = 0.005, report: str = "report", page: str = "page", text: str = "text") -> DataFrame:
    """Pages that show a known value, or that name it too: one row per report, page and kpi.

    ``targets`` has the report, ``kpi, target, offset_years``.  Numbers take
    their own unit, else that of the three lines around, the page or the
    report.  A page of the target year needs the value, one of a later year
    the value and an alias.  Returns ``match_type, alias, raw, normalized,
    rel_error, unit_source`` of the first matching number of the page and the
    least error on it.  Values and targets meet by an equi join of bins;
    a report's hints are at most three values.
    """
    plain = pages.where(F.col(text).isNotNull()).select(report, page, text, T.unit_hints(F.col(text)).alias("__page"))
    whole = plain.select(report, F.explode("__page").alias("h")).distinct().groupBy(report).agg(F.collect_set("h").alias("__document"))
    lines = plain.select(report, page, "__page", F.posexplode(F.split(F.col(text), r"\r?\n")).alias("line", "__raw"))
    lines = T.line_context(lines.withColumn("__t", T.plain_line(T.plain_marks(F.col("__raw")))), [report, page], "line", "__t")
    numbers = lines.select(report, page, "line", "__page", T.unit_hints(F.col("context")).alias("__line"), F.posexplode(T.number_tokens(F.col("__t"))).alias("place", "n"))
    numbers = numbers.join(whole, report, "left")
    own = F.when(F.col("n.inline_multiplier").isNotNull(), F.array("n.inline_multiplier")).otherwise(F.array().cast("array<double>"))
    empty = F.array().cast("array<double>")
    unit = T.resolve_unit([("inline", own), ("line", F.col("__line")), ("page", F.col("__page")), ("document", F.coalesce("__document", empty))])
    numbers = numbers.withColumn("u", unit).select(report, page, "line", "place", F.col("n.raw").alias("raw"), F.col("u.unit_source").alias("unit_source"), (F.col("n.value") * F.col("u.multiplier")).alias("normalized"))
    hits = within(numbers, targets, [report], "normalized", "target", tolerance)
    first = F.min(F.struct("line", "place", "raw", "normalized", "unit_source"))
    values = hits.groupBy(report, page, "kpi", "offset_years").agg(first.alias("f"), F.min("rel_error").alias("rel_error"))
    named = None
    for kpi, words in sorted(aliases.items()):
        one = lines.select(report, page, F.lit(kpi).alias("kpi"), "line", T.first_alias(F.col("__t"), words).alias("alias")).where("alias IS NOT NULL")
        named = one if named is None else named.unionByName(one)
    if named is None:
        named = lines.select(report, page, F.lit("").alias("kpi"), "line", F.lit(None).cast("string").alias("alias")).limit(0)
    named = named.groupBy(report, page, "kpi").agg(F.min(F.struct("line", "alias"))["alias"].alias("alias"))
    found = values.join(named, [report, page, "kpi"], "left")
    kind = emission(F.col("alias").isNotNull(), F.lit(True), F.col("offset_years"))
    return found.select(report, page, "kpi", "offset_years", kind.alias("match_type"), "alias", F.col("f.raw").alias("raw"), F.col("f.normalized").alias("normalized"), "rel_error", F.col("f.unit_source").alias("unit_source")).where("match_type <> 'none'")
