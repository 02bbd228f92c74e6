"""Fact tables: choosing, filling, keying and covering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fiscal_year(period_end: Column, cutoff_month: int = 1) -> Column:
    """Fiscal year of a period's end: ends up to the cutoff month belong to the year before."""
    return F.year(period_end) - F.when(F.month(period_end) <= cutoff_month, 1).otherwise(0)


def annual(form: Column, period: Column) -> Column:
    """Whether a fact comes from an annual filing for a whole fiscal year."""
    return (period == "FY") & (form.like("10-K%") | form.like("20-F%"))


def full_year_span(start: Column, end: Column, least: int = 340, most: int = 400) -> Column:
    return F.datediff(end, start).between(least, most)


def latest_fact(facts: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One fact per key: the first in a total order."""
    return facts.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def waterfall(facts: DataFrame, keys: Sequence[str], tag: str, value: str, order: Sequence[str]) -> DataFrame:
    """The value of the first tag, in the given order, that has one.

    A partial aggregate, so that hot keys are combined before the shuffle.
    Tags outside the order and null values take no part; among several values
    of the tag the smallest is taken.
    """
    place = F.array_position(F.array(*[F.lit(t) for t in order]), F.col(tag))
    known = facts.where(F.col(tag).isin(*order) & F.col(value).isNotNull())
    best = known.groupBy(*keys).agg(F.min(F.struct(place.alias("p"), F.col(value).alias("v"), F.col(tag).alias("t"))).alias("b"))
    return best.select(*keys, F.col("b.v").alias(value), F.col("b.t").alias(tag))


def signed_sum(facts: DataFrame, keys: Sequence[str], tag: str, value: str, parts: Sequence[tuple[int, str]], filled: DataFrame | None = None) -> DataFrame:
    """Sum of signed components where all of them are there, for keys not filled already."""
    sign = F.coalesce(*[F.when(F.col(tag) == t, F.lit(float(s))) for s, t in parts])
    one = facts.where(F.col(tag).isin(*[t for _, t in parts]) & F.col(value).isNotNull()).groupBy(*keys, tag).agg(F.min(value).alias("__v"))
    out = one.groupBy(*keys).agg(F.sum(sign * F.col("__v")).alias(value), F.count(F.lit(1)).alias("__n")).where(F.col("__n") == len(parts)).drop("__n")
    return out if filled is None else out.join(filled.select(*keys).distinct(), list(keys), "left_anti")


def ambiguous(facts: DataFrame, chosen: DataFrame, keys: Sequence[str], tag: str, value: str, threshold: float = 1e-3) -> DataFrame:
    """Candidates that differ from the chosen value by more than the threshold of the larger."""
    picked = chosen.select(*keys, F.col(value).alias("chosen_value"), F.col(tag).alias("chosen_tag"))
    v, c = F.col(value), F.col("chosen_value")
    error = F.try_divide(F.abs(v - c), F.greatest(F.abs(v), F.abs(c)))
    return facts.join(picked, list(keys)).where((F.col(tag) != F.col("chosen_tag")) & (error > threshold))


def gap_fill(base: DataFrame, fill: DataFrame, keys: Sequence[str], value: str, names: tuple[str, str]) -> DataFrame:
    """Base values, completed from another source but never overwritten, with their provenance."""
    both = base.select(*keys, F.col(value).alias("__b")).join(fill.select(*keys, F.col(value).alias("__f")), list(keys), "full")
    source = F.when(F.col("__b").isNotNull(), names[0]).when(F.col("__f").isNotNull(), names[1])
    return both.select(*keys, F.coalesce("__b", "__f").alias(value), source.alias("source"))


def priority_union(parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Union of sources by name; a key that several have comes from the first."""
    out = None
    for rank, part in enumerate(parts):
        part = part.withColumn("__rank", F.lit(rank))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    first = out.groupBy(*keys).agg(F.min("__rank").alias("__rank"))
    return out.join(first, [*keys, "__rank"], "left_semi").drop("__rank")


def coverage(entities: DataFrame, attributes: Sequence[str], facts: DataFrame, keys: Sequence[str], attribute: str) -> DataFrame:
    """Every cell of entities by attributes with whether a fact is there.

    The attributes are exploded beside each entity, so no cross join arises.
    """
    grid = entities.select(*keys, F.explode(F.array(*[F.lit(a) for a in attributes])).alias(attribute))
    have = facts.select(*keys, attribute).distinct().withColumn("__have", F.lit(1))
    return grid.join(have, [*keys, attribute], "left").withColumn("filled", F.col("__have").isNotNull()).drop("__have")


def year_windows(years: DataFrame, entity: str, year: str, sizes: Sequence[int]) -> DataFrame:
    """For each window size the window of years that most entities cover whole; ties go to the latest.

    A run of consecutive years of an entity covers a window from a iff the run
    goes on for its size from a, so each (entity, year) counts once per size.
    """
    one = years.select(entity, year).where(F.col(entity).isNotNull() & F.col(year).isNotNull()).distinct()
    order = Window.partitionBy(entity).orderBy(year)
    runs = one.withColumn("__g", F.col(year) - F.row_number().over(order))
    ahead = Window.partitionBy(entity, "__g").orderBy(F.col(year).desc())
    runs = runs.withColumn("__ahead", F.row_number().over(ahead))
    sized = runs.select(year, "__ahead", F.explode(F.array(*[F.lit(s) for s in sizes])).alias("size")).where("__ahead >= size")
    counts = sized.groupBy("size", F.col(year).alias("first_year")).agg(F.count(F.lit(1)).alias("entities"))
    best = counts.groupBy("size").agg(F.max(F.struct("entities", "first_year")).alias("b"))
    return best.select("size", F.col("b.first_year").cast("bigint").alias("first_year"), (F.col("b.first_year") + F.col("size") - 1).cast("bigint").alias("last_year"), F.col("b.entities").alias("entities"))


def uncovered(wanted: DataFrame, covered: DataFrame, entity: str, years: str) -> DataFrame:
    """Wanted years per entity without those covered; entities left without years are dropped."""
    left = wanted.join(covered.select(F.col(entity), F.col(years).alias("__c")), entity, "left")
    rest = F.array_except(F.col(years), F.coalesce("__c", F.array().cast("array<int>")))
    return left.withColumn(years, F.array_sort(rest)).where(F.size(years) > 0).drop("__c")


def pivot_first(facts: DataFrame, keys: Sequence[str], attribute: str, value: str, values: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Long to wide: per attribute of a fixed list the first value in a total order."""
    first = lambda a: F.min(F.when(F.col(attribute) == a, F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.col(value).alias("v"))))["v"]
    return facts.groupBy(*keys).agg(*[first(a).alias(a) for a in values])


def usable(rows: DataFrame, columns: Sequence[str], missing: Sequence[str] = ("N/A", "Error", "")) -> DataFrame:
    """Rows none of whose cells is missing or one of the spellings of a missing value, blanks aside."""
    return rows.where(~F.exists(F.array(*[F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) for c in columns]), lambda x: x.isin(*missing)))


def allowed(rows: DataFrame, allow: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose keys an allow-list has, and the dropped ones counted by key."""
    kept = rows.join(allow.select(*keys).distinct(), list(keys), "left_semi")
    dropped = rows.join(allow.select(*keys).distinct(), list(keys), "left_anti").groupBy(*keys).agg(F.count(F.lit(1)).alias("dropped"))
    return kept, dropped


def route(exchange: Column, filed: Sequence[str] = ("NYSE", "NASDAQ", "AMEX")) -> Column:
    """Where an exchange's figures come from: ``filings`` where filing is electronic, else ``api``."""
    return F.when(F.upper(exchange).isin(*filed), "filings").otherwise("api")


def signed_sums(facts: DataFrame, keys: Sequence[str], tag: str, value: str, sets: Sequence[Sequence[tuple[int, str]]], filled: DataFrame | None = None) -> DataFrame:
    """The sum of the first of several component sets that is there whole, with its place in the list."""
    every = None
    for place, parts in enumerate(sets):
        one = signed_sum(facts, keys, tag, value, parts).withColumn("component_set", F.lit(place))
        every = one if every is None else every.unionByName(one)
    first = every.groupBy(*keys).agg(F.min(F.struct("component_set", value)).alias("b")).select(*keys, F.col(f"b.{value}").alias(value), "b.component_set")
    return first if filled is None else first.join(filled.select(*keys).distinct(), list(keys), "left_anti")


def parse_years(text: str) -> list[int]:
    """Years of a list such as ``2012-2014,2018``, sorted."""
    years: set[int] = set()
    for part in filter(None, (p.strip() for p in text.split(","))):
        first, _, last = part.partition("-")
        years.update(range(int(first), int(last or first) + 1))
    return sorted(years)


def answerable(questions: DataFrame, truth: DataFrame, reports: DataFrame, cell: Sequence[str], report: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Questions with a truth and a report, and how many there were at each step."""
    t = truth.select(*cell).distinct().withColumn("__t", F.lit(True))
    r = reports.select(*report).distinct().withColumn("__r", F.lit(True))
    flagged = questions.join(t, list(cell), "left").join(r, list(report), "left").withColumns({"__t": F.coalesce("__t", F.lit(False)), "__r": F.coalesce("__r", F.lit(False))})
    steps = flagged.agg(F.count(F.lit(1)).alias("questions"), F.count_if(~F.col("__t")).alias("without_truth"), F.count_if(F.col("__t") & ~F.col("__r")).alias("without_report"), F.count_if(F.col("__t") & F.col("__r")).alias("kept"))
    return flagged.where("__t AND __r").drop("__t", "__r"), steps


def with_texts(facts: DataFrame, texts: DataFrame, report: str) -> DataFrame:
    """Facts of each report as an array of structs beside its text; reports without text keep a null one."""
    rest = [c for c in facts.columns if c != report]
    nested = facts.groupBy(report).agg(F.sort_array(F.collect_list(F.struct(*rest))).alias("facts"))
    return nested.join(texts, report, "left")


def looked_up(rows: DataFrame, table: DataFrame, key: str, columns: Sequence[str], suffix: str = ".L") -> DataFrame:
    """Columns of a table by key, else by key with a suffix; the table has one row per key."""
    direct = table.select(key, *[F.col(c).alias(f"__a_{c}") for c in columns], F.lit(True).alias("__a"))
    second = table.where(F.endswith(key, F.lit(suffix))).select(F.expr(f"substring({key}, 1, length({key}) - {len(suffix)})").alias(key), *[F.col(c).alias(f"__b_{c}") for c in columns])
    both = rows.join(direct, key, "left").join(second, key, "left")
    out = both.withColumns({c: F.when(F.col("__a"), F.col(f"__a_{c}")).otherwise(F.col(f"__b_{c}")) for c in columns})
    return out.drop("__a", *[f"__{s}_{c}" for s in "ab" for c in columns])


def nested_groups(rows: DataFrame, outer: str, inner: str, member: str) -> DataFrame:
    """Per outer group its inner groups as an array of structs (inner, members sorted), and how many have at least 2, 5 and 10 members."""
    one = rows.groupBy(outer, inner).agg(F.sort_array(F.collect_set(member)).alias("members"))
    size = F.size("members")
    return one.groupBy(outer).agg(F.sort_array(F.collect_list(F.struct(inner, "members"))).alias("groups"), *[F.count_if(size >= n).alias(f"at_least_{n}") for n in (2, 5, 10)])


def trimmed(rows: DataFrame, group: str, value: str, key: str, take: dict[str, int]) -> tuple[DataFrame, DataFrame]:
    """The ``take[group]`` smallest rows of each group named, and the rows without them; ties go to the smaller key."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(value, key))
    quota = F.coalesce(*[F.when(F.col(group) == g, F.lit(k)) for g, k in take.items()], F.lit(0))
    outliers = rows.where(F.col(group).isin(*take) & F.col(value).isNotNull()).withColumn("__n", n).where(F.col("__n") <= quota).drop("__n")
    return outliers, rows.join(outliers.select(key).distinct(), key, "left_anti")


def top_rows(rows: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows in a total order."""
    return rows.orderBy(*order).limit(k)


def within_budget(rows: DataFrame, deficit: str, calls: str, key: str, budget: int) -> DataFrame:
    """The most deficient rows first, as long as their calls together stay within a budget.

    Each row takes at least one call, so the first ``budget`` rows are enough.
    """
    order = [F.col(deficit).desc(), F.col(key)]
    head = rows.where((F.col(deficit) > 0) & (F.col(calls) > 0)).orderBy(*order).limit(budget)
    run = F.sum(calls).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return head.withColumn("__run", run).where(F.col("__run") <= budget).drop("__run")
