"""Time series on irregular calendars: returns, windows around events, as-of lookups."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable


def _order(by: Sequence[str], time: str):
    return Window.partitionBy(*by).orderBy(time)


#: Rows of a series in one block; a series with more is cut into several.
BLOCK = 4096


def _slot(series: DataFrame, time: str) -> Column:
    """A coarse step of a time column that keeps its order; missing times come first."""
    kind, t = dict(series.dtypes)[time], F.col(time)
    if kind == "date":
        step = F.floor(F.unix_date(t) / 90)
    elif kind.startswith("timestamp"):
        step = F.unix_date(t.cast("date"))
    elif kind in ("int", "bigint", "smallint", "tinyint"):
        step = F.floor(t / 1024)
    else:
        return F.when(t.isNull(), 0).otherwise(1)
    return F.coalesce(step.cast("bigint"), F.lit(-(2**62)))


def _joined(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join of ``a`` on keys of which some may be null."""
    right = b.select(*[F.col(k).alias(f"__r{i}") for i, k in enumerate(keys)], *[c for c in b.columns if c not in keys])
    return a.join(right, reduce(and_, [F.col(k).eqNullSafe(F.col(f"__r{i}")) for i, k in enumerate(keys)]), "left").drop(*[f"__r{i}" for i in range(len(keys))])


def with_ordinal(series: DataFrame, by: Sequence[str], time: str, value: str | None = None) -> DataFrame:
    """Trading-day ordinal from 0, per series; rows without the value are dropped first if one is named.

    Rows are numbered within slots of time, and the slots' sizes summed up
    before them, so that no series is sorted in one task.
    """
    if value is not None:
        series = series.where(F.col(value).isNotNull())
    cut = series.withColumn("__s", _slot(series, time))
    sizes = cut.groupBy(*by, "__s").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*by).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*by, "__s", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inner = F.row_number().over(Window.partitionBy(*by, "__s").orderBy(time)) - 1
    return _joined(cut.withColumn("__i", inner), sizes, [*by, "__s"]).withColumn("ordinal", (F.col("__before") + F.col("__i")).cast("int")).drop("__s", "__i", "__before")


def _blocks(series: DataFrame, by: Sequence[str], time: str, before: int, after: int, carry: str | None = None) -> DataFrame:
    """Blocks ``__b`` of each series in order ``__o``, with ``before`` and ``after`` rows of the neighbours (not ``__own``).

    With ``carry``, ``__f`` is that column's last known value at each row,
    wherever in the series it stands.  A series that has its ``ordinal``
    already isn't numbered again.
    """
    at = F.col("__o")
    rows = series.withColumn("__o", F.col("ordinal")) if "ordinal" in series.columns else with_ordinal(series, by, time).withColumnRenamed("ordinal", "__o")
    first, last = F.greatest(F.floor((at - after) / BLOCK), F.lit(0)), F.floor((at + before) / BLOCK)
    out = rows.withColumn("__b", F.explode(F.sequence(first, last))).withColumn("__own", F.floor(at / BLOCK) == F.col("__b"))
    if carry is None:
        return out
    # the last known value before a block's first row, neighbours included
    known = rows.groupBy(*by, F.floor((at + before) / BLOCK).alias("__b")).agg(F.max(F.when(F.col(carry).isNotNull(), F.struct("__o", F.col(carry).alias("v"))))["v"].alias("__v"))
    ahead = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    known = known.select(*by, "__b", F.last("__v", ignorenulls=True).over(ahead).alias("__carry"))
    out = _joined(out, known, [*by, "__b"])
    return out.withColumn("__f", F.coalesce(F.last(carry, ignorenulls=True).over(_within(by)), F.col("__carry"))).drop("__carry")


def _within(by: Sequence[str]):
    return Window.partitionBy(*by, "__b").orderBy("__o")


def _own(blocks: DataFrame) -> DataFrame:
    return blocks.where("__own").drop("__o", "__b", "__own", "__f")


def pct_change(series: DataFrame, by: Sequence[str], time: str, value: str, name: str) -> DataFrame:
    """Change against the last known value before; gaps are filled forward first."""
    blocks = _blocks(series, by, time, 1, 0, value)
    return _own(blocks.withColumn(name, F.try_divide("__f", F.lag("__f").over(_within(by))) - 1))


def rolling_sd(series: DataFrame, by: Sequence[str], time: str, value: str, rows: int, name: str) -> DataFrame:
    """Sample deviation over the last rows; null until all of them are there."""
    w = _within(by).rowsBetween(1 - rows, 0)
    return _own(_blocks(series, by, time, rows - 1, 0).withColumn(name, F.when(F.count(value).over(w) >= rows, F.stddev_samp(value).over(w))))


def shifted_return(series: DataFrame, by: Sequence[str], time: str, value: str, days: Sequence[int]) -> DataFrame:
    """value[t+d]/value[t] - 1 for each d, as columns return_<d> (m for minus)."""
    w = _within(by)
    shifted = {f"return_{'m' if d < 0 else ''}{abs(d)}": F.try_divide(F.lead(value, d).over(w) if d > 0 else F.lag(value, -d).over(w), F.col(value)) - 1 for d in days}
    return _own(_blocks(series, by, time, max([0, *(-d for d in days)]), max([0, *days])).withColumns(shifted))


def trailing(shifted: Column) -> Column:
    """The holding-period return that a backward shifted return stands for."""
    return F.try_divide(F.lit(1.0), shifted + 1) - 1


def group_means(series: DataFrame, groups: DataFrame, entity: str, group: str, time: str, value: str, volume: str) -> DataFrame:
    """Equal and volume weighted mean of a group by date.

    Weights are each entity's mean volume over the group's sum; a missing
    value counts as 0 in the weighted mean, whose weights aren't rescaled.
    """
    joined = series.join(groups, entity)
    weight = joined.groupBy(group, entity).agg(F.avg(volume).alias("__w"))
    total = weight.groupBy(group).agg(F.sum("__w").alias("__t"))
    weight = weight.join(total, group).select(group, entity, F.try_divide("__w", "__t").alias("__w"))
    both = joined.join(weight, [group, entity])
    return both.groupBy(group, time).agg(F.avg(value).alias("equal_weighted"), F.sum(F.col("__w") * F.coalesce(F.col(value), F.lit(0.0))).alias("volume_weighted"))


def as_of_next(events: DataFrame, calendar: DataFrame, by: Sequence[str], event_time: str, day: str, slot_days: int = 90) -> DataFrame:
    """The first calendar day on or after each event.

    Series are cut into slots of time.  Within a slot, events and calendar are
    one sorted stream from which the next day is looked up; past a slot's last
    day the first day of the next slot that has one is taken, from a table of
    one row per slot.  No range join arises, and a hot series is many slots.
    """
    names = [c for c in events.columns if c not in by]
    slot = F.floor(F.unix_date("__t") / F.lit(slot_days)).cast("int")
    e = events.select(*by, F.col(event_time).cast("date").alias("__t"), F.lit(0).alias("__k"), F.struct(*names).alias("__row"))
    days = calendar.select(*by, F.col(day).cast("date").alias("__t")).where("__t IS NOT NULL").distinct()
    c = days.withColumns({"__k": F.lit(1), "__row": F.lit(None).cast(e.schema["__row"].dataType)})
    both = e.unionByName(c).withColumn("__s", slot)
    ahead = Window.partitionBy(*by, "__s").orderBy("__t", "__k").rowsBetween(0, Window.unboundedFollowing)
    inside_ = both.withColumn("__in", F.min(F.when(F.col("__k") == 1, F.col("__t"))).over(ahead)).where("__k = 0")
    firsts = days.withColumn("__s", slot).groupBy(*by, "__s").agg(F.min("__t").alias("__first"))
    every = firsts.select(*by, "__s", "__first").unionByName(e.withColumn("__s", slot).select(*by, "__s").distinct().withColumn("__first", F.lit(None).cast("date")))
    every = every.groupBy(*by, "__s").agg(F.min("__first").alias("__first"))
    later = Window.partitionBy(*by).orderBy("__s").rowsBetween(1, Window.unboundedFollowing)
    every = every.select(*by, "__s", F.min("__first").over(later).alias("__next"))
    return inside_.join(every, [*by, "__s"], "left").select(*by, "__row.*", F.coalesce("__in", "__next").alias("next_day"))


def latest_within(events: DataFrame, others: DataFrame, by: Sequence[str], key: str, time: str, other_time: str, before_days: int, after_days: int) -> DataFrame:
    """For each event the latest other date within [time - before, time + after], by day buckets instead of a range join."""
    width = before_days + after_days + 1
    slot = lambda c: F.floor(F.unix_date(c.cast("date")) / F.lit(width)).cast("int")
    o = others.select(*by, F.col(other_time).cast("date").alias("other_date")).where("other_date IS NOT NULL").distinct()
    o = o.withColumn("__s", slot(F.col("other_date")))
    first, last = F.date_sub(F.col(time).cast("date"), before_days), F.date_add(F.col(time).cast("date"), after_days)
    e = events.where(F.col(time).isNotNull()).withColumn("__s", F.explode(F.array_distinct(F.array(slot(first), slot(last)))))
    hit = e.join(o, [*by, "__s"]).where(F.col("other_date").between(first, last))
    return hit.groupBy(*by, key).agg(F.max("other_date").alias("other_date"))


def event_rows(series: DataFrame, events: DataFrame, by: Sequence[str], event: str, anchor: str, days: Sequence[int], value: str) -> DataFrame:
    """Values at trading days around each event's anchor ordinal."""
    spread = events.select(*by, event, anchor, F.explode(F.array(*[F.lit(d) for d in days])).alias("day"))
    return spread.withColumn("ordinal", F.col(anchor) + F.col("day")).join(series.select(*by, "ordinal", value), [*by, "ordinal"]).select(*by, event, "day", value)


def event_curve(rows: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Mean, standard error, count and 95 % bounds of a value by group and day."""
    n = F.count(value)
    sem = F.try_divide(F.stddev_samp(value), F.sqrt(n))
    return rows.groupBy(*group, "day").agg(F.avg(value).alias("mean"), sem.alias("sem"), n.alias("n")).withColumns({"low": F.col("mean") - 1.96 * F.col("sem"), "high": F.col("mean") + 1.96 * F.col("sem")})


def day0_normalised(rows: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """(v - v0) / |v0| against day 0; null when v0 is missing or 0."""
    base = rows.where("day = 0").select(*key, F.col(value).alias("__v0"))
    return rows.join(base, list(key), "left").withColumn("normalised", F.try_divide(F.col(value) - F.col("__v0"), F.nullif(F.abs("__v0"), F.lit(0.0)))).drop("__v0")


def separation(curve: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """|mean of one group - mean of the other| by day."""
    pick = lambda g: F.max(F.when(F.col(group) == g, F.col("mean")))
    return curve.groupBy("day").agg(F.abs(pick(a) - pick(b)).alias("separation"))


def session_of(local: Column, trading: Column) -> Column:
    """non_trading_day, pre_market before 09:30, intraday up to 16:00, else after_hours, of a time on the exchange's clock."""
    minute = F.hour(local) * 60 + F.minute(local) + F.second(local) / 60
    return F.when(~F.coalesce(trading, F.lit(False)), "non_trading_day").when(minute < 570, "pre_market").when(minute <= 960, "intraday").otherwise("after_hours")


def filing_windows(filings: DataFrame, calendar: DataFrame, by: Sequence[str], key: str, accepted: str, day: str, zone: str = "America/New_York") -> DataFrame:
    """``key, filing_window_class, t0, t1, t5`` of each filing by its series' own trading days.

    t1 is the day of a filing before the close of a trading day, else the next
    trading day; t0 is the trading day before t1, t5 the fourth after it.
    Without t0 or t1 the class is null too.  A holiday is any day that the
    calendar lacks.
    """
    local = F.from_utc_timestamp(F.col(accepted), zone)
    days = durable(with_ordinal(calendar.select(*by, F.col(day).cast("date").alias("__d")).where("__d IS NOT NULL").distinct(), by, "__d"))
    f = filings.where(F.col(accepted).isNotNull()).select(*by, key, local.alias("__at"), local.cast("date").alias("__d"))
    f = f.join(days.select(*by, "__d", F.lit(True).alias("__open")), [*by, "__d"], "left").withColumn("__class", session_of(F.col("__at"), F.col("__open")))
    start = F.when(F.col("__class").isin("pre_market", "intraday"), F.col("__d")).otherwise(F.date_add("__d", 1))
    f = as_of_next(f.select(*by, key, "__class", start.alias("__from")), days, by, "__from", "__d").withColumnRenamed("next_day", "t1")
    f = f.join(days.withColumnRenamed("__d", "t1"), [*by, "t1"], "left")
    for name, shift in (("t0", -1), ("t5", 4)):
        f = f.join(days.select(*by, F.col("__d").alias(name), (F.col("ordinal") - shift).alias("ordinal")), [*by, "ordinal"], "left")
    whole = F.col("t0").isNotNull()
    return f.select(*by, key, *[F.when(whole, F.col(c)).alias(n) for c, n in (("__class", "filing_window_class"), ("t0", "t0"), ("t1", "t1"), ("t5", "t5"))])


def against(rows: DataFrame, other: DataFrame, keys: Sequence[str], pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Left join with another series and the differences ``name = own - other's``; null where either is missing."""
    joined = rows.join(other, list(keys), "left")
    return joined.withColumns({name: F.col(own) - F.col(others) for name, (own, others) in pairs.items()})


def filing_returns(windows: DataFrame, stock: DataFrame, benchmark: DataFrame, industry: DataFrame, by: Sequence[str], sector: Sequence[str], day: str) -> DataFrame:
    """Returns, abnormal returns and industry-adjusted figures of each filing's window.

    ``stock`` has ``return_1, return_5, volume, volatility`` by series and day,
    ``benchmark`` has ``returns`` by day, ``industry`` what ``stock`` has, by
    sector and day; ``windows`` has the sector.  Forward returns are read at
    t0, the rest at t1 and t5.
    """

    def at(rows: DataFrame, series: DataFrame, keys: Sequence[str], when: str, columns: dict[str, str]) -> DataFrame:
        side = series.select(*keys, F.col(day).alias(when), *[F.col(c).alias(n) for n, c in columns.items()])
        return rows.join(side, [*keys, when], "left")

    out = windows
    for keys, series, lead in ((by, stock, ""), (sector, industry, "industry_")):
        out = at(out, series, keys, "t0", {f"{lead}r_1d": "return_1", f"{lead}r_5d": "return_5"})
        for when in ("t1", "t5"):
            out = at(out, series, keys, when, {f"{lead}volume_{when}": "volume", f"{lead}volatility_{when}": "volatility"})
    for when, n in (("t1", "1d"), ("t5", "5d")):
        out = at(out, benchmark, [], when, {f"spy_r_{n}": "returns"})
    late = F.col("t5").isNotNull()
    out = out.withColumns({c: F.when(late, F.col(c)) for c in ("r_5d", "industry_r_5d")})
    out = out.withColumns({f"a_{n}": F.col(f"r_{n}") - F.col(f"spy_r_{n}") for n in ("1d", "5d")} | {f"unbiased_a_{n}": F.col(f"r_{n}") - F.col(f"industry_r_{n}") for n in ("1d", "5d")})
    return out.withColumns({f"unbiased_{c}": F.col(c) - F.col(f"industry_{c}") for c in ("volume_t1", "volume_t5", "volatility_t1", "volatility_t5")})


def central_change(series: DataFrame, by: Sequence[str], time: str, value: str, name: str) -> DataFrame:
    """value[t+1] - value[t-1]."""
    w = _within(by)
    return _own(_blocks(series, by, time, 1, 1).withColumn(name, F.lead(value).over(w) - F.lag(value).over(w)))


def forward_mean(series: DataFrame, by: Sequence[str], time: str, value: str, first: int, last: int, name: str) -> DataFrame:
    """Mean of the known values of the rows t+first to t+last."""
    blocks = _blocks(series, by, time, max(0, -first), max(0, last))
    return _own(blocks.withColumn(name, F.avg(value).over(_within(by).rowsBetween(first, last))))


def band(series: DataFrame, by: Sequence[str], time: str, value: str, rows: int) -> DataFrame:
    """Rolling mean and deviation band of the forward-filled value."""
    r = _within(by).rowsBetween(1 - rows, 0)
    mean, sd = F.avg("__f").over(r), F.stddev_samp("__f").over(r)
    return _own(_blocks(series, by, time, rows - 1, 0, value).withColumns({"band_mean": mean, "band_low": mean - sd, "band_high": mean + sd}))


def missing_days(rows: DataFrame, events: DataFrame, key: Sequence[str], days: Sequence[int], value: str) -> DataFrame:
    """Per event how many of the expected days are absent or null."""
    expected = events.select(*key, F.explode(F.array(*[F.lit(d) for d in days])).alias("day"))
    return expected.join(rows.select(*key, "day", value), [*key, "day"], "left").groupBy(*key).agg(F.count_if(F.col(value).isNull()).alias("missing"))


def inside(ordinal: Column, rows: Column, edge: int) -> Column:
    """Whether an anchor has ``edge`` days of its series on both sides."""
    return (ordinal >= edge) & (ordinal < rows - edge)


def shifted_anchor(events: DataFrame, lengths: DataFrame, by: Sequence[str], anchor: str, shift: int, horizon: int) -> DataFrame:
    """Events with their anchor moved by some trading days, kept only where the series goes on for the horizon; ``lengths`` has ``rows`` per series."""
    moved = events.join(lengths, list(by)).withColumn(anchor, F.col(anchor) + shift)
    return moved.where((F.col(anchor) >= 0) & (F.col(anchor) + horizon < F.col("rows"))).drop("rows")
