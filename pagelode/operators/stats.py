"""Outliers, clipping, fits, ranks, agreement and samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def iqr_outliers(df: DataFrame, by: Sequence[str], value: str, k: float = 1.5) -> DataFrame:
    """Rows outside [q1 - k*iqr, q3 + k*iqr] of their group."""
    q = df.groupBy(*by).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.75))).alias("__q"))
    low, high = F.col("__q")[0], F.col("__q")[1]
    return df.join(q, list(by)).where((F.col(value) < low - k * (high - low)) | (F.col(value) > high + k * (high - low))).drop("__q")


def clipped(df: DataFrame, by: Sequence[str], value: str, low: float, high: float) -> DataFrame:
    """Rows within the group's quantiles, ends included."""
    q = df.groupBy(*by).agg(F.percentile(value, F.array(F.lit(low), F.lit(high))).alias("__q"))
    return df.join(q, list(by)).where(F.col(value).between(F.col("__q")[0], F.col("__q")[1])).drop("__q")


def ols(df: DataFrame, by: Sequence[str], x: str, y: str, least: int = 2) -> DataFrame:
    """Slope, intercept, r2, Pearson r and the residuals' population deviation per group with enough pairs."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    out = both.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.corr(x, y).alias("r"), F.stddev_pop(y).alias("__s")
    )
    return out.where(F.col("n") >= least).withColumn("residual_sd", F.col("__s") * F.sqrt(F.greatest(1 - F.col("r2"), F.lit(0.0)))).drop("__s")


def residuals(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """y less its linear fit on x, per group."""
    fit = ols(df, by, x, y).select(*by, "slope", "intercept")
    keys = list(by) or ["__all"]
    if not by:
        df, fit = df.withColumn("__all", F.lit(0)), fit.withColumn("__all", F.lit(0))
    joined = df.join(fit, keys).drop("__all")
    return joined.withColumn("residual", F.col(y) - F.col("intercept") - F.col("slope") * F.col(x))


def average_rank(df: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    """Rank with ties averaged, from counts of the distinct values."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__c"))
    run = F.sum("__c").over(Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ranks = counts.select(*by, value, (run - (F.col("__c") - 1) / 2).alias(name))
    return df.join(ranks, [*by, value])


def spearman(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Correlation of average ranks, over the pairs without nulls."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = average_rank(average_rank(both, by, x, "__rx"), by, y, "__ry")
    return ranked.groupBy(*by).agg(F.corr("__rx", "__ry").alias("spearman"), F.count(F.lit(1)).alias("n"))


def three_classes(value: Column, threshold: float) -> Column:
    return F.when(value > threshold, 1).when(value < -threshold, -1).when(value.isNotNull(), 0)


def quantile_labels(df: DataFrame, by: Sequence[str], value: str, share: float) -> DataFrame:
    """Top and bottom quantile flags, cutoffs included."""
    q = df.groupBy(*by).agg(F.percentile(value, F.array(F.lit(share), F.lit(1 - share))).alias("__q"))
    return df.join(q, list(by)).withColumns({"bottom": F.col(value) <= F.col("__q")[0], "top": F.col(value) >= F.col("__q")[1]}).drop("__q")


def class_baseline(df: DataFrame, by: Sequence[str], label: str) -> DataFrame:
    """Number of classes, the smallest class and the accuracy of always guessing the largest."""
    counts = df.where(F.col(label).isNotNull()).groupBy(*by, label).agg(F.count(F.lit(1)).alias("__c"))
    return counts.groupBy(*by).agg(F.count(F.lit(1)).alias("classes"), F.min("__c").alias("smallest"), (F.max("__c") / F.sum("__c")).alias("baseline"))


def vote_counts(votes: DataFrame, item: Sequence[str], label: str) -> DataFrame:
    """Votes per item and label."""
    return votes.where(F.col(label).isNotNull()).groupBy(*item, label).agg(F.count(F.lit(1)).alias("c"))


def majority(votes: DataFrame, item: Sequence[str], label: str) -> DataFrame:
    """The label with more than half of an item's votes, else null."""
    best = vote_counts(votes, item, label).groupBy(*item).agg(F.sum("c").alias("votes"), F.max(F.struct("c", label)).alias("b"))
    return best.select(*item, "votes", F.when(2 * F.col("b.c") > F.col("votes"), F.col(f"b.{label}")).alias("majority"))


def pairwise_agreement(votes: DataFrame, item: Sequence[str], label: str) -> DataFrame:
    """Share of agreeing pairs of votes among all pairs on the same item: one row."""
    per = vote_counts(votes, item, label).groupBy(*item).agg(F.sum("c").alias("n"), F.sum(F.col("c") * (F.col("c") - 1)).alias("a"))
    return per.agg((F.sum("a") / 2).cast("bigint").alias("agreeing"), (F.sum(F.col("n") * (F.col("n") - 1)) / 2).cast("bigint").alias("pairs")).withColumn("agreement", F.try_divide("agreeing", "pairs"))


def fleiss_kappa(votes: DataFrame, item: Sequence[str], label: str, raters: int) -> DataFrame:
    """Fleiss' kappa over the items with exactly ``raters`` votes; null if chance agreement is 1."""
    counts = vote_counts(votes, item, label)
    full = counts.groupBy(*item).agg(F.sum("c").alias("n"), F.sum(F.col("c") * (F.col("c") - 1)).alias("a")).where(F.col("n") == raters)
    shares = counts.join(full.select(*item), list(item), "left_semi").groupBy(label).agg(F.sum("c").alias("c"))
    chance = shares.agg(F.lit(0).alias("__all"), (F.sum(F.col("c") * F.col("c")) / F.pow(F.sum("c"), F.lit(2))).alias("pe"))
    seen = full.agg(F.lit(0).alias("__all"), F.count(F.lit(1)).alias("items"), F.avg(F.col("a") / (raters * (raters - 1))).alias("p"))
    return seen.join(chance, "__all").select("items", F.when(F.abs(1 - F.col("pe")) > 1e-12, (F.col("p") - F.col("pe")) / (1 - F.col("pe"))).alias("kappa"))


def cohen_kappa(pairs: DataFrame, by: Sequence[str], a: str, b: str, categories: Sequence[str], weights: str = "none") -> DataFrame:
    """Cohen's kappa of two raters: unweighted, linear or quadratic in the categories' order."""
    n = len(categories)
    place = lambda c: F.array_position(F.array(*[F.lit(x) for x in categories]), F.col(c)) - 1
    known = pairs.where(F.col(a).isin(*categories) & F.col(b).isin(*categories)).select(*by, place(a).alias("i"), place(b).alias("j"))
    d = lambda i, j: {"none": (F.lit(i) != F.lit(j)).cast("double"), "linear": F.abs(F.lit(i) - F.lit(j)).cast("double"), "quadratic": F.pow(F.lit(float(i - j)), F.lit(2))}[weights]
    far = {"none": (F.col("i") != F.col("j")).cast("double"), "linear": F.abs(F.col("i") - F.col("j")).cast("double"), "quadratic": F.pow(F.col("i") - F.col("j"), F.lit(2))}[weights]
    one = known.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(far).alias("o"), *[F.count_if(F.col("i") == k).alias(f"a{k}") for k in range(n)], *[F.count_if(F.col("j") == k).alias(f"b{k}") for k in range(n)])
    expected = sum((d(i, j) * F.col(f"a{i}") * F.col(f"b{j}") for i in range(n) for j in range(n)), F.lit(0.0)) / F.col("n")
    return one.select(*by, "n", (1 - F.try_divide(F.col("o"), expected)).alias("kappa"))


def confusion(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def hash_sample(df: DataFrame, key: str, k: int, seed: int = 0) -> DataFrame:
    """k rows drawn uniformly by the order of a seeded hash; the same rows for the same seed."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(k)


def stratified_sample(df: DataFrame, stratum: str, order: Sequence[Column], k: int) -> DataFrame:
    """k rows shared out in proportion to the strata, the largest remainders rounded up."""
    counts = df.where(F.col(stratum).isNotNull()).groupBy(stratum).agg(F.count(F.lit(1)).alias("__n"))
    every = Window.partitionBy()
    exact = F.lit(k) * F.col("__n") / F.sum("__n").over(every)
    base = counts.withColumn("__base", F.least(F.floor(exact), F.col("__n"))).withColumn("__rest", exact - F.floor(exact))
    nth = F.row_number().over(Window.partitionBy().orderBy(F.col("__rest").desc(), stratum))
    quota = base.withColumn("__take", F.col("__base") + F.when(nth <= k - F.sum("__base").over(every), 1).otherwise(0)).select(stratum, "__take")
    ranked = df.withColumn("__i", F.row_number().over(Window.partitionBy(stratum).orderBy(*order)))
    return ranked.join(F.broadcast(quota), stratum).where(F.col("__i") <= F.col("__take")).drop("__i", "__take")


def balanced_slots(items: DataFrame, key: str, slots: int, overlap_share: float = 0.2, votes: int = 3) -> DataFrame:
    """Items shared out to slots evenly; a share of them goes to ``votes`` neighbouring slots for agreement.

    An item's slot follows from its rank in the order of a hash of its key, so
    the slots' sizes differ by at most one before the shared items and the
    share is met to one item; no item list is held in one task.
    """
    rank = F.col("__rank")
    ranked = spread_rank(items.withColumn("__all", F.lit(0)), ["__all"], F.xxhash64(key), key, "__rank")
    slot = (rank % slots).cast("int")
    shared = F.floor((rank + 1) * overlap_share + 1e-9) > F.floor(rank * overlap_share + 1e-9)
    targets = F.when(shared, F.transform(F.sequence(F.lit(0), F.lit(votes - 1)), lambda d: (slot + d) % slots)).otherwise(F.array(slot))
    return ranked.withColumn("expected_votes", F.size(targets)).withColumn("slot", F.explode(targets)).drop("__all", "__rank")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows, repeats counted."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def off_by(pairs: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Of two grades per row: how often equal, one apart, two or more apart, and which is higher."""
    d = F.col(a) - F.col(b)
    return pairs.where(d.isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(d == 0).alias("exact"), F.count_if(F.abs(d) == 1).alias("off_by_1"), F.count_if(F.abs(d) >= 2).alias("off_by_2"), F.count_if(d > 0).alias("a_higher"), F.count_if(d < 0).alias("b_higher"))


def best_per_cell(rows: DataFrame, cell: Sequence[str], method: str, metric: str, baseline: str) -> DataFrame:
    """The best metric of a grid cell, its method (ties: the smaller name), the best baseline and the gain; NaN counts as missing."""
    clean = lambda c: F.when(~F.isnan(c), F.col(c))
    best = F.min(F.when(clean(metric).isNotNull(), F.struct((-clean(metric)).alias("m"), F.col(method).alias("w"))))
    out = rows.groupBy(*cell).agg(best.alias("b"), F.max(clean(baseline)).alias("baseline"))
    return out.select(*cell, (-F.col("b.m")).alias("best"), F.col("b.w").alias("method"), "baseline", (-F.col("b.m") - F.col("baseline")).alias("gain"))


def means_by_class(rows: DataFrame, label: str, day: str, values: Sequence[str], last: int = 5) -> DataFrame:
    """Means per class over all days, and over days 0 to ``last``, both ends included."""
    near = F.col(day).between(0, last)
    return rows.groupBy(label).agg(*[F.avg(v).alias(f"mean_{v}") for v in values], *[F.avg(F.when(near, F.col(v))).alias(f"window_{v}") for v in values], F.count(F.lit(1)).alias("n"))


def labelled_ratio(rows: DataFrame, entity: str, labelled: str, value: str) -> DataFrame:
    """Mean of the entities' means with and without label, and their ratio: one row."""
    own = rows.groupBy(entity, labelled).agg(F.avg(value).alias("__m"))
    part = lambda flag: F.avg(F.when(F.col(labelled) == flag, F.col("__m")))
    return own.agg(part(True).alias("labelled"), part(False).alias("unlabelled")).withColumn("ratio", F.try_divide("labelled", "unlabelled"))


def threshold_labels(rows: DataFrame, value: str, threshold: float, least: int = 5) -> tuple[DataFrame, DataFrame]:
    """Rows labelled -1, 0, 1 by a threshold either way, and one row of counts with the reason to skip the cell, if a class has too few."""
    label = F.when(F.col(value) > threshold, 1).when(F.col(value) < -threshold, -1).otherwise(0)
    labelled = rows.where(F.col(value).isNotNull()).withColumn("label", label)
    counts = labelled.agg(*[F.count_if(F.col("label") == k).alias(n) for k, n in ((-1, "negative"), (0, "neutral"), (1, "positive"))])
    few = F.least("negative", "neutral", "positive") < least
    return labelled, counts.withColumn("skip_reason", F.when(few, F.lit(f"a class has fewer than {least} rows")))


def spread_rank(rows: DataFrame, by: Sequence[str], order: Column, key: str, name: str) -> DataFrame:
    """Rank from 0 within a group by a hash order, with no group in one task.

    The upper ten bits of the hash cut each group into 1024 parts; ranks count
    within the parts, and the parts' sizes are summed up before them.
    """
    cut = rows.withColumns({"__h": order, "__b": F.shiftright(order, 54)})
    sizes = cut.groupBy(*by, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*by, "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inner = F.row_number().over(Window.partitionBy(*by, "__b").orderBy("__h", key)) - 1
    return cut.withColumn("__i", inner).join(sizes, [*by, "__b"]).withColumn(name, F.col("__before") + F.col("__i")).drop("__h", "__b", "__i", "__before")
