"""Predictions against truth: statuses, failure buckets and metrics."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds of relative error in use: what the difference is divided by, and what a zero truth means.
KINDS = ("floored", "absolute_at_zero", "larger", "near_zero_equal")


def relative_error(pred: Column, truth: Column, kind: str = "near_zero_equal") -> Column:
    """Relative error of a prediction; null when either side is null or the kind leaves it undefined."""
    d, t = F.abs(pred - truth), F.abs(truth)
    if kind == "floored":
        return d / F.greatest(t, F.lit(1.0))
    if kind == "absolute_at_zero":
        return F.when(t == 0, F.abs(pred)).otherwise(F.try_divide(d, t))
    if kind == "larger":
        top = F.greatest(t, F.abs(pred))
        return F.when(top == 0, F.lit(0.0)).otherwise(F.try_divide(d, top))
    if kind == "near_zero_equal":
        return F.when(t != 0, F.try_divide(d, t))
    raise ValueError(f"unknown kind {kind}")


def matches(pred: Column, truth: Column, tolerance: float, zero_eps: float = 0.5) -> Column:
    """Whether a prediction counts as the truth: both near zero, or within the tolerance."""
    return F.when(F.abs(truth) < zero_eps, F.abs(pred) < zero_eps).otherwise(relative_error(pred, truth) <= tolerance)


def cell_status(pred: Column, truth: Column, tolerance: float, zero_eps: float = 0.5) -> Column:
    """matched, wrong, missing (truth only), extra (prediction only) or absent."""
    return (
        F.when(truth.isNull() & pred.isNull(), "absent")
        .when(truth.isNull(), "extra")
        .when(pred.isNull(), "missing")
        .when(matches(pred, truth, tolerance, zero_eps), "matched")
        .otherwise("wrong")
    )


def answer_outcome(responded: Column, skipped: Column, found: Column, pred: Column, truth: Column, tolerance: float, zero_eps: float = 0.5) -> Column:
    """matched, wrong, not_found, no_response or skipped, for one answer per question."""
    return (
        F.when(skipped, "skipped")
        .when(~responded, "no_response")
        .when(~found | pred.isNull(), "not_found")
        .when(matches(pred, truth, tolerance, zero_eps), "matched")
        .otherwise("wrong")
    )


def align(truth: DataFrame, pred: DataFrame, keys: Sequence[str], scope: DataFrame | None = None) -> DataFrame:
    """Full outer join of truth and predictions, both within the scope's keys if one is given."""
    if scope is not None:
        truth, pred = (d.join(scope, scope.columns, "left_semi") for d in (truth, pred))
    return truth.join(pred, list(keys), "full")


#: Factors by which a value may be out of scale, in the order tried.
SCALE_FACTORS = (1e3, 1e6, 1e9, 1e-3, 1e-6, 1e-9)


def wrong_bucket(pred: Column, truth: Column, neighbours: Sequence[tuple[int, Column]], tolerance: float, zero_eps: float = 0.5, factors: Sequence[float] = SCALE_FACTORS) -> Column:
    """Why a wrong value is wrong: year_shift(k), sign_error, scale_error(x1ek), scope_factor or other.

    ``neighbours`` are the truths of the years by their distance, tried in
    order.  Values near zero match as everywhere; sign and scale need a truth
    other than zero; the scope factor is a ratio from 0.5 to 2 of either sign.
    """
    close = lambda a, b: F.coalesce(matches(a, b, tolerance, zero_eps), F.lit(False))
    out = F.when(pred.isNull(), "other")
    for k, value in neighbours:
        out = out.when(close(pred, value), f"year_shift({k:+d})")
    known = F.coalesce(truth != 0, F.lit(False))
    out = out.when(known & close(pred, -truth), "sign_error")
    for f in factors:
        out = out.when(known & close(pred, truth * f), f"scale_error(x1e{round(math.log10(f)):+d})")
    return out.when(known & F.abs(F.try_divide(pred, truth)).between(0.5, 2.0), "scope_factor").otherwise("other")


def cell_metrics(scored: DataFrame, by: Sequence[str], status: str = "status", error: str = "rel_error") -> DataFrame:
    """Counts by status, recall, precision and exact median error per group."""
    n = {s: F.count_if(F.col(status) == s) for s in ("matched", "wrong", "missing", "extra")}
    return scored.groupBy(*by).agg(
        *[c.alias(s) for s, c in n.items()],
        F.try_divide(n["matched"], n["matched"] + n["wrong"] + n["missing"]).alias("recall"),
        F.try_divide(n["matched"], n["matched"] + n["wrong"]).alias("precision"),
        F.median(error).alias("median_error"),
    )


def answer_metrics(scored: DataFrame, slices: Sequence[Sequence[str]], outcome: str = "outcome", strict: str | None = None, error: str | None = None) -> DataFrame:
    """Accuracy, attempt rate and precision when found over several slices in one pass.

    ``slices`` are grouping sets; the empty one is the overall row.  Answers
    skipped or without response are no part of the denominators.  ``strict``
    is a flag of answers within the strict tolerance; ``error`` the relative
    error, whose exact median is taken over the answers given.
    """
    columns = list(dict.fromkeys(c for s in slices for c in s))
    is_ = lambda *x: F.count_if(F.col(outcome).isin(*x))
    judged = is_("matched", "wrong", "not_found")
    more = []
    if strict is not None:
        more.append(F.try_divide(F.count_if(F.coalesce(F.col(strict), F.lit(False))), judged).alias("accuracy_strict"))
    if error is not None:
        more.append(F.median(F.when(F.col(outcome).isin("matched", "wrong"), F.abs(error))).alias("median_error"))
    return scored.groupingSets([[F.col(c) for c in s] for s in slices], *columns).agg(
        judged.alias("judged"),
        is_("matched").alias("matched"),
        F.try_divide(is_("matched"), judged).alias("accuracy"),
        F.try_divide(is_("matched", "wrong"), judged).alias("attempt_rate"),
        F.try_divide(is_("matched"), is_("matched", "wrong")).alias("precision_when_found"),
        *more,
    )


def pending(work: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Work without a finished record."""
    return work.join(done.select(*keys).distinct(), list(keys), "left_anti")


def greedy_prefix(groups: DataFrame, size: str, order: Sequence[Column], target: int) -> DataFrame:
    """Groups taken in order until their sizes reach the target; ``taken`` truncates the last.

    Every group has at least one member, so the first ``target`` groups are
    enough, and only they are summed up in one task.
    """
    head = groups.where(F.col(size) > 0).orderBy(*order).limit(target)
    before = F.coalesce(F.sum(size).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return head.withColumn("__before", before).where(F.col("__before") < target).withColumn("taken", F.least(F.col(size), target - F.col("__before"))).drop("__before")


def prefill_savings(asked: DataFrame, group: str, tokens: str) -> DataFrame:
    """Tokens read when each document is read once, or once per question."""
    per = asked.groupBy(group).agg(F.max(tokens).alias("t"), F.count(F.lit(1)).alias("q"))
    return per.agg(F.sum("t").alias("cached_tokens"), F.sum(F.col("t") * F.col("q")).alias("uncached_tokens"))
