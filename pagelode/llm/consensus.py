"""Consensus of annotators who disagree: a variational confusion model.

Items have a true label with a Dirichlet-distributed class prior; each
annotator has a confusion row per true label with a Dirichlet prior.  The
mean-field updates are group-bys: the posterior of an item sums the expected
log likelihoods of its votes (digammas of the class counts and of the
annotators' rows), and the rows of an annotator sum the posteriors of the
items voted on.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable, epoch_us


def digamma(x: Column) -> Column:
    """Derivative of the log gamma function for x > 0, from its asymptotic series at x + 6."""
    y = x + 6
    series = F.log(y) - 1 / (2 * y) - 1 / (12 * y * y) + 1 / (120 * F.pow(y, F.lit(4))) - 1 / (252 * F.pow(y, F.lit(6)))
    return series - sum((1 / (x + i) for i in range(1, 6)), 1 / x)


def digamma_of(x: float) -> float:
    """The same of a number."""
    y = x + 6
    return math.log(y) - 1 / (2 * y) - 1 / (12 * y**2) + 1 / (120 * y**4) - 1 / (252 * y**6) - sum(1 / (x + i) for i in range(6))


def label_name(column: Column) -> Column:
    """Label in lower snake_case."""
    return F.regexp_replace(F.lower(F.trim(column)), r"[\s\-_]+", "_")


def counted_votes(votes: DataFrame, annotator: str, item: str, label: str, time: str, labels: Sequence[str]) -> DataFrame:
    """One vote per annotator and item: the latest, whatever it is, if its label is among ``labels``.

    Ties in time go to the larger label.  Rows without annotator, item or time
    don't count; repeated rows count once.
    """
    rows = votes.select(
        F.col(annotator).alias("annotator"), F.col(item).alias("item"), F.struct(epoch_us(votes, time).alias("t"), label_name(F.col(label)).alias("label")).alias("vote")
    ).where("annotator IS NOT NULL AND item IS NOT NULL AND vote.t IS NOT NULL")
    last = rows.groupBy("annotator", "item").agg(F.max("vote")["label"].alias("label"))
    return last.where(F.col("label").isin(*labels))


@dataclass
class Consensus:
    """``items``: label, confidence, votes and agreement; ``annotators``: reliability with its interval; ``summary``: one row."""

    items: DataFrame
    annotators: DataFrame
    summary: DataFrame


def consensus(
    votes: DataFrame, labels: Sequence[str], row_prior: float = 0.5, class_prior: float = 1.0, rounds: int = 25, tolerance: float = 1e-3, z: float = 3.0, broadcast_annotators: int = 200_000, hot_share: float = 1e-3, hot_least: int = 100_000
) -> Consensus:
    """Fit the model to votes of ``annotator, item, label`` (one per annotator and item).

    Reliability of an annotator is the mean, over pairs of labels weighted by
    how common they are, of the difference that the true label makes to the
    vote: 1 for perfect votes, 0 for votes unrelated to the truth, negative
    for opposed ones.  Leniency, strictness and hesitation leave it positive.
    Its distribution is the fitted posterior of the annotator's rows, whose
    prior of ``row_prior`` a cell leans neither way; majorities, with which
    the fit begins, tell the labels apart.  ``low`` and ``high`` are the
    posterior's quantiles that lie ``z`` deviations out on a normal scale,
    from its first three cumulants.  An item's label with equal posteriors is
    the first of ``labels``.  No votes give empty items and annotators.

    The votes are laid out by item once, and every round passes over them once
    and sends the annotators' partial sums only.  An item with more than
    ``hot_share`` of all votes (and ``hot_least``) is split by annotator; at
    most 1/``hot_share`` items are.  Beliefs about up to
    ``broadcast_annotators`` annotators are broadcast; beyond, they are joined.
    """
    k = range(len(labels))
    number = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("label")).cast("int") - 1
    votes = durable(votes.select(F.xxhash64("annotator").alias("a"), F.xxhash64("item").alias("i"), number.alias("l"), "annotator", "item"))
    names = votes.groupBy("a").agg(F.min("annotator").alias("annotator"), F.count(F.lit(1)).alias("n"))
    per_item = votes.groupBy("i").agg(F.min("item").alias("item"), F.count(F.lit(1)).alias("votes"), *[F.count_if(F.col("l") == c).alias(f"v{c}") for c in k])
    size = votes.count()
    small = names.count() <= broadcast_annotators
    hot = [r.i for r in votes.groupBy("i").count().where(F.col("count") > max(hot_least, hot_share * size)).select("i").collect()]
    group = ["i", "s"] if hot else ["i"]
    part = F.when(F.col("i").isin(hot), F.pmod(F.xxhash64("a", "i"), F.lit(256)).cast("int")).otherwise(0) if hot else F.lit(0)
    parts = int(votes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = votes.select("a", "i", "l", part.alias("s")).select("a", "i", "l", *group[1:]).repartition(parts, *group).sortWithinPartitions(*group).persist(StorageLevel.MEMORY_AND_DISK)
    own = Window.partitionBy(*group)

    def posteriors(scores: DataFrame, prior: Sequence[float]) -> DataFrame:
        """Every vote with the posterior ``q`` of its item, from the votes' ``s0, s1, ...``, and its share ``w`` of the item's votes."""
        summed = scores.select("a", *group, "l", F.count(F.lit(1)).over(own).alias("m"), *[F.sum(f"s{c}").over(own).alias(f"t{c}") for c in k])
        if hot:
            totals = scores.where(F.col("i").isin(hot)).groupBy("i").agg(F.count(F.lit(1)).alias("hm"), *[F.sum(f"s{c}").alias(f"h{c}") for c in k])
            summed = summed.join(F.broadcast(totals), "i", "left").withColumns({"m": F.coalesce("hm", "m")} | {f"t{c}": F.coalesce(f"h{c}", f"t{c}") for c in k})
        log = {c: F.col(f"t{c}") + prior[c] for c in k}
        top = F.greatest(*log.values())
        total = sum((F.exp(v - top) for v in log.values()), F.lit(0.0))
        return summed.select("a", "i", "l", (1 / F.col("m")).alias("w"), *[(F.exp(log[c] - top) / total).alias(f"q{c}") for c in k])

    # before the first round, a vote for a label speaks for it
    scored, prior = laid.select("a", *group, "l", *[F.when(F.col("l") == c, 1.0).otherwise(0.0).alias(f"s{c}") for c in k]), [0.0 for _ in k]
    before: list[float] | None = None
    for _ in range(rounds):
        voted = posteriors(scored, prior)
        counts = voted.groupBy("a").agg(*[F.sum(F.when(F.col("l") == v, F.col(f"q{c}")).otherwise(0.0)).alias(f"n{c}{v}") for c in k for v in k], *[F.sum(F.col(f"q{c}") * F.col("w")).alias(f"c{c}") for c in k])
        counts = durable(counts)
        sums = counts.agg(*[F.sum(x).alias(x) for x in counts.columns if x != "a"]).first()
        mass = [sum((sums[f"n{c}{v}"] or 0.0) for v in k) for c in k]
        shown = [class_prior + (sums[f"c{c}"] or 0.0) for c in k]  # an item counts once, however many votes it has
        weight = [x / sum(shown) for x in shown]
        prior = [digamma_of(x) - digamma_of(sum(shown)) for x in shown]
        right = sum((sums[f"n{c}{c}"] or 0.0) for c in k) / max(sum(mass), 1e-9)
        cell = {(c, v): F.col(f"n{c}{v}") + row_prior for c in k for v in k}
        rows = {c: sum((cell[c, v] for v in k), F.lit(0.0)) for c in k}
        beliefs = counts.select("a", *[(digamma(cell[c, v]) - digamma(rows[c])).alias(f"e{c}{v}") for c in k for v in k])
        joined = laid.join(F.broadcast(beliefs) if small else beliefs, "a")
        scored = joined.select("a", *group, "l", *[F.coalesce(*[F.when(F.col("l") == v, F.col(f"e{c}{v}")) for v in k]).alias(f"s{c}") for c in k])
        state = [*weight, right]
        if before is not None and max(abs(x - y) for x, y in zip(state, before)) < tolerance:
            break
        before = state
    laid.unpersist()

    q = posteriors(scored, prior).groupBy("i").agg(*[F.max(f"q{c}").alias(f"q{c}") for c in k])
    best = F.greatest(*[F.col(f"q{c}") for c in k])
    pick = F.coalesce(*[F.when(F.col(f"q{c}") == best, F.lit(labels[c])) for c in k])
    agreeing = sum((F.col(f"v{c}") * (F.col(f"v{c}") - 1) for c in k), F.lit(0))
    rated = per_item.withColumn("agreement", F.try_divide(agreeing, F.col("votes") * (F.col("votes") - 1)))
    items = rated.join(q, "i").select("item", pick.alias("label"), best.alias("confidence"), "votes", "agreement")

    mean = {(c, v): cell[c, v] / rows[c] for c in k for v in k}
    pairs = [(c, d, weight[c] * weight[d]) for c in k for d in k if c < d]
    scale = sum(w for *_, w in pairs) * 2
    contrast = {c: [0.0] * len(labels) for c in k}
    for c, d, w in pairs:
        contrast[c][c] += w / scale
        contrast[c][d] -= w / scale
        contrast[d][d] += w / scale
        contrast[d][c] -= w / scale
    centre = {c: sum((contrast[c][v] * mean[c, v] for v in k), F.lit(0.0)) for c in k}
    spread = {c: [contrast[c][v] - centre[c] for v in k] for c in k}
    # cumulants of a linear combination of independent Dirichlet rows
    variance = sum((sum((mean[c, v] * spread[c][v] ** 2 for v in k), F.lit(0.0)) / (rows[c] + 1) for c in k), F.lit(0.0))
    third = sum((2 * sum((mean[c, v] * spread[c][v] ** 3 for v in k), F.lit(0.0)) / ((rows[c] + 1) * (rows[c] + 2)) for c in k), F.lit(0.0))
    reliability = sum(centre.values(), F.lit(0.0))
    sd = F.sqrt(variance)
    lean = third / (variance * sd) * (z * z - 1) / 6
    accuracy = sum((weight[c] * mean[c, c] for c in k), F.lit(0.0))
    confusion = F.array(*[F.array(*[mean[c, v] for v in k]) for c in k])
    annotators = counts.join(names, "a").select(
        "annotator", F.col("n").alias("votes"), accuracy.alias("accuracy"), reliability.alias("reliability"), (reliability + sd * (lean - z)).alias("low"), (reliability + sd * (lean + z)).alias("high"), confusion.alias("confusion")
    )
    return Consensus(items, annotators, krippendorff(per_item, [f"v{c}" for c in k]))


def krippendorff(counts: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nominal alpha from the items' votes by label: one row of ``items, votes, alpha``.

    Items with one vote don't count; alpha is null when nothing can be paired
    or all votes are alike.
    """
    m = sum((F.col(c) for c in columns), F.lit(0))
    paired = counts.where(m >= 2)
    inside = sum((F.col(c) * (m - F.col(c)) for c in columns), F.lit(0)) / (m - 1)
    one = paired.agg(F.count(F.lit(1)).alias("items"), F.sum(m).cast("bigint").alias("votes"), F.sum(inside).alias("observed"), *[F.sum(c).alias(f"t{c}") for c in columns])
    n = F.col("votes")
    expected = sum((F.col(f"t{c}") * (n - F.col(f"t{c}")) for c in columns), F.lit(0)) / (n - 1)
    return one.select("items", F.coalesce(n, F.lit(0)).alias("votes"), (1 - F.try_divide(F.col("observed"), expected)).alias("alpha"))
