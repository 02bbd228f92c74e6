"""A mixture of sources at target weights by weighted fair queueing."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..session import durable

#: The split pattern that public byte-pair vocabularies of 50,257 ids come with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def source_name(column: Column) -> Column:
    """Source in lower snake_case, whatever its spelling."""
    name = F.regexp_replace(F.lower(F.trim(column)), r"[\s\-_]+", "_")
    return F.when(name != "", name)


def token_counter(vocabulary: str):
    """Arrow function that counts the tokens of texts under a rank file; null counts 0."""

    @pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encode = tiktoken.Encoding("counter", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for texts in batches:
            yield texts.map(lambda t: len(encode(t)) if t else 0).astype("int64")

    return count


def plan(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: its tokens, its share among the sources that can be had, and its quota.

    The budget is the largest at which no source is repeated more than
    ``max_repeats`` times.  A target source without tokens gets no quota, and
    the others keep their proportions.  One row per target source.
    """
    t = targets.select(source_name(F.col("source")).alias("source"), F.col("target_share").cast("double"), F.greatest(F.col("max_repeats"), F.lit(1)).alias("max_repeats"))
    t = t.where("source IS NOT NULL AND target_share > 0").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    have = t.join(sizes, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    every = Window.partitionBy()
    weight = F.when(F.col("tokens") > 0, F.col("target_share"))
    have = have.withColumn("weight", weight / F.sum(weight).over(every))
    budget = F.floor(F.min(F.col("tokens") * F.col("max_repeats") / F.col("weight")).over(every))
    return have.withColumn("budget", budget).withColumn("quota", F.coalesce(F.col("budget") * F.col("weight"), F.lit(0.0)))


def mix(documents: DataFrame, targets: DataFrame, doc_id: str, source: str, text: str, vocabulary: str, seed: int = 1, bucket_rows: int = 20_000, max_sources: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """The mixture and its shares.

    Mixture: ``doc_id, source, copy, tokens, finish`` in the order of the
    virtual finish time, which is the tokens that the source has sent by the
    end of this document, divided by its weight.  Each pass over a source is
    shuffled anew; the queue is cut where the time reaches the budget, which
    leaves each source short of its quota by less than one document.

    Shares: one row per target source with what was wanted and reached.

    Documents without id, known source or tokens take no part.  Running sums
    go over buckets of about ``bucket_rows`` documents, whose totals are
    summed first, so that no source is sorted in one task.  The targets, which
    are sent to every task, are at most ``max_sources``.
    """
    if targets.limit(max_sources + 1).count() > max_sources:
        raise ValueError(f"more than {max_sources} target sources")
    known = targets.select(source_name(F.col("source")).alias("source")).where("source IS NOT NULL").distinct()
    docs = documents.select(F.col(doc_id).alias("doc_id"), source_name(F.col(source)).alias("source"), F.col(text).alias("__t"))
    docs = docs.join(F.broadcast(known), "source", "left_semi").where("doc_id IS NOT NULL AND __t <> ''")
    docs = durable(docs.select("doc_id", "source", token_counter(vocabulary)("__t").alias("tokens")).where("tokens > 0"))
    sizes = docs.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("documents"))
    quotas = durable(plan(sizes, targets))
    buckets = F.greatest(F.lit(1), F.ceil(F.col("documents") / bucket_rows)).cast("bigint")
    passes = F.ceil(F.col("quota") / F.col("source_tokens")).cast("int")
    small = quotas.where("quota > 0").select("source", "documents", "quota", "weight", "budget", F.col("tokens").alias("source_tokens"))
    copies = docs.join(F.broadcast(small), "source").withColumn("copy", F.explode(F.sequence(F.lit(0), passes - 1)))
    copies = copies.withColumn("__h", F.xxhash64("doc_id", "copy", F.lit(seed))).withColumn("__b", F.pmod(F.col("__h"), buckets))
    inside = Window.partitionBy("source", "copy", "__b").orderBy("__h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("source").orderBy("copy", "__b").rowsBetween(Window.unboundedPreceding, -1)
    sums = copies.groupBy("source", "copy", "__b").agg(F.sum("tokens").alias("__s"))
    sums = sums.select("source", "copy", "__b", F.coalesce(F.sum("__s").over(ahead), F.lit(0)).alias("__before"))
    queue = copies.withColumn("__run", F.sum("tokens").over(inside)).join(sums, ["source", "copy", "__b"])
    finish = (F.col("__before") + F.col("__run")) / F.col("weight")
    mixture = queue.withColumn("finish", finish).where("finish <= budget").select("doc_id", "source", "copy", "tokens", "finish").orderBy("finish", "source", "doc_id")
    taken = mixture.groupBy("source").agg(F.sum("tokens").alias("tokens_taken"), F.max("copy").alias("last_copy"))
    every = Window.partitionBy()
    shares = quotas.join(taken, "source", "left").select(
        "source",
        "target_share",
        F.col("max_repeats").cast("bigint").alias("max_repeats"),
        F.col("tokens").cast("bigint").alias("tokens_available"),
        F.coalesce("tokens_taken", F.lit(0)).cast("bigint").alias("tokens_taken"),
        F.coalesce(F.col("last_copy") + 1, F.lit(0)).cast("bigint").alias("repeats"),
        (F.coalesce("tokens_taken", F.lit(0)) / F.sum("tokens_taken").over(every)).alias("share"),
    )
    return mixture, shares
