"""Ranking pages for questions, and measuring rankings."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, FloatType

STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with")


def terms(text: Column, stopwords: Sequence[str] = STOPWORDS) -> Column:
    """Lower-case words of letters and digits without stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(*stopwords)) if stopwords else words


def bm25(documents: DataFrame, questions: DataFrame, doc: str, text: str, question: str, query: str, scope: Sequence[str] = (), k1: float = 0.9, b: float = 0.4) -> DataFrame:
    """BM25 scores of all pairs of question and document that share a term.

    With ``scope`` columns, which both sides have, documents are ranked within
    the scope and its statistics only.  Document lengths and frequencies are
    taken over all documents; postings are made only for the questions' terms.
    Terms repeated in a question count once each time.  Documents without any
    term count with length 0.
    """
    keys = list(scope) or ["__all"]
    if not scope:
        documents, questions = (d.withColumn("__all", F.lit(0)) for d in (documents, questions))
    asked = questions.select(*keys, question, F.explode(terms(F.col(query))).alias("term")).groupBy(*keys, question, "term").agg(F.count(F.lit(1)).alias("qf"))
    words = documents.where(F.col(text).isNotNull()).select(*keys, doc, terms(F.col(text)).alias("__w"))
    stats = words.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.avg(F.size("__w")).alias("__avg"))
    wanted = asked.select(*keys, "term").distinct()
    postings = words.select(*keys, doc, F.size("__w").alias("__dl"), F.explode("__w").alias("term")).join(wanted, [*keys, "term"], "left_semi")
    tf = postings.groupBy(*keys, doc, "__dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("df"))
    with_stats = df.join(stats, keys)
    idf = F.log(1 + (F.col("__n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = asked.join(with_stats, [*keys, "term"]).select(*keys, question, "term", "qf", idf.alias("idf"), "__avg")
    scored = tf.join(weights, [*keys, "term"])
    part = F.col("qf") * F.col("idf") * F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("__dl") / F.col("__avg")))
    return scored.groupBy(*keys, question, doc).agg(F.sum(part).alias("score")).select(*scope, question, doc, "score")


def top_k(scored: DataFrame, by: Sequence[str], score: str, doc: str, k: int) -> DataFrame:
    """The k best per group with their rank from 1; ties go to the smaller id."""
    order = Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(doc))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def sparse_dot(a: Column, b: Column) -> Column:
    """Dot product of two term-weight maps."""
    return F.aggregate(F.map_keys(a), F.lit(0.0), lambda s, k: s + F.coalesce(F.try_element_at(a, k) * F.try_element_at(b, k), F.lit(0.0)))


def ranking_metrics(run: DataFrame, qrels: DataFrame, question: str, doc: str, k: int = 10) -> DataFrame:
    """Recall, reciprocal rank, precision, average precision, success and nDCG at k for every judged question.

    The ideal ranking is over the judged documents; gain is the grade.
    Questions without a relevant document are left out.
    """
    # the ideal gain needs only how often each grade was given: places are filled from the highest grade down
    reach = F.array(*[F.lit(sum(1 / math.log2(i + 2) for i in range(n))) for n in range(k + 1)])
    counts = qrels.where("relevance > 0").groupBy(question, "relevance").agg(F.count(F.lit(1)).alias("n"))
    above = Window.partitionBy(question).orderBy(F.desc("relevance")).rowsBetween(Window.unboundedPreceding, -1)
    start = F.least(F.coalesce(F.sum("n").over(above), F.lit(0)), F.lit(k))
    filled = counts.select(question, "relevance", "n", start.cast("int").alias("lo")).withColumn("hi", F.least(F.col("lo") + F.col("n"), F.lit(k)).cast("int"))
    judged = filled.groupBy(question).agg(F.sum("n").alias("n_rel"), F.sum(F.col("relevance") * (F.get(reach, F.col("hi")) - F.get(reach, F.col("lo")))).alias("ideal"))
    ideal = F.col("ideal")
    hits = run.where(F.col("rank") <= k).join(qrels.where("relevance > 0").select(question, doc, "relevance"), [question, doc])
    nth = F.row_number().over(Window.partitionBy(question).orderBy("rank"))
    found = hits.withColumn("__i", nth).groupBy(question).agg(
        F.count(F.lit(1)).alias("__hits"), F.min("rank").alias("__first"), F.sum(F.col("__i") / F.col("rank")).alias("__ap"), F.sum(F.col("relevance") / F.log2(F.col("rank") + F.lit(1.0))).alias("__dcg")
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return judged.join(found, question, "left").select(
        question,
        zero(F.col("__hits") / F.col("n_rel")).alias("recall"),
        zero(1 / F.col("__first")).alias("rr"),
        zero(F.col("__hits") / F.lit(k)).alias("precision"),
        zero(F.col("__ap") / F.col("n_rel")).alias("ap"),
        F.when(F.col("__hits") > 0, 1.0).otherwise(0.0).alias("success"),
        zero(F.col("__dcg") / ideal).alias("ndcg"),
    )


def in_blocks(queries: DataFrame, key: str, size: int) -> list[DataFrame]:
    """A stated query set cut into blocks of at most about ``size`` rows by hash, small enough to be sent to every task."""
    n = -(-queries.count() // max(size // 2, 1))
    return [queries.where(F.pmod(F.xxhash64(key), F.lit(n)) == i) for i in range(n)]


def cosine_top(vectors: DataFrame, queries: DataFrame, vec_id: str, vector: str, k: int, block: int = 2048) -> DataFrame:
    """For a stated set of query vectors the k nearest of all vectors by cosine, itself left out.

    Blocks of queries meet blocks of all vectors as matrix products; each
    product keeps its k best per query, and these are merged.  Vectors that
    are null take no part.
    """
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30)
    near = None
    for part in in_blocks(queries.where(F.col(vector).isNotNull()), vec_id, 2 * block):
        rows = part.select(vec_id, vector).limit(8 * block + 1).collect()
        if len(rows) > 8 * block:
            raise ValueError("a block of queries is too large")
        if rows:
            one = vectors.select(vec_id, vector).mapInPandas(_nearest(rows, unit, vec_id, vector, k, block), "query_id bigint, neighbour_id bigint, cosine double")
            near = one if near is None else near.unionByName(one)
    if near is None:
        near = vectors.sparkSession.createDataFrame([], "query_id bigint, neighbour_id bigint, cosine double")
    return top_k(near, ["query_id"], "cosine", "neighbour_id", k)


def _nearest(rows, unit, vec_id: str, vector: str, k: int, block: int):
    ids = np.array([r[0] for r in rows], np.int64)
    q = unit(np.array([r[1] for r in rows], np.float64))

    def work(batches):
        for batch in batches:
            batch = batch[batch[vector].notna()]
            for lo in range(0, len(batch), block):
                part = batch.iloc[lo : lo + block]
                own = part[vec_id].to_numpy()
                sim = q @ unit(np.stack(part[vector].to_numpy()).astype(np.float64)).T
                sim[ids[:, None] == own[None, :]] = -np.inf
                n = min(k, sim.shape[1])
                kth = np.partition(sim, -n, axis=1)[:, -n]
                i, j = np.nonzero((sim >= kth[:, None]) & (sim > -np.inf))
                yield pd.DataFrame({"query_id": ids[i], "neighbour_id": own[j], "cosine": sim[i, j]})

    return work


def max_sim_top(vectors: DataFrame, queries: DataFrame, vec_id: str, tokens: str, k: int, block: int = 256) -> DataFrame:
    """For a stated set of queries the k best other rows by late interaction.

    The queries go in blocks of a checked size, and each block meets all rows
    in one product a batch.  Rows or queries without tokens score 0.
    """
    best = None
    for part in in_blocks(queries.where(F.col(tokens).isNotNull()), vec_id, block):
        rows = part.select(vec_id, tokens).limit(8 * block + 1).collect()
        if len(rows) > 8 * block:
            raise ValueError("a block of queries is too large")
        if rows:
            one = vectors.select(vec_id, tokens).mapInPandas(_interacting(rows, vec_id, tokens, k), f"query_id bigint, {vec_id} bigint, score double")
            best = one if best is None else best.unionByName(one)
    if best is None:
        best = vectors.sparkSession.createDataFrame([], f"query_id bigint, {vec_id} bigint, score double")
    return top_k(best, ["query_id"], "score", vec_id, k)


def _interacting(rows, vec_id: str, tokens: str, k: int):
    ids = np.array([r[0] for r in rows], np.int64)
    asked = [np.array(r[1], np.float64) for r in rows]
    full = [i for i, q in enumerate(asked) if len(q)]
    stacked = np.concatenate([asked[i] for i in full]) if full else None
    starts = np.cumsum([0, *[len(asked[i]) for i in full[:-1]]]) if full else None

    def work(batches):
        for batch in batches:
            batch = batch[batch[tokens].notna()]
            own = batch[vec_id].to_numpy()
            held = [np.stack(d).astype(np.float64) if len(d) else np.empty((0, 0)) for d in batch[tokens]]
            some = [j for j, d in enumerate(held) if len(d)]
            score = np.zeros((len(ids), len(own)))
            if full and some:
                first = np.cumsum([0, *[len(held[j]) for j in some[:-1]]])
                dots = np.maximum.reduceat(stacked @ np.concatenate([held[j] for j in some]).T, first, axis=1)
                score[np.ix_(full, some)] = np.add.reduceat(dots, starts, axis=0)
            score[ids[:, None] == own[None, :]] = -np.inf
            if not len(own):
                continue
            n = min(k, score.shape[1])
            kth = np.partition(score, -n, axis=1)[:, -n]
            i, j = np.nonzero((score >= kth[:, None]) & (score > -np.inf))
            yield pd.DataFrame({"query_id": ids[i], vec_id: own[j], "score": score[i, j]})

    return work


def target_reports(qrels: DataFrame, question: str, doc: str, relevance: str, mark: str = "#") -> DataFrame:
    """The judged report of each question: ``question, target_report`` and the judgements' page and grade within it.

    The target is the report whose trailing year is the question's; of several
    the one with the strongest judgement, then the smaller name.  Questions
    without such a report are left out.
    """
    year = lambda c: F.nullif(F.regexp_extract(c, r"([0-9]{4})$", 1), F.lit(""))
    split = qrels.select(question, F.substring_index(doc, mark, 1).alias("target_report"), F.substring_index(doc, mark, -1).alias("page"), F.col(relevance).alias("relevance"))
    same = split.where(year(F.col(question)) == year(F.col("target_report")))
    strongest = same.groupBy(question, "target_report").agg(F.max("relevance").alias("__top"))
    chosen = strongest.groupBy(question).agg(F.min(F.struct((-F.col("__top")).alias("t"), F.col("target_report").alias("r")))["r"].alias("target_report"))
    return same.join(chosen, [question, "target_report"], "left_semi")


def eligible(targets: DataFrame, questions: DataFrame, reports: DataFrame, question: str, report: str, threshold: int = 1) -> DataFrame:
    """Questions with text whose target report is there and has a page of at least the threshold's grade."""
    relevant = targets.where(F.col("relevance") >= threshold).select(question, F.col("target_report").alias(report)).distinct()
    return relevant.join(questions.select(question), question, "left_semi").join(reports.select(report), report, "left_semi").select(question, report)


@pandas_udf(DoubleType())
def max_sim(query: pd.Series, document: pd.Series) -> pd.Series:
    """Late interaction: for each query token the best document token's dot product, summed."""
    return pd.Series([float((np.stack(q) @ np.stack(d).T).max(1).sum()) if len(q) and len(d) else 0.0 for q, d in zip(query, document)], dtype="float64")


@pandas_udf(ArrayType(ArrayType(FloatType())))
def as_tokens(vector: pd.Series, size: pd.Series) -> pd.Series:
    """A flat vector as token vectors of a size."""
    return pd.Series([np.asarray(v, np.float32).reshape(-1, s).tolist() for v, s in zip(vector, size)])
