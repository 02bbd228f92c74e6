"""Queries that rank and measure rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import search as R
from ..session import table


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "report_pages").where("text IS NOT NULL")
    return pages.groupBy("docid").agg(F.min("text").alias("text"), F.min("exchange").alias("exchange"))


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "eval_items").select("query_id", "query_text")


def _few(values: DataFrame, most: int = 10_000) -> list[str]:
    """The distinct values of a column that has few; more than ``most`` are an error."""
    rows = values.distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} values")
    return sorted(r[0] for r in rows)


def _run(spark: SparkSession, sf: str) -> DataFrame:
    scored = R.bm25(_pages(spark, sf), _questions(spark, sf), "docid", "text", "query_id", "query_text")
    return R.top_k(scored.withColumn("score", F.round("score", 6)), ["query_id"], "score", "docid", 10)


def _qrels(spark: SparkSession, sf: str) -> DataFrame:
    """Judgements made from the tables: a page that names the question's figure is relevant, with the year highly."""
    q = table(spark, sf, "eval_items").select("query_id", F.replace(F.regexp_extract("query_id", "^[^_]+_(.+)_[0-9]{4}$", 1), F.lit("_"), F.lit(" ")).alias("kpi"), F.regexp_extract("query_id", "([0-9]{4})$", 1).alias("year"))
    names = _few(q.select("kpi"))
    words = _pages(spark, sf).select("docid", F.lower("text").alias("t"))
    held = words.withColumn("kpi", F.explode(F.array_compact(F.array(*[F.when(F.col("t").contains(n), n) for n in sorted(names)]))))
    return q.join(held, "kpi").select("query_id", "docid", F.when(F.expr("contains(t, year)"), 2).otherwise(1).cast("bigint").alias("relevance"))


def bm25_top(spark: SparkSession, sf: str) -> DataFrame:
    return _run(spark, sf).select("query_id", "docid", F.col("rank").cast("bigint"), "score")


def bm25_per_exchange(spark: SparkSession, sf: str) -> DataFrame:
    """Rankings within each exchange."""
    pages = _pages(spark, sf).where("exchange IS NOT NULL")
    scopes = _few(pages.select("exchange"))
    questions = _questions(spark, sf).withColumn("exchange", F.explode(F.array(*[F.lit(x) for x in scopes])))
    scored = R.bm25(pages, questions, "docid", "text", "query_id", "query_text", ["exchange"], 1.2, 0.75)
    return R.top_k(scored.withColumn("score", F.round("score", 6)), ["exchange", "query_id"], "score", "docid", 3).select("exchange", "query_id", "docid", F.col("rank").cast("bigint"), "score")


def ir_metrics(spark: SparkSession, sf: str) -> DataFrame:
    m = R.ranking_metrics(_run(spark, sf), _qrels(spark, sf), "query_id", "docid", 10)
    return m.select("query_id", *[F.round(c, 6).alias(c) for c in ("recall", "rr", "precision", "ap", "success", "ndcg")])


def ir_macro(spark: SparkSession, sf: str) -> DataFrame:
    m = R.ranking_metrics(_run(spark, sf), _qrels(spark, sf), "query_id", "docid", 10)
    return m.agg(F.count(F.lit(1)).alias("questions"), *[F.round(F.avg(c), 5).alias(c) for c in ("recall", "rr", "precision", "ap", "success", "ndcg")])


def cosine_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings")
    near = R.cosine_top(v, v.where("vec_id % 100 = 0"), "vec_id", "embedding", 5)
    return near.select("query_id", F.col("neighbour_id"), F.col("rank").cast("bigint"), F.round("cosine", 5).alias("cosine"))


def late_interaction(spark: SparkSession, sf: str) -> DataFrame:
    """MaxSim of a stated set of queries against all rows, each vector read as eight tokens of eight."""
    v = table(spark, sf, "embeddings").select("vec_id", R.as_tokens("embedding", F.lit(8)).alias("tokens"))
    out = R.max_sim_top(v, v.where("vec_id % 100 = 0"), "vec_id", "tokens", 5)
    return out.select("query_id", "vec_id", F.col("rank").cast("bigint"), F.round("score", 4).alias("score"))


def target_reports(spark: SparkSession, sf: str) -> DataFrame:
    """Target report of every question, its judged pages, and whether the question can be evaluated there."""
    t = R.target_reports(_qrels(spark, sf), "query_id", "docid", "relevance")
    reports = table(spark, sf, "report_notes").select(F.col("report_name").alias("report"))
    ok = R.eligible(t, table(spark, sf, "eval_items").where("query_text <> ''").select("query_id"), reports, "query_id", "report").select("query_id", F.lit(True).alias("ok"))
    counted = t.groupBy("query_id", "target_report").agg(F.count(F.lit(1)).alias("pages"), F.max("relevance").alias("best"))
    return counted.join(ok, "query_id", "left").select("query_id", "target_report", "pages", "best", F.coalesce("ok", F.lit(False)).alias("eligible"))


def sparse_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Dot products of term-count maps of questions and the items' own passages."""
    count = lambda c: F.map_from_entries(F.transform(F.array_distinct(R.terms(F.col(c))), lambda w: F.struct(w, F.lit(1.0))))
    e = table(spark, sf, "eval_items").select("item_id", count("query_text").alias("a"), count("passage").alias("b"))
    return e.select("item_id", R.sparse_dot(F.col("a"), F.col("b")).alias("score"))


QUERIES = {f.__name__: f for f in (bm25_top, bm25_per_exchange, ir_metrics, ir_macro, cosine_neighbours, late_interaction, sparse_scores, target_reports)}
_STOP = ", ".join(f"'{w}'" for w in R.STOPWORDS)
_TERMS = "list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda w: w NOT IN (" + _STOP + "))"


def _bm25(scope: str, k1: float, b: float) -> str:
    s = f"{scope}, " if scope else ""
    on = f"USING ({s}term)"
    return f"""
WITH d AS (SELECT docid, min(text) AS text, min(exchange) AS exchange FROM report_pages WHERE text IS NOT NULL GROUP BY 1),
w AS (SELECT docid, exchange, {_TERMS.format('text')} AS w FROM d {'WHERE exchange IS NOT NULL' if scope else ''}),
st AS (SELECT {s} count(*) AS n, avg(len(w)) AS a FROM w {'GROUP BY ' + scope if scope else ''}),
q0 AS (SELECT query_id, unnest({_TERMS.format('query_text')}) AS term FROM eval_items),
q AS (SELECT {'x.exchange, ' if scope else ''} query_id, term, count(*) AS qf FROM q0 {', (SELECT DISTINCT exchange FROM w) x' if scope else ''} GROUP BY ALL),
p AS (SELECT docid, {s} len(w) AS dl, unnest(w) AS term FROM w),
tf AS (SELECT docid, {s} dl, term, count(*) AS tf FROM p WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT {s} term, count(*) AS df FROM tf GROUP BY ALL),
sc AS (SELECT {s} query_id, docid, round(sum(qf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + {k1} * (1 - {b} + {b} * dl / a))), 6) AS score
  FROM tf JOIN q {on} JOIN df {on} {'JOIN st USING (exchange)' if scope else ', st'} GROUP BY ALL),
run AS (SELECT *, row_number() OVER (PARTITION BY {s} query_id ORDER BY score DESC, docid) AS rank FROM sc)
"""


_QRELS = """, qr AS (SELECT query_id, docid, CASE WHEN contains(lower(text), regexp_extract(query_id, '([0-9]{4})$', 1)) THEN 2 ELSE 1 END AS relevance
  FROM eval_items JOIN d ON contains(lower(text), replace(regexp_extract(query_id, '^[^_]+_(.+)_[0-9]{4}$', 1), '_', ' '))),
j AS (SELECT query_id, count(*) AS n_rel, list_slice(list_reverse_sort(list(relevance)), 1, 10) AS ideal FROM qr GROUP BY 1),
h AS (SELECT query_id, rank, relevance, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS i FROM run JOIN qr USING (query_id, docid) WHERE rank <= 10),
f AS (SELECT query_id, count(*) AS hits, min(rank) AS first, sum(i / rank) AS ap, sum(relevance / log2(rank + 1)) AS dcg FROM h GROUP BY 1),
m AS (SELECT query_id, coalesce(hits / n_rel, 0) AS recall, coalesce(1 / first, 0) AS rr, coalesce(hits / 10, 0) AS precision, coalesce(ap / n_rel, 0) AS ap, CASE WHEN hits > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS success,
  coalesce(dcg / list_sum(list_transform(ideal, lambda g, i: g / log2(i + 1))), 0) AS ndcg FROM j LEFT JOIN f USING (query_id))
"""
_M = ("recall", "rr", "precision", "ap", "success", "ndcg")
ORACLES = {
    "bm25_top": _bm25("", 0.9, 0.4) + "SELECT query_id, docid, rank, score FROM run WHERE rank <= 10",
    "bm25_per_exchange": _bm25("exchange", 1.2, 0.75) + "SELECT exchange, query_id, docid, rank, score FROM run WHERE rank <= 3",
    "ir_metrics": _bm25("", 0.9, 0.4) + _QRELS + "SELECT query_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in _M) + " FROM m",
    "ir_macro": _bm25("", 0.9, 0.4) + _QRELS + "SELECT count(*) AS questions, " + ", ".join(f"round(avg({c}), 5) AS {c}" for c in _M) + " FROM m",
    "cosine_neighbours": """WITH p AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbour_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS c
  FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, neighbour_id, n AS rank, round(c, 5) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, neighbour_id) AS n FROM p) WHERE n <= 5""",
    "late_interaction": """WITH s AS (SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(range(8), lambda i: list_max(list_transform(range(8), lambda j:
    list_inner_product(a.embedding[i * 8 + 1 : i * 8 + 8]::DOUBLE[], b.embedding[j * 8 + 1 : j * 8 + 8]::DOUBLE[]))))) AS s FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, vec_id, n AS rank, round(s, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS n FROM s) WHERE n <= 5""",
    "target_reports": """WITH d AS (SELECT docid, min(text) AS text FROM report_pages WHERE text IS NOT NULL GROUP BY 1),
qr AS (SELECT query_id, docid, CASE WHEN contains(lower(text), regexp_extract(query_id, '([0-9]{4})$', 1)) THEN 2 ELSE 1 END AS relevance FROM eval_items JOIN d ON contains(lower(text), replace(regexp_extract(query_id, '^[^_]+_(.+)_[0-9]{4}$', 1), '_', ' '))),
s AS (SELECT query_id, split_part(docid, '#', 1) AS target_report, count(*) AS pages, max(relevance) AS best FROM qr WHERE regexp_extract(query_id, '([0-9]{4})$', 1) = regexp_extract(split_part(docid, '#', 1), '([0-9]{4})$', 1) GROUP BY 1, 2),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best DESC, target_report) AS n FROM s)
SELECT query_id, target_report, pages, CAST(best AS BIGINT) AS best, query_id IN (SELECT query_id FROM eval_items WHERE query_text <> '') AND target_report IN (SELECT report_name FROM report_notes) AS eligible FROM t WHERE n = 1""",
    "sparse_scores": f"""SELECT item_id, len(list_intersect(list_distinct({_TERMS.format('query_text')}), list_distinct({_TERMS.format('passage')})))::DOUBLE AS score FROM eval_items""",
}
