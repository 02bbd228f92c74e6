"""Writers of rankings, judgements, audits, shards and logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def write_run(run: DataFrame, path: str, tag: str) -> None:
    """Ranking lines ``qid Q0 docid rank score tag`` with six decimals, in order of question and rank."""
    ordered = run.orderBy("query_id", "rank")
    ordered.select(F.format_string(f"%s Q0 %s %d %.6f {tag}", "query_id", "doc_id", F.col("rank").cast("int"), F.col("score").cast("double"))).write.mode("overwrite").text(path)


def nested_hits(run: DataFrame) -> DataFrame:
    """One row per question with its hits in rank order."""
    return run.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "score"))).alias("hits"))


def write_hits(run: DataFrame, path: str) -> None:
    nested_hits(run).write.mode("overwrite").json(path)


def write_qrels(rows: DataFrame, path: str, order: str | None = None) -> None:
    """Distinct judgements, sorted, tab-separated: the first of each pair by ``order``, or the highest grade without one."""
    pick = F.min_by("relevance", F.struct(order, "relevance")) if order else F.max("relevance")
    best = rows.groupBy("query_id", "doc_id").agg(pick.alias("relevance"))
    best.orderBy("query_id", "doc_id").select(F.format_string("%s\t0\t%s\t%d", "query_id", "doc_id", F.col("relevance").cast("int"))).write.mode("overwrite").text(path)


def write_audit(rows: DataFrame, path: str, columns: Sequence[str]) -> None:
    """A CSV with a fixed list of columns; missing ones are empty."""
    have = set(rows.columns)
    rows.select(*[F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in columns]).write.mode("overwrite").option("header", "true").csv(path)


def write_shards(rows: DataFrame, path: str, rows_per_file: int = 100_000) -> None:
    rows.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path)


def current_records(log: DataFrame, key: Sequence[str], time: str, sequence: str) -> DataFrame:
    """Latest record per key of an append-only log; ties go to the larger sequence number."""
    rest = [c for c in log.columns if c not in (*key, time, sequence)]
    last = log.groupBy(*key).agg(F.max(F.struct(time, sequence, *rest)).alias("__r"), F.count(F.lit(1)).alias("revisions"))
    return last.select(*key, "__r.*", "revisions")


def numbered(log: DataFrame, session: str, order: Sequence[str]) -> DataFrame:
    """Log rows with their sequence number in the session."""
    return log.withColumn("sequence", F.row_number().over(Window.partitionBy(session).orderBy(*order)))


def append_log(rows: DataFrame, path: str) -> None:
    """Appends rows; together with ``pending`` over what is there, a writer can be resumed."""
    rows.write.mode("append").json(path)


def docstore(pages: DataFrame, path: str, most: int = 220) -> None:
    """Snippets by document id."""
    flat = F.trim(F.regexp_replace("text", r"\s+", " "))
    pages.select("docid", F.substring(flat, 1, most).alias("snippet")).write.mode("overwrite").parquet(path)


def markdown(rows: DataFrame, most: int = 500) -> str:
    """A small aggregate as a Markdown table; more than ``most`` rows are refused."""
    data = rows.limit(most + 1).collect()
    if len(data) > most:
        raise ValueError(f"more than {most} rows; aggregate first")
    head = "| " + " | ".join(rows.columns) + " |\n|" + "---|" * len(rows.columns) + "\n"
    return head + "".join("| " + " | ".join("" if v is None else str(v) for v in r) + " |\n" for r in data)


def write_facts(facts: DataFrame, path: str, keys: Sequence[str], attribute: str, value: str, attributes: Sequence[str]) -> None:
    """Facts three times over: ``long``, ``wide`` with a column per attribute, and ``coverage`` by attribute."""
    facts.write.mode("overwrite").parquet(f"{path}/long")
    facts.groupBy(*keys).agg(*[F.min(F.when(F.col(attribute) == a, F.col(value))).alias(a) for a in attributes]).write.mode("overwrite").parquet(f"{path}/wide")
    facts.groupBy(attribute).agg(F.count(value).alias("filled"), F.countDistinct(*keys).alias("entities")).write.mode("overwrite").option("header", "true").csv(f"{path}/coverage")


def all_sessions(summaries: dict[str, DataFrame]) -> DataFrame:
    """Summaries of several sessions in one table, by name of the session; columns that one lacks are null."""
    out = None
    for name, one in sorted(summaries.items()):
        one = one.withColumn("session", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise ValueError("no session")
    return out
