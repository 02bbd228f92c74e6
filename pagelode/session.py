"""Session helpers: tables, durable intermediate results and time arithmetic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One test table as a DataFrame."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share.

    Only a session in one process may do without the setting; it gets a
    private folder there.  Anywhere else a folder of one machine would lose
    data with that machine, so its absence is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if spark.sparkContext not in _PRIVATE:
        import tempfile

        _PRIVATE[spark.sparkContext] = tempfile.mkdtemp(prefix="pagelode-")
    return _PRIVATE[spark.sparkContext]


_PRIVATE: dict = {}


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def with_small(df: DataFrame, side: DataFrame, key: str, spread: Sequence[str], most: int = 100_000, salts: int = 64) -> DataFrame:
    """Left join with ``side``, which has one row per key.

    Up to ``most`` rows it is broadcast.  A larger one is joined by key and
    salt: each row of ``df`` falls into one of ``salts`` parts of its key by
    the hash of the ``spread`` columns, and the side is repeated over them, so
    that a key with a third of all rows is no single task.  The hint keeps the
    repeated side out of the driver: its estimate is that of the files and
    knows nothing of the salts, so it may lie under the broadcast threshold.
    Rows without key go past the join.
    """
    if side.count() <= most:
        return df.join(F.broadcast(side), key, "left")
    known = df.where(F.col(key).isNotNull()).withColumn("__salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    wide = side.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).hint("merge")
    return known.join(wide, [key, "__salt"], "left").drop("__salt").unionByName(df.where(F.col(key).isNull()), allowMissingColumns=True)


def epoch_us(df: DataFrame, column: str) -> Column:
    """Microseconds since 1970 of a timestamp column, whatever its kind."""
    c = F.col(column)
    if dict(df.dtypes)[column] == "timestamp":
        return F.unix_micros(c)
    second = F.round(F.expr(f"extract(SECOND FROM `{column}`)") * 1_000_000).cast("bigint")
    return (
        F.unix_date(c.cast("date")).cast("bigint") * DAY_US
        + F.hour(c).cast("bigint") * 3_600_000_000
        + F.minute(c).cast("bigint") * 60_000_000
        + second
    )


def clean_ticker(column: Column, suffixes: tuple[str, ...] = ("L", "AX", "TO", "V")) -> Column:
    """Ticker in upper case without blanks and exchange suffix; null when nothing is left."""
    bare = F.regexp_replace(F.upper(column), r"[\s ]+", "")
    bare = F.regexp_replace(bare, r"\.(" + "|".join(suffixes) + r")$", "")
    return F.when(bare != "", bare)
