"""Probabilistic linkage of records that share no key."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable

#: Words of legal forms and fillers that don't tell companies apart.
FILLERS = ("plc", "inc", "incorporated", "ltd", "limited", "llc", "corporation", "corp", "group", "holdings", "holding", "international", "co", "company", "the", "and", "uk")

#: Spellings of a missing attribute.
MISSING = ("", "n/a", "na", "error", "none", "null", "nan", "-", "unknown")

#: Comparison levels by attribute, the last the strongest; -1 stands for a missing side.
LEVELS = {"name": 5, "city": 3, "industry": 3, "year": 4, "revenue": 4}


def present(column: Column) -> Column:
    """Trimmed lower-case text; null for the spellings of a missing value."""
    text = F.lower(F.trim(column))
    return F.when(~text.isin(*MISSING), text)


def core_words(name: Column) -> Column:
    """Telling words of a company name, in order, without legal forms, fillers and the seat ("of ...")."""
    text = F.regexp_replace(F.lower(name), r"\([^)]*\)", " ")
    text = F.regexp_replace(text, r"\b([a-z])\.(?=[a-z]\b)", "$1")
    text = F.regexp_replace(text, r"\s+of\s+.*$", " ")
    words = F.split(F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " ")), " ")
    return F.filter(words, lambda w: (w != "") & ~w.isin(*FILLERS))


def industry_word(column: Column) -> Column:
    """Industry without a trade prefix: "wholesale-security" and "Security Services" begin alike."""
    return F.regexp_replace(present(column), r"^(wholesale|retail trade|services)-", "")


def consonants(column: Column) -> Column:
    return F.regexp_replace(column, r"[^bcdfghjklmnpqrstvwxz]", "")


def records(df: DataFrame, key: str, name: str, former: str | None, city: str, industry: str, year: str, revenue: Column) -> DataFrame:
    """Comparable attributes of one source; rows without key are left out."""
    names = F.array(F.col(name)) if former is None else F.array(F.col(name), F.col(former))
    out = df.where(F.col(key).isNotNull()).select(
        F.col(key).cast("bigint").alias("id"),
        F.filter(F.transform(names, lambda n: core_words(n)), lambda w: F.coalesce(F.size(w) > 0, F.lit(False))).alias("names"),
        present(F.col(city)).alias("city"),
        F.split_part(industry_word(F.col(industry)), F.lit(" "), F.lit(1)).alias("industry"),
        industry_word(F.col(industry)).alias("industry_full"),
        F.col(year).cast("int").alias("year"),
        F.when(revenue > 0, F.log(revenue)).alias("revenue"),
    )
    return out.dropDuplicates(["id"])


def block_keys(r: DataFrame, wide: bool, common: list[str], year_reach: int = 1, bucket: float = 0.06) -> DataFrame:
    """Keys of several passes: ``key, id``.  Trade words make no key.  Near years and revenues are reached by giving one side the neighbouring keys too."""
    near = lambda c, n: F.transform(F.sequence(F.lit(-n), F.lit(n)), lambda d: (c + d).cast("string")) if wide else F.array(c.cast("string"))
    flat = F.flatten(F.col("names"))
    words = F.array_distinct(flat)
    telling = F.filter(words, lambda w: ~w.isin(*common)) if common else words
    city = F.array(F.concat(F.substring("city", 1, 1), F.substring(consonants(F.reverse(F.col("city"))), 1, 3)))
    parts = {
        "city": F.when(F.col("city").isNotNull(), city),
        "industry": F.array_distinct(F.concat(F.filter(words, lambda w: w.isin(*common)) if common else F.array().cast("array<string>"), F.array_compact(F.array("industry")))),
        "year": F.when(F.col("year").isNotNull(), near(F.col("year"), year_reach)),
        "revenue": F.when(F.col("revenue").isNotNull(), near(F.floor(F.col("revenue") / bucket).cast("int"), 1)),
        "word": F.array_distinct(F.flatten(F.transform(F.filter(telling, lambda w: F.length(w) >= 5), lambda w: F.array(F.substring(w, 1, 5), F.concat(F.lit("-"), F.substring(w, -5, 5)))))),
    }

    def cross(keys: Column, others: Column) -> Column:
        return F.flatten(F.transform(keys, lambda a: F.transform(others, lambda b: F.concat_ws("|", a, b))))

    def named(keys: Column, name: str) -> Column:
        return F.transform(keys, lambda k: F.concat(F.lit(name + ":"), k))

    crossed = []
    passes = [p for p in combinations(("city", "industry", "year", "revenue"), 3)] + [("word", x) for x in ("city", "year", "revenue", "industry")]
    for p in passes:
        keys = parts[p[0]]
        for other in p[1:]:
            keys = cross(keys, parts[other])
        crossed.append(F.coalesce(named(keys, "+".join(p)), F.array().cast("array<string>")))
    whole = F.transform("names", lambda n: F.concat(F.lit("name:"), F.concat_ws(" ", F.array_sort(n))))
    keys = F.array_distinct(F.concat(F.coalesce(whole, F.array().cast("array<string>")), *crossed))
    return r.select("id", F.explode(keys).alias("key"))


def candidate_pairs(a: DataFrame, b: DataFrame, common: list[str], most: int = 10_000) -> DataFrame:
    """Distinct pairs of ids that share a key of some pass.

    A key whose block would give more than ``most`` pairs is cut into a grid of
    cells of about that many: each record falls by its hash into one row (or
    column) of the grid and is repeated over its cells, so that every pair of
    the block meets in exactly one cell.
    """
    ka, kb = (k.select("id", F.xxhash64("key").alias("key")) for k in (block_keys(a, True, common), block_keys(b, False, common)))
    # eight bytes a key; both sides are read twice below
    ka, kb = durable(ka), durable(kb)
    sizes = ka.groupBy("key").agg(F.count(F.lit(1)).alias("na")).join(kb.groupBy("key").agg(F.count(F.lit(1)).alias("nb")), "key")
    side = math.sqrt(most)
    big = durable(sizes.where(F.col("na") * F.col("nb") > most).select("key", F.ceil(F.col("na") / side).alias("cut_a"), F.ceil(F.col("nb") / side).alias("cut_b")))
    if big.isEmpty():
        return ka.withColumnRenamed("id", "ia").join(kb.withColumnRenamed("id", "ib"), "key").select("ia", "ib").distinct()

    def celled(k: DataFrame, own: str, other: str) -> DataFrame:
        k = k.join(big, "key", "left").select("id", "key", *[F.coalesce(c, F.lit(1)).cast("bigint").alias(c) for c in ("cut_a", "cut_b")])
        k = k.select("id", "key", F.pmod(F.xxhash64("id"), own).alias(own), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(other) - 1)).alias(other))
        return k.select("id", F.xxhash64("key", "cut_a", "cut_b").alias("key"))

    pairs = celled(ka, "cut_a", "cut_b").withColumnRenamed("id", "ia").join(celled(kb, "cut_b", "cut_a").withColumnRenamed("id", "ib"), "key")
    return pairs.select("ia", "ib").distinct()


def _similar(x: Column, y: Column) -> Column:
    """2 for equal words, 1 for a shortened, vowelless or misspelled one, else 0."""
    short, long = F.least(F.length(x), F.length(y)), F.greatest(F.length(x), F.length(y))
    prefix = (short >= 3) & (F.startswith(x, y) | F.startswith(y, x))
    bare = (short >= 2) & ((consonants(x) == y) | (consonants(y) == x)) | ((F.length(consonants(x)) >= 3) & (consonants(x) == consonants(y)))
    # one letter added, left out or changed, two neighbours swapped, or up to two letters doubled in front
    doubled = (long - short <= 2) & (F.endswith(x, y) | F.endswith(y, x))
    edits = F.levenshtein(x, y)
    swapped = (edits == 2) & (short == long) & (F.array_sort(F.split(x, "")) == F.array_sort(F.split(y, "")))
    typo = (short >= 5) & ((edits <= 1) | swapped | doubled)
    return F.when(x == y, 2).when(prefix | bare | typo, 1).otherwise(0)


def _name_level(na: Column, nb: Column, common: list[str]) -> Column:
    """Level of the best pair of names: 4 same words, 3 alike, 2 same telling word only, 1 initials, 0 other."""

    def one(x: Column, y: Column) -> Column:
        best = lambda w: F.coalesce(F.array_max(F.transform(y, lambda v: _similar(w, v))), F.lit(0))
        rare = F.filter(x, lambda w: ~w.isin(*common)) if common else x
        rare = F.when(F.size(rare) > 0, rare).otherwise(x)
        rest = F.filter(x, lambda w: w.isin(*common)) if common else F.array().cast("array<string>")
        rare_low = F.array_min(F.transform(rare, best))
        rest_low = F.coalesce(F.array_min(F.transform(rest, best)), F.lit(2))
        clash = F.size(F.filter(y, lambda v: v.isin(*common))) > 0 if common else F.lit(False)
        first = F.element_at(x, 1)
        second = F.try_element_at(x, F.lit(2))
        initials = F.array(
            F.concat(F.substring(first, 1, 1), F.substring(second, 1, 2)),
            F.concat_ws("", F.transform(x, lambda w: F.substring(w, 1, 1))),
            F.concat(F.substring(first, 1, 2), F.substring(second, 1, 1)),
        )
        only = F.element_at(y, 1)
        acronym = (F.size(y) == 1) & (F.length(only) >= 2) & (F.length(only) <= 4) & F.array_contains(initials, only)
        return (
            F.when((rare_low == 2) & (rest_low == 2), 4)
            .when((rare_low >= 1) & (rest_low >= 1), 3)
            .when((rare_low == 2) & ~clash, 2)
            .when(F.coalesce(acronym, F.lit(False)), 1)
            .otherwise(0)
        )

    return F.coalesce(F.array_max(F.flatten(F.transform(na, lambda x: F.transform(nb, lambda y: one(x, y))))), F.lit(-1))


def compare(pairs: DataFrame, a: DataFrame, b: DataFrame, common: list[str]) -> DataFrame:
    """Agreement levels of each pair; -1 where a side is missing."""
    sides = [d.select([F.col(c).alias(f"{c}_{s}" if c != "id" else f"i{s}") for c in d.columns]) for d, s in ((a, "a"), (b, "b"))]
    both = pairs.join(sides[0], "ia").join(sides[1], "ib")
    ca, cb = F.col("city_a"), F.col("city_b")
    city = F.when(ca == cb, 2).when((F.levenshtein(ca, cb) <= 2) | (consonants(ca) == consonants(cb)) | (F.split_part(ca, F.lit(" "), F.lit(-1)) == F.split_part(cb, F.lit(" "), F.lit(-1))), 1).otherwise(0)
    industry = F.when(F.col("industry_full_a") == F.col("industry_full_b"), 2).when(F.col("industry_a") == F.col("industry_b"), 1).otherwise(0)
    years = F.abs(F.col("year_a") - F.col("year_b"))
    money = F.abs(F.col("revenue_a") - F.col("revenue_b"))
    missing = lambda c, level: F.when(F.col(f"{c}_a").isNull() | F.col(f"{c}_b").isNull(), -1).otherwise(level)
    return both.select(
        "ia",
        "ib",
        _name_level(F.col("names_a"), F.col("names_b"), common).alias("name"),
        missing("city", city).alias("city"),
        missing("industry", industry).alias("industry"),
        missing("year", F.when(years == 0, 3).when(years <= 1, 2).when(years <= 3, 1).otherwise(0)).alias("year"),
        missing("revenue", F.when(money <= 0.03, 3).when(money <= 0.06, 2).when(money <= 0.2, 1).otherwise(0)).alias("revenue"),
    )


def random_pairs(a: DataFrame, b: DataFrame, size_a: int, size_b: int, per_record: int = 4) -> DataFrame:
    """Pairs that chance alone brings together, about ``per_record`` for each record of the larger source.

    Both sources fall into buckets by a hash of the id, so all records are
    alike in their chance to meet, a bucket's size depends on no attribute,
    and the number of pairs grows with the records, not with their square.
    """
    buckets = max(1, min(size_a, size_b) // per_record)
    bucket = F.pmod(F.xxhash64(F.lit("chance"), "id"), F.lit(buckets)).alias("bucket")
    return a.select(bucket, F.col("id").alias("ia")).join(b.select(bucket, F.col("id").alias("ib")), "bucket").select("ia", "ib")


def fit(vectors: list[tuple], chance: list[tuple], pairs: float, rounds: int = 50) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray], float]:
    """EM over the counts of comparison vectors: match and non-match probabilities of the levels, and the share of matches among all pairs.

    ``vectors`` counts the candidates, ``chance`` the random pairs.  In every
    round the non-match probabilities of all levels come from the random
    pairs, each weighted by its own posterior of being no match.  Levels of
    the name that agree in a word are too rare there; for them the
    candidates' expected non-matches count, over all pairs, divided by the
    probability that such a pair becomes a candidate at all: surely for equal
    names, else when one of the other attributes agrees too.
    """
    names = list(LEVELS)
    split = lambda rows: (np.array([v[:-1] for v in rows], int).reshape(-1, len(names)), np.array([v[-1] for v in rows], float))
    (levels, n), (random, r) = split(vectors), split(chance)
    count = lambda lv, w, i, k: np.array([w[lv[:, i] == x].sum() for x in range(k)])
    # pairs with the same name start as matches
    same = n * (levels[:, 0] == LEVELS["name"] - 1)
    m = {"name": np.array([0.02, 0.08, 0.1, 0.2, 0.6])}
    for i, c in enumerate(names[1:], 1):
        mass = count(levels, same, i, LEVELS[c]) + 0.5
        m[c] = mass / mass.sum()
    prior = min(max(same.sum(), 1.0) / max(pairs, 1.0), 0.5)
    u: dict[str, np.ndarray] = {}
    q, p = np.ones(len(r)), np.where(same > 0, 1.0, 0.0)
    for step in range(rounds):
        for i, c in enumerate(names):
            mass = count(random, q * r, i, LEVELS[c]) + 0.5
            u[c] = mass / mass.sum()
        agree = 1 - np.prod([1 - u[c][-1] for c in names[1:]])
        for k in range(2, LEVELS["name"]):
            left = ((1 - p) * n)[levels[:, 0] == k].sum() + 0.5
            u["name"][k] = left / max(pairs, 1.0) / (1.0 if k == LEVELS["name"] - 1 else max(agree, 1e-6))
        u["name"][:2] *= max(1 - u["name"][2:].sum(), 0.5) / u["name"][:2].sum()
        odds = posterior_odds(levels, m, u, prior)
        p = odds / (1 + odds)
        prior = min(max((p * n).sum() / max(pairs, 1.0), 1e-15), 0.5)
        for i, c in enumerate(names):
            mass = count(levels, p * n, i, LEVELS[c])
            m[c] = (mass + 0.5) / (mass.sum() + 0.5 * LEVELS[c])
        if len(r):
            odds = posterior_odds(random, m, u, prior)
            q = 1 / (1 + odds)
    return m, u, prior


def posterior_odds(levels: np.ndarray, m: dict[str, np.ndarray], u: dict[str, np.ndarray], prior: float) -> np.ndarray:
    log = np.full(len(levels), math.log(prior / (1 - prior)))
    for i, c in enumerate(LEVELS):
        weight = np.append(np.log(m[c]) - np.log(np.array(u[c])), 0.0)  # the last is for -1
        log += weight[levels[:, i]]
    return np.exp(np.clip(log, -700, 700))


def link(a: DataFrame, b: DataFrame, common_share: float = 0.002) -> DataFrame:
    """Pairs of records with their posterior probability of a match.

    Returns ``ia, ib``, the levels and ``confidence`` for every candidate
    pair.  A missing attribute says nothing; records that lack nearly all
    attributes meet no candidate.  Repeated records pair each for itself, and
    empty sources give no pairs.  Words borne by more than ``common_share``
    of the records (at most 1/share times the words of a name) count as trade
    words, which tell less.
    """
    a, b = durable(a), durable(b)
    size_a, size_b = a.count(), b.count()
    words = a.select("id", F.explode(F.flatten("names")).alias("w")).unionByName(b.select("id", F.explode(F.flatten("names")).alias("w")))
    bar = max(common_share * (size_a + size_b), 5)
    common = sorted(r[0] for r in words.groupBy("w").count().where(F.col("count") > bar).select("w").collect())
    compared = durable(compare(candidate_pairs(a, b, common), a, b, common))
    vectors = [tuple(r) for r in compared.groupBy(*LEVELS).count().collect()]
    scored = compared.withColumn("confidence", F.lit(None).cast("double"))
    if not vectors:
        return scored
    chance = [tuple(r) for r in compare(random_pairs(a, b, size_a, size_b), a, b, common).groupBy(*LEVELS).count().collect()]
    m, u, prior = fit(vectors, chance, float(size_a) * size_b)
    log = F.lit(math.log(prior / (1 - prior)))
    for c in LEVELS:
        weights = [float(x) for x in np.log(m[c]) - np.log(np.array(u[c]))]
        log = log + F.coalesce(*[F.when(F.col(c) == i, F.lit(w)) for i, w in enumerate(weights)], F.lit(0.0))
    return compared.withColumn("confidence", 1 / (1 + F.exp(-log)))
