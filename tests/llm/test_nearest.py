import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from pagelode.llm.nearest import PiecewiseLinearIndex, _step, nearest_in_time

HOUR = 3_600_000_000
T0 = dt.datetime(2020, 1, 1)


def test_index_finds_lower_bounds():
    rng = np.random.default_rng(3)
    for keys in (np.cumsum(rng.integers(1, 10, 5000)), np.unique((10 ** rng.uniform(0, 15, 3000)).astype(np.int64)), np.array([5]), np.empty(0, np.int64)):
        breaks = np.sort(rng.choice(len(keys), min(5, len(keys)), replace=False)) if len(keys) > 1 else np.empty(0, np.int64)
        wanted = rng.integers(0, (keys[-1] if len(keys) else 10) + 100, 2000)
        wanted = np.concatenate([wanted, keys, keys + 1])
        index = PiecewiseLinearIndex(keys.astype(np.int64), breaks)
        assert (index.lower_bound(wanted) == np.searchsorted(keys, wanted)).all()


def pairs(spark, left, right, tolerance=72 * HOUR, **more):
    a = spark.createDataFrame(left, "id bigint, k string, t timestamp_ntz, window_id string, left_id string")
    b = spark.createDataFrame(right, "window_id bigint, k string, t timestamp_ntz, id string, side string")
    out = nearest_in_time(a, b, "id", "window_id", "t", "t", F.col("k"), F.col("k"), tolerance, **more)
    return sorted(tuple(r) for r in out.collect())


def at(hours):
    return T0 + dt.timedelta(hours=hours)


def test_ties_ends_nulls_and_clashing_columns(spark):
    left = [(1, "a", at(0), "x", "y"), (2, "a", at(1000), None, None), (3, None, at(0), None, None), (4, "a", None, None, None), (5, "b", at(0), None, None), (6, "c", at(5), None, None)]
    right = [(9, "a", at(2), "q", "r"), (8, "a", at(2), None, None), (7, "a", at(-2), None, None), (6, "a", at(1072), None, None), (5, "a", at(927), None, None), (4, None, at(0), None, None), (3, "c", None, None, None), (None, "b", at(0), None, None), (2, "c", at(5), None, None)]
    assert pairs(spark, left, right) == [(1, 7, -2 * HOUR), (2, 6, 72 * HOUR), (6, 2, 0)]


def test_empty_tables(spark):
    assert pairs(spark, [], []) == []
    assert pairs(spark, [(1, "a", at(0), None, None)], []) == []
    assert pairs(spark, [], [(1, "a", at(0), None, None)]) == []


def test_brute_force_with_a_hot_entity_and_short_shards(spark):
    rng = np.random.default_rng(5)
    name = lambda: "hot" if rng.random() < 0.5 else f"e{rng.integers(20)}"
    left = [(i, name(), at(float(rng.uniform(0, 3000))), None, None) for i in range(600)]
    right = [(i, name(), at(float(rng.integers(0, 3000))), None, None) for i in range(800)]
    want = []
    for i, k, t, *_ in left:
        near = [(abs((u - t).total_seconds()), u, j) for j, m, u, *_ in right if m == k and abs((u - t).total_seconds()) <= 72 * 3600]
        if near:
            _, u, j = min(near)
            want.append((i, j, round((u - t).total_seconds() * 1e6)))
    assert pairs(spark, left, right, shard_days=7) == sorted(want)


def test_small_batches_give_the_same(spark):
    import pandas as pd

    rng = np.random.default_rng(7)
    rows = pd.DataFrame({"entity": "a", "slot": 0, "at": np.sort(rng.integers(0, 10**6, 500)), "side": rng.integers(0, 2, 500), "id": np.arange(500)})
    rows = rows.sort_values(["at", "side", "id"]).reset_index(drop=True)
    whole = _step(rows, 900, 16, last=True)[1]
    rest, parts = rows.iloc[:0], []
    for lo in range(0, 500, 7):
        chunk = pd.concat([rest, rows.iloc[lo : lo + 7]], ignore_index=True)
        _, out, rest = _step(chunk, 900, 16, last=False)
        parts.append(out)
    parts.append(_step(rest, 900, 16, last=True)[1])
    assert sorted(map(tuple, pd.concat(parts).to_numpy().tolist())) == sorted(map(tuple, whole.to_numpy().tolist()))
