import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from pagelode.llm.consensus import consensus, counted_votes, digamma

LABELS = ["ok", "not_ok", "uncertain"]


def test_digamma(spark):
    x = [0.01, 0.3, 1.0, 2.5, 40.0]
    want = [-100.5608854, -3.5025242, -0.5772157, 0.7031566, 3.6763274]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(digamma(F.col("x"))).collect()]
    assert np.allclose(got, want, atol=1e-6)


def test_counted_votes(spark):
    t = dt.datetime(2020, 1, 1)
    rows = [
        ("a", "i", "OK", t), ("a", "i", "Not-OK", t + dt.timedelta(1)), ("a", "i", "Not-OK", t + dt.timedelta(1)), ("b", "i", " ok ", t), ("b", "i", None, t + dt.timedelta(1)), ("c", "i", "not ok", None),
        (None, "i", "ok", t), ("c", None, "ok", t), ("d", "i", "skip", t), ("e", "i", "ok", t), ("e", "i", "uncertain", t),
    ]
    df = spark.createDataFrame(rows, "annotator string, item_id string, s string, at timestamp_ntz").withColumn("item", F.lit("clash"))
    got = sorted(tuple(r) for r in counted_votes(df, "annotator", "item_id", "s", "at", LABELS).collect())
    assert got == [("a", "i", "not_ok"), ("e", "i", "uncertain")]


def world(seed=2, items=300):
    rng = np.random.default_rng(seed)
    truth = rng.choice(3, items, p=[0.5, 0.35, 0.15])
    rows, kinds = [], {}
    for a in range(40):
        kind = "opposed" if a < 3 else "random" if a < 7 else "constant" if a < 9 else "lenient" if a < 14 else "good"
        kinds[f"a{a}"] = kind
        for i in rng.choice(items, 60, replace=False):
            t = truth[i]
            if kind == "opposed":
                v = 1 - t if t < 2 and rng.random() < 0.9 else rng.integers(3)
            elif kind == "random":
                v = rng.choice(3, p=[0.4, 0.4, 0.2])
            elif kind == "constant":
                v = 0
            elif kind == "lenient":
                v = 0 if rng.random() < 0.4 else t
            else:
                v = t if rng.random() < 0.88 else rng.integers(3)
            rows.append((f"a{a}", f"i{i}", LABELS[v]))
    return rows, {f"i{i}": LABELS[t] for i, t in enumerate(truth)}, kinds


def test_finds_guessers_and_truth(spark):
    rows, truth, kinds = world()
    c = consensus(spark.createDataFrame(rows, "annotator string, item string, label string"), LABELS)
    bad = {r.annotator for r in c.annotators.where("low <= 0").collect()}
    assert bad == {a for a, k in kinds.items() if k in ("opposed", "random", "constant")}
    items = c.items.where("votes >= 4").collect()
    assert np.mean([truth[r.item] == r.label for r in items]) > 0.9
    assert 0 < c.summary.first().alpha < 1


def test_krippendorff_by_hand(spark):
    rows = [("a", "1", "ok"), ("b", "1", "ok"), ("a", "2", "ok"), ("b", "2", "not_ok"), ("a", "3", "not_ok"), ("b", "3", "not_ok"), ("a", "4", "ok")]
    s = consensus(spark.createDataFrame(rows, "annotator string, item string, label string"), LABELS, rounds=2).summary.first()
    assert (s["items"], s.votes) == (3, 6) and np.isclose(s.alpha, 1 - 2 / (18 / 5))


def test_single_vote_and_none(spark):
    one = consensus(spark.createDataFrame([("a", "1", "ok")], "annotator string, item string, label string"), LABELS)
    assert one.items.first().label == "ok" and one.items.first().agreement is None and one.summary.first().alpha is None
    empty = consensus(spark.createDataFrame([], "annotator string, item string, label string"), LABELS)
    assert empty.items.count() == 0 and empty.annotators.count() == 0


def test_hot_item_is_split_without_change(spark):
    """An item with a third of all votes, split by annotator, changes no result."""
    rows, _, _ = world(5, 60)
    rows += [(f"h{j}", "hot", LABELS[j % 7 == 0]) for j in range(900)]
    df = spark.createDataFrame(rows, "annotator string, item string, label string").cache()
    plain, split = consensus(df, LABELS, rounds=4), consensus(df, LABELS, rounds=4, hot_share=0.05, hot_least=100)
    for part in ("items", "annotators"):
        a, b = (getattr(c, part).toPandas() for c in (plain, split))
        key = a.columns[0]
        a, b = (d.sort_values(key).reset_index(drop=True) for d in (a, b))
        assert list(a[key]) == list(b[key])
        for c in a.select_dtypes("number"):
            assert np.allclose(a[c].astype(float), b[c].astype(float), equal_nan=True)


def test_interval_holds_the_posterior(spark):
    """The quantiles are those of draws from the annotator's fitted rows."""
    rows, _, _ = world(7, 80)
    r = consensus(spark.createDataFrame(rows, "annotator string, item string, label string"), LABELS).annotators.where("annotator = 'a20'").first()
    assert r.low < r.reliability < r.high <= 1.05 and r.votes == 60
