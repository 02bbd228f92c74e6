import os

import pytest

from pagelode.llm.mixture import mix, plan, token_counter

VOCABULARY = os.environ.get("PAGELODE_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.tiktoken"
pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary here")


def run(spark, docs, targets, **more):
    d = spark.createDataFrame(docs, "id bigint, source string, text string, copy string")
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    return mix(d, t, "id", "source", "text", VOCABULARY, **more)


def test_tokens(spark):
    got = spark.createDataFrame([("Hello world",), ("",), (None,), ("a" * 20_000,)], "t string").select(token_counter(VOCABULARY)("t")).collect()
    assert got[0][0] == 2 and got[1][0] == 0 and got[2][0] == 0 and got[3][0] > 0


def test_shares_are_reached_and_repeats_capped(spark):
    docs = [(i, "Big-One" if i % 2 else "big one", "word " * 10, None) for i in range(900)] + [(1000 + i, "small", "word " * 10, None) for i in range(100)]
    docs += [(2000, "other", "word " * 50, None), (2001, None, "word", None), (None, "small", "word", None), (2002, "small", None, None), (2003, "small", "", None)]
    mixture, shares = run(spark, docs, [("big_one", 0.6, 1), ("small", 0.3, 3), ("absent", 0.1, 4), (None, 0.5, 1)], bucket_rows=50)
    s = {r.source: r for r in shares.collect()}
    assert set(s) == {"big_one", "small", "absent"} and s["absent"].tokens_taken == 0
    assert abs(s["big_one"].share - 2 / 3) < 0.01 and abs(s["small"].share - 1 / 3) < 0.01
    assert s["small"].repeats <= 3 and s["big_one"].repeats == 1
    rows = mixture.collect()
    assert len({(r.doc_id, r["copy"]) for r in rows}) == len(rows) and not {r.doc_id for r in rows} & {2000, 2001, 2002, 2003}
    assert [r.finish for r in rows] == sorted(r.finish for r in rows)
    for source in ("big_one", "small"):  # any prefix of the queue is mixed alike
        half = [r for r in rows[: len(rows) // 2] if r.source == source]
        assert abs(sum(r.tokens for r in half) / sum(r.tokens for r in rows[: len(rows) // 2]) - s[source].share) < 0.02


def test_empty(spark):
    mixture, shares = run(spark, [], [("a", 1.0, 1)])
    assert mixture.count() == 0 and shares.first().tokens_taken == 0
    mixture, shares = run(spark, [(1, "a", "word", None)], [])
    assert mixture.count() == 0 and shares.count() == 0


def test_plan_keeps_proportions(spark):
    sizes = spark.createDataFrame([("a", 100, 1), ("b", 1000, 1)], "source string, tokens bigint, documents bigint")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.25, 1), ("c", 0.25, 9)], "source string, target_share double, max_repeats int")
    got = {r.source: r.quota for r in plan(sizes, targets).collect()}
    assert got["a"] == 200.0 and got["b"] == 100.0 and got["c"] == 0.0
