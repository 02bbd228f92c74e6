import math
import random
import re
from collections import Counter

import __spark_entry__ as entry


def test_line_matches_against_brute_force(spark, tmp_path):
    """Every line is a target, in the same order too, and lines with the same order and number are different lines."""
    rng = random.Random(5)
    lines = [(rng.randrange(12), rng.randrange(3), rng.randrange(1, 3), round(rng.choice([100.0, 250.0, -80.0]) * (1 + rng.uniform(-2e-3, 2e-3)), 2)) for _ in range(120)]
    lines += [(1, 1, 2, 500.0), (1, 1, 2, 500.0), (2, 1, 3, None), (2, None, 3, 500.0)]
    spark.createDataFrame(lines, "l_orderkey bigint, l_partkey bigint, l_linenumber int, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    want = []
    for i, (oa, pa, na, xa) in enumerate(lines):
        for j, (ob, pb, nb, xb) in enumerate(lines):
            if i != j and pa is not None and pa == pb and xa is not None and xb is not None and abs(xa - xb) / abs(xb) <= 0.001:
                want.append((pa, oa, na, ob, nb, round(abs(xa - xb) / abs(xb), 8)))
    got = [tuple(r) for r in entry.queries()["line_matches"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)
    assert any(r[1] == r[3] for r in want) and any(r[1] == r[3] and r[2] == r[4] for r in want) and any(r[4] != 1 for r in want)


def test_residual_codes_have_all_levels_and_centres(spark, tmp_path):
    rng = random.Random(7)
    data = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(300)]
    spark.createDataFrame(data, "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = entry.queries()["residual_codes"](spark, str(tmp_path)).collect()
    assert sorted(r.vec_id for r in got) == list(range(300)) and {len(r.codes) for r in got} == {8}
    assert {r.codes[0] for r in got} == set(range(32))
    norm = {i: math.hypot(*v) for i, v in data}
    assert sum(r.residual_norm for r in got) < 0.2 * sum(norm.values())


def test_tfidf_terms_against_plain_python(spark, tmp_path):
    rng = random.Random(9)
    data = [(i, " ".join(rng.choices(["alpha", "Beta", "gamma", "delta", "eps", "zeta", "eta", "theta"], weights=[9, 7, 5, 4, 3, 2, 1, 1], k=25))) for i in range(20)] + [(20, None), (21, "")]
    spark.createDataFrame(data, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    counts = {i: Counter(re.findall("[a-z]{2,}", t.lower())) for i, t in data if t is not None}
    spread = Counter(w for c in counts.values() for w in c)
    want = []
    for i, c in counts.items():
        weights = sorted((-(1 + math.log(n)) * (math.log((1 + len(counts)) / (1 + spread[w])) + 1), w) for w, n in c.items())
        want += [(i, w, rank) for rank, (_, w) in enumerate(weights[:5], 1)]
    got = entry.queries()["tfidf_terms"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.term, r["rank"]) for r in got) == sorted(want)
