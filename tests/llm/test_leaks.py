import numpy as np

from pagelode.llm.leaks import Sparse, copied, fold, leaked_passages, places_of, subsequence

WORDS = [a + b for a in "bcdfghjklmnpqrstvz" for b in ("aron", "elim", "itok", "oved", "ugas", "anor", "epil", "idax", "ozun")]


def passage(seed, n=60):
    r = np.random.default_rng(seed)
    return " ".join(str(r.integers(1000, 9999)) if r.random() < 0.1 else WORDS[r.integers(len(WORDS))] for _ in range(n))


def plain(seed, n=120):
    r = np.random.default_rng(10_000 + seed)
    return " ".join(f"plain{r.integers(400)}" for _ in range(n))


def found(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id bigint, text string, item_id string, cosine string")
    i = spark.createDataFrame(items, "item_id bigint, passage string, doc_id string")
    return leaked_passages(d, i, "doc_id", "text", "item_id", "passage", **more)


def test_fold():
    assert fold("Toll-\nroad $1,334 settlernent") == fold("TOLL-ROAD, 1334 Settlement!") and fold("c1ient") == fold("client") and fold("a<--- Page Split --->b") == fold("a b")


def test_copied_and_subsequence():
    a, b = np.arange(20), np.arange(20)
    p = places_of(b)
    assert copied(a, p, 8) == 20 and copied(np.delete(a, 10), p, 8) == 19 and copied(np.delete(a, [5, 13]), p, 8) == 0
    assert copied(np.full(5, -1), p, 8) == 0 and subsequence(np.delete(a, [5, 13]), b) == 18 and subsequence(a, b[::-1]) == 1


def test_leaks_against_all_texts(spark):
    items = [(i, passage(i), None) for i in range(1, 13)] + [(90, None, None), (91, " ", None), (None, passage(99), None)]
    p = {i: passage(i).split() for i in range(1, 13)}
    docs = [(i, plain(i), None, None) for i in range(100, 200)]
    docs += [
        (1, plain(1) + " " + passage(1).upper().replace(" ", "\n") + " " + plain(2), None, None),
        (2, plain(3) + " " + " ".join(p[2][10:35]), None, None),
        (3, plain(4) + " " + " ".join(p[3][:7]) + " " + plain(5), None, None),
        (4, " ".join(w for k, w in enumerate(p[4]) if k % 6), None, None),
        (5, plain(6) + " " + ". ".join(p[5][:30]).replace("ron", "r0n").replace("m", "rn") + plain(7), None, None),
        (6, passage(6) + " " + passage(7), "clash", None),
        (7, "x" * 50_000 + " " + plain(8) * 50 + " " + passage(8), None, None),
        (8, None, None, None), (9, "", None, None), (None, passage(9), None, None),
        (10, passage(10), None, None), (10, passage(10), None, None),
    ]
    got = sorted((r.doc_id, r.item_id) for r in found(spark, docs, items).where("copied_share >= 0.3333").collect())
    assert got == [(1, 1), (2, 2), (5, 5), (6, 6), (6, 7), (7, 8), (10, 10), (10, 10)]
    near = {(r.doc_id, r.item_id): r for r in found(spark, docs, items).collect()}
    assert near[4, 4].copied_share == 0 and near[4, 4].lcs_share > 0.7
    assert near[1, 1].answer_share == 1.0
    # no stretch is copied, but the order of the words and the numbers are the item's
    assert near[4, 4].verdict == "paraphrase" and near[1, 1].verdict == "copy"


def test_other_facts_are_no_paraphrase(spark):
    """The item's sentence with other numbers and every fourth word replaced is only similar."""
    words = passage(1).split()
    numbers = [k for k, w in enumerate(words) if any(c.isdigit() for c in w)]
    assert numbers
    other = [("9" * len(w) if k in numbers else "plain1" if k % 4 == 0 else w) for k, w in enumerate(words)]
    same = [("plain1" if k % 4 == 0 and k not in numbers else w) for k, w in enumerate(words)]
    docs = [(i, plain(i), None, None) for i in range(100, 160)] + [(1, " ".join(other), None, None), (2, " ".join(same), None, None)]
    got = {r.doc_id: r.verdict for r in found(spark, docs, [(1, passage(1), None)]).collect()}
    assert got.get(1, "similar") == "similar" and got[2] == "paraphrase"


def test_sparse_is_the_dense_matrix():
    rng = np.random.default_rng(1)
    flat, row, idf = rng.integers(-1, 14, 400), np.sort(rng.integers(0, 30, 400)), rng.random(10) + 0.5
    x = Sparse.of(flat, row, 30, idf, 0.7)
    dense = np.zeros((30, 10))
    for w, r in zip(flat, row):
        if 0 <= w < 10:
            dense[r, w] += idf[w]
    norm = np.sqrt((dense**2).sum(1) + 0.49 * np.bincount(row[flat < 0], minlength=30))
    dense /= np.maximum(norm, 1e-9)[:, None]
    few = np.array([3, 7, 8, 20])
    for terms in (10, 9_000):  # written out, and word by word
        basis, total = rng.random((terms, 4)), np.zeros((terms, 4))
        x.table = None
        assert np.allclose(x.times(basis), dense @ basis[:10], atol=1e-5)
        assert np.allclose(x.part(few).times(basis), (dense @ basis[:10])[few], atol=1e-5)
        x.gather(x.times(basis), total)
        assert np.allclose(total[:10], dense.T @ dense @ basis[:10], atol=1e-5) and not total[10:].any()


def test_empty(spark):
    assert found(spark, [], [(1, passage(1), None)]).count() == 0
    assert found(spark, [(1, plain(1), None, None)], []).count() == 0
