import random

from pagelode.llm.pieces import number_pieces, split_files, split_texts

SCHEMA = "k string, text string, piece string, start int"


def cut(spark, rows, **more):
    return split_texts(spark.createDataFrame(rows, SCHEMA), ["k"], "text", **more)


def check(text, pieces, limit, overlap):
    pieces = sorted(pieces)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for (a, b, p), nxt in zip(pieces, pieces[1:] + [None]):
        assert text[a:b] == p and 0 < b - a <= limit
        if nxt:
            assert 0 <= b - nxt[0] <= overlap and nxt[0] > a


def prose(n, seed=0):
    r = random.Random(seed)
    return "".join(r.choice(["word ", "longer-word ", "end. ", "é" * 40 + " ", "para.\n\n", "line\n", "𝒳𝒴 "]) for _ in range(n))


def test_cover_limit_and_overlap(spark):
    texts = {"a": prose(3000), "b": "x" * 9001, "c": "short", "d": "", "e": prose(9000, 1), "f": "w" * 399 + " " + "y" * 700}
    rows = [(k, t, None, 1) for k, t in texts.items()] + [("n", None, None, None), (None, "z " * 400, None, None)]
    got = number_pieces(cut(spark, rows, limit=400, overlap=40, span=5000), ["k"]).collect()
    by = {}
    for r in got:
        by.setdefault(r.k, []).append((r.start, r.end, r.piece))
    assert {k for k in by if k} == {"a", "b", "e", "f"}
    for k, p in by.items():
        if k:
            check(texts[k], p, 400, 40)
    order = [r.start for r in sorted((r for r in got if r.k == "e"), key=lambda r: r.piece_no)]
    assert order == sorted(order) and sorted(r.piece_no for r in got if r.k == "e") == list(range(len(order)))


def test_natural_boundaries(spark):
    text = ("One sentence here. " * 30).strip()
    got = sorted((r.start, r.end, r.piece) for r in cut(spark, [("a", text, None, 0)], limit=200, overlap=0, span=1000).collect())
    assert all(p.rstrip().endswith(".") for *_, p in got)
    text = "a" * 150 + "\n\n" + "b" * 150
    assert sorted(r.end for r in cut(spark, [("a", text, None, 0)], limit=200, overlap=0, span=1000).collect())[0] == 152


def test_exactly_the_limit_empty_table_and_repeats(spark):
    assert cut(spark, [("a", "x" * 400, None, 0)], limit=400, overlap=10, span=1600).count() == 0
    assert cut(spark, []).count() == 0
    twice = cut(spark, [("a", "x" * 401, None, 0)] * 2, limit=400, overlap=10, span=1600)
    assert twice.count() == 4


def test_giant_file_by_ranges(spark, tmp_path):
    text = prose(30_000, 4) + "q" * 3000 + prose(2000, 5)
    path = tmp_path / "big.txt"
    path.write_text(text, encoding="utf-8")
    (tmp_path / "empty.txt").write_text("")
    got = split_files(spark, [str(path), str(tmp_path / "empty.txt")], limit=400, overlap=40, span=20_000).collect()
    check(text, [(r.char_start, r.char_start + len(r.piece), r.piece) for r in got], 400, 40)
    raw = path.read_bytes()
    assert all(raw[r.byte_start : r.byte_end].decode() == r.piece for r in got)
