import random

from pagelode.llm.reading import _isotonic, held_out_error, language, prose, reading_level

EASY = "We sold the red hats. Kids like the new bikes. The man put the cups on a low shelf. We had a good week. The rain was bad.".split(". ")
HARD = "The determination of contractual consideration necessitates probabilistic evaluation of macroeconomic contingencies. Indemnification obligations consequently survive notwithstanding applicable regulatory determinations. Remeasurement of actuarial liabilities necessitates comprehensive disclosure.".split(". ")


def text(kind, seed, n=8):
    r = random.Random(seed)
    return ". ".join(r.choice(kind).rstrip(".") for _ in range(n)) + "."


def test_prose():
    t = "Acme Water plc - Information Department 2020\n\nWe sold hats.\nAnd it rained\n\nHats | 3 | 9\nNet income  17,912  68,648\n<--- Page Split --->\n- The shop is\nred.\n\nThis summary does not constitute an invitation to subscribe for securities."
    assert prose(t) == [["We sold hats", "And it rained"], ["The shop is red"]]


def test_language():
    assert language("the man and the dog".split()) == "en" and language("le chat et la souris".split()) == "fr" and language("xx yy".split()) is None and language([]) is None


def test_isotonic():
    assert _isotonic([(1, 1, 1), (2, 5, 1), (3, 3, 1), (4, 9, 1)]) == [(1, 1), (2, 4.0), (3, 4.0), (4, 9)]


def test_levels(spark):
    rows = [(i, text(EASY, i), None) for i in range(40)] + [(100 + i, text(HARD, i), None) for i in range(60)]
    rows.append((200, "Acme Water plc - Information Department 2020\n\n" + text(EASY, 7).replace(". ", "\n") + "\n\nHats | 3 | 9\n\nThis summary does not constitute an invitation to subscribe for securities; recipients should consult regulatory disclosure.", "x"))
    rows += [(201, None, None), (202, "", None), (None, text(EASY, 1), None), (203, "La société a réduit son endettement et la hausse des volumes reste une priorité.", None), (204, "We sold hats.", None), (205, "x" * 60_000, None), (206, text(EASY, 3) + " " + text(HARD, 3), None), (7, text(EASY, 7), None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, level string")
    got = reading_level(df, "doc_id", "text").collect()
    assert len(got) == len(rows) - 1
    level = {r.doc_id: r.level for r in got}
    assert all(level[i] < 5 for i in range(40)) and level[200] < 5
    assert all(level[100 + i] > 8 for i in range(60)) and level[206] > 8
    assert [level[i] for i in (201, 202, 203, 204, 205)] == [None] * 5
    assert {r.doc_id: r.lang for r in got}[203] == "fr"


def test_empty(spark):
    assert reading_level(spark.createDataFrame([], "doc_id bigint, text string"), "doc_id", "text").count() == 0


def test_held_out_error(spark):
    rows = [(i, text(EASY, i)) for i in range(60)] + [(100 + i, text(HARD, i)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    r = held_out_error(reading_level(docs, "doc_id", "text", folds=2)).first()
    assert r.documents > 100 and r.mean_error < 3
