from pagelode.llm.scans import learn, number_on, scanned_noise
from pagelode.session import with_small

SENTENCES = [
    "The committee considers the severe weather and the legal settlement of the regional business to be closed.",
    "Management expects the regional business to remain severe in the market for interest-rate movements.",
    "The annual settlement of legal claims was deferred by the committee in the business of the market.",
]


def page(i, noise=()):
    lines = ["Acme Holdings plc Annual Report 2020  " + str(i), "Risk Factors"]
    for k in range(6):
        words = SENTENCES[(i + k) % 3].split()
        lines += [" ".join(words[:8]), " ".join(words[8:])]
    for at, line in noise:
        lines[at] = line
    return lines


def table(spark, pages, extra=()):
    rows = [("page", f"R#p{i}", "R", i, "\n".join(p), None) for i, p in pages.items()] + list(extra)
    return spark.createDataFrame(rows, "src string, item_key string, report string, page int, text string, noise string")


def found(df):
    return {(r.item_key, n.line_no, n.kind) for r in df.collect() for n in r.noise}


def test_page_numbers():
    assert [number_on(x) for x in ("46 of 215", "| 18", "F-31", "- 1 -", "[7]", "35/135", "Page 19 of 134", "l9", "word", "ix")] == [46, 18, 31, 1, 7, 35, 19, 19, None, -1]


def test_noise_is_found_and_repaired(spark):
    pages = {i: page(i) for i in range(1, 60)}
    pages[60] = page(60, [(3, "the legal settlernent of the regional business"), (5, "be closed in the rnarket and the lega1"), (13, "Page 60")])
    pages[61] = [*page(61), "The committee considers the regio-"]
    pages[62] = ["Acme Holdings plc Annual Report 2020  62", "nal business of the market for interest-", "rate movements. The annual settle¬", "ment was 20l9 in the business."]
    df = scanned_noise(table(spark, pages, [("page", "R#p62", "R", 62, "\n".join(pages[62]), None), ("page", "X", None, None, None, None), ("page", "Y", None, None, "  ", None), (None, None, "R", 3, "x", None)]))
    got = found(df)
    for i in range(1, 60):
        assert {x for x in got if x[0] == f"R#p{i}"} == {(f"R#p{i}", 0, "furniture")}
    assert {x[1:] for x in got if x[0] == "R#p60"} == {(0, "furniture"), (3, "glyph"), (5, "glyph"), (13, "furniture")}
    assert {x[1:] for x in got if x[0] == "R#p61"} == {(0, "furniture"), (len(pages[61]) - 1, "hyphen")}
    assert {x[1:] for x in got if x[0] == "R#p62"} == {(0, "furniture"), (2, "hyphen"), (3, "glyph")}
    text = {r.item_key: r.repaired for r in df.collect()}
    assert "legal settlement of the regional business" in text["R#p60"] and "Page 60" not in text["R#p60"]
    assert "annual settlement was" in text["R#p62"] and "interest-" in text["R#p62"]
    assert "X" not in text and "Y" not in text and sorted(text) == sorted(set(text))


def test_empty_and_very_long(spark):
    assert scanned_noise(table(spark, {})).count() == 0
    r = scanned_noise(table(spark, {1: ["word " * 40_000, "", "x" * 50_000]})).first()
    assert [n.kind for n in r.noise] == []


def test_divided_word_across_any_length(spark):
    """Furniture and blanks of any length may stand between the parts of a word divided at a page's end."""
    pages = {i: [*page(i), "The committee expects the re-entry of the business."] for i in range(1, 40)}
    head = ["gional business of the market.", *page(0)[2:]]
    end = "The committee considers the severe weather and the re-"
    pages[40], pages[41] = [*page(40), end, *[""] * 700, "Page 40"], ["Acme Holdings plc Annual Report 2020  41", *head]
    pages[42], pages[43] = [*page(42), end], ["Acme Holdings plc Annual Report 2020  43", *[""] * 1600, *head]
    pages[44], pages[45] = [*page(44), end], ["Acme Holdings plc Annual Report 2020  45", "entry of the business.", *page(0)[2:]]
    got = {x for x in found(scanned_noise(table(spark, pages))) if x[2] == "hyphen"}
    assert got == {("R#p40", 14, "hyphen"), ("R#p42", 14, "hyphen")}


def test_header_of_one_report_in_a_large_corpus(spark):
    """A header form on a few pages of one report is known there, however many other pages there are, and nowhere else."""
    pages = {i: page(i) for i in range(1, 200)}
    rows = [("page", f"Q#p{i}", "Q", i, "\n".join([f"Borealis review of our harbours  {i}", *page(i)[1:], "Borealis review of our harbours"]), None) for i in range(1, 6)]
    rows += [("page", "S#p1", "S", 1, "\n".join([*page(1)[1:], "Borealis review of our harbours"]), None)]
    model, own = learn(table(spark, pages, rows), header_share=0.1)
    assert "borealis" not in " ".join(model.headers) and [r.report for r in own.collect()] == ["Q"]
    got = found(scanned_noise(table(spark, {i: p for i, p in pages.items() if i < 40}, rows * 1)))
    assert {x[1] for x in got if x[0] == "Q#p1" and x[2] == "furniture"} == {0, 14}


def test_long_words_and_pages_given_twice(spark):
    """A word longer than any known one has no reading but its own; copies of a page count once."""
    rows = [("page", "A#p1", "A", 1, "settlernent" * 400 + "\nthe legal business", None)] * 2
    got = scanned_noise(table(spark, {i: page(i) for i in range(1, 30)}, rows))
    assert got.where("item_key = 'A#p1'").count() == 1
    assert not {x for x in found(got) if x[0] == "A#p1"}


def test_side_table_beyond_the_broadcast(spark):
    """The salted join gives what the broadcast gives, rows without key included."""
    left = spark.createDataFrame([(i, "hot" if i % 3 else None if i % 2 else "cold") for i in range(60)], "id int, k string")
    side = spark.createDataFrame([("hot", 1), ("none", 2)], "k string, v int")
    a, b = ({tuple(r[c] for c in ("id", "k", "v")) for r in with_small(left, side, "k", ["id"], most).collect()} for most in (10, 0))
    assert a == b and len(a) == 60
