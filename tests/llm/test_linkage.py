import random

from pyspark.sql import functions as F

from pagelode.llm.linkage import candidate_pairs, core_words, link, random_pairs, records

A = "company_id bigint, company_name string, hq_city string, industry string, founded_year int, revenue_musd double, id string, confidence string"
B = "entity_id bigint, entity_name string, former_names string, business_city string, sic_description string, incorporated_year int, revenue_usd double, names string"


def test_core_words(spark):
    names = ["The Segutor Retail Company of Marlow Sands", "Jalellen Fertiliser p.l.c.", "Bafilor & Co plc", "X Water Company (UK)", None, ""]
    got = [r[0] for r in spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").orderBy("i").select(core_words(F.col("n"))).collect()]
    assert got[:4] == [["segutor", "retail"], ["jalellen", "fertiliser"], ["bafilor"], ["x", "water"]] and got[4] is None and got[5] == []


def both(spark, a, b):
    ra = records(spark.createDataFrame(a, A), "company_id", "company_name", None, "hq_city", "industry", "founded_year", F.col("revenue_musd") * 1e6)
    rb = records(spark.createDataFrame(b, B), "entity_id", "entity_name", "former_names", "business_city", "sic_description", "incorporated_year", F.col("revenue_usd"))
    return link(ra, rb)


TRADES = ["Glass", "Paper", "Water", "Rail", "Media", "Solar", "Foods"]
CITIES = ["Ashgate", "Vantry", "Port Ellory", "Dunmoor", "Corvale"]


def world():
    a, b, truth = [], [], set()
    for i in range(200):
        trade, city, year, money = TRADES[i % 7], CITIES[i % 5], 1900 + (i * 7) % 100, 10.0 + i * 3
        first, second = ("Ba", "Ke", "Do", "Mi", "Fu", "La", "Pe", "So")[i % 8], ("ron", "lim", "tak", "ved", "gus", "nor")[i % 6]
        name = f"{first}{second}{'aeiou'[i % 5]}{'xzvlmn'[i // 34]} {trade}"
        a.append((i, name + " plc", city, trade + " Products", year, money, None, None))
        if i % 2 == 0:
            b.append((1000 + i, (name.upper() if i % 4 else name) + " Group", None, city if i % 6 else None, "Wholesale-" + trade, year + (i % 3 == 0), money * 1e6 * 1.01, None))
            truth.add((i, 1000 + i))
        else:
            b.append((1000 + i, name + " Ltd", None, CITIES[(i + 2) % 5], TRADES[(i + 3) % 7], year - 30, money * 5e6, None))
    return a, b, truth


def test_matches_and_lookalikes(spark):
    a, b, truth = world()
    b.append((5000, "Other plc", a[7][1], a[7][2], "GLASS", a[7][4], a[7][5] * 1e6, None))
    b.append((5000, "Other plc", a[7][1], a[7][2], "GLASS", a[7][4], a[7][5] * 1e6, None))
    got = {(r.ia, r.ib) for r in both(spark, a, b).where("confidence >= 0.5").collect()}
    assert got == truth | {(7, 5000)}


def test_nulls_and_empty(spark):
    a, b, _ = world()
    none = (None,) * 7
    assert both(spark, [(999, *none), (None, "x", *none[1:])] + a[:5], [(998, *none), *b[:5]]).where("ia = 999 or ib = 998").count() == 0
    assert both(spark, [], []).count() == 0 and "confidence" in both(spark, a[:3], []).columns


def test_hot_block_is_narrowed_not_lost(spark):
    """All records agree in everything but the name: only the names can tell, and no block is dropped."""
    rng = random.Random(3)
    syllables = ["ba", "ker", "dol", "mip", "fut", "lag", "pez", "sov", "nim", "tug", "rax", "wen"]
    names = sorted({"".join(rng.choices(syllables, k=4)) for _ in range(300)})
    a = [(i, f"{n} Glass plc", "Ashgate", "Glass Products", 1950, 10.0, None, None) for i, n in enumerate(names)]
    b = [(i, f"{n.upper()} Glass Ltd", None, "Ashgate", "glass", 1950, 1e7, None) for i, n in enumerate(names)]
    got = both(spark, a, b).where("name = 4").collect()
    assert {(r.ia, r.ib) for r in got if r.confidence >= 0.5} >= {(i, i) for i in range(len(names))}


def test_hot_block_keeps_every_pair(spark):
    """Names without a common initial, of trade words only or missing lose nothing in a block beyond the bound."""
    names = ["Zorvane", "Paper Products plc", None, *(f"{'BCDFGHJKLM'[i % 10]}arn{i}" for i in range(117))]
    others = ["Quillip", "Paper Products Ltd", None, *(f"{'NPRSTVWXYZ'[i % 10]}olt{i}" for i in range(97))]
    a = [(i, n, "Ashgate", "Glass Products", 1950, None, None, None) for i, n in enumerate(names)]
    b = [(1000 + i, n, None, "Ashgate", "glass", 1950, None, None) for i, n in enumerate(others)]
    ra = records(spark.createDataFrame(a, A), "company_id", "company_name", None, "hq_city", "industry", "founded_year", F.col("revenue_musd") * 1e6)
    rb = records(spark.createDataFrame(b, B), "entity_id", "entity_name", "former_names", "business_city", "sic_description", "incorporated_year", F.col("revenue_usd"))
    for most in (10_000, 60):
        got = candidate_pairs(ra, rb, ["paper", "products"], most).collect()
        assert sorted((r.ia, r.ib) for r in got) == [(i, 1000 + j) for i in range(120) for j in range(100)]


def test_random_pairs_take_every_record(spark):
    """Chance pairs draw on nearly all records of both sources, about as many as asked for, whatever their attributes."""
    left, right = (spark.range(k).select(F.col("id"), F.lit("same").alias("city")) for k in (3_000, 2_000))
    got = random_pairs(left, right, 3_000, 2_000).cache()
    assert got.select("ia").distinct().count() > 2_700 and got.select("ib").distinct().count() > 1_900
    assert 0.5 < got.count() / (4 * 3_000) < 1.5
    assert random_pairs(left.limit(0), right, 0, 2_000).count() == 0
