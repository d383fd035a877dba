"""The paths that large or uneven inputs take, against brute force on small fixtures."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline.functions import columns as X
from wardline.operators import geo, intents, pairs, search, stats, substring, validate, vector
from wardline.registry import queries as registry
from wardline.registry.asked import asked
from wardline.sources import layers, readers, sinks
from tests.conftest import SMALL


def km(a, b):
    p1, p2 = math.radians(a[0]), math.radians(b[0])
    h = (math.sin(math.radians(b[0] - a[0]) / 2) ** 2
         + math.cos(p1) * math.cos(p2) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2)
    return 2 * 6371 * math.asin(math.sqrt(min(1, h)))


def test_contains_join_matches_brute_force(spark):
    rnd = random.Random(1)
    texts = [(i, "".join(rnd.choice("abc d") for _ in range(40))) for i in range(60)]
    texts += [(100, ""), (101, "a"), (102, None)]
    needles = ["a", "bc", "abc", "d ab", "zzz", "cab", " "]
    got = substring.contains_join(
        spark.createDataFrame(texts, "id int, t string"), "id", "t",
        spark.createDataFrame([(n,) for n in needles], "n string"), "n").collect()
    want = {(i, n) for i, t in texts if t is not None for n in needles if n in t}
    assert {(r.id, r.n) for r in got} == want and len(got) == len(want)


def test_contains_scan_matches_brute_force(spark, monkeypatch):
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("abc") for _ in range(rnd.randrange(9))) for _ in range(300)] + [None]
    needles = ["a", "bc", "abc", "zzz", "cab", "", None, "a"]
    monkeypatch.setattr(substring, "NEEDLES_PER_SCAN", 2)
    got = substring.contains_scan(spark.createDataFrame([(t,) for t in texts], "t string"), "t",
                                  spark.createDataFrame([(n,) for n in needles], "n string"), "n").collect()
    want = {(t, n) for t in texts if t for n in needles if n and n in t}
    assert {(r.t, r.n) for r in got} == want and len(got) == len(want)


def test_first_pairs_is_the_head_of_the_join(spark):
    rnd = random.Random(2)
    # one key holds most rows of both sides
    left = [(i, "hot" if i % 3 else f"k{i % 5}", rnd.randrange(4)) for i in range(300)]
    right = [(i, "hot" if i % 2 else f"k{i % 5}") for i in range(200)]
    a = spark.createDataFrame(left, "l int, k string, s int")
    b = spark.createDataFrame(right, "r int, k string")
    got = pairs.first_pairs(a, b, ["k"], [F.col("s").desc(), F.col("l")], [F.col("r")], 50,
                            "l", "r").collect()
    want = set()
    for key in {k for _, k, _ in left}:
        both = sorted((-s, i, j) for i, k, s in left if k == key for j, kk in right if kk == key)
        want |= {(key, i, j) for _, i, j in both[:50]}
    assert {(r.k, r.l, r.r) for r in got} == want and len(got) == len(want)


@pytest.fixture(scope="module")
def small_gold(spark):
    return registry.gold(spark, SMALL)


def rows(df):
    return sorted(tuple(r) for r in df.select(
        "query_id", "rank", "gold_id", "silver_id", "relevance_score").collect())


def test_search_block_by_block_equals_all_blocks(spark, small_gold, monkeypatch):
    s = search.silver_view(small_gold)
    one = rows(search.hybrid_search(small_gold, s, asked(spark), 10))
    monkeypatch.setattr(search, "BLOCK_ROWS", 4)
    monkeypatch.setattr(search, "FIRST_BLOCKS", 1)
    monkeypatch.setattr(search, "NEXT_BLOCKS", 3)
    assert rows(search.hybrid_search(small_gold, s, asked(spark), 10)) == one


def test_blocks_that_cannot_enter_are_not_opened(spark, small_gold, monkeypatch):
    """One block is opened per query; the rest of them hold worse answers only."""
    records = [(f"{i:03d}", f"n{i}", 99.0 - i // 10, "ventilator" if i % 10 == 0 else "bed") for i in range(400)]
    g = small_gold.limit(1).drop("facility_id", "name", "trust_score", "searchable_text").crossJoin(
        spark.createDataFrame(records, "facility_id string, name string, trust_score double, searchable_text string"))
    opened = []
    inner = search._opened
    monkeypatch.setattr(search, "BLOCK_ROWS", 4)
    monkeypatch.setattr(search, "FIRST_BLOCKS", 6)
    monkeypatch.setattr(search, "_opened", lambda blocks, *rest: opened.append(blocks.count()) or inner(blocks, *rest))
    q = asked(spark).where("query_id = 7").withColumn("search_text", F.lit("ventilator"))
    found = search.hybrid_search(g, search.silver_view(g), q, 1)
    assert [r.gold_id for r in found.collect()] == ["000"] and sum(opened) <= 12


def test_600_queries_match_brute_force(spark, small_gold):
    rnd = random.Random(8)
    g = small_gold.limit(60)
    recs = [r.asDict() for r in g.collect()]
    words = sorted({w for r in recs for w in r["searchable_text"].split() if w.isalnum() and len(w) > 3})
    states = sorted({r["address_state"] for r in recs if r["address_state"]})
    asks = []
    for i in range(600):
        text = " ".join(rnd.sample(words, rnd.randrange(4)))
        asks.append((i, rnd.choice([None, "", *states, "A"]), rnd.choice([None, None, 30.0, 60.0]),
                     rnd.random() < 0.2, text))
    q = spark.createDataFrame(asks, "query_id long, state string, min_trust_score double, requires_icu boolean, search_text string")
    got = rows(search.hybrid_search(g, search.silver_view(g), q, 5))
    terms = {r["spec"]["query_id"]: [t["term"] for t in r["spec"]["terms"]] for r in search.search_specs(q).collect()}
    want = []
    for i, state, trust, icu, _ in asks:
        hits = []
        for a in recs:
            for b in recs:
                if a["name"] != b["name"] or (trust and a["trust_score"] < trust) or (icu and not a["has_icu"]):
                    continue
                if state is not None and (b["address_state"] is None or state not in b["address_state"]):
                    continue
                hay = "\n".join([b["searchable_text"], *b["specialties"], *a["capabilities"]])
                rel = sum(t in hay for t in terms[i])
                if rel or not terms[i]:
                    hits.append((-rel, -a["trust_score"], a["facility_id"], b["facility_id"]))
        want += [(i, n + 1, x[2], x[3], -x[0]) for n, x in enumerate(sorted(hits)[:5])]
    assert got == sorted(want)


def test_repeated_and_null_query_ids_lose_no_answer(spark, small_gold, monkeypatch):
    s = search.silver_view(small_gold)
    queries = asked(spark).withColumn("query_id", F.expr("if(query_id > 4, null, 7L)"))

    def found():
        got = search.hybrid_search(small_gold, s, queries, 5)
        return rows(got.withColumn("query_id", F.coalesce("query_id", F.lit(-1))))

    one = found()
    monkeypatch.setattr(search, "BLOCK_ROWS", 5)
    assert found() == one and one


def test_search_with_a_hot_name_matches_brute_force(spark, small_gold):
    g = small_gold.withColumn("name", F.when(F.col("facility_id") % 3 != 0, "same")
                              .otherwise(F.col("name")))
    found = search.hybrid_search(g, search.silver_view(g), asked(spark), 100)
    recs = [r.asDict() for r in g.collect()]
    terms = {q: t for q, t in spark.createDataFrame(search.search_specs(asked(spark)).select(
        "spec.query_id", F.transform("spec.terms", lambda t: t.getField("term")).alias("t"))
        .collect()).collect()}
    want = []
    for q in (3, 6, 7):
        got = []
        for a in recs:
            for b in recs:
                if a["name"] != b["name"]:
                    continue
                if q == 3 and not any("nephrology" in x or "dialysis" in x
                                      for x in b["specialties"]):
                    continue
                hay = "\n".join([b["searchable_text"], *b["specialties"], *a["capabilities"]])
                rel = sum(t in hay for t in terms[q])
                if rel or not terms[q]:
                    got.append((-rel, -a["trust_score"], a["facility_id"], b["facility_id"]))
        want += [(q, i + 1, x[2], x[3], -x[0]) for i, x in enumerate(sorted(got)[:100])]
    assert rows(found.where("query_id in (3, 6, 7)")) == want


def test_vector_blocks_equal_scan(spark, monkeypatch):
    v = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    q = v.where("vec_id < 40").select(F.col("vec_id").alias("query_id"), "embedding")
    scan = sorted(map(tuple, vector.vector_top_k(q, v, 5).collect()))
    monkeypatch.setattr(vector, "QUERIES_PER_BLOCK", 8)
    monkeypatch.setattr(vector, "VECTORS_PER_GROUP", 10)
    assert sorted(map(tuple, vector.vector_top_k(q, v, 5).collect())) == scan
    data = {r.vec_id: np.array(r.embedding, dtype=float) for r in v.collect()}
    unit = {i: x / np.linalg.norm(x) for i, x in data.items()}
    best = sorted((-round(float(unit[3] @ u), 4), i) for i, u in unit.items() if i != 3)[:5]
    assert [(r[2], r[3]) for r in scan if r[0] == 3] == [(i, -s) for s, i in best]


def clustered(seed, n):
    """A dense town, a ring about 50 km away, points across the date line and a far island."""
    rnd = random.Random(seed)
    pts = [(20 + rnd.random() * 0.03, 78 + rnd.random() * 0.03) for _ in range(n)]
    pts += [(20 + 0.45 * math.sin(a), 78 + 0.475 * math.cos(a))
            for a in (rnd.random() * 6.3 for _ in range(n))]
    pts += [(60 + rnd.random(), 179.6 + rnd.random() * 0.39) for _ in range(n // 4)]
    pts += [(60 + rnd.random(), -179.99 + rnd.random() * 0.39) for _ in range(n // 4)]
    pts += [(-50.0, 10.0), (-50.0, 10.0), (20.0, 78.0), (20.0, 78.0)]
    return [(i, round(a, 4), round(b, 4)) for i, (a, b) in enumerate(pts)]


@pytest.mark.parametrize("slot_pairs", [10**6, 0])
def test_radius_counts_match_brute_force(spark, monkeypatch, slot_pairs):
    monkeypatch.setattr(geo, "POINT_PAIRS_PER_SLOT", slot_pairs)
    pts = clustered(3, 60)
    able = {i: i % 3 == 0 for i, _, _ in pts}
    df = spark.createDataFrame([(i, a, b, int(able[i])) for i, a, b in pts],
                               "id int, latitude double, longitude double, n bigint")
    got = {r.id: (r["n_50km"], r["n_100km"]) for r in geo.radius_counts(
        df, df.select("latitude", "longitude", "n"), [50.0, 100.0], ["n"], ["n"]).collect()}
    for i, a, b in pts:
        near = [km((a, b), (c, d)) for j, c, d in pts if able[j] and j != i]
        assert got[i] == (sum(x <= 50 for x in near), sum(x <= 100 for x in near)), (i, a, b)


@pytest.mark.parametrize("every, slot_pairs", [(3, 10**6), (3, 0), (40, 0)])
def test_nearest_matches_brute_force(spark, monkeypatch, every, slot_pairs):
    monkeypatch.setattr(geo, "POINT_PAIRS_PER_SLOT", slot_pairs)
    pts = clustered(4, 40)
    df = spark.createDataFrame(
        [(f"{i:05d}", a, b, i % every == 0) for i, a, b in pts],
        "facility_id string, latitude double, longitude double, is_x boolean")
    got = {int(r.facility_id): r.nearest_km for r in geo.nearest_capable(df, ["x"]).collect()}
    assert len(got) == len(pts)
    for i, a, b in pts:
        want = min(round(km((a, b), (c, d)), 3) for j, c, d in pts if j % every == 0 and j != i)
        assert got[i] == pytest.approx(want, abs=0.0011), (i, a, b)


def test_nearest_label_ties_and_single_target(spark):
    p = spark.createDataFrame([(1.0, 1.0), (5.0, 5.0)], "latitude double, longitude double")
    t = spark.createDataFrame([(1.0, 1.0, "b"), (1.0, 1.0, "a")],
                              "latitude double, longitude double, z string")
    got = {r.latitude: (r.nearest_km, r.label) for r in geo.nearest(p, t, label="z").collect()}
    assert got[1.0] == (0.0, "a") and got[5.0][1] == "a"
    only = spark.createDataFrame([("0", 1.0, 1.0, True)],
                                 "facility_id string, latitude double, longitude double, is_x boolean")
    assert [r.nearest_km for r in geo.nearest_capable(only, ["x"]).collect()] == [None]


def test_longest_place_in_blocks(spark, monkeypatch):
    q = spark.createDataFrame(
        [(1, "Clinics in west bengal or Goa"), (1, "GOA"), (2, "anywhere"), (None, "goa, Delhi; new delhi"),
         (None, None), (3, ""), (None, "Bengal")], "query_id bigint, query string")
    places = spark.createDataFrame([("Goa",), ("West Bengal",), ("Bengal",), (None,), ("",), (" ",),
                                    ("GOA",), ("Delhi",), ("New Delhi",)], "p string")
    want = sorted([(1, "West Bengal"), (1, "GOA"), (2, None), (None, "New Delhi"), (None, None), (3, None),
                   (None, "Bengal")], key=repr)

    def found():
        return sorted(((r.query_id, r.s) for r in intents.longest_place(q, places, "p", "s").collect()), key=repr)

    assert found() == want
    monkeypatch.setattr(intents, "NAMES_PER_SCAN", 2)
    monkeypatch.setattr(intents, "QUESTIONS_PER_SCAN", 3)
    assert found() == want


def test_places_of_20000_names_match_brute_force(spark):
    rnd = random.Random(3)
    names = list({"".join(rnd.choice("abcd ") for _ in range(rnd.randrange(2, 9))).strip() for _ in range(20000)} - {""})
    texts = [(i, "".join(rnd.choice("ABcd ") for _ in range(30))) for i in range(50)]
    got = intents.find_places(spark.createDataFrame(texts, "query_id int, query string"),
                              {"s": (spark.createDataFrame([(n,) for n in names], "p string"), "p")}).collect()
    for r in got:
        held = [(-len(n), n) for n in names if n in r.query.lower()]
        assert r.s == (min(held)[1] if held else None)


@pytest.mark.parametrize("keywords,limit", [
    (["icu", "surgery monitor"], 2000), ([" nephrology ", "oncology emergencymedicine no"], 300), (None, 2500)])
def test_map_filters_come_before_the_limit(spark, small_gold, keywords, limit):
    """More pairs than the limit, keywords on either side of the name join and across it."""
    g = small_gold.withColumn("name", F.when(F.col("facility_id") % 3 != 0, "same").otherwise(F.col("name")))
    g = cut_rows = layers.cut(g)
    recs = [r.asDict() for r in cut_rows.collect()]
    pairs_, texts = [], [k.strip() for k in keywords or []]
    for a in recs:
        if a["trust_score"] is None or a["trust_score"] < 20:
            continue
        right = [*a["capabilities"][:3], (a["capabilities"] or ["No capabilities extracted"])[0], a["name"]]
        for b in recs:
            if b["name"] != a["name"] or b["latitude"] is None or b["longitude"] is None:
                continue
            text = (" ".join(b["specialties"][:4]) + " " + " ".join(
                [" ".join(right[:-2]), *right[-2:]])).lower()
            if not texts or any(t in text for t in texts):
                pairs_.append((-a["trust_score"], a["facility_id"], b["facility_id"]))
    pairs_.sort()
    s = search.silver_view(g)
    got = stats.map_points(g, s, limit, keywords=keywords, min_trust=20).collect()
    assert sorted((-r.trust, r.gold_id, r.silver_id) for r in got) == pairs_[:limit]
    total = stats.map_filter_summary(g, s, keywords=keywords, min_trust=20).collect()[0]
    tenths = sum(round(-10 * t) for t, _, _ in pairs_)
    assert total.visible == len(pairs_) > limit and total.high_trust == sum(t <= -70 for t, _, _ in pairs_)
    assert total.avg_trust == (tenths + 5 * len(pairs_)) // (10 * len(pairs_))


def test_map_filter_of_nothing(spark, small_gold):
    s = search.silver_view(small_gold)
    assert stats.map_points(small_gold, s, state="nowhere").collect() == []
    assert tuple(stats.map_filter_summary(small_gold, s, state="nowhere").collect()[0]) == (0, 0, 0)


@pytest.mark.parametrize("kind", ["clusters", "isotropic", "odd"])
def test_cells_find_the_nearest_vectors(spark, kind):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((600, 8))
    if kind == "clusters":
        x = np.repeat(rng.standard_normal((20, 8)), 30, axis=0) * 3 + 0.2 * x
    if kind == "odd":
        x = np.concatenate([np.zeros((3, 8)), np.ones((40, 8)), x[:5]])
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(-1, None)],
                              "vec_id bigint, embedding array<float>").repartition(4)
    q = v.where("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id")
    exact = vector.vector_top_k(q, v, 5)
    index = vector.build_cells(v)
    want = sorted(map(tuple, exact.collect()))
    assert sorted(map(tuple, vector.search_cells(q, index, 5).collect())) == want
    fast = vector.search_cells(q, index, 5, probes=2 if kind == "clusters" else 16, exact=False)
    found = vector.recall(fast, exact).collect()[0]
    assert found.answers == len(want) and found.recall >= 0.95
    assert vector.search_cells(q, vector.build_cells(v.limit(0)), 5).collect() == []


def test_poisson_sums_have_their_distribution(spark):
    counts = spark.createDataFrame([("a", 1), ("b", 40), ("c", 250_000), ("d", 0)], "g string, n bigint")
    got = validate.poisson_sums(counts, ["g"], 4000).toPandas()
    assert set(got.g) == {"a", "b", "c"} and len(got) == 12000
    for g, n in (("a", 1), ("b", 40), ("c", 250_000)):
        w = got[got.g == g].w
        assert abs(w.mean() - n) < 5 * math.sqrt(n / 4000) and abs(w.var() / n - 1) < 0.15
    ones = got[got.g == "a"].w
    assert abs((ones == 0).mean() - math.exp(-1)) < 0.04 and ones.max() >= 5


def test_claims_stated_late_in_a_text_are_found(spark):
    """Above the former cuts at 300, 400 and 600 characters."""
    text = "x " * 2000 + "An intensive care unit (ICU) is open 24/7."
    rows = [(1, r, "n", True, None, True, ["icu"], text if r == 1 else "y " * 900, 50.0, "low", "c") for r in (1, 2)]
    df = spark.createDataFrame(rows, """query_id int, rank int, name string, has_icu boolean,
        has_emergency boolean, has_24_7 boolean, key_capabilities array<string>, source_text string,
        trust_score double, confidence string, citation string""")
    got = {r["rank"]: r for r in validate.validate_top(df).collect()}
    assert (got[1].overall_verdict, got[2].overall_verdict) == ("VERIFIED", "DISPUTED")
    assert got[1].capabilities_supported and not got[2].capabilities_supported
    disputed = df.where("rank = 1").withColumn("validation_verdict", F.lit("DISPUTED"))
    kept = validate.re_extract(disputed).collect()[0]
    assert kept.has_icu and kept.has_24_7 and kept.key_capabilities == ["icu"]


def test_overview_counts_every_pair(spark, small_gold):
    g = small_gold.withColumn("name", F.when(F.col("facility_id") % 3 != 0, "same")
                              .otherwise(F.col("name")))
    got = stats.overview_stats(g, search.silver_view(g)).collect()[0]
    joined = g.alias("g").join(g.alias("s"), F.col("g.name") == F.col("s.name"))
    want = joined.agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("g.trust_score"), 1).alias("t"),
        F.count_if(F.coalesce("g.has_icu", F.lit(False))).alias("i"),
        F.count_distinct("s.address_state").alias("s")).collect()[0]
    assert (got.total_facilities, got.avg_trust_score, got.icu_confirmed, got.states_covered) == \
        (want.n, want.t, want.i, want.s)


def test_ids_follow_file_order_over_many_files(spark):
    path = layers.scratch_path(spark, "csv")
    df = spark.range(0, 500, numPartitions=7).select(
        F.concat(F.lit("n"), F.col("id")).alias("name"),
        F.when(F.col("id") % 5 == 0, "two\nlines, \"quoted\"").alias("description"))
    sinks.write_csv(df, path)
    back = readers.read_facilities(spark, path, multi_line=True).orderBy("facility_id").collect()
    assert [r.name for r in back] == [f"n{i}" for i in range(500)]
    assert [r.facility_id for r in back] == [f"{i:05d}" for i in range(500)]
    assert back[5].description == 'two\nlines, "quoted"'
    few = readers.read_facilities(spark, path, max_rows=13, multi_line=True).collect()
    assert sorted(r.name for r in few) == sorted(f"n{i}" for i in range(13))


def test_bootstrap_brackets_the_share(spark):
    rows_ = [("S", f"{i:05d}", True if i % 4 == 0 else (None if i % 2 else False))
             for i in range(400)]
    df = spark.createDataFrame(rows_, "address_state string, facility_id string, has_icu boolean")
    r = validate.bootstrap_interval(df, "has_icu").collect()[0]
    assert r.of_all_lower < 0.25 < r.of_all_upper < r.of_known_upper
    assert r.of_known_lower < 0.5 < r.of_known_upper
    again = validate.bootstrap_interval(df.repartition(5), "has_icu").collect()[0]
    assert r == again


def test_hash_number_is_the_documented_one(spark):
    assert spark.range(1).select(X.hash_number(F.lit("7")).alias("h")).collect()[0].h == 2400511071
