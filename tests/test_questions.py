"""User questions by both routes, records stored as JSON text, tables bucketed by name."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from wardline.operators import gold as G, present, search, silver as S, stats, stored
from wardline.operators.pairs import name_pairs
from wardline.plans.answers import answer_questions
from wardline.registry import queries as registry
from wardline.sources import layers, sinks

ASKED = "query_id long, query string, ui_state string, ui_min_trust double"


@pytest.fixture(scope="module")
def small(spark):
    g = registry.gold(spark, SMALL)
    return g, search.silver_view(g), registry.gap_table(spark, SMALL), registry.search_index(spark, SMALL)


def test_both_routes_of_repeated_and_null_ids(spark, small):
    g, s, table, index = small
    rows = [(1, "Hospitals with surgery", "All", None), (1, "states lack dialysis", None, 90.0),
            (None, "Hospitals with surgery", None, 0.0), (2, " a ", None, None), (3, None, None, None),
            (4, "zzzqqq wwwvvv", None, None)]
    out = answer_questions(g, s, table, spark.createDataFrame(rows, ASKED).repartition(3), 5, index)
    said = out.answers.collect()
    assert sorted((str(r.query_id), r.route) for r in said) == [
        ("1", "gap"), ("1", "search"), ("4", "search"), ("None", "search")]
    cards = out.cards.collect()
    per = {}
    for r in cards:
        per.setdefault(r.question, []).append(r)
    for a in said:
        ranks = sorted(r["rank"] for r in per.get(a.question, []))
        assert ranks == list(range(1, len(ranks) + 1))
        assert (a.total_found > 0) == bool(ranks)
        assert a.candidates == a.total_found
    none = next(a for a in said if a.query_id == 4)
    assert none.total_found == 0 and none.answer.startswith("No facilities found")
    one, null = ([(r.rank, r.name) for r in sorted(per[a.question], key=lambda r: r["rank"])]
                 for a in said if a.route == "search" and a.query_id != 4)
    assert one == null and 0 < len(one) <= 5
    gap = [r for r in cards if r.route == "gap"]
    assert gap and all(r.type == "Desert Zone" and r.phone is None for r in gap)


def test_slider_and_chosen_state(spark, small):
    g, s, table, index = small
    state = g.where("address_state is not null").groupBy("address_state").count() \
        .orderBy(F.desc("count")).first()[0]
    rows = [(1, "hospital surgery trust above 1", None, 45.0), (2, "hospital surgery trust above 45", None, 0.0),
            (3, "hospital surgery trust above 99", None, 1.0), (4, "surgery care", state, None)]
    out = answer_questions(g, s, table, spark.createDataFrame(rows, ASKED), 10, index).cards.collect()
    by = {q: sorted((r["rank"], r.name, r.pin_code) for r in out if r.query_id == q) for q in range(1, 5)}
    assert by[1] == by[2] and len(by[3]) >= len(by[1])
    assert by[3] and by[4] and all(r.location.endswith(state) for r in out if r.query_id == 4)


def test_questions_without_sliders_and_of_an_empty_table(spark, small):
    g, s, table, index = small
    plain = spark.createDataFrame([(7, "states lack dialysis")], "query_id long, query string")
    out = answer_questions(g, s, table, plain, 5, index)
    assert [r.route for r in out.answers.collect()] == ["gap"] and out.cards.count() > 0
    none = answer_questions(g, s, table, plain.where("query_id < 0"), 5, index)
    assert none.answers.count() == none.cards.count() == 0
    nothing = answer_questions(g, s, table.where("false"), plain, 5, index)
    assert nothing.answers.collect()[0].answer.startswith("No medical desert data")


def test_record_columns_reach_results_and_profiles(raw_rows, spark):
    raw = raw_rows({"name": "A", "description": "icu ventilator"}, {"name": "B"})
    contact = {"officialPhone": "1", "officialWebsite": "w", "email": "nan", "address_line1": "road",
               "operatorTypeId": " Public ", "yearEstablished": "1990"}
    full = raw.withColumns({c: F.when(F.col("name") == "A", v) for c, v in contact.items()})
    for table, want in ((full, ("1", "w", "", "road", "public", "1990")), (raw, ("",) * 6)):
        g = G.build_gold(S.clean_silver(table))
        s = search.silver_view(g)
        names = spark.createDataFrame([("A",)], "name string")
        p = stats.facility_profiles(g, s, names).collect()[0]
        assert (p.phone, p.website, p.email, p.address_line, p.operator_type, p.year_established) == want
        q = spark.createDataFrame([(1, "ventilator")], "query_id long, search_text string")
        found = search.with_details(search.hybrid_search(g, s, q, 5), g, s)
        r = present.format_results(found).collect()[0]
        assert (r.phone or "", r.website or "") == want[:2]


JSON = [('{"has_icu": true, "has_emergency":false}', True, False),
        ('{"has_icu":true}', True, None), ('{"has_icu": "true", "has_emergency": 1}', None, None),
        ("not json", None, None), (None, None, None), ("", None, None), ("[true]", None, None),
        ('{"has_icu": null}', None, None)]


def test_flags_in_json_text(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(JSON)], "i int, said string")
    for form in (df, df.withColumn("said", F.try_parse_json("said"))):
        v = stored.variant_of(form, "said")
        got = form.select("i", stored.flag(v, "has_icu").alias("a"), stored.flag(v, "has_emergency").alias("b"),
                          stored.filter_flag(form, "said", "has_icu").alias("f")).orderBy("i").collect()
        assert [(r.a, r.b) for r in got] == [(a, b) for _, a, b in JSON]
        assert [r.f for r in got] == [a is True for _, a, _ in JSON]


def test_lists_from_text_and_arrays(spark):
    texts = ['["x", "y"]', "[]", "nope", None, '{"a": 1}', "null", '["x", 1, null]']
    want = [["x", "y"], [], [], [], [], [], ["x", "1", None]]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, contradictions string")
    assert [r[0] for r in df.orderBy("i").select(stored.contradictions(df)).collect()] == want
    lists = spark.createDataFrame(list(enumerate(want + [None])), "i int, contradictions array<string>")
    assert [r[0] for r in lists.orderBy("i").select(stored.contradictions(lists)).collect()] == want + [[]]
    shown = spark.createDataFrame([("a | b|c |d|e",), (None,)], "specialties string")
    assert [r[0] for r in shown.select(stored.shown_specialties(shown)).collect()] == [["a", "b", "c", "d"], []]
    shown = spark.createDataFrame([(["a ", "b", "c", "d", "e"],), (None,)], "specialties array<string>")
    assert [r[0] for r in shown.select(stored.shown_specialties(shown)).collect()] == [["a ", "b", "c", "d"], []]


def test_read_form_of_lacking_and_nested_columns(spark):
    bare = spark.createDataFrame([("1",)], "facility_id string")
    r = stored.read_form(bare).collect()[0]
    assert (r.has_icu, r.capabilities, r.contradictions, r.trust) == (None, [], [], None)
    nested = spark.sql("""SELECT named_struct('has_icu', true) AS extracted_availability,
        array('a') AS extracted_capabilities, named_struct('digital_presence', 2.5D) AS trust_score_breakdown,
        named_struct('doctor_count', 3) AS extracted_staff, array('x') AS contradictions""")
    r = stored.read_form(nested).collect()[0]
    assert (r.has_icu, r.has_24_7, r.capabilities, r.trust.digital, r.inferred_doctors, r.contradictions) == (
        True, None, ["a"], 2.5, 3, ["x"])


def test_bucketed_tables_join_without_an_exchange(spark, small):
    g, s, _, _ = small
    names = []
    for side, df in (("g", g.select("name", "trust_score")), ("s", s.select("name", "address_state"))):
        path = layers.scratch_path(spark, side)
        names.append(path.rsplit("/", 1)[1].replace("-", "_"))
        sinks.write_by_name(df, names[-1], path, 8)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = name_pairs(spark.table(names[0]), spark.table(names[1]))
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        got = sorted(map(tuple, joined.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for n in names:
            spark.sql(f"DROP TABLE {n}")
    assert got == sorted(map(tuple, name_pairs(g, s).collect()))
