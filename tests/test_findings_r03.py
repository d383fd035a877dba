"""Cases of the findings of round 3."""

import os

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from wardline.functions import columns as X
from wardline.operators import claims, gold, many, search, silver, validate
from wardline.plans import answers
from wardline.registry.asked import asked
from wardline.registry.queries import QUERIES, gold as stored_gold
from wardline.sources import derived


@pytest.fixture
def no_partition_setting(spark):
    """A session in which spark.sql.shuffle.partitions was never set."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.unset("spark.sql.shuffle.partitions")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("name", ["distance_severity", "fill_region", "nearest_capable", "radius_counts", "rollup_severity"])
def test_distances_without_a_partition_setting(spark, no_partition_setting, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_gold_searches_its_text_for_beds_once(spark, raw_rows):
    """One lower-cased text serves the rules, the bed count and the claims."""
    spark.conf.set("spark.sql.maxPlanStringLength", str(1 << 24))
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    rows = raw_rows({"facilityTypeId": "Clinic", "description": "Has 60 BEDS.", "capability": "ICU, 70 beds"},
                    {"description": None, "capability": "Closes at 9pm"}, {})
    built = gold.build_gold(silver.clean_silver(rows))
    plan = _plan(built.drop("description", "searchable_text"))
    assert plan.count("regexp_extract_all") == 1 and plan.count("lower(coalesce(description") == 1
    got = built.orderBy("facility_id").collect()
    assert [r.bed_count for r in got] == [70, 0, 0]
    assert got[0].contradictions[0] == "Facility type=clinic but claims 70 beds"


def test_first_sentence_where_words_overlap(spark):
    words = ["icu", "newborn icu", "ot "]
    df = spark.createDataFrame([(t,) for t in (
        "One. A Newborn ICU. An icu.", "ICU here. Newborn icu.", "None. At all.", None, "",
        "A bot walks. Nothing. Icu", "x.  icu")], "t string").withColumn("l", F.lower("t"))
    got = [r.s for r in df.select(X.first_sentence_with("t", "l", words).alias("s")).collect()]
    assert got == ["A Newborn ICU.", "ICU here.", None, None, None, "A bot walks.", "icu"]
    odd = X.first_sentence_with("t", "l", [" icu", "icu", "a. b"])
    assert [r.s for r in df.select(odd.alias("s")).collect()][0] == "A Newborn ICU."


def test_numbers_before_words(spark):
    df = spark.createDataFrame([("12 icu beds and 3 icu beds",), ("icu beds",), ("7\n surgeons",), ("7 beds",)], "t string")
    got = df.select(claims.first_number("t", ["icu bed"]), claims.first_number("t", ["doctors", "surgeons"])).collect()
    assert [tuple(r) for r in got] == [(12, None), (None, None), (None, 7), (None, None)]


def test_index_tasks_follow_the_number_of_records(spark, raw_rows, monkeypatch):
    """One task indexes a bounded number of records, whatever the session's settings."""
    monkeypatch.setattr(search, "TASK_ROWS", 4, raising=False)
    monkeypatch.setattr(search, "BLOCK_ROWS", 1)
    built = gold.build_gold(silver.clean_silver(raw_rows(
        *[{"description": f"Trauma  ward\n{i} of us"} for i in range(20)])))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        index = search.build_index(built, search.silver_view(built))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(index.postings.inputFiles()) > 4
    terms = {r.token for r in index.tokens.where("kind = 'term'").collect()}
    assert {"Trauma", "ward"} <= terms and "of" not in terms


def _hits(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "gold_id", "silver_id", "relevance_score").collect())


def test_many_questions_scan_the_texts_once(spark, monkeypatch):
    """Above a number of queries no query opens blocks of its own; the answers are the same, also
    with a name and texts, terms and queries in many parts."""
    g = stored_gold(spark, SMALL).withColumn("name", F.when(F.col("facility_id") % 3 != 0, "same").otherwise(F.col("name")))
    s = search.silver_view(g)
    queries = asked(spark)
    monkeypatch.setattr(search, "MANY_QUERIES", 1000)
    one = _hits(search.hybrid_search(g, s, queries, 15))
    monkeypatch.setattr(search, "MANY_QUERIES", 0)
    monkeypatch.setattr(search, "_opened", None)
    for name, size in (("UNIT_ROWS", 40), ("GROUP_ROWS", 20), ("TERMS_PER_SCAN", 4), ("QUERIES_PER_TASK", 3)):
        monkeypatch.setattr(many, name, size)
    assert _hits(search.hybrid_search(g, s, queries, 15)) == one and one


def test_checks_read_a_text_once_per_record_found(spark, monkeypatch):
    """Answers with the first characters of their texts are checked against whole ones."""
    g = stored_gold(spark, SMALL)
    s = search.silver_view(g)
    whole, short = (answers.answer_batch(g, s, asked(spark), 10, chars=n).orderBy("query_id", "rank").drop(
        "standards_check").collect() for n in (None, 5))
    assert len(whole) == len(short) > 0
    for a, b in zip(whole, short):
        assert b.source_text == a.source_text[:5]
        assert {**a.asDict(), "source_text": ""} == {**b.asDict(), "source_text": ""}
    read = []
    inner = validate.with_text_facts
    monkeypatch.setattr(validate, "with_text_facts", lambda df, *c: read.append(df.count()) or inner(df, *c))
    got = answers.answer_batch(g, s, asked(spark).crossJoin(spark.range(5)).drop("id"), 10, chars=5)
    assert got.count() > sum(read) and len(read) == 1


def test_gold_tasks_follow_the_bytes_of_the_texts(spark, monkeypatch):
    """One task of the gold layer gets a bounded share of the documents, however large they are."""
    whole = os.path.getsize(f"{SMALL}/documents.parquet")
    monkeypatch.setattr(derived, "TASK_BYTES", whole // 20, raising=False)
    built = stored_gold(spark, f"{SMALL}/")  # a layer of its own
    assert len(built.inputFiles()) >= 15
    assert built.count() == stored_gold(spark, SMALL).count()
