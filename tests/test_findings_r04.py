"""Findings of round 4: searches of very many queries on large tables."""

import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from wardline.operators import many, search
from wardline.plans import answers
from wardline.registry import queries as registry
from wardline.registry.asked import asked
from wardline.sources import layers


@pytest.fixture(scope="module")
def small(spark):
    g = registry.gold(spark, SMALL)
    return g, search.silver_view(g)


def _written(spark, before=()):
    root = layers.shared_root(spark).removeprefix("file://")
    return {name: f"{root}/{name}" for name in os.listdir(root) if name not in before}


def test_what_leaves_a_search_does_not_grow_with_the_table(spark, small, monkeypatch):
    """Each query is answered over all groups of records in one task, so k pairs of it leave the search
    however many groups there are; no copy of the texts is stored, and the groups are deleted."""
    for name, size in (("GROUP_ROWS", 20), ("UNIT_ROWS", 8), ("QUERIES_PER_TASK", 1)):
        monkeypatch.setattr(many, name, size)
    monkeypatch.setattr(search, "MANY_QUERIES", 0)
    queries = asked(spark).crossJoin(spark.range(4)).drop("id")
    left, inner = [], many.top_k
    monkeypatch.setattr(many, "top_k", lambda df, *a, **b: left.append(df.count()) or inner(df, *a, **b))
    before = _written(spark)
    found = search.hybrid_search(*small, queries, 3)
    assert 0 < found.count() <= left[0] <= 3 * queries.count()
    new = _written(spark, before)
    assert new and not [n for n in new if n.startswith(("groups", "terms"))]
    assert not [n for n, path in new.items() if "text" in spark.read.parquet(path).columns]


def test_many_queries_with_few_records_of_many_names_and_sets(spark, small, monkeypatch):
    """One path and the other give the same pairs where gold records tell terms too, names have parts,
    trust is equal and ids repeat across them."""
    g, _ = small
    g = g.withColumns({
        "name": F.when(F.col("facility_id") % 4 != 0, F.concat(F.lit("n"), F.col("facility_id") % 3)).otherwise(F.col("name")),
        "trust_score": F.floor(F.col("trust_score") / 20) * 20.0,
        "capabilities": F.concat("capabilities", F.when(F.col("facility_id") % 5 == 0, F.array(F.lit("icu surgery care")))
                                 .otherwise(F.array(F.lit("trauma"))))})
    s = search.silver_view(g)
    rows = [(i, words, [state], None) for i, (words, state) in enumerate([
        ("icu surgery trauma care dialysis emergency ward unit", None), ("surgery care", "BRAZIL"),
        ("trauma icu", None), ("zzz", None), ("the and for with unit", "EGYPT")])]
    queries = spark.createDataFrame([(i, w, st[0], t) for i, w, st, t in rows],
                                    "query_id long, search_text string, state string, min_trust_score double")
    hits = lambda df: sorted(map(tuple, df.drop("final_score").collect()))
    monkeypatch.setattr(search, "MANY_QUERIES", 1000)
    want = hits(search.hybrid_search(g, s, queries, 12))
    monkeypatch.setattr(search, "MANY_QUERIES", 0)
    for unit, group in ((16_384, 65_536), (7, 30)):
        monkeypatch.setattr(many, "UNIT_ROWS", unit)
        monkeypatch.setattr(many, "GROUP_ROWS", group)
        assert hits(search.hybrid_search(g, s, queries, 12)) == want and want


def test_terms_held_by_texts(monkeypatch):
    """As Python's `in` finds them, with letters of several bytes, white space that is none of the
    separators, and terms in parts."""
    pick = random.Random(4)
    word = lambda n: "".join(pick.choice("ab\u00e9\u6f22\xa0.x") for _ in range(n))
    for _ in range(40):
        terms = sorted({word(pick.randint(1, 6)) for _ in range(pick.randint(0, 40))})
        texts = [pick.choice([None, "", " ", *["".join(pick.choice("ab\u00e9\u6f22\xa0.x \t\n\x0b")
                                                     for _ in range(pick.randint(0, 60)))] * 6]) for _ in range(20)]
        monkeypatch.setattr(many, "MARKS_PER_SCAN", pick.choice([10, 1 << 20]))
        monkeypatch.setattr(many, "BYTES_PER_SCAN", pick.choice([20, 1 << 20]))
        step = pick.choice([3, 1000])
        given, got = pa.array(terms, pa.large_string()), []
        scans = [many._Terms(given.slice(i, step), i) for i in range(0, len(terms), step)]
        column = pa.array(texts, pa.string())
        for a, b in many._slices(column):
            got += many._held_in(column.slice(a, b - a), scans)
        assert [many._unpacked(b).tolist() for b in got] == [
            [i for i, term in enumerate(terms) if text and term in text] for text in texts]


def test_whole_texts_are_shuffled_once_at_most(spark, small, monkeypatch):
    """Facts of found records are the same by both joins; a shuffle carries one text a record."""
    g, s = small
    monkeypatch.setattr(search, "MANY_QUERIES", 0)
    few = answers.answer_batch(g, s, asked(spark), 10, chars=300)
    plans, inner = [], answers.cut
    monkeypatch.setattr(answers, "cut", lambda df: plans.append(df._jdf.queryExecution().toString()) or inner(df))
    monkeypatch.setattr(answers, "FEW_FOUND", 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        many_found = answers.answer_batch(g, s, asked(spark), 10, chars=300).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    key = lambda r: (r.query_id, r["rank"])
    assert sorted(few.collect(), key=key) == sorted(many_found, key=key) and many_found
    joined = [p.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0] for p in plans if "_wanted" in p][-1]
    above = joined[:joined.index("Join")]
    assert "searchable_text" not in above and "source_text" in above
