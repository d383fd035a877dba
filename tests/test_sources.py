"""Readers and sinks on files that many tasks share, and layers whose values keep their types."""

import json
import math
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.test_scale_paths import km
from wardline.operators import geo
from wardline.sources import layers, readers, sinks


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def csv_text(records):
    quoted = ['"' + r.replace('"', '""') + '"' if any(c in r for c in '",\n\r') else r
              for row in records for r in row]
    lines = [",".join(quoted[i:i + 2]) for i in range(0, len(quoted), 2)]
    return "name,description\n" + "\n".join(lines) + "\n"


def records_of(n, seed):
    """Values with line breaks, quotes and commas; some longer than several splits."""
    rnd = random.Random(seed)
    bits = ["a", "word ", ",", '"', "\n", "\n\n", "\r\n", "é", '","']
    rows = [(f"n{i}", "".join(rnd.choice(bits) for _ in range(rnd.randrange(1, 60)))) for i in range(n)]
    rows[n // 2] = (f"n{n // 2}", "long\n" * 900)
    return rows


def test_records_with_line_breaks_are_read_by_many_tasks(spark, small_splits):
    folder = Path(layers.scratch_path(spark, "quoted"))
    folder.mkdir(parents=True)
    rows = records_of(300, 1)
    for i in range(3):
        (folder / f"f{i}.csv").write_text(csv_text(rows[100 * i:100 * i + 100]), newline="")
    df = readers.read_facilities(spark, str(folder))
    assert df.select(F.spark_partition_id()).distinct().count() > 10
    got = [(r.facility_id, r.name, r.description) for r in df.orderBy("facility_id").collect()]
    whole = readers.read_facilities(spark, str(folder), multi_line=True).orderBy("facility_id").collect()
    assert got == [(r.facility_id, r.name, r.description) for r in whole]
    assert [g[1:] for g in got] == rows
    few = readers.read_facilities(spark, str(folder), max_rows=7).collect()
    assert sorted(r.name for r in few) == [f"n{i}" for i in range(7)]


def test_odd_csv_files(spark, small_splits):
    folder = Path(layers.scratch_path(spark, "odd"))
    folder.mkdir(parents=True)
    (folder / "a.csv").write_text("name,social_count\r\nx,1\r\n\r\n,2\r\ny,\r\nz,no\r\n", newline="")
    (folder / "b.csv").write_text("name,social_count\n", newline="")
    (folder / "c.csv").write_text("", newline="")
    (folder / "d.csv").write_text('name,social_count\n"last\nline",4', newline="")
    rows = readers.read_facilities(spark, str(folder), schema="name string, social_count int") \
        .orderBy("facility_id").collect()
    assert [(r.facility_id, r.name, r.social_count) for r in rows] == [
        ("00000", "x", 1), ("00001", None, 2), ("00002", "y", None), ("00003", "z", None),
        ("00004", "last\nline", 4)]


def test_partitioned_layers_keep_their_values(spark):
    rows = [("007", 1), ("7", 2), ("", 3), (None, 4), ("a/b=c", 5)] + [("hot", i) for i in range(100)]
    df = spark.createDataFrame(rows, "address_state string, n int").repartition(5)
    path = layers.scratch_path(spark, "states")
    sinks.write_layer(df, path, partition_by="address_state")
    back = readers.read_layer(spark, path)
    assert back.schema.simpleString() == "struct<address_state:string,n:int>"
    assert sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))
    assert len(list(Path(path).glob("*/*.parquet"))) == 5  # empty and missing texts share a folder


@pytest.mark.parametrize("n, tasks", [(0, 3), (1, 4), (500, 7)])
def test_feature_collection_is_one_object(spark, n, tasks):
    gold = spark.range(0, n + 3, 1, tasks).select(
        F.concat(F.lit('q"\n'), "id").alias("facility_id"), F.lit("né").alias("name"),
        F.lit(None).cast("string").alias("address_city"), F.lit("s").alias("address_state"),
        F.lit("t").alias("facility_type"), F.when(F.col("id") < n, F.lit(1.5)).alias("latitude"),
        F.lit(2.5).alias("longitude"), F.lit(50.0).alias("trust_score"),
        F.array(F.lit("x")).alias("specialties"), F.lit(True).alias("has_icu"),
        F.lit(None).cast("boolean").alias("has_emergency"))
    path = layers.scratch_path(spark, "collection")
    for _ in range(2):  # the second run replaces the first
        sinks.write_feature_collection(gold, path)
        parts = sorted(Path(path).glob("part-*"))
        one = json.loads("".join(p.read_text() for p in parts))
        assert one["type"] == "FeatureCollection"
        assert [f["properties"]["id"] for f in one["features"]] == [f'q"\n{i}' for i in range(n)]
    if n == 500:
        assert len([p for p in parts if "separator" in p.name]) == tasks - 1


def scattered(kind, n, seed):
    rnd = random.Random(seed)
    if kind == "dense":
        return [(20 + rnd.random() / 100, 77 + rnd.random() / 100) for _ in range(n)]
    if kind == "border":  # date line and poles
        return [(rnd.choice([90.0, -90.0, 89.5, rnd.uniform(-90, 90)]),
                 rnd.choice([180.0, -180.0, 179.9, -179.9])) for _ in range(n)]
    return [(math.degrees(math.asin(rnd.uniform(-1, 1))), rnd.uniform(-180, 180)) for _ in range(n)]


@pytest.mark.parametrize("kind", ["dense", "border", "sparse"])
@pytest.mark.parametrize("slot_pairs", [10**6, 10])
def test_nearest_over_the_globe(spark, monkeypatch, kind, slot_pairs):
    monkeypatch.setattr(geo, "POINT_PAIRS_PER_SLOT", slot_pairs)
    places, held = scattered(kind, 60, 2), scattered(kind, 40, 3)
    keyed = [(a, b, "often" if i else "once") for i, (a, b) in enumerate(held)]
    p = spark.createDataFrame(places, "latitude double, longitude double")
    t = spark.createDataFrame(keyed, "latitude double, longitude double, key string")
    got = {(r.latitude, r.longitude, r.key): r.nearest_km for r in geo.nearest(p, t, "key").collect()}
    want = {(*a, k): min(km(a, (x, y)) for x, y, kk in keyed if kk == k)
            for a in places for k in ("once", "often")}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=0.0011) for k in want)


def test_nearest_joins_on_cells(spark, monkeypatch):
    """No join on a constant or on the key alone; coarse cells decide a small table."""
    joins = []
    kind = type(spark.range(1))
    inner = kind.join
    monkeypatch.setattr(kind, "join", lambda self, other, on=None, how=None:
                        joins.append(on) or inner(self, other, on, how))
    p = spark.createDataFrame(scattered("sparse", 50, 1), "latitude double, longitude double")
    t = p.withColumn("key", F.lit("k"))
    spark.sparkContext.setJobGroup("nearest", "nearest")
    assert geo.nearest(p, t, "key", other_points=True).count() == 50
    spark.sparkContext.setJobGroup("rest", "rest")
    assert all(any("row" in c for c in on) for on in joins)
    # stages of adaptive plans count as jobs
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("nearest")) <= 20
