"""The batch run end to end: layers, reports and totals."""

import json
from pathlib import Path
from types import SimpleNamespace

from pyspark.sql import functions as F

from tests.conftest import SMALL
from wardline.operators import gaps, vector
from wardline.plans.batch import run_batch
from wardline.registry import queries as registry
from wardline.sources import layers, readers, sinks


def test_batch_outputs(spark):
    out = layers.scratch_path(spark, "batch")
    raw = registry.raw(spark, SMALL)
    summary = run_batch(raw, out).collect()[0]
    n = raw.count()
    assert summary.enriched == n == spark.read.parquet(f"{out}/bronze").count()
    assert spark.read.parquet(f"{out}/silver").count() == n
    assert summary.with_text + summary.without_text == n
    table = readers.read_layer(spark, f"{out}/gaps")
    csv = spark.read.option("header", True).csv(f"{out}/gaps_csv")
    assert csv.count() == table.count() == gaps.gap_sort(table).count()
    features = [json.loads(r.value) for r in spark.read.text(f"{out}/features").collect()]
    assert all(f["type"] == "Feature" and len(f["properties"]) == 9 for f in features)
    located = raw.where("latitude IS NOT NULL").count()
    assert len(features) == located
    failures = spark.read.option("header", True).csv(f"{out}/failures_csv")
    assert failures.count() == summary.failures > 0
    one = json.loads("".join(p.read_text() for p in sorted(Path(f"{out}/feature_collection").glob("part-*"))))
    assert one["type"] == "FeatureCollection" and len(one["features"]) == located


def test_no_failures_means_no_file(spark):
    empty = spark.createDataFrame([], "facility_id string, error string")
    assert sinks.write_failures(empty, layers.scratch_path(spark, "none")) is False


def test_scratch_follows_the_configured_folder():
    settings = {"spark.checkpoint.dir": "hdfs://shared/tmp/"}
    session = SimpleNamespace(conf=settings)
    assert layers.scratch_path(session, "x").startswith("hdfs://shared/tmp/x-")


def test_vector_without_queries(spark):
    v = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    q = v.where("vec_id < 0").select(F.col("vec_id").alias("query_id"), "embedding")
    assert vector.vector_top_k(q, v, 5).count() == 0
