"""Inputs that earlier versions answered wrongly."""

import pytest
from pyspark.sql import functions as F

from wardline.operators import gaps, silver as S, validate
from wardline.sources import layers, readers, sinks


def test_texts_such_as_nan_are_no_numbers(raw_rows):
    df = S.clean_silver(raw_rows(*[{"numberDoctors": t} for t in ("nan", "Infinity", "-inf", "7")]))
    assert [r.numberDoctors for r in df.orderBy("facility_id").collect()] == [None, None, None, 7.0]
    assert df.where(F.col("numberDoctors") > 5).count() == 1


@pytest.mark.parametrize("percent", [10, 30, 60, 75])
def test_sample_share(spark, percent):
    gold = spark.range(4000).select(F.format_string("%05d", "id").alias("facility_id"),
                                    (F.col("id") % 100).alias("trust_score"))
    share = validate.stratified_sample(gold, percent).count() / 4000
    assert abs(share - percent / 100) < 0.03


def test_gap_lookup_keeps_all_specialties_of_the_table(spark):
    table = spark.createDataFrame(
        [("S", name, i, 0.9) for i, name in enumerate(("oncology", "cardiology", "eye, ear"))],
        "state string, specialty string, facility_count long, desert_severity double")
    asked = spark.createDataFrame([(1, "where are the medical deserts")], "query_id long, query string")
    got = gaps.gap_lookup(asked, table).collect()
    assert {r.specialty for r in got} == {"oncology", "cardiology", "eye, ear"}
    some = gaps.gap_lookup(asked, table, ["oncology", "eye, ear"]).collect()
    assert {r.specialty for r in some} == {"oncology", "eye, ear"}


def test_large_files_are_split(spark):
    path = layers.scratch_path(spark, "csv")
    rows = spark.range(0, 5000, numPartitions=1).select(F.concat(F.lit("n"), "id").alias("name"))
    sinks.write_csv(rows, path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        back = readers.read_facilities(spark, path)
        assert back.select(F.spark_partition_id()).distinct().count() > 1
        got = back.orderBy("facility_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.name for r in got] == [f"n{i}" for i in range(5000)]


def test_machines_need_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()

        class sparkContext:
            master, applicationId = "spark://host:7077", "app"

            @staticmethod
            def getConf():
                return Conf()
    with pytest.raises(ValueError):
        layers.shared_root(Session())
