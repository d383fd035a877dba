"""Writing layers, CSV reports, failure rows and map features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from wardline.sources.collection import FeatureCollection
from wardline.sources.readers import FOLDERS


def write_layer(df: DataFrame, target: str, partition_by: str | None = None) -> None:
    """A layer as parquet files (path) or a table (name).

    A partitioned layer keeps the column in its files, with its type and its empty texts, and
    folders are named by a copy, which `read_layer` leaves out. Its rows are dealt by that
    column into files of even size: Spark splits values of many rows and joins small ones.
    """
    if partition_by:
        df = df.withColumn(FOLDERS, F.col(partition_by)).hint("rebalance", FOLDERS)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(FOLDERS)
    writer.parquet(target) if "/" in target else writer.format("parquet").saveAsTable(target)


def write_by_name(df: DataFrame, table: str, path: str, buckets: int, key: str = "name") -> None:
    """A table bucketed and sorted by the key of later joins, so that two such tables of as many
    buckets meet without an exchange. Rows are dealt by that key first, so that a bucket is few
    files; keys of very many rows are split over several tasks.

    One task reads a bucket. Where one name holds a large share of all rows, use plain layers:
    Spark splits such a name in an exchange, not in a bucket."""
    df.hint("rebalance", key).write.mode("overwrite").format("parquet").option("path", path) \
        .bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def flat_for_csv(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text; simple columns as they are."""
    nested = (ArrayType, MapType, StructType)
    return df.select(*[
        F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name)
        for f in df.schema.fields
    ])


def write_csv(df: DataFrame, path: str) -> None:
    flat_for_csv(df).write.mode("overwrite").option("header", True) \
        .option("escape", '"').csv(path)


def write_failures(failures: DataFrame, path: str) -> bool:
    """Writes failure rows only when there are any."""
    if failures.limit(1).count() == 0:
        return False
    write_csv(failures, path)
    return True


def feature_text() -> Column:
    """A facility as a map feature: point and nine properties."""
    return F.to_json(F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"),
                 F.array("longitude", "latitude").alias("coordinates")).alias("geometry"),
        F.struct(
            F.col("facility_id").alias("id"), "name", F.col("address_city").alias("city"),
            F.col("address_state").alias("state"), F.col("facility_type").alias("type"),
            F.coalesce("trust_score", F.lit(0.0)).alias("trust_score"), "specialties",
            "has_icu", "has_emergency").alias("properties"),
    ), {"ignoreNullFields": "false"})


def geo_features(gold: DataFrame) -> DataFrame:
    """One feature per row; rows without a point are left out."""
    return gold.dropna(subset=["latitude", "longitude"]).select(feature_text().alias("feature"))


def write_geojson(gold: DataFrame, path: str) -> None:
    """One feature per line, written by every task; see `write_feature_collection` for one object."""
    geo_features(gold).write.mode("overwrite").text(path)


def write_feature_collection(gold: DataFrame, path: str) -> None:
    """All features in one object, in parts whose names are in order (see `collection`). What
    `path` held before is replaced."""
    gold.sparkSession.dataSource.register(FeatureCollection)
    geo_features(gold).write.format(FeatureCollection.name()).mode("append").save(path)
