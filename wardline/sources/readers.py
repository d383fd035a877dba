"""Reading raw facility files and stored layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from wardline.sources.layers import cut
from wardline.sources.quoted import quoted_records

# Column that names the folders of a partitioned layer.
FOLDERS = "_folder"

# Names of the source columns that the engine stores under shorter names.
RENAMED = {
    "address_stateOrRegion": "address_state",
    "address_zipOrPostcode": "address_zip",
    "distinct_social_media_presence_count": "social_count",
}


def read_facilities(spark: SparkSession, path: str, max_rows: int | None = None,
                    schema: str | None = None, multi_line: bool | None = None) -> DataFrame:
    """CSV with header and a zero-padded id in file order.

    Quoted texts may hold line breaks: large files are split at the borders of records (see
    `quoted_records`). `multi_line=True` leaves that to Spark's reader, one file per task;
    `multi_line=False` says that no text holds a line break, and saves a scan. Neither way
    shuffles the records. Ids are padded to five digits and never cut.
    """
    if multi_line is None:
        numbered = _parsed(spark, path, schema)
    else:
        numbered = _numbered(spark, path, schema, multi_line)
    if max_rows:
        numbered = numbered.where(F.col("_index") < max_rows)
    named = numbered.withColumn("facility_id", F.format_string("%05d", F.col("_index"))).drop("_index")
    return named.withColumnsRenamed({k: v for k, v in RENAMED.items() if k in named.columns})


def _reader(spark: SparkSession, multi_line: bool):
    return (spark.read.option("header", True).option("multiLine", multi_line)
            .option("escape", '"').option("nullValue", ""))


def _parsed(spark: SparkSession, path: str, schema: str | None) -> DataFrame:
    reader = _reader(spark, False)
    fields = (reader.schema(schema).csv(path) if schema else reader.csv(path)).schema.fields
    names = {f"c{i}": f.name for i, f in enumerate(fields)}
    kinds = ", ".join(f"{c} {f.dataType.simpleString()}" for c, f in zip(names, fields))
    values = F.from_csv("_text", kinds, {"escape": '"', "nullValue": "", "multiLine": "true"})
    return quoted_records(spark, path).select("_index", values.alias("_values")) \
        .select("_index", "_values.*").withColumnsRenamed(names)


def _numbered(spark: SparkSession, path: str, schema: str | None, multi_line: bool) -> DataFrame:
    """The first pass counts rows per file split, the second adds the split's offset to the
    row's position. The counts are stored, so Spark sees their size and broadcasts them while
    they are small."""
    reader = _reader(spark, multi_line)
    raw = reader.schema(schema).csv(path) if schema else reader.csv(path)
    placed = raw.select("*", F.col("_metadata.file_path").alias("_file"),
                        F.col("_metadata.file_block_start").alias("_start"),
                        F.monotonically_increasing_id().alias("_at"))
    splits = placed.groupBy("_file", "_start").agg(
        F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    # one row per file split, not per record
    before = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.withColumn("_offset", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    return placed.join(cut(offsets.drop("_rows")), ["_file", "_start"]).withColumn(
        "_index", F.col("_at") - F.col("_first") + F.col("_offset")).drop(
        "_file", "_start", "_at", "_first", "_offset")


def read_layer(spark: SparkSession, name: str, columns: list[str] | None = None) -> DataFrame:
    """A stored layer by path or table name, limited to the named columns. The copy of a column
    that names a layer's folders is left out."""
    df = spark.read.parquet(name) if "/" in name else spark.table(name)
    return df.select(*columns) if columns else df.drop(FOLDERS)
