"""Cleaning: raw facility records to typed silver records (one projection, no shuffle)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wardline.functions import columns as X, vocab

NUMERIC_FIELDS = ["numberDoctors", "capacity", "latitude", "longitude"]
ENUM_FIELDS = ["facilityTypeId", "operatorTypeId"]


def clean_silver(raw: DataFrame) -> DataFrame:
    """Parsed lists, normal casing, numbers, completeness and the has_text flag."""
    parsed = {
        f"{c}_parsed": X.parse_list(F.col(c)) if c in raw.columns else X.empty_strings()
        for c in vocab.LIST_FIELDS
    }
    typed = {c: F.lower(F.trim(c)) for c in ENUM_FIELDS if c in raw.columns}
    # texts such as nan and Infinity are no numbers
    typed |= {c: F.expr(f"if(abs(try_cast({c} AS double)) < double('Infinity'), "
                        f"try_cast({c} AS double), NULL)")
              for c in NUMERIC_FIELDS if c in raw.columns}
    silver = raw.withColumns({**parsed, **typed})
    return silver.withColumns({
        "data_completeness": completeness(silver.columns),
        "has_text": F.col("description").isNotNull() | F.col("capability").isNotNull(),
    })


def completeness(available: list[str], fields: list[str] | None = None) -> Column:
    """Filled share of the key fields, 3 decimals; an absent column counts as unfilled."""
    fields = fields or vocab.KEY_FIELDS
    filled = " + ".join(
        f"if({X.missing_sql(f)}, 0, 1)" for f in fields if f in available) or "0"
    return F.expr(f"bround(({filled}) / {len(fields)}D, 3)")


def with_missing_fields(silver: DataFrame) -> DataFrame:
    """Names of the missing key fields and the completeness class."""
    names = F.array_compact(F.array(*[
        F.when(X.is_missing(f), F.lit(f)) for f in vocab.KEY_FIELDS
    ]))
    share = F.col("data_completeness")
    grade = (
        F.when(share >= 0.75, "full").when(share >= 0.5, "partial")
        .when(share >= 0.25, "sparse").otherwise("empty")
    )
    return silver.withColumns({"missing_fields": names, "completeness_class": grade})


def with_specialty_labels(silver: DataFrame, categories: dict[str, str] | None = None) -> DataFrame:
    """Codes such as emergencyMedicine as readable labels, and their clinical categories."""
    categories = vocab.SPECIALTY_CATEGORIES if categories is None else categories
    pairs = [F.lit(x) for kv in categories.items() for x in kv]
    lookup = F.create_map(*pairs)
    labels = F.array_distinct(F.transform(
        "specialties_parsed",
        lambda s: F.lower(F.trim(F.regexp_replace(s, "([a-z])([A-Z])", "$1 $2"))),
    ))
    silver = silver.withColumn("specialty_labels", labels)
    found = F.transform("specialty_labels",
                        lambda s: F.coalesce(F.try_element_at(lookup, s), F.lit("Other")))
    return silver.withColumn("specialty_categories", F.array_sort(F.array_distinct(found)))


def null_safe_int(c: Column, default: int = 0) -> Column:
    number = c.cast("string").try_cast("double")
    return F.coalesce(F.nanvl(number, F.lit(None).cast("double")).try_cast("bigint"),
                      F.lit(default).cast("bigint"))


def null_safe_float(c: Column, default: float = 0.0) -> Column:
    number = c.cast("string").try_cast("double")
    return F.coalesce(F.when(~F.isnan(number), number), F.lit(default))


def null_safe_string(c: Column, default: str = "") -> Column:
    text = c.cast("string")
    return F.when(text.isNull() | text.isin("nan", "None", "NaT"), default).otherwise(text)


def mean_completeness(silver: DataFrame) -> DataFrame:
    return silver.agg(F.bround(F.avg("data_completeness"), 4).alias("mean_completeness"))


def quality_report(raw: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Row count, missing count and rate per column, from one aggregate over the table."""
    fields = fields or raw.columns
    one_row = raw.agg(
        F.count(F.lit(1)).alias("row_count"),
        *[F.count_if(X.is_missing(c)).alias(c) for c in fields],
    )
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).alias("missing")) for c in fields
    ]))
    return (
        one_row.select("row_count", pairs.alias("p"))
        .select(
            F.col("p.column_name").alias("column_name"), "row_count",
            F.col("p.missing").alias("missing"),
            X.half_even(F.col("p.missing") / F.greatest("row_count", F.lit(1)), 4)
            .alias("missing_rate"),
        )
    )


def coordinate_bounds(silver: DataFrame) -> DataFrame:
    """Coordinate ranges and the number of records off the globe."""
    lat, lng = F.col("latitude"), F.col("longitude")
    return silver.agg(
        F.min(lat).alias("min_lat"), F.max(lat).alias("max_lat"),
        F.min(lng).alias("min_lng"), F.max(lng).alias("max_lng"),
        F.count_if((F.abs(lat) > 90) | (F.abs(lng) > 180)).alias("off_globe"),
        F.count_if(lat.isNull() | lng.isNull()).alias("without_point"),
    )
