"""Records whose lists, flags and sub-scores are stored as JSON text, as arrays or as structs: one
adapter by the VARIANT type, so that a reader need not know which of them a table holds.

Defined cases: null, unreadable text and JSON of another kind give an empty list, an unknown flag
or an unknown number. A flag is JSON true or false only: the text "true" and the number 1 are none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructType

from wardline.functions import columns as X
from wardline.operators import claims

FLAGS = ["has_icu", "has_emergency", "has_24_7"]
# Sub-scores in gold and in the stored form.
PARTS = {"completeness": "completeness", "consistency": "consistency",
         "verifiability": "verifiability", "recency": "recency", "digital": "digital_presence"}


def variant_of(df: DataFrame, name: str) -> Column:
    """A column of any stored kind as a VARIANT: text is parsed, arrays, maps and structs are
    converted, variants stay. A column the table lacks is null."""
    if name not in df.columns:
        return F.try_parse_json(F.lit(None).cast("string"))
    kind = df.schema[name].dataType
    if isinstance(kind, (ArrayType, MapType, StructType)):
        return F.to_variant_object(name)
    return F.try_parse_json(name) if isinstance(kind, StringType) else F.col(name)


def text_list(v: Column) -> Column:
    """The items of a list as texts; anything else is an empty list."""
    return F.coalesce(F.try_variant_get(v, "$", "array<string>"), X.empty_strings())


def flag(v: Column, name: str) -> Column:
    """True or false where the object holds that very value, else null."""
    value = F.try_variant_get(v, f"$.{name}", "variant")
    return F.when(F.schema_of_variant(value) == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))


def number(v: Column, name: str, kind: str = "double") -> Column:
    return F.try_variant_get(v, f"$.{name}", kind)


def filter_flag(df: DataFrame, column: str, name: str) -> Column:
    """The stored object says that the claim is true."""
    return F.coalesce(flag(variant_of(df, column), name), F.lit(False))


def contradictions(df: DataFrame, name: str = "contradictions") -> Column:
    return text_list(variant_of(df, name))


def shown_specialties(df: DataFrame, name: str = "specialties", n: int = 4) -> Column:
    """The first n specialties of pipe-separated text (trimmed) or of a list, as they are."""
    if isinstance(df.schema[name].dataType, StringType):
        return F.coalesce(claims.specialties_display(F.col(name), n), X.empty_strings())
    return F.slice(text_list(variant_of(df, name)), 1, n)


def write_form(gold: DataFrame) -> DataFrame:
    """Gold with its claims, lists and sub-scores as JSON text; other columns as they are."""
    scores = F.struct(*[F.col(f"trust.{part}").alias(out) for part, out in PARTS.items()])
    return gold.withColumns({
        "extracted_availability": F.to_json(F.struct(*FLAGS)),
        "extracted_capabilities": F.to_json("capabilities"),
        "extracted_staff": F.to_json(F.struct(F.col("inferred_doctors").alias("doctor_count"))),
        "trust_score_breakdown": F.when(F.col("trust").isNotNull(), F.to_json(scores)),
        "contradictions": F.to_json("contradictions"),
    }).withColumnsRenamed({"confidence": "confidence_level", "bed_count": "extracted_bed_count"}) \
        .drop(*FLAGS, "capabilities", "inferred_doctors", "trust")


def read_form(stored: DataFrame) -> DataFrame:
    """The typed columns of gold from a table in the written form, whatever its nested columns
    are stored as."""
    said = variant_of(stored, "extracted_availability")
    scores, staff = variant_of(stored, "trust_score_breakdown"), variant_of(stored, "extracted_staff")
    trust = F.struct(*[number(scores, name).alias(part) for part, name in PARTS.items()])
    return stored.withColumns({
        **{c: flag(said, c) for c in FLAGS},
        "capabilities": text_list(variant_of(stored, "extracted_capabilities")),
        "inferred_doctors": number(staff, "doctor_count", "bigint"),
        "trust": F.when(scores.isNotNull(), trust),
        "contradictions": contradictions(stored),
    }).withColumnsRenamed({"confidence_level": "confidence", "extracted_bed_count": "bed_count"}) \
        .drop("extracted_availability", "extracted_capabilities", "extracted_staff",
              "trust_score_breakdown")
