"""Gold: claims, trust and searchable text in one select chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wardline.functions import columns as X, vocab
from wardline.operators import claims, trust

# Record columns that a source may lack: gold's name and the source's.
RECORD_COLUMNS = {
    "phone": "officialPhone", "website": "officialWebsite", "email": "email",
    "address_line": "address_line1", "operator_type": "operatorTypeId",
    "year_established": "yearEstablished",
}

GOLD_COLUMNS = [
    "facility_id", "name", "address_city", "address_state", "address_zip", "facility_type",
    "latitude", "longitude", "data_completeness", "has_text",
    "specialties", "capabilities", "extracted_equipment", "extracted_procedures",
    *vocab.CLAIMS, "icu_beds", "inferred_doctors", "number_doctors", "bed_count",
    "confidence", "trust", "trust_score", "contradictions",
    "searchable_text", "description", "source_field", "source_sentence", "operational_notes",
    "extraction_error", *RECORD_COLUMNS,
]


def searchable_text() -> Column:
    """Ten parts joined by one space; blank parts are left out."""
    parts = [
        F.col("name"), F.col("description"), F.col("capability"),
        F.array_join("specialties_parsed", " "), F.array_join("procedure_parsed", " "),
        F.array_join("equipment_parsed", " "), F.col("address_city"), F.col("address_state"),
        F.array_join("extracted_equipment", " "), F.array_join("extracted_procedures", " "),
    ]
    return F.concat_ws(" ", *[F.when(F.trim(p) != "", p) for p in parts])


def build_gold(silver: DataFrame) -> DataFrame:
    """One gold row per silver row, with or without text: no loop, no shuffle, no UDF. Record
    columns that the source lacks are null."""
    claimed = claims.with_claims(silver, keep=tuple(f"_{f}" for f in trust.RULE_FIELDS))
    scored = trust.with_trust(trust.with_rule_text(claimed))
    return scored.withColumns({
        "searchable_text": searchable_text(),
        "facility_type": F.col("facilityTypeId"),
        "specialties": F.col("specialties_parsed"),
        "capabilities": F.when(F.col("has_text"), F.array_union(
            "capability_parsed", "extracted_procedures")).otherwise(X.empty_strings()),
        "number_doctors": F.col("numberDoctors"),
        "bed_count": F.col("_beds"),
        **{name: F.col(source) if source in silver.columns else F.lit(None).cast("string")
           for name, source in RECORD_COLUMNS.items()},
    }).select(*GOLD_COLUMNS)


def split_by_text(silver: DataFrame) -> tuple[DataFrame, DataFrame]:
    return silver.where("has_text"), silver.where("NOT has_text")
