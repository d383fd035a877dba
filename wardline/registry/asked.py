"""Parsed user queries the registered searches answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wardline.functions import vocab

# The stored gap table: the six grid specialties and one that the records rarely name.
TABLE_SPECIALTIES = {**vocab.GAP_SPECIALTIES, "cardiology": vocab.MAP_GROUPS["Cardiology"]}

SCHEMA = """query_id bigint, query string, state string, city string, facility_type string,
 specialties array<string>, requires_icu boolean, requires_emergency boolean,
 requires_24_7 boolean, requires_dialysis boolean, requires_contradictions boolean,
 min_trust_score double, search_text string, min_doctors double"""

FIELDS = [part.strip().split(" ") for part in SCHEMA.replace("\n", " ").split(",")]


def _q(query_id: int, query: str, **given) -> dict:
    row = {name: None for name, _ in FIELDS}
    row.update(query_id=query_id, query=query, specialties=[], search_text="")
    row.update(given)
    return row


ASKED = [
    _q(1, "Hospitals in BRAZIL with ICU", state="BRAZIL", requires_icu=True,
       search_text="icu ventilators", specialties=["critical care"]),
    _q(2, "Surgery near CANADA_C1 with trust above 40", city="CANADA_C1", min_trust_score=40.0,
       search_text="surgery anaesthesiologist", specialties=["surgery"]),
    _q(3, "Dialysis unit", requires_dialysis=True, search_text="Dialysis unit 24 hours"),
    _q(4, "Disputed facilities in EGYPT", state="EGYPT"),
    _q(5, "Clinic for trauma and emergency", facility_type="clinic", requires_emergency=True,
       search_text="trauma emergency care"),
    _q(6, "Psychiatry or maternity", search_text="psychiatry",
       specialties=["maternity ward", "neonatal"]),
    _q(7, "anything"),
    _q(8, "Hospitals in ATLANTIS", state="ATLANTIS", search_text="mri scanner"),
    _q(9, "More than five specialists with ventilator", min_doctors=5.0,
       search_text="ventilator oncology"),
    _q(10, "Find hospital with ICU beds claiming surgery", facility_type="hospital",
       requires_icu=True, min_trust_score=30.0, search_text="surgeons surgery delivery"),
]


def asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([tuple(q[n] for n, _ in FIELDS) for q in ASKED], SCHEMA)


def asked_sql() -> str:
    """The same records as a select text of the checking engine."""
    kinds = {"bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE",
             "array<string>": "VARCHAR[]"}

    def text(value):
        if value is None:
            return "NULL"
        if isinstance(value, list):
            return "[" + ", ".join(f"'{v}'" for v in value) + "]"
        return f"'{value}'" if isinstance(value, str) else str(value)

    rows = ",\n ".join("(" + ", ".join(text(q[n]) for n, _ in FIELDS) + ")" for q in ASKED)
    names = ", ".join(n for n, _ in FIELDS)
    cast = ", ".join(f"CAST({n} AS {kinds[k]}) AS {n}" for n, k in FIELDS)
    return f"SELECT {cast} FROM (VALUES\n {rows}) t({names})"
