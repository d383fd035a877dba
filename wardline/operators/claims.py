"""Claims stated in free text, their evidence, and failed model replies.

A claim is true when its words occur, and unknown (null) otherwise: absence of
evidence is never turned into "no".
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from wardline.functions import columns as X, vocab

TEXT_FIELDS = ["description", "capability", "procedure", "equipment"]
ALL_CLAIM_WORDS = list(dict.fromkeys(w for words in vocab.CLAIMS.values() for w in words))

REPLY_FIELDS = """has_icu: boolean, has_emergency: boolean, has_24_7: boolean,
 has_surgery: boolean, has_dialysis: boolean, has_oncology: boolean,
 has_neonatal_icu: boolean, has_mental_health: boolean, has_trauma_centre: boolean,
 icu_beds: bigint, inferred_doctors: bigint, operational_notes: string,
 confidence: string, source_sentence: string"""


def strip_fences(reply: Column) -> Column:
    return F.regexp_replace(reply, r"```(json)?|^\s+|\s+$", "")


def parse_model_json(reply: Column, fields: str = REPLY_FIELDS) -> Column:
    """Fenced JSON reply as a record; a nested `properties` record is unwrapped."""
    names = [f.split(":")[0].strip() for f in fields.replace("\n", " ").split(",")]
    parsed = F.from_json(strip_fences(reply), f"struct<{fields}, properties: struct<{fields}>>")
    return F.coalesce(parsed.getField("properties"),
                      F.struct(*[parsed.getField(n).alias(n) for n in names]))


def reply_error(reply: Column) -> Column:
    """Message for a reply that is not JSON; null when there is none or it parses."""
    clean = strip_fences(reply)
    bad = reply.isNotNull() & F.try_parse_json(clean).isNull()
    return F.when(bad, F.concat(F.lit("reply is not JSON: "), F.substring(clean, 1, 100)))


def bed_mentions(text: Column) -> Column:
    """Largest number written before the word bed, 0 when none (over-long numbers ignored)."""
    return beds_in(F.lower(X.text_or_empty(text)))


def beds_in(lowered: Column) -> Column:
    """As bed_mentions for a lower-cased text; the pattern runs only where the word occurs."""
    numbers = F.when(F.contains(lowered, F.lit("bed")), F.regexp_extract_all(
        lowered, F.lit(r"(\d+)\s*bed"), F.lit(1)))
    return F.coalesce(F.array_max(F.transform(numbers, lambda n: n.try_cast("bigint"))),
                      F.lit(0).cast("bigint"))


def first_number(text: str, words: list[str]) -> Column:
    """First number before one of the words; the pattern runs only where a word occurs."""
    either = "|".join(re.escape(w) for w in words)
    found = F.regexp_extract(F.col(text), rf"(\d+)\s*(?:{either})", 1)
    return F.when(X.any_word(text, words), X.blank_to_null(found)).try_cast("bigint")


def with_claims(silver: DataFrame, claims: dict[str, list[str]] | None = None,
                keep: tuple[str, ...] = ()) -> DataFrame:
    """All claim columns. Rows without text get unknown claims and empty lists.

    Each text field is lower-cased once; the words of a claim are looked up once per
    field, and both the claim and the per-field evidence are read off that result.
    `keep` names inner columns (`_description`) that a later step reads again.
    """
    claims = vocab.CLAIMS if claims is None else claims
    has_text = F.col("has_text")
    lowered = silver.withColumns({
        f"_{f}": F.lower(X.text_or_empty(F.col(f))) for f in TEXT_FIELDS
    }).withColumn("_all", F.concat_ws(" ", *[F.col(f"_{f}") for f in TEXT_FIELDS]))
    hits = lowered.withColumns({
        f"_hit_{f}": F.array(*[X.any_word(f"_{f}", w) for w in claims.values()])
        for f in TEXT_FIELDS
    })
    hours = vocab.STANDARDS["has_24_7"] + vocab.LIMITED_HOURS_WORDS
    known = {}
    for i, claim in enumerate(claims):
        stated = reduce(lambda a, b: a | b, [F.get(f"_hit_{f}", F.lit(i)) for f in TEXT_FIELDS])
        known[claim] = F.when(has_text & stated, True)
    fields_hit = reduce(lambda a, b: a + b, [
        F.exists(f"_hit_{f}", lambda x: x).cast("int") for f in TEXT_FIELDS
    ])
    lead = F.coalesce(*[F.when(F.exists(f"_hit_{f}", lambda x: x), F.lit(f))
                        for f in TEXT_FIELDS])
    said = {f: X.any_word(f"_{f}", hours) for f in TEXT_FIELDS}
    if claims.get("has_24_7") == vocab.STANDARDS["has_24_7"]:  # these words were looked up
        at = F.lit(list(claims).index("has_24_7"))
        said = {f: F.get(f"_hit_{f}", at) | X.any_word(f"_{f}", vocab.LIMITED_HOURS_WORDS)
                for f in TEXT_FIELDS}
    spoken = F.coalesce(*[F.when(said[f], F.lit(f)) for f in TEXT_FIELDS])
    hits = hits.withColumns({
        "source_field": F.when(has_text, lead), "_notes_field": F.when(has_text, spoken),
    })
    words = list(dict.fromkeys(w for ws in claims.values() for w in ws))
    derived = hits.withColumns({
        **known,
        "icu_beds": F.when(has_text, first_number("_all", ["icu bed"])),
        "inferred_doctors": F.when(has_text, first_number(
            "_all", ["doctors", "specialists", "surgeons"])),
        "extracted_equipment": F.when(has_text, F.array_union(
            "equipment_parsed", X.words_found("_all", vocab.EQUIPMENT_WORDS)))
            .otherwise(X.empty_strings()),
        "extracted_procedures": F.when(has_text, F.array_union(
            "procedure_parsed", X.words_found("_all", vocab.PROCEDURE_WORDS)))
            .otherwise(X.empty_strings()),
        "operational_notes": sentence_of("_notes_field", hours),
        "evidence_fields": F.when(has_text, fields_hit).otherwise(0),
        "source_sentence": sentence_of("source_field", words),
        "_reply": parse_model_json(F.col("model_reply"))
            if "model_reply" in silver.columns else F.lit(None).cast(f"struct<{REPLY_FIELDS}>"),
        "extraction_error": F.when(has_text, reply_error(F.col("model_reply")))
            if "model_reply" in silver.columns else F.lit(None).cast("string"),
    })
    overridden = {
        c: F.when(has_text, F.coalesce(F.col("_reply").getField(c), F.col(c)))
        for c in [*claims, "icu_beds", "inferred_doctors", "operational_notes", "source_sentence"]
        if c in REPLY_FIELDS
    }
    graded = derived.withColumn("confidence", confidence_grade()).withColumns({
        **overridden,
        "confidence": F.when(has_text, F.coalesce(
            F.col("_reply").getField("confidence"), F.col("confidence")))
            .otherwise("insufficient_data"),
    })
    inner = ["_reply", "_notes_field", "_all", *[f"_{f}" for f in TEXT_FIELDS],
             *[f"_hit_{f}" for f in TEXT_FIELDS]]
    return graded.drop(*[c for c in inner if c not in keep])


def confidence_grade() -> Column:
    empty = X.is_missing("description") & X.is_missing("capability")
    specific = (
        F.coalesce(F.col("source_sentence").rlike("[0-9]"), F.lit(False))
        | (F.size("extracted_equipment") + F.size("extracted_procedures") > 0)
    )
    return (
        F.when(empty, "insufficient_data")
        .when((F.col("evidence_fields") >= 2) & specific, "high")
        .when((F.col("evidence_fields") >= 1) & specific, "medium")
        .otherwise("low")
    )


def sentence_of(field: str, words: list[str]) -> Column:
    """First sentence holding a word, in the text column that `field` names."""
    return F.coalesce(*[
        F.when(F.col(field) == f, X.first_sentence_with(f, f"_{f}", words))
        for f in TEXT_FIELDS
    ])


def evidence_sentence(silver: DataFrame, claims: dict[str, list[str]] | None = None) -> DataFrame:
    """(facility_id, source_field, source_sentence) for every record that states a claim."""
    words = ALL_CLAIM_WORDS if claims is None else list(
        dict.fromkeys(w for ws in claims.values() for w in ws))
    lowered = silver.withColumns({
        f"_{f}": F.lower(X.text_or_empty(F.col(f))) for f in TEXT_FIELDS
    })
    field = F.coalesce(*[F.when(X.any_word(f"_{f}", words), F.lit(f))
                         for f in TEXT_FIELDS])
    found = lowered.withColumn("source_field", field) \
        .withColumn("source_sentence", sentence_of("source_field", words))
    # unfolding drops rows without a sentence; a filter would be pushed below the projection
    # and search the texts once more
    kept = F.filter(F.array(F.struct("source_field", "source_sentence")),
                    lambda e: e.getField("source_sentence").isNotNull())
    return found.select("facility_id", F.inline(kept))


def split_failures(claimed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records whose reply parsed or was absent, failure rows with id and message)."""
    failed = F.col("extraction_error").isNotNull()
    return claimed.where(~failed), claimed.where(failed).select(
        "facility_id", F.col("extraction_error").alias("error"))


def specialties_display(c: Column, n: int = 4) -> Column:
    """Pipe-separated specialties, trimmed, first n."""
    return F.slice(F.transform(F.split(c, r"\|"), lambda s: F.trim(s)), 1, n)


def validated_record(fields: dict[str, str], defaults: dict[str, object]) -> list[Column]:
    """Columns cast to a fixed schema; a value that does not fit becomes the default."""
    out = []
    for name, kind in fields.items():
        value = F.col(name).cast(kind) if kind.startswith("array") else F.col(name).try_cast(kind)
        if name in defaults:
            value = F.coalesce(value, F.lit(defaults[name]).cast(kind))
        out.append(value.alias(name))
    return out
