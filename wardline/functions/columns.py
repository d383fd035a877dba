"""Column expressions shared by the operators. All of them stay inside the JVM."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, functions as F

from wardline.functions import vocab

EARTH_KM = 6371.0
KM_PER_DEGREE = 111.19
SENTENCE_BREAK = r"(?<=[.!?])\s+"


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def word_array(words: list[str]) -> str:
    return "array(" + ", ".join(quoted(w) for w in words) + ")"


def any_word(text: str, words: list[str]) -> Column:
    """True when the text holds one of the words as a substring (case as given).

    The word list is one constant array: a long OR chain would make methods too big for
    the JVM to compile and take longer to plan than to run.
    """
    return F.expr(f"exists({word_array(words)}, w -> contains({text}, w))")


def any_phrase(text: Column, phrases: list[str]) -> Column:
    """As any_word for short computed texts: one pattern, so the text is computed once."""
    return text.rlike("|".join(re.escape(p) for p in phrases))


def words_found(text: str, words: list[str]) -> Column:
    """The words the text column holds, in list order."""
    return F.expr(f"filter({word_array(words)}, w -> contains({text}, w))")


def first_word(text: str, words: list[str]) -> Column:
    return F.get(words_found(text, words), F.lit(0))


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def is_missing(c: str | Column) -> Column:
    if isinstance(c, str):
        return F.expr(missing_sql(c))
    text = c.cast("string")
    return text.isNull() | text.isin(vocab.MISSING_MARKERS)


def missing_sql(name: str) -> str:
    marks = ", ".join(quoted(m) for m in vocab.MISSING_MARKERS)
    return f"(`{name}` IS NULL OR CAST(`{name}` AS STRING) IN ({marks}))"


def empty_strings() -> Column:
    return F.array().cast("array<string>")


def parse_list(c: Column) -> Column:
    """JSON (or single-quoted) list text as array<string>; other text is one element."""
    blank = c.isNull() | c.isin("null", "[]", "")
    parsed = F.from_json(c, "array<string>")
    other_json = F.try_parse_json(c).isNotNull()
    return (
        F.when(blank, empty_strings())
        .when(parsed.isNotNull(), parsed)
        .when(other_json, empty_strings())
        .otherwise(F.array(c))
    )


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def first_sentence_with(text: str, lowered: str, words: list[str]) -> Column:
    """First sentence of the text that holds a word, ignoring case; null when none does.

    The text before the earliest word gives the number of sentence breaks before it, so no
    sentence is searched on its own. `lowered` is the lower-cased text. Each word that occurs is
    looked for before the earliest one found so far: a word that reaches into that one starts
    in the same sentence, unless words hold (part of) a sentence break.
    """
    breaks = quoted(SENTENCE_BREAK)
    listed = f"filter({word_array(words)}, w -> contains({lowered}, w))"
    place = (f"aggregate({listed}, {lowered}, (t, w) -> substring_index(t, w, 1), t -> "
             f"if(octet_length(t) < octet_length({lowered}), size(split(t, {breaks})) - 1, NULL))")
    if any(not w or w[0].isspace() or re.search(SENTENCE_BREAK, w) for w in words):
        first = f"array_min(filter(transform({listed}, w -> instr({lowered}, w)), p -> p > 0))"
        place = f"size(split(substring({lowered}, 1, {first} - 1), {breaks})) - 1"
    return F.expr(f"get(split({text}, {breaks}), {place})")


def half_even(c: Column, digits: int) -> Column:
    return F.bround(c, digits)


def literal_table(rows: list, schema: str) -> Column:
    """A small constant list of records as one foldable array column."""
    return F.from_json(F.lit(json.dumps(rows)), f"array<{schema}>")


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    sin_phi, sin_lam = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    a = (sin_phi * sin_phi
         + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * sin_lam * sin_lam)
    return F.lit(2 * EARTH_KM) * F.asin(F.least(F.sqrt(a), F.lit(1.0)))


def gap_severity(count: Column, total: Column) -> Column:
    share = count / F.greatest(total, F.lit(1))
    return F.when(count == 0, 95).when(share < 0.02, 75).when(share < 0.05, 45).otherwise(20)


def severity_label(severity: Column) -> Column:
    return (
        F.when(severity > 80, "critical")
        .when(severity >= 60, "high")
        .when(severity > 30, "medium")
        .otherwise("low")
    )


def severity_rank(label: Column) -> Column:
    low = F.lower(label)
    return (
        F.when(low == "critical", 0).when(low == "high", 1)
        .when(low == "medium", 2).when(low == "low", 3).otherwise(4)
    )


def trust_band(trust: Column, high: float = 70, medium: float = 40) -> Column:
    return (
        F.when(trust.isNull(), F.lit(None).cast("string"))
        .when(trust >= high, "high").when(trust >= medium, "medium").otherwise("low")
    )


def hash_number(text: Column) -> Column:
    """First 32 bits of md5 as a whole number: the same on every engine and every run."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
