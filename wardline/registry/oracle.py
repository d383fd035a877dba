"""Check queries: the registered results restated as SQL for the checking engine.

The texts share only the derived input views with the Spark side; every operator is
written again, in the form plain SQL suggests (nested-loop joins, CASE arithmetic).
"""

from __future__ import annotations

from wardline.functions import vocab
from wardline.registry.asked import TABLE_SPECIALTIES, asked_sql
from wardline.sources import derived

ORACLE: dict[str, str] = {}
SPECIALTIES = list(vocab.GAP_SPECIALTIES)
TEXTS = ["description", "capability", "procedure", "equipment"]
ALL_WORDS = list(dict.fromkeys(w for ws in vocab.CLAIMS.values() for w in ws))


def has(col: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({col}, {lit(w)})" for w in words) + ")"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def lst(words: list[str]) -> str:
    return "[" + ", ".join(lit(w) for w in words) + "]"


def missing(col: str) -> str:
    return f"({col} IS NULL OR CAST({col} AS VARCHAR) IN ('null', '[]', '', 'None'))"


def parsed(col: str) -> str:
    return f"""CASE WHEN {col} IS NULL OR {col} IN ('null', '[]', '') THEN []::VARCHAR[]
      WHEN json_valid({col}) AND json_type({col}) = 'ARRAY' THEN from_json({col}, '["VARCHAR"]')
      WHEN json_valid({col}) THEN []::VARCHAR[]
      WHEN starts_with({col}, '[') AND json_valid(replace({col}, chr(39), '"'))
        THEN from_json(replace({col}, chr(39), '"'), '["VARCHAR"]')
      ELSE [{col}] END"""


def sentence_list(col: str) -> str:
    return (f"string_split(regexp_replace({col}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))")


def first_sentence(col: str, words: list[str]) -> str:
    pattern = "|".join(words)
    return (f"list_filter({sentence_list(col)}, "
            f"lambda s : regexp_matches(lower(s), {lit(pattern)}))[1]")


def joined(col: str) -> str:
    return f"array_to_string({col}, '|')"


def km(lat1, lng1, lat2, lng2) -> str:
    return (f"(2 * 6371 * asin(sqrt(least(1.0, pow(sin(radians(({lat2}) - ({lat1})) / 2), 2)"
            f" + cos(radians({lat1})) * cos(radians({lat2}))"
            f" * pow(sin(radians(({lng2}) - ({lng1})) / 2), 2)))))")


KEY_SUM = " + ".join(
    f"CASE WHEN {missing(c)} THEN 0 ELSE 1 END" for c in (
        "description", "specialties", "equipment", "procedure", "capability",
        "number_doctors", "capacity_n", "facility_type"))

SILVER = f"""
facilities AS MATERIALIZED ({derived.oracle_facilities()}),
silver0 AS (
  SELECT *, lower(trim("facilityTypeId")) AS facility_type,
    try_cast("numberDoctors" AS DOUBLE) AS number_doctors, try_cast(capacity AS DOUBLE) AS capacity_n,
    {parsed('specialties')} AS specialties_p, {parsed('"procedure"')} AS procedure_p,
    {parsed('equipment')} AS equipment_p, {parsed('capability')} AS capability_p,
    description IS NOT NULL OR capability IS NOT NULL AS has_text
  FROM facilities),
silver AS MATERIALIZED (
  SELECT *, round_even(({KEY_SUM}) / 8.0::DOUBLE, 3) AS data_completeness FROM silver0)
"""

HOURS = vocab.STANDARDS["has_24_7"] + vocab.LIMITED_HOURS_WORDS
LOW = {f: f"lower(coalesce(\"{f}\", ''))" for f in TEXTS}


def case_first(words: list[str], out) -> str:
    return "CASE " + " ".join(
        f"WHEN {has('l_' + f, words)} THEN {out(f)}" for f in TEXTS) + " END"


CLAIM_COLS = ",\n    ".join(
    f"CASE WHEN has_text AND ({' OR '.join(has('l_' + f, w) for f in TEXTS)}) THEN true END AS c_{c}"
    for c, w in vocab.CLAIMS.items())
FINAL_CLAIMS = ",\n    ".join(
    f"CASE WHEN has_text THEN coalesce(TRY_CAST(json_extract_string(reply, '$.{c}') AS BOOLEAN), "
    f"c_{c}) END AS {c}" for c in vocab.CLAIMS)


def union_list(known: str, words: list[str]) -> str:
    return (f"CASE WHEN has_text THEN list_concat({known}, list_filter({lst(words)}, lambda w : "
            f"contains(l_all, w) AND NOT list_contains({known}, w))) ELSE []::VARCHAR[] END")


CLAIMED = f"""
lowered AS (SELECT *, {", ".join(f"{LOW[f]} AS l_{f}" for f in TEXTS)},
    trim(regexp_replace(model_reply, '```(json)?', '', 'g'), ' ' || chr(10)) AS clean
  FROM silver),
lowered2 AS (SELECT *,
    l_description || ' ' || l_capability || ' ' || l_procedure || ' ' || l_equipment AS l_all,
    CASE WHEN json_valid(clean) THEN
      coalesce(json_extract(clean, '$.properties'), clean::JSON) END AS reply
  FROM lowered),
evidence AS (
  SELECT *,
    {CLAIM_COLS},
    {union_list('equipment_p', vocab.EQUIPMENT_WORDS)} AS extracted_equipment,
    {union_list('procedure_p', vocab.PROCEDURE_WORDS)} AS extracted_procedures,
    CASE WHEN has_text THEN {case_first(ALL_WORDS, lit)} END AS source_field,
    CASE WHEN has_text THEN {case_first(ALL_WORDS, lambda f: first_sentence('"' + f + '"', ALL_WORDS))} END
      AS sentence0,
    CASE WHEN has_text THEN {case_first(HOURS, lambda f: first_sentence('"' + f + '"', HOURS))} END
      AS operational_notes,
    CASE WHEN has_text THEN {" + ".join(f"{has('l_' + f, ALL_WORDS)}::INT" for f in TEXTS)}
      ELSE 0 END AS evidence_fields,
    CASE WHEN has_text THEN TRY_CAST(nullif(regexp_extract(l_all, '(\\d+)\\s*icu bed', 1), '')
      AS BIGINT) END AS icu_beds,
    CASE WHEN has_text THEN TRY_CAST(nullif(regexp_extract(l_all,
      '(\\d+)\\s*(?:doctors|specialists|surgeons)', 1), '') AS BIGINT) END AS inferred_doctors,
    CASE WHEN has_text AND model_reply IS NOT NULL AND NOT json_valid(clean)
      THEN 'reply is not JSON: ' || substring(clean, 1, 100) END AS extraction_error
  FROM lowered2),
claimed AS MATERIALIZED (
  SELECT * EXCLUDE ({", ".join("c_" + c for c in vocab.CLAIMS)}),
    {FINAL_CLAIMS},
    sentence0 AS source_sentence,
    CASE WHEN NOT has_text THEN 'insufficient_data'
      WHEN {missing('description')} AND {missing('capability')} THEN 'insufficient_data'
      WHEN evidence_fields >= 2 AND specific THEN 'high'
      WHEN evidence_fields >= 1 AND specific THEN 'medium' ELSE 'low' END AS confidence
  FROM (SELECT *, coalesce(regexp_matches(sentence0, '[0-9]'), false)
          OR len(extracted_equipment) + len(extracted_procedures) > 0 AS specific FROM evidence))
"""

SIX_RULES = {
    "clinic_beds": ("facility_type = 'clinic' AND beds > 50",
                    "'Facility type=clinic but claims ' || beds::VARCHAR || ' beds'", 15),
    "surgery_no_anaesthetist": (
        f"has_surgery AND NOT {has('rt', vocab.ANAESTHETIST_WORDS)}",
        "'Claims surgery capability but no anaesthesiologist mentioned'", 12),
    "limited_hours": (f"has_24_7 AND {has('rt', vocab.LIMITED_HOURS_WORDS)}",
                      "'Claims 24/7 but text suggests limited operating hours'", 10),
    "icu_no_evidence": (
        f"has_icu AND NOT {has('rt', vocab.ICU_EVIDENCE_WORDS)} AND len(extracted_equipment) = 0",
        "'Claims ICU but no supporting equipment or text evidence found'", 10),
    "one_doctor_team": (f"number_doctors = 1 AND {has('rt', vocab.TEAM_WORDS)}",
                        "'numberDoctors=1 but claims team of specialists'", 15),
    "one_doctor_24_7": ("has_24_7 AND has_emergency AND number_doctors = 1",
                        "'Claims 24/7 emergency but numberDoctors=1'", 10),
}
FIVE = list(SIX_RULES)[:5]
RULE_COLS = ", ".join(f"CASE WHEN {t} THEN {m} END AS r_{n}" for n, (t, m, _) in SIX_RULES.items())


def penalty(names) -> str:
    return " + ".join(f"CASE WHEN r_{n} IS NULL THEN 0 ELSE {SIX_RULES[n][2]} END" for n in names)


def messages(names) -> str:
    return "list_filter([" + ", ".join("r_" + n for n in names) + \
        "], lambda m : m IS NOT NULL)"


TRUSTED = f"""
ruled AS (
  SELECT *, {RULE_COLS} FROM (
    SELECT *, coalesce(list_max(list_transform(regexp_extract_all(rt, '(\\d+)\\s*bed', 1),
      lambda x : TRY_CAST(x AS BIGINT))), 0) AS beds
    FROM (SELECT *, l_description || ' ' || l_capability AS rt FROM claimed))),
parts AS (
  SELECT *,
    round_even(data_completeness * 25, 1) AS t_completeness,
    greatest(0.0::DOUBLE, 30.0::DOUBLE - ({penalty(FIVE)})) AS t_consistency,
    least(25.0::DOUBLE, 3.0::DOUBLE * (len(extracted_equipment) + len(extracted_procedures)))
      AS t_verifiability,
    CASE WHEN {missing('recency_of_page_update')} THEN 2.0::DOUBLE ELSE 8.0::DOUBLE END AS t_recency,
    least(10.0::DOUBLE, coalesce(social_count, 0) * 2.5::DOUBLE) AS t_digital,
    {messages(FIVE)} AS contradictions
  FROM ruled),
gold AS MATERIALIZED (
  SELECT *, round_even(least(100.0::DOUBLE, t_completeness + t_consistency + t_verifiability
      + t_recency + t_digital), 1) AS trust_score,
    CASE WHEN has_text THEN list_concat(capability_p, list_filter(extracted_procedures,
      lambda p : NOT list_contains(capability_p, p))) ELSE []::VARCHAR[] END AS capabilities,
    specialties_p AS specialty_list,
    concat_ws(' ', {", ".join(f"CASE WHEN trim({p}) <> '' THEN {p} END" for p in (
        "name", "description", "capability", "array_to_string(specialties_p, ' ')",
        "array_to_string(procedure_p, ' ')", "array_to_string(equipment_p, ' ')",
        "address_city", "address_state", "array_to_string(extracted_equipment, ' ')",
        "array_to_string(extracted_procedures, ' ')"))}) AS searchable_text
  FROM parts)
"""

UP_TO_SILVER = "WITH " + SILVER
UP_TO_CLAIMS = UP_TO_SILVER + "," + CLAIMED
UP_TO_GOLD = UP_TO_CLAIMS + "," + TRUSTED


def check(name: str, select: str, base: str = "", extra: str = "") -> None:
    if extra:
        base = f"{base},\n{extra}" if base else f"WITH {extra}"
    ORACLE[name] = f"{base}\n{select}"


RAW = f"WITH facilities AS ({derived.oracle_facilities()})"
QUESTIONS = f"WITH questions AS ({derived.oracle_questions()})"

# --- cleaning ------------------------------------------------------------------------------
check("parse_lists", f"""SELECT facility_id, {joined('specialties_p')} AS specialties_list,
  {joined('procedure_p')} AS procedure_list, {joined('equipment_p')} AS equipment_list,
  {joined('capability_p')} AS capability_list FROM silver""", UP_TO_SILVER)
check("completeness", "SELECT facility_id, data_completeness, has_text FROM silver", UP_TO_SILVER)
check("normal_enums", "SELECT facility_type, count(*) AS n FROM silver GROUP BY 1", UP_TO_SILVER)
check("numeric_fields", "SELECT facility_id, number_doctors, capacity_n AS capacity FROM silver",
      UP_TO_SILVER)
MISSING = "list_filter([" + ", ".join(
    f"CASE WHEN {missing(c)} THEN {lit(n)} END" for n, c in (
        ("description", "description"), ("specialties", "specialties"),
        ("equipment", "equipment"), ("procedure", '"procedure"'), ("capability", "capability"),
        ("numberDoctors", "number_doctors"), ("capacity", "capacity_n"),
        ("facilityTypeId", "facility_type"))) + "], lambda x : x IS NOT NULL)"
check("missing_fields", f"""SELECT facility_id, {joined(MISSING)} AS missing_fields,
  CASE WHEN data_completeness < 0.25 THEN 'empty' WHEN data_completeness < 0.5 THEN 'sparse'
       WHEN data_completeness < 0.75 THEN 'partial' ELSE 'full' END AS completeness_class
  FROM silver""", UP_TO_SILVER)
check("clean_silver", f"""SELECT facility_id, name, facility_type, number_doctors,
  capacity_n AS capacity, latitude, longitude, {joined('specialties_p')} AS specialties_parsed,
  {joined('procedure_p')} AS procedure_parsed, {joined('equipment_p')} AS equipment_parsed,
  {joined('capability_p')} AS capability_parsed, data_completeness, has_text FROM silver""",
      UP_TO_SILVER)
check("fill_region", f"""
SELECT s.facility_id, coalesce(s.address_state, st.state) AS address_state,
  coalesce(s.address_zip, z.zip) AS address_zip
FROM silver s
LEFT JOIN (
  SELECT a.facility_id, arg_min(c.address_state, (
      round_even({km('a.latitude', 'a.longitude', 'c.lat', 'c.lng')}, 3), c.address_state)) AS state
  FROM silver a, (SELECT address_state, round_even(avg(latitude), 4) AS lat,
      round_even(avg(longitude), 4) AS lng FROM silver
      WHERE address_state IS NOT NULL AND latitude IS NOT NULL GROUP BY 1) c
  WHERE a.address_state IS NULL AND a.latitude IS NOT NULL GROUP BY 1) st USING (facility_id)
LEFT JOIN (
  SELECT a.facility_id, arg_min(c.address_zip, (
      round_even({km('a.latitude', 'a.longitude', 'c.latitude', 'c.longitude')}, 3),
      c.address_zip)) AS zip
  FROM silver a, silver c WHERE a.address_zip IS NULL AND a.latitude IS NOT NULL
    AND c.address_zip IS NOT NULL AND c.latitude IS NOT NULL GROUP BY 1) z USING (facility_id)""",
      UP_TO_SILVER)
CATEGORY = "CASE label " + " ".join(
    f"WHEN {lit(k)} THEN {lit(v)}" for k, v in vocab.SPECIALTY_CATEGORIES.items()) \
    + " ELSE 'Other' END"
check("specialty_labels", f"""
SELECT s.facility_id, coalesce(string_agg(label, '|' ORDER BY pos), '') AS specialty_labels,
  coalesce(string_agg(DISTINCT {CATEGORY}, '|' ORDER BY {CATEGORY})
    FILTER (WHERE label IS NOT NULL), '') AS specialty_categories
FROM silver s LEFT JOIN (
  SELECT facility_id, unnest(specialties_p) AS code, generate_subscripts(specialties_p, 1) AS pos
  FROM silver) u ON s.facility_id = u.facility_id
LEFT JOIN LATERAL (SELECT lower(trim(regexp_replace(u.code, '([a-z])([A-Z])', '\\1 \\2', 'g')))
  AS label) l ON true
GROUP BY 1""", UP_TO_SILVER)
check("null_safe_casts", """SELECT facility_id,
  coalesce(TRY_CAST(TRY_CAST("numberDoctors" AS DOUBLE) AS BIGINT), 0) AS doctors_int,
  coalesce(latitude, 20.5) AS lat_float, coalesce(address_state, 'unknown') AS state_text
  FROM facilities""", RAW)
check("mean_completeness", """SELECT round_even(avg(data_completeness), 4) AS mean_completeness
  FROM silver""", UP_TO_SILVER)
RAW_COLUMNS = ["facility_id", "name", "address_state", "address_city", "address_zip", "latitude",
               "longitude", "facilityTypeId", "specialties", "procedure", "equipment",
               "capability", "description", "numberDoctors", "capacity",
               "recency_of_page_update", "social_count", "model_reply", "officialPhone",
               "officialWebsite", "email", "address_line1", "operatorTypeId", "yearEstablished"]
QUALITY = " UNION ALL ".join(f"""SELECT {lit(c)} AS column_name, count(*) AS row_count,
  count(*) FILTER (WHERE {missing(chr(34) + c + chr(34))}) AS missing,
  round_even(count(*) FILTER (WHERE {missing(chr(34) + c + chr(34))}) / count(*)::DOUBLE, 4)
  AS missing_rate FROM facilities""" for c in RAW_COLUMNS)
check("quality_report", QUALITY, RAW)
check("coordinate_bounds", """SELECT min(latitude) AS min_lat, max(latitude) AS max_lat,
  min(longitude) AS min_lng, max(longitude) AS max_lng,
  count(*) FILTER (WHERE abs(latitude) > 90 OR abs(longitude) > 180) AS off_globe,
  count(*) FILTER (WHERE latitude IS NULL OR longitude IS NULL) AS without_point
  FROM facilities""", RAW)

# --- sources and sinks ---------------------------------------------------------------------
check("read_csv_with_ids", """SELECT
  lpad(CAST(row_number() OVER (ORDER BY length(facility_id), facility_id) - 1 AS VARCHAR),
       greatest(5, length(CAST(row_number() OVER (ORDER BY length(facility_id), facility_id) - 1
       AS VARCHAR)))::INT, '0') AS facility_id,
  name, address_state, address_city, specialties, md5(description) AS description_md5
  FROM facilities""", RAW)
check("silver_layer", """SELECT address_state, count(*) AS n,
  round_even(avg(data_completeness), 4) AS mean FROM silver GROUP BY 1""", UP_TO_SILVER)


def json_list(col: str) -> str:
    return f"CAST(to_json({col}) AS VARCHAR)"


check("gold_csv", f"""SELECT facility_id, name, trust_score, {json_list('contradictions')} AS
  contradictions, {json_list('specialty_list')} AS specialties, confidence FROM gold""", UP_TO_GOLD)
check("failures_csv", """SELECT facility_id, extraction_error AS error FROM claimed
  WHERE extraction_error IS NOT NULL""", UP_TO_CLAIMS)
check("geojson_features", f"""SELECT longitude AS lng, latitude AS lat, facility_id AS id, name,
  address_city AS city, address_state AS state, facility_type AS type, trust_score,
  {joined('specialty_list')} AS specialties, has_icu, has_emergency FROM gold
  WHERE latitude IS NOT NULL AND longitude IS NOT NULL""", UP_TO_GOLD)
check("geojson_collection", """SELECT 'Feature' AS kind, address_state AS state, count(*) AS n,
    sum(round(coalesce(trust_score, 0) * 10)::BIGINT)::BIGINT AS trust_tenths,
    sum(round(latitude * 100)::BIGINT)::BIGINT AS lat_hundredths,
    sum(length(facility_id))::BIGINT AS id_chars FROM gold
  WHERE latitude IS NOT NULL AND longitude IS NOT NULL GROUP BY 2
  UNION ALL SELECT 'separator', NULL, count(*) - 1, NULL, NULL, NULL FROM gold
  WHERE latitude IS NOT NULL AND longitude IS NOT NULL HAVING count(*) > 1
  UNION ALL SELECT unnest(['header', 'footer']), NULL, 1, NULL, NULL, NULL""", UP_TO_GOLD)

# --- claims --------------------------------------------------------------------------------
check("claim_flags", f"""SELECT facility_id, {", ".join(vocab.CLAIMS)}, icu_beds, inferred_doctors
  FROM claimed""", UP_TO_CLAIMS)
check("claim_lists", f"""SELECT facility_id, {joined('extracted_equipment')} AS extracted_equipment,
  {joined('extracted_procedures')} AS extracted_procedures, operational_notes FROM claimed""",
      UP_TO_CLAIMS)
check("confidence_grade", """SELECT facility_id, confidence,
  evidence_fields::BIGINT AS evidence_fields FROM claimed""", UP_TO_CLAIMS)
check("bed_mentions", """SELECT facility_id, coalesce(list_max(list_transform(regexp_extract_all(
  lower(concat_ws(' ', description, capability)), '(\\d+)\\s*bed', 1),
  lambda x : TRY_CAST(x AS BIGINT))), 0) AS max_beds FROM facilities""", RAW)
check("model_reply_json", """SELECT facility_id,
  TRY_CAST(json_extract_string(reply, '$.has_icu') AS BOOLEAN) AS has_icu,
  TRY_CAST(json_extract_string(reply, '$.has_24_7') AS BOOLEAN) AS has_24_7,
  CASE WHEN model_reply IS NOT NULL AND NOT json_valid(clean)
    THEN 'reply is not JSON: ' || substring(clean, 1, 100) END AS error
  FROM lowered2""", UP_TO_CLAIMS)
check("event_props_json", """SELECT event_type, count(*) AS n,
  count(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)) AS parsed,
  sum(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS sum_k
  FROM events GROUP BY 1""")
check("display_specialties", """SELECT facility_id, array_to_string(list_slice(list_filter(
  [trim(address_city), trim(name), trim(address_zip), trim(address_state), trim(facility_id)],
  lambda x : x IS NOT NULL), 1, 4), '|') AS shown FROM facilities""", RAW)
check("text_routes", """SELECT facility_id, confidence, trust_score,
  CASE WHEN has_text THEN 'text' ELSE 'trust only' END AS route FROM gold""", UP_TO_GOLD)
check("extraction_failures", """SELECT facility_id, extraction_error AS error FROM claimed
  WHERE extraction_error IS NOT NULL""", UP_TO_CLAIMS)
check("typed_records", """SELECT facility_id, name,
  coalesce(TRY_CAST(capacity AS BIGINT), 0) AS capacity,
  TRY_CAST("numberDoctors" AS BIGINT) AS number_doctors,
  coalesce(social_count, 0)::BIGINT AS social_count, coalesce(latitude, 0.0) AS latitude,
  CAST(TRY_CAST(recency_of_page_update AS DATE) AS VARCHAR) AS updated FROM facilities""", RAW)
check("evidence_sentences", f"""SELECT facility_id, field AS source_field,
  CASE field {" ".join(
      f"WHEN {lit(f)} THEN " + first_sentence(chr(34) + f + chr(34), ALL_WORDS) for f in TEXTS)} END
  AS source_sentence
  FROM (SELECT *, {case_first(ALL_WORDS, lit)} AS field FROM lowered2) WHERE field IS NOT NULL""",
      UP_TO_CLAIMS)
check("build_gold", f"""SELECT facility_id, name, address_state, address_city, facility_type,
  has_icu, has_24_7, confidence, {joined('capabilities')} AS capabilities,
  {joined('contradictions')} AS contradictions, trust_score,
  t_completeness AS trust_completeness, t_consistency AS trust_consistency,
  t_verifiability AS trust_verifiability, t_recency AS trust_recency, t_digital AS trust_digital,
  source_field, source_sentence, operational_notes, extraction_error, beds AS bed_count
  FROM gold""", UP_TO_GOLD)
check("contradicting_evidence", " UNION ALL ".join(
    f"SELECT facility_id, {lit(n)} AS rule, r_{n} AS message FROM gold WHERE r_{n} IS NOT NULL"
    for n in FIVE), UP_TO_GOLD)

# --- trust ---------------------------------------------------------------------------------
check("trust_parts", """SELECT facility_id, t_completeness AS completeness,
  t_consistency AS consistency, t_verifiability AS verifiability, t_recency AS recency,
  t_digital AS digital, trust_score FROM gold""", UP_TO_GOLD)
check("trust_rules", f"""SELECT facility_id, {joined('contradictions')} AS contradictions FROM gold
  WHERE len(contradictions) > 0""", UP_TO_GOLD)
check("trust_rule_one_doctor", f"""SELECT facility_id,
  len({messages(SIX_RULES)})::BIGINT AS fired, c6 AS consistency,
  round_even(least(100.0::DOUBLE, t_completeness + c6 + t_verifiability + t_recency + t_digital), 1)
    AS trust_score
  FROM (SELECT *, greatest(0.0::DOUBLE, 30.0::DOUBLE - ({penalty(SIX_RULES)})) AS c6 FROM gold)""",
      UP_TO_GOLD)
check("trust_recency_decay", """SELECT facility_id, coalesce(round_even(10 * exp(-(
  datediff('month', TRY_CAST(recency_of_page_update AS DATE), DATE '2025-02-01')) / 12.0::DOUBLE), 3),
  0.0::DOUBLE) AS decay FROM facilities""", RAW)
STD = " + ".join(f"coalesce({c}, false)::INT" for c in vocab.STANDARDS)
STD_OK = " + ".join(f"(coalesce({c}, false) AND {has('rt', w)})::INT"
                    for c, w in vocab.STANDARDS.items())
check("trust_verifiability_ratio", f"""SELECT facility_id, CASE WHEN ({STD}) = 0 THEN 0.0::DOUBLE
  ELSE round_even(({STD_OK}) / ({STD})::DOUBLE * 25, 1) END AS verifiability FROM gold""", UP_TO_GOLD)
check("trust_bands", """SELECT CASE WHEN trust_score >= 70 THEN 'high' WHEN trust_score >= 40
  THEN 'medium' ELSE 'low' END AS band, CASE WHEN trust_score >= 80 THEN 'high'
  WHEN trust_score >= 60 THEN 'medium' ELSE 'low' END AS strict_band, count(*) AS n
  FROM gold GROUP BY 1, 2""", UP_TO_GOLD)
check("trust_distribution", """SELECT address_state, facility_type,
  (floor(trust_score / 10) * 10)::BIGINT AS trust_bucket, count(*) AS facilities
  FROM gold GROUP BY 1, 2, 3""", UP_TO_GOLD)
check("low_trust_critical", """SELECT facility_id, trust_score FROM gold WHERE trust_score < 40
  AND (has_icu OR has_emergency OR has_trauma_centre OR has_neonatal_icu)""", UP_TO_GOLD)

# --- search --------------------------------------------------------------------------------
check("searchable_text", """SELECT facility_id, md5(searchable_text) AS text_md5,
  length(searchable_text)::BIGINT AS chars FROM gold""", UP_TO_GOLD)
DIALYSIS = "len(list_filter(specialty_list, lambda x : contains(x, 'nephrology') OR contains(x, 'dialysis'))) > 0"
FILTERS = {
    "state": "contains(address_state, 'BRA')", "city": "contains(address_city, '_C1')",
    "type": "facility_type = 'clinic'", "min_trust": "trust_score >= 50",
    "no_trust": "trust_score IS NOT NULL", "icu": "has_icu", "emergency": "has_emergency",
    "dialysis": DIALYSIS, "open_24_7": "has_24_7", "contradictions": "len(contradictions) > 0",
    "min_doctors": "coalesce(number_doctors, inferred_doctors) > 5",
}
check("single_filters", " UNION ALL ".join(
    f"SELECT {lit(n)} AS filter, count(*) AS n FROM gold WHERE {t}"
    for n, t in FILTERS.items()), UP_TO_GOLD)


def word_list(text: str) -> str:
    return (f"list_filter(string_split_regex(lower(coalesce({text}, '')), '\\s+'), "
            "lambda w : w <> '')")


def useful(text: str) -> str:
    return (f"list_filter({word_list(text)}, lambda w : length(w) >= 3 AND "
            f"NOT list_contains({lst(vocab.STOP_WORDS)}, w))")


def dedupe(items: str) -> str:
    return f"list_filter({items}, lambda x, i : list_position({items}, x) = i)"


PREFIX_ROWS = ", ".join(
    f"({i}, {lit(k)}, {lst(v)})" for i, (k, v) in enumerate(vocab.SPECIALTY_PREFIXES.items()))
PATTERNS = f"""prefixes(pos, prefix, patterns) AS (VALUES {PREFIX_ROWS}),
word_rows AS (SELECT query_id, unnest({word_list('query')}) AS word,
  generate_subscripts({word_list('query')}, 1) AS nth FROM questions),
pattern_rows AS (SELECT query_id, nth, pos, unnest(patterns) AS pattern,
  generate_subscripts(patterns, 1) AS sub FROM word_rows JOIN prefixes
  ON starts_with(word, prefix)),
pattern_first AS (SELECT query_id, pattern, min((nth, pos, sub)) AS spot FROM pattern_rows
  GROUP BY 1, 2),
patterns AS (SELECT query_id, list(pattern ORDER BY spot) AS specialties FROM pattern_first
  GROUP BY 1),
asked_patterns AS (SELECT q.*, coalesce(p.specialties, []::VARCHAR[]) AS specialties
  FROM questions q LEFT JOIN patterns p USING (query_id))"""
check("specialty_intent", f"SELECT query_id, {joined('specialties')} AS patterns "
      "FROM asked_patterns", QUESTIONS, PATTERNS)
SPEC_WORDS = ("flatten(list_transform(list_slice(specialties, 1, 4), lambda s : "
              f"{useful('s')}))")
check("query_terms", f"""SELECT query_id, array_to_string(list_slice({dedupe('words')}, 1, 8), '|')
  AS terms FROM (SELECT query_id, list_concat({useful('query')}, {SPEC_WORDS}) AS words
  FROM asked_patterns)""", QUESTIONS, PATTERNS)
HAY = ("searchable_text || chr(10) || array_to_string(capabilities, chr(10)) || chr(10) || "
       "array_to_string(specialty_list, chr(10))")
check("relevance_score", f"""SELECT * FROM (SELECT facility_id,
  len(list_filter(['icu', 'surgery', 'ventilator', 'the', 'nephrology'], lambda t :
  contains({HAY}, t)))::BIGINT AS relevance FROM gold) WHERE relevance > 0""", UP_TO_GOLD)
check("name_join_stored", """SELECT name, (n * m)::BIGINT AS pair_rows, (tenths * m)::BIGINT
  AS trust_tenths, best_trust, states FROM (
  SELECT name, count(*) AS n, count(*) AS m, max(trust_score) AS best_trust,
    sum(round(trust_score * 10)::BIGINT)::BIGINT AS tenths,
    count(DISTINCT address_state) AS states FROM gold GROUP BY 1)""", UP_TO_GOLD)
check("stored_records", f"""SELECT facility_id, has_icu, has_emergency, has_24_7,
  {joined('capabilities')} AS capabilities, inferred_doctors, {joined('contradictions')} AS
  contradictions, confidence, beds AS bed_count, t_completeness AS trust_completeness,
  t_consistency AS trust_consistency, t_verifiability AS trust_verifiability,
  t_recency AS trust_recency, t_digital AS trust_digital FROM gold""", UP_TO_GOLD)
check("stored_filters", """SELECT unnest(['text', 'struct', 'variant']) AS form, * FROM (
  SELECT count(*) FILTER (WHERE has_icu) AS has_icu,
  count(*) FILTER (WHERE has_emergency) AS has_emergency,
  count(*) FILTER (WHERE has_24_7) AS has_24_7 FROM gold)""", UP_TO_GOLD)
check("stored_lists", f"""SELECT facility_id, unnest(['array', 'text']) AS form,
  {joined('list_slice(specialty_list, 1, 4)')} AS specialties,
  {joined('contradictions')} AS contradictions FROM gold""", UP_TO_GOLD)
check("name_join", """SELECT g.name, count(DISTINCT g.facility_id) AS gold_rows,
  count(DISTINCT s.facility_id) AS silver_rows, count(*) AS pair_rows
  FROM gold g JOIN gold s ON g.name = s.name GROUP BY 1""", UP_TO_GOLD)

TRIGGERS = lst(vocab.CONTRADICTION_TRIGGERS)
FOUND = f"""
asked0 AS ({asked_sql()}),
asked AS (SELECT *, list_slice({dedupe('words')}, 1, 8) AS terms,
  coalesce(requires_contradictions, false)
    OR list_has_any({word_list('query')}, {TRIGGERS})
    OR list_has_any({word_list('search_text')}, {TRIGGERS}) AS disputed
  FROM (SELECT *, list_concat({useful('search_text')}, {SPEC_WORDS}) AS words FROM asked0)),
matched AS (
  SELECT q.query_id, g.facility_id AS gold_id, s.facility_id AS silver_id, g.trust_score,
    len(q.terms) AS n_terms,
    len(list_filter(q.terms, lambda t : contains(s.searchable_text, t)
      OR contains(array_to_string(g.capabilities, chr(10)), t)
      OR contains(array_to_string(s.specialty_list, chr(10)), t))) AS relevance_score
  FROM asked q, gold g JOIN gold s ON g.name = s.name
  WHERE g.trust_score IS NOT NULL
    AND (q.state IS NULL OR contains(s.address_state, q.state))
    AND (q.city IS NULL OR contains(s.address_city, q.city))
    AND (q.facility_type IS NULL OR s.facility_type = q.facility_type)
    AND (coalesce(q.min_trust_score, 0) = 0 OR g.trust_score >= q.min_trust_score)
    AND (NOT coalesce(q.requires_icu, false) OR g.has_icu)
    AND (NOT coalesce(q.requires_emergency, false) OR g.has_emergency)
    AND (NOT coalesce(q.requires_dialysis, false) OR
      {DIALYSIS.replace('specialty_list', 's.specialty_list')})
    AND (NOT q.disputed OR len(g.contradictions) > 0)
    AND (q.min_doctors IS NULL OR coalesce(g.number_doctors, g.inferred_doctors) > q.min_doctors)),
ranked AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance_score DESC,
    trust_score DESC, gold_id, silver_id) AS rank
  FROM matched WHERE n_terms = 0 OR relevance_score > 0),
found AS (SELECT *, least(20, count(*) OVER (PARTITION BY query_id)) AS total_found FROM ranked
  WHERE rank <= 20)"""
check("search_batch", """SELECT query_id, rank::BIGINT AS rank, gold_id, silver_id,
  relevance_score::BIGINT AS relevance_score, trust_score, trust_score AS final_score
  FROM ranked WHERE rank <= 20""", UP_TO_GOLD, FOUND)

CITES = f"""list_filter([
  CASE WHEN g.has_icu THEN 'ICU confirmed (extracted from facility text)' END,
  CASE WHEN g.has_emergency THEN 'Emergency services confirmed (extracted from facility text)' END,
  CASE WHEN g.has_24_7 THEN '24/7 availability confirmed (extracted from facility text)' END,
  CASE WHEN len(g.capabilities) > 0 THEN 'Key capabilities extracted: ' ||
    array_to_string(list_slice(g.capabilities, 1, 3), ', ') END,
  CASE WHEN g.inferred_doctors > 0 THEN g.inferred_doctors::VARCHAR ||
    ' doctors identified in facility text' END], lambda x : x IS NOT NULL)"""
PARTS = ", ".join(
    f"'{label}: ' || g.t_{part}::VARCHAR || '/{top}'" for label, part, top in (
        ("Completeness", "completeness", 25), ("Consistency", "consistency", 30),
        ("Verifiability", "verifiability", 25), ("Recency", "recency", 10),
        ("Digital presence", "digital", 10)))
RESULTS = FOUND + f""",
results AS MATERIALIZED (
  SELECT f.query_id, f.rank::BIGINT AS rank, f.total_found, g.name, s.facility_type,
    s.address_state AS state, s.address_city AS city, s.address_zip AS pin_code,
    s.officialPhone AS phone, s.officialWebsite AS website, s.latitude, s.longitude, g.trust_score,
    g.confidence, g.has_icu, g.has_emergency, g.has_24_7,
    list_slice(g.capabilities, 1, 5) AS key_capabilities, g.inferred_doctors AS doctor_count,
    g.beds AS bed_count,
    CASE WHEN len({CITES}) > 0 THEN {CITES} ELSE
      ['Basic facility information — insufficient text for detailed citation'] END
      AS sentence_citations,
    coalesce(nullif(s.description, ''), s.searchable_text) AS whole_text,
    substring(whole_text, 1, 400) AS source_text,
    'description + capability statements' AS source_field,
    [{PARTS}] AS trust_justification, g.contradictions
  FROM found f JOIN gold g ON f.gold_id = g.facility_id JOIN gold s ON f.silver_id = s.facility_id
  WHERE f.rank <= 10)"""
check("format_results", f"""SELECT query_id, rank, name, facility_type, state, city, pin_code,
  phone, website, latitude, longitude, trust_score, confidence, has_icu, has_emergency, has_24_7,
  {joined('key_capabilities')} AS key_capabilities, doctor_count, bed_count,
  array_to_string(sentence_citations, ' | ') AS citation,
  {joined('sentence_citations')} AS sentence_citations, source_text, source_field,
  {joined('trust_justification')} AS trust_justification,
  {joined('contradictions')} AS contradictions FROM results""", UP_TO_GOLD, RESULTS)

CHECKED_CLAIMS = ["has_icu", "has_emergency", "has_24_7"]


def ok(c: str, text: str) -> str:
    return has(f"lower({text})", vocab.STANDARDS[c])



def tenths(x: str) -> str:
    """Half-even to one decimal of the number as printed. round_even(x, 1) takes 28.5 * 0.9 =
    25.650000000000002 for a tie, as it rounds the product by ten."""
    d = f"CAST(CAST({x} AS VARCHAR) AS DECIMAL(25, 18))"
    low = f"floor({d} * 10)"
    return (f"CASE WHEN {d} * 10 - {low} = 0.5 AND CAST({low} AS BIGINT) % 2 = 0 "
            f"THEN CAST({low} AS DOUBLE) / 10 ELSE CAST(round({d}, 1) AS DOUBLE) END")


SHORT = "whole_text"
VALID = RESULTS + f""",
validated AS MATERIALIZED (
  SELECT *, CASE WHEN nothing THEN 'INSUFFICIENT_TEXT' WHEN len(failed) > 0 THEN 'DISPUTED'
      ELSE 'VERIFIED' END AS overall_verdict,
    CASE WHEN nothing THEN 'Text too short or no claim to verify'
      WHEN len(failed) > 0 THEN 'No evidence for ' || array_to_string(failed, ', ')
      ELSE 'All claims supported' END AS validation_note
  FROM (SELECT *,
    {", ".join(f"CASE WHEN {c} THEN {ok(c, SHORT)} END AS {c}_supported" for c in CHECKED_CLAIMS)},
    list_filter([{", ".join(f"CASE WHEN {c} AND NOT {ok(c, SHORT)} THEN '{c}' END"
                            for c in CHECKED_CLAIMS)}], lambda x : x IS NOT NULL) AS failed,
    length({SHORT}) < 20 OR NOT ({" OR ".join(f"coalesce({c}, false)" for c in CHECKED_CLAIMS)})
      AS nothing,
    len(list_filter(key_capabilities, lambda c : NOT contains(lower({SHORT}), lower(c)))) = 0
      AS capabilities_supported
    FROM results))"""
check("validate_top", """SELECT query_id, rank, name AS facility_name, has_icu_supported,
  has_emergency_supported, has_24_7_supported, capabilities_supported, validation_note,
  overall_verdict FROM validated WHERE rank <= 5""", UP_TO_GOLD, VALID)
LONG = "whole_text"
ANSWERS = VALID + f""",
top5 AS (SELECT query_id, name, arg_max(overall_verdict, rank) AS verdict,
    arg_max(validation_note, rank) AS note, max(rank) AS last_rank
  FROM validated WHERE rank <= 5 GROUP BY 1, 2),
attached AS (SELECT v.* EXCLUDE (validation_note),
    coalesce(t.verdict, 'NOT_VALIDATED') AS validation_verdict,
    coalesce(t.note, '') AS validation_note, l.has_icu_supported AS icu_verified,
    l.has_emergency_supported AS emergency_verified, l.has_24_7_supported AS availability_verified
  FROM validated v LEFT JOIN top5 t ON v.query_id = t.query_id AND v.name = t.name
  LEFT JOIN validated l ON l.query_id = t.query_id AND l.rank = t.last_rank),
reread AS (SELECT *, validation_verdict = 'DISPUTED' AS d,
    list_filter(key_capabilities, lambda c : contains(lower({LONG}), lower(c))) AS kept,
    array_to_string(sentence_citations, ' | ') AS citation0,
    {first_sentence(LONG, ALL_WORDS)} AS hit,
    {", ".join(f"coalesce({c}, false) AND NOT {ok(c, LONG)} AS lost_{c}" for c in CHECKED_CLAIMS)}
  FROM attached),
corrected AS (SELECT *,
    d AND (lost_has_icu OR lost_has_emergency OR lost_has_24_7
      OR len(kept) < len(key_capabilities)) AS removed FROM reread),
answers AS MATERIALIZED (
  SELECT query_id, rank, name, state, city, facility_type, pin_code, phone, latitude, longitude,
    trust_score, total_found, contradictions, source_text, validation_verdict, validation_note,
    icu_verified, emergency_verified, availability_verified,
    removed OR (d AND coalesce(hit <> citation0, false)) AS self_corrected,
    CASE WHEN removed THEN 'Removed without evidence: ' || array_to_string(list_concat(list_filter([
      {", ".join(f"CASE WHEN lost_{c} THEN '{c}' END" for c in CHECKED_CLAIMS)}],
      lambda x : x IS NOT NULL), list_filter(key_capabilities, lambda c : NOT list_contains(kept, c))),
      ', ') ELSE '' END AS correction_note,
    {", ".join(f"CASE WHEN NOT (d AND lost_{c}) THEN {c} END AS {c}" for c in CHECKED_CLAIMS)},
    CASE WHEN removed THEN 'low' ELSE confidence END AS confidence,
    CASE WHEN d THEN coalesce(hit, citation0) ELSE citation0 END AS citation,
    CASE WHEN d THEN kept ELSE key_capabilities END AS key_capabilities
  FROM corrected),
shown AS MATERIALIZED (SELECT *,
    CASE WHEN self_corrected THEN {tenths('trust_score * 0.90::DOUBLE')}
      WHEN validation_verdict = 'DISPUTED' THEN {tenths('trust_score * 0.85::DOUBLE')}
      ELSE trust_score END AS trust_score_display,
    CASE WHEN self_corrected THEN 'Self-corrected — extraction revised after validation'
      WHEN validation_verdict = 'DISPUTED' THEN
        'Trust score adjusted — disputed claims not correctable' END AS trust_score_warning
  FROM answers)"""
check("answer_rows", f"""SELECT query_id, rank, name, validation_verdict, validation_note,
  icu_verified, emergency_verified, availability_verified, self_corrected, correction_note,
  has_icu, has_emergency, has_24_7, confidence, citation,
  {joined('key_capabilities')} AS key_capabilities, trust_score_display, total_found
  FROM shown""", UP_TO_GOLD, ANSWERS)
check("trust_display", """SELECT query_id, rank, trust_score, trust_score_display,
  trust_score_warning FROM shown""", UP_TO_GOLD, ANSWERS)
TAGS = """list_concat(list_filter([
  CASE validation_verdict WHEN 'VERIFIED' THEN '✅ Verified' WHEN 'DISPUTED' THEN '⚠ Disputed!' END,
  CASE WHEN self_corrected THEN '🔄 Self-corrected' END, CASE WHEN has_icu THEN 'ICU' END,
  CASE WHEN has_emergency THEN 'Emergency' END, CASE WHEN has_24_7 THEN '24/7' END,
  CASE WHEN confidence = 'low' THEN 'Low data quality!' END,
  CASE WHEN len(contradictions) > 0 THEN '⚠ ' || len(contradictions)::VARCHAR ||
    ' contradiction(s)!' END], lambda x : x IS NOT NULL),
  list_transform(list_slice(key_capabilities, 1, 2), lambda c : substring(c, 1, 25)))"""
check("result_tags", f"SELECT query_id, rank, {joined(TAGS)} AS tags FROM shown",
      UP_TO_GOLD, ANSWERS)
CARDS = """SELECT query_id, rank, name,
  coalesce(city, '') || ', ' || coalesce(state, '') AS location, trust_score_display AS trust,
  upper(substring(coalesce(facility_type, 'facility'), 1, 1)) ||
    substring(coalesce(facility_type, 'facility'), 2) AS type,
  substring(citation, 1, 200) AS citation, phone, pin_code, latitude, longitude, validation_note,
  correction_note, substring(source_text, 1, 300) AS source_text FROM shown"""
check("result_cards", CARDS, UP_TO_GOLD, ANSWERS)
SUMMARY = """SELECT a.query_id, coalesce(s.total_found, 0)::BIGINT AS total_found,
  CASE WHEN s.name IS NULL THEN
    'No facilities found matching your query. Try broadening your search criteria.'
  ELSE 'Found ' || s.total_found::VARCHAR || ' facilities matching your criteria. Top result: ' ||
    s.name || ' in ' || coalesce(s.state, 'India') || ' with a trust score of ' ||
    s.trust_score_display::VARCHAR || '. The search was validated against original source text.'
  END AS answer FROM asked a LEFT JOIN shown s ON a.query_id = s.query_id AND s.rank = 1"""
check("answer_summary", SUMMARY, UP_TO_GOLD, ANSWERS)
TRACE = f"""SELECT a.query_id, coalesce(max(s.total_found), 0)::BIGINT AS candidates,
  coalesce(((2 * sum(round(s.trust_score * 10)::BIGINT) FILTER (WHERE s.trust_score > 0)
      + count(*) FILTER (WHERE s.trust_score > 0))
    // (2 * nullif(count(*) FILTER (WHERE s.trust_score > 0), 0)))::DOUBLE / 10.0::DOUBLE, 0.0::DOUBLE)
    AS avg_trust,
  count(*) FILTER (WHERE s.validation_verdict = 'VERIFIED') AS verified,
  count(*) FILTER (WHERE s.validation_verdict = 'DISPUTED') AS disputed,
  count(*) FILTER (WHERE s.self_corrected) AS self_corrected,
  max(len({word_list('a.query')}) * 50 + 500)::BIGINT AS tokens
  FROM asked a LEFT JOIN shown s ON a.query_id = s.query_id GROUP BY 1"""
check("query_trace", TRACE, UP_TO_GOLD, ANSWERS)
check("verdict_counts", """SELECT query_id, count(*) FILTER (WHERE rank <= 5) AS validated,
  count(*) FILTER (WHERE rank <= 5 AND validation_verdict = 'VERIFIED') AS verified,
  count(*) FILTER (WHERE rank <= 5 AND validation_verdict = 'DISPUTED') AS disputed,
  count(*) FILTER (WHERE rank <= 5 AND validation_verdict = 'INSUFFICIENT_TEXT') AS insufficient,
  count(*) FILTER (WHERE self_corrected) AS corrected FROM shown GROUP BY 1""", UP_TO_GOLD, ANSWERS)
check("contradiction_text", """SELECT facility_id, CASE WHEN equipment IS NULL THEN '' ELSE
  array_to_string(from_json(equipment, '["VARCHAR"]'), '|') END AS contradictions
  FROM facilities""", RAW)

VECTORS = """exemplars AS (SELECT label, min(vec_id) AS query_id FROM embeddings GROUP BY 1),
scored AS (SELECT e.query_id, v.vec_id, v.label, round_even(list_cosine_similarity(
    q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 4) AS score
  FROM exemplars e JOIN embeddings q ON e.query_id = q.vec_id, embeddings v
  WHERE v.vec_id <> e.query_id)"""
for key, test, top in (("vector_top_k", "true", 50), ("vector_top_k_filtered", "label >= 5", 10),
                       ("vector_cells_top_k", "true", 50)):
    check(key, f"""SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id
  ORDER BY score DESC, vec_id)::BIGINT AS rank, vec_id, score FROM scored WHERE {test})
  WHERE rank <= {top}""", "", VECTORS)
check("distance_to_reference", f"""SELECT facility_id,
  round_even({km('latitude', 'longitude', '28.61', '77.21')}, 3) AS distance_km FROM facilities""",
      RAW)

# --- questions -----------------------------------------------------------------------------
GAP = has("lower(query)", vocab.GAP_PHRASES)
check("gap_intent", f"SELECT query_id, {GAP} AS is_gap FROM questions", QUESTIONS)
check("needs_translation", """SELECT query_id, coalesce(language IN ('hi-IN', 'ur-PK', 'hi', 'ur'),
  false) OR strlen(query) <> length(query) AS translate FROM questions""", QUESTIONS)
UI_QUERY = """CASE WHEN ui_state IS NULL OR ui_state IN ('', 'All')
  OR contains(lower(query), lower(ui_state)) THEN query ELSE query || ' in ' || ui_state END"""
check("ui_filters", f"""SELECT query_id, {UI_QUERY} AS query FROM questions
  WHERE length(trim(query)) >= 3""", QUESTIONS)
check("query_routes", f"""SELECT CASE WHEN {GAP} THEN 'gap' ELSE 'search' END AS route,
  count(*) AS n, min(query_id) AS first_id FROM questions GROUP BY 1""", QUESTIONS)


def longest(col: str) -> str:
    return (f"(SELECT query_id, arg_min(place, (-length(place), place)) AS {col} FROM questions, "
            f"(SELECT DISTINCT address_{col} AS place FROM facilities) WHERE "
            f"contains(lower(query), lower(place)) GROUP BY 1)")


TYPE = "CASE " + " ".join(f"WHEN contains(lower(query), '{t}') THEN '{t}'"
                          for t in vocab.FACILITY_TYPES) + " END"


def parsed_select(specialties: str, source: str, more: str = "") -> str:
    return f"""SELECT query_id, state, city, {TYPE} AS facility_type,
  {specialties} AS specialties,
  {", ".join(f"CASE WHEN {has('lower(query)', vocab.CLAIMS[c])} THEN true END AS requires_{n}"
             for c, n in (("has_icu", "icu"), ("has_emergency", "emergency"), ("has_24_7", "24_7"),
                          ("has_dialysis", "dialysis")))},
  CASE WHEN list_has_any({word_list('query')}, {TRIGGERS}) THEN true END
    AS requires_contradictions, min_trust_score,
  array_to_string(list_filter({word_list('query')}, lambda w :
    NOT list_contains({lst(vocab.STOP_WORDS)}, w)
    AND NOT list_contains(list_concat({word_list('state')}, {word_list('city')}), w)), ' ')
    AS search_text,
  CASE WHEN ui_min_trust > 0 THEN ui_min_trust ELSE min_trust_score END AS effective_trust{more}
  FROM (SELECT *, TRY_CAST(nullif(regexp_extract(lower(query), 'trust\\D*(\\d+)', 1), '')
      AS DOUBLE) AS min_trust_score FROM {source})
  LEFT JOIN {longest('state')} USING (query_id) LEFT JOIN {longest('city')} USING (query_id)"""


check("parse_queries", parsed_select(joined("specialties"), "asked_patterns"),
      QUESTIONS, f"facilities AS ({derived.oracle_facilities()}),\n" + PATTERNS)
check("min_doctors", """SELECT facility_id, number_doctors, inferred_doctors FROM claimed
  WHERE coalesce(number_doctors, inferred_doctors) > 5""", UP_TO_CLAIMS)

# --- validation ----------------------------------------------------------------------------
SNIPPET = "lower(coalesce(nullif(description, ''), searchable_text))"


def first_found(words) -> str:
    return "CASE " + " ".join(f"WHEN contains(snip, {lit(w)}) THEN {lit(w)}" for w in words) + " END"


STANDARD_ROWS = "standards_rows AS (" + " UNION ALL ".join(
    f"SELECT facility_id, {lit(c)} AS claim, coalesce({c}, false) AS claimed, "
    f"{first_found(w)} AS word, {lit('Expected one of: ' + str(w[:3]))} AS note FROM snips"
    for c, w in vocab.STANDARDS.items()) + ")"
STANDARD = f"snips AS (SELECT *, {SNIPPET} AS snip FROM gold), {STANDARD_ROWS}"
check("standards_check", """SELECT facility_id, claim, claimed,
  CASE WHEN claimed THEN word IS NOT NULL END AS supported,
  CASE WHEN claimed THEN word END AS evidence,
  CASE WHEN claimed AND word IS NULL THEN note END AS standard_note FROM standards_rows""",
      UP_TO_GOLD, STANDARD)
ORDER = "CASE claim " + " ".join(f"WHEN {lit(c)} THEN {i}" for i, c in
                                 enumerate(vocab.STANDARDS)) + " END"
check("failed_claims", f"""SELECT facility_id, string_agg(claim, '|' ORDER BY {ORDER}) AS failed
  FROM standards_rows WHERE claimed AND word IS NULL GROUP BY 1""", UP_TO_GOLD, STANDARD)


def md5_number(text: str) -> str:
    return f"('0x' || substring(md5({text}), 1, 8))::BIGINT"


SAMPLE = f"""sampled AS (SELECT *, CASE WHEN trust_score >= 70 THEN 'high' WHEN trust_score >= 40
  THEN 'medium' ELSE 'low' END AS band FROM gold WHERE {md5_number('facility_id')} % 10000 < 1000)"""
check("stratified_sample", "SELECT facility_id, band FROM sampled", UP_TO_GOLD, SAMPLE)
OPINION = SAMPLE + """,
compared AS (SELECT s.facility_id,
  (s.has_icu IS NOT DISTINCT FROM CASE WHEN l.quality = 1 THEN true END)::INT AS icu,
  (s.has_surgery IS NOT DISTINCT FROM CASE WHEN l.toxic = 1 THEN true END)::INT AS surgery
  FROM sampled s LEFT JOIN labels l ON l.doc_id = CAST(s.facility_id AS BIGINT))"""
check("agreement_records", """SELECT facility_id, round_even((icu + surgery) / 2.0::DOUBLE, 4)
  AS agreement, icu + surgery < 2 AS needs_review FROM compared""", UP_TO_GOLD, OPINION)
check("agreement_rate", """SELECT count(*) AS sampled, round_even(avg(icu), 4) AS has_icu_rate,
  round_even(avg(surgery), 4) AS has_surgery_rate,
  count(*) FILTER (WHERE icu + surgery < 2) AS needs_review FROM compared""", UP_TO_GOLD, OPINION)
check("bootstrap_interval", """SELECT grp AS address_state,
  round_even(quantile_cont(of_all, 0.025), 4) AS of_all_lower,
  round_even(quantile_cont(of_all, 0.975), 4) AS of_all_upper,
  round_even(quantile_cont(of_known, 0.025), 4) AS of_known_lower,
  round_even(quantile_cont(of_known, 0.975), 4) AS of_known_upper
  FROM shares GROUP BY 1""", UP_TO_GOLD, f"""
counts AS (SELECT address_state AS grp, CASE WHEN has_icu THEN 'yes' WHEN NOT has_icu THEN 'no'
    ELSE 'unknown' END AS answer, count(*) AS n FROM gold WHERE address_state IS NOT NULL GROUP BY 1, 2),
chances AS (SELECT *, exp(k * ln(n::DOUBLE) - n - lgamma(k + 1)) AS p FROM (
  SELECT *, unnest(range(greatest(0, n - ceil(9 * sqrt(n))::BIGINT - 10),
    n + ceil(9 * sqrt(n))::BIGINT + 11)) AS k FROM counts)),
cumulated AS (SELECT grp, answer, k, sum(p) OVER (PARTITION BY grp, answer ORDER BY k) AS upto FROM chances),
draws AS (SELECT grp, answer, b, {md5_number("grp || '|' || answer || '|' || b::VARCHAR")}
    / 4294967296.0::DOUBLE AS u FROM counts, range(1, 201) r(b)),
weights AS (SELECT grp, answer, b, min(k) AS w FROM draws JOIN cumulated USING (grp, answer)
  WHERE upto > u GROUP BY 1, 2, 3),
shares AS (SELECT grp, b,
  coalesce(sum(w) FILTER (WHERE answer = 'yes'), 0)::DOUBLE / nullif(sum(w), 0)::DOUBLE AS of_all,
  coalesce(sum(w) FILTER (WHERE answer = 'yes'), 0)::DOUBLE
    / nullif(sum(w) FILTER (WHERE answer <> 'unknown'), 0)::DOUBLE AS of_known
  FROM weights GROUP BY 1, 2)""")

# --- gaps ----------------------------------------------------------------------------------
check("specialty_match", "SELECT facility_id, " + ", ".join(
    f"{has('lower(searchable_text)', w)} AS is_{s}" for s, w in vocab.GAP_SPECIALTIES.items())
    + " FROM gold", UP_TO_GOLD)
SPECIALTY_ROWS = " UNION ALL ".join(
    f"SELECT facility_id, {lit(s)} AS specialty FROM gold WHERE {has('lower(searchable_text)', w)}"
    for s, w in TABLE_SPECIALTIES.items())
GAPS = f"""able AS MATERIALIZED ({SPECIALTY_ROWS}),
regions AS (SELECT address_state AS state, count(*) AS total,
    coalesce(round_even(avg(latitude), 4), 20.5) AS lat,
    coalesce(round_even(avg(longitude), 4), 78.9) AS lng
  FROM gold WHERE address_state IS NOT NULL GROUP BY 1),
counted AS (SELECT g.address_state AS state, a.specialty, count(*) AS n FROM able a
  JOIN gold g USING (facility_id) WHERE g.confidence IN ('high', 'medium') GROUP BY 1, 2),
grid AS (SELECT r.state, s.specialty, coalesce(c.n, 0) AS n, r.total, r.lat, r.lng
  FROM regions r CROSS JOIN (SELECT unnest({lst(list(TABLE_SPECIALTIES))}) AS specialty) s
  LEFT JOIN counted c ON c.state = r.state AND c.specialty = s.specialty),
severities AS (SELECT *, CASE WHEN n = 0 THEN 95 WHEN n / total::DOUBLE < 0.02 THEN 75
  WHEN n / total::DOUBLE < 0.05 THEN 45 ELSE 20 END AS severity FROM grid),
gaps AS MATERIALIZED (SELECT state, specialty, n AS facility_count, total AS total_facilities_state,
  round_even(n / total::DOUBLE, 4) AS coverage_ratio, severity::BIGINT AS desert_severity,
  CASE WHEN severity > 80 THEN 'critical' WHEN severity >= 60 THEN 'high'
    WHEN severity > 30 THEN 'medium' ELSE 'low' END AS severity_label,
  CASE WHEN severity > 80 THEN 'CRITICAL: ' ELSE '' END || state || ' has only ' || n::VARCHAR ||
    ' verified ' || specialty || ' facilities out of ' || total::VARCHAR || ' total.' AS action,
  lat AS centroid_lat, lng AS centroid_lng FROM severities),
summary AS MATERIALIZED (SELECT state, max(desert_severity) AS max_desert_severity,
  count(*) FILTER (WHERE severity_label = 'critical') AS critical_specialty_count,
  any_value(total_facilities_state) AS total_facilities, any_value(centroid_lat) AS centroid_lat,
  any_value(centroid_lng) AS centroid_lng,
  arg_max(severity_label, desert_severity) AS overall_severity_label FROM gaps GROUP BY 1)"""


def gap_check(name: str, select: str, extra: str = "") -> None:
    check(name, select, UP_TO_GOLD, GAPS + ("," + extra if extra else ""))


BY_GAP = "ORDER BY desert_severity DESC, state, specialty"
gap_check("gap_grid", "SELECT * FROM gaps WHERE specialty <> 'cardiology'")
gap_check("gaps_csv", """SELECT state, specialty, facility_count, coverage_ratio, action
  FROM gaps""")
gap_check("gap_critical_count", """SELECT count(*) FILTER (WHERE desert_severity > 80)
  AS critical_gaps FROM gaps""")
gap_check("state_summary", "SELECT * FROM summary")
gap_check("gaps_filtered", f"""
SELECT 'all' AS scope, * FROM (SELECT state, specialty, desert_severity, severity_label FROM gaps
  WHERE desert_severity >= 60 {BY_GAP} LIMIT 200)
UNION ALL SELECT 'state', * FROM (SELECT state, specialty, desert_severity, severity_label
  FROM gaps WHERE state = 'FRANCE')
UNION ALL SELECT 'specialty', * FROM (SELECT state, specialty, desert_severity, severity_label
  FROM gaps WHERE specialty = 'oncology')""")
gap_check("gaps_like", f"""SELECT state, specialty, desert_severity FROM gaps
  WHERE specialty LIKE '%dialysis%' OR specialty LIKE '%mental%' {BY_GAP} LIMIT 50""")
gap_check("worst_states", """SELECT state, max_desert_severity, critical_specialty_count
  FROM summary ORDER BY max_desert_severity DESC, state LIMIT 30""")
gap_check("gap_payload", f"""SELECT state, specialty, facility_count AS count,
  total_facilities_state AS total, severity_label AS severity, desert_severity AS score, action,
  centroid_lat AS lat, centroid_lng AS lng,
  count(*) FILTER (WHERE severity_label = 'critical') OVER () AS total_critical
  FROM (SELECT * FROM gaps WHERE desert_severity >= 60 {BY_GAP} LIMIT 200)""")
gap_check("gap_payload_states", """SELECT state, lower(overall_severity_label) AS severity,
  critical_specialty_count AS critical_count, total_facilities AS facilities,
  centroid_lat AS lat, centroid_lng AS lng FROM summary""")
gap_check("top_gaps_per_state", """SELECT state, rank, specialty, desert_severity,
  '#' || rank::VARCHAR || ' ' || action AS report FROM (SELECT *, row_number() OVER (
  PARTITION BY state ORDER BY desert_severity DESC, specialty) AS rank FROM gaps)
  WHERE rank <= 3""")
gap_check("critical_specialties", """SELECT state, coalesce(string_agg(specialty, ', ' ORDER BY
  specialty) FILTER (WHERE severity_label = 'critical'), 'none') AS critical_specialties
  FROM gaps GROUP BY 1""")
CARD_TAGS = """array_to_string(list_filter(['Desert: ' || upper(severity_label) ||
  CASE WHEN severity_label IN ('critical', 'high') THEN '!' ELSE '' END,
  CASE WHEN facility_count = 0 THEN 'Zero facilities!' END, specialty],
  lambda x : x IS NOT NULL), '|')"""
gap_check("gap_cards", f"""SELECT state || ' — ' || specialty AS name, state,
  'Desert Zone' AS facility_type, (100 - desert_severity)::DOUBLE AS trust_score,
  'high' AS confidence, action AS citation, {CARD_TAGS} AS tags,
  'NOT_VALIDATED' AS validation_verdict, desert_severity::DOUBLE AS desert_severity,
  centroid_lat AS latitude, centroid_lng AS longitude FROM gaps""")
LOOKUP = f"""questions AS ({derived.oracle_questions()}), {PATTERNS},
gap_questions AS (SELECT * FROM asked_patterns WHERE {GAP}),
looked AS MATERIALIZED (SELECT * FROM (
  SELECT q.query_id, row_number() OVER (PARTITION BY q.query_id {BY_GAP}) AS rank, g.*
  FROM gap_questions q, gaps g
  WHERE len(q.specialties) = 0 OR len(list_filter(q.specialties, lambda p :
    contains(g.specialty, p))) > 0) WHERE rank <= 50)"""
gap_check("gap_lookup", "SELECT query_id, rank, state, specialty, desert_severity FROM looked",
          LOOKUP)
GAP_ANSWERS = """SELECT q.query_id, count(l.rank) AS gaps,
  CASE WHEN count(l.rank) = 0 THEN 'No medical desert data found for your query. ' ||
    'The desert analysis table may not have data for this specialty.'
  ELSE 'Found ' || count(l.rank)::VARCHAR || ' state-specialty gaps in our desert analysis. ' ||
    'Most underserved states for ' || arg_min(l.specialty, l.rank) || ': ' || (
      SELECT string_agg(state, ', ' ORDER BY first) FROM (SELECT state, min(rank) AS first
        FROM looked k WHERE k.query_id = q.query_id AND k.rank <= 8 GROUP BY 1
        ORDER BY 2 LIMIT 5)) || '. ' ||
    (count(*) FILTER (WHERE l.severity_label = 'critical'))::VARCHAR ||
    ' zone(s) classified as CRITICAL — meaning fewer than 10% of expected facilities are present.'
  END AS answer
  FROM gap_questions q LEFT JOIN looked l ON l.query_id = q.query_id GROUP BY q.query_id"""
gap_check("gap_answers", GAP_ANSWERS, LOOKUP)

# --- user questions by both routes -----------------------------------------------------------
BY_ROUTE = LOOKUP.replace(f"questions AS ({derived.oracle_questions()})", f"""questions AS (
  SELECT * REPLACE ({UI_QUERY} AS query), query AS said FROM ({derived.oracle_questions()})
  WHERE length(trim(query)) >= 3)""") + ",\n" + ANSWERS.replace(f"asked0 AS ({asked_sql()})", f"""
asked0 AS (SELECT * EXCLUDE (min_trust_score, effective_trust),
    effective_trust AS min_trust_score, NULL::DOUBLE AS min_doctors
  FROM ({parsed_select('specialties', f"(SELECT * FROM asked_patterns WHERE NOT {GAP})", ", query, said")}))""")
gap_check("question_cards", f"""SELECT 'search' AS route, c.*, t.tags FROM ({CARDS}) c
  JOIN (SELECT query_id, rank, {joined(TAGS)} AS tags FROM shown) t USING (query_id, rank)
  UNION ALL BY NAME SELECT 'gap' AS route, query_id, rank, state || ' — ' || specialty AS name,
  state AS location, (100 - desert_severity)::DOUBLE AS trust, 'Desert Zone' AS type,
  {CARD_TAGS} AS tags, substring(action, 1, 200) AS citation, NULL::VARCHAR AS phone,
  NULL::VARCHAR AS pin_code, centroid_lat AS latitude, centroid_lng AS longitude,
  '' AS validation_note, '' AS correction_note, '' AS source_text FROM looked""", BY_ROUTE)
gap_check("question_answers", f"""SELECT 'search' AS route, s.*, t.* EXCLUDE (query_id)
  FROM ({SUMMARY}) s JOIN ({TRACE.replace('a.query)', 'a.said)').replace('a.query,', 'a.said,')}) t USING (query_id)
  UNION ALL BY NAME SELECT 'gap' AS route, query_id, gaps AS total_found, answer,
  gaps AS candidates, 0.0::DOUBLE AS avg_trust, 0::BIGINT AS verified, 0::BIGINT AS disputed,
  0::BIGINT AS self_corrected, 0::BIGINT AS tokens FROM ({GAP_ANSWERS})""", BY_ROUTE)
gap_check("pin_gaps", f"""SELECT p.address_zip, p.address_city, s.specialty,
  coalesce(c.n, 0) AS facility_count, p.total AS total_facilities
  FROM (SELECT address_zip, address_city, count(*) AS total FROM gold
    WHERE address_zip IS NOT NULL GROUP BY 1, 2) p
  CROSS JOIN (SELECT unnest({lst(SPECIALTIES)}) AS specialty) s
  LEFT JOIN (SELECT address_zip, address_city, specialty, count(*) AS n FROM able
    JOIN gold USING (facility_id) WHERE confidence <> 'low' GROUP BY 1, 2, 3) c
  ON c.address_zip = p.address_zip AND c.address_city = p.address_city
    AND c.specialty = s.specialty""")

# --- distance ------------------------------------------------------------------------------
PLACES = """places AS (SELECT facility_id, latitude, longitude FROM gold
  WHERE latitude IS NOT NULL AND longitude IS NOT NULL),
kinds AS (SELECT DISTINCT specialty FROM able),
held AS (SELECT a.specialty, p.* FROM able a JOIN places p USING (facility_id))"""
ONE_KM = km("p.latitude", "p.longitude", "h.latitude", "h.longitude")
gap_check("nearest_capable", f"""SELECT p.facility_id, k.specialty,
  min(round_even({ONE_KM}, 3)) AS nearest_km
  FROM places p CROSS JOIN (SELECT unnest({lst(SPECIALTIES)}) AS specialty) k
  LEFT JOIN held h ON h.specialty = k.specialty AND h.facility_id <> p.facility_id
  GROUP BY 1, 2""", PLACES)
gap_check("radius_counts", f"""SELECT p.facility_id, k.specialty,
  count(*) FILTER (WHERE h.facility_id IS NOT NULL AND {ONE_KM} <= 50) AS within_50km,
  count(*) FILTER (WHERE h.facility_id IS NOT NULL AND {ONE_KM} <= 100) AS within_100km
  FROM places p CROSS JOIN (SELECT unnest({lst(SPECIALTIES)}) AS specialty) k
  LEFT JOIN held h ON h.specialty = k.specialty AND h.facility_id <> p.facility_id
  GROUP BY 1, 2""", PLACES)
PINS = PLACES + f""",
pin_points AS (SELECT address_state, address_zip, round_even(avg(latitude), 4) AS latitude,
    round_even(avg(longitude), 4) AS longitude FROM gold
  WHERE address_state IS NOT NULL AND address_zip IS NOT NULL GROUP BY 1, 2),
seen AS (SELECT p.address_state, p.address_zip, k.specialty, count(h.facility_id) AS capable,
    sum(round(h.trust_score * 10))::DOUBLE / 10 / nullif(count(h.facility_id), 0) AS mean_trust
  FROM pin_points p CROSS JOIN (SELECT unnest({lst(SPECIALTIES)}) AS specialty) k
  LEFT JOIN (SELECT held.*, trust_score FROM held JOIN gold USING (facility_id)
    WHERE confidence <> 'low') h ON h.specialty = k.specialty AND {ONE_KM} <= 50
  WHERE p.latitude IS NOT NULL GROUP BY 1, 2, 3),
pins AS MATERIALIZED (SELECT address_state, address_zip, specialty, capable, (CASE
  WHEN capable = 0 THEN 95 WHEN capable = 1 AND mean_trust < 40 THEN 75 WHEN capable = 1 THEN 60
  WHEN mean_trust >= 70 THEN 20 ELSE 45 END)::BIGINT AS severity FROM seen)"""
gap_check("distance_severity", "SELECT * FROM pins", PINS)
gap_check("rollup_severity", """SELECT address_state, address_zip, max(severity) AS max_severity,
  round_even(avg(severity), 4) AS mean_severity,
  CASE WHEN grouping(address_state) = 1 THEN 3 WHEN grouping(address_zip) = 1 THEN 1 ELSE 0 END
    ::BIGINT AS level FROM pins GROUP BY ROLLUP (address_state, address_zip)""", PINS)

# --- dashboard -----------------------------------------------------------------------------
PAIRS = "FROM gold g JOIN gold s ON g.name = s.name WHERE g.trust_score IS NOT NULL"
check("overview_stats", f"""SELECT count(*) AS total_facilities,
  count(*) FILTER (WHERE g.trust_score >= 80) AS high_trust_count,
  count(*) FILTER (WHERE g.trust_score >= 60) AS medium_plus_count,
  round(avg(g.trust_score), 1) AS avg_trust_score,
  count(*) FILTER (WHERE g.has_icu) AS icu_confirmed,
  count(*) FILTER (WHERE g.has_emergency) AS emergency_confirmed,
  count(*) FILTER (WHERE g.confidence = 'high') AS high_confidence,
  count(DISTINCT s.address_state) AS states_covered {PAIRS}""", UP_TO_GOLD)
ALL_POINTS = f"""all_points AS (SELECT g.facility_id AS gold_id, s.facility_id AS silver_id,
  g.name, s.address_state AS state, s.address_city AS city, s.facility_type AS type,
  s.latitude AS lat, s.longitude AS lng, g.trust_score AS trust, g.confidence,
  list_slice(s.specialty_list, 1, 4) AS specialties, coalesce(g.has_icu, false) AS has_icu,
  coalesce(g.has_emergency, false) AS has_emergency, coalesce(g.has_24_7, false) AS has_24_7,
  list_slice(g.capabilities, 1, 3) AS capabilities,
  coalesce(g.capabilities[1], 'No capabilities extracted') AS citation,
  len(g.contradictions) > 0 AS has_contradiction {PAIRS}
  AND s.latitude IS NOT NULL AND s.longitude IS NOT NULL)"""
FIRST_POINTS = "ORDER BY trust DESC, gold_id, silver_id LIMIT 2000"
POINTS = f"{ALL_POINTS},\npoints AS MATERIALIZED (SELECT * FROM all_points {FIRST_POINTS})"
check("map_points", f"""SELECT * EXCLUDE (specialties, capabilities),
  {joined('specialties')} AS specialties, {joined('capabilities')} AS capabilities FROM points""",
      UP_TO_GOLD, POINTS)
TEXT = ("lower(concat_ws(' ', array_to_string(specialties, ' '), "
        "array_to_string(capabilities, ' '), citation, name))")
check("map_filter", f"""SELECT gold_id, silver_id, trust FROM all_points WHERE trust >= 40 AND
  {has(TEXT, vocab.MAP_GROUPS['Emergency Trauma'])} {FIRST_POINTS}""", UP_TO_GOLD, ALL_POINTS)
check("map_filter_summary", f"""SELECT count(*) AS visible,
  coalesce((sum(round(trust * 10)::BIGINT) + 5 * count(*)) // (10 * count(*)), 0)::BIGINT AS avg_trust,
  count(*) FILTER (WHERE trust >= 70) AS high_trust FROM all_points
  WHERE trust >= 30 AND {has(TEXT, ['oncology', 'cancer'])}""", UP_TO_GOLD, ALL_POINTS)
check("facility_profiles", f"""SELECT g.name, coalesce(facility_type, '') AS facility_type,
  coalesce(address_state, '') AS state, coalesce(address_city, '') AS city,
  coalesce(address_zip, '') AS pin_code, coalesce(latitude, 0.0) AS latitude,
  coalesce(longitude, 0.0) AS longitude, coalesce(description, '') AS description,
  {joined('specialty_list')} AS specialties, trust_score, confidence AS confidence_level,
  {joined('capabilities')} AS extracted_capabilities,
  {joined('extracted_equipment')} AS extracted_equipment, inferred_doctors AS doctor_count,
  beds AS extracted_bed_count, {joined('contradictions')} AS contradictions, data_completeness,
  t_completeness AS trust_completeness, t_consistency AS trust_consistency,
  t_verifiability AS trust_verifiability, t_recency AS trust_recency, t_digital AS trust_digital,
  inferred_doctors AS staff_doctors, has_icu, has_emergency, has_24_7,
  coalesce(officialPhone, '') AS phone, coalesce(officialWebsite, '') AS website,
  CASE WHEN email IS NULL OR email IN ('nan', 'None', 'NaT') THEN '' ELSE email END AS email,
  coalesce(address_line1, '') AS address_line,
  coalesce(lower(trim(operatorTypeId)), '') AS operator_type,
  coalesce(yearEstablished, '') AS year_established
  FROM gold g JOIN (SELECT name, min(facility_id) AS facility_id FROM gold GROUP BY 1) f
    ON g.facility_id = f.facility_id
  WHERE g.name IN (SELECT name FROM gold WHERE trust_score >= 70)""", UP_TO_GOLD)
gap_check("state_breakdown", """SELECT state, upper(overall_severity_label) AS severity,
  critical_specialty_count AS critical_count,
  least(100.0::DOUBLE, critical_specialty_count / 8.0::DOUBLE * 100) AS share FROM summary
  ORDER BY list_position(['critical', 'high', 'medium', 'low'], overall_severity_label), state
  LIMIT 8""")
gap_check("top_gaps", f"SELECT state, specialty, desert_severity FROM gaps {BY_GAP} LIMIT 6")
gap_check("batch_summary", """SELECT count(*) AS enriched, round(avg(trust_score), 1) AS mean_trust,
  count(*) FILTER (WHERE trust_score >= 70) AS high_trust,
  count(*) FILTER (WHERE trust_score < 30) AS low_trust,
  count(*) FILTER (WHERE extraction_error IS NOT NULL) AS failures,
  count(*) FILTER (WHERE has_text) AS with_text,
  count(*) FILTER (WHERE NOT has_text) AS without_text,
  (SELECT count(*) FROM gaps WHERE desert_severity > 80) AS critical_gaps FROM gold""")
check("icu_warning", """SELECT facility_id, CASE WHEN coalesce(has_icu, false) THEN NULL
  WHEN list_contains(specialty_list, 'ICU') THEN 'Claims ICU no evidence'
  WHEN len(specialty_list) = 0 THEN 'No data' END AS warning FROM gold""", UP_TO_GOLD)
gap_check("map_clusters", """SELECT state, centroid_lat, centroid_lng,
  CASE WHEN total_facilities > 999 THEN floor(total_facilities / 1000 + 0.5)::BIGINT::VARCHAR || 'K'
    ELSE total_facilities::VARCHAR END AS count_label,
  upper(overall_severity_label) AS severity, critical_specialty_count AS critical_count
  FROM summary""")
