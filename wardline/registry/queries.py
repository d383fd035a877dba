"""Registered queries: one callable (spark, sf_dir) -> DataFrame per operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from wardline.functions import columns as X, vocab
from wardline.operators import (claims, gaps, geo, gold as G, intents, present, search,
                                silver as S, stats, stored, trust, validate, vector)
from wardline.operators.pairs import name_fanout, name_pairs
from wardline.plans.answers import answer_batch, answer_questions
from wardline.registry.asked import TABLE_SPECIALTIES, asked
from wardline.sources import collection, derived, layers, readers, sinks

SPECIALTIES = list(vocab.GAP_SPECIALTIES)
QUERIES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def plain(df: DataFrame) -> DataFrame:
    """Text lists joined by | and whole numbers as bigint, for comparison across engines."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, ArrayType) and isinstance(f.dataType.elementType, StringType):
            c = F.array_join(c, "|").alias(f.name)
        elif isinstance(f.dataType, IntegerType):
            c = c.cast("bigint").alias(f.name)
        out.append(c)
    return df.select(*out)


# --- inputs ------------------------------------------------------------------------------

def raw(spark, sf):
    return derived.facilities(spark, sf)


def silver(spark, sf):
    return S.clean_silver(raw(spark, sf))


def claimed(spark, sf):
    return claims.with_claims(silver(spark, sf))


def gold(spark, sf):
    """The stored gold layer, as the search and dashboard queries read it."""
    return layers.stored(spark, f"gold:{sf}", lambda: G.build_gold(S.clean_silver(
        derived.facilities(spark, sf, small_tasks=True))))


def gap_table(spark, sf):
    return layers.stored(spark, f"gaps:{sf}", lambda: gaps.gap_grid(
        gold(spark, sf), TABLE_SPECIALTIES))


def flags(spark, sf):
    """Specialty flags and positions without the texts: the texts are searched once."""
    return layers.stored(spark, f"flags:{sf}", lambda: gaps.specialty_match(gold(spark, sf)).select(
        "facility_id", "address_state", "address_zip", "latitude", "longitude", "confidence",
        "trust_score", *[f"is_{s}" for s in SPECIALTIES]))


def search_index(spark, sf):
    """The stored inverted index of gold and silver, as all searches read it."""
    g = gold(spark, sf)
    return search.open_index(spark, layers.folder(
        spark, f"index:{sf}", lambda path: search.build_index(g, search.silver_view(g), path)))


def questions(spark, sf):
    return derived.questions(spark, sf)


def answers(spark, sf):
    g = gold(spark, sf)
    return layers.stored(spark, f"answers:{sf}", lambda: answer_batch(
        g, search.silver_view(g), asked(spark), 10, search_index(spark, sf)))


# --- cleaning ----------------------------------------------------------------------------

@query
def parse_lists(spark, sf):
    return plain(raw(spark, sf).select("facility_id", *[
        X.parse_list(F.col(c)).alias(f"{c}_list") for c in vocab.LIST_FIELDS]))


@query
def completeness(spark, sf):
    return silver(spark, sf).select("facility_id", "data_completeness", "has_text")


@query
def normal_enums(spark, sf):
    return silver(spark, sf).groupBy(F.col("facilityTypeId").alias("facility_type")).agg(
        F.count(F.lit(1)).alias("n"))


@query
def numeric_fields(spark, sf):
    return silver(spark, sf).select("facility_id", F.col("numberDoctors").alias("number_doctors"),
                                    "capacity")


@query
def missing_fields(spark, sf):
    return plain(S.with_missing_fields(silver(spark, sf)).select(
        "facility_id", "missing_fields", "completeness_class"))


@query
def clean_silver(spark, sf):
    return plain(silver(spark, sf).select(
        "facility_id", "name", F.col("facilityTypeId").alias("facility_type"),
        F.col("numberDoctors").alias("number_doctors"), "capacity", "latitude", "longitude",
        *[f"{c}_parsed" for c in vocab.LIST_FIELDS], "data_completeness", "has_text"))


@query
def fill_region(spark, sf):
    return geo.fill_region(silver(spark, sf)).select("facility_id", "address_state", "address_zip")


@query
def specialty_labels(spark, sf):
    return plain(S.with_specialty_labels(silver(spark, sf)).select(
        "facility_id", "specialty_labels", "specialty_categories"))


@query
def null_safe_casts(spark, sf):
    return raw(spark, sf).select(
        "facility_id", S.null_safe_int(F.col("numberDoctors")).alias("doctors_int"),
        S.null_safe_float(F.col("latitude"), vocab.DEFAULT_LAT).alias("lat_float"),
        S.null_safe_string(F.col("address_state"), "unknown").alias("state_text"))


@query
def mean_completeness(spark, sf):
    return S.mean_completeness(silver(spark, sf))


@query
def quality_report(spark, sf):
    return S.quality_report(raw(spark, sf))


@query
def coordinate_bounds(spark, sf):
    return S.coordinate_bounds(silver(spark, sf))


# --- sources and sinks -------------------------------------------------------------------

RAW_TEXT = ["name", "address_state", "address_city", "facilityTypeId", "specialties",
            "description"]


@query
def read_csv_with_ids(spark, sf):
    path = layers.scratch_path(spark, "raw_csv")
    sinks.write_csv(raw(spark, sf).orderBy(F.length("facility_id"), "facility_id")
                    .select(*RAW_TEXT), path)
    back = readers.read_facilities(spark, path, schema=", ".join(f"{c} string" for c in RAW_TEXT))
    return back.select("facility_id", "name", "address_state", "address_city", "specialties",
                       F.md5("description").alias("description_md5"))


@query
def silver_layer(spark, sf):
    path = layers.scratch_path(spark, "silver")
    sinks.write_layer(silver(spark, sf), path, partition_by="address_state")
    back = readers.read_layer(spark, path, ["facility_id", "address_state", "data_completeness"])
    return back.groupBy("address_state").agg(
        F.count(F.lit(1)).alias("n"), F.bround(F.avg("data_completeness"), 4).alias("mean"))


@query
def gold_csv(spark, sf):
    path = layers.scratch_path(spark, "gold_csv")
    sinks.write_csv(gold(spark, sf).select(
        "facility_id", "name", "trust_score", "contradictions", "specialties", "confidence"), path)
    return spark.read.option("header", True).option("escape", '"').csv(path) \
        .withColumn("trust_score", F.col("trust_score").cast("double"))


@query
def gaps_csv(spark, sf):
    path = layers.scratch_path(spark, "gaps_csv")
    sinks.write_csv(gaps.gap_sort(gap_table(spark, sf)), path)
    return spark.read.option("header", True).csv(path).select(
        "state", "specialty", F.col("facility_count").cast("bigint").alias("facility_count"),
        F.col("coverage_ratio").cast("double").alias("coverage_ratio"), "action")


@query
def failures_csv(spark, sf):
    path = layers.scratch_path(spark, "failures")
    _, failed = claims.split_failures(gold(spark, sf))
    if not sinks.write_failures(failed, path):
        return failed
    return spark.read.option("header", True).csv(path)


FEATURE = """type string, geometry struct<type: string, coordinates: array<double>>,
 properties struct<id: string, name: string, city: string, state: string, type: string,
 trust_score: double, specialties: array<string>, has_icu: boolean, has_emergency: boolean>"""


@query
def geojson_features(spark, sf):
    path = layers.scratch_path(spark, "features")
    sinks.write_geojson(gold(spark, sf), path)
    return plain(spark.read.text(path).select(F.from_json("value", FEATURE).alias("f")).select(
        F.col("f.geometry.coordinates")[0].alias("lng"),
        F.col("f.geometry.coordinates")[1].alias("lat"), "f.properties.*"))


@query
def geojson_collection(spark, sf):
    """The written parts by kind of line and state, with the sums of what the features hold."""
    path = layers.scratch_path(spark, "collection")
    sinks.write_feature_collection(gold(spark, sf), path)
    line, f = F.col("value"), F.from_json("value", FEATURE)
    kind = (F.when(line == collection.HEADER, "header").when(line == collection.SEPARATOR, "separator")
            .when(line == collection.FOOTER, "footer").otherwise(f.getField("type")))
    properties, at = F.col("f.properties"), F.col("f.geometry.coordinates")
    return spark.read.text(path).select(kind.alias("kind"), F.when(kind == "Feature", f).alias("f")).groupBy(
        "kind", properties.getField("state").alias("state")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.round(properties.getField("trust_score") * 10).cast("bigint")).alias("trust_tenths"),
        F.sum(F.round(at[1] * 100).cast("bigint")).alias("lat_hundredths"),
        F.sum(F.length(properties.getField("id")).cast("bigint")).alias("id_chars"))


# --- claims ------------------------------------------------------------------------------

@query
def claim_flags(spark, sf):
    return claimed(spark, sf).select("facility_id", *vocab.CLAIMS, "icu_beds", "inferred_doctors")


@query
def claim_lists(spark, sf):
    return plain(claimed(spark, sf).select(
        "facility_id", "extracted_equipment", "extracted_procedures", "operational_notes"))


@query
def confidence_grade(spark, sf):
    return claimed(spark, sf).select("facility_id", "confidence",
                                     F.col("evidence_fields").cast("bigint")
                                     .alias("evidence_fields"))


@query
def bed_mentions(spark, sf):
    return raw(spark, sf).select("facility_id", claims.bed_mentions(
        F.concat_ws(" ", "description", "capability")).alias("max_beds"))


@query
def model_reply_json(spark, sf):
    parsed = claims.parse_model_json(F.col("model_reply"))
    return raw(spark, sf).select(
        "facility_id", parsed.getField("has_icu").alias("has_icu"),
        parsed.getField("has_24_7").alias("has_24_7"),
        claims.reply_error(F.col("model_reply")).alias("error"))


@query
def event_props_json(spark, sf):
    k = claims.parse_model_json(F.col("props"), "k: bigint").getField("k")
    return derived.table(spark, sf, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count(k).alias("parsed"), F.sum(k).alias("sum_k"))


@query
def display_specialties(spark, sf):
    text = F.concat_ws(" | ", "address_city", "name", "address_zip", "address_state", "facility_id")
    return plain(raw(spark, sf).select(
        "facility_id", claims.specialties_display(text).alias("shown")))


@query
def text_routes(spark, sf):
    with_text, without = G.split_by_text(silver(spark, sf))
    a = G.build_gold(with_text).select("facility_id", "confidence", "trust_score")
    b = G.build_gold(without).select("facility_id", "confidence", "trust_score")
    return a.withColumn("route", F.lit("text")).unionByName(
        b.withColumn("route", F.lit("trust only")), allowMissingColumns=True)


@query
def extraction_failures(spark, sf):
    return claims.split_failures(claimed(spark, sf))[1]


@query
def typed_records(spark, sf):
    fields = {"facility_id": "string", "name": "string", "capacity": "int",
              "numberDoctors": "int", "social_count": "bigint", "latitude": "double",
              "recency_of_page_update": "date"}
    cast = claims.validated_record(fields, {"capacity": 0, "social_count": 0, "latitude": 0.0})
    return plain(raw(spark, sf).select(*cast).withColumnsRenamed(
        {"numberDoctors": "number_doctors", "recency_of_page_update": "updated"})
        .withColumn("updated", F.col("updated").cast("string")))


@query
def evidence_sentences(spark, sf):
    return claims.evidence_sentence(silver(spark, sf))


@query
def build_gold(spark, sf):
    return plain(G.build_gold(silver(spark, sf)).select(
        "facility_id", "name", "address_state", "address_city", "facility_type", "has_icu",
        "has_24_7", "confidence", "capabilities", "contradictions", "trust_score",
        *[F.col(f"trust.{p}").alias(f"trust_{p}") for p in
          ("completeness", "consistency", "verifiability", "recency", "digital")],
        "source_field", "source_sentence", "operational_notes", "extraction_error", "bed_count"))


@query
def contradicting_evidence(spark, sf):
    return trust.contradicting_evidence(claimed(spark, sf))


# --- trust -------------------------------------------------------------------------------

@query
def trust_parts(spark, sf):
    return trust.with_trust(claimed(spark, sf)).select("facility_id", "trust.*", "trust_score")


@query
def trust_rules(spark, sf):
    return plain(gold(spark, sf).where(F.size("contradictions") > 0)
                 .select("facility_id", "contradictions"))


@query
def trust_rule_one_doctor(spark, sf):
    return plain(trust.with_trust(claimed(spark, sf), one_doctor_24_7=True).select(
        "facility_id", F.size("contradictions").alias("fired"),
        F.col("trust.consistency").alias("consistency"), "trust_score"))


@query
def trust_recency_decay(spark, sf):
    return raw(spark, sf).select("facility_id", trust.recency_decay("2025-02-01").alias("decay"))


@query
def trust_verifiability_ratio(spark, sf):
    return trust.with_verifiability_ratio(claimed(spark, sf)).select(
        "facility_id", "verifiability")


@query
def trust_bands(spark, sf):
    t = F.col("trust_score")
    return gold(spark, sf).groupBy(
        X.trust_band(t).alias("band"), X.trust_band(t, 80, 60).alias("strict_band")).agg(
        F.count(F.lit(1)).alias("n"))


@query
def trust_display(spark, sf):
    return answers(spark, sf).select("query_id", F.col("rank").cast("bigint").alias("rank"),
                                     "trust_score", "trust_score_display", "trust_score_warning")


@query
def trust_distribution(spark, sf):
    return trust.trust_distribution(gold(spark, sf))


@query
def low_trust_critical(spark, sf):
    return trust.low_trust_critical(gold(spark, sf)).select("facility_id", "trust_score")


# --- search ------------------------------------------------------------------------------

@query
def searchable_text(spark, sf):
    return claimed(spark, sf).select(
        "facility_id", F.md5(G.searchable_text()).alias("text_md5"),
        F.length(G.searchable_text()).cast("bigint").alias("chars"))


@query
def single_filters(spark, sf):
    g = gold(spark, sf)
    tests = {
        "state": search.filter_state("BRA"), "city": search.filter_city("_C1"),
        "type": search.filter_type("clinic"), "min_trust": search.filter_min_trust(50),
        "no_trust": search.filter_min_trust(0), "icu": search.filter_flag("has_icu"),
        "emergency": search.filter_flag("has_emergency"),
        "dialysis": search.filter_dialysis(), "open_24_7": search.filter_flag("has_24_7"),
        "contradictions": search.filter_contradictions(),
        "min_doctors": search.filter_min_doctors(5),
    }
    wide = g.agg(*[F.count_if(t).alias(n) for n, t in tests.items()])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("filter"), F.col(n).alias("n")) for n in tests])))


@query
def query_terms(spark, sf):
    q = questions(spark, sf)
    return plain(q.select("query_id", intents.query_terms(
        F.col("query"), intents.specialty_filters(F.col("query"))).alias("terms")))


@query
def relevance_score(spark, sf):
    terms = intents.literal_words(["icu", "surgery", "ventilator", "the", "nephrology"])
    return plain(gold(spark, sf).select(
        "facility_id", search.relevance_score(terms).alias("relevance")).where("relevance > 0"))


@query
def name_join(spark, sf):
    g = gold(spark, sf)
    return name_fanout(g, search.silver_view(g))


@query
def name_join_stored(spark, sf):
    """The name join over two tables bucketed by name: pairs, best trust and trust over pairs."""
    g = gold(spark, sf)
    tables = {}
    for side, df in (("gold", g.select("name", "trust_score")), ("silver", search.silver_view(g)
                                                                  .select("name", "address_state"))):
        path = layers.scratch_path(spark, f"by_name_{side}")
        tables[side] = path.rsplit("/", 1)[1].replace("-", "_")
        sinks.write_by_name(df, tables[side], path, 64)
    return name_pairs(spark.table(tables["gold"]), spark.table(tables["silver"]))


@query
def stored_records(spark, sf):
    """Gold written with its nested columns as JSON text, and read back."""
    path = layers.scratch_path(spark, "json_text")
    sinks.write_layer(stored.write_form(gold(spark, sf)), path)
    back = stored.read_form(readers.read_layer(spark, path))
    return plain(back.select(
        "facility_id", *stored.FLAGS, "capabilities", "inferred_doctors", "contradictions",
        "confidence", "bed_count", *[F.col(f"trust.{p}").alias(f"trust_{p}") for p in stored.PARTS]))


@query
def stored_filters(spark, sf):
    """Flag filters on the stored object as JSON text, as a struct and as a VARIANT."""
    text = stored.write_form(gold(spark, sf)).select("extracted_availability")
    forms = {"text": text, "struct": gold(spark, sf).select(
        F.struct(*stored.FLAGS).alias("extracted_availability")),
        "variant": text.select(F.try_parse_json("extracted_availability").alias("extracted_availability"))}
    out = None
    for form, df in forms.items():
        n = df.agg(*[F.count_if(stored.filter_flag(df, "extracted_availability", c)).alias(c)
                     for c in stored.FLAGS]).select(F.lit(form).alias("form"), "*")
        out = n if out is None else out.unionByName(n)
    return out


@query
def stored_lists(spark, sf):
    """Specialties and contradictions shown from text columns and from array columns."""
    lists = gold(spark, sf).select("facility_id", "specialties", "contradictions")
    texts = lists.select("facility_id", F.array_join("specialties", " | ").alias("specialties"),
                         F.to_json("contradictions").alias("contradictions"))
    forms = [df.select("facility_id", F.lit(form).alias("form"),
                       stored.shown_specialties(df).alias("specialties"),
                       stored.contradictions(df).alias("contradictions"))
             for form, df in (("array", lists), ("text", texts))]
    return plain(forms[0].unionByName(forms[1]))


@query
def search_batch(spark, sf):
    g = gold(spark, sf)
    return plain(search.hybrid_search(g, search.silver_view(g), asked(spark), 20,
                                      index=search_index(spark, sf)))


@query
def vector_top_k(spark, sf):
    v = derived.table(spark, sf, "embeddings")
    return plain(vector.vector_top_k(vector.exemplars(v), v, 50))


@query
def vector_cells_top_k(spark, sf):
    v = derived.table(spark, sf, "embeddings")
    return plain(vector.search_cells(vector.exemplars(v), vector.build_cells(v), 50))


@query
def vector_top_k_filtered(spark, sf):
    v = derived.table(spark, sf, "embeddings")
    return plain(vector.vector_top_k(vector.exemplars(v), v, 10, where=F.col("label") >= 5))


@query
def distance_to_reference(spark, sf):
    return geo.distance_to_reference(gold(spark, sf), 28.61, 77.21).select(
        "facility_id", "distance_km")


@query
def gap_intent(spark, sf):
    return questions(spark, sf).select(
        "query_id", intents.is_gap_query(F.col("query")).alias("is_gap"))


@query
def specialty_intent(spark, sf):
    return plain(questions(spark, sf).select(
        "query_id", intents.specialty_filters(F.col("query")).alias("patterns")))


@query
def needs_translation(spark, sf):
    return questions(spark, sf).select("query_id", intents.needs_translation(
        F.col("query"), F.col("language")).alias("translate"))


@query
def ui_filters(spark, sf):
    return intents.apply_ui_filters(questions(spark, sf)).select("query_id", "query")


@query
def query_routes(spark, sf):
    return intents.route_queries(questions(spark, sf)).groupBy("route").agg(
        F.count(F.lit(1)).alias("n"), F.min("query_id").alias("first_id"))


@query
def parse_queries(spark, sf):
    parsed = intents.parse_queries(questions(spark, sf), gold(spark, sf))
    return plain(parsed.select(
        "query_id", "state", "city", "facility_type", "specialties", "requires_icu",
        "requires_emergency", "requires_24_7", "requires_dialysis", "requires_contradictions",
        "min_trust_score", "search_text",
        intents.effective_min_trust(F.col("ui_min_trust"), F.col("min_trust_score"))
        .alias("effective_trust")))


@query
def min_doctors(spark, sf):
    return gold(spark, sf).where(search.filter_min_doctors(5)).select(
        "facility_id", "number_doctors", "inferred_doctors")


# --- results -----------------------------------------------------------------------------

def found(spark, sf):
    g = gold(spark, sf)
    s = search.silver_view(g)
    return search.with_details(search.hybrid_search(
        g, s, asked(spark), 10, index=search_index(spark, sf)), g, s)


@query
def format_results(spark, sf):
    return plain(present.format_results(found(spark, sf)).drop("trust_breakdown"))


@query
def result_tags(spark, sf):
    tags = F.transform("tags", lambda t: F.concat(
        t.getField("label"), F.when(t.getField("warn"), "!").otherwise("")))
    return plain(present.result_cards(answers(spark, sf)).select(
        "query_id", "rank", tags.alias("tags")))


@query
def result_cards(spark, sf):
    return plain(present.result_cards(answers(spark, sf)).drop("tags", "trust_breakdown"))


@query
def answer_summary(spark, sf):
    return present.answer_summary(asked(spark), answers(spark, sf))


@query
def query_trace(spark, sf):
    return present.query_trace(asked(spark), answers(spark, sf))


def answered_questions(spark, sf):
    """The folder of the cards and answers of all user questions."""
    def build(path):
        g = gold(spark, sf)
        out = answer_questions(g, search.silver_view(g), gap_table(spark, sf), questions(spark, sf), 10)
        out.cards.write.parquet(f"{path}/cards")
        out.answers.write.parquet(f"{path}/answers")
    return layers.folder(spark, f"questions:{sf}", build)


@query
def question_cards(spark, sf):
    cards = spark.read.parquet(f"{answered_questions(spark, sf)}/cards")
    return plain(cards.withColumn("tags", F.transform("tags", lambda t: F.concat(
        t.getField("label"), F.when(t.getField("warn"), "!").otherwise(""))))
        .drop("question", "trust_breakdown"))


@query
def question_answers(spark, sf):
    return plain(spark.read.parquet(f"{answered_questions(spark, sf)}/answers").drop("question"))


@query
def contradiction_text(spark, sf):
    return plain(raw(spark, sf).select("facility_id", present.coerce_contradictions(
        F.col("equipment")).alias("contradictions")))


# --- validation --------------------------------------------------------------------------

@query
def standards_check(spark, sf):
    return validate.standards_long(validate.with_standards_check(
        gold(spark, sf), present.source_snippet(None)))


@query
def failed_claims(spark, sf):
    checked = validate.with_standards_check(gold(spark, sf), present.source_snippet(None))
    return plain(checked.select(
        "facility_id", validate.failed_claims(F.col("standards_check")).alias("failed"))
        .where(F.size("failed") > 0))


@query
def validate_top(spark, sf):
    return plain(validate.validate_top(present.format_results(found(spark, sf), chars=None)))


@query
def answer_rows(spark, sf):
    g = gold(spark, sf)
    rows = answer_batch(g, search.silver_view(g), asked(spark), 10, search_index(spark, sf))
    return plain(rows.select(
        "query_id", "rank", "name", "validation_verdict", "validation_note", "icu_verified",
        "emergency_verified", "availability_verified", "self_corrected", "correction_note",
        "has_icu", "has_emergency", "has_24_7", "confidence", "citation", "key_capabilities",
        "trust_score_display", "total_found"))


@query
def verdict_counts(spark, sf):
    return validate.verdict_counts(answers(spark, sf))


@query
def stratified_sample(spark, sf):
    return validate.stratified_sample(gold(spark, sf)).select("facility_id", "band")


def second_opinion(spark, sf):
    """Gold with the second reader's claims, where the labels table covers the record."""
    labels = derived.table(spark, sf, "labels").select(
        F.format_string("%05d", "doc_id").alias("facility_id"),
        F.when(F.col("quality") == 1, True).alias("validator_has_icu"),
        F.when(F.col("toxic") == 1, True).alias("validator_has_surgery"))
    return validate.stratified_sample(gold(spark, sf)).join(labels, "facility_id", "left")


@query
def agreement_records(spark, sf):
    return validate.agreement(second_opinion(spark, sf), ["has_icu", "has_surgery"]).select(
        "facility_id", "agreement", "needs_review")


@query
def agreement_rate(spark, sf):
    return validate.agreement_rate(second_opinion(spark, sf), ["has_icu", "has_surgery"])


@query
def bootstrap_interval(spark, sf):
    return validate.bootstrap_interval(gold(spark, sf), "has_icu")


# --- gaps --------------------------------------------------------------------------------

@query
def specialty_match(spark, sf):
    g = gaps.specialty_match(gold(spark, sf))
    return g.select("facility_id", *[f"is_{s}" for s in SPECIALTIES])


@query
def gap_grid(spark, sf):
    built = G.build_gold(silver(spark, sf))
    return plain(gaps.gap_grid(built))


@query
def gap_critical_count(spark, sf):
    return gaps.critical_count(gap_table(spark, sf))


@query
def state_summary(spark, sf):
    return plain(gaps.state_summary(gap_table(spark, sf)))


@query
def gaps_filtered(spark, sf):
    t = gap_table(spark, sf)
    everywhere = gaps.gaps_filtered(t).withColumn("scope", F.lit("all"))
    one = gaps.gaps_filtered(t, state="FRANCE", min_severity=0).withColumn("scope", F.lit("state"))
    kind = gaps.gaps_filtered(t, specialty="oncology", min_severity=0) \
        .withColumn("scope", F.lit("specialty"))
    return plain(everywhere.union(one).union(kind).select(
        "scope", "state", "specialty", "desert_severity", "severity_label"))


@query
def gaps_like(spark, sf):
    return plain(gaps.gaps_like(gap_table(spark, sf), ["dialysis", "mental"]).select(
        "state", "specialty", "desert_severity"))


@query
def worst_states(spark, sf):
    return plain(gaps.worst_states(gaps.state_summary(gap_table(spark, sf))).select(
        "state", "max_desert_severity", "critical_specialty_count"))


@query
def gap_payload(spark, sf):
    t = gap_table(spark, sf)
    return plain(gaps.gap_payload(t, gaps.state_summary(t))[0])


@query
def gap_payload_states(spark, sf):
    t = gap_table(spark, sf)
    return plain(gaps.gap_payload(t, gaps.state_summary(t))[1])


@query
def top_gaps_per_state(spark, sf):
    return plain(gaps.top_gaps_per_state(gap_table(spark, sf)))


@query
def critical_specialties(spark, sf):
    return gaps.critical_specialties_list(gap_table(spark, sf))


@query
def gap_lookup(spark, sf):
    return plain(gaps.gap_lookup(
        questions(spark, sf), gap_table(spark, sf)).select(
        "query_id", "rank", "state", "specialty", "desert_severity"))


@query
def gap_cards(spark, sf):
    cards = present.gap_cards(gap_table(spark, sf))
    return plain(cards.withColumn("tags", F.transform("tags", lambda t: F.concat(
        t.getField("label"), F.when(t.getField("warn"), "!").otherwise("")))))


@query
def gap_answers(spark, sf):
    q = questions(spark, sf)
    cards = present.gap_cards(gaps.gap_lookup(q, gap_table(spark, sf), list(TABLE_SPECIALTIES)))
    return present.gap_answers(q.where(intents.is_gap_query(F.col("query"))), cards)


@query
def pin_gaps(spark, sf):
    return plain(gaps.pin_gaps(gold(spark, sf)))


# --- distance ----------------------------------------------------------------------------

@query
def nearest_capable(spark, sf):
    return geo.nearest_capable(flags(spark, sf), SPECIALTIES)


@query
def radius_counts(spark, sf):
    return geo.facility_radius_counts(flags(spark, sf), SPECIALTIES)


def pins(spark, sf):
    return geo.pin_severity(flags(spark, sf), SPECIALTIES)


@query
def distance_severity(spark, sf):
    return plain(pins(spark, sf).select("address_state", "address_zip", "specialty", "capable",
                                        "severity"))


@query
def rollup_severity(spark, sf):
    return plain(geo.rollup_severity(pins(spark, sf)))


# --- dashboard ---------------------------------------------------------------------------

def both(spark, sf):
    g = gold(spark, sf)
    return g, search.silver_view(g)


@query
def overview_stats(spark, sf):
    return stats.overview_stats(*both(spark, sf))


@query
def map_points(spark, sf):
    return plain(stats.map_points(*both(spark, sf)))


@query
def facility_profiles(spark, sf):
    g, s = both(spark, sf)
    names = g.where(F.col("trust_score") >= 70).select("name")
    nested = ["trust_breakdown", "extracted_staff", "extracted_availability"]
    profiles = stats.facility_profiles(g, s, names)
    return plain(profiles.select(
        *[c for c in profiles.columns if c not in nested],
        *[F.col(f"trust_breakdown.{p}").alias(f"trust_{p}") for _, p, _ in present.TRUST_PARTS],
        F.col("extracted_staff.doctor_count").alias("staff_doctors"), "extracted_availability.*"))


@query
def map_filter(spark, sf):
    g, s = both(spark, sf)
    return stats.map_points(g, s, keywords=vocab.MAP_GROUPS["Emergency Trauma"], min_trust=40) \
        .select("gold_id", "silver_id", "trust")


@query
def map_filter_summary(spark, sf):
    g, s = both(spark, sf)
    return stats.map_filter_summary(g, s, keywords=["oncology", "cancer"], min_trust=30)


@query
def state_breakdown(spark, sf):
    return stats.state_breakdown(gaps.state_summary(gap_table(spark, sf)))


@query
def top_gaps(spark, sf):
    return plain(gaps.top_critical_gaps(gap_table(spark, sf), 6).select(
        "state", "specialty", "desert_severity"))


@query
def batch_summary(spark, sf):
    return stats.batch_summary(gold(spark, sf), gap_table(spark, sf))


@query
def icu_warning(spark, sf):
    return stats.icu_warning(gold(spark, sf)).select("facility_id", "warning")


@query
def map_clusters(spark, sf):
    return stats.map_clusters(gaps.state_summary(gap_table(spark, sf)))
