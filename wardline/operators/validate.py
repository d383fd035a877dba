"""Checking claims against source text, correcting disputed ones, sampling and intervals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from wardline.functions import columns as X, vocab
from wardline.operators import claims as C

VALIDATED = ["has_icu", "has_emergency", "has_24_7"]
VALIDATED_ROWS = 5

# A Poisson sum is tabulated this many standard deviations (and ten) around its mean: what lies
# outside is less than the rounding of a double.
TABLE_WIDTH = 9


def with_standards_check(records: DataFrame, text: Column,
                         standards: dict[str, list[str]] | None = None,
                         claimed: list[str] | None = None,
                         out: str = "standards_check", evidence_of: Column | None = None) -> DataFrame:
    """Adds map<claim, (claimed, supported, evidence, standard_note)>. The evidence is looked for
    in the text, or given as a struct with a field per claim."""
    standards = vocab.STANDARDS if standards is None else standards
    claimed = list(standards) if claimed is None else claimed
    entries = []
    for claim, words in standards.items():
        on = F.coalesce(F.col(claim), F.lit(False)) if claim in claimed else F.lit(False)
        evidence = X.first_word("_checked", words) if evidence_of is None else evidence_of.getField(claim)
        entries += [F.lit(claim), F.struct(
            on.alias("claimed"),
            F.when(on, evidence.isNotNull()).alias("supported"),
            F.when(on, evidence).alias("evidence"),
            F.when(on & evidence.isNull(), f"Expected one of: {words[:3]}")
            .alias("standard_note"))]
    lowered = records.withColumn("_checked", F.lower(X.text_or_empty(text)))
    return lowered.withColumn(out, F.create_map(*entries)).drop("_checked")


def standards_long(checked: DataFrame, column: str = "standards_check") -> DataFrame:
    return checked.select("facility_id", F.explode(column).alias("claim", "r")).select(
        "facility_id", "claim", "r.claimed", "r.supported", "r.evidence", "r.standard_note")


def failed_claims(check: Column) -> Column:
    bad = F.map_filter(check, lambda _, r: r.getField("claimed") & ~r.getField("supported"))
    return F.map_keys(bad)


def with_text_facts(records: DataFrame, capabilities: str = "key_capabilities") -> DataFrame:
    """Adds what the checks below take from the source text: its first word for each claim, its first
    sentence that states a claim, and which of the listed capabilities it holds. A text that
    many results share is read once if its facts are joined to them."""
    low = F.lower("source_text")
    return records.withColumn("_low", low).withColumn("text_facts", F.struct(
        F.col("source_text").isNotNull().alias("known"), (F.length("source_text") < 20).alias("short"),
        F.struct(*[X.first_word("_low", words).alias(c) for c, words in vocab.STANDARDS.items()]).alias("evidence"),
        X.first_sentence_with("source_text", "_low", C.ALL_CLAIM_WORDS).alias("sentence"),
        F.filter(capabilities, lambda c: F.contains(F.col("_low"), F.lower(c))).alias("held"))).drop("_low")


def _fact(name: str) -> Column:
    return F.col("text_facts").getField(name)


def _stated(claim: str) -> Column:
    return F.when(_fact("known"), _fact("evidence").getField(claim).isNotNull())


def validate(results: DataFrame) -> DataFrame:
    """Per-claim support, note and verdict from the source text, or from its facts where given."""
    if "text_facts" not in results.columns:
        return validate(with_text_facts(results)).drop("text_facts")
    on = {c: F.coalesce(F.col(c), F.lit(False)) for c in VALIDATED}
    support = {c: F.when(on[c], _stated(c)) for c in VALIDATED}
    checked = results.withColumns({f"{c}_supported": s for c, s in support.items()})
    failed = F.array_compact(F.array(*[
        F.when(~F.col(f"{c}_supported"), F.lit(c)) for c in VALIDATED]))
    nothing = _fact("short") | ~reduce(lambda a, b: a | b, on.values())
    return checked.withColumns({
        "capabilities_supported": F.forall(
            "key_capabilities", lambda c: F.when(_fact("known"), F.array_contains(_fact("held"), c))),
        "overall_verdict": F.when(nothing, "INSUFFICIENT_TEXT")
        .when(F.size(failed) > 0, "DISPUTED").otherwise("VERIFIED"),
        "validation_note": F.when(nothing, "Text too short or no claim to verify")
        .when(F.size(failed) > 0, F.concat(F.lit("No evidence for "), F.array_join(failed, ", ")))
        .otherwise("All claims supported"),
    })


def validate_top(results: DataFrame, rows: int = VALIDATED_ROWS) -> DataFrame:
    """Validation records of the first rows of every query."""
    return validate(results.where(F.col("rank") <= rows)).select(
        "query_id", "rank", F.col("name").alias("facility_name"),
        *[f"{c}_supported" for c in VALIDATED], "capabilities_supported",
        "validation_note", "overall_verdict")


def attach_verdict(results: DataFrame, rows: int = VALIDATED_ROWS) -> DataFrame:
    """Verdict of the last validated row with the same name in the query, else NOT_VALIDATED.

    A query has at most a page of results, so the window partition is that small.
    """
    checked = validate(results)
    record = F.when(F.col("rank") <= rows, F.struct(
        "rank", F.col("overall_verdict").alias("verdict"), F.col("validation_note").alias("note"),
        F.col("has_icu_supported").alias("icu"),
        F.col("has_emergency_supported").alias("emergency"),
        F.col("has_24_7_supported").alias("open")))
    last = F.max(record).over(Window.partitionBy("query_id", "name"))
    return (
        checked.withColumn("_v", last)
        .drop(*[f"{c}_supported" for c in VALIDATED], "capabilities_supported",
              "overall_verdict", "validation_note")
        .withColumns({
            "validation_verdict": F.coalesce("_v.verdict", F.lit("NOT_VALIDATED")),
            "validation_note": F.coalesce("_v.note", F.lit("")),
            "icu_verified": F.col("_v.icu"),
            "emergency_verified": F.col("_v.emergency"),
            "availability_verified": F.col("_v.open"),
        }).drop("_v")
    )


def re_extract(answered: DataFrame) -> DataFrame:
    """Disputed rows keep only what the source text supports."""
    if "text_facts" not in answered.columns:
        return re_extract(with_text_facts(answered)).drop("text_facts")
    disputed = F.col("validation_verdict") == "DISPUTED"
    answered = with_standards_check(answered, F.col("source_text"), claimed=VALIDATED, evidence_of=_fact("evidence"))
    kept_caps = F.filter("key_capabilities", lambda c: F.array_contains(_fact("held"), c))
    lost_flag = {c: F.coalesce(F.col(c), F.lit(False)) & ~_stated(c) for c in VALIDATED}
    checked = answered.withColumns({
        "_caps": F.when(disputed, kept_caps).otherwise(F.col("key_capabilities")),
        **{f"_lost_{c}": disputed & lost for c, lost in lost_flag.items()},
        "_sentence": F.when(disputed, _fact("sentence")),
    })
    removed = reduce(lambda a, b: a | b, [F.col(f"_lost_{c}") for c in VALIDATED],
                     F.size("_caps") < F.size("key_capabilities"))
    changed = removed | (F.col("_sentence").isNotNull() & (F.col("_sentence") != F.col("citation")))
    note = F.concat(F.lit("Removed without evidence: "), F.array_join(F.concat(
        F.array_compact(F.array(*[F.when(F.col(f"_lost_{c}"), F.lit(c)) for c in VALIDATED])),
        F.array_except("key_capabilities", "_caps")), ", "))
    return checked.withColumns({
        "self_corrected": F.coalesce(disputed & changed, F.lit(False)),
        "correction_note": F.when(disputed & removed, note).otherwise(""),
        "confidence": F.when(disputed & removed, "low").otherwise(F.col("confidence")),
        "citation": F.coalesce("_sentence", "citation"),
        **{c: F.when(~F.col(f"_lost_{c}"), F.col(c)) for c in VALIDATED},
    }).withColumn("key_capabilities", F.col("_caps")).drop(
        "_caps", "_sentence", *[f"_lost_{c}" for c in VALIDATED])


def verdict_counts(answered: DataFrame, rows: int = VALIDATED_ROWS) -> DataFrame:
    top = F.col("rank") <= rows
    verdict = F.col("validation_verdict")
    return answered.groupBy("query_id").agg(
        F.count_if(top).alias("validated"),
        *[F.count_if(top & (verdict == v)).alias(n) for v, n in (
            ("VERIFIED", "verified"), ("DISPUTED", "disputed"),
            ("INSUFFICIENT_TEXT", "insufficient"))],
        F.count_if("self_corrected").alias("corrected"))


def stratified_sample(gold: DataFrame, percent: int = 10) -> DataFrame:
    """A repeatable share of the records of every trust band, chosen by a hash of the id."""
    banded = gold.withColumn("band", X.trust_band(F.col("trust_score")))
    return banded.where(
        F.pmod(X.hash_number(F.col("facility_id")), F.lit(10_000)) < round(100 * percent))


def agreement(sampled: DataFrame, claims: list[str]) -> DataFrame:
    """Primary claims against `validator_<claim>` columns: rate per record, review flag."""
    same = [F.col(c).eqNullSafe(F.col(f"validator_{c}")).cast("int") for c in claims]
    return sampled.withColumns({
        "agreement": X.half_even(reduce(lambda a, b: a + b, same) / len(claims), 4),
        "needs_review": reduce(lambda a, b: a + b, same) < len(claims),
    })


def agreement_rate(sampled: DataFrame, claims: list[str]) -> DataFrame:
    """Agreement of every claim over the sample, and the number of records to review."""
    per_claim = [F.avg(F.col(c).eqNullSafe(F.col(f"validator_{c}")).cast("int")) for c in claims]
    flagged = agreement(sampled, claims)
    return flagged.agg(
        F.count(F.lit(1)).alias("sampled"),
        *[F.bround(a, 4).alias(f"{c}_rate") for c, a in zip(claims, per_claim)],
        F.count_if("needs_review").alias("needs_review"))


def poisson_sums(counts: DataFrame, keys: list[str], replicates: int) -> DataFrame:
    """(*keys, b, w): for every row of counts (keys, n) and replicate, the sum of n independent
    Poisson(1) weights. The sum is Poisson(n): its distribution is tabulated around n and
    inverted at a hash of the keys and the replicate, so a group costs the square root of its
    records, however many replicates are drawn. A count of 0 has the sum 0."""
    some = counts.where("n > 0")
    spread = F.ceil(TABLE_WIDTH * F.sqrt("n")) + 10
    k = F.sequence(F.greatest(F.lit(0), F.col("n") - spread).cast("bigint"),
                   (F.col("n") + spread).cast("bigint"))
    rows = some.select(*keys, "n", F.explode(k).alias("k"))
    upward = Window.partitionBy(*keys).orderBy("k")
    whole = Window.partitionBy(*keys)
    # probabilities up to a factor: each is n / k times the one before
    step = F.when(F.row_number().over(upward) > 1, F.ln(F.col("n") / F.col("k"))).otherwise(0.0)
    table = rows.withColumn("step", step).withColumn("logp", F.sum("step").over(upward)) \
        .withColumn("p", F.exp(F.col("logp") - F.max("logp").over(whole))) \
        .withColumn("v", F.sum("p").over(upward) / F.sum("p").over(whole))
    draws = some.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in keys], F.col("b").cast("string"))
    draws = draws.withColumn("v", X.hash_number(text) / F.lit(4294967296.0))
    # the smallest k whose cumulated probability is above the draw
    both = table.select(*keys, "v", "k", F.lit(None).cast("int").alias("b")).unionByName(
        draws.select(*keys, "v", F.lit(None).cast("bigint").alias("k"), "b"))
    above = Window.partitionBy(*keys).orderBy(F.col("v").desc(), F.col("k").asc_nulls_first()) \
        .rowsBetween(Window.unboundedPreceding, 0)
    drawn = both.withColumn("w", F.min("k").over(above)).where(F.col("b").isNotNull())
    # a draw beyond the table, which rounding alone can cause, is the table's last entry
    last = table.groupBy(*keys).agg(F.max("k").alias("last"))
    return drawn.join(last, keys).select(*keys, "b", F.coalesce("w", "last").alias("w"))


def bootstrap_interval(gold: DataFrame, claim: str, by: str = "address_state",
                       replicates: int = 200) -> DataFrame:
    """95 % interval of the share of records with the claim, per group.

    `low`: unknown counted as no. `known`: unknown left out. Only the counts of yes, no and
    unknown per group are resampled, so no record is ever repeated.
    """
    answer = F.when(F.col(claim), "yes").when(~F.col(claim), "no").otherwise("unknown")
    counts = gold.where(F.col(by).isNotNull()).select(F.col(by).alias("group"), answer.alias("answer")) \
        .groupBy("group", "answer").agg(F.count(F.lit(1)).alias("n"))
    drawn = poisson_sums(counts, ["group", "answer"], replicates)

    def total(*answers: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("answer").isin(*answers), F.col("w"))), F.lit(0))

    shares = drawn.groupBy("group", "b").agg(
        F.try_divide(total("yes"), total("yes", "no", "unknown")).alias("of_all"),
        F.try_divide(total("yes"), total("yes", "no")).alias("of_known"))
    return shares.groupBy(F.col("group").alias(by)).agg(*[
        F.bround(F.percentile(c, p), 4).alias(f"{c}_{n}")
        for c in ("of_all", "of_known") for n, p in (("lower", 0.025), ("upper", 0.975))])
