"""Documents to packed training sequences: language, repeated lines, near-duplicates, mixing,
packing. Each stage works on all rows its predecessor kept; all but the last return the columns
of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wardline.llm import language_id, mixing, packing
from wardline.llm.common import Steps
from wardline.llm.line_dedup import line_dedup
from wardline.llm.minhash_dedup import near_duplicates

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near-duplicates: five words, similarity 0.8.
PERCENT = 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; those without text or letters go. A missing label is
    filled with the prediction."""
    found = language_id.identify(docs, language_id.learnable(docs), COLUMNS)
    return found.filter(F.col("lang_pred") != language_id.UNKNOWN).withColumn(
        "lang", F.coalesce("lang", "lang_pred")).select(COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of line runs; a document that is nothing else goes."""
    out = line_dedup(docs, ["doc_id", "lang", "source"])
    return out.filter("n_removed = 0 or n_removed < n_lines").withColumn(
        "n_chars", F.length("text").cast("long")).select(COLUMNS)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    kept = near_duplicates(docs, PERCENT).filter("kept").select(
        F.col("doc_id").alias("kept_id")).distinct()
    # rows that repeat id and text are one document too
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["kept_id"]), "left_semi") \
        .dropDuplicates(["doc_id", "text"]).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.repeat(mixing.mix(docs, COLUMNS)).select(COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("language_id", identify_language), ("line_dedup", dedup_lines),
          ("minhash_dedup", dedup_documents), ("source_mixing", mix_sources),
          ("best_fit_packing", pack_sequences)]
#: SuperMinHash, seeded mixing and tokenization have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are stored for the next one."""
    steps = Steps(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        # two tables stand at a time: the stage's input and its result
        docs = steps.put(name, stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
