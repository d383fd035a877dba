"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lowered, everything but letters becomes a space, and all bigrams and trigrams of the
whole text are hashed to BUCKETS features. Spark sums feature counts per language over all
labelled rows; the matrix of log-probabilities (languages x BUCKETS, bounded by the number of
labels) is broadcast, and tasks score batches of texts as sparse rows in numpy.

Defined cases: null texts and texts without a letter are `und` with score 0, as is everything
where no labelled row exists; a label that is null is not learned; equal scores go to the
smaller label; repeated rows count as often as they stand there; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

#: Feature buckets (a power of two).
BUCKETS = 1 << 16
#: Characters that one numpy step handles: it holds about 100 bytes for each of them.
SLICE_CHARS = 1 << 17
UNKNOWN = "und"
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def _features(texts: list[str]):
    """Feature of every n-gram, first feature of each text (texts + 1 numbers), and whether
    each text has a letter."""
    padded = [f"  {t.lower()}  " for t in texts]
    sizes = np.fromiter(map(len, padded), np.int64, len(padded))
    code = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter()[code]
    code = np.where(letter, code, np.uint32(32)).astype(np.uint64)
    firsts = np.append(0, np.cumsum(sizes))
    two = code[:-1] * np.uint64(0x9E3779B1) + code[1:]
    three = two[:-1] * np.uint64(0x85EBCA77C2B2AE63) + code[2:] * np.uint64(0x27D4EB2F165667C5)
    # an n-gram of a text starts before its last two characters, which are padding
    starts = np.ones(len(code), bool)
    starts[firsts[1:] - 1] = False
    starts[firsts[1:] - 2] = False
    starts = starts[:-2]
    shift, mask = np.uint64(40), np.uint64(BUCKETS - 1)
    pairs = ((two[:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) >> shift) & mask
    features = np.stack([pairs, (three >> shift) & mask], axis=1)[starts]
    has_letter = np.add.reduceat(letter.astype(np.int64), firsts[:-1]) > 0
    return features.astype(np.int64).ravel(), 2 * (firsts - 2 * np.arange(len(firsts))), has_letter


def _slices(column: pa.Array):
    """Runs of texts of about SLICE_CHARS characters, so that no more are unpacked at once."""
    first = size = 0
    for i, n in enumerate(pc.fill_null(pc.utf8_length(column), 0).to_pylist()):
        size += n
        if size >= SLICE_CHARS or i == len(column) - 1:
            yield first, i + 1
            first, size = i + 1, 0


def _counts(batches):
    """Feature counts per language of one task."""
    total: dict[str, np.ndarray] = {}
    rows: dict[str, int] = {}
    for batch in batches:
        column, labels = batch.column("text"), batch.column("lang").to_pylist()
        for a, b in _slices(column):
            texts = column.slice(a, b - a).to_pylist()
            part = sorted(range(a, b), key=lambda i: labels[i])
            features, firsts, _ = _features([texts[i - a] or "" for i in part])
            names = [labels[i] for i in part]
            edges = [k for k in range(len(names)) if k == 0 or names[k] != names[k - 1]]
            for k, end in zip(edges, edges[1:] + [len(names)]):
                got = np.bincount(features[firsts[k]:firsts[end]], minlength=BUCKETS)
                total[names[k]] = total.get(names[k], 0) + got
                rows[names[k]] = rows.get(names[k], 0) + end - k
    for name, got in total.items():
        at = np.flatnonzero(got)
        n = len(at) + 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * n), pa.array(np.append(at, -1).astype(np.int32)),
             pa.array(np.append(got[at], rows[name]))], ["lang", "feature", "n"])


def learn(labelled: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log-probabilities (languages x BUCKETS) and log-priors of rows (text, lang)."""
    rows = labelled.filter("lang is not null and text is not null").select("text", "lang") \
        .mapInArrow(_counts, "lang string, feature int, n long") \
        .groupBy("lang", "feature").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(rows["lang"].unique())
    at = {name: i for i, name in enumerate(names)}
    counts = np.ones((len(names), BUCKETS))
    priors = np.zeros(len(names))
    place, feature, n = rows["lang"].map(at).to_numpy(int), rows["feature"].to_numpy(), \
        rows["n"].to_numpy(float)
    real = feature >= 0
    np.add.at(counts, (place[real], feature[real]), n[real])
    priors[place[~real]] = n[~real]
    return names, np.log(counts / counts.sum(axis=1, keepdims=True)), \
        np.log(priors / max(1.0, priors.sum()))


def _score(model):
    def run(batches):
        names, table, priors = model.value
        labels = np.array([*names, UNKNOWN], dtype=object)
        for batch in batches:
            column = batch.column("_text")
            best = np.full(len(column), len(names))
            score = np.zeros(len(column))
            for a, b in _slices(column) if names else ():
                texts = column.slice(a, b - a).to_pylist()
                features, firsts, has_letter = _features([t or "" for t in texts])
                # a text without characters has padding only, which is one n-gram of each order
                logs = np.stack([np.add.reduceat(row[features], firsts[:-1]) for row in table],
                                axis=1) + priors
                top = logs.argmax(axis=1)
                gap = logs - logs.max(axis=1, keepdims=True)
                sure = 1.0 / np.exp(gap).sum(axis=1)
                best[a:b] = np.where(has_letter, top, len(names))
                score[a:b] = np.where(has_letter, sure, 0.0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(labels[best], pa.string()), pa.array(score)],
                [*batch.schema.names[:-1], "lang_pred", "score"])
    return run


def identify(docs: DataFrame, labelled: DataFrame, keep: list[str]) -> DataFrame:
    """Columns `keep` of docs, lang_pred and score (the posterior), learned from `labelled`."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(learn(labelled))
    kept = [f"_{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(c).alias(k) for c, k in zip(keep, kept)], F.col("text").alias("_text"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    out = rows.mapInArrow(_score(model), f"{fields}, lang_pred string, score double")
    return out.select(*[F.col(k).alias(c) for c, k in zip(keep, kept)], "lang_pred", "score")


def held_out() -> "F.Column":
    """Rows kept from learning: crc32 of the id as text, divisible by five."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learnable(docs: DataFrame) -> DataFrame:
    return docs.filter(~held_out() & F.col("doc_id").isNotNull()).select("text", "lang")
