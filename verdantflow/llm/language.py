"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training sums n-gram counts of whole labelled texts over all tasks; the matrix of log-probabilities, of a size
fixed by its parameters, is broadcast, and texts are scored in batches: their n-grams index its rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from verdantflow.llm.shared import dense, slices, sum_vectors, vector_rows

UNKNOWN = "und"
BITS = 16
SIZES = (1, 2, 3)
CELLS = 1 << 24
_PART = 1 << 14


@dataclass(frozen=True)
class LanguageModel:
    """``languages`` in order and ``weights``: log-probabilities, a row for each bucket; ``prior`` by language."""

    languages: tuple[str, ...]
    weights: np.ndarray
    prior: np.ndarray
    sizes: tuple[int, ...] = SIZES


def _grams(texts: list[str], bits: int, sizes: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size: bucket of each n-gram, and the text that it is from. A text is lower-cased and led by a space."""
    lowered = [" " + t.lower() for t in texts]
    length = np.array([len(t) for t in lowered])
    code = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.where((code < 33) & (code != 32), np.uint32(32), code)
    row = np.repeat(np.arange(len(texts), dtype=np.int32), length)
    h = code.astype(np.uint64)
    for size in range(1, max(sizes) + 1):
        if size > 1:
            h = h[:-1] * np.uint64(0x100000001B3) + code[size - 1 :]
        if size in sizes and len(h):
            mixed = (h + np.uint64(size)) * np.uint64(0x9E3779B97F4A7C15)
            within = row[: len(h)] == row[size - 1 :]
            yield (mixed >> np.uint64(64 - bits)).astype(np.int64)[within], row[: len(h)][within]


def _count(batches, bits: int, sizes: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in slices(batches, "text", 1 << 18):
        langs, texts = batch.column("lang").to_pylist(), [t or "" for t in batch.column("text").to_pylist()]
        for lang in set(langs):
            own = [t for t, x in zip(texts, langs) if x == lang]
            counts = total.setdefault(lang, np.zeros((1 << bits) + 1, np.int64))
            counts[-1] += len(own)
            for bucket, _ in _grams(own, bits, sizes):
                counts[:-1] += np.bincount(bucket, minlength=1 << bits)
    for lang, counts in total.items():
        for row in vector_rows(lang, counts, _PART):
            yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("name", pa.string()), ("part", pa.int32()), ("data", pa.binary())]))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", bits: int = BITS, sizes: tuple[int, ...] = SIZES, smoothing: float = 0.5) -> LanguageModel:
    """Counts over all rows with a label; rows with a null label, or null text, teach nothing.

    Every label is learned. The matrix has at most ``CELLS`` cells: labels are counted first, and with more than
    2^(24 - bits) of them n-grams share fewer buckets. More than 2^16 labels, fewer than 256 buckets each, raise
    ValueError.
    """
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    labels = rows.select("lang").distinct().count()
    if labels > CELLS >> 8:
        raise ValueError(f"{labels} labels are not languages")
    bits = min(bits, (CELLS // max(labels, 1)).bit_length() - 1)
    counted = sum_vectors(rows.mapInArrow(lambda b: _count(b, bits, sizes), "name string, part int, data binary"))
    counts = dense(counted.collect(), (1 << bits) + 1, _PART)
    languages = tuple(sorted(counts))
    if not languages:
        return LanguageModel((), np.zeros((1 << bits, 0)), np.zeros(0), sizes)
    grams = np.stack([counts[x][:-1] for x in languages], 1) + smoothing
    docs_of = np.array([counts[x][-1] for x in languages], float)
    return LanguageModel(languages, np.log(grams / grams.sum(0)).astype(np.float32), np.log(docs_of / docs_of.sum()), sizes)


def score_texts(texts: list[str | None], model: LanguageModel) -> tuple[list[str], np.ndarray]:
    """Language and score of each text: the posterior of the likeliest language, its evidence tempered.

    N-grams overlap and so aren't independent; log-likelihoods are divided by the number of sizes. Ties go to
    the first language in order. Without text, letters or a trained language: ``und`` and 0.
    """
    known = [bool(model.languages) and t is not None and any(map(str.isalpha, t)) for t in texts]
    own = [t for t, k in zip(texts, known) if k]
    labels, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if own:
        total = np.zeros((len(own), len(model.languages)))
        bits = int(model.weights.shape[0]).bit_length() - 1
        for bucket, row in _grams(own, bits, model.sizes):
            begin = np.searchsorted(row, np.arange(len(own)))
            some = begin < np.append(begin[1:], len(row))
            for k in range(len(model.languages)):  # one column at a time keeps the work array small
                total[some, k] += np.add.reduceat(model.weights[bucket, k], begin[some], dtype=np.float64)
        total = total / len(model.sizes) + model.prior
        best = total.argmax(1)
        share = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
        at = np.flatnonzero(known)
        score[at] = share
        for i, b in zip(at.tolist(), best.tolist()):
            labels[i] = model.languages[b]
    return labels, score


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its score (0 to 1) of every whole text; other columns stay as they are.

    A null text, or one without a letter, is ``und`` with score 0. Repeated rows get the same prediction.
    The new columns replace any of the same name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop(lang, score)

    def scored(batches):
        for batch in slices(batches, text_col, 1 << 18):
            labels, found = score_texts(batch.column(text_col).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(labels, pa.string()), pa.array(found)], names=[*batch.schema.names, lang, score])

    schema = StructType([*kept.schema.fields, StructField(lang, StringType()), StructField(score, DoubleType())])
    return kept.mapInArrow(scored, schema)
