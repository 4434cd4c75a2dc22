"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are the character n-grams (1 to ``LONGEST`` letters, lower case) of the whole text, hashed into ``CELLS``
cells; a cell's value is the square root of its count times the inverse document frequency, scaled to length 1. Document
frequencies are counted over all training documents. The weights are fitted on a sample of at most ``SAMPLE`` rows, spread
evenly over the languages, by follow-the-regularised-leader with an L1 and an L2 penalty; the L1 penalty leaves most
weights at 0. A temperature fitted on a part of the sample that the weights have not seen makes the scores honest.

The driver sees the document frequencies (``CELLS`` numbers) and the sample's features (at most ``CELLS`` numbers a row).
Prediction is one pass over the texts without a shuffle.

Defined cases: a null text or one without a letter is ``und`` with score 0; without training rows every text is; with one
language every other text has it with score 1; ties go to the language first in the alphabet; rows are predicted one by
one, so equal texts get equal results; rows with a null id are predicted but never learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsignal.llm.batches import lean, small_batches

LONGEST = 3
CELL_BITS = 14
CELLS = 1 << CELL_BITS
#: Slices of the keys, as a power of two, by which the sample is cut down before it meets in one task.
SLICE_BITS = 12
SAMPLE = 2_000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.05
UNKNOWN = "und"

_ROLL, _LETTER, _SPREAD = (np.uint32(odd) for odd in (0xC2B2AE3D, 0x9E3779B1, 0x27D4EB2F))


def fold(doc_id: Column) -> Column:
    """Remainder by which documents are held out; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def cell_counts(text: str) -> np.ndarray:
    """Counts of the hashed n-grams of a whole text."""
    chars = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    counts, keys = np.zeros(CELLS, np.int64), np.zeros(len(chars), np.uint32)
    for n in range(min(LONGEST, len(chars))):
        keys = keys[: len(chars) - n] * _ROLL + (chars[n:] + np.uint32(n + 1)) * _LETTER
        spread = (keys ^ (keys >> np.uint32(15))) * _SPREAD
        counts += np.bincount(spread >> np.uint32(32 - CELL_BITS), minlength=CELLS)
    return counts


def _unit(values: np.ndarray) -> np.ndarray:
    norm = np.sqrt((values * values).sum(axis=-1, keepdims=True))
    return values / np.where(norm > 0, norm, 1)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # (CELLS + 1, languages); the last row is the bias
    temperature: float = 1.0

    def probabilities(self, counts: np.ndarray) -> np.ndarray:
        """For counts of several texts, a row each."""
        values = _unit(np.sqrt(counts, dtype=np.float32) * self.idf)
        logits = (values @ self.weights[:-1] + self.weights[-1]) / self.temperature
        raised = np.exp(logits - logits.max(axis=1, keepdims=True))
        return raised / raised.sum(axis=1, keepdims=True)


def follow_the_leader(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], classes: int, epochs: int = EPOCHS) -> np.ndarray:
    """Weights by FTRL-proximal steps, one row after another. Rows are (cells, values)."""
    z, n = np.zeros((CELLS + 1, classes)), np.zeros((CELLS + 1, classes))

    def weights(cells):
        zc = z[cells]
        shrunk = np.sign(zc) * np.maximum(np.abs(zc) - L1, 0.0)
        return -shrunk / ((BETA + np.sqrt(n[cells])) / ALPHA + L2)

    for _ in range(epochs):
        for (cells, values), label in zip(rows, labels):
            w = weights(cells)
            logits = values @ w
            error = np.exp(logits - logits.max())
            error /= error.sum()
            error[label] -= 1.0
            g = values[:, None] * error
            squared = n[cells] + g * g
            z[cells] += g - (np.sqrt(squared) - np.sqrt(n[cells])) / ALPHA * w
            n[cells] = squared
    return weights(slice(None))


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits with the smallest log loss, between 1/20 and 20."""
    def loss(t):
        scaled = logits / t
        top = scaled.max(axis=1)
        return float(np.mean(top + np.log(np.exp(scaled - top[:, None]).sum(axis=1)) - scaled[np.arange(len(labels)), labels]))

    return min(np.exp(np.linspace(-np.log(20), np.log(20), 121)), key=loss) if len(labels) else 1.0


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Documents in which each cell occurs, over all rows, and their number."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, rows = np.zeros(CELLS, np.int64), 0
        for batch in batches:
            for text in batch.column("text"):
                found += cell_counts(text.as_py()) > 0
                rows += 1
        cells = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([
            pa.array([*cells.tolist(), -1], pa.int32()), pa.array([*found[cells].tolist(), rows], pa.int64())], ["cell", "docs"])

    counted = texts.select("text").mapInArrow(lean(count), "cell int, docs bigint").groupBy("cell").agg(F.sum("docs").alias("docs"))
    frequencies, rows = np.zeros(CELLS, np.int64), 0
    for cell, docs in counted.collect():  # CELLS + 1 rows at most
        if cell < 0:
            rows = docs
        else:
            frequencies[cell] = docs
    return frequencies, rows


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.filter((fold(F.col("doc_id")) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())


def lowest(ids: DataFrame, label: str, sample: int) -> DataFrame:
    """The rows that may be among the ``sample`` lowest keys of their label, and few others: all up to the slice of keys in which that
    many are reached. The sizes of the slices are SLICES rows for each label, so no task sees the rows of a whole label."""
    part = F.shiftright("key", 64 - SLICE_BITS).cast("int")
    sizes = ids.groupBy(label, part.alias("slice")).agg(F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy(label).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    needed = sizes.withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0))).filter(F.col("before") < sample)
    last = needed.groupBy(label).agg(F.max("slice").alias("last"))
    return ids.join(F.broadcast(last), label).filter(part <= F.col("last")).drop("last")


def sample_features(rows: DataFrame, sample: int = SAMPLE) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(lang, cells, counts) of at most ``sample`` ids: first one of each language, then a second of each, … An id that
    repeats counts once, with its smallest language and text."""
    ids = rows.groupBy("doc_id").agg(F.min("lang").alias("lang")).withColumn("key", F.xxhash64("doc_id"))
    ids = lowest(ids, "lang", sample).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("key", "doc_id")))
    # No language has more than `sample` rows here.
    chosen = ids.filter(F.col("rank") <= sample).orderBy("rank", "key", "doc_id").limit(sample)
    chosen = F.broadcast(chosen.select("doc_id"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                counts = cell_counts(batch.column("text")[row].as_py())
                cells = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([
                    batch.column("key").slice(row, 1), batch.column("lang").slice(row, 1),
                    pa.array([cells.astype("<u2").tobytes()], pa.binary()),
                    pa.array([counts[cells].astype("<u4").tobytes()], pa.binary()),
                ], ["key", "lang", "cells", "counts"])

    picked = rows.join(chosen, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("row"))
    picked = picked.select(F.xxhash64("doc_id").alias("key"), "row.*")
    found = picked.mapInArrow(lean(features), "key bigint, lang string, cells binary, counts binary").collect()
    found.sort(key=lambda r: (r.key, r.lang, bytes(r.cells), bytes(r.counts)))
    return [(r.lang, np.frombuffer(r.cells, "<u2"), np.frombuffer(r.counts, "<u4")) for r in found]


def train(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Learns from the documents that are not held out; None without any."""
    small_batches(docs.sparkSession)
    rows = training_rows(docs)
    found = sample_features(rows, sample)
    if not found:
        return None
    frequencies, total = document_frequencies(rows)
    idf = (np.log((1 + total) / (1 + frequencies)) + 1).astype(np.float32)
    languages = sorted({lang for lang, _, _ in found})
    labels = [languages.index(lang) for lang, _, _ in found]
    vectors = []
    for _, cells, counts in found:
        values = _unit(np.sqrt(counts) * idf[cells])
        vectors.append((np.append(cells.astype(np.int64), CELLS), np.append(values, 1.0)))
    held = [i for i in range(len(found)) if i % 5 == 4]
    seen = [i for i in range(len(found)) if i % 5 != 4]
    weights = follow_the_leader([vectors[i] for i in seen], [labels[i] for i in seen], len(languages))
    temperature = 1.0  # of samples too small to hold rows out
    if held:
        logits = np.array([values @ weights[cells] for cells, values in (vectors[i] for i in held)]).reshape(len(held), -1)
        temperature = fit_temperature(logits, np.array([labels[i] for i in held], np.int64))
    return Model(languages, idf, weights.astype(np.float32), temperature)


def predict(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",),
            into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Columns ``keep`` of every row with its language and score, named ``into``."""
    def languages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = [UNKNOWN] * batch.num_rows, [0.0] * batch.num_rows
            for first in range(0, batch.num_rows if model else 0, 64):
                texts = batch.column("text").slice(first, 64).to_pylist()
                rows = [i for i, text in enumerate(texts) if has_letter(text)]
                if not rows:
                    continue
                found = model.probabilities(np.stack([cell_counts(texts[i]) for i in rows]))
                for i, p in zip(rows, found):
                    names[first + i], scores[first + i] = model.languages[int(p.argmax())], float(min(p.max(), 1.0))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                [*keep, *into])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    source = docs.select(*keep, *(["text"] if "text" not in keep else []))
    return source.mapInArrow(lean(languages), f"{kinds}, `{into[0]}` string, `{into[1]}` double")


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    held = F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False))
    return predict(docs, train(docs, sample)).select("doc_id", held.alias("held_out"), "lang_pred", "score")
