"""Toxicity: a convolutional text classifier trained in numpy, with thresholds calibrated by language.

A text is lower-cased and cut into runs of letters and digits. A word's vector is the sum of two rows of a hashed
embedding table, one for the word and one for its first ``STEM`` bytes. Filters of widths 1, 2 and 3 run over the whole
text, their largest values are pooled, and a logistic layer turns them into a score. All labelled rows are learned from, but for
a fifth set aside. The network starts from at most ``SAMPLE`` rows of each label, on the driver; if there are more, shards of about
``SHARD`` rows go on from it, over all rows, and their networks are averaged, ``ROUNDS`` times. Labelled texts are shuffled once, to their
shard, which is kept as one row of lists; whoever reads that row has the whole shard. A naive Bayes over the hashed stems
of all labelled rows guesses the language from the text; for each language the threshold with the best F1 is found on all
rows set aside (languages with fewer than ``LEAST_TOXIC`` toxic rows there share one; logits are counted in steps of 1 / ``STEPS``),
and scores are shifted so that it stands at ``THRESHOLD``.

The sample's word numbers, averages and counts are all that reaches the driver. Scoring is one pass over the texts without a shuffle.

Defined cases: a null or empty text pools zeros and gets the score of a text without words; without labelled rows, or with
one label only, every score is 0; rows are scored one by one, so equal texts get equal scores; rows with a null id are
scored but never learned from, and labels that repeat an id count as toxic if one of them is; an empty table gives an
empty result.
"""

from __future__ import annotations

import copy
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsignal.functions.bits import bit_table, may_hold
from newsignal.llm.batches import lean, small_batches
from newsignal.llm.hashing import PUNCTUATION, TextWords, in_chunks, span_hashes
from newsignal.llm.langid import fold, lowest
from newsignal.session import scratch

THRESHOLD = 0.3
STEM = 4
ROW_BITS = 18
#: A hashed word or stem found in fewer rows of the sample has a vector of zeros, which is not learned.
LEAST_ROWS = 3
GUESS_CELLS = 1 << 12
WIDTH, FILTERS, SPANS = 16, 16, (1, 2, 3)
#: Rows of each label that the network starts from at most.
SAMPLE = {1: 1_500, 0: 3_000}
#: Rows of a task that goes on from there, and how often the networks of all tasks are averaged.
SHARD, ROUNDS = 4_500, 2
#: Rows of the table that are averaged together.
BLOCK = 1 << 12
#: Bits that tell apart texts without a label before they are shuffled: two megabytes.
BITS = 1 << 24
EPOCHS, BATCH, RATE, DECAY = 6, 32, 0.05, 1e-4
#: A word is left out of a training step with this probability.
DROPPED = 0.1
LEAST_TOXIC = 8
STEPS = 256


class Words:
    """Rows of the embedding table and cells of the language guess for the words of some texts."""

    def __init__(self, texts: list[str]):
        words = TextWords([t.lower().encode() for t in texts], PUNCTUATION)
        stems = span_hashes(words.buffer, words.starts, np.minimum(words.starts + STEM, words.ends))
        self.full = (words.hashes >> np.uint64(64 - ROW_BITS)).astype(np.int32)
        self.stem = (stems >> np.uint64(64 - ROW_BITS)).astype(np.int32)
        self.bounds = words.bounds


@dataclass
class Model:
    slots: np.ndarray  # of every hashed word or stem in the table; slot 0 holds zeros
    table: np.ndarray
    filters: list[np.ndarray]  # by span: (span, WIDTH, FILTERS)
    shifts: np.ndarray
    weights: np.ndarray
    bias: float
    languages: list[str] = field(default_factory=list)
    guess: np.ndarray | None = None  # (GUESS_CELLS, languages)
    logits_at: np.ndarray | None = None  # threshold of each language, as a logit

    def convolved(self, full: np.ndarray, stem: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Filter values at each word. ``last`` is the place of the last word of the word's text."""
        vectors = self.table[self.slots[full]] + self.table[self.slots[stem]]
        out = np.repeat(self.shifts[None, :], len(full), axis=0)
        places = np.arange(len(full))
        for i, filters in enumerate(self.filters):
            here = out[:, i * FILTERS : (i + 1) * FILTERS]
            for k, weights in enumerate(filters):
                if k >= len(full):
                    break
                part = vectors[k:] @ weights
                part[places[k:] > last[: len(full) - k]] = 0.0
                here[: len(full) - k] += part
        return out

    def pooled(self, full, stem, bounds) -> tuple[np.ndarray, np.ndarray]:
        """Largest value of each filter in each text, at least 0, and the place that it has it at."""
        texts = len(bounds) - 1
        best, at = np.zeros((texts, len(self.shifts)), np.float32), np.full((texts, len(self.shifts)), -1, np.int64)
        values = self.convolved(full, stem, np.repeat(bounds[1:] - 1, np.diff(bounds)))
        for i in range(texts):
            a, b = bounds[i], bounds[i + 1]
            if b > a:
                at[i] = values[a:b].argmax(axis=0) + a
                best[i] = values[at[i], np.arange(len(self.shifts))]
        at[best <= 0] = -1
        return np.maximum(best, 0.0), at

    def logits(self, words: Words) -> np.ndarray:
        bounds = words.bounds
        best = np.zeros((len(bounds) - 1, len(self.shifts)), np.float32)
        rows = np.flatnonzero(np.diff(bounds))
        if len(rows):
            values = self.convolved(words.full, words.stem, np.repeat(bounds[1:] - 1, np.diff(bounds)))
            best[rows] = np.maximum(np.maximum.reduceat(values, bounds[:-1][rows], axis=0), 0.0)
        return best @ self.weights + self.bias

    def guesses(self, words: Words) -> np.ndarray:
        """Number of the likeliest language of each text."""
        sums = np.zeros((len(words.bounds) - 1, len(self.languages)))
        rows = np.flatnonzero(np.diff(words.bounds))
        if len(rows):
            sums[rows] = np.add.reduceat(self.guess[words.stem % GUESS_CELLS], words.bounds[:-1][rows], axis=0)
        return sums.argmax(axis=1)

    def scores(self, words: Words) -> np.ndarray:
        shifted = self.logits(words) - self.logits_at[self.guesses(words)] + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(shifted, -30, 30)))


def _learn(sample: list[tuple[int, np.ndarray, np.ndarray]], epochs: int, rows_with: np.ndarray) -> tuple[Model, dict]:
    """A network after some epochs over the sample, and the squares of its gradients. ``rows_with``: in how many rows each hashed word is."""
    random = np.random.default_rng(4)
    width = len(SPANS) * FILTERS
    common = np.flatnonzero(rows_with >= LEAST_ROWS)
    slots = np.zeros(1 << ROW_BITS, np.int32)
    slots[common] = np.arange(1, len(common) + 1)
    table = random.normal(0, 0.1, (len(common) + 1, WIDTH)).astype(np.float32)
    table[0] = 0.0
    model = Model(
        slots, table,
        [random.normal(0, 1 / np.sqrt(span * WIDTH), (span, WIDTH, FILTERS)).astype(np.float32) for span in SPANS],
        np.zeros(width, np.float32), random.normal(0, 0.3, width).astype(np.float32), -1.0)
    past = {"table": np.zeros(len(table)), "filters": [np.zeros_like(f) for f in model.filters], "shifts": np.zeros(width), "weights": np.zeros(width), "bias": 0.0}
    _go_on(model, past, sample, epochs, random)
    return model, past


def _go_on(model: Model, past: dict, sample: list[tuple[int, np.ndarray, np.ndarray]], epochs: int, random: np.random.Generator) -> None:
    """Minibatch Adagrad. The pooled maxima let a gradient through at one place of each filter and text only."""
    slots, table = model.slots, model.table

    def step(squares, gradient):
        squares += gradient * gradient
        return RATE * gradient / np.sqrt(squares + 1e-8)

    for _ in range(epochs):
        order = random.permutation(len(sample))
        for first in range(0, len(order), BATCH):
            batch = [sample[i] for i in order[first : first + BATCH]]
            kept = [random.random(len(full)) >= DROPPED for _, full, _ in batch]
            full = np.concatenate([f[k] for (_, f, _), k in zip(batch, kept)])
            stem = np.concatenate([s[k] for (_, _, s), k in zip(batch, kept)])
            bounds = np.concatenate([[0], np.cumsum([k.sum() for k in kept])])
            labels = np.array([label for label, _, _ in batch], np.float32)
            best, at = model.pooled(full, stem, bounds)
            error = (1 / (1 + np.exp(-np.clip(best @ model.weights + model.bias, -30, 30))) - labels) / len(batch)
            flow = np.where(at >= 0, error[:, None] * model.weights, 0.0)
            to_weights = best.T @ error + DECAY * model.weights
            rows, parts = [], []
            for i, span in enumerate(SPANS):
                columns = slice(i * FILTERS, (i + 1) * FILTERS)
                text, which = np.nonzero(flow[:, columns])
                place, amount = at[:, columns][text, which], flow[:, columns][text, which]
                gradient = DECAY * model.filters[i]
                for k in range(span):
                    inside = place + k < bounds[text + 1]
                    word, f, g = place[inside] + k, which[inside], amount[inside]
                    in_full, in_stem = slots[full[word]], slots[stem[word]]
                    vectors = table[in_full] + table[in_stem]
                    np.add.at(gradient[k].T, f, g[:, None] * vectors)
                    back = g[:, None] * model.filters[i][k].T[f]
                    rows += [in_full, in_stem]
                    parts += [back, back]
                model.filters[i] -= step(past["filters"][i], gradient)
            model.shifts -= step(past["shifts"], flow.sum(axis=0)).astype(np.float32)
            if rows:
                touched, where = np.unique(np.concatenate(rows), return_inverse=True)
                total = np.zeros((len(touched), WIDTH))
                np.add.at(total, where, np.concatenate(parts))
                past["table"][touched] += (total * total).sum(axis=1)
                table[touched] -= RATE * total / np.sqrt(past["table"][touched, None] + 1e-8)
                table[0] = 0.0
            model.weights -= step(past["weights"], to_weights).astype(np.float32)
            past["bias"] += float(error.sum()) ** 2
            model.bias -= RATE * float(error.sum()) / np.sqrt(past["bias"] + 1e-8)


def _dense(model: Model, past: dict) -> np.ndarray:
    """All that is learned but the table, in one row."""
    parts = [*model.filters, *past["filters"], model.shifts, past["shifts"], model.weights, past["weights"], [model.bias], [past["bias"]]]
    return np.concatenate([np.ravel(x) for x in parts]).astype(float)


def _set_dense(model: Model, past: dict, values: np.ndarray) -> None:
    parts = [*model.filters, *past["filters"], model.shifts, past["shifts"], model.weights, past["weights"]]
    ends = np.cumsum([x.size for x in parts])
    for part, value in zip(parts, np.split(values, ends)):
        part[...] = value.reshape(part.shape)
    model.bias, past["bias"] = float(values[ends[-1]]), float(values[ends[-1] + 1])


def _pressed(full: np.ndarray, stem: np.ndarray) -> bytes:
    """The numbers of a text's words."""
    return zlib.compress(full.tobytes() + stem.tobytes(), 1)


def _unpressed(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    numbers = np.frombuffer(zlib.decompress(raw), np.int32)
    return numbers[: len(numbers) // 2], numbers[len(numbers) // 2 :]


def _averaged(model: Model, past: dict, rows: DataFrame, shards: int | None = None) -> None:
    """One round over all rows: each shard (a row of lists; single rows are dealt to ``shards`` of them) goes on from the network, which then becomes the mean of theirs. A row of the table is
    the mean over the shards that have its words: a shard names the rows it has, and gives the steps of those that it moved. They are
    added up in blocks of ``BLOCK`` rows; block -1 is the rest of the network."""
    width = WIDTH + 1
    schema = "block int, weight double, held binary, slots binary, steps binary"

    def made(block: int, weight: float = 0.0, held: bytes = b"", slots: bytes = b"", steps: bytes = b"") -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({
            "block": pa.array([block], pa.int32()), "weight": pa.array([weight], pa.float64()),
            "held": pa.array([held], pa.binary()), "slots": pa.array([slots], pa.binary()), "steps": pa.array([steps], pa.binary())})

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in map(sorted, _shards(batches)):
            sample = [(toxic, *_unpressed(words)) for _, toxic, words in found]
            net, squares = copy.deepcopy((model, past))
            _go_on(net, squares, sample, 1, np.random.default_rng(abs(found[0][0])))
            yield made(-1, len(sample), steps=(_dense(net, squares) * len(sample)).tobytes())
            own = np.zeros(len(net.table), bool)
            own[net.slots[np.unique(np.concatenate([x for _, full, stem in sample for x in (full, stem)]))]] = True
            own[0] = False
            steps = np.column_stack([net.table - model.table, squares["table"] - past["table"]]).astype(np.float32)
            for block, first in enumerate(range(0, len(own), BLOCK)):
                part = steps[first : first + BLOCK]
                moved = np.flatnonzero(own[first : first + BLOCK] & part.any(axis=1)).astype(np.int32)
                yield made(block, 0.0, np.packbits(own[first : first + BLOCK]).tobytes(), moved.tobytes(), part[moved].tobytes())

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights: dict[int, float] = {}
        sums: dict[int, np.ndarray] = {}
        times: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, weight, held, slots, steps in zip(*(batch.column(c).to_pylist() for c in batch.schema.names)):
                if block < 0:
                    weights[block] = weights.get(block, 0.0) + weight
                    sums[block] = sums.get(block, 0.0) + np.frombuffer(steps)
                    continue
                total = sums.setdefault(block, np.zeros((BLOCK, width)))
                total[np.frombuffer(slots, np.int32)] += np.frombuffer(steps, np.float32).reshape(-1, width)
                count = times.setdefault(block, np.zeros(BLOCK, np.int64))
                bits = np.unpackbits(np.frombuffer(held, np.uint8))
                count[: len(bits)] += bits
        for block, total in sums.items():
            if block < 0:
                yield made(block, steps=(total / weights[block]).tobytes())
            else:
                moved = np.flatnonzero(total.any(axis=1)).astype(np.int32)
                yield made(block, slots=moved.tobytes(), steps=(total[moved] / times[block][moved, None]).astype(np.float32).tobytes())

    learned = (rows.repartition(shards, "key") if shards else rows).select("key", "toxic", "words").mapInArrow(lean(learn), schema)
    means = learned.repartition("block").mapInArrow(lean(add), schema).toArrow()
    for block, slots, steps in zip(*(means.column(c) for c in ("block", "slots", "steps"))):
        if block.as_py() < 0:
            _set_dense(model, past, np.frombuffer(steps.as_py()).copy())
            continue
        at, step = np.frombuffer(slots.as_py(), np.int32) + block.as_py() * BLOCK, np.frombuffer(steps.as_py(), np.float32).reshape(-1, width)
        model.table[at] += step[:, :WIDTH]
        past["table"][at] += step[:, WIDTH]


def _best_threshold(logits: np.ndarray, toxic: np.ndarray, rows: np.ndarray) -> float | None:
    """The logit with the best F1, in the middle of the gap it falls into. ``rows`` and ``toxic`` count those of each logit."""
    order = np.argsort(-logits, kind="stable")
    found = np.cumsum(toxic[order])
    if not len(toxic) or not found[-1]:
        return None
    f1 = 2 * found / (np.cumsum(rows[order]) + found[-1])
    cut = int(f1.argmax())
    below = logits[order[cut + 1]] if cut + 1 < len(order) else logits[order[cut]] - 2
    return float(logits[order[cut]] + below) / 2


def _marks(labels: DataFrame) -> DataFrame:
    """doc_id and label of the rows to learn from."""
    return labels.filter(F.col("toxic").isin(0, 1) & (fold(F.col("doc_id")) != 2)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def _texts(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """toxic, lang and text of marked rows. An id that repeats gives one row, its smallest language and text."""
    rows = docs.select("doc_id", "lang", "text").filter("text is not null").join(marks, "doc_id")
    return rows.groupBy("doc_id", "toxic").agg(F.min(F.struct("lang", "text")).alias("row")).select("doc_id", "toxic", "row.*")


def _maybe_marked(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """The documents without most of those that have no mark, told by bits of the ids where they are read."""
    if docs.schema["doc_id"].dataType != marks.schema["doc_id"].dataType:  # equal ids have other hashes
        return docs
    return docs.filter(may_hold(bit_table(marks, "doc_id", BITS).scalar(), F.col("doc_id"), BITS))


def _sampled(docs: DataFrame, labels: DataFrame, sample: dict[int, int]) -> DataFrame:
    """toxic, lang and text of the rows to start from: for each label those first in the order of a hash of their id."""
    marks = _marks(labels)
    order = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id")
    most = F.when(F.col("toxic") == 1, sample[1]).otherwise(sample[0])
    few = lowest(marks.withColumn("key", F.xxhash64("doc_id")), "toxic", max(sample.values()))
    ranked = few.withColumn("rank", F.row_number().over(order))
    return _texts(docs, F.broadcast(ranked.filter(F.col("rank") <= most).select("doc_id", "toxic")))


def _numbered(texts: DataFrame, together: bool = False) -> DataFrame:
    """key, toxic, lang and the numbers of the words; ``together``: lists of them, a row of those set ``aside`` and one of the others for each task."""
    names = ["key", "toxic", "lang", "words"]

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = 0
            for chunk in in_chunks(t.as_py().encode() for t in batch.column("text")):
                words = Words([t.decode() for t in chunk])
                pressed = [_pressed(words.full[a:b], words.stem[a:b]) for a, b in zip(words.bounds, words.bounds[1:])]
                rest = [batch.column(c).slice(place, len(chunk)) for c in names[:3]]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(pressed, pa.binary())], names)
                place += len(chunk)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = list(numbered(batches))
        if not made:
            return
        whole = pa.concat_batches(made)
        aside = whole.column("key").to_numpy() % 5 == 4
        for kind in (False, True):
            part = whole.filter(pa.array(aside == kind))
            if part.num_rows:
                ends = pa.array([0, part.num_rows], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([kind]), *(pa.ListArray.from_arrays(ends, part.column(c)) for c in names)], ["aside", *names])

    picked = texts.select(F.xxhash64("doc_id").alias("key"), F.col("toxic").cast("int"), F.col("lang").cast("string"), "text")
    if together:
        return picked.mapInArrow(lean(listed), "aside boolean, key array<bigint>, toxic array<int>, lang array<string>, words array<binary>")
    return picked.mapInArrow(lean(numbered), "key bigint, toxic int, lang string, words binary")


def _sharded(docs: DataFrame, marks: DataFrame, shards: int) -> DataFrame:
    """The marked rows as lists, a row of those set aside and one of the others for each shard. Each text is shuffled once, to the shard that it stays in: texts and marks meet
    there, and each round reads a shard as it is. An id that repeats gives one row, its smallest language and text."""
    texts = _maybe_marked(docs, marks).filter("doc_id is not null and text is not null")
    texts = texts.select("doc_id", F.lit(None).cast("int").alias("toxic"), F.struct("lang", "text").alias("row"))
    ids = marks.select("doc_id", F.col("toxic").cast("int").alias("toxic"), F.lit(None).cast(texts.schema["row"].dataType).alias("row"))
    met = texts.union(ids).withColumn("key", F.xxhash64("doc_id")).repartition(shards, "key").groupBy("key", "doc_id").agg(
        F.max("toxic").alias("toxic"), F.min("row").alias("row")).filter("toxic is not null and row is not null")
    return _numbered(met.select("doc_id", "toxic", "row.*"), together=True)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The values of each row of lists, side by side; single rows of a task are one shard."""
    single = []
    for batch in batches:
        if not pa.types.is_list(batch.schema.field("words").type):
            single += zip(*(c.to_pylist() for c in batch.columns))
            continue
        for row in range(batch.num_rows):
            yield list(zip(*(c[row].as_py() for c in batch.columns)))
    if single:
        yield single


def _tallies(rows: DataFrame, languages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """How many rows not set aside hold each hashed word or stem, and how often each cell of the guess occurs in each language; over all rows."""
    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, cells = np.zeros(1 << ROW_BITS, np.int64), np.zeros((len(languages), GUESS_CELLS), np.int64)
        for batch in batches:
            for aside, found in zip(batch.column("aside").to_pylist(), _shards([batch.select(["lang", "words"])])):
                for lang, words in found:
                    full, stem = _unpressed(words)
                    if not aside:
                        held[np.union1d(full, stem)] += 1
                    if lang is not None:
                        cells[languages.index(lang)] += np.bincount(stem % GUESS_CELLS, minlength=GUESS_CELLS)
        for kind, counts in enumerate([held, *cells], -1):
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), kind), pa.int32()), pa.array(at, pa.int32()), pa.array(counts[at])], ["kind", "at", "n"])

    counted = rows.mapInArrow(lean(tally), "kind int, at int, n bigint").groupBy("kind", "at").agg(F.sum("n").alias("n")).toArrow()
    kind, at, n = (counted[c].to_numpy() for c in ("kind", "at", "n"))
    held, cells = np.zeros(1 << ROW_BITS, np.int64), np.zeros((GUESS_CELLS, max(1, len(languages))), np.int64)
    held[at[kind < 0]] = n[kind < 0]
    cells[at[kind >= 0], kind[kind >= 0]] = n[kind >= 0]
    return held, cells


def _thresholds(rows: DataFrame, model: Model) -> np.ndarray:
    """The threshold of each language, from how many of the rows have each logit."""
    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _shards(batches):
            for toxic, pressed in found:
                words = Words.__new__(Words)
                words.full, words.stem = _unpressed(pressed)
                words.bounds = np.array([0, len(words.full)])
                place = np.rint(np.clip(model.logits(words), -60, 60) * STEPS).astype(int)
                yield pa.RecordBatch.from_arrays([
                    pa.array(model.guesses(words), pa.int32()), pa.array(place, pa.int32()), pa.array([toxic], pa.int32())], ["guess", "place", "toxic"])

    cells = rows.select("toxic", "words").mapInArrow(lean(weighed), "guess int, place int, toxic int").groupBy("guess", "place").agg(
        F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("rows")).orderBy("guess", "place").toArrow()
    guess, place, toxic, n = (cells[c].to_numpy() for c in ("guess", "place", "toxic", "rows"))
    places, where = np.unique(place, return_inverse=True)
    shared = _best_threshold(places / STEPS, np.bincount(where, toxic, len(places)), np.bincount(where, n, len(places)))
    found = [
        _best_threshold(place[part] / STEPS, toxic[part], n[part]) if toxic[part].sum() >= LEAST_TOXIC else None
        for part in (guess == i for i in range(len(model.languages)))
    ]
    return np.array([t if t is not None else shared or 0.0 for t in found])


def train(
    docs: DataFrame, labels: DataFrame, sample: dict[int, int] = SAMPLE, epochs: int = EPOCHS, shard: int = SHARD, rounds: int = ROUNDS,
) -> Model | None:
    small_batches(docs.sparkSession)
    with scratch(docs.sparkSession) as keep:
        marks = _marks(labels)
        texts = _maybe_marked(docs, marks).filter("text is not null").select("doc_id").distinct()
        if docs.schema["doc_id"].dataType != marks.schema["doc_id"].dataType:
            marks = texts.join(marks, "doc_id")  # ids as the documents have them
        sizes = {int(r.toxic): r.n for r in texts.join(marks, "doc_id").groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
        if len(sizes) < 2:
            return None
        rows = keep(_sharded(docs, marks, -(-sum(sizes.values()) // shard)))
        languages = sorted(r.lang for r in rows.select(F.explode("lang").alias("lang")).filter("lang is not null").distinct().collect()) or [""]
        held, cells = _tallies(rows, languages)
        found = _numbered(_sampled(docs, labels, sample)).filter(F.pmod("key", F.lit(5)) != 4).toArrow()
        unpressed = sorted((
            (key, toxic, lang or "", *_unpressed(words)) for key, toxic, lang, words in zip(*(c.to_pylist() for c in found.columns))
        ), key=lambda r: (*r[:3], r[3].tobytes()))
        first = [(toxic, full, stem) for _, toxic, _, full, stem in unpressed]
        model, past = _learn(first, epochs, held)
        if any(n > sample[toxic] for toxic, n in sizes.items()):
            for _ in range(rounds):
                _averaged(model, past, rows.filter("not aside"))
        model.languages = languages
        model.guess = np.log((cells + 1) / (cells + 1).sum(axis=0)).astype(np.float32)
        model.logits_at = _thresholds(rows.filter("aside"), model)
        return model


def score(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",), into: str = "score") -> DataFrame:
    """Columns ``keep`` of every row with its score, named ``into``."""
    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values: list[float] = []
            if model is None:
                values = [0.0] * batch.num_rows
            else:
                for chunk in in_chunks((t.as_py() or "").encode() for t in batch.column("text")):
                    values += model.scores(Words([t.decode() for t in chunk])).astype(float).tolist()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(values, pa.float64())], [*keep, into])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    source = docs.select(*keep, *(["text"] if "text" not in keep else []))
    return source.mapInArrow(lean(scores), f"{kinds}, `{into}` double")


def toxicity(docs: DataFrame, labels: DataFrame, sample: dict[int, int] = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    held = F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False))
    scored = score(docs, train(docs, labels, sample))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
