"""Packing of whole documents into sequences by non-negative least squares over a length histogram.

A document's ids are those of the tokenizers library, followed by one end id. Full windows of ``WINDOW`` ids are
sequences of their own; what remains of a document is a piece of 1 to ``WINDOW`` - 1 ids. Pieces are counted by
their length in units of ``UNIT`` ids. All ways to fill a window with up to ``DEPTH`` lengths are enumerated,
and a non-negative least-squares fit finds how often to use each, so that the histogram is used up. The fit is
rounded down. The pieces left over are laid end to end, longest first, and cut where a window is full: each window
but the very last one is filled, up to the last partial unit of a piece.

The driver sees the histogram and the plan only; both have a size fixed by ``WINDOW / UNIT``. A piece finds its
sequence by its rank among the pieces of its length, counted in ``SALTS`` shares, so that one common length is
not one task. Ids leave the tokenizing task as checksums of prefixes, one every ``UNIT`` ids; the checksum of any
range follows from two of them.

Defined cases: a null or empty text is the end id alone; rows are packed one by one, so repeated rows and
repeated or null ids each get their pieces; ties between equal lengths are put in order by id; an empty table
gives an empty result.
"""

from __future__ import annotations

import os
import re
import string
import zlib
from array import array
from collections.abc import Iterator
from itertools import filterfalse

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType
from tokenizers import Tokenizer

from newsignal.llm.batches import lean, small_batches
from newsignal.session import durable

WINDOW = 4096
UNIT = 16
UNITS = WINDOW // UNIT
DEPTH = 3
SALTS = 64
SWEEPS = 60
END_ID = 2
#: Words whose ids a worker keeps: some 60 MB.
MOST_WORDS = 250_000
#: Rows whose new words are looked up together, and words of one call of the library.
PART = 512
TOGETHER = 1_000
WORD_END = "</w>"
#: Marks that are no letters, digits or blanks.
MARKS = "".join(set(string.punctuation) - {"<"})
#: Marks that end a word of letters; the tokenizer parts them from it.
END_MARKS = re.compile(rf"[{re.escape(MARKS)}](?<=[A-Za-zªµºÀ-ÖØ-öø-ÿ].)[{re.escape(MARKS)}]*(?=\s|\Z)")


class WordIds(dict):
    """Ids of words as little-endian 32-bit numbers, asked from the library once for each word, many words at a time.

    The tokenizer drops white space and no piece of it spans any, so a text's ids are those of its
    parts between blanks and line ends.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        # The model alone cuts words of ASCII letters in lower case, unless an added token may lie within them.
        self.letters_alone = not any(token.content.isalpha() for token in self.tokenizer.get_added_tokens_decoder().values())
        self.ends_word = np.array([(self.tokenizer.id_to_token(i) or "").endswith(WORD_END) for i in range(size)])

    @staticmethod
    def _parts(word: str) -> list[str]:
        """What the library is asked for: words in lower case, which it puts all in, without the marks at the end that it parts from letters."""
        if "<" in word:  # a special token, perhaps
            return [word]
        plain = word.lower() if word.isascii() else word
        head = plain.rstrip(MARKS)
        if len(head) < len(plain) and head[-1:].lower().isalpha():
            return [head, plain[len(head):]]
        return [plain]

    def _unknown(self, words: set[str]) -> set[str]:
        """Looks up each of the words; ``words - self.keys()`` would go through all that is known, for every few rows."""
        return set(filterfalse(self.__contains__, words))

    def learn(self, words: set[str]) -> None:
        """Takes up all words that are not known yet."""
        new = self._unknown(words)
        plain = {word for word in new if word.isascii() and word.islower() and word.isalpha()}  # letters only, one piece each
        others = [(word, self._parts(word)) for word in new - plain]
        asked = self._unknown({part for _, parts in others for part in parts}) - plain
        plain.update([part for part in asked if part.isalpha() and part.lower().isalpha()])
        direct = {word for word in plain if word.isascii()} if self.letters_alone else set()
        model = self.tokenizer.model
        for word in direct:
            self[word] = array("I", [piece.id for piece in model.tokenize(word)]).tobytes()
        together = list(plain - direct)
        for first in range(0, len(together), TOGETHER):
            self._ask_together(together[first : first + TOGETHER])
        self._ask(list(asked - plain))
        for word, parts in others:
            if len(parts) > 1 or parts[0] != word:
                self[word] = b"".join([self[part] for part in parts])

    def _ask(self, words: list[str]) -> None:
        for word, found in zip(words, self.tokenizer.encode_batch_fast(words, add_special_tokens=False)):
            self[word] = array("I", found.ids).tobytes()

    def _ask_together(self, words: list[str]) -> None:
        """Words of letters only are one piece of a text each, so each ends at the next id that ends a word."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        ends = (np.flatnonzero(self.ends_word[ids]) + 1) * 4
        if len(ends) != len(words):
            self._ask(words)
            return
        flat, ends = ids.tobytes(), ends.tolist()
        self.update(zip(words, (flat[a:b] for a, b in zip([0, *ends], ends))))

    @staticmethod
    def _plain(text: str) -> str:
        """The text with the same ids and few different words: marks at the end stand alone, Latin letters are in lower case."""
        if "<" in text:  # a special token, perhaps
            return text.replace("\n", " ")
        try:
            text.encode("latin-1")
            text = text.lower()  # letter by letter, as the tokenizer does; other scripts have letters that depend on their neighbours
        except UnicodeEncodeError:
            pass
        return END_MARKS.sub(r" \g<0>", text).replace("\n", " ")

    def of(self, texts: list[str]) -> list[bytes]:
        """Ids of each text: every different word is looked up once, its ids are copied to all its places."""
        cut = pc.split_pattern(pa.array(map(self._plain, texts), pa.large_string()), " ")
        coded = cut.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = list(map(self.get, words))
        new = {word for word, ids in zip(words, known) if ids is None}
        if len(self) + len(new) > MOST_WORDS:  # those of these texts stay
            self.clear()
            self.update((word, ids) for word, ids in zip(words, known) if ids is not None)
        self.learn(new)
        known = [self[word] if ids is None else ids for word, ids in zip(words, known)]
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        firsts, places = np.cumsum(sizes) - sizes, coded.indices.to_numpy()
        counts = sizes[places]
        ends = np.concatenate([[0], np.cumsum(counts)])
        shift = np.repeat(firsts[places] - ends[:-1], counts)
        ids = np.frombuffer(b"".join(known), "<u4")[shift + np.arange(len(shift))]
        bounds = ends[cut.offsets.to_numpy()]
        return [ids[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]


_words: dict[str, WordIds] = {}


def prefix_sums(ids: bytes) -> list[int]:
    """CRC-32 of the first 0, UNIT, 2 UNIT, … ids, and of all."""
    sums, step, view = [0], 4 * UNIT, memoryview(ids)
    for at in range(0, len(ids), step):
        sums.append(zlib.crc32(view[at : at + step], sums[-1]))
    return sums


def tokenized(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, doc_tokens and the checksums of prefixes (unsigned, in signed 64-bit numbers)."""
    end = np.array([end_id], "<u4").tobytes()

    small_batches(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words.setdefault(tokenizer, None) or WordIds(tokenizer)
        _words[tokenizer] = words
        for batch in batches:
            for part in (batch.slice(i, PART) for i in range(0, batch.num_rows, PART)):
                counts, sums, places = [], array("q"), [0]
                for ids in words.of([text or "" for text in part.column("text").to_pylist()]):
                    ids += end
                    counts.append(len(ids) // 4)
                    sums.extend(prefix_sums(ids))
                    places.append(len(sums))
                lists = pa.ListArray.from_arrays(np.array(places, np.int32), np.frombuffer(sums, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(counts, pa.int64()), lists], ["doc_id", "doc_tokens", "sums"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lean(encode), f"doc_id {kind}, doc_tokens bigint, sums array<bigint>")


def combinations(units: int = UNITS, depth: int = DEPTH) -> np.ndarray:
    """All ways to write ``units`` as a sum of at most ``depth`` lengths; unused places are 0."""
    rows: list[list[int]] = [[]]
    for left in range(depth, 0, -1):
        grown = []
        for row in rows:
            rest, least = units - sum(row), row[-1] if row else 0
            parts = [rest] if left == 1 else range(least, rest + 1)
            grown += [[*row, part] for part in parts if part >= least]
        rows = grown
    return np.array(rows, np.int64).reshape(-1, depth)


def fit(histogram: np.ndarray, ways: np.ndarray, sweeps: int = SWEEPS) -> np.ndarray:
    """Non-negative least squares by coordinate descent: how often to use each way, to match the histogram.

    Each step sets one count to its best value of at least 0, the others held; the squared error never grows.
    """
    rest = [0.0, *map(float, histogram)]
    columns = [[(p, parts.count(p)) for p in set(parts) if p] for parts in map(tuple, ways.tolist())]
    norms = [sum(times * times for _, times in column) for column in columns]
    repeats = [0.0] * len(columns)
    for _ in range(sweeps):
        moved = 0.0
        for i, column in enumerate(columns):
            step = sum(times * rest[p] for p, times in column) / norms[i]
            step = max(step, -repeats[i])
            if step:
                repeats[i] += step
                moved = max(moved, abs(step))
                for p, times in column:
                    rest[p] -= times * step
        if moved < 0.01:
            break
    return np.array(repeats)


def plan(histogram: np.ndarray) -> tuple[list[tuple], np.ndarray, int]:
    """Intervals (length, first rank, end rank, first sequence, place), covered ranks, sequences used."""
    ways = combinations()
    repeats = fit(histogram, ways)
    left = np.concatenate([[0], histogram.astype(np.int64)])
    used = np.zeros(len(left), np.int64)
    intervals, sequences = [], 0
    for way in np.argsort(-repeats, kind="stable"):
        parts = [int(p) for p in ways[way] if p]
        times = min([int(repeats[way] + 1e-6), *(int(left[p]) // parts.count(p) for p in parts)])
        if times <= 0:
            continue
        for place, part in enumerate(sorted(parts, reverse=True)):
            intervals.append((part, int(used[part]), int(used[part]) + times, sequences, place))
            used[part] += times
            left[part] -= times
        sequences += times
    return intervals, used, sequences


def _powers() -> np.ndarray:
    """Tables of the operators that append 1, 2, 4, … zero bytes to a CRC-32: [power, byte, value]."""
    one = np.array([zlib.crc32(b"\0", 1 << k) ^ zlib.crc32(b"\0", 0) for k in range(32)], np.uint64)

    def table(basis):
        out = np.zeros((4, 256), np.uint64)
        for byte in range(4):
            for bit in range(8):
                out[byte] ^= np.where(np.arange(256) >> bit & 1, basis[8 * byte + bit], np.uint64(0))
        return out

    tables = []
    for _ in range(20):
        now = table(one)
        tables.append(now)
        one = _apply(now, one)
    return np.array(tables)


def _apply(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values), np.uint64)
    for byte in range(4):
        out ^= table[byte][(values >> np.uint64(8 * byte) & np.uint64(255)).astype(np.int64)]
    return out


@F.pandas_udf(LongType())
def range_sum(before: pd.Series, upto: pd.Series, length: pd.Series) -> pd.Series:
    """CRC-32 of the bytes between two prefixes, from the checksums of the prefixes."""
    shifted, size = before.to_numpy().astype(np.uint64), length.to_numpy()
    for power, table in enumerate(_powers()):
        rows = (size >> power & 1).astype(bool) & (shifted != 0)
        shifted[rows] = _apply(table, shifted[rows])
    return pd.Series((shifted ^ upto.to_numpy().astype(np.uint64)).astype(np.int64))


def _ranked(pieces: DataFrame) -> DataFrame:
    """``rank`` of every piece among those of its length, from 0, in order of share, id and checksum."""
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(SALTS)))
    shares = salted.groupBy("units", "salt").agg(F.count(F.lit(1)).alias("share"))
    before = Window.partitionBy("units").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = shares.select("units", "salt", F.coalesce(F.sum("share").over(before), F.lit(0)).alias("first"))
    order = Window.partitionBy("units", "salt").orderBy("doc_id", "start", "doc_tokens", F.col("sums")[0], F.element_at("sums", -1))
    ranked = salted.withColumn("place", F.row_number().over(order))
    # (UNITS + 1) * SALTS rows at most.
    return ranked.join(F.broadcast(firsts), ["units", "salt"]).withColumn("rank", F.col("first") + F.col("place") - 1)


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    ids = durable(spark, tokenized(docs, tokenizer))
    full = F.floor(F.col("doc_tokens") / WINDOW).cast("bigint")
    starts = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("doc_tokens") - 1) / WINDOW).cast("bigint"))
    length = F.least(F.lit(WINDOW).cast("bigint"), F.col("doc_tokens") - F.col("start"))
    up = lambda tokens: F.ceil(tokens / UNIT).cast("int")
    first = (F.col("start") / UNIT).cast("int") + 1
    whole = F.col("length") == WINDOW
    pieces = ids.select("doc_id", "doc_tokens", "sums", F.explode(starts).alias("window")).withColumn(
        "start", F.col("window") * WINDOW).withColumn("length", length).select(
        "doc_id", "doc_tokens", "start", "length",
        F.when(whole, 0).otherwise(up(F.col("length"))).alias("units"),
        F.when(whole, F.array(F.element_at("sums", first), F.element_at("sums", first + UNITS)))
        .otherwise(F.slice("sums", first, up(F.col("length")) + 1)).alias("sums"),
    )
    counted = dict(pieces.groupBy("units").count().collect())  # UNITS + 1 rows at most
    intervals, used, sequences = plan(np.array([counted.get(u, 0) for u in range(1, UNITS + 1)]))
    # Full windows come first, then the fitted sequences, then the stream of the rest.
    windows = counted.get(0, 0)
    rest, at = [], 0
    for u in range(UNITS, 0, -1):
        rest.append((u, int(used[u]), at))
        at += (counted.get(u, 0) - int(used[u])) * u
    fitted = spark.createDataFrame(
        [(0, 0, windows, 0, 0)] + [(u, a, b, s + windows, p) for u, a, b, s, p in intervals],
        "units int, low bigint, high bigint, first_sequence bigint, at int")
    stream = spark.createDataFrame(rest, "units int, covered bigint, base bigint")
    placed = _ranked(pieces).join(F.broadcast(stream), "units", "left").drop("first", "place", "salt")
    in_plan = placed.filter((F.col("units") == 0) | (F.col("rank") < F.col("covered")))
    hit = F.broadcast(fitted).withColumnRenamed("units", "of")
    fixed = in_plan.join(hit, (F.col("units") == F.col("of")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))).select(
        "doc_id", "start", "length", "doc_tokens",
        F.element_at("sums", 1).alias("before"), F.element_at("sums", -1).alias("upto"),
        (F.col("first_sequence") + F.col("rank") - F.col("low")).alias("sequence_id"), F.col("at").cast("bigint").alias("at"),
    )
    begin = F.col("base") + (F.col("rank") - F.col("covered")) * F.col("units")
    room = (UNITS - F.col("begin") % UNITS).cast("int")
    cuts = F.when(F.col("units") > room, F.array(
        F.struct(F.lit(0).alias("a"), room.alias("b")), F.struct(room.alias("a"), F.col("units").alias("b")),
    )).otherwise(F.array(F.struct(F.lit(0).alias("a"), F.col("units").alias("b"))))
    a, b = F.col("cut.a"), F.col("cut.b")
    laid = placed.filter("units > 0 and rank >= covered").withColumn("begin", begin).withColumn(
        "cut", F.explode(cuts)).select(
        "doc_id", (F.col("start") + a * UNIT).alias("start"),
        (F.least(b.cast("bigint") * UNIT, F.col("length")) - a * UNIT).alias("length"), "doc_tokens",
        F.element_at("sums", a + 1).alias("before"), F.element_at("sums", b + 1).alias("upto"),
        (F.floor((F.col("begin") + a) / UNITS).cast("bigint") + windows + sequences).alias("sequence_id"),
        (F.col("begin") + a).alias("at"),
    )
    inside = Window.partitionBy("sequence_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    placed = fixed.unionByName(laid).withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)))
    checksum: Column = range_sum("before", "upto", F.col("length") * 4)
    return placed.select("doc_id", "start", "length", checksum.alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
