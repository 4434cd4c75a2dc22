"""Alignment of two tokenizations of the same text, and how often their ids meet in the corpus.

Both tokenizers cut the bytes of a blank and the text. Every token points to its farthest-right overlapping token: the token of
the other side that holds its last byte, if that one ends later; tokens that end where the other side ends too are terminal. All
pointers are doubled at once (a token's successor becomes the successor's successor) until nothing moves; then each
token points to the terminal token of its component. These components are the groups between bytes where both sides end a
token. Pointers are numbers in one array for many texts, so that a step is one numpy lookup.

A token of the one side and a token of the other are linked if they share a group. Links of a document are kept as distinct id
pairs with the number of times they occur. How many documents hold a pair is counted over the whole corpus. The pairs held
most often go to all workers, at most ``HEAD`` of them whatever the corpus; so common pairs never meet in one task.
Documents shuffle only the rarer pairs, which are looked up in the table of counts by a join.

Defined cases: a null or empty text, or one that either side does not give back byte by byte, has no tokens; its
counts are 0 and its alignment is empty; equal counts are all the highest; repeated rows are documents of their own, and so are rows with repeated or null
ids; an empty table gives an empty result; other columns are ignored unless they are asked for.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsignal.llm.hashing import in_chunks
from newsignal.llm.naming import extended, unused
from newsignal.session import durable

#: Pairs that every worker gets: a few megabytes.
HEAD = 200_000
#: Parts of texts whose ids a worker keeps.
MOST_PARTS = 500_000
_BLANK = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Fixed value: where byte-level tokenizers part a text before they merge.
PARTS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_BLANK}\p{{L}}\p{{N}}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+"
#: Steps of the scale of counts for each doubling, to find how many pairs the head may take.
STEPS = 8


class ByteLevel:
    """A byte-level tokenizer from a .json file of the tokenizers library; it gets a blank before the text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        plain = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace() and b != 0xAD]
        letters = {chr(b): b for b in plain}
        letters |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
        names = (self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size()))
        self.bytes = [bytes(letters[c] for c in name) if all(c in letters for c in name) else name.encode() for name in names]

        self.ids: dict[str, list[int]] = {}
        splits = self.tokenizer.normalizer is None and isinstance(self.tokenizer.pre_tokenizer, pre_tokenizers.ByteLevel)
        #: The tokenizer never merges across these parts, so each is asked for once.
        self.part = regex.compile(PARTS) if splits else None

    def __call__(self, texts: list[str]) -> list[list[int]]:
        if self.part is None:
            return self._asked([" " + t for t in texts])
        cut = [self.part.findall(" " + t) for t in texts]
        known = self.ids
        if len(known) > MOST_PARTS:
            known.clear()
        new = list(set().union(*cut) - known.keys())
        known.update(zip(new, self._asked(new)))
        return [list(chain.from_iterable(map(known.__getitem__, parts))) for parts in cut]

    def _asked(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class Pieces:
    """A sentencepiece model; it puts the blank before the text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [
            bytes([int(name[3:5], 16)]) if self.model.is_byte(i) else name.replace("▁", " ").encode() for i, name in enumerate(names)]

    def __call__(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


_sides: dict[str, ByteLevel | Pieces] = {}


def _side(path: str) -> ByteLevel | Pieces:
    """One for each worker process and file."""
    if path not in _sides:
        _sides[path] = (ByteLevel if path.endswith(".json") else Pieces)(path)
    return _sides[path]


def terminals(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every token of both sides (increasing ends, the last ones equal): the b token that ends its component."""
    n = len(ends_a)
    after_a = np.searchsorted(ends_b, ends_a)  # the b token that holds a token's last byte
    after_b = np.searchsorted(ends_a, ends_b)
    own = np.arange(n, n + len(ends_b))
    successor = np.concatenate([after_a + n, np.where(ends_a[after_b] == ends_b, own, after_b)]) if n else own
    while True:
        further = successor[successor]
        if np.array_equal(further, successor):
            return successor[:n] - n, successor[n:] - n
        successor = further


def groups_of(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the groups, from left to right, of the tokens of both sides."""
    last_a, last_b = terminals(ends_a, ends_b)
    number = np.zeros(len(ends_b), np.int64)
    number[last_b] = 1
    number = np.cumsum(number) - 1
    return number[last_a], number[last_b]


class Aligned:
    """Several texts with the tokens of both sides."""

    def __init__(self, texts: list[str | None], a: ByteLevel | Pieces, b: ByteLevel | Pieces):
        given = [i for i, t in enumerate(texts) if t]
        sides = [side([texts[i] for i in given]) for side in (a, b)]
        self.texts, self.sizes = len(texts), (len(a.bytes), len(b.bytes))
        ids: list[list[list[int]]] = [[[] for _ in texts] for _ in sides]
        for place, i in enumerate(given):
            whole = (" " + texts[i]).encode()
            if all(b"".join([side.bytes[t] for t in found[place]]) == whole for side, found in zip((a, b), sides)):
                for mine, found in zip(ids, sides):
                    mine[i] = found[place]
        lengths = [np.array([len(x) for x in side.bytes], np.int64) for side in (a, b)]
        self.counts = [np.array([len(x) for x in mine], np.int64) for mine in ids]
        self.ids = [np.array([t for x in mine for t in x], np.int64) for mine in ids]
        self.group = groups_of(*(np.cumsum(size[x]) for size, x in zip(lengths, self.ids)))
        self.bounds = [np.concatenate([[0], np.cumsum(n)]) for n in self.counts]
        #: Groups before each text.
        groups = int(self.group[1][-1]) + 1 if len(self.group[1]) else 0
        self.groups = np.append(self.group[1], groups)[self.bounds[1]]

    def alignments(self) -> list[str]:
        """Ids of each text's groups: ``a1,a2|b1;a3|b2,b3``."""
        n = len(self.ids[0])
        place = np.concatenate([self.group[0] * 2, self.group[1] * 2 + 1])
        order = np.argsort(place, kind="stable")
        place = place[order]
        last = np.append(place[1:] != place[:-1], True) if len(place) else np.empty(0, bool)
        mark = np.where(last, 1 + (order >= n), 0)
        ids = np.concatenate(self.ids)[order]
        text_ends = np.cumsum(self.counts[0] + self.counts[1])
        mark[text_ends[text_ends > 0] - 1] = 3
        parts = _marked(max(self.sizes))[mark, ids].tolist()
        return ["".join(parts[i:j]) for i, j in zip([0, *text_ends.tolist()], text_ends.tolist())]

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, id pair (a * number of b's ids + b) and times of every distinct linked pair of a text, in order."""
        (group_a, id_a, times_a), (group_b, id_b, times_b) = (
            _distinct(group, ids, size) for group, ids, size in zip(self.group, self.ids, self.sizes))
        first = np.searchsorted(group_b, group_a)
        others = np.searchsorted(group_b, group_a, "right") - first
        left = np.repeat(np.arange(len(group_a)), others)
        right = np.arange(len(left)) - np.repeat(np.cumsum(others) - others, others) + first[left]
        text = np.searchsorted(self.groups, group_a[left], "right") - 1
        span = self.sizes[0] * self.sizes[1]
        key = text * span + id_a[left] * self.sizes[1] + id_b[right]
        order = np.argsort(key, kind="stable")
        key, times = key[order], (times_a[left] * times_b[right])[order]
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
        return key[new] // span, key[new] % span, np.add.reduceat(times, new) if len(new) else times


def _distinct(group: np.ndarray, ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, times = np.unique(group * size + ids, return_counts=True)
    return keys // size, keys % size, times


_marks: dict[int, np.ndarray] = {}


def _marked(size: int) -> np.ndarray:
    """Every id as text with what may follow it."""
    if size not in _marks:
        _marks[size] = np.array([[f"{i}{mark}" for i in range(size)] for mark in (",", "|", ";", "")], object)
    return _marks[size]


def _list(kind: str) -> pa.DataType:
    return pa.list_(pa.int32() if kind == "int" else pa.int64())


def pair_kind(a: str, b: str) -> str:
    """Type of an id pair: small vocabularies fit into 32 bits."""
    return "int" if len(_side(a).bytes) * len(_side(b).bytes) < 1 << 31 else "bigint"


def align(docs: DataFrame, columns: tuple[str, ...], a: str, b: str, text: str = "text") -> DataFrame:
    """columns, n_a, n_b, n_groups, n_links, alignment (``a1,a2|b1;a3|b2,b3``), pairs (distinct linked id pairs) and times.

    ``a`` and ``b`` are paths of tokenizer files: .json for byte-level ones, .model for sentencepiece.
    """
    kind = pair_kind(a, b)
    made = {"n_a": "bigint", "n_b": "bigint", "n_groups": "bigint", "n_links": "bigint", "alignment": "string",
            "pairs": f"array<{kind}>", "times": "array<bigint>"}
    if clash := {*columns} & {*made, "_text"}:
        raise ValueError(f"columns named like those of the result: {sorted(clash)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = _side(a), _side(b)
        for batch in batches:
            at = 0
            for chunk in in_chunks((t.as_py() or "").encode() for t in batch.column("_text")):
                found = Aligned([t.decode() for t in chunk], *sides)
                owner, pairs, times = found.links()
                places = np.searchsorted(owner, np.arange(len(chunk) + 1)).astype(np.int32)
                n_links = np.diff(np.concatenate([[0], np.cumsum(times)])[places])
                lists = [pa.ListArray.from_arrays(places, pa.array(x, t.value_type)) for x, t in ((pairs, _list(kind)), (times, _list("bigint")))]
                kept = [batch.column(k).slice(at, len(chunk)) for k in range(len(columns))]
                numbers = [*found.counts, np.diff(found.groups), n_links]
                yield pa.RecordBatch.from_arrays(
                    [*kept, *(pa.array(x, pa.int64()) for x in numbers), pa.array(found.alignments(), pa.string()), *lists], [*columns, *made])
                at += len(chunk)

    added = ", ".join(f"{name} {type_}" for name, type_ in made.items())
    return docs.select(*columns, F.col(text).alias("_text")).mapInArrow(run, extended(docs, columns, added))


def pair_counts(aligned: DataFrame, b_size: int) -> DataFrame:
    """pair, n (documents that hold it) and best (no pair with the same a id has more) of every linked pair."""
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    first = F.floor(F.col("pair") / b_size).cast("int").alias("a")
    most = counts.groupBy(first).agg(F.max("n").alias("most"))  # one row for each id of a, at most
    return counts.withColumn("a", first).join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _head(counts: DataFrame, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """pair, n and best of the most frequent pairs, at most ``rows``, in order of pair."""
    step = F.floor(F.log2("n") * STEPS).cast("int")
    sizes = counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect()  # 64 * STEPS rows at most
    least, total = None, 0
    for size in sizes:
        total += size["count"]
        if total > rows:
            break
        least = size["step"]
    if least is None:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    table = counts.filter(step >= least).toArrow()
    pair, n, best = (table.column(c).to_numpy() for c in ("pair", "n", "best"))
    order = np.argsort(pair)
    return pair[order].astype(np.int64), n[order], best[order].astype(bool)


def _with_head(aligned: DataFrame, head: tuple, columns: list[str]) -> DataFrame:
    """columns, n_best and count_sum over the links in the head, and the pairs that are not in it with their times."""
    shared = aligned.sparkSession.sparkContext.broadcast(head)
    kind = aligned.schema["pairs"].dataType.simpleString()

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, is_best = shared.value
        for batch in batches:
            pairs, times = batch.column("pairs"), batch.column("times")
            sizes = np.diff(pairs.offsets.to_numpy())
            keys, often = pairs.flatten().to_numpy(zero_copy_only=False), times.flatten().to_numpy(zero_copy_only=False)
            at = np.searchsorted(known, keys)
            there = np.zeros(len(keys), bool) if not len(known) else known[np.minimum(at, len(known) - 1)] == keys
            at = np.where(there, at, 0)
            bounds = np.concatenate([[0], np.cumsum(sizes)])

            def total(values: np.ndarray) -> pa.Array:
                return pa.array(np.diff(np.concatenate([[0], np.cumsum(np.where(there, values, 0))])[bounds]), pa.int64())

            zeros = np.zeros(len(keys), np.int64)
            n_best = total(often * is_best[at] if len(known) else zeros)
            count_sum = total(often * counts[at] if len(known) else zeros)
            rest = np.concatenate([[0], np.cumsum(~there)])[bounds].astype(np.int32)
            lists = [pa.ListArray.from_arrays(rest, pa.array(x[~there])) for x in (keys, often)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), n_best, count_sum, *lists], [*columns, "n_best", "count_sum", "pairs", "times"])

    schema = extended(aligned, columns, f"n_best bigint, count_sum bigint, pairs {kind}, times array<bigint>")
    return aligned.select(*columns, "pairs", "times").mapInArrow(look_up, schema)


def corpus_links(spark: SparkSession, aligned: DataFrame, columns: tuple[str, ...], b_size: int, head: int = HEAD) -> DataFrame:
    """columns, n_best and count_sum of every row of ``aligned``: its links whose pair is the most frequent one of its a id,
    and the sum of the counts of all its links."""
    row, = unused(columns, "row")
    whole = durable(spark, aligned.select(*columns, F.monotonically_increasing_id().alias(row), "pairs", "times"))
    counts = durable(spark, pair_counts(whole, b_size))
    placed = _with_head(whole, _head(counts, head), [*columns, row])
    rare = placed.select(row, F.explode(F.arrays_zip("pairs", "times")).alias("link")).select(row, F.col("link.pairs").alias("pair"), "link.times")
    sums = rare.join(counts, "pair").groupBy(row).agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("rare_best"), F.sum(F.col("times") * F.col("n")).alias("rare_sum"))
    add = lambda one, other: (F.col(one) + F.coalesce(other, F.lit(0))).alias(one)
    return placed.drop("pairs", "times").join(sums, row, "left").select(
        *columns, add("n_best", "rare_best"), add("count_sum", "rare_sum"))


def alignment_report(spark: SparkSession, docs: DataFrame, a: str, b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    digest = F.when(F.col("alignment") != "", F.sha2("alignment", 256)).otherwise(F.lit("")).alias("groups_sha256")
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links")
    aligned = align(docs, ("doc_id",), a, b).select(*names, digest, "pairs", "times")
    found = corpus_links(spark, aligned, (*names, "groups_sha256"), len(_side(b).bytes))
    return found.select(*names, "n_best", "count_sum", "groups_sha256")
