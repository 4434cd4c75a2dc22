"""Benchmark decontamination: every suffix of the test items is looked up in suffix arrays over the documents.

Texts are lower-cased (A to Z) and cut into words of letters, digits and all beyond ASCII. Documents are read in shards of about
``SHARD`` bytes, one after another within a task; each shard gets a suffix array over its words. Every test suffix that starts a window (``window`` consecutive
words of an item, or a whole shorter item) is narrowed down by binary search, word by word, to the range of training
suffixes that begin with it: all places of that window. A training suffix found like this is then narrowed down in the suffix array of
the items, which gives the longest verbatim match at that place. Words inside any window are hit.

The items come in blocks of at most ``BLOCK`` bytes, which bounds what is broadcast; each further block is a further step over the same
rows, without a shuffle. Items longer than a block are cut with an overlap, so that no window is lost. No document leaves its task, and nothing is
collected but one block of items at a time.

Defined cases: a null text, or one without words, has no words and no hits; null or wordless items have no windows; windows of an item
without id hit words, but the item is not listed; equal item ids count as one item; repeated rows and repeated or null document ids
each give their own row; ties of matches go to the item that comes first; an empty table of documents gives an empty result, an empty benchmark
leaves all clean; other columns are ignored unless they are asked for. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsignal.llm.hashing import LOWER, PUNCTUATION, TextWords, in_chunks, mix
from newsignal.llm.naming import extended
from newsignal.llm.suffixes import suffix_array

WINDOW = 10
SHARD = 1 << 21
BLOCK = 1 << 21

SPANS = "array<struct<start:bigint,length:bigint>>"
MATCHES = "array<struct<start:bigint,length:bigint,item:string>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
_MATCHES = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("item", pa.string())]))
_FOUND = {"n_words": "bigint", "spans": SPANS, "matches": MATCHES, "items": "array<string>"}

_ODD = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Words:
    """The words of several texts in one array, with a 0 after each text, and a suffix array over them."""

    words: np.ndarray
    #: Number of the text at each place, and the place where each text starts.
    text: np.ndarray
    starts: np.ndarray
    order: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes]) -> Words:
        found = TextWords([t.translate(LOWER) for t in texts], PUNCTUATION)
        words = np.zeros(len(found.hashes) + len(texts), np.uint64)
        words[np.arange(len(found.hashes)) + found.text] = np.maximum(found.hashes, np.uint64(1))
        counts = np.diff(found.bounds)
        starts = found.bounds[:-1] + np.arange(len(texts))
        return cls(words, np.repeat(np.arange(len(texts)), counts + 1), starts, suffix_array(words))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(np.append(self.starts, len(self.words))) - 1

    def narrowed(self, low: np.ndarray, high: np.ndarray, depth: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The parts of the ranges [low, high) of the suffix array whose word at ``depth`` is the wanted one."""
        last = len(self.words) - 1

        def bound(low: np.ndarray, high: np.ndarray, above: bool) -> np.ndarray:
            low, high = low.copy(), high.copy()
            left = np.flatnonzero(low < high)
            while len(left):
                middle = (low[left] + high[left]) >> 1
                place = self.order[middle] + depth
                word = np.where(place <= last, self.words[np.minimum(place, last)], np.uint64(0))
                right = word <= wanted[left] if above else word < wanted[left]
                low[left[right]] = middle[right] + 1
                high[left[~right]] = middle[~right]
                left = left[low[left] < high[left]]
            return low

        first = bound(low, high, False)
        return first, bound(first, high, True)

    def ranges(self, other: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of the suffixes that begin with ``lengths`` words of ``other`` from ``starts`` on."""
        low, high = np.zeros(len(starts), np.int64), np.full(len(starts), len(self.words))
        for depth in range(int(lengths.max(initial=0))):
            on = np.flatnonzero((depth < lengths) & (low < high))
            low[on], high[on] = self.narrowed(low[on], high[on], depth, other[starts[on] + depth])
        return low, high

    def longest(self, other: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For suffixes of ``other``: how many words some suffix here shares with it, and the first text that has them."""
        low, high = np.zeros(len(starts), np.int64), np.full(len(starts), len(self.words))
        length, on, depth = np.zeros(len(starts), np.int64), np.arange(len(starts)), 0
        while len(on):
            word = other[np.minimum(starts[on] + depth, len(other) - 1)]
            a, b = self.narrowed(low[on], high[on], depth, word)
            going = (a < b) & (word > 0)
            on, depth = on[going], depth + 1
            low[on], high[on], length[on] = a[going], b[going], depth
        firsts = self.text[self.order]
        return length, np.array([firsts[a:b].min() if a < b else -1 for a, b in zip(low, high)], np.int64)


@dataclass(frozen=True)
class Block:
    """Some of the items: their words, the different windows, and the items of each window."""

    words: Words
    ids: list[str | None]
    starts: np.ndarray
    lengths: np.ndarray
    #: Items of window w: owners[bounds[w] : bounds[w + 1]].
    bounds: np.ndarray
    owners: np.ndarray

    @classmethod
    def of(cls, items: list[tuple[str | None, bytes]], window: int) -> Block:
        words = Words.of([text for _, text in items])
        counts = words.counts
        size = np.minimum(counts, window)
        number = np.where(counts > 0, counts - size + 1, 0)
        owner = np.repeat(np.arange(len(items)), number)
        starts = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number) + words.starts[owner]
        lengths = size[owner]
        key = lengths.astype(np.uint64)
        for k in range(int(lengths.max(initial=0))):
            here = words.words[np.minimum(starts + k, len(words.words) - 1)]
            key = np.where(k < lengths, mix(key * _ODD + here), key)
        _, first, which = np.unique(key, return_index=True, return_inverse=True)
        pairs = np.unique(np.stack([which, owner], axis=1), axis=0) if len(which) else np.empty((0, 2), np.int64)
        return cls(words, [i for i, _ in items], starts[first], lengths[first],
                   np.searchsorted(pairs[:, 0], np.arange(len(first) + 1)), pairs[:, 1])

    def __bool__(self) -> bool:
        return len(self.starts) > 0


def item_blocks(benchmark: DataFrame, item: str, window: int, size: int = BLOCK) -> Iterator[Block]:
    """All items in blocks of at most ``size`` bytes; a longer item is cut between words, with ``window`` - 1 words of overlap."""
    held, total = [], 0
    for name, text in benchmark.select(F.col(item).cast("string"), "text").toLocalIterator():
        for part in _parts((text or "").encode(), window, size):
            if held and total + len(part) > size:
                yield Block.of(held, window)
                held, total = [], 0
            held.append((name, part))
            total += len(part)
    if held:
        yield Block.of(held, window)


def _parts(text: bytes, window: int, size: int) -> list[bytes]:
    if len(text) <= size:
        return [text]
    found = TextWords([text.translate(LOWER)], PUNCTUATION)
    parts, first, n = [], 0, len(found.starts)
    while first < n:
        end = max(int(np.searchsorted(found.ends, found.starts[first] + size, "right")), min(first + window, n))
        parts.append(text[found.starts[first] : found.ends[end - 1]])
        first = end if end == n else end - window + 1
    return parts


def _union(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint ranges that cover the same places; ranges that touch become one."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > reach[:-1]])
    return starts[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(reach) - 1)]


def shard_hits(texts: list[bytes], block: Block) -> tuple[np.ndarray, dict[int, tuple[list, list, list]]]:
    """Words of each text, and for those with hits: spans (start, end), matches (start, length, item), listed items."""
    shard = Words.of(texts)
    low, high = shard.ranges(block.words.words, block.starts, block.lengths)
    size = high - low
    window = np.repeat(np.arange(len(size)), size)
    if not len(window):
        return shard.counts, {}
    place = shard.order[np.arange(len(window)) - np.repeat(np.cumsum(size) - size, size) + low[window]]
    order = np.argsort(place, kind="stable")
    place, window = place[order], window[order]
    text = shard.text[place]
    at = np.unique(place)
    length, item = block.words.longest(shard.words, at)
    # A match that is the rest of the one a word before is no match of its own.
    inner = np.zeros(len(at), bool)
    inner[1:] = (at[1:] == at[:-1] + 1) & (length[1:] == length[:-1] - 1)
    begin, finish = _union(place, place + block.lengths[window])
    found: dict[int, tuple[list, list, list]] = {int(t): ([], [], []) for t in np.unique(text)}
    for t, a, b in zip(shard.text[begin].tolist(), begin.tolist(), finish.tolist()):
        found[t][0].append((a - int(shard.starts[t]), b - int(shard.starts[t])))
    for p, n, i in zip(at[~inner].tolist(), length[~inner].tolist(), item[~inner].tolist()):
        t = int(shard.text[p])
        found[t][1].append((p - int(shard.starts[t]), n, block.ids[i]))
    pairs = np.unique(np.stack([text, window], axis=1), axis=0)
    for t, w in pairs.tolist():
        found[t][2].append(block.owners[block.bounds[w] : block.bounds[w + 1]])
    for spans, matches, owners in found.values():
        owners[:] = {block.ids[i] for i in np.unique(np.concatenate(owners)).tolist()} - {None}
    return shard.counts, found


def _with_block(docs: DataFrame, block: Block) -> DataFrame:
    """``docs`` (with the columns of ``_FOUND`` and _text) with the hits of one more block."""
    shared = docs.sparkSession.sparkContext.broadcast(block)
    others = [c for c in docs.columns if c not in _FOUND]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for chunk in in_chunks(((t.as_py() or "").encode() for t in batch.column("_text")), SHARD):
                counts, hits = shard_hits(chunk, shared.value)
                part = batch.slice(at, len(chunk))
                spans, matches, items = (part.column(c).to_pylist() for c in ("spans", "matches", "items"))
                for t, (ranges, pairs, names) in hits.items():
                    ranges += [(s["start"], s["start"] + s["length"]) for s in spans[t]]
                    begin, finish = _union(*np.array(ranges, np.int64).T)
                    spans[t] = [{"start": a, "length": b - a} for a, b in zip(begin.tolist(), finish.tolist())]
                    matches[t] += [{"start": s, "length": n, "item": i} for s, n, i in pairs]
                    matches[t].sort(key=lambda m: (m["start"], -m["length"]))
                    items[t] = sorted({*items[t], *names})
                made = [pa.array(counts, pa.int64()), pa.array(spans, _SPANS), pa.array(matches, _MATCHES), pa.array(items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), *made], [*others, *_FOUND])
                at += len(chunk)

    added = ", ".join(f"{name} {kind}" for name, kind in _FOUND.items())
    return docs.select(*others, *_FOUND).mapInArrow(find, extended(docs, others, added))


def verbatim_matches(
    docs: DataFrame, benchmark: DataFrame, columns: tuple[str, ...], item: str = "item_id", window: int = WINDOW, block: int = BLOCK,
) -> DataFrame:
    """columns, n_words, spans (the hit words, as disjoint ranges), matches (longest verbatim matches: start, length, an item that has
    it) and items (ids of all items with a window in the text, sorted).

    ``columns`` must not be named like what is added, or ``_text``.
    """
    if clash := ({*columns} & {*_FOUND, "_text"}):
        raise ValueError(f"columns named like those of the result: {sorted(clash)}")
    empty = [F.lit(0).cast("bigint"), F.array().cast(SPANS), F.array().cast(MATCHES), F.array().cast("array<string>")]
    found = docs.select(*columns, F.col("text").alias("_text"), *(c.alias(n) for c, n in zip(empty, _FOUND)))
    first = True
    for part in item_blocks(benchmark, item, window, block):
        if part or first:
            found, first = _with_block(found, part), False
    if first:
        found = _with_block(found, Block.of([], window))
    return found.drop("_text")


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without hits, in their own columns."""
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text")
    return verbatim_matches(whole, benchmark, ("row",), window=window).filter(F.size("spans") == 0).select("row.*")


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda total, s: total + s["length"])
    return verbatim_matches(docs.select("doc_id", "text"), benchmark, ("doc_id",)).select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


REPORT_SQL = r"""
WITH cut AS (
  SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
), item AS (
  SELECT row_number() OVER () AS number, CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark
), placed AS (
  SELECT item_id, words, least(len(words), 10) AS size, unnest(range(1, len(words) - least(len(words), 10) + 2)) AS first
  FROM item WHERE len(words) > 0
), windows AS (
  SELECT DISTINCT item_id, size, array_to_string(list_slice(words, first, first + size - 1), ' ') AS gram FROM placed
), sizes AS (
  SELECT DISTINCT size FROM windows
), word AS (
  SELECT row_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM cut
), ahead AS (
  SELECT row_id, place, list(word) OVER (PARTITION BY row_id ORDER BY place ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS words FROM word
), hits AS (
  SELECT a.row_id, a.place, a.size, w.item_id
  FROM (SELECT row_id, place, size, array_to_string(list_slice(words, 1, size), ' ') AS gram FROM ahead, sizes WHERE len(words) >= size) a
  JOIN windows w ON w.size = a.size AND w.gram = a.gram
), covered AS (
  SELECT row_id, count(DISTINCT word) AS n_hit FROM (
    SELECT row_id, unnest(range(place, place + size)) AS word FROM (SELECT DISTINCT row_id, place, size FROM hits)) GROUP BY row_id
), listed AS (
  SELECT row_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hits GROUP BY row_id
)
SELECT c.doc_id, CAST(len(c.words) AS BIGINT) AS n_words, CAST(coalesce(v.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(l.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(l.ids, '')) AS items_sha256,
  coalesce(v.n_hit, 0) > 0 AS contaminated
FROM cut c LEFT JOIN covered v USING (row_id) LEFT JOIN listed l USING (row_id)
"""
