"""Periodic runs: stretches of words that repeat with a period, found as maximal pairs of an LCP-interval tree.

Two equal stretches of a text that neither the word before nor the word after extends are a *maximal pair*. A run of length L
with period q is the pair at distance q whose stretches have L - q words; the other way round, a maximal pair at distance q
whose stretches have at least (``REPEATS`` - 1) q words is such a run as it stands: nothing has to be extended. Among pairs that
cover the same words the smallest distance is the period.

Pairs are enumerated bottom-up over the LCP-interval tree of a text's suffix array. An interval holds the places of its
suffixes in order, each in the class of the word on its left. Where two children meet, suffixes of different children are followed by
different words, so those of different classes are maximal pairs. Only neighbouring places can be at the smallest distance, as
a place between them would repeat sooner; so each place of the smaller child meets the nearest on either side in the larger one.

A run of ``least`` words shares at least ``least`` - floor(``least`` / ``REPEATS``) words with itself a period on, so intervals with shorter common
prefixes are never built, and texts in which no stretch of that many words occurs twice are done after one pass over hashes.

Texts are independent rows: no shuffle, and a worker holds one batch. Defined cases: null, empty or blank text has no words and no
runs, and collapses to an empty text; ties of runs are in order of start, then period; repeated rows and repeated or null ids each give their own row;
an empty table gives an empty result; other columns are ignored unless they are asked for. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsignal.llm.hashing import TextWords, in_chunks, mix
from newsignal.llm.naming import extended
from newsignal.llm.suffixes import common_prefixes, dense_ranks, suffix_array

LEAST = 24
REPEATS = 3
#: Up to so many places are inserted one by one; more are sorted in together.
FEW = 32

_SALTS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]


def repeated_stretches(hashes: np.ndarray, text: np.ndarray, length: int) -> np.ndarray:
    """Numbers of the texts in which some stretch of ``length`` words occurs at least twice."""
    def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        size = min(len(left), len(right))
        return mix(left[:size] * _SALTS[0] + mix(right[:size] + _SALTS[1]))

    power, reach, total, covered = hashes, 1, None, 0
    for bit in range(length.bit_length()):  # stretches of 1, 2, 4, … words, put together to one of the length
        if length >> bit & 1:
            total = power if total is None else joined(total, power[covered:])
            covered += reach
        power, reach = joined(power, power[reach:]), reach * 2
    if total is None or len(hashes) < length:
        return np.empty(0, np.int64)
    total = total[: len(hashes) - length + 1]
    whole = text[: len(total)] == text[length - 1 :]
    keys, owner = (total + mix(text[: len(total)].astype(np.uint64)))[whole], text[: len(total)][whole]
    order = np.argsort(keys)
    again = np.flatnonzero(keys[order[1:]] == keys[order[:-1]])
    return np.unique(owner[order[again]])


def text_runs(symbols: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least ``least`` words and ``REPEATS`` periods, by start, then period."""
    shortest = least - least // REPEATS
    places = suffix_array(symbols).tolist()
    words = symbols.tolist()
    shared = common_prefixes(words, places)
    periods: dict[tuple[int, int], int] = {}

    def meet(one: list[int], other: list[int], common: int) -> list[int]:
        """The places of both children in order; notes the runs among pairs of one from each."""
        small, large = (one, other) if len(one) < len(other) else (other, one)
        reach, size = common // (REPEATS - 1), len(large)
        for p in small:
            at = bisect_left(large, p)
            for i, j in ((large[at - 1], p) if at else (0, 0), (p, large[at]) if at < size else (0, 0)):
                q = j - i
                if 0 < q <= reach and q + common >= least and (not i or words[i - 1] != words[j - 1]):
                    key = (i, q + common)
                    periods[key] = min(q, periods.get(key, q))
        if len(small) <= FEW:
            for p in small:
                insort(large, p)
            return large
        large += small
        large.sort()
        return large

    open_: list[tuple[int, list[int]]] = []  # (common prefix, places) of the intervals around the last suffix, outermost first
    previous = places[:1]
    for place, common in zip(places[1:], shared[1:]):
        held = previous  # the suffix before; its children below are closed from the innermost
        while open_ and open_[-1][0] > common:
            depth, around = open_.pop()
            held = meet(around, held, depth)
        if common >= shortest:
            if open_ and open_[-1][0] == common:
                held = meet(open_.pop()[1], held, common)
            open_.append((common, held))
        previous = [place]
    held = previous
    while open_:
        depth, around = open_.pop()
        held = meet(around, held, depth)
    return sorted((start, length, q) for (start, length), q in periods.items())


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay when each run is cut to its first period."""
    edges = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return np.cumsum(edges[:-1]) == 0


def periodic_runs(docs: DataFrame, columns: tuple[str, ...], text: str = "text", least: int = LEAST) -> DataFrame:
    """columns, n_words, runs (start, length, period of each) and collapsed: the text with each run cut to its first
    period, words joined by one blank."""
    if least < REPEATS:
        raise ValueError(f"least must be {REPEATS} or more")
    shortest = least - least // REPEATS
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    names = [*columns, "n_words", "runs", "collapsed"]

    def of_chunk(texts: list[bytes]) -> Iterator[tuple[int, list[dict], bytes]]:
        found = TextWords(texts)
        repeating = set(repeated_stretches(found.hashes, found.text, shortest).tolist())
        for i in range(len(texts)):
            first, end = found.bounds[i], found.bounds[i + 1]
            runs = text_runs(dense_ranks(found.hashes[first:end]), least) if i in repeating else []
            words = texts[i].split()  # the same six separators
            if runs:
                words = [words[k] for k in np.flatnonzero(kept_words(len(words), runs))]
            yield int(end - first), [dict(zip(("start", "length", "period"), r)) for r in runs], b" ".join(words)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for chunk in in_chunks((t.as_py() or "").encode() for t in batch.column("_text")):
                counts, runs, left = zip(*of_chunk(chunk))
                kept = [batch.column(k).slice(at, len(chunk)) for k in range(len(columns))]
                made = [pa.array(counts, pa.int64()), pa.array(runs, pa.list_(run_type)), pa.array(left, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*kept, *made], names)
                at += len(chunk)

    schema = extended(docs, columns, "n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
    return docs.select(*columns, F.col(text).alias("_text")).mapInArrow(find, schema)


def with_loops(text: Column, doc_id: Column) -> Column:
    """``text`` with a periodic tail, in one of ten documents chosen by their id; the others, and those without id, as they are."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")

    def looped(w: Column) -> Column:
        n = F.size(w).cast("bigint")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(w, lambda x, i: F.when(i >= a, F.get(w, (a + (i - a) % p).cast("int"))).otherwise(x)), " ")

    tailed = F.element_at(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, looped(w))), 1)
    return F.when(h % 10 == 0, tailed).otherwise(text)


def strongest(runs: Column) -> Column:
    """The run with most repeats, compared as fractions; null without runs. Runs are in order of start and period."""
    better = lambda best, run: run["length"] * best["period"] > best["length"] * run["period"]
    return F.aggregate(runs, F.get(runs, 0), lambda best, run: F.when(better(best, run), run).otherwise(best))


def run_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256 of every document."""
    found = periodic_runs(docs.select("doc_id", with_loops(F.col("text"), F.col("doc_id")).alias("text")), ("doc_id",))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = found.withColumn("best", strongest(F.col("runs")))
    return best.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
