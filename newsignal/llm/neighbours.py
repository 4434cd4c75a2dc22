"""Approximate nearest neighbours by inner product: a forest of hash-prefix trees over sorted arrays.

Each of ``TREES`` trees gives a vector a hash string of ``DEPTH`` bits, the sides of random hyperplanes, and keeps
its vectors sorted by it. A query descends every tree to the vectors that share its longest prefix, then ascends in
all trees at once, one bit at a time, until the groups of equal prefix hold ``share`` times as many entries as there
are vectors (or ``LEAST_CANDIDATES``). These groups are ranges of the sorted arrays; the arrays are cut into slices of about
``SLICE`` entries, and a query meets the slices its ranges touch. There, inner products are taken with the
original vectors and the nearest ``k`` go on; the last step keeps the nearest of all trees.

For inner products of vectors of unequal length, candidates get one more coordinate that brings them to equal
length (the largest found), which turns the largest inner product into the smallest angle.

What is sent to every task is the number of entries under each of the 2^``DEPTH`` strings in each tree: a fixed size. A string held by
very many vectors is spread over several slices, and slices met by many queries are joined in blocks of queries.

Defined cases: vectors that are null, empty, zero or hold a null or non-finite number take no part, nor do rows without an
id or vectors of another dimension than most have (ties: the smaller one); of rows that repeat an id the largest vector
counts; a query is never its own neighbour; ties go to the smaller id; fewer than ``k`` candidates are all
returned; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsignal.session import durable

TREES = 16
DEPTH = 16
SHARE = 0.8
LEAST_CANDIDATES = 4_096
SLICE = 4_096
QUERY_BLOCK = 4_096


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vector (doubles) of the rows that take part, an id once."""
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.filter("vec_id is not null and embedding is not null").filter(
        good & F.exists("embedding", lambda x: x != 0)).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    return rows.groupBy("vec_id").agg(F.max("vector").alias("vector"))


class Forest:
    """Hyperplanes of all trees, and how many entries stand before each string."""

    def __init__(self, dimension: int, longest: float, seed: int = 3):
        random = np.random.default_rng(seed)
        self.planes = random.standard_normal((dimension + 1, TREES * DEPTH))
        self.longest, self.slice = longest, SLICE
        self.before = np.zeros((TREES, (1 << DEPTH) + 1), np.int64)

    def _strings(self, vectors: np.ndarray, extra: np.ndarray) -> np.ndarray:
        sides = vectors @ self.planes[:-1] + extra[:, None] * self.planes[-1] > 0
        return sides.reshape(len(vectors), TREES, DEPTH) @ (1 << np.arange(DEPTH)[::-1])

    def strings(self, vectors: np.ndarray) -> np.ndarray:
        """Of candidates: [vector, tree]."""
        squared = np.maximum(self.longest**2 - (vectors * vectors).sum(axis=1), 0.0)
        return self._strings(vectors, np.sqrt(squared))

    def query_strings(self, vectors: np.ndarray) -> np.ndarray:
        return self._strings(vectors, np.zeros(len(vectors)))

    def slices_of(self, tree: int, string: int, vec_id: int) -> int:
        """The slice of a candidate; the entries of one string may fill several."""
        first, size = self.before[tree, string], self.before[tree, string + 1] - self.before[tree, string]
        return int(first // self.slice + (vec_id * 0x9E3779B1 >> 7) % max(-(-size // self.slice), 1))

    def ranges(self, strings: np.ndarray, enough: int) -> tuple[np.ndarray, np.ndarray]:
        """First and end position in each tree of the entries to be met by each query."""
        low = np.zeros(strings.shape, np.int64)
        high = np.zeros(strings.shape, np.int64)
        todo = np.arange(len(strings))
        trees = np.arange(TREES)
        for level in range(DEPTH, -1, -1):
            shift = DEPTH - level
            prefix = strings[todo] >> shift
            low[todo], high[todo] = self.before[trees, prefix << shift], self.before[trees, (prefix + 1) << shift]
            todo = todo[(high[todo] - low[todo]).sum(axis=1) < enough]
            if not len(todo):
                break
        everything = (high - low == self.before[:, -1]).all(axis=1)
        high[everything, 1:] = low[everything, 1:] = 0  # one tree has all
        return low, high


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64)


def _index(vectors: DataFrame, forest: Forest) -> DataFrame:
    """vec_id, vector, strings (as a candidate) of every vector."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                strings = forest.strings(_matrix(batch.column("vector")))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), batch.column("vector"), pa.array(strings.tolist(), pa.list_(pa.int32()))],
                    ["vec_id", "vector", "strings"])

    return vectors.mapInArrow(run, "vec_id bigint, vector array<double>, strings array<int>")


def _entries(index: DataFrame, forest: Forest) -> DataFrame:
    """tree, slice, vec_id, vector: every vector once for each tree."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("vec_id").to_pylist()
            places = [[forest.slices_of(t, s, i) for t, s in enumerate(row)] for i, row in zip(ids, batch.column("strings").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("vector"), pa.array(places, pa.list_(pa.int64()))], ["vec_id", "vector", "slices"])

    placed = index.mapInArrow(run, "vec_id bigint, vector array<double>, slices array<bigint>")
    return placed.select("vec_id", "vector", F.posexplode("slices").alias("tree", "slice"))


def _met(queries: DataFrame, forest: Forest, enough: int) -> DataFrame:
    """tree, slice, query_id, vector: every query once for each slice it meets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            low, high = forest.ranges(forest.query_strings(_matrix(batch.column("vector"))), enough)
            places = [
                [{"tree": t, "slice": s} for t in range(TREES) if b[t] > a[t] for s in range(int(a[t] // forest.slice), int((b[t] - 1) // forest.slice) + 1)]
                for a, b in zip(low, high)
            ]
            kind = pa.list_(pa.struct([("tree", pa.int32()), ("slice", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vector"), pa.array(places, kind)], ["query_id", "vector", "places"])

    found = queries.select("vec_id", "vector").mapInArrow(
        run, "query_id bigint, vector array<double>, places array<struct<tree: int, slice: bigint>>")
    return found.select("query_id", "vector", F.explode("places").alias("p")).select("query_id", "vector", "p.tree", "p.slice")


def _nearest(k: int):
    def run(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "vec_id", "score"]
        if not len(candidates) or not len(queries):
            return pd.DataFrame({n: [] for n in names}).astype({"query_id": "int64", "vec_id": "int64"})
        ids, vectors = candidates["vec_id"].to_numpy(), np.stack(candidates["vector"].to_numpy())
        out = []
        for first in range(0, len(queries), 256):
            part = queries.iloc[first : first + 256]
            asked = np.stack(part["vector"].to_numpy())
            scores = asked @ vectors.T
            scores[part["query_id"].to_numpy()[:, None] == ids] = -np.inf
            few = min(k, len(ids))
            bound = np.partition(scores, len(ids) - few, axis=1)[:, len(ids) - few]
            for i, query in enumerate(part["query_id"]):
                # Once more without rounding of the sum, so that equal vectors tie exactly.
                near = np.flatnonzero((scores[i] >= bound[i] - 1e-9 * max(1.0, abs(bound[i]))) & (scores[i] > -np.inf))
                best = sorted((-math.fsum(asked[i] * vectors[j]), int(ids[j])) for j in near)[:k]
                out += [(query, j, -s) for s, j in best]
        return pd.DataFrame(out, columns=names).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return run


def nearest(spark: SparkSession, vectors: DataFrame, queries: Column, k: int = 20, share: float = SHARE) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` nearest found. ``queries`` is a condition on vec_id."""
    rows = usable(vectors)
    sizes = rows.groupBy(F.size("vector").alias("size")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.max(F.aggregate("vector", F.lit(0.0), lambda total, x: total + x * x)).alias("squared"))
    common = sizes.orderBy(F.desc("rows"), "size").limit(1).collect()
    if not common:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    forest = Forest(common[0]["size"], math.sqrt(common[0]["squared"]))
    index = durable(spark, _index(rows.filter(F.size("vector") == common[0]["size"]), forest))
    counts = index.select(F.posexplode("strings").alias("tree", "string")).groupBy("tree", "string").count()
    found = counts.toPandas()  # TREES * 2^DEPTH rows at most
    sizes_by = np.zeros((TREES, 1 << DEPTH), np.int64)
    sizes_by[found["tree"], found["string"]] = found["count"]
    forest.before[:, 1:] = sizes_by.cumsum(axis=1)
    enough = max(int(share * common[0]["rows"]), LEAST_CANDIDATES)
    met = durable(spark, _met(index.filter(queries), forest, enough))
    blocks = met.groupBy("tree", "slice").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("blocks"))
    keys = ["tree", "slice", "block"]
    asked = met.join(blocks, ["tree", "slice"]).withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int"))
    offered = _entries(index, forest).join(blocks, ["tree", "slice"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    scored = offered.select(*keys, "vec_id", "vector").groupBy(*keys).cogroup(
        asked.select(*keys, "query_id", "vector").groupBy(*keys)).applyInPandas(_nearest(k), "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
