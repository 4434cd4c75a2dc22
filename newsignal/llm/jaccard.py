"""N-gram Jaccard join: documents whose sets of ``words``-word shingles overlap by ``share`` percent, joined exactly in
metric regions. ``WORDS`` and ``SHARE`` are the values of the op10 query; callers may give others.

Sets are compared by two distances, both metrics: the Jaccard distance, and the number of elements in which two sets
differ. For unrelated documents every Jaccard distance to a document is 1, so documents are no use as pivots. The pivots are:

* **single shingles**: a set's distance to the shingles it holds is the same, so ties are put in one global order (rare
  ones first, by a table of counts of fixed size, then by hash), and the Voronoi region of a set is that of its first shingle. A set within reach
  misses at most 100 - ``share`` percent of the elements, so by the triangle inequality a window over that part of the order
  (plus one) holds a common shingle: a set is replicated to the regions in that window. No pair is lost.
* **cells** of the shingle space: the distance of a set to a cell is given by how many of its shingles lie there. The
  differences to all cells together bound the number of differing elements from below, for any two sets.

A region is joined recursively by Voronoi cells in the second space, with windows of twice the reach (``region_pairs``).
What no bound rules out is not listed pair by pair: a region gives each set one other set of its cluster, so it makes no more rows than it has.
The clusters of all regions together are groups, and every pair in reach lies within one. Each set is sent to its group once (to as many
blocks as the group has), where the sizes of all intersections come from one product of incidence matrices.

Equal sets are one class from the start. Classes are first compared with one class of each of four shingles of low hash and
what is linked is contracted to components. Then all windows are joined, but only between different components. So
groups of near copies are linked star by star, not pair by pair; regions and groups beyond ``BLOCK`` rows are split into blocks. Links
and components stay in tables, which are deleted as soon as what follows is written; the driver sees bitmaps of a fixed size only.

Defined cases: null text, or text without words, has an empty set and is linked with nothing; fewer words than ``words`` are
one shingle; repeated rows are in one component; a null id never is the smallest of a component that has another; an empty
table gives an empty result. Shingles and sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsignal.llm.batches import lean, small_batches
from newsignal.llm.hashing import LOWER, TextWords, in_chunks, mix
from newsignal.session import delete, shared_dir, tidy

SHARE = 90
WORDS = 3
CELLS = 64
STARS = 4
#: Places of the table of rarity, in parts of PART places; levels for each doubling of a count.
PLACES = 1 << 22
PART = 1 << 12
STEPS = 8
#: A shingle found in more sets than usual and this many is no star.
COMMON = 32
BITS = 1 << 23
#: Pairs that a worker holds before it reduces them to clusters.
PAIRS = 1 << 17
BLOCK = 1_024
LEAF = 128
#: Sets and shingles of a block of a group, and columns of the matrix that are multiplied at once.
SETS = 512
ITEMS = 1 << 20
COLUMNS = 4_096

#: Names that columns handed through must not have.
OWN_COLUMNS = ("text", "own", "n", "low", "n_shingles", "least", "root", "smallest")

_ODD = [np.uint64(x) for x in (
    0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def shingle_sets(texts: list[bytes], words: int = WORDS) -> Iterator[np.ndarray]:
    """Sorted distinct shingles of each text."""
    found = TextWords([t.translate(LOWER) for t in texts])
    h = found.hashes
    rolled = np.zeros(max(len(h) - words + 1, 0), np.uint64)
    for k in range(words):
        rolled += h[k : k + len(rolled)] * _ODD[k]
    rolled = mix(rolled)
    for a, b in zip(found.bounds, found.bounds[1:]):
        if b - a >= words:
            yield np.unique(rolled[a : b - words + 1])
        elif b > a:
            yield mix((h[a:b] * _ODD[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a))
        else:
            yield np.empty(0, np.uint64)


def class_id(found: np.ndarray) -> int | None:
    if not len(found):
        return None
    total = np.array([mix(found).sum(dtype=np.uint64)], np.uint64) + np.uint64(len(found))
    return int(mix(total).view(np.int64)[0])


def window_size(n: int, share: int = SHARE) -> int:
    return n * (100 - share) // 100 + 1


def cell_counts(found: np.ndarray) -> bytes:
    counts = np.bincount((found >> np.uint64(20)) & np.uint64(CELLS - 1), minlength=CELLS)
    return np.minimum(counts, 65_535).astype("<u2").tobytes()


class Bitmap:
    """A set of 64-bit hashes as ``BITS`` bits: every member is found, few others are."""

    def __init__(self, keys: DataFrame, column: str):
        place = F.col(column).bitwiseAND(F.lit(BITS - 1))
        bits = keys.groupBy(F.shiftright(place, 5).cast("int").alias("word")).agg(
            F.bit_or(F.expr(f"shiftleft(1L, cast({column} & 31 as int))")).alias("bits"))
        self.words = np.zeros(BITS >> 5, np.uint32)
        found = bits.toArrow()  # BITS / 32 rows at most, as two arrays: as objects they would take some hundred megabytes
        self.words[found["word"].to_numpy()] = found["bits"].to_numpy().astype(np.uint32)

    def __contains__(self, key: int) -> bool:
        return bool(self.has(np.array([key], np.int64).view(np.uint64))[0])

    def has(self, keys: np.ndarray) -> np.ndarray:
        place = (keys & np.uint64(BITS - 1)).astype(np.int64)
        return (self.words[place >> 5] >> (place & 31).astype(np.uint32) & np.uint32(1)).astype(bool)


def _map_sets(docs: DataFrame, schema: str, row: Callable, words: int, columns: tuple[str, ...] = ()) -> DataFrame:
    """``row(set, class, first in this task)`` for every document; rows that are None are left out."""
    kinds = "".join(f"{c} {docs.schema[c].dataType.simpleString()}, " for c in columns)
    names = [*columns, *(part.split()[0] for part in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            place = 0
            for chunk in in_chunks((t.as_py() or "").encode() for t in batch.column("text")):
                rows, made = [], []
                for i, found in enumerate(shingle_sets(chunk, words), place):
                    own = class_id(found)
                    new = row(found, own, own not in seen)
                    if own is not None:
                        seen.add(own)
                    if new is not None:
                        rows.append(i)
                        made.append(new)
                place += len(chunk)
                if made:
                    kept = [batch.column(c).take(pa.array(rows)) for c in columns]
                    types = _types[schema]
                    yield pa.RecordBatch.from_arrays(
                        [*kept, *(pa.array(list(v), t) for v, t in zip(zip(*made), types))], names)

    return docs.select(*columns, "text").mapInArrow(lean(run), kinds + schema)


_DESCRIBED, _SETS = "own bigint, n bigint, cells binary, prefix array<bigint>, stars array<bigint>", "own bigint, items binary"
_types = {
    _DESCRIBED: [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())],
    _SETS: [pa.int64(), pa.binary()],
}


def _signed(values: np.ndarray) -> list[int]:
    return values.view(np.int64).tolist()


def rarity(docs: DataFrame, words: int) -> np.ndarray:
    """A level for every place of a table of fixed size: about the logarithm of how many sets have shingles of that place.

    Each task counts its own classes and emits the whole table in parts; the parts are added up place by place.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.zeros(PLACES, np.uint32), set()
        for batch in batches:
            for chunk in in_chunks((t.as_py() or "").encode() for t in batch.column("text")):
                for found in shingle_sets(chunk, words):
                    own = class_id(found)
                    if own is not None and own not in seen:
                        seen.add(own)
                        np.add.at(counts, (found & np.uint64(PLACES - 1)).astype(np.int64), 1)
        parts = np.minimum(counts, 255).astype(np.uint8).reshape(-1, PART)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts")):
                total = sums.setdefault(part, np.zeros(PART, np.int64))
                total += np.frombuffer(counts.as_py(), np.uint8)
        levels = [np.minimum(np.rint(np.log2(1 + total) * STEPS), 255).astype(np.uint8).tobytes() for total in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(levels, pa.binary())], ["part", "levels"])

    parts = docs.select("text").mapInArrow(lean(count), "part int, counts binary").repartition("part").mapInArrow(lean(add), "part int, levels binary")
    levels = np.zeros((PLACES // PART, PART), np.uint8)
    for part, found in parts.collect():  # PLACES / PART rows
        levels[part] = np.frombuffer(found, np.uint8)
    return levels.reshape(-1)


def described(docs: DataFrame, levels: np.ndarray, words: int, share: int, columns: tuple[str, ...]) -> DataFrame:
    """columns, own, n of every row; with the first of each class in a task also cells, prefix (the window in the global order)
    and stars (a few shingles that near copies are likely to share)."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)
    mean = float((2.0 ** (levels / STEPS) - 1).mean())
    often = STEPS * np.log2(1 + mean + 6 * mean**0.5 + COMMON)

    def row(found, own, first):
        if own is None or not first:
            return own, len(found), None, None, None
        level = shared.value[(found & np.uint64(PLACES - 1)).astype(np.int64)]
        window = found[np.argsort(level, kind="stable")[: window_size(len(found), share)]]
        stars = found[level <= often][:STARS]
        return own, len(found), cell_counts(found), _signed(window), _signed(stars if len(stars) else found[:STARS])

    return _map_sets(docs, _DESCRIBED, row, words, columns)


def with_sets(docs: DataFrame, wanted: Bitmap, words: int) -> DataFrame:
    """own and the whole set as bytes, of the wanted classes."""
    def row(found, own, first):
        return (own, found.astype("<u8").tobytes()) if first and own is not None and own in wanted else None

    return _map_sets(docs, _SETS, row, words).dropDuplicates(["own"])


def in_reach(sizes: np.ndarray, cells: np.ndarray, size: int, own: np.ndarray, share: int = SHARE) -> np.ndarray:
    """Sets that the cell distances leave within reach of one set. Two sets in reach differ in at most
    (100 - share) / (100 + share) of the sum of their sizes."""
    apart = np.abs(cells - own).sum(axis=1)
    return (100 + share) * apart <= (100 - share) * (sizes + size)


def region_parts(sizes: np.ndarray, cells: np.ndarray, groups: np.ndarray, share: int = SHARE) -> Iterator[np.ndarray]:
    """Pairs of rows of different groups that the bounds leave in reach, some at a time, by recursive Voronoi cells.

    Two pivots split the rows; a row goes to the nearer pivot, and to the other one too if its distances to both
    differ by no more than twice the reach. Pairs of rows that were replicated are found twice.
    """
    open_ = [np.arange(len(sizes))]
    found: list[np.ndarray] = []
    held = 0
    while open_:
        rows = open_.pop()
        if not len(rows) or (groups[rows] == groups[rows[0]]).all():
            continue
        if len(rows) > LEAF:
            reach = (100 - share) * 2 * sizes[rows].max() / (100 + share)
            one = np.abs(cells[rows] - cells[rows[0]]).sum(axis=1)
            far = int(one.argmax())
            two = np.abs(cells[rows] - cells[rows[far]]).sum(axis=1)
            left, right = rows[one - two <= 2 * reach], rows[two - one <= 2 * reach]
            if len(left) + len(right) < 1.5 * len(rows):
                open_ += [right, left]
                continue
        for place, i in enumerate(rows[:-1]):
            others = rows[place + 1 :]
            others = others[groups[others] != groups[i]]
            near = others[in_reach(sizes[others], cells[others], sizes[i], cells[i], share)]
            if len(near):
                found.append(np.stack([np.full(len(near), i), near], axis=1))
                held += len(near)
            if held > PAIRS:
                yield np.concatenate(found)
                found, held = [], 0
    if found:
        yield np.concatenate(found)


def region_pairs(sizes: np.ndarray, cells: np.ndarray, groups: np.ndarray, share: int = SHARE) -> np.ndarray:
    """All pairs of ``region_parts``, once each."""
    found = list(region_parts(sizes, cells, groups, share))
    return np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)


class Rows:
    """Rows of regions, region after region."""

    def __init__(self, batch: pa.Table, share: int):
        self.share = share
        number = lambda c: batch.column(c).combine_chunks().fill_null(0).to_numpy(zero_copy_only=False)
        self.region = np.stack([number(c) for c in ("shingle", "p", "q")], axis=1)
        self.own, self.root, self.n = number("own"), number("root"), number("n")
        self.heads = np.stack([number(f"h{k}") for k in range(STARS)], axis=1)
        self.cells = np.frombuffer(b"".join(batch.column("cells").to_pylist()), "<u2").reshape(-1, CELLS).astype(np.int32)

    def possible(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs are of different components and left in reach by sizes and cells."""
        good = self.root[i] != self.root[j]
        low, high = np.minimum(self.n[i], self.n[j]), np.maximum(self.n[i], self.n[j])
        good &= 100 * low >= self.share * high
        at = np.flatnonzero(good)
        apart = np.abs(self.cells[i[at]] - self.cells[j[at]]).sum(axis=1)
        good[at] = (100 + self.share) * apart <= (100 - self.share) * (self.n[i[at]] + self.n[j[at]])
        return good

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that connect all rows of different components that share a region and that the bounds leave in reach."""
        edges = np.flatnonzero((self.region[1:] != self.region[:-1]).any(axis=1)) + 1
        bounds = np.concatenate([[0], edges, [len(self.own)]])
        sizes = np.diff(bounds)
        end = np.repeat(bounds[1:], sizes)
        left, right = [], []
        rows = np.flatnonzero(np.repeat(sizes <= LEAF, sizes))
        for step in range(1, LEAF):  # small regions side by side: each row with the one `step` rows on
            rows = rows[rows + step < end[rows]]
            if not len(rows):
                break
            near = rows[self.possible(rows, rows + step)]
            i, j = self._own(near, near + step)
            left.append(i)
            right.append(j)
        for group in np.flatnonzero(sizes > LEAF):
            part = slice(bounds[group], bounds[group + 1])
            for found in region_parts(self.n[part], self.cells[part], self.root[part], self.share):
                i, j = self._own(found[:, 0] + bounds[group], found[:, 1] + bounds[group])
                i, j = star(i, j, len(self.own))
                left.append(i)
                right.append(j)
        if not left:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(left), np.concatenate(right)

    def _own(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaves out pairs that an earlier common region among their first ones has."""
        same = ((self.heads[i][:, :, None] == self.heads[j][:, None, :]) & (self.heads[i] != 0)[:, :, None]).any(axis=2)
        first = self.heads[i][np.arange(len(i)), same.argmax(axis=1)]
        here = ~same.any(axis=1) | (first == self.region[i, 0])
        return i[here], j[here]


def representatives(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """For each of n rows the first row that pairs (i, j) connect it with."""
    label = np.arange(n)
    while len(i):
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], least)
        np.minimum.at(new, label[j], least)
        while (new[new] != new).any():
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    return label


def star(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that connect the same rows: each but the first of a cluster with that first one."""
    first = representatives(i, j, n)
    moved = np.flatnonzero(first != np.arange(n))
    return moved, first[moved]


def _ends(i: np.ndarray, j: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
    """What connects the rows that pairs connect."""
    i, j = star(i, j, len(own))
    a, b = own[i], own[j]
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _by_key(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[pa.Table]:
    """Rows sorted by key in parts that end where a key ends; the rows of a key are held until its last one is there."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns], axis=1)
        other = np.flatnonzero((key != key[-1]).any(axis=1))
        cut = int(other[-1]) + 1 if len(other) else 0  # where the last region starts
        if held:
            before = [held[-1].column(c)[held[-1].num_rows - 1].as_py() for c in columns]
            if not cut and before != key[-1].tolist():
                yield pa.Table.from_batches(held)
                held = []
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _join_regions(batches: Iterator[pa.RecordBatch], share: int) -> Iterator[pa.RecordBatch]:
    """What connects the sets in reach of each other, region by region."""
    for part in _by_key(batches, ("shingle", "p", "q")):
        rows = Rows(part, share)
        yield _ends(*rows.pairs(), rows.own)


def common_elements(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, as a product of incidence matrices, some columns at a time."""
    sizes = [len(x) for x in sets]
    elements, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = times[column] > 1  # the others are in no intersection
    number = np.cumsum(times > 1) - 1
    row, column = row[shared], number[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(sets), len(sets)), np.float32)  # whole numbers below 2 ** 24
    for first in range(0, int((times > 1).sum()), COLUMNS):
        part = slice(*np.searchsorted(column, (first, first + COLUMNS)))
        matrix = np.zeros((len(sets), COLUMNS), np.float32)
        matrix[row[part], column[part] - first] = 1
        common += matrix @ matrix.T
    return common


def _linked(batches: Iterator[pa.RecordBatch], share: int) -> Iterator[pa.RecordBatch]:
    """What connects the sets of a group that link, from rows sorted by group and block."""
    for part in _by_key(batches, ("group", "p", "q")):
        number = lambda c: part.column(c).combine_chunks().to_numpy()  # noqa: E731, B023
        key = np.stack([number(c) for c in ("group", "p", "q")], axis=1)
        own, root, items = number("own"), number("root"), part.column("items")
        edges = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        for a, b in zip([0, *edges], [*edges, len(own)]):
            if (root[a:b] == root[a]).all():
                continue
            sets = [np.frombuffer(x.as_py(), "<u8") for x in items[a:b]]
            sizes = np.array([len(x) for x in sets], np.int32)
            common = common_elements(sets).astype(np.int32)
            good = 100 * common >= share * (sizes[:, None] + sizes[None, :] - common)
            good &= root[a:b, None] != root[None, a:b]
            yield _ends(*np.nonzero(np.triu(good, 1)), own[a:b])


def _verified(docs: DataFrame, pairs: DataFrame, tables: Tables, words: int, share: int) -> DataFrame:
    """Pairs whose whole sets link."""
    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("items_a"), batch.column("items_b")):
                x, y = np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= share * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    ends = pairs.select(F.col("a").alias("own")).union(pairs.select("b"))
    sets = tables.keep(with_sets(docs, Bitmap(ends, "own"), words))
    of = lambda end: sets.select(F.col("own").alias(end), F.col("items").alias(f"items_{end}"))
    links = tables.keep(pairs.join(of("a"), "a").join(of("b"), "b").mapInArrow(lean(linked), "a bigint, b bigint"))
    tables.drop(sets)
    return links


def _linked_groups(
    docs: DataFrame, classes: DataFrame, roots: DataFrame, edges: DataFrame, tables: Tables, words: int, share: int,
) -> DataFrame:
    """Links between different components within the groups that ``edges`` connect; what connects the classes that link."""
    inner = components(edges, tables)
    members = inner.select("own", F.col("root").alias("group")).union(inner.select("root", "root").distinct())
    members = tables.keep(_rooted(members.join(classes.select("own", "n"), "own"), roots))
    sizes = members.groupBy("group").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("items")).select(
        "group", F.ceil(F.greatest(F.col("rows") / SETS, F.col("items") / ITEMS)).cast("int").alias("blocks"))
    placed = members.join(sizes, "group").withColumn("block", _block()).select("own", "root", "group", F.explode(_met()).alias("pair"))
    sets = with_sets(docs, Bitmap(members, "own"), words)
    key = ["group", "p", "q"]
    rows = placed.select("own", "root", "group", "pair.*").join(sets, "own").repartition(*key).sortWithinPartitions(*key, "own")
    links = tables.keep(rows.mapInArrow(lean(partial(_linked, share=share)), "a bigint, b bigint"))
    tables.drop(inner, members)
    return links


def components(links: DataFrame, tables: Tables) -> DataFrame:
    """own and root (the smallest class reachable) of every linked class, by alternating stars.

    A step replaces links by links to the smallest neighbour; it ends when links are stars already. Links go from ``a`` to a smaller
    ``b`` throughout, so each half of a step reads them twice only: plans of more scans cost the driver more than the links do.
    """
    smaller, larger = F.least("a", "b"), F.greatest("a", "b")

    def large_star(edges: DataFrame) -> DataFrame:
        ends = F.explode(F.array(*(F.struct(F.col(x).alias("b"), F.least("a", "b").alias("m")) for x in ("a", "b")))).alias("end")
        least = edges.select(ends).groupBy("end.b").agg(F.min("end.m").alias("m"))
        return edges.join(least, "b").select("a", F.col("m").alias("b")).distinct()

    def small_star(edges: DataFrame) -> DataFrame:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        moved = edges.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        return moved.filter("a <> b").distinct()

    def state(edges: DataFrame):
        return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).collect()[0])

    edges = tables.keep(links.select(larger.alias("a"), smaller.alias("b")).filter("a <> b").distinct())
    now = state(edges)
    while True:
        before, edges = edges, tables.keep(small_star(large_star(edges)))
        tables.drop(before)
        then, now = now, state(edges)
        if then == now:
            return tables.renamed(edges, {"a": "own", "b": "root"})


def _rooted(classes: DataFrame, roots: DataFrame) -> DataFrame:
    return classes.join(roots, "own", "left").withColumn("root", F.coalesce("root", "own"))


def _star_pairs(classes: DataFrame, share: int) -> DataFrame:
    """Each class with one class of each of its star shingles, where the cell distances allow a link."""
    heads = classes.select("own", F.explode("stars").alias("shingle"))
    pivots = heads.groupBy("shingle").agg(F.min("own").alias("b"), F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    pairs = heads.join(pivots, "shingle").filter("own <> b").select(F.col("own").alias("a"), "b").distinct()
    of = lambda end: classes.select(F.col("own").alias(end), F.col("n").alias(f"n_{end}"), F.col("cells").alias(f"cells_{end}"))

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = [np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, CELLS).astype(np.int32) for c in ("cells_a", "cells_b")]
            sizes = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
            good = (100 + share) * np.abs(cells[0] - cells[1]).sum(axis=1) <= (100 - share) * sizes
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return pairs.join(of("a"), "a").join(of("b"), "b").mapInArrow(lean(possible), "a bigint, b bigint")


def _block() -> Column:
    return F.pmod(F.xxhash64("own"), F.col("blocks")).cast("int")


def _met() -> Column:
    """The pairs of blocks in which a row of ``block`` meets the others."""
    return F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.struct(
        F.least(F.col("block"), other).alias("p"), F.greatest(F.col("block"), other).alias("q")))


def _window_edges(classes: DataFrame, roots: DataFrame, tables: Tables, share: int) -> DataFrame:
    """What connects classes of different components that share a region of their windows and may be in reach."""
    known = _rooted(classes, roots)
    spread = known.select("own", "root", F.explode("prefix").alias("shingle"))
    mixed = spread.groupBy("shingle").agg(
        F.count(F.lit(1)).alias("rows"), F.min("root").alias("least"), F.max("root").alias("most"),
    ).filter("least < most").select("shingle", F.ceil(F.col("rows") / BLOCK).cast("int").alias("blocks"))
    placed = tables.keep(spread.join(mixed, "shingle").withColumn("block", _block()).select("own", "shingle", F.explode(_met()).alias("pair")))
    heads = [F.get("prefix", k).alias(f"h{k}") for k in range(STARS)]
    details = known.select("own", "root", "n", "cells", *heads)
    key = ["shingle", "p", "q"]
    rows = placed.select("own", "shingle", "pair.*").join(details, "own").repartition(*key).sortWithinPartitions(*key, "own")
    edges = tables.keep(rows.mapInArrow(lean(partial(_join_regions, share=share)), "a bigint, b bigint").distinct())
    tables.drop(placed)
    return edges


class Tables:
    """Intermediate results in the shared folder, deleted once what follows is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, shared_dir(spark, "jaccard")
        self.paths: dict[int, tuple[DataFrame, str]] = {}
        tidy(spark)

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(kept)] = kept, path
        tidy(self.spark)
        return kept

    def renamed(self, kept: DataFrame, names: dict[str, str]) -> DataFrame:
        other = kept.withColumnsRenamed(names)
        self.paths[id(other)] = other, self.paths[id(kept)][1]
        return other

    def drop(self, *kept: DataFrame) -> None:
        for df in kept:
            gone = self.paths[id(df)][1]
            delete(self.spark, gone)
            self.paths = {key: (table, path) for key, (table, path) in self.paths.items() if path != gone}  # nor are their plans held


def smallest_of_components(spark: SparkSession, docs: DataFrame, columns: tuple[str, ...], order: Column,
                           words: int = WORDS, share: int = SHARE) -> DataFrame:
    """columns, n_shingles, smallest of every row: the smallest value of ``order``, made of ``columns``, among the rows
    of its component; null for a row without words."""
    if not 1 <= words <= len(_ODD) or not 1 <= share <= 100:
        raise ValueError(f"words must be 1 to {len(_ODD)}, share 1 to 100")
    small_batches(spark)
    tables = Tables(spark)
    docs = docs.select(*columns, "text")
    rows = tables.keep(described(docs, rarity(docs, words), words, share, columns))
    classes = tables.keep(rows.filter("prefix is not null").select("own", "n", "cells", "prefix", "stars").dropDuplicates(["own"]))
    slim = tables.keep(rows.select(*columns, "own", F.col("n").alias("n_shingles")))
    tables.drop(rows)
    stars = tables.keep(_star_pairs(classes, share))
    links = _verified(docs, stars, tables, words, share)
    tables.drop(stars)
    starred = components(links, tables)
    edges = _window_edges(classes, starred, tables, share)
    more = _linked_groups(docs, classes, starred, edges, tables, words, share)
    tables.drop(edges, classes, links)
    roots = components(starred.select(F.col("own").alias("a"), F.col("root").alias("b")).union(more), tables)
    tables.drop(starred, more)
    least = slim.filter("own is not null").groupBy("own").agg(F.min(order).alias("least"))
    of_root = _rooted(least, roots)
    smallest = of_root.groupBy("root").agg(F.min("least").alias("smallest"))
    named = tables.keep(of_root.join(smallest, "root").select("own", "smallest"))
    tables.drop(roots)
    return slim.join(named, "own", "left").select(*columns, "n_shingles", "smallest")


def jaccard_components(spark: SparkSession, docs: DataFrame, words: int = WORDS, share: int = SHARE) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    found = smallest_of_components(spark, docs, ("doc_id",), F.col("doc_id"), words, share)
    return found.select("doc_id", "n_shingles", F.coalesce("smallest", "doc_id").alias("component_id"))
