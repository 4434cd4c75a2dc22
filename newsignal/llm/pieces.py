"""SentencePiece encoding and decoding in numpy, a batch of words at a time.

The pieces, their scores and the kind of model are read from a ``.model`` file. Words are a run of blanks with
the letters after it; no piece reaches beyond one (else a whole text is one word). Words that a worker meets for the first time are
put together by length, and all words of one length advance together: the hash of every substring comes from
prefix hashes and is looked up among the sorted hashes of the pieces of that length, which gives a table of scores.

* Unigram models take the segmentation with the largest sum of scores: for each end position a vectorised maximum
  over the start positions is kept with its backpointer (Viterbi).
* Byte-pair models merge neighbours instead, the best-scored pair first and the leftmost of equals. The best sum of scores
  is not what such a model encodes to, so Viterbi cannot be used there; the same table of scores drives the merges.

Letters without a piece become their bytes where the model has byte pieces, else the unknown piece. Decoding joins pieces and
bytes and takes off the blank put before the text.

Defined cases: a null text counts as empty and encodes to nothing; rows are encoded one by one, whatever their ids; an empty
table gives an empty result.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

BLANK = "▁"
UNIGRAM, BYTE_PAIRS = 1, 2
MOST_WORDS = 500_000
#: Longer words are merged one by one, with a heap.
LONGEST_BATCHED = 256
#: A letter without a piece costs this much more than the worst piece (fixed value of the format).
UNKNOWN_PENALTY = 10.0
_BASE = np.uint64(0x9E3779B97F4A7C15)


def fields(message: bytes) -> dict[int, list]:
    """Fields of a serialized message: numbers and byte strings by field number."""
    found, at = defaultdict(list), 0

    def number():
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        tag = number()
        kind = tag & 7
        if kind == 0:
            value = number()
        else:
            size = {1: 8, 5: 4}.get(kind) or number()
            value = message[at : at + size]
            at += size
        found[tag >> 3].append(value)
    return found


class Model:
    """What a ``.model`` file says."""

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        whole = fields(self.library.serialized_model_proto())
        trainer, normalizer = fields(whole[2][0]), fields(whole[3][0])
        self.kind = trainer[3][-1] if 3 in trainer else UNIGRAM
        flags = [normalizer[n][-1] if n in normalizer else 1 for n in (3, 4, 5)]
        self.prefixed = bool(flags[0])
        self.plain = flags[1:] == [0, 1] and not any(normalizer.get(2, []))
        self.texts = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.scores = np.array([self.library.get_score(i) for i in range(len(self.texts))], np.float32)
        ids = range(len(self.texts))
        self.bytes = {int(self.texts[i][3:5], 16): i for i in ids if self.library.is_byte(i)}
        special = [self.library.is_byte(i) or self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_unused(i) for i in ids]
        self.ids = {self.texts[i]: i for i in ids if not special[i]}
        self.unknown = self.library.unk_id()
        values = {i: b for b, i in self.bytes.items()}
        self.spelling = [bytes([values[i]]) if i in values else b"" if special[i] and i != self.unknown else self.texts[i].encode() for i in ids]
        self.spelling[self.unknown] = " ⁇ ".encode()
        self.within_words = not any(BLANK in t.lstrip(BLANK) for t in self.ids)
        self.worst = float(min(self.scores[i] for i in self.ids.values())) - UNKNOWN_PENALTY

    def normalized(self, text: str) -> str:
        if not self.plain:
            return self.library.normalize(text)
        return (BLANK if self.prefixed and text else "") + text.replace(" ", BLANK)

    def fallback(self, letter: str) -> list[int]:
        return [self.bytes[b] for b in letter.encode()] if self.bytes else [self.unknown]


def _hashes(codes: np.ndarray) -> np.ndarray:
    """Prefix hashes of rows of code points: [word, length]."""
    sums = np.zeros((len(codes), codes.shape[1] + 1), np.uint64)
    for k in range(codes.shape[1]):
        sums[:, k + 1] = sums[:, k] * _BASE + codes[:, k] + np.uint64(1)
    return sums


def _codes(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1).astype(np.uint64)


class Encoder:
    def __init__(self, path: str):
        self.model = Model(path)
        by_length = defaultdict(list)
        for text, i in self.model.ids.items():
            by_length[len(text)].append((text, i))
        self.keys, self.key_ids = {}, {}
        for length, pieces in by_length.items():
            keys = _hashes(_codes([t for t, _ in pieces]))[:, -1]
            order = np.argsort(keys, kind="stable")
            self.keys[length], self.key_ids[length] = keys[order], np.array([i for _, i in pieces], np.int32)[order]
        self.longest = max(by_length)
        self.known: dict[str, bytes] = {}
        self.split = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+" if self.model.within_words else r"(?s).+")

    def _table(self, words: list[str]) -> np.ndarray:
        """Piece of every substring of words of one length, -1 for none: [word, start, length]."""
        sums, n = _hashes(_codes(words)), len(words[0])
        table = np.full((len(words), n, min(self.longest, n) + 1), -1, np.int32)
        powers = np.cumprod(np.full(table.shape[2], _BASE))
        for length in range(1, table.shape[2]):
            power = powers[length - 1]
            if length in self.keys:
                found = sums[:, length:] - sums[:, : n + 1 - length] * power
                keys = self.keys[length]
                place = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
                table[:, : n + 1 - length, length] = np.where(keys[place] == found, self.key_ids[length][place], -1)
        return table

    def _viterbi(self, table: np.ndarray) -> np.ndarray:
        """Length of the piece that ends the best segmentation at each position: [word, end]."""
        count, n, width = table.shape
        scores = np.where(table >= 0, self.model.scores[table], -np.inf).astype(np.float32)
        scores[:, :, 1] = np.where(table[:, :, 1] >= 0, scores[:, :, 1], self.model.worst)
        best = np.full((count, n + 1), -np.inf, np.float32)
        best[:, 0] = 0
        back = np.zeros((count, n + 1), np.int32)
        for end in range(1, n + 1):
            lengths = np.arange(min(end, width - 1), 0, -1)
            ways = best[:, end - lengths] + scores[:, end - lengths, lengths]
            choice = ways.argmax(axis=1)
            best[:, end], back[:, end] = ways[np.arange(count), choice], lengths[choice]
        starts = np.zeros((count, n), bool)
        at, rows = np.full(count, n), np.arange(count)
        while len(rows):
            at[rows] -= back[rows, at[rows]]
            starts[rows, at[rows]] = True
            rows = rows[at[rows] > 0]
        return starts

    def _merge(self, table: np.ndarray) -> np.ndarray:
        """Starts of the pieces after all merges: [word, start]."""
        count, n, width = table.shape
        scores = np.where(table >= 0, self.model.scores[table], -np.inf).astype(np.float32)
        ends = np.tile(np.arange(1, n + 2), (count, 1))  # of the piece at each start; place n is beyond
        ends[:, n] = n + 1
        starts = np.ones((count, n), bool)
        rows, places = np.arange(count), np.arange(n)
        while len(rows) and n > 1:
            middle = ends[rows, :n]
            far = np.take_along_axis(ends[rows], middle, axis=1)
            length = far - places
            fits = starts[rows] & (middle < n) & (length < width)
            value = np.where(fits, scores[rows[:, None], places, np.where(fits, length, 0)], -np.inf)
            best = value.argmax(axis=1)
            going = value[np.arange(len(rows)), best] > -np.inf
            rows, best, middle, far = rows[going], best[going], middle[going], far[going]
            pick = np.arange(len(rows))
            starts[rows, middle[pick, best]] = False
            ends[rows, best] = far[pick, best]
        return starts

    def _merge_long(self, word: str) -> list[int]:
        """Ends of the pieces of one long word: the same merges, kept in a heap."""
        model, n = self.model, len(word)
        ends, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive, heap = [True] * n, []

        def offer(i):
            k = ends[i] if i >= 0 else n
            if k < n and ends[k] - i <= self.longest and (piece := model.ids.get(word[i : ends[k]])) is not None:
                heapq.heappush(heap, (-float(model.scores[piece]), i, k, ends[k]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, k, end = heapq.heappop(heap)
            if not (alive[i] and ends[i] == k and alive[k] and ends[k] == end):
                continue
            alive[k], ends[i] = False, end
            if end < n:
                before[end] = i
            offer(before[i])
            offer(i)
        return [ends[i] for i in range(n) if alive[i]]

    def _spelled(self, word: str, ends: list[int]) -> bytes:
        ids, start = array("I"), 0
        for end in ends:
            piece = self.model.ids.get(word[start:end])
            ids.extend([piece] if piece is not None else self.model.fallback(word[start:end]))
            start = end
        return ids.tobytes()

    def learn(self, words: list[str]) -> None:
        """Encodes words not met before."""
        by_length = defaultdict(list)
        for word in words:
            by_length[len(word)].append(word)
        segment = self._viterbi if self.model.kind == UNIGRAM else self._merge
        for length, same in by_length.items():
            if length > LONGEST_BATCHED and self.model.kind != UNIGRAM:
                for word in same:
                    self.known[word] = self._spelled(word, self._merge_long(word))
                continue
            step = max(1, 2_000_000 // (length * (self.longest + 1)))
            for first in range(0, len(same), step):
                part = same[first : first + step]
                table = self._table(part)
                starts = segment(table)
                word_of, start = np.nonzero(starts)
                follow = np.append(start[1:], 0)
                end = np.where(np.append(word_of[1:], -1) == word_of, follow, length)
                pieces = np.take_along_axis(table[word_of, start], np.minimum(end - start, table.shape[2] - 1)[:, None], axis=1)[:, 0]
                bounds = np.searchsorted(word_of, np.arange(len(part) + 1))
                ids = pieces.astype("<u4").tobytes()
                plain = np.minimum.reduceat(pieces, bounds[:-1]) >= 0
                for i, word in enumerate(part):
                    a, b = bounds[i], bounds[i + 1]
                    self.known[word] = ids[4 * a : 4 * b] if plain[i] else self._spelled(word, end[a:b].tolist())

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian 32-bit numbers."""
        split = [self.split.findall(self.model.normalized(t)) for t in texts]
        if len(self.known) > MOST_WORDS:
            self.known.clear()
        self.learn(sorted(set().union(*split) - self.known.keys()))
        return [b"".join(map(self.known.__getitem__, words)) for words in split]

    def decode(self, ids: bytes) -> str:
        text = b"".join(map(self.model.spelling.__getitem__, array("I", ids))).decode("utf-8", "replace").replace(BLANK, " ")
        return text[1:] if self.model.prefixed and text.startswith(" ") else text


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode_documents(docs: DataFrame, model: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_ids, ids_crc32, round_trip (whether decoding gives the text) and, if asked for, the ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model)
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                texts = [t or "" for t in part.column("text").to_pylist()]
                ids = encoder.encode(texts)
                columns = [
                    part.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                    pa.array([encoder.decode(x) == t for x, t in zip(ids, texts)], pa.bool_()),
                ]
                names = ["doc_id", "n_ids", "ids_crc32", "round_trip"]
                if keep_ids:
                    columns.append(pa.array([np.frombuffer(x, "<u4").tolist() for x in ids], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_ids bigint, ids_crc32 bigint, round_trip boolean" + (", ids array<int>" if keep_ids else "")
    return docs.select("doc_id", "text").mapInArrow(run, schema)
