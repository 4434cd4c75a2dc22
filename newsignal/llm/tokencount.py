"""Token counts of a byte-level BPE tokenizer by finite-state transducers.

Two deterministic transducers are compiled from the tokenizer's file.

*The splitter* runs over character classes and marks where the tokenizer's pattern starts a new piece. It
has ten states. A buffer of texts is cut into chunks; every chunk is run from all states at once, which
gives its map from state to state, and a prefix scan composes the maps, so that all chunks know
the state they start in and are run side by side.

*The counter* runs over the bytes of a piece; each transition carries the number of tokens by which the
encoding grows (negative where a longer token replaces several). Its state holds, for every place where a
token may still be open, the node reached in the vocabulary's prefix tree, the last token before that place and
the number of tokens up to it. A token may follow another if the two, merged as one string, come out as
these two; that fixes the encoding of every prefix, so each state has exactly one successor per byte. States are
compiled when a text first needs them and kept by the worker up to ``MOST_STATES``; then the table starts
anew, which costs time but no result. All distinct pieces of a buffer advance together.

The count equals that of the tokenizers library without added special tokens; a special token's string in a
text counts one, as the library has it by default. Defined cases: a null text counts as empty (0 tokens, 0 bytes);
rows are counted one by one, whatever their ids; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from newsignal.llm.hashing import in_chunks, span_hashes

MOST_STATES = 120_000
MOST_PIECES = 1_000_000
CHUNK = 64

#: White space of the tokenizer's pattern (fixed values).
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Contractions of the tokenizer's pattern (fixed values).
CONTRACTIONS = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d"]

# Character classes. SHORT: letters that end a contraction after the apostrophe.
PAD, END, LETTER, SHORT, R, V, L, E, NUMBER, BLANK, SPACE, QUOTE, OTHER = range(13)
LETTERS = (LETTER, SHORT, R, V, L, E)
# States: FRESH before any piece or after a contraction; IN_* inside a run; AFTER_BLANK and AFTER_SPACE
# inside white space; QUOTED after an apostrophe that starts a piece; QUOTED_* one letter later.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_BLANK, AFTER_SPACE, QUOTED, QUOTED_R, QUOTED_V, QUOTED_L = range(10)
STATES = 10
# Emissions: a piece starts at this character, or at the one before.
HERE, BEFORE = 1, 2


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """Successor and emission of every (class, state)."""
    follow = np.zeros((13, STATES), np.uint8)
    emit = np.zeros((13, STATES), np.uint8)
    run_of = {**dict.fromkeys(LETTERS, IN_LETTERS), NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, BLANK: AFTER_BLANK, SPACE: AFTER_SPACE, QUOTE: QUOTED}
    same_run = {IN_LETTERS: LETTERS, IN_NUMBERS: (NUMBER,), IN_OTHERS: (OTHER, QUOTE), AFTER_BLANK: (BLANK, SPACE), AFTER_SPACE: (BLANK, SPACE), QUOTED: (OTHER, QUOTE)}
    done = {(QUOTED, SHORT): FRESH, (QUOTED, R): QUOTED_R, (QUOTED, V): QUOTED_V, (QUOTED, L): QUOTED_L, (QUOTED_R, E): FRESH, (QUOTED_V, E): FRESH, (QUOTED_L, L): FRESH}
    for state in range(STATES):
        follow[PAD, state] = state
        opened = state in (QUOTED_R, QUOTED_V, QUOTED_L)
        follow[END, state], emit[END, state] = FRESH, BEFORE if opened else 0
        for kind, run in run_of.items():
            if (state, kind) in done:
                target, mark = done[state, kind], 0
            elif opened:  # no contraction: the letter was the start of a run of its own
                target, mark = run, BEFORE | (0 if run == IN_LETTERS else HERE)
            elif kind in same_run.get(state, ()):
                target, mark = IN_OTHERS if state == QUOTED else run if kind != QUOTE else state, 0
            elif state == AFTER_BLANK:  # the blank belongs to what follows, an apostrophe included
                target, mark = IN_OTHERS if kind == QUOTE else run, BEFORE
            else:
                target, mark = run, HERE | (BEFORE if state == AFTER_SPACE else 0)
            follow[kind, state], emit[kind, state] = target, mark
    return follow, emit


def _classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
    table[WHITE_SPACE] = SPACE
    table[0x20], table[ord("'")] = BLANK, QUOTE
    for letter, kind in (("s", SHORT), ("t", SHORT), ("m", SHORT), ("d", SHORT), ("r", R), ("v", V), ("l", L), ("e", E)):
        table[ord(letter)] = kind
    return table


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary: printable ones for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Splitter:
    def __init__(self):
        self.follow, self.emit = (t.reshape(-1) for t in _splitter())
        self.classes = _classes()

    def starts(self, chars: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Whether a piece starts at each character. ``ends`` marks the character after each text."""
        kinds = self.classes[chars]
        kinds[ends] = END
        rows = -(-len(kinds) // CHUNK)
        grid = np.full(rows * CHUNK, PAD, np.uint8)
        grid[: len(kinds)] = kinds
        steps = np.ascontiguousarray(grid.reshape(rows, CHUNK).T).astype(np.int32) * STATES
        maps = np.tile(np.arange(STATES, dtype=np.uint8), (rows, 1))
        for step in steps:
            maps = self.follow[step[:, None] + maps]
        state = self._scan(maps)
        marks = np.empty((CHUNK, rows), np.uint8)
        for k, step in enumerate(steps):
            at = step + state
            marks[k] = self.emit[at]
            state = self.follow[at]
        marks = np.ascontiguousarray(marks.T).reshape(-1)[: len(kinds)]
        found = (marks & HERE).astype(bool)
        found[:-1] |= (marks[1:] & BEFORE).astype(bool)
        return found

    @staticmethod
    def _scan(maps: np.ndarray) -> np.ndarray:
        """State in which each chunk starts: prefix composition of the maps, doubling the reach."""
        reach, total = 1, maps
        while reach < len(total):
            combined = total.copy()
            combined[reach:] = np.take_along_axis(total[reach:], total[:-reach], axis=1)
            total, reach = combined, reach * 2
        return np.concatenate([[FRESH], total[:-1, FRESH]]).astype(np.uint8)


class Counter:
    """The transducer over the bytes of a piece, compiled on demand."""

    def __init__(self, path: str):
        model = json.load(open(path, encoding="utf-8"))
        letters = _byte_letters()
        ids = model["model"]["vocab"]
        spell = lambda token: bytes(letters[c] for c in token)
        self.spelling = {i: spell(t) for t, i in ids.items()}
        merges = (m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"])
        self.merges = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(merges)}
        self.single = {s[0]: i for i, s in self.spelling.items() if len(s) == 1}
        self.special = [t["content"] for t in model["added_tokens"]]
        self.children: dict[int, int] = {}
        self.token = [-1]
        inner = set()
        for i, s in self.spelling.items():
            node = 0
            for b in s:
                inner.add(node)
                node = self.children.setdefault(node << 8 | b, len(self.token))
                if node == len(self.token):
                    self.token.append(-1)
            self.token[node] = i
        self.inner = inner
        self.fits: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        start = ((0, -1, 0),)
        self.numbers, self.states = {start: 0}, [start]
        self.column = np.zeros(256, np.int64)  # of the tables, for each byte met; column 0 stays empty
        self.columns = 1
        self.follow = np.full((1024, 64), -1, np.int32)
        self.grow = np.zeros((1024, 64), np.int8)

    def _widen(self, rows: int, columns: int) -> None:
        more = ((0, rows), (0, columns))
        self.follow = np.pad(self.follow, more, constant_values=-1)
        self.grow = np.pad(self.grow, more)

    def merged(self, text: bytes) -> list[int]:
        """Tokens of a few bytes by the merge rules: the best pair first, the leftmost of equals."""
        tokens = [self.single[b] for b in text]
        while len(tokens) > 1:
            rank, at = min((self.merges.get(p, (1 << 60,))[0], i) for i, p in enumerate(zip(tokens, tokens[1:])))
            if rank == 1 << 60:
                break
            tokens[at : at + 2] = [self.merges[tokens[at], tokens[at + 1]][1]]
        return tokens

    def may_follow(self, last: int, token: int) -> bool:
        known = self.fits.get((last, token))
        if known is None:
            if len(self.fits) > 20 * MOST_STATES:
                self.fits.clear()
            before = [] if last < 0 else [last]
            text = b"".join(self.spelling[t] for t in [*before, token])
            known = self.fits[last, token] = self.merged(text) == [*before, token]
        return known

    def compile(self, state: int, byte: int) -> None:
        opened, ending = [], None
        for node, last, count in self.states[state]:
            child = self.children.get(node << 8 | byte)
            if child is None:
                continue
            token = self.token[child]
            if ending is None and token >= 0 and self.may_follow(last, token):
                ending = (token, count + 1)
            if child in self.inner:
                opened.append((child, last, count))
        token, grown = ending
        key = (*((node, last, count - grown) for node, last, count in opened), (0, token, 0))
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.states)
            self.states.append(key)
            if number == len(self.follow):
                self._widen(number, 0)
        if not self.column[byte]:
            if self.columns == self.follow.shape[1]:
                self._widen(0, self.columns)
            self.column[byte] = self.columns
            self.columns += 1
        self.follow[state, self.column[byte]] = number
        self.grow[state, self.column[byte]] = grown

    def counts(self, buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Tokens of each piece, given by its place in the buffer."""
        if len(self.states) > MOST_STATES:
            self.reset()
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        state = np.zeros(len(order), np.int32)
        total = np.zeros(len(order), np.int32)
        active = len(order)
        for k in range(int(lengths[0]) if len(lengths) else 0):
            active = np.searchsorted(-lengths, -k, side="left")
            now, byte = state[:active], buffer[starts[:active] + k]
            missing = np.flatnonzero(self.follow[now, self.column[byte]] < 0)
            for key in np.unique(now[missing].astype(np.int64) << 8 | byte[missing]):
                self.compile(int(key) >> 8, int(key) & 255)
            column = self.column[byte]
            total[:active] += self.grow[now, column]
            state[:active] = self.follow[now, column]
        result = np.empty_like(total)
        result[order] = total
        return result


class TokenCounter:
    """Counts for whole texts; keeps the counts of pieces it has met, up to ``MOST_PIECES``."""

    def __init__(self, path: str):
        self.splitter, self.counter = Splitter(), Counter(path)
        self._forget()

    def _forget(self) -> None:
        self.known, self.known_counts = np.empty(0, np.uint64), np.empty(0, np.int32)

    def _piece_counts(self, buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        hashes = span_hashes(buffer, starts, ends)
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(self.known, distinct), max(len(self.known) - 1, 0))
        met = self.known[place] == distinct if len(self.known) else np.zeros(len(distinct), bool)
        counts = np.zeros(len(distinct), np.int32)
        counts[met] = self.known_counts[place[met]]
        new = first[~met]
        counts[~met] = self.counter.counts(buffer, starts[new], ends[new] - starts[new])
        if len(self.known) + len(new) > MOST_PIECES:
            self._forget()
        keys, values = np.concatenate([self.known, distinct[~met]]), np.concatenate([self.known_counts, counts[~met]])
        order = np.argsort(keys, kind="stable")
        self.known, self.known_counts = keys[order], values[order]
        return counts[which]

    def _count_chunk(self, texts: list[str]) -> np.ndarray:
        parts, owners, specials = [], [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            pieces = [text]
            for special in self.counter.special:
                pieces = [p for piece in pieces for p in piece.split(special)]
            specials[i] = len(pieces) - 1
            parts += pieces
            owners += [i] * len(pieces)
        joined = "\0".join([*parts, ""])
        chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        buffer = np.frombuffer(joined.encode(), np.uint8)
        ends = np.cumsum([len(p) + 1 for p in parts]) - 1
        starts = self.splitter.starts(chars, ends)
        starts[ends] = True
        sizes = 1 + (chars > 0x7F) + (chars > 0x7FF) + (chars > 0xFFFF)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        where = np.flatnonzero(starts)
        real = ~np.isin(where, ends, assume_unique=True)
        begin, finish = offsets[where], np.concatenate([offsets[where[1:]], [len(buffer)]])
        owner = np.searchsorted(ends, where[real], side="left")
        counts = self._piece_counts(buffer, begin[real], finish[real])
        per_part = np.bincount(owner, counts, minlength=len(parts)).astype(np.int64)
        return np.bincount(owners, per_part, minlength=len(texts)).astype(np.int64) + specials

    def __call__(self, texts: list[str]) -> list[int]:
        encoded = (t.encode() for t in texts)
        return [int(n) for chunk in in_chunks(encoded) for n in self._count_chunk([t.decode() for t in chunk])]


_counters: dict[str, TokenCounter] = {}


def _counter(path: str) -> TokenCounter:
    """One for each worker process: what it compiled serves the tasks that follow."""
    if path not in _counters:
        _counters[path] = TokenCounter(path)
    return _counters[path]


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row. ``tokenizer`` is the path of the .json file."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(tokenizer)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            tokens = counter(texts)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"),
                pa.array([len(t.encode()) for t in texts], pa.int64()),
                pa.array(tokens, pa.int64()),
                pa.array([n > limit for n in tokens], pa.bool_()),
            ], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        count, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
