import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from newsignal.llm import packing, pieces, tokencount
from tokenizers import Tokenizer

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["'", "'s", "'ll", "'re", "'v", " ", "  ", "\n", "a", "Z", "é", "´", "9", "!", "..", ". ", "İ,", "Σ", "<|endoftext|>", "<|", "日本", "👍", "\t", "\xa0", "　", "_", "the", "ing", "\0", "µ²"]
texts = st.lists(st.sampled_from(PARTS), max_size=25).map("".join) | st.text(max_size=40)
EDGES = [(1, None), (2, ""), (3, "a"), (3, "a"), (4, " \n"), (5, "word " * 9_000), (6, "x" * 3_000), (None, "no id"), (7, "it's <|endoftext|> here")]
counter, library = tokencount.TokenCounter(BYTES), Tokenizer.from_file(BYTES)
word_ids, word_library = packing.WordIds(WORDS), Tokenizer.from_file(WORDS)
encoder, piece_library = pieces.Encoder(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)


@settings(max_examples=300, deadline=None)
@given(st.lists(texts, min_size=1, max_size=5))
def test_counts_equal_the_library(some):
    assert counter(some) == [len(e.ids) for e in library.encode_batch(some, add_special_tokens=False)]


@settings(max_examples=300, deadline=None)
@given(texts)
def test_word_ids_equal_the_library(text):
    assert np.frombuffer(word_ids.of([text])[0], "<u4").tolist() == word_library.encode(text, add_special_tokens=False).ids


def test_words_are_forgotten_and_learned_again(monkeypatch):
    monkeypatch.setattr(packing, "MOST_WORDS", 5)
    few = packing.WordIds(WORDS)
    for some in (["one two three", "Four, five. six"], ["one seven"], ["two eight nine ten eleven twelve", ""]):
        assert [np.frombuffer(ids, "<u4").tolist() for ids in few.of(some)] == [e.ids for e in word_library.encode_batch(some, add_special_tokens=False)]


def test_words_differ_neither_by_capitals_nor_by_marks_at_the_end(monkeypatch):
    """What a worker keeps grows with the words of letters, and stays under its limit."""
    some = ["Word, word. WORD! (word) Été, été; été", "Été\u0301, word.\x1c ª? 9. a'. it's, <|endoftext|>. Word,\nΣ. word\t,"]
    few = packing.WordIds(WORDS)
    assert [np.frombuffer(ids, "<u4").tolist() for ids in few.of(some)] == [e.ids for e in word_library.encode_batch(some, add_special_tokens=False)]
    few.clear()
    few.of(some[:1])
    assert {word for word in few if word.lower().strip(packing.MARKS) in ("word", "été")} == {"word", "(word", "été"}
    monkeypatch.setattr(packing, "MOST_WORDS", 40)
    for i in range(20):
        few.of([" ".join("qzxjv"[(i * k) % 5] * (k + 1) for k in range(8)) + f" a{i} b{i},"])
        assert len(few) <= 80


@settings(max_examples=300, deadline=None)
@given(texts)
def test_pieces_equal_the_library_and_decode(text):
    ids = encoder.encode([text])[0]
    assert np.frombuffer(ids, "<u4").tolist() == piece_library.encode(text)
    assert encoder.decode(ids) == piece_library.decode(piece_library.encode(text))


def test_viterbi_finds_the_best_sum_of_scores(tmp_path):
    """The same pieces read as a unigram model, against a plain search over all segmentations' prefixes."""
    proto = bytearray(piece_library.serialized_model_proto())
    trainer = pieces.fields(bytes(proto))[2][0]
    at = bytes(proto).index(trainer)
    place = next(i for i in range(len(trainer) - 1) if trainer[i] == 3 << 3 and pieces.fields(trainer[:i] + trainer[i : i + 2]).get(3) == [2])
    proto[at + place + 1] = pieces.UNIGRAM
    (tmp_path / "unigram.model").write_bytes(bytes(proto))
    own = pieces.Encoder(str(tmp_path / "unigram.model"))
    assert own.model.kind == pieces.UNIGRAM

    def best(word):
        sums = [0.0]
        for end in range(1, len(word) + 1):
            sums.append(max(
                sums[a] + (float(own.model.scores[own.model.ids[word[a:end]]]) if word[a:end] in own.model.ids else own.model.worst)
                for a in range(max(0, end - own.longest), end) if word[a:end] in own.model.ids or a == end - 1))
        return sums[-1]

    rng = random.Random(1)
    words = {"▁" + "".join(rng.choice(["the", "qu", "ing", "µ", "a", "日", "er", "x"]) for _ in range(rng.randint(1, 8))) for _ in range(300)}
    own.learn(sorted(words))
    for word in words:
        ids = np.frombuffer(own.known[word], "<u4").tolist()
        letters = sum(c not in own.model.ids for c in word)
        known = [i for i in ids if not own.model.library.is_byte(i)]
        found = sum(float(own.model.scores[i]) for i in known) + letters * own.model.worst
        assert abs(found - best(word)) < 1e-6 * abs(best(word)) + 0.5 and own.decode(own.known[word]) == word[1:]


def test_long_words_merge_like_short_ones():
    word = "▁" + "abcabd" * 40
    assert np.frombuffer(encoder._spelled(word, encoder._merge_long(word)), "<u4").tolist() == piece_library.encode(word[1:])


def test_count_query_handles_edges(spark, docs):
    rows = tokencount.token_counts(docs(EDGES), BYTES).collect()
    want = [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in EDGES]
    assert sorted(map(repr, (tuple(r) for r in rows))) == sorted(repr((*w, w[2] > 1024)) for w in want)
    assert tokencount.token_counts(docs([]), BYTES).collect() == []


def test_a_full_table_of_states_starts_anew(monkeypatch):
    monkeypatch.setattr(tokencount, "MOST_STATES", 50)
    monkeypatch.setattr(tokencount, "MOST_PIECES", 20)
    fresh = tokencount.TokenCounter(BYTES)
    some = ["several different words to be counted", "and others again", "antidisestablishmentarianism"] * 2
    assert [fresh([t])[0] for t in some] == [len(library.encode(t).ids) for t in some]


def test_piece_query_round_trips(spark, docs):
    rows = pieces.encode_documents(docs(EDGES), PIECES, keep_ids=True).collect()
    assert all(r.round_trip for r in rows) and len(rows) == len(EDGES)
    assert {r.n_ids for r in rows if r.doc_id in (1, 2)} == {0}
    assert all(r.ids == piece_library.encode(dict(EDGES)[r.doc_id] or "") for r in rows)


def test_packing_places_every_id_once(spark, docs, prose):
    rows = EDGES + [(i, prose(i, 5 + i * i % 900)) for i in range(100, 260)] + [(20, prose(20, 12_000)), (21, None)]
    found = packing.pack(spark, docs(rows), WORDS).collect()
    ids = defaultdict(list)
    for i, t in rows:
        ids[i].append(np.array(word_library.encode(t or "", add_special_tokens=False).ids + [2], "<u4"))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in found:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        assert any(len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in ids[r.doc_id])
    for i, own in ids.items():
        assert sum(r.length for r in by_doc[i]) == sum(map(len, own))
        if len(own) == 1:
            ends = [(r.start, r.start + r.length) for r in sorted(by_doc[i], key=lambda r: r.start)]
            assert [a for a, _ in ends] == [0] + [b for _, b in ends[:-1]]
    used = {s: sum(r.length for r in rs) for s, rs in by_sequence.items()}
    for s, rs in by_sequence.items():
        rs.sort(key=lambda r: r.offset)
        assert [r.offset for r in rs] == [sum(x.length for x in rs[:k]) for k in range(len(rs))] and used[s] <= 4096
    assert sum(used.values()) > 0.95 * 4096 * (len(used) - 1)
    assert packing.pack(spark, docs([]), WORDS).collect() == []


def test_fit_uses_up_a_histogram_that_combinations_can_fill():
    ways = packing.combinations(8, 3)
    assert len({tuple(w) for w in ways.tolist()}) == len(ways) and (ways.sum(axis=1) == 8).all()
    histogram = np.zeros(8)
    for way, times in (((0, 3, 5), 40), ((2, 2, 4), 30), ((0, 0, 8), 7)):
        for part in way:
            if part:
                histogram[part - 1] += times
    repeats = packing.fit(histogram, ways, 2_000)
    left = histogram.copy()
    for way, times in zip(ways, repeats):
        for part in way:
            if part:
                left[part - 1] -= times
    assert (repeats >= 0).all() and np.abs(left).max() < 1


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=300), st.binary(max_size=300))
def test_checksum_of_a_range(before, rest):
    import pandas as pd

    size = pd.Series([len(rest)])
    found = packing.range_sum.func(pd.Series([zlib.crc32(before)]), pd.Series([zlib.crc32(before + rest)]), size)
    assert found[0] == zlib.crc32(rest)
