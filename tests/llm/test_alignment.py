"""Cross-tokenizer alignment against plain loops over the tokens the libraries give."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from newsignal.llm import alignment
from tokenizers import Tokenizer

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SIDE = alignment.ByteLevel(A)


def plain_groups(ends_a, ends_b):
    cuts = sorted({*ends_a} & {*ends_b})
    return [[next(k for k, c in enumerate(cuts) if e <= c) for e in ends] for ends in (ends_a, ends_b)]


@given(st.lists(st.integers(1, 4), min_size=1, max_size=30), st.lists(st.integers(1, 4), min_size=1, max_size=30))
@settings(max_examples=200, deadline=None)
def test_pointer_jumping_finds_the_groups_between_common_ends(left, right):
    total = max(sum(left), sum(right))
    ends = [np.cumsum([*sizes, *([total - sum(sizes)] if sum(sizes) < total else [])]) for sizes in (left, right)]
    found = [g.tolist() for g in alignment.groups_of(*ends)]
    assert found == plain_groups(*(e.tolist() for e in ends))


def test_long_chains_end_at_the_last_token():
    ends = np.arange(2, 200_002, 2), np.append(np.arange(1, 200_001, 2), 200_000)
    last_a, last_b = alignment.terminals(*ends)
    assert (last_a == len(ends[1]) - 1).all() and (last_b == len(ends[1]) - 1).all()


PIECES = ["'", "'s", "'ll", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", "\u2003", "\u200b", "\u3000", "a", "Z", "é", "9", "½", "²", "!", "..", "日本",
          "👍🏽", "́", "़", "<|endoftext|>", "_", "the", "\0", "\ufeff", "'S", "Ⅷ", "ª"]


@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=20).map("".join) | st.text(max_size=30), min_size=1, max_size=6))
@settings(max_examples=300, deadline=None)
def test_ids_by_parts_equal_the_library(texts):
    library = Tokenizer.from_file(A)
    library.encode_special_tokens = True
    assert SIDE(texts) == [e.ids for e in library.encode_batch([" " + t for t in texts], add_special_tokens=False)]


def plain_tokens(text):
    """Ids of both sides with the end of each token in bytes, by decoding prefixes; None if a side does not give the text back."""
    if not text:
        return None
    tokenizer = Tokenizer.from_file(A)
    tokenizer.encode_special_tokens = True
    whole = (" " + text).encode()
    ids = tokenizer.encode(" " + text, add_special_tokens=False).ids
    model = sentencepiece.SentencePieceProcessor(model_file=B)
    pieces = model.encode(text)
    byte_of = {}
    for b in (*range(33, 127), *range(161, 173), *range(174, 256)):
        byte_of[chr(b)] = b
    others = [b for b in range(256) if b not in byte_of.values()]
    byte_of |= {chr(256 + k): b for k, b in enumerate(others)}
    bytes_a = [bytes(byte_of[c] for c in tokenizer.id_to_token(i)) for i in ids]
    names = [model.id_to_piece(p) for p in pieces]
    bytes_b = [bytes([int(x[3:5], 16)]) if len(x) == 6 and x.startswith("<0x") else x.replace("▁", " ").encode() for x in names]
    if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
        return None
    return ids, np.cumsum([len(x) for x in bytes_a]).tolist(), pieces, np.cumsum([len(x) for x in bytes_b]).tolist()


def plain_report(rows):
    documents, counts = [], Counter()
    for doc_id, text in rows:
        tokens = plain_tokens(text)
        if tokens is None:
            documents.append((doc_id, [], [], "", []))
            continue
        ids, ends_a, pieces, ends_b = tokens
        of_a, of_b = plain_groups(ends_a, ends_b)
        sides = defaultdict(lambda: ([], []))
        for side, (values, groups) in enumerate(((ids, of_a), (pieces, of_b))):
            for value, group in zip(values, groups):
                sides[group][side].append(value)
        shown = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for _, (a, b) in sorted(sides.items()))
        links = [(x, y) for a, b in sides.values() for x in a for y in b]
        counts.update(set(links))
        documents.append((doc_id, ids, pieces, shown, links))
    most = defaultdict(int)
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    return [(
        doc_id, len(ids), len(pieces), shown.count("|"), len(links), sum(counts[x] == most[x[0]] for x in links), sum(counts[x] for x in links),
        hashlib.sha256(shown.encode()).hexdigest() if shown else "") for doc_id, ids, pieces, shown, links in documents]


def texts(prose):
    rows = [(i, prose(i, 12)) for i in range(25)]
    rows += [(100, None), (101, ""), (102, " "), (103, "  two  blanks and\n\n\nlines\t\ttabs"), (104, "日本語 and 👍🏽 emoji é è"), (105, "<|endoftext|> <s> </s> <unk> <0x41> ▁x"),
             (106, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 3), (107, "ﬁne ＡＢＣ ½ ​ ﻿ x"), (108, "nul\x00 \x01\x7f\x85\xa0x"), (109, "========----____!!!!"),
             (None, prose(1, 12)), (3, prose(3, 12)), (3, prose(3, 12)), (3, "other text"), (110, "12345 67890 3.14159 1,000,000"), (111, "̃ä ё й \U0010ffff")]
    return rows


@pytest.mark.parametrize("head", [0, 7, 40, 200_000])
def test_report_matches_plain_loops(spark, docs, prose, head):
    rows = texts(prose)
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "alignment")
    aligned = alignment.align(docs(rows), ("doc_id",), A, B)
    found = alignment.corpus_links(spark, aligned, names, 32_000, head).collect()
    got = [(*r[:5], r.n_best, r.count_sum, hashlib.sha256(r.alignment.encode()).hexdigest() if r.alignment else "") for r in found]
    assert sorted(map(repr, got)) == sorted(map(repr, plain_report(rows)))


def test_report_with_long_text_and_helper_names(spark, docs, prose):
    rows = [(1, prose(1, 20_000)), (2, prose(2, 30))]
    table = docs(rows).withColumnsRenamed({"score": "row", "source": "pairs"})
    found = alignment.alignment_report(spark, table, A, B).collect()
    assert len(found) == 2
    whole = {r.doc_id: r for r in found}
    assert whole[1].n_a == len(Tokenizer.from_file(A).encode(" " + rows[0][1], add_special_tokens=False).ids)
    assert alignment.alignment_report(spark, docs([]), A, B).collect() == []
    with_row = alignment.corpus_links(spark, alignment.align(table, ("doc_id", "row"), A, B), ("row",), 32_000)
    assert with_row.columns == ["row", "n_best", "count_sum"] and with_row.count() == 2
    with pytest.raises(ValueError):
        alignment.align(table, ("pairs",), A, B)


def test_common_pairs_do_not_shuffle(spark, docs, prose):
    """Pairs of the head are summed up where the document is; only the others are exploded."""
    aligned = alignment.align(docs([(i, "the same text") for i in range(50)] + [(99, "rare words")]), ("doc_id",), A, B)
    counts = alignment.pair_counts(aligned, 32_000)
    head = alignment._head(counts, 3)
    assert len(head[0]) == 3 and (head[1] == 50).all()
    left = alignment._with_head(aligned, head, ["doc_id"]).collect()
    assert all((r.pairs == []) == (r.doc_id != 99) for r in left)
