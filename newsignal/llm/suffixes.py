"""Suffix arrays over words, by prefix doubling in numpy."""

from __future__ import annotations

from itertools import pairwise

import numpy as np


def dense_ranks(keys: np.ndarray) -> np.ndarray:
    """Rank of each key among the different keys, from 0."""
    order = np.argsort(keys, kind="stable")
    ranks = np.empty(len(keys), np.int64)
    ranks[order] = np.concatenate([[0], np.cumsum(keys[order[1:]] != keys[order[:-1]])]) if len(keys) else 0
    return ranks


def suffix_array(symbols: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Starts of all suffixes in order of their symbols (non-negative numbers); a suffix comes before its extensions.

    With ``depth``, suffixes that agree on that many symbols may stand in any order. Each step doubles the length that is
    in order and sorts only the suffixes that are still tied, so copies of whole texts cost one more step per doubling.
    """
    n = len(symbols)
    if not n:
        return np.empty(0, np.int64)
    order = np.argsort(symbols, kind="stable")
    sorted_symbols = symbols[order]
    first = np.concatenate([[True], sorted_symbols[1:] != sorted_symbols[:-1]])
    # A suffix's rank is the place where its group of tied suffixes starts.
    group = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = group
    known = 1
    tied = np.flatnonzero(~(first & np.append(first[1:], True)))
    while len(tied) and (depth is None or known < depth):
        rows, base = order[tied], group[tied]
        after = rows + known
        key = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        place = np.lexsort((key, base))
        rows, key = rows[place], key[place]
        order[tied] = rows
        new = np.concatenate([[True], (base[1:] != base[:-1]) | (key[1:] != key[:-1])])
        group[tied] = tied[np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))]
        rank[rows] = group[tied]
        alone = new & np.append(new[1:], True)
        tied = tied[~alone]
        known *= 2
    return order


def common_prefixes(symbols: list[int], order: list[int]) -> list[int]:
    """For each suffix in order, how many symbols it shares with the one before (0 for the first)."""
    n = len(symbols)
    before = [-1] * n
    for one, other in pairwise(order):
        before[other] = one
    shared, length = [0] * n, 0
    for i in range(n):
        j = before[i]
        if j < 0:
            length = 0
            continue
        end = n - max(i, j)
        while length < end and symbols[i + length] == symbols[j + length]:
            length += 1
        shared[i] = length
        length = length - 1 if length else 0
    return [shared[i] for i in order]
