"""Two-stage suffix sorting with array operations.

A suffix is of type B when it is smaller than its successor, else of type A. Type-B suffixes are
sorted directly, by eight bytes at a time among those still equal. Type-A suffixes are induced: the
buckets of first bytes are scanned in order, and each suffix met puts its predecessor, if that is of
type A, at the head of the predecessor's bucket. Only suffixes that are asked for are placed, with
the successors of type A that induction needs.
"""

from __future__ import annotations

import numpy as np

SEPARATOR = 0xFF  # never occurs in UTF-8


def types(text: np.ndarray) -> np.ndarray:
    """True for type B. A run of equal bytes has the type of what follows it; the last suffix is type A."""
    n = len(text)
    step = np.empty(n, np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1])
    step[-1] = -1
    change = np.where(step != 0, np.arange(n), n)
    following = np.minimum.accumulate(change[::-1])[::-1]
    return step[following] > 0


def words_at(padded: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes from each position as a big-endian number."""
    return np.lib.stride_tricks.sliding_window_view(padded, 8)[at].copy().view(">u8").ravel().astype(np.uint64)


def sort_directly(padded: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their first `depth` bytes (rounded up to eight); equal ones in any order."""
    key = words_at(padded, at)
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    new = np.ones(len(at), bool)
    new[1:] = key[1:] != key[:-1]
    for offset in range(8, depth, 8):
        alone = new & np.append(new[1:], True)
        open_ = np.flatnonzero(~alone)
        if not len(open_):
            break
        group = np.cumsum(new)[open_]
        key = words_at(padded, at[open_] + offset)
        order = np.lexsort((key, group))
        at[open_] = at[open_[order]]
        key, group = key[order], group[order]
        new[open_[1:]] |= (key[1:] != key[:-1]) & (group[1:] == group[:-1])
    return at


def sort_suffixes(text: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The wanted positions in the order of their suffixes' first `depth` bytes.

    `text` ends with a separator; `wanted` flags its positions."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(depth + 16, np.uint8)])
    type_b = types(text)
    # What induction needs: from a wanted position of type A to the next one of type B.
    next_b = np.minimum.accumulate(np.where(type_b, np.arange(n), n - 1)[::-1])[::-1]
    marks = np.zeros(n + 1, np.int32)
    chosen = np.flatnonzero(wanted)
    np.add.at(marks, chosen, 1)
    np.add.at(marks, next_b[chosen] + 1, -1)
    needed = np.cumsum(marks[:-1]) > 0
    place = np.flatnonzero(needed)
    count_a = np.bincount(text[place[~type_b[place]]], minlength=256)
    direct = sort_directly(padded, place[type_b[place]], depth) if type_b[place].any() else np.empty(0, np.int64)
    count_b = np.bincount(text[direct], minlength=256)
    start = np.concatenate(([0], np.cumsum(count_a + count_b)))
    middle, head = start[:-1] + count_a, start[:-1].copy()
    array = np.full(len(place), -1, np.int64)
    at = np.concatenate(([0], np.cumsum(count_b)))
    for c in np.flatnonzero(count_b):
        array[middle[c] : start[c + 1]] = direct[at[c] : at[c + 1]]
    inducible = needed & ~type_b

    def induce(found: np.ndarray) -> None:
        before = found - 1
        before = before[before >= 0]
        before = before[inducible[before]]
        if not len(before):
            return
        first = text[before]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        for c, size in zip(*np.unique(first, return_counts=True)):
            lo = np.searchsorted(first, c)
            array[head[c] : head[c] + size] = before[lo : lo + size]
            head[c] += size

    if inducible[n - 1]:
        array[head[text[n - 1]]] = n - 1
        head[text[n - 1]] += 1
    for c in np.flatnonzero(count_a + count_b):
        low = start[c]
        while low < head[c]:  # suffixes of this bucket may put others of it behind themselves
            high = head[c]
            induce(array[low:high])
            low = high
        induce(array[middle[c] : start[c + 1]])
    return array[wanted[array]]


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Bytes that each suffix in `order` has in common with the one before it, at most `depth`; first 0."""
    padded = np.concatenate([text, np.zeros(depth + 16, np.uint8)])
    out = np.zeros(len(order), np.int64)
    alike = np.arange(1, len(order))
    for offset in range(0, depth, 8):
        x = words_at(padded, order[alike] + offset) ^ words_at(padded, order[alike - 1] + offset)
        differ = np.flatnonzero(x)
        lead = (x[differ].astype(">u8").view(np.uint8).reshape(-1, 8) != 0).argmax(axis=1)
        out[alike[differ]] = offset + lead
        alike = alike[x == 0]
    out[alike] = depth
    return np.minimum(out, depth)
