"""Terms of blocks of posts by array operations: word 1-2-grams, and n-grams of 3 to 5 characters inside words.

A block is a partition in which all rows of a post lie. It is worked off in slices of whole posts. A word is
cut into n-grams once per slice, terms are numbers until they leave it, and a term's string is made once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD, CHAR = "word", "char_wb"
#: Bytes of units of the posts that are worked off at once.
SLICE_BYTES = 1 << 20
SIZES = (3, 4, 5)


@dataclass
class Slice:
    """Rows of whole posts: `table` has them post by post, `post` their post's number, `keys` the posts' keys."""

    table: pa.Table
    post: np.ndarray
    keys: pa.Array


def slices(batches: Iterable[pa.RecordBatch], key: str, units: list[str], limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """The rows of a block, by slices of whole posts; rows with a null key are one post."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    table = pa.Table.from_batches(batches).combine_chunks()
    codes = _one(table.column(key)).dictionary_encode(null_encoding="encode")
    keys, post = codes.dictionary, codes.indices.to_numpy().astype(np.int64)
    order = np.argsort(post, kind="stable")
    post = post[order]
    sizes = sum(_unit_bytes(_one(table.column(u))) for u in units)[order]
    ends = np.cumsum(sizes)
    borders = np.append(np.flatnonzero(post[1:] != post[:-1]) + 1, len(post))  # a post ends here
    at = 0
    while at < len(post):
        full = (ends[at - 1] if at else 0) + limit
        to = borders[min(np.searchsorted(ends[borders - 1], full, "left"), len(borders) - 1)]
        first, last = post[at], post[to - 1]
        yield Slice(table.take(pa.array(order[at:to])), post[at:to] - first, keys.slice(first, last - first + 1))
        at = int(to)


def _one(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _unit_bytes(lists: pa.ListArray) -> np.ndarray:
    n = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
    size = np.asarray(pc.binary_length(lists.flatten()), np.int64)
    return np.diff(np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(n)))]) + 1


def summed(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and the sums of their `n`, or how often they occur."""
    if not len(keys):
        return keys, np.empty(0, np.int64)
    if n is None:
        keys = np.sort(keys)
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        return keys[first], np.diff(np.append(first, len(keys)))
    bits = int(n.max()).bit_length()
    if int(keys.max()).bit_length() + bits < 63:  # both in one number: a plain sort is much faster
        both = np.sort((keys << bits) | n)
        keys, n = both >> bits, both & ((1 << bits) - 1)
    else:
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(n, first)


def places(terms: pa.Array, known: pa.Array) -> np.ndarray:
    """The place of each term in `known`, or -1."""
    return np.asarray(pc.fill_null(pc.index_in(terms, value_set=known), -1), np.int64)


def counted(analyzer: str, lists: pa.ListArray, post: np.ndarray, known: pa.Array | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(post, place, tf, terms): the terms of each post, by places in `terms`; only those of `known`, if it is given.

    `lists` has the units of each row: word tokens, whose n-grams stay inside the row, or words between blanks."""
    n = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
    units = lists.flatten().dictionary_encode()
    words, unit = units.dictionary, units.indices.to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(n)), n)
    owner, w = post[row], max(1, len(words))
    if analyzer == WORD:
        left = np.flatnonzero(row[1:] == row[:-1])
        pairs, second = np.unique(unit[left] * w + unit[left + 1], return_inverse=True)
        both = pc.binary_join_element_wise(words.take(pa.array(pairs // w)), words.take(pa.array(pairs % w)), pa.scalar(" ", words.type))
        terms = pa.concat_arrays([words, both])
        owner, gram, n = np.concatenate([owner, owner[left]]), np.concatenate([unit, len(words) + second]), None
        if known is not None:
            gram = places(terms, known)[gram]
            owner, gram = owner[gram >= 0], gram[gram >= 0]
    else:
        key, n = summed(owner * w + unit)
        owner, unit = key // w, key % w
        word, gram, terms = char_grams(words.to_pylist())
        if known is not None:
            gram = places(terms, known)[gram]
            word, gram = word[gram >= 0], gram[gram >= 0]
        edges = np.searchsorted(word, np.arange(w + 1))
        size = np.diff(edges)[unit]
        at = np.repeat(edges[unit] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        owner, gram, n = np.repeat(owner, size), gram[at], np.repeat(n, size)
    terms = terms if known is None else known
    g = max(1, len(terms))
    key, tf = summed(owner * g + gram, n)
    return key // g, key % g, tf, terms


def char_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(word, gram, terms): the n-grams of each word between two blanks, in the order of the words."""
    text = "".join([f" {w} " for w in words])
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    length = np.fromiter(map(len, words), np.int64, len(words)) + 2
    start = np.cumsum(length) - length
    letters, code = np.unique(points, return_inverse=True)
    code, word, gram, terms = code.astype(np.int64), [], [], []
    for n in SIZES:
        count = np.maximum(length - n + 1, 0)
        at = np.repeat(start - (np.cumsum(count) - count), count) + np.arange(count.sum())
        value, most = code[at], len(letters)
        for j in range(1, n):
            if most > (1 << 62) // max(1, len(letters)):  # too many letters for one number: ranks of what there is
                value = np.unique(value, return_inverse=True)[1].astype(np.int64)
                most = len(value)
            value, most = value * len(letters) + code[at + j], most * len(letters)
        _, first, number = np.unique(value, return_index=True, return_inverse=True)
        word.append(np.repeat(np.arange(len(words)), count))
        gram.append(len(terms) + number)
        begin = at[first].tolist()
        terms += [text[b : b + n] for b in begin]
    word, gram = np.concatenate(word), np.concatenate(gram)
    order = np.argsort(word, kind="stable")
    return word[order], gram[order], pa.array(terms, pa.string())


def weighed(post: np.ndarray, place: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """(1 + ln tf) * idf, each post scaled to length one."""
    raw = (np.log(tf) + 1.0) * idf[place]
    length = np.sqrt(np.bincount(post, raw * raw))
    return raw / length[post]


def listed(values: np.ndarray, owner: np.ndarray, n: int) -> pa.ListArray:
    """The values of owners 0 to n - 1, which are sorted, as lists."""
    ends = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
