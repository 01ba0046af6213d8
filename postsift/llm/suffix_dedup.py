"""Removal of repeated strings of `length` bytes, by suffix arrays.

A byte goes when a string of `length` bytes that covers it also starts in a document with a smaller
key; strings are judged on the input. Equal strings must meet in one suffix array, so each string is
routed by the least hash of its 16-byte substrings: neighbouring strings mostly share it, and
together they form one stretch of text. First, each block of documents says which least hashes it
has; only those that another document has too can belong to a repeated string. Then their stretches
are sent, each different one once per block with its smallest document. A bucket sorts the suffixes
of its stretches in two stages, groups strings whose adjacent common prefixes reach `length`, and
tells for each string whether a smaller document than the block's own has it.

Matches never cross documents. Null texts count as empty; texts shorter than `length` keep all bytes;
rows with equal keys do not remove each other's bytes; a null key counts as the largest.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from postsift.llm.common import (
    blocks, by_bucket, contains, give_back, int64_column, mix, n_blocks, packed, row_slices, seeded, shared_keys,
    shared_of_block, text_buffer, text_bytes, unpacked,
)
from postsift.llm.suffixes import SEPARATOR, common_prefixes, sort_suffixes
from postsift.llm.words import powers, _BASE, _INVERSE

LENGTH = 50
GRAM = 16
SLICE = 256_000
#: A bucket sorts its stretches in so many shares, to hold only one of them as suffixes.
SHARES = 16

_U = np.uint64
_BYTES = seeded("bytes", 256)
_ORDER = seeded("order", 4)


def least_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """For each start of a string of `length` bytes, the least hash of the 16-byte substrings in it."""
    with np.errstate(over="ignore"):
        h, width = _BYTES[data], 1
        while width < GRAM:
            h = h[:-width] * _U(pow(_BASE, width, 1 << 64)) + h[width:]
            width *= 2
        h = mix(h)
    count, width = length - GRAM + 1, 1
    while 2 * width <= count:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    rest = count - width
    return np.minimum(h[: len(h) - rest], h[rest:]) if rest else h


def stretches(data: np.ndarray, offsets: np.ndarray, length: int):
    """(first string, number of strings, least hash, row) of each run of strings with one least hash."""
    none = np.empty(0, np.int64)
    if len(data) < length:
        return none, none, np.empty(0, _U), none
    least = least_hashes(data, length)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(least)]
    inside = np.arange(len(least)) + length <= offsets[row + 1]
    at = np.flatnonzero(inside)
    if not len(at):
        return none, none, np.empty(0, _U), none
    value = least[at]
    new = np.ones(len(at), bool)
    new[1:] = (value[1:] != value[:-1]) | (at[1:] != at[:-1] + 1) | (row[at[1:]] != row[at[:-1]])
    first = np.flatnonzero(new)
    # Least hashes are small numbers; scrambled, they fill all buckets alike.
    return at[first], np.diff(np.append(first, len(at))), mix(value[first]), row[at[first]]


def _documents(table: pa.Table) -> np.ndarray:
    return int64_column(table.column("row_key").combine_chunks().fill_null(np.iinfo(np.int64).max))


def _slices(table: pa.Table, length: int):
    """(rows of the slice, their data and offsets, stretches with block rows) for all slices of a block."""
    data, offsets = text_buffer(table.column("row_text"))
    for a, b in row_slices(offsets, SLICE):
        part, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        first, count, least, row = stretches(part, own, length)
        yield range(a, b), part, own, first, count, least, row + a


def _keys(table: pa.Table, length: int):
    ids = _documents(table)
    for _, _, _, _, _, least, row in _slices(table, length):
        yield least, ids[row]


def _names(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each span's bytes."""
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, _U), np.cumsum(_BYTES[data] * powers(_BASE, len(data)), dtype=_U)))
        raw = (sums[first + size] - sums[first]) * powers(_INVERSE, len(data) + 1)[first]
        return mix(mix(raw + _ORDER[0]) + size.astype(_U))


def _gather(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    ends = np.cumsum(size)
    return data[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - size), size)]


def _candidates(table: pa.Table, length: int, shared: np.ndarray):
    """The stretches of a block with a shared hash: bytes, first string, strings, hash, name, row."""
    for _, part, _, first, count, least, row in _slices(table, length):
        hit = contains(shared, least)
        first, count, least, row = first[hit], count[hit], least[hit], row[hit]
        yield part, first, count, least, _names(part, first, count + length - 1), row


def remove_repeats(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text",
                   carry: list[str] | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, one row per row of
    `docs`; `carry`, if given, adds kept_text, the remaining bytes read as UTF-8 (bytes of cut
    characters are dropped from it; null stays null), and those columns as carried_0, carried_1, ..."""
    n = n_blocks(text_bytes(docs, text))
    more = [f"carried_{i}" for i in range(len(carry or []))]
    parts = blocks(docs, n, key, text, **{name: docs[c] for name, c in zip(more, carry or [])})
    keys_of = functools.partial(_keys, length=length)
    answers = shared_keys(parts, keys_of, n)

    def send(table: pa.Table, answer: pa.Table) -> pa.Table:
        give_back(cycles=False)
        block = (table if table.num_rows else answer).column("block")[0].as_py()
        shared = shared_of_block(table, keys_of, answer, n)
        ids = _documents(table)
        names, least, sizes, owners, texts = [], [], [], [], []
        for part, first, count, key_, name, row in _candidates(table, length, shared):
            order = np.lexsort((ids[row], name))
            fresh = np.ones(len(order), bool)
            fresh[1:] = name[order][1:] != name[order][:-1]
            pick = order[fresh]  # of equal stretches the one of the smallest document
            names.append(name[pick]), least.append(key_[pick]), owners.append(ids[row[pick]])
            sizes.append(count[pick] + length - 1)
            texts.append(_gather(part, first[pick], sizes[-1]))
        name, key_, owner = (np.concatenate([np.empty(0, t), *x]) for x, t in ((names, _U), (least, _U), (owners, np.int64)))
        size, flat = np.concatenate([np.empty(0, np.int64), *sizes]), np.concatenate([np.empty(0, np.uint8), *texts])
        order = np.lexsort((owner, name, key_))
        fresh = np.ones(len(order), bool)
        fresh[1:] = name[order][1:] != name[order][:-1]
        pick = order[fresh]
        start = np.cumsum(size) - size
        key_, name, owner, first, size = key_[pick], name[pick], owner[pick], start[pick], size[pick]
        buckets, at = by_bucket(key_, n)
        full = np.flatnonzero(at[1:] > at[:-1])
        cut = lambda x: packed([x[at[b] : at[b + 1]] for b in full])
        shares = np.diff(by_bucket(key_, n * SHARES)[1]).astype(np.int32).reshape(n, SHARES)
        return pa.table({
            "bucket": pa.array(buckets[full], pa.int32()), "block": pa.array(np.full(len(full), block), pa.int32()),
            "shares": packed(list(shares[full])), "names": cut(name), "owners": cut(owner), "sizes": cut(size.astype(np.int32)),
            "texts": packed([_gather(flat, first[at[b] : at[b + 1]], size[at[b] : at[b + 1]]) for b in full]),
        })

    def judge(table: pa.Table) -> pa.Table:
        give_back(cycles=False)
        names, at = unpacked(table.column("names"), _U)
        owners, sizes = unpacked(table.column("owners"), np.int64)[0], unpacked(table.column("sizes"), np.int32)[0].astype(np.int64)
        flat = text_buffer(table.column("texts"))[0]
        strings = sizes - length + 1
        start, first = np.cumsum(sizes) - sizes, np.cumsum(strings) - strings
        shares = unpacked(table.column("shares"), np.int32)[0]
        share = np.repeat(np.tile(np.arange(SHARES), len(shares) // SHARES), shares)
        bits = np.zeros(int(strings.sum()), bool)
        for i in range(SHARES):  # equal strings are in one share of the bucket
            mine = np.flatnonzero(share == i)
            if len(mine):
                found = earlier(_gather(flat, start[mine], sizes[mine]), sizes[mine], names[mine], owners[mine], length)
                size = strings[mine]
                bits[np.arange(len(found)) + np.repeat(first[mine] - (np.cumsum(size) - size), size)] = found
        ends = np.concatenate(([0], np.cumsum(sizes - length + 1)))
        return pa.table({
            "block": table.column("block"), "names": table.column("names"), "owners": table.column("owners"),
            "counts": packed([(sizes[at[i] : at[i + 1]] - length + 1).astype(np.int32) for i in range(len(at) - 1)]),
            "bits": packed([np.packbits(bits[ends[at[i]] : ends[at[i + 1]]]) for i in range(len(at) - 1)]),
        })

    def result(table: pa.Table, replies: pa.Table) -> pa.Table:
        give_back(cycles=False)
        names, at = unpacked(replies.column("names"), _U)
        owners, counts = unpacked(replies.column("owners"), np.int64)[0], unpacked(replies.column("counts"), np.int32)[0].astype(np.int64)
        flags = [
            np.unpackbits(np.frombuffer(b, np.uint8), count=int(counts[at[i] : at[i + 1]].sum()))
            for i, b in enumerate(replies.column("bits").to_pylist())
        ]
        flags = np.concatenate([np.empty(0, np.uint8), *flags]).astype(bool)
        starts = np.cumsum(counts) - counts
        order = np.argsort(names)
        names, owners, starts = names[order], owners[order], starts[order]
        ids = _documents(table)
        offsets = text_buffer(table.column("row_text"))[1]
        total, spans = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        kept: list[bytes] = []
        for rows, part, own, first, count, _, row in _slices(table, length):
            hit = np.flatnonzero(contains(names, name := _names(part, first, count + length - 1)))
            first, count, row, name = first[hit], count[hit], row[hit], name[hit]
            place = np.searchsorted(names, name)
            ends = np.cumsum(count)
            owner = np.repeat(np.arange(len(count)), count)
            inner = np.arange(len(owner)) - np.repeat(ends - count, count)
            gone = flags[starts[place][owner] + inner] | (ids[row] > owners[place])[owner] if len(owner) else np.zeros(0, bool)
            string = first[owner[gone]] + inner[gone]
            marks = np.bincount(string, minlength=len(part) + 1) - np.bincount(string + length, minlength=len(part) + 1)
            removed = np.cumsum(marks[:-1]) > 0
            for i, lo, hi in zip(rows, own[:-1], own[1:]):
                flag = removed[lo:hi]
                total[i] = flag.sum()
                spans[i] = (flag[1:] & ~flag[:-1]).sum() + flag[:1].sum()
                kept.append(part[lo:hi][~flag].tobytes())
        out = {
            "doc_id": table.column("row_key"), "n_bytes": pa.array(np.diff(offsets), pa.int64()),
            "n_removed": pa.array(total, pa.int64()), "n_spans": pa.array(spans, pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
        }
        if carry is not None:
            null = table.column("row_text").combine_chunks().is_null().to_pylist()
            out["kept_text"] = pa.array([None if z else k.decode(errors="ignore") for k, z in zip(kept, null)], pa.string())
            out |= {c: table.column(c) for c in more}
        return pa.table(out)

    sent = parts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        send, "bucket int, block int, shares binary, names binary, owners binary, sizes binary, texts binary"
    )
    replies = sent.groupBy("bucket").applyInArrow(judge, "block int, names binary, owners binary, counts binary, bits binary")
    return parts.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(
        result, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
        + (", kept_text string" if carry is not None else "")
        + "".join(f", {name} {docs.schema[c].dataType.simpleString()}" for name, c in zip(more, carry or []))
    )


def without_repeats(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with the remaining text of each row, all other columns as they are."""
    others = [c for c in docs.columns if c not in (key, text)]
    found = remove_repeats(docs, length, key, text, carry=others)
    back = {key: found["doc_id"].cast(docs.schema[key].dataType), text: found["kept_text"]}
    back |= {c: found[f"carried_{i}"] for i, c in enumerate(others)}
    return found.select(*[back[c].alias(c) for c in docs.columns])


def earlier(flat: np.ndarray, sizes: np.ndarray, names: np.ndarray, owners: np.ndarray, length: int) -> np.ndarray:
    """For each string of each stretch, whether a smaller document than the stretch's own has it."""
    unique, pick, code = np.unique(names, return_index=True, return_inverse=True)
    start = np.cumsum(sizes) - sizes
    owner = np.full(len(unique), np.iinfo(np.int64).max)
    np.minimum.at(owner, code, owners)
    size = sizes[pick]
    # Equal stretches once, each with a separator behind it.
    text = np.full(int(size.sum()) + len(size), SEPARATOR, np.uint8)
    ends = np.cumsum(size + 1)
    first = ends - size - 1
    inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    text[np.repeat(first, size) + inner] = flat[np.repeat(start[pick], size) + inner]
    strings = size - length + 1
    holder = np.repeat(np.arange(len(unique)), strings)
    begin = np.cumsum(strings) - strings
    at = np.repeat(first, strings) + np.arange(len(holder)) - np.repeat(begin, strings)
    wanted = np.zeros(len(text), bool)
    wanted[at] = True
    order = sort_suffixes(text, wanted, length)
    alike = common_prefixes(text, order, length) >= length
    group = np.flatnonzero(~alike)
    stretch_of = np.zeros(len(text), np.int32)
    stretch_of[at] = holder
    least = np.minimum.reduceat(owner[stretch_of[order]], group) if len(order) else np.empty(0, np.int64)
    first_owner = np.empty(len(text), np.int64)
    first_owner[order] = np.repeat(least, np.diff(np.append(group, len(order))))
    # Back to the stretches as they came.
    count = sizes - length + 1
    ask = np.repeat(begin[code], count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    return first_owner[at][ask] < np.repeat(owners, count)
