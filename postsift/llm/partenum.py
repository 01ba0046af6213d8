"""N-gram Jaccard join by PartEnum signatures.

A document's set holds its distinct shingles of `size` words (fewer words: the whole sequence; no
words: empty, linked with nothing). Sets are put into bands of sizes that can be similar; a set takes
part in the join of its own band with the next one, and of the band before with its own. In such a
join similar sets differ in at most k elements. The domain is cut into n1 parts, so that some part
differs in at most one element, and each part into three; of these, two at least are then equal. The
signatures of a set are therefore the hashes of two of three sub-parts, for each part.

Weak signatures, of at most `WEAK` elements, would join unlike sets. n1 has `SPARE` parts more than
needed, so that as many parts may be passed over: a set with no more parts than that with a weak
signature leaves these out, any other keeps them. A pair with a set that leaves them out still
shares a signature, and two sets that keep them share theirs; no similar pair is lost.

Signatures are compared block by block: a block of documents sends each of its signatures once, so
one that a third of all documents have costs one entry per block; it gets back the least document of
each. Equal sets are then one node, that of the least key. A document and the least one of a signature
are a candidate pair; it passes a size bound and a parity sketch (its distance never exceeds that of
the sets), then the sets decide. What still may link are members of the same least document in
different components. Of these, all outside the largest component are pivots; members and pivots meet in
cells of bounded bytes, each set sent once per cell, and a cell puts out one true link per pivot and
component that it joins. So rows grow with members, not with pairs, and no pair is left out.

Rows that share a key are one document: what links with one of them is in the component of all. A
null key is never linked and has a null component.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsift.llm import words
from postsift.llm.common import (
    blocks, by_bucket, contains, give_back, int64_column, mix, n_blocks, packed, row_slices, seeded,
    shared_keys, shared_of_block, text_buffer, text_bytes, unpacked,
)
from postsift.llm.components import components
from postsift.sources.staging import pin

_U = np.uint64
WEAK = 1
SPARE = 0.12
#: Bytes of the sets of pivots, and of members, that meet in one task.
CELL_BYTES = 8_000_000
#: Pairs of pivot and member whose sketches are compared at once.
SKETCH_PAIRS = 100_000
#: Rows that say which documents meet where, up to this number, are broadcast, about 16 MB.
BROADCAST_CELLS = 300_000
#: Keys of dropped documents up to this number are broadcast, about 16 MB.
BROADCAST_KEYS = 1_000_000
_SEEDS = seeded("partenum", 8)


@functools.lru_cache(maxsize=8)
def bands(percent: int, largest: int) -> tuple[np.ndarray, np.ndarray]:
    """Greatest size of each band, and k for the join of each band with the next one."""
    ends, low = [], 1
    while low <= largest or len(ends) < 3:
        ends.append(low * 100 // percent)
        low = ends[-1] + 1
    ends = np.array(ends + [low * 100 // percent], np.int64)
    return ends[:-1], (ends[:-1] + ends[1:]) * (100 - percent) // (100 + percent)


def parts_of(k: np.ndarray) -> np.ndarray:
    """Number of first-level parts for distance k: half of them differ in at most one element, and spare ones."""
    need = (k + 2) // 2
    return np.where(k == 0, 1, need + np.ceil(SPARE * need).astype(np.int64))


def signatures(hashes: np.ndarray, rows: np.ndarray, n_rows: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of the sets given as (hash, row), with the row of each."""
    sizes = np.bincount(rows, minlength=n_rows)
    ends, ks = bands(percent, 1 << int(max(4, sizes.max(initial=1))).bit_length())
    band = np.searchsorted(ends, np.maximum(sizes, 1))
    out, owner = [np.empty(0, _U)], [np.empty(0, np.int64)]
    # Of an element: what decides its part, its sub-part, and its share of the sub-part's sum.
    part_of, second_of, share_of = mix(hashes ^ _SEEDS[0]), (mix(hashes ^ _SEEDS[1]) % _U(3)).astype(np.int64), mix(hashes ^ _SEEDS[2])
    for shift in (0, 1):
        join = band - shift
        usable = (sizes > 0) & (join >= 0)
        k = ks[np.maximum(join, 0)]
        n1 = np.where(usable, parts_of(k), 0)
        at = np.concatenate(([0], np.cumsum(3 * n1)))
        inside = slice(None) if usable.all() else usable[rows]
        r = rows[inside]
        first = (part_of[inside] % n1.astype(_U)[r]).astype(np.int64)
        cell = at[r] + 3 * first + second_of[inside]
        sums = np.zeros(at[-1], _U)
        with np.errstate(over="ignore"):
            np.add.at(sums, cell, share_of[inside])
            counts = np.bincount(cell, minlength=at[-1])
            # All three cells of one part, in rows of three.
            sums, counts = sums.reshape(-1, 3), counts.reshape(-1, 3)
            part_row = np.repeat(np.arange(n_rows), n1)
            part = np.arange(len(part_row)) - at[part_row] // 3
            tag = mix(part.astype(_U) * _SEEDS[3] + join[part_row].astype(_U) * _SEEDS[4])
            exact = (k == 0)[part_row]  # equal sets only: the whole part is the signature
            for left_out in range(3):
                a, b = (left_out + 1) % 3, (left_out + 2) % 3
                value = mix(mix(sums[:, a] + _SEEDS[5]) + sums[:, b] * _SEEDS[6] + tag + _U(left_out))
                weak = counts[:, a] + counts[:, b] <= WEAK
                if left_out == 0:
                    whole = mix(mix(sums.sum(axis=1, dtype=_U)) + tag + _U(7))
                    out.append(whole[exact])
                    owner.append(part_row[exact])
                    smallest = counts.sum(axis=1) - counts.max(axis=1) <= WEAK
                    weak_parts = np.bincount(part_row[smallest & ~exact], minlength=n_rows)
                    spare = n1 - (k + 2) // 2
                    lenient = (weak_parts <= spare)[part_row]
                keep = ~exact & ~(weak & lenient)
                out.append(value[keep])
                owner.append(part_row[keep])
    return np.concatenate(out), np.concatenate(owner)


def sketches(hashes: np.ndarray, rows: np.ndarray, n_rows: int) -> list[bytes]:
    """Parity bitmaps: bit h mod m is flipped by each element; m, a power of two, is about the set's size."""
    sizes = np.bincount(rows, minlength=n_rows)
    bits = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))
    at = np.concatenate(([0], np.cumsum(bits)))
    place = at[rows] + (mix(hashes ^ _SEEDS[7]) % bits[rows].astype(_U)).astype(np.int64)
    flipped = (np.bincount(place, minlength=at[-1]) & 1).astype(np.uint8)
    packed_bits = np.packbits(flipped)
    ends = at // 8
    return [packed_bits[ends[i] : ends[i + 1]].tobytes() for i in range(n_rows)]


def sketch_distance(a: bytes, b: bytes) -> int:
    """A lower bound of the number of elements that two sets do not share."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]  # the bitmap of half the bits
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _sets(table: pa.Table, size: int):
    """(first row, row count, hashes, rows, data, offsets) of each slice of a block."""
    data, offsets = text_buffer(table.column("row_text"))
    for a, b in row_slices(offsets):
        found, rows = words.word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        yield a, b - a, *words.shingles(found, rows, b - a, size)


def _keys(table: pa.Table, size: int, percent: int):
    """Signatures and document keys of a block, slice by slice; rows with a null key have none."""
    ids, known = _ids(table)
    for a, n, hashes, rows in _sets(table, size):
        found, owner = signatures(hashes, rows, n, percent)
        owner = owner + a
        keep = known[owner]
        yield found[keep], ids[owner[keep]]


def _ids(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    column = table.column("row_key").combine_chunks()
    known = np.asarray(column.is_valid().to_numpy(zero_copy_only=False), bool)
    return int64_column(column.fill_null(0)), known


def set_digests(hashes: np.ndarray, rows: np.ndarray, n_rows: int) -> list[bytes]:
    """128 bits that follow from the elements of each set."""
    sums = np.zeros((n_rows, 2), _U)
    with np.errstate(over="ignore"):
        for i in (0, 1):
            np.add.at(sums[:, i], rows, mix(hashes ^ _SEEDS[i]))
    return [s.tobytes() for s in sums]


def similar_sets(docs: DataFrame, size: int = 3, percent: int = 90, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: one row per row of `docs`.

    Documents link when 100 * |intersection| >= percent * |union| of their shingle sets; the component
    is the smallest key reachable by links."""
    n = n_blocks(text_bytes(docs, text))
    sent = pin(_find(docs, n, size, percent, key, text), "partenum")
    rows = sent.filter("kind = 0").select(F.col("a").alias("id"), "n", "bits", "d")
    known = rows.filter("bits is not null and id is not null")
    # Equal sets are one node, the least key of them.
    least = known.groupBy("d").agg(F.min("id").alias("node"))
    nodes = pin(known.select("d", "id").distinct().join(least, "d").select("id", "node").distinct(), "nodes")
    first = [F.first(c).alias(c) for c in ("n", "bits")]  # of rows that are equal in all
    sketch = pin(known.join(least.withColumnRenamed("node", "id"), ["id", "d"], "left_semi").groupBy("id", "d").agg(*first).drop("d"), "sketches")
    pairs = _candidates(sent, n).join(nodes.toDF("a", "x"), "a").join(nodes.toDF("b", "y"), "b")
    pairs = pin(pairs.filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "pairs")
    whole = functools.partial(_with_sets, docs=docs, key=key, text=text, size=size)
    stars = components(_linked(pairs, sketch, percent, whole))
    edges = stars.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    edges = edges.unionByName(pin(_rest(pairs, stars, sketch, percent, whole), "links"))
    # Rows of one key may have several sets, whose nodes then are one document.
    several = nodes.groupBy("id").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    edges = edges.unionByName(nodes.join(several, "id").select(F.col("node").alias("a"), "b"))
    labels = components(edges)
    found = nodes.join(labels, "node", "left").groupBy("id").agg(F.min(F.coalesce("component", "node")).alias("component"))
    return rows.select("id", "n").join(found, "id", "left").select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id")
    )


def without_near_copies(docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs`, with all columns, of the smallest key of each component; all rows of a key
    that stays are kept, and so are rows with a null key."""
    found = similar_sets(docs, size, percent, key, text)
    dropped = pin(found.filter("doc_id <> component_id").select(F.col("doc_id").alias(key)).distinct(), "copies")
    if dropped.count() <= BROADCAST_KEYS:
        dropped = F.broadcast(dropped)  # 8 bytes a row; beyond the bound both sides are shuffled
    return docs.join(dropped, key, "left_anti").select(*docs.columns)


_SENT = "kind int, bucket int, block int, keys binary, least binary, a long, n long, bits binary, d binary"


def _find(docs: DataFrame, n: int, size: int, percent: int, key: str, text: str) -> DataFrame:
    """kind 0: (a id, n shingles; bits sketch and d digest of the set if a signature is shared), a row per document;
    1: (bucket, block, keys, least): the shared signatures of a block and the least document of each, by bucket;
    2: (block, keys, least): which shared signature each document of a block has, as places and ids."""
    parts = blocks(docs, n, key, text)
    answers = shared_keys(parts, functools.partial(_keys, size=size, percent=percent), n)

    def send(table: pa.Table, answer: pa.Table) -> pa.Table:
        give_back(cycles=False)
        block = (table if table.num_rows else answer).column("block")[0].as_py()
        ids, known = _ids(table)
        slices = list(_sets(table, size))
        signed = []
        for a, m, hashes, rows in slices:
            found, owner = signatures(hashes, rows, m, percent)
            keep = known[owner + a]
            signed.append((found[keep], owner[keep] + a))
        shared = shared_of_block(table, lambda _: ((k, ids[o]) for k, o in signed), answer, n)
        at, row = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for keys, owner in signed:
            hit = contains(shared, keys)
            at.append(np.searchsorted(shared, keys[hit]))
            row.append(owner[hit])
        at, row = np.concatenate(at), np.concatenate(row)
        needed = np.zeros(len(ids), bool)
        needed[row] = True
        at, member = _distinct(at, ids[row])
        first = np.searchsorted(at, np.arange(len(shared)))
        least = member[first] if len(shared) else np.empty(0, np.int64)
        buckets, ends = by_bucket(shared, n)
        full = np.flatnonzero(ends[1:] > ends[:-1])
        counts, bits, digests = np.zeros(len(ids), np.int64), [], []
        for a, m, hashes, rows in slices:
            counts[a : a + m] = np.bincount(rows, minlength=m)
            want = needed[a : a + m].tolist()
            bits += [b if w else None for b, w in zip(sketches(hashes, rows, m), want)]
            digests += [b if w else None for b, w in zip(set_digests(hashes, rows, m), want)]
        return pa.concat_tables([
            _sent(0, len(ids), a=table.column("row_key").combine_chunks(), n=counts, bits=bits, d=digests),
            _sent(1, len(full), bucket=buckets[full], block=np.full(len(full), block),
                  keys=[shared[ends[b] : ends[b + 1]].tobytes() for b in full], least=[least[ends[b] : ends[b + 1]].tobytes() for b in full]),
            _sent(2, 1, block=np.full(1, block), keys=[at.tobytes()], least=[member.tobytes()]),
        ])

    return parts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(send, _SENT)


def _sent(kind: int, rows: int, **columns) -> pa.Table:
    kinds = {c.split()[0]: {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]] for c in _SENT.split(", ")}
    columns["kind"] = np.full(rows, kind)
    fill = lambda v, of: pa.nulls(rows, of) if v is None else v if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v, of)
    return pa.table({name: fill(columns.get(name), of) for name, of in kinds.items()})


def _distinct(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs, sorted."""
    order = np.lexsort((second, first))
    first, second = first[order], second[order]
    new = np.ones(len(first), bool)
    new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
    return first[new], second[new]


def _candidates(sent: DataFrame, n: int) -> DataFrame:
    """(a, b): each document and the least one of all documents that share a signature with it."""

    def gather(table: pa.Table) -> pa.Table:
        keys, at = unpacked(table.column("keys"), _U)
        order = np.argsort(keys)
        ordered = keys[order]
        first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        least = np.minimum.reduceat(unpacked(table.column("least"), np.int64)[0][order], first)
        back = np.empty(len(keys), np.int64)
        back[order] = np.repeat(least, np.diff(np.append(first, len(ordered))))
        return pa.table({
            "block": table.column("block"), "bucket": table.column("bucket"),
            "least": packed([back[at[i] : at[i + 1]] for i in range(len(at) - 1)]),
        })

    def result(own: pa.Table, replies: pa.Table) -> pa.Table:
        replies = replies.take(pa.array(np.argsort(replies.column("bucket").to_numpy())))
        least = unpacked(replies.column("least"), np.int64)[0]
        at, ids = unpacked(own.column("keys"), np.int64)[0], unpacked(own.column("least"), np.int64)[0]
        a, b = _distinct(ids, least[at])
        return pa.table({"a": pa.array(a[a != b], pa.int64()), "b": pa.array(b[a != b], pa.int64())})

    packets = sent.filter("kind = 1").select("bucket", "block", "keys", "least")
    replies = packets.groupBy("bucket").applyInArrow(gather, "block int, bucket int, least binary")
    own = sent.filter("kind = 2").select("block", "keys", "least")
    return own.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(result, "a long, b long")


def _bit_words(bits: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sketches as numbers of 64 bits, and the n + 1 offsets of the rows; a sketch has one number at least."""
    return unpacked(bits, _U)


def _near(na: np.ndarray, nb: np.ndarray, bits_a: pa.Array, bits_b: pa.Array, at_a: np.ndarray, at_b: np.ndarray,
          percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether sizes and sketches allow that two sets are similar enough, for pairs of places in `bits`,
    and the distances of the sketches."""
    keep = 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)
    bound = (na + nb) * (100 - percent) // (100 + percent)
    (data_a, off_a), (data_b, off_b) = _bit_words(bits_a), _bit_words(bits_b)
    size_a, size_b = np.diff(off_a)[at_a], np.diff(off_b)[at_b]
    left, distance = np.flatnonzero(keep), np.zeros(len(keep), np.int64)
    kinds = size_a[left] * (1 << 32) + size_b[left]
    for kind in np.unique(kinds):
        mine = left[kinds == kind]
        wide, narrow = int(kind >> 32), int(kind & 0xFFFFFFFF)
        for lo in range(0, len(mine), max(1, (1 << 22) // max(wide, narrow, 1))):
            part = mine[lo : lo + max(1, (1 << 22) // max(wide, narrow, 1))]
            x = data_a[off_a[at_a[part]][:, None] + np.arange(wide)]
            y = data_b[off_b[at_b[part]][:, None] + np.arange(narrow)]
            while x.shape[1] > y.shape[1]:
                x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]  # the bitmaps of half the bits
            while y.shape[1] > x.shape[1]:
                y = y[:, : y.shape[1] // 2] ^ y[:, y.shape[1] // 2 :]
            distance[part] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
    return keep & (distance <= bound), distance


def _with_sets(cells: DataFrame, docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """The rows of `cells` with n, bits and s of the documents' sets, made from their texts where these are read."""
    cells = pin(cells, "cells")
    small = cells.count() <= BROADCAST_CELLS  # beyond, both sides are shuffled
    texts = docs.select(docs[key].cast("long").alias("id"), docs[text].alias("row_text"))
    rows = texts.join(F.broadcast(cells) if small else cells, "id").select("home", "chunk", "slice", "id", "c", "pivot", "row_text")

    def run(batches):
        for batch in batches:
            for a, m, hashes, owner in _sets(pa.Table.from_batches([batch]), size):
                counts = np.bincount(owner, minlength=m)
                end = np.concatenate(([0], np.cumsum(counts)))
                yield pa.RecordBatch.from_arrays([
                    *(batch.column(i).slice(a, m) for i in range(6)), pa.array(counts, pa.int64()),
                    pa.array(sketches(hashes, owner, m), pa.binary()), packed([hashes[end[i] : end[i + 1]] for i in range(m)]),
                ], names=["home", "chunk", "slice", "id", "c", "pivot", "n", "bits", "s"])

    return rows.mapInArrow(run, "home long, chunk int, slice int, id long, c long, pivot boolean, n long, bits binary, s binary")


def _linked(pairs: DataFrame, sketch: DataFrame, percent: int, whole) -> DataFrame:
    """Links (a, b) of documents with the least one, of all they are paired with, whose sketch is the nearest."""
    both = pairs.join(sketch.toDF("a", "na", "bits_a"), "a").join(sketch.toDF("b", "nb", "bits_b"), "b")

    def near(batches):
        for batch in batches:
            every = np.arange(batch.num_rows)
            keep, distance = _near(
                int64_column(batch.column(2)), int64_column(batch.column(3)), batch.column(4), batch.column(5), every, every, percent
            )
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(distance, pa.int64())], names=["a", "b", "distance"])
            yield out.filter(pa.array(keep, pa.bool_()))

    close = both.select("a", "b", "na", "nb", "bits_a", "bits_b").mapInArrow(near, "a long, b long, distance long")
    nearest = pin(close.groupBy("a").agg(F.min(F.struct("distance", "b")).alias("x")).select("a", F.col("x.b").alias("b")), "nearest")
    met = nearest.select(F.col("b").alias("home"), F.col("a").alias("id"), F.col("a").alias("c"), F.lit(False).alias("pivot"))
    met = met.unionByName(nearest.select("b").distinct().select(*[F.col("b").alias(x) for x in ("home", "id", "c")], F.lit(True).alias("pivot")))
    return _judged(whole(_cells(met.join(_sizes(sketch), "id"), "bytes")), percent)


def _sizes(sketch: DataFrame) -> DataFrame:
    """Bytes of the sketches, and of the sets with them, of each id."""
    return sketch.groupBy("id").agg(F.sum(F.length("bits")).alias("small"), F.sum(F.col("n") * 8 + F.length("bits")).alias("bytes"))


def _rest(pairs: DataFrame, stars: DataFrame, sketch: DataFrame, percent: int, whole) -> DataFrame:
    """Links (a, b) between members of one least document that are in different components so far."""
    member = pairs.select(F.col("b").alias("home"), F.col("a").alias("id")).unionByName(pairs.select("b", "b").distinct().toDF("home", "id"))
    at = member.join(stars, member["id"] == stars["node"], "left").select("home", "id", F.coalesce("component", "id").alias("c"))
    at = pin(at.join(_sizes(sketch), "id"), "members")
    counts = at.groupBy("home", "c").agg(F.count(F.lit(1)).alias("members"))
    mixed = counts.groupBy("home").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("members", "c")).alias("most")).filter("parts > 1")
    met = at.join(pin(mixed.select("home", F.col("most.c").alias("most")), "mixed"), "home").withColumn("pivot", F.col("c") != F.col("most"))
    # Sketches alone first: sets are sent only where a sketch leaves a partner, so most never are.
    close = _cells(met, "small").join(sketch, "id").groupBy("home", "chunk", "slice").applyInArrow(
        _with_partners(percent), "home long, id long"
    ).distinct()
    left = pin(met.join(close, ["home", "id"], "left_semi"), "partners")
    return _judged(whole(_cells(left, "bytes")), percent)


def _judged(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between pivots and members of each cell that join all of its components that links join."""

    def judge(table: pa.Table) -> pa.Table:
        give_back(cycles=False)
        table = table.combine_chunks()
        pivot = np.asarray(table.column("pivot").to_numpy(zero_copy_only=False), bool)
        ids, n = int64_column(table.column("id")), int64_column(table.column("n"))
        # Components of this cell, joined as links are found.
        group = np.unique(int64_column(table.column("c")), return_inverse=True)[1]
        bits, (hashes, ends) = table.column("bits").combine_chunks(), unpacked(table.column("s"), _U)
        asking, asked = np.flatnonzero(pivot), np.flatnonzero(~pivot)
        out_a, out_b = [], []
        for p, m in _apart(asking, asked, group, n, bits, percent):
            for k in np.unique(p):
                rest = m[p == k]
                rest = rest[group[rest] != group[k]]  # others may have been joined meanwhile
                if not len(rest):
                    continue
                flat = np.concatenate([hashes[ends[i] : ends[i + 1]] for i in rest])
                begin = np.concatenate(([0], np.cumsum(n[rest])))[:-1]
                common = np.add.reduceat(contains(hashes[ends[k] : ends[k + 1]], flat).astype(np.int64), begin)
                for i in rest[100 * common >= percent * (n[k] + n[rest] - common)]:
                    if group[i] != group[k]:
                        out_a.append(ids[k])
                        out_b.append(ids[i])
                        group[group == group[i]] = group[k]
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return rows.groupBy("home", "chunk", "slice").applyInArrow(judge, "a long, b long")


def _cells(met: DataFrame, weight: str) -> DataFrame:
    """home, chunk, slice, id, c, pivot: a pivot meets all slices of the members of
    its home, a member all chunks of the pivots; chunks and slices have about CELL_BYTES of `weight`."""
    totals = met.groupBy("home").agg(F.sum(F.when(F.col("pivot"), F.col(weight))).alias("others"), F.sum(weight).alias("whole"))
    chunks, slices = (F.ceil(F.col(c) / F.lit(CELL_BYTES)).cast("int") for c in ("others", "whole"))
    both = met.join(totals.filter("others > 0"), "home").select("home", "id", "c", "pivot", chunks.alias("chunks"), slices.alias("slices"))
    own = lambda n: F.pmod(F.xxhash64("id", "home"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asking = both.filter("pivot").select("home", "id", "c", "pivot", own("chunks").alias("chunk"), every("slices").alias("slice"))
    asked = both.select("home", "id", "c", F.lit(False).alias("pivot"), every("chunks").alias("chunk"), own("slices").alias("slice"))
    return asking.unionByName(asked).select("home", "chunk", "slice", "id", "c", "pivot")


def _apart(asking: np.ndarray, asked: np.ndarray, group: np.ndarray, n: np.ndarray, bits: pa.Array, percent: int):
    """Pairs of places of pivots and members, some at a time, in different groups that sizes and sketches leave.

    Sketches of one width are a matrix, folded once to the width they are compared at; both sides are in order of
    size, so that a run of pivots meets only the members of sizes that can be similar."""
    data, ends = _bit_words(bits)
    width = np.diff(ends)

    def by_width(at: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        out = {}
        for w in np.unique(width[at]).tolist():
            mine = at[width[at] == w]
            mine = mine[np.argsort(n[mine], kind="stable")]
            out[w] = mine, data[ends[mine][:, None] + np.arange(w)].T
        return out

    def folded(words: np.ndarray, w: int) -> np.ndarray:
        while len(words) > w:
            words = words[: len(words) // 2] ^ words[len(words) // 2 :]  # the bitmaps of half the bits
        return np.ascontiguousarray(words)

    members = by_width(asked)
    for wide, (pivots, x) in by_width(asking).items():
        for other, (rest, y) in members.items():
            w = min(wide, other)
            x_w, y_w, sizes = folded(x, w), folded(y, w), n[rest]
            step = max(1, SKETCH_PAIRS // max(1, len(rest)))
            for lo in range(0, len(pivots), step):
                p = pivots[lo : lo + step]
                first = np.searchsorted(100 * sizes, percent * n[p[0]], "left")
                last = np.searchsorted(percent * sizes, 100 * n[p[-1]], "right")
                m = rest[first:last]
                if not len(m):
                    continue
                distance = np.zeros((len(p), len(m)), np.int32)
                for a, b in zip(x_w[:, lo : lo + step], y_w[:, first:last]):
                    distance += np.bitwise_count(a[:, None] ^ b)
                na, nb = n[p][:, None], n[m]
                keep = (distance <= (na + nb) * (100 - percent) // (100 + percent)) & (group[p][:, None] != group[m])
                keep &= 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)
                at, to = np.nonzero(keep)
                if len(at):
                    yield p[at], m[to]


def _with_partners(percent: int):
    """A function that gives the members of a cell that a sketch leaves a partner of another component."""

    def judge(table: pa.Table) -> pa.Table:
        pivot = np.asarray(table.column("pivot").to_numpy(zero_copy_only=False), bool)
        ids, n, group = (int64_column(table.column(c)) for c in ("id", "n", "c"))
        found = np.zeros(len(ids), bool)
        for p, m in _apart(np.flatnonzero(pivot), np.flatnonzero(~pivot), group, n, table.column("bits").combine_chunks(), percent):
            found[p] = found[m] = True
        some = np.unique(ids[found])
        return pa.table({"home": pa.array(np.full(len(some), table.column("home")[0].as_py()), pa.int64()), "id": pa.array(some, pa.int64())})

    return judge
