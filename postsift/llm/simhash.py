"""SimHash near-dedup with BK-trees.

A fingerprint has 64 bits; a bit is 1 if more than half of the XXH64 values (seed 42) of the text's
word shingles, repeats included, have it. Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z; a
text with fewer words than a shingle is one shingle, one without words has the fingerprint zero.

Fingerprints link at `radius` differing bits or fewer. Equal ones are one node. The 64 bits are cut into
blocks; two fingerprints within the radius agree on all blocks but `radius`, so a shard holds the
fingerprints that agree on one choice of the other blocks, and each link lies within a shard. More
fingerprints take more blocks, so that shards stay small (`layout`). The members of a shard make a
BK-tree: a node's children are keyed by their Hamming distance to it, and a search follows only edges
that differ from the query's distance by no more than the radius. The trees of many small shards are
built and searched together by array operations. Of a shard above `SHARD` members, the members are
dealt to parts of bounded size, each with its own tree; these trees are broadcast to the packets of
all members of the shard as rows of bounded size, never as one Spark broadcast. A part puts out a link
from each member to the least one that it reaches within it, so rows grow with members, not pairs.

Null and empty texts have the fingerprint zero and are linked like any other. A row with a null key
links with nothing and has a null component. Rows that share a key are one document: what links
with one of them is in the component of all.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsift.llm import words
from postsift.llm.common import row_slices, text_buffer
from postsift.llm.components import components
from postsift.sources.staging import pin

BITS = 64
SEED = 42
#: Members of one BK-tree, and of one packet of queries.
SHARD = 20_000
#: Rows of shard members that one task holds, about 24 bytes each.
TASK_ROWS = 400_000
#: Pairs of query and node that a search holds at once.
FRONTIER = 300_000
#: Shingles whose bits are counted at once.
PIECE = 500_000

_U = np.uint64
_LOWER = bytes(words._LOWER.astype(np.uint8))


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 values of the shingles of each row, in text order, and the rows."""
    starts, ends, rows = words.spans(data, offsets)
    text = data.tobytes().translate(_LOWER)
    counts = np.bincount(rows, minlength=len(offsets) - 1)
    # Words one blank apart need no copy; elsewhere words are joined by single blanks first.
    lengths = ends - starts
    joined = b" ".join([text[a:b] for a, b in zip(starts.tolist(), ends.tolist())])
    begin = np.cumsum(lengths + 1) - lengths - 1
    stop = begin + lengths
    first = np.concatenate(([0], np.cumsum(counts)))
    n = np.where(counts == 0, 0, np.maximum(counts - size + 1, 1))
    owner = np.repeat(np.arange(len(counts)), n)
    at = first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    last = np.minimum(at + size, first[owner + 1]) - 1
    digest = xxhash.xxh64_intdigest
    found = [digest(joined[a:b], SEED) for a, b in zip(begin[at].tolist(), stop[last].tolist())]
    return np.array(found, _U), owner


def fingerprints(data: np.ndarray, offsets: np.ndarray, size: int) -> np.ndarray:
    """The fingerprint of each row."""
    n = len(offsets) - 1
    hashes, owner = shingle_hashes(data, offsets, size)
    ones = np.zeros((n, BITS), np.int64)
    for a in range(0, len(hashes), PIECE):  # the bits of a very long text come in pieces
        part, row = hashes[a : a + PIECE], owner[a : a + PIECE]
        bits = np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        ones[row[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    total = np.bincount(owner, minlength=n)
    return np.packbits(2 * ones > total[:, None], axis=1).view(">u8").ravel().astype(_U)


def fingerprint(docs: DataFrame, size: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, bits (the fingerprint as a signed integer): one row per row of `docs`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            found = [fingerprints(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size) for a, b in row_slices(offsets)]
            bits = np.concatenate([np.empty(0, _U), *found]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.int64())], names=["doc_id", "bits"])

    return docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("t")).mapInArrow(run, "doc_id long, bits long")


class Forest:
    """BK-trees of the groups 0, 1, 2 ... of values, built level by level; node i is the root of group i.

    The children of a node are next to each other, sorted by their distance to it: `edge[i]` is the
    distance of node i to its parent, and the children of i are child[i] to child[i + 1]."""

    def __init__(self, values: np.ndarray, groups: np.ndarray) -> None:
        order = np.argsort(groups, kind="stable")
        group = groups[order]
        nodes, edges, parents = [], [], []
        made = 0
        parent_of_group = None
        while len(order):
            first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
            sizes = np.diff(np.append(first, len(order)))
            nodes.append(order[first])
            if parent_of_group is None:
                edges.append(np.full(len(first), -1))
                parents.append(np.full(len(first), -1))
            else:
                which = group[first]
                edges.append(which % 128)
                parents.append(parent_of_group + which // 128)
            # The first of a group is the node, the others go to its children by distance.
            rank = np.repeat(np.arange(len(first)), sizes)
            rest = np.ones(len(order), bool)
            rest[first] = False
            distance = np.bitwise_count(values[order] ^ values[order[first]][rank]).astype(np.int64)
            next_group = (rank * 128 + distance)[rest]
            order = order[rest]
            parent_of_group = made
            made += len(first)
            by = np.argsort(next_group, kind="stable")
            order, group = order[by], next_group[by]
        none = np.empty(0, np.int64)
        self.at = np.concatenate([none, *nodes])
        self.edge = np.concatenate([none, *edges])
        parent = np.concatenate([none, *parents])
        self.value = values[self.at]
        # Levels follow each other and are sorted by parent and edge, so children are ranges.
        self.child = np.searchsorted(parent, np.arange(made + 1))
        self.key = np.where(parent < 0, -1, parent * 128 + self.edge)

    def within(self, queries: np.ndarray, roots: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query places, value places) of all pairs within the radius, piece by piece."""
        todo = [(np.arange(len(queries)), np.asarray(roots, np.int64))]
        while todo:
            q, node = todo.pop()
            if len(q) > FRONTIER:
                half = len(q) // 2
                todo += [(q[half:], node[half:]), (q[:half], node[:half])]
                continue
            distance = np.bitwise_count(queries[q] ^ self.value[node]).astype(np.int64)
            hit = distance <= radius
            if hit.any():
                yield q[hit], self.at[node[hit]]
            inner = self.child[node + 1] > self.child[node]
            q, node, distance = q[inner], node[inner], distance[inner]
            low = np.searchsorted(self.key, node * 128 + np.maximum(distance - radius, 0), "left")
            high = np.searchsorted(self.key, node * 128 + distance + radius, "right")
            n = high - low
            if n.sum():
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                todo.append((np.repeat(q, n), np.repeat(low, n) + step))


def _least(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least number of the component of each of 0 ... n - 1; pairs are merged as they come."""
    label = np.arange(n)
    for a, b in pairs:
        a, b = label[a], label[b]
        while True:
            change = a != b
            if not change.any():
                break
            a, b = a[change], b[change]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label = up
            a, b = label[a], label[b]
    return label


def layout(n: int, radius: int = 3) -> list[tuple[int, ...]]:
    """Which bits each choice of blocks leaves to agree on, as block masks; about n / 2^bits members a shard."""
    for blocks in range(radius + 1, 2 * radius + 1):
        if n >> (BITS * (blocks - radius) // blocks) <= 64:
            break
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    return [tuple(c) for c in itertools.combinations(masks, blocks - radius)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def links(bits: DataFrame, n: int, radius: int = 3) -> DataFrame:
    """(a, b): pairs of distinct `bits` within the radius that connect all such pairs; `n` is their number."""
    spark = bits.sparkSession
    choices = [_signed(sum(c)) for c in layout(n, radius)]
    shard = F.explode(F.array(*[F.struct(F.lit(i).alias("choice"), F.col("bits").bitwiseAND(F.lit(m)).alias("agree")) for i, m in enumerate(choices)]))
    rows = bits.select("bits", shard.alias("shard")).select("shard.choice", "shard.agree", "bits")
    sizes = rows.groupBy("choice", "agree").agg(F.count(F.lit(1)).alias("members"))
    hot = pin(sizes.filter(F.col("members") > SHARD), "shards")
    cold = rows.join(hot, ["choice", "agree"], "left_anti")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n * len(choices) // TASK_ROWS + 1)
    task = F.pmod(F.xxhash64("choice", "agree"), F.lit(tasks)).cast("int")

    def search(table: pa.Table) -> pa.Table:
        values = np.asarray(table.column("bits").to_numpy(), np.int64).view(_U)
        agree = np.asarray(table.column("agree").to_numpy(), np.int64)
        choice = np.asarray(table.column("choice").to_numpy(), np.int64)
        order = np.lexsort((values, agree, choice))
        values, agree, choice = values[order], agree[order], choice[order]
        new = np.concatenate(([True], (agree[1:] != agree[:-1]) | (choice[1:] != choice[:-1])))
        group = np.cumsum(new) - 1
        sizes = np.bincount(group)
        alone = sizes[group] < 2
        values, group = values[~alone], group[~alone]
        if not len(values):
            return _pairs(values, values)
        group = np.unique(group, return_inverse=True)[1]
        forest = Forest(values, group)
        least = _least(len(values), forest.within(values, group, radius))
        linked = least != np.arange(len(values))
        return _pairs(values[linked], values[least[linked]])

    found = cold.select(task.alias("task"), "choice", "agree", "bits").groupBy("task").applyInArrow(search, "a long, b long")
    if not hot.isEmpty():
        found = found.unionByName(_hot_links(rows, hot, radius))
    return found.distinct()


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.Table:
    return pa.table({"a": pa.array(a.view(np.int64), pa.int64()), "b": pa.array(b.view(np.int64), pa.int64())})


def _hot_links(rows: DataFrame, hot: DataFrame, radius: int) -> DataFrame:
    """Links within shards of many members: the tree of each part meets the packets of the shard."""
    parts = F.ceil(F.col("members") * 2 / F.lit(SHARD)).cast("int")
    part = F.pmod(F.xxhash64("bits"), parts).cast("int")
    member = rows.join(hot, ["choice", "agree"]).select("choice", "agree", parts.alias("parts"), part.alias("part"), "bits")
    # Parts of about half the bound; a part as one row of bytes.
    packet = F.sort_array(F.collect_list("bits"))
    packets = pin(member.groupBy("choice", "agree", "parts", "part").agg(packet.alias("members")), "packets")
    met = F.explode(F.expr("sequence(0, part)"))
    asked = packets.select("choice", "agree", "part", "members", met.alias("tree"))
    trees = packets.select("choice", "agree", F.col("part").alias("tree"), F.col("members").alias("nodes"))
    both = asked.join(trees, ["choice", "agree", "tree"]).select("members", "nodes")
    # One row is one search, so that the work of a hot shard is spread over all tasks.
    both = both.repartition(int(both.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                asked, nodes = (np.asarray(batch.column(c)[i].values.to_numpy(), np.int64).view(_U) for c in (0, 1))
                forest = Forest(nodes, np.zeros(len(nodes), np.int64))
                values = np.concatenate([nodes, asked])
                pairs = ((q + len(nodes), at) for q, at in forest.within(asked, np.zeros(len(asked), np.int64), radius))
                least = _least(len(values), pairs)
                linked = least != np.arange(len(values))
                out = _pairs(values[linked], values[least[linked]])
                yield from out.filter(pa.array(values[linked] != values[least[linked]])).to_batches()

    return both.mapInArrow(search, "a long, b long")


def near_copies(docs: DataFrame, size: int = 3, radius: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id: one row per row of `docs`."""
    found = pin(fingerprint(docs, size, key, text), "fingerprints")
    known = found.filter("doc_id is not null")
    distinct = pin(known.groupBy("bits").agg(F.min("doc_id").alias("least")), "fingerprint-nodes")
    pairs = links(distinct.select("bits"), distinct.count(), radius)
    least = distinct.select(F.col("bits").alias("a"), F.col("least").alias("x"))
    edges = pairs.join(least, "a").join(least.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    # Rows of one key may have several fingerprints, and so link their nodes.
    own = known.join(distinct, "bits").filter("doc_id <> least").select(F.col("doc_id").alias("a"), F.col("least").alias("b"))
    several = known.groupBy("doc_id").agg(F.min("bits").alias("p"), F.max("bits").alias("q")).filter("p <> q").select("doc_id")
    edges = edges.unionByName(own.join(several.toDF("a"), "a", "left_semi"))
    label = components(edges)
    node = distinct.join(label, distinct["least"] == label["node"], "left").select(
        "bits", F.coalesce("component", "least").alias("component_id")
    )
    rows = found.join(node, "bits", "left")
    return rows.select(
        "doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )
