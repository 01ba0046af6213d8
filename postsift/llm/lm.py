"""Bigram language-model scores from Elias-Fano tries that are built over the whole corpus.

Tokens are lower-cased words and one end per text. Word counts of the training texts give the base
model, (c + 1) / (N + V + 1). The language model interpolates discounted bigram shares with it:
P(w | h) = max(c(hw) - D, 0) / c(h) + D T(h) / c(h) base(w), T(h) being the number of different
followers of h; a text starts in the context of an end, and an unknown context leaves the base.

Counts are gathered by blocks: a block of texts sends each of its words, then each of its bigrams,
once, and gets back what it needs to score its own texts. A bucket of bigrams builds a trie
(contexts, monotone pointers, followers, shares quantised to 8 bits on a logarithmic scale), writes
it to the shared folder, maps it and looks up what the blocks asked. Contexts with a large share of
all tokens are dealt to several buckets by their followers.

Null texts count as empty: their only token is the end. Repeated rows are learned and scored as
often as they occur. Without training texts all scores are those of the empty base model.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsift.llm import words
from postsift.llm.common import (
    blocks, by_bucket, int64_column, mix, n_blocks, packed, row_slices, seeded, text_buffer, text_bytes, unpacked,
)
from postsift.llm.elias_fano import BigramTrie
from postsift.sources.staging import shared_dir

BLOCK_BYTES = 8_000_000
DISCOUNT = 0.75
#: A context with more than this part of a bucket's mean load is dealt to several buckets.
HOT = 0.25
FOLLOWER_BITS = 40
#: Codes 1 to 255 stand for 10^(-(code - 1) / STEPS); 0 is "not in the trie".
STEPS = 28.0

_U = np.uint64
END = int(seeded("end of text", 1)[0])
_PAIR = seeded("pair", 2)


def quantise(share: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(1 - STEPS * np.log10(share)), 1, 255).astype(np.uint8)


CODEBOOK = np.concatenate(([0.0], 10 ** (-np.arange(255) / STEPS)))


def _tokens(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and row of every token, ends included, and whether each row is for training."""
    data, offsets = text_buffer(table.column("row_text"))
    found, owners = [], []
    for a, b in row_slices(offsets):
        token, row = words.word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        place = np.searchsorted(row, np.arange(b - a), "right")
        found.append(np.insert(token, place, _U(END)))
        owners.append(np.insert(row, place, np.arange(b - a)) + a)
    train = np.asarray(table.column("row_train").to_numpy(zero_copy_only=False), bool)
    return np.concatenate([np.empty(0, _U), *found]), np.concatenate([np.empty(0, np.int64), *owners]), train


def _vocabulary(table: pa.Table):
    token, row, train = _tokens(table)
    vocabulary, code = np.unique(token, return_inverse=True)
    counts = np.bincount(code[train[row]], minlength=len(vocabulary))
    return vocabulary, code, row, train, counts


def _global_counts(vocabulary: np.ndarray, answers: pa.Table, n: int) -> tuple[np.ndarray, int, int]:
    """Training counts of a block's words, all training tokens N and words V."""
    _, at = by_bucket(vocabulary, n)
    counts = np.zeros(len(vocabulary), np.int64)
    for bucket, data in zip(answers.column("bucket").to_pylist(), answers.column("counts").to_pylist()):
        counts[at[bucket] : at[bucket + 1]] = np.frombuffer(data, np.int64)
    return counts, sum(answers.column("tokens").to_pylist()), sum(answers.column("types").to_pylist())


def _bigrams(vocabulary: np.ndarray, code: np.ndarray, row: np.ndarray, counts: np.ndarray, total: int, n: int):
    """A block's different bigrams in the order of bucket, context and follower.

    Returns for each bigram its bucket, context (index of the vocabulary) and follower; for every
    token the index of its bigram; and the contexts that each bucket must hear of."""
    end = int(np.searchsorted(vocabulary, _U(END)))
    before = np.concatenate(([end], code[:-1]))
    before[np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))] = end
    cuts = by_bucket(vocabulary, n)[1]
    home = np.searchsorted(cuts, np.arange(len(vocabulary)), "right") - 1
    limit = max(1.0, HOT * total / n)
    fan = np.minimum(n, np.ceil(counts / limit)).astype(np.int64)
    fan = np.where(counts > limit, fan, 1)
    # Followers by rank: a bigram is one number of context and follower, so that the tokens are sorted once by it.
    names = vocabulary >> _U(64 - FOLLOWER_BITS)
    rank = np.cumsum(np.concatenate(([False], names[1:] != names[:-1]))[: len(names)])
    pair = before * max(len(vocabulary), 1) + rank[code]
    order = np.argsort(pair)
    ordered = pair[order]
    new = np.ones(len(order), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    pick = order[new]
    follower, context = names[code[pick]], before[pick]
    turn = (mix(follower + _PAIR[0]) % fan[context].astype(_U)).astype(np.int64)
    # Context and bucket as one number, then the follower.
    first = (home[context] + turn) % n * len(vocabulary) + context
    moved = np.argsort(first, kind="stable")  # only the followers of hot contexts change places
    place = np.empty(len(moved), np.int64)
    place[moved] = np.arange(len(moved))
    index = np.empty(len(order), np.int64)
    index[order] = place[np.cumsum(new) - 1]
    first, follower = first[moved], follower[moved]
    # Every block names a hot context to all of its buckets, so that it hears of all followers.
    hot = np.flatnonzero(fan > 1)
    owner = np.repeat(hot, fan[hot])
    step = np.arange(len(owner)) - np.repeat(np.cumsum(fan[hot]) - fan[hot], fan[hot])
    named = np.unique(np.concatenate([first, ((home[owner] + step) % n) * len(vocabulary) + owner]))
    return first, follower, index, before, named, fan


def score(docs: DataFrame, train, key: str = "doc_id", text: str = "text", discount: float = DISCOUNT,
          root: str | None = None) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score: one row per row of `docs`.

    `train` is a boolean column: the rows that the model learns from. The tries stay under `root`, if
    it is given; else each is removed from the shared folder when its bucket is done."""
    spark = docs.sparkSession
    folder = root or f"{shared_dir(spark)}/bigram-tries/{uuid.uuid4().hex}"
    n = n_blocks(text_bytes(docs, text), BLOCK_BYTES)
    parts = blocks(docs, n, key, text, row_train=F.coalesce(train, F.lit(False)))

    def send_words(table: pa.Table) -> pa.Table:
        vocabulary, _, _, _, counts = _vocabulary(table)
        _, at = by_bucket(vocabulary, n)
        cut = lambda x: packed([x[at[b] : at[b + 1]] for b in range(n)])
        return pa.table({
            "bucket": pa.array(np.arange(n), pa.int32()), "block": pa.array([table.column("block")[0].as_py()] * n, pa.int32()),
            "words": cut(vocabulary), "counts": cut(counts.astype(np.int64)),
        })

    def count_words(table: pa.Table) -> pa.Table:
        found, at = unpacked(table.column("words"), _U)
        counts = unpacked(table.column("counts"), np.int64)[0]
        _, back = np.unique(found, return_inverse=True)
        total = np.zeros(back.max() + 1 if len(back) else 0, np.int64)
        np.add.at(total, back, counts)
        every = total[back] if len(back) else counts
        m = len(at) - 1
        return pa.table({
            "block": table.column("block"), "bucket": table.column("bucket"),
            "counts": packed([every[at[i] : at[i + 1]] for i in range(m)]),
            "spread": pa.nulls(m, pa.binary()),
            "tokens": pa.array([int(total.sum())] * m, pa.int64()), "types": pa.array([int((total > 0).sum())] * m, pa.int64()),
        })

    def send_bigrams(table: pa.Table, answers: pa.Table) -> pa.Table:
        block = (table if table.num_rows else answers).column("block")[0].as_py()
        vocabulary, code, row, train_rows, _ = _vocabulary(table)
        counts, total, _ = _global_counts(vocabulary, answers, n)
        first, follower, index, _, named, fan = _bigrams(vocabulary, code, row, counts, total, n)
        here = np.bincount(index[train_rows[row]], minlength=len(first))
        sizes = np.diff(np.append(np.searchsorted(first, named), len(first)))
        edges = np.arange(n + 1) * len(vocabulary)
        at, to = np.searchsorted(named, edges), np.searchsorted(first, edges)
        context = vocabulary[named % max(len(vocabulary), 1)]
        # A bucket with all followers of a context sums up its count itself.
        own = np.where(fan > 1, counts, 0)[named % max(len(vocabulary), 1)]
        big = here > 254
        full = np.flatnonzero(at[1:] > at[:-1])
        by_context = lambda x: packed([x[at[b] : at[b + 1]] for b in full])
        by_pair = lambda x: packed([x[to[b] : to[b + 1]] for b in full])
        return pa.table({
            "bucket": pa.array(full, pa.int32()), "block": pa.array(np.full(len(full), block), pa.int32()),
            "contexts": by_context(context), "sizes": by_context(sizes.astype(np.int32)), "totals": by_context(own),
            "low": by_pair((follower & _U(0xFFFFFFFF)).astype(np.uint32)), "high": by_pair((follower >> _U(32)).astype(np.uint8)),
            "small": by_pair(np.where(big, 255, here).astype(np.uint8)),
            "large": packed([here[to[b] : to[b + 1]][big[to[b] : to[b + 1]]].astype(np.int64) for b in full]),
        })

    def look_up(table: pa.Table) -> pa.Table:
        contexts, at = unpacked(table.column("contexts"), _U)
        sizes = unpacked(table.column("sizes"), np.int32)[0].astype(np.int64)
        totals = unpacked(table.column("totals"), np.int64)[0]
        low, to = unpacked(table.column("low"), np.uint32)
        follower = low.astype(_U) | (unpacked(table.column("high"), np.uint8)[0].astype(_U) << _U(32))
        here = unpacked(table.column("small"), np.uint8)[0].astype(np.int64)
        here[here == 255] = unpacked(table.column("large"), np.int64)[0]
        # One number below 2^63 for a context: its upper 63 bits.
        names = contexts >> _U(1)
        which, back = np.unique(names, return_inverse=True)
        context_total = np.zeros(len(which), np.int64)
        np.maximum.at(context_total, back, totals)
        owner = np.repeat(back, sizes)
        if len(which) <= 1 << (64 - FOLLOWER_BITS):
            order = np.argsort((owner.astype(_U) << _U(FOLLOWER_BITS)) | follower)
        else:
            order = np.lexsort((follower, owner))
        o, f = owner[order], follower[order]
        new = np.ones(len(order), bool)
        new[1:] = (o[1:] != o[:-1]) | (f[1:] != f[:-1])
        start = np.flatnonzero(new)
        count = np.add.reduceat(here[order], start) if len(start) else np.empty(0, np.int64)
        asked, wanted = o[start], f[start]
        seen = count > 0
        o, f, count = asked[seen], wanted[seen], count[seen]
        own = np.zeros(len(which), np.int64)
        np.add.at(own, o, count)
        context_total = np.where(context_total > 0, context_total, own)
        codes = quantise((count - discount) / np.maximum(context_total[o], 1))
        buffer = BigramTrie.build(which, np.bincount(o, minlength=len(which)), f, codes, FOLLOWER_BITS)
        with _mapped(folder, table.column("bucket")[0].as_py(), buffer, keep=root is not None) as mapped:
            trie = BigramTrie(mapped)
            # What several blocks ask for is looked up once.
            rank, spread = trie.find(which)
            answer, spread = trie.lookup(rank[asked], wanted, FOLLOWER_BITS), spread[back]
        found = np.empty(len(order), np.uint8)
        found[order] = np.repeat(answer, np.diff(np.append(start, len(order))))
        m = len(at) - 1
        return pa.table({
            "block": table.column("block"), "bucket": table.column("bucket"),
            "counts": packed([found[to[i] : to[i + 1]] for i in range(m)]),
            "spread": packed([spread[at[i] : at[i + 1]] for i in range(m)]),
            "tokens": pa.array([0] * m, pa.int64()), "types": pa.array([0] * m, pa.int64()),
        })

    def result(table: pa.Table, answers: pa.Table) -> pa.Table:
        words_part = answers.filter(answers.column("spread").is_null())
        vocabulary, code, row, _, _ = _vocabulary(table)
        counts, total, n_types = _global_counts(vocabulary, words_part, n)
        first, _, index, before, named, _ = _bigrams(vocabulary, code, row, counts, total, n)
        edges = np.arange(n + 1) * len(vocabulary)
        at, to = np.searchsorted(named, edges), np.searchsorted(first, edges)
        codes, followers = np.zeros(len(first), np.uint8), np.zeros(max(len(vocabulary), 1), np.int64)
        pairs = answers.filter(answers.column("spread").is_valid())
        for b, found, spread in zip(*(pairs.column(c).to_pylist() for c in ("bucket", "counts", "spread"))):
            codes[to[b] : to[b + 1]] = np.frombuffer(found, np.uint8)
            followers[named[at[b] : at[b + 1]] % len(vocabulary)] += np.frombuffer(spread, np.int64)
        rows = table.num_rows
        c = counts[code]
        base = (c + 1) / (total + n_types + 1)
        context = counts[before]
        rest = np.where(context > 0, discount * followers[before] / np.maximum(context, 1), 1.0)
        p = CODEBOOK[codes[index]] * (context > 0) + rest * base
        sums = lambda w: np.bincount(row, w, minlength=rows)
        return pa.table({
            "doc_id": table.column("row_key"), "n_tokens": pa.array(np.bincount(row, minlength=rows), pa.int64()),
            "n_known": pa.array(np.bincount(row[c > 0], minlength=rows), pa.int64()),
            "train_tokens": pa.array(np.full(rows, total), pa.int64()),
            "base_score": pa.array(sums(np.log10(base))), "score": pa.array(sums(np.log10(p))),
        })

    reply = "block int, bucket int, counts binary, spread binary, tokens long, types long"
    counted = (
        parts.groupBy("block").applyInArrow(send_words, "bucket int, block int, words binary, counts binary")
        .groupBy("bucket").applyInArrow(count_words, reply)
    )
    looked_up = (
        parts.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(
            send_bigrams, "bucket int, block int, contexts binary, sizes binary, totals binary, low binary, high binary, "
            "small binary, large binary",
        ).groupBy("bucket").applyInArrow(look_up, reply)
    )
    return parts.groupBy("block").cogroup(counted.unionByName(looked_up).groupBy("block")).applyInArrow(
        result, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )


@contextmanager
def _mapped(root: str, bucket: int, buffer: bytes, keep: bool):
    """The trie as a file of the shared folder, mapped where that is a mounted one."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)
    system.create_dir(path, recursive=True)
    name = f"{path}/{bucket}-{uuid.uuid4().hex}.trie"  # an attempt of its own name
    with system.open_output_stream(name, compression=None) as out:
        out.write(buffer)
    try:
        if isinstance(system, fs.LocalFileSystem):
            yield np.memmap(name, np.uint8, "r")
        else:
            yield np.frombuffer(system.open_input_file(name).read(), np.uint8)
    finally:
        if not keep:
            system.delete_file(name)
