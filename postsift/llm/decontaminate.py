"""Benchmark decontamination: a BM25 index of test items, asked by every passage of every text.

Items are indexed as documents, passages are the queries. A posting carries the share that its term
has in the item's score for itself, so scores lie between 0 and 1 and one threshold fits all items.
Passages are windows of 2 L words at every L words, L being the words of the longest item, so each
copy of an item lies whole in a passage; words are runs of letters and digits, lower-cased.

Retrieval follows block-max WAND, worked off for a batch of passages at once: the commonest terms,
whose joint weight in an item stays under `COMMON` of the threshold, cannot lift a passage over it
alone and are set aside; the other terms add up the maxima of their posting blocks, and only item
blocks whose bound reaches the threshold are scored exactly. All items at or above the threshold are
retrieved, then verified: the text must hold `overlap` of the five-word shingles of the question and
of the answer (the item's last sentence; an item of one sentence is all question), or as much of the
whole item, whose sentences may have been altered a little. Parts under five words must occur whole.

Null and empty texts and items have no terms and match nothing; repeated texts match alike; equal
items each match. A null item id is carried like any other.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from postsift.llm import words
from postsift.llm.common import contains, row_slices, text_buffer

K1, B = 1.2, 0.75
THRESHOLD = 0.5
OVERLAP = 0.8
COMMON = 0.4
SHINGLE = 5
BLOCK_ITEMS = 16
#: Items of one broadcast index; a larger set of items is indexed in parts, each asked by all texts.
ITEMS_PER_INDEX = 20_000

_SENTENCE = re.compile(r"(?<=[.?!])\s+|\n+")


def question_and_answer(text: str) -> tuple[str, str]:
    """The item without its last sentence, and that sentence."""
    parts = [p for p in _SENTENCE.split(text.strip()) if p.strip()]
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text, "")


def _terms(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return words.word_hashes(data, np.array([0, len(data)]), words.PLAIN_SPACE)[0]


def _shingles(terms: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    return words.shingles(terms, np.zeros(len(terms), np.int64), 1, size)[0]


def _part(text: str) -> tuple[int, np.ndarray]:
    """Shingle size and shingles of a part of an item: its whole sequence where it is short."""
    terms = _terms(text)
    size = min(SHINGLE, len(terms))
    return size, _shingles(terms, size) if size else np.empty(0, np.uint64)


@dataclass
class Index:
    """Postings by term: items ascending, in blocks of items with the greatest weight of each block."""

    item_ids: list
    terms: np.ndarray  # sorted hashes
    starts: np.ndarray  # of each term's postings
    items: np.ndarray
    weights: np.ndarray
    block_starts: np.ndarray  # of each term's blocks
    blocks: np.ndarray
    block_max: np.ndarray
    common: np.ndarray  # whether a term is set aside
    rest: np.ndarray  # joint weight of an item's set-aside terms
    item_terms: list[np.ndarray]
    item_weights: list[np.ndarray]
    parts: list[tuple]  # of each item: the question, the answer and the whole, see _part
    stride: int
    seen: np.ndarray  # which leading bits of a hash any term has


def build_index(item_ids: list, texts: list[str], document_frequency: dict[int, int], n_items: int, mean_length: float,
                threshold: float = THRESHOLD) -> Index:
    """The index of some items, with the statistics of all of them."""
    shares, rest, postings = [], np.zeros(len(texts)), []
    frequency = lambda t: np.array([document_frequency[v] for v in t.tolist()], float)
    set_aside: dict[int, float] = {}
    for i, text in enumerate(texts):
        terms, tf = np.unique(_terms(text), return_counts=True)
        df = frequency(terms)
        idf = np.log1p((n_items - df + 0.5) / (df + 0.5))
        impact = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * tf.sum() / max(mean_length, 1e-9)))
        shares.append((terms, impact / impact.sum() if len(terms) else impact))
        postings += [(t, i, w) for t, w in zip(terms.tolist(), shares[-1][1].tolist())]
    # Terms in order of frequency, while no item's set-aside weight passes its part of the threshold.
    for t in sorted({p[0] for p in postings}, key=lambda t: (-document_frequency[t], t)):
        set_aside[t] = 0.0
    order = {t: k for k, t in enumerate(set_aside)}
    postings.sort(key=lambda p: (order[p[0]], p[1]))
    common_terms, k = set(), 0
    while k < len(postings):
        end = k
        while end < len(postings) and postings[end][0] == postings[k][0]:
            end += 1
        group = postings[k:end]
        if document_frequency[group[0][0]] < 2 or any(rest[i] + w >= COMMON * threshold for _, i, w in group):
            break
        for _, i, w in group:
            rest[i] += w
        common_terms.add(group[0][0])
        k = end
    postings.sort()
    hashes = np.array([p[0] for p in postings], np.uint64)
    terms, starts = np.unique(hashes, return_index=True)
    items, weights = np.array([p[1] for p in postings], np.int64), np.array([p[2] for p in postings])
    term_of = np.repeat(np.arange(len(terms)), np.diff(np.append(starts, len(hashes))))
    key = term_of * (1 << 32) + items // BLOCK_ITEMS
    block_key, block_at = np.unique(key, return_index=True)
    lengths = [len(_terms(t)) for t in texts]
    parts = [tuple(map(_part, (*question_and_answer(t), t))) for t in texts]
    seen = np.zeros(1 << 20, bool)
    seen[(terms >> np.uint64(44)).astype(np.int64)] = True
    return Index(
        item_ids, terms, np.append(starts, len(hashes)), items, weights,
        np.searchsorted(block_key >> 32, np.arange(len(terms) + 1)), block_key & ((1 << 32) - 1),
        np.maximum.reduceat(weights, block_at) if len(weights) else weights,
        np.array([t in common_terms for t in terms.tolist()], bool), rest,
        [t for t, _ in shares], [w for _, w in shares],
        parts, max([32, *lengths]), seen,
    )


def _expand(starts: np.ndarray, picked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the entries of the picked terms, and to which pick each belongs."""
    sizes = starts[picked + 1] - starts[picked]
    owner = np.repeat(np.arange(len(picked)), sizes)
    ends = np.cumsum(sizes)
    return np.arange(len(owner)) + np.repeat(starts[picked] - (ends - sizes), sizes), owner


def retrieve(index: Index, terms: np.ndarray, rows: np.ndarray, threshold: float = THRESHOLD):
    """(row, item, score) of all items that a passage of a row retrieves, with the best passage's score."""
    none = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    if not len(terms) or not len(index.terms):
        return none
    n = int(rows[-1]) + 1
    counts = np.bincount(rows, minlength=n)
    first = np.concatenate(([0], np.cumsum(counts)))
    # Passages are numbered over all rows; a word lies in its own stride's passage and the one before.
    base = np.concatenate(([0], np.cumsum(counts // index.stride + 1)))
    hit = np.flatnonzero(index.seen[(terms >> np.uint64(44)).astype(np.int64)])
    place = np.minimum(np.searchsorted(index.terms, terms[hit]), len(index.terms) - 1)
    true = index.terms[place] == terms[hit]
    hit, place = hit[true], place[true]
    own = base[rows[hit]] + (hit - first[rows[hit]]) // index.stride
    passage = np.concatenate([own, own - 1])
    term = np.concatenate([place, place])
    good = np.concatenate([np.ones(len(own), bool), own > base[rows[hit]]])
    n_terms = len(index.terms)
    pairs = np.unique(passage[good] * n_terms + term[good])  # each term counts once in a passage
    passage, term = pairs // n_terms, pairs % n_terms
    rare = ~index.common[term]
    # Bounds: the block maxima of the rare terms, and what the set-aside terms can add at most.
    at, owner = _expand(index.block_starts, term[rare])
    n_blocks = len(index.item_ids) // BLOCK_ITEMS + 1
    key = passage[rare][owner] * n_blocks + index.blocks[at]
    found, back = np.unique(key, return_inverse=True)
    bound = np.bincount(back, index.block_max[at], minlength=len(found))
    worst = np.zeros(n_blocks)
    np.maximum.at(worst, np.arange(len(index.rest)) // BLOCK_ITEMS, index.rest)
    found = found[bound + worst[found % n_blocks] >= threshold - 1e-9]
    if not len(found):
        return none
    # Exact scores of the items of the blocks left over, with all terms.
    left = np.isin(passage, found // n_blocks)
    at, owner = _expand(index.starts, term[left])
    items = index.items[at]
    key = passage[left][owner] * n_blocks + items // BLOCK_ITEMS
    chosen = contains(found, key)
    size = len(index.item_ids)
    pair = passage[left][owner][chosen] * size + items[chosen]
    pair, back = np.unique(pair, return_inverse=True)
    score = np.bincount(back, index.weights[at][chosen], minlength=len(pair))
    keep = score >= threshold - 1e-9
    pair, score = pair[keep], np.minimum(score[keep], 1.0)
    row = np.searchsorted(base, pair // size, "right") - 1
    best, back = np.unique(row * size + pair % size, return_inverse=True)
    top = np.zeros(len(best))
    np.maximum.at(top, back, score)
    return best // size, best % size, top


def verify(index: Index, item: int, terms: np.ndarray, known: dict[int, np.ndarray]) -> list[float | None]:
    """Share of the shingles of the question, the answer and the whole item that a text holds.

    `known` keeps the text's shingles by size; a part without words is None."""
    shares: list[float | None] = []
    for size, wanted in index.parts[item]:
        if size and size not in known:
            known[size] = np.sort(_shingles(terms, size))
        shares.append(float(contains(known[size], wanted).mean()) if size else None)
    return shares


def _indexes(items: DataFrame, item_id: str, text: str, threshold: float):
    """Indexes of all items in parts of about ITEMS_PER_INDEX, with statistics over all items."""
    rows = items.select(items[item_id].alias("i"), F.coalesce(items[text], F.lit("")).alias("t"))

    def count(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            terms, owner = words.word_hashes(data, offsets, words.PLAIN_SPACE)
            sizes = np.bincount(owner, minlength=len(offsets) - 1)
            different = np.unique(np.stack([owner.astype(np.uint64), terms]), axis=1)[1]
            total = pa.array([int(sizes.sum())] + [0] * len(different), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([None, *different.astype(np.int64).tolist()], pa.int64()), total], names=["term", "words"]
            )

    counted = rows.mapInArrow(count, "term long, words long")
    n_items = rows.count()
    total = counted.agg(F.sum("words")).first()[0] or 0
    frequency = counted.filter("term is not null").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    parts = max(1, -(-n_items // ITEMS_PER_INDEX))
    marked = rows.withColumn("part", F.pmod(F.xxhash64("i", "t"), F.lit(parts)))
    for part in range(parts):
        # One part of the items and the counts of its own terms.
        mine = marked.filter(F.col("part") == part)
        own = mine.select("i", "t").mapInArrow(count, "term long, words long").select("term").distinct()
        known = {r["term"] & ((1 << 64) - 1): r["n"] for r in frequency.join(own, "term").toLocalIterator()}
        found = sorted(((r["i"], r["t"]) for r in mine.toLocalIterator()), key=lambda r: (r[0] is not None, r[0], r[1]))
        yield build_index([i for i, _ in found], [t for _, t in found], known, n_items, total / max(n_items, 1), threshold)


def find_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_id: str = "item_id",
               item_text: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap (null without an answer), item_overlap,
    leaked: all pairs of a text and an item it retrieves; `leaked` where the overlap is verified."""
    id_type = items.schema[item_id].dataType
    types = _types(id_type)
    rows = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("t"))
    out = None
    for index in _indexes(items, item_id, item_text, threshold):
        shared = docs.sparkSession.sparkContext.broadcast(index)  # at most ITEMS_PER_INDEX items
        found = rows.mapInArrow(
            _search(shared, types, threshold, overlap),
            f"doc_id long, item_id {id_type.simpleString()}, score double, question_overlap double, "
            "answer_overlap double, item_overlap double, leaked boolean",
        )
        out = found if out is None else out.unionByName(found)
    return out


_NAMES = ["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "item_overlap", "leaked"]


def _types(id_type) -> list[pa.DataType]:
    return [pa.int64(), pa.int64() if id_type == "long" else to_arrow_type(id_type), *[pa.float64()] * 4, pa.bool_()]


def _search(shared, types: list[pa.DataType], threshold: float, overlap: float):
    def apply(batches, item_ids: bool = True):
        index = shared.value
        for batch in batches:
            ids = batch.column(0).to_pylist()
            data, offsets = text_buffer(batch.column(1))
            out = []
            for a, b in row_slices(offsets):
                terms, rows = words.word_hashes(
                    data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words.PLAIN_SPACE
                )
                row, item, score = retrieve(index, terms, rows, threshold)
                known, at = {}, -1
                for r, i, s in zip(row.tolist(), item.tolist(), score.tolist()):
                    if r != at:
                        (lo, hi), known, at = np.searchsorted(rows, [r, r + 1]), {}, r
                    question, answer, whole = verify(index, i, terms[lo:hi], known)
                    both = (question or 0) >= overlap and (answer is None or answer >= overlap)
                    out.append((ids[a + r], index.item_ids[i] if item_ids else i, s, question, answer, whole, both or whole >= overlap))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(zip(*out) if out else [[]] * len(types), types)], names=_NAMES
            )

    return apply


def without_leaks(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
                  threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """The rows of `docs`, with all columns, in which no item is leaked."""
    out, place = docs, docs.columns.index(text)
    for index in _indexes(items, item_id, item_text, threshold):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def apply(batches, search=_search(shared, _types("long"), threshold, overlap), place=place):
            for batch in batches:
                numbered = pa.RecordBatch.from_arrays(
                    [pa.array(range(batch.num_rows), pa.int64()), batch.column(place)], names=["row", "t"]
                )
                keep = np.ones(batch.num_rows, bool)
                for found in search([numbered], item_ids=False):
                    rows = found.column(0).to_numpy()
                    keep[rows[np.asarray(found.column(6).to_numpy(zero_copy_only=False), bool)]] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(apply, docs.schema)
    return out
