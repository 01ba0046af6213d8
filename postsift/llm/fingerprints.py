"""Lempel-Ziv fingerprints: the phrase set of a document, kept as minimum hashes.

A document is parsed as in LZ78: the shortest run of characters that is not yet in the dictionary
becomes a phrase. Phrases are hashed, and a fingerprint keeps for each of `SLOTS` parts of the hash
domain one byte of the least hash in it (0: no phrase there). The likeness of two fingerprints
estimates the Jaccard similarity of the phrase sets, corrected for chance agreement of bytes; equal
texts have equal fingerprints and likeness 1. Null counts as empty; two empty texts are alike (1),
an empty and another text are not (0).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postsift.llm.common import mix, n_blocks, text_bytes

SLOTS = 256
#: More ranges of keys than this would make the list of cuts long; a range is read as a stream.
MAX_RANGES = 4096

_START, _FACTOR, _MASK = 0x0BF29CE484222325, 0x100000001B3, (1 << 61) - 1


def parse(text: str, phrases: set[int], state: int = _START) -> int:
    """Add the phrases of `text` to `phrases`, going on from `state`; the state after it."""
    add, h = phrases.add, state
    for c in np.frombuffer(text.encode("utf-32-le"), np.uint32).tolist():
        h = (h ^ c) * _FACTOR & _MASK
        if h not in phrases:
            add(h)
            h = _START
    return h


def signature(phrases: set[int]) -> np.ndarray:
    """One byte per slot: 1 + least hash modulo 255, or 0 where no phrase falls."""
    hashes = mix(np.fromiter(phrases, np.uint64, len(phrases)))
    least = np.full(SLOTS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, (hashes >> np.uint64(56)).astype(np.int64), hashes & np.uint64((1 << 56) - 1))
    empty = least == np.iinfo(np.uint64).max
    return np.where(empty, 0, 1 + least % np.uint64(255)).astype(np.uint8)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity of two signatures, 0 to 1."""
    used = (a > 0) | (b > 0)
    if not used.any():
        return 1.0
    rate = float(((a == b) & used).sum()) / float(used.sum())
    chance = 1 / 255
    return max(0.0, (rate - chance) / (1 - chance))


def fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds `fingerprint` (hex) to all columns, row by row."""

    @F.pandas_udf("string")
    def of(texts):
        def one(t):
            phrases: set[int] = set()
            parse(t or "", phrases)
            return signature(phrases).tobytes().hex()

        return texts.map(one)

    return docs.withColumn("fingerprint", of(docs[text]))


def _chain(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(bucket, guest, k, doc_id, t): ranges of keys, each with the row that follows it as a guest.

    In a range, rows in the order of `k` descending are followed by the first row of the next range
    (of the first one after the last). The cuts are at most MAX_RANGES numbers.
    """
    rows = docs.select(
        docs[key].cast("long").alias("doc_id"),
        F.coalesce(docs[key].cast("long"), F.lit(-(2**63))).alias("k"),  # null comes last
        docs[text].alias("t"),
    )
    n = min(MAX_RANGES, n_blocks(text_bytes(docs, text)))
    cuts = sorted({int(c) for c in rows.approxQuantile("k", [i / n for i in range(1, n)], 0.25 / n)}) if n > 1 else []
    placed = rows.withColumn("bucket", _bucket(F.col("k"), cuts))
    heads = sorted(
        ((r["bucket"], r["head"]) for r in placed.groupBy("bucket").agg(F.max("k").alias("head")).collect()),
        reverse=True,
    )
    if not heads:
        return placed.withColumn("guest", F.lit(False))
    # The head of each range is the guest of the range before it.
    before = [heads[-1][0], *[b for b, _ in heads[:-1]]]
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("to", T.IntegerType())])
    guests = docs.sparkSession.createDataFrame([(h, b) for (_, h), b in zip(heads, before)], schema)
    invited = placed.join(F.broadcast(guests), "k")  # at most MAX_RANGES rows
    columns = ["bucket", "guest", "k", "doc_id", "t"]
    return placed.withColumn("guest", F.lit(False)).select(columns).unionByName(
        invited.select(F.col("to").alias("bucket"), F.lit(True).alias("guest"), "k", "doc_id", "t")
    )


def _bucket(k, cuts: list[int]):
    """How many cuts are at or under `k`, by halving."""
    if not cuts:
        return F.lit(0)
    mid = len(cuts) // 2
    if len(cuts) == 1:
        return F.when(k >= cuts[0], F.lit(1)).otherwise(F.lit(0)).cast("int")
    low = _bucket(k, cuts[:mid]) if mid else F.lit(0)
    high = _bucket(k, cuts[mid + 1 :]) + F.lit(mid + 1) if mid + 1 < len(cuts) else F.lit(mid + 1)
    return F.when(k >= cuts[mid], high).otherwise(low).cast("int")


def compare_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edited text, and the likeness to that and to the next text.

    The next document is the one with the next smaller key (after the last: the first; null is the
    smallest, equal keys follow each other by text). The edited text is the text whose last
    floor(n / 2) code points are replaced by the first as many of the next text. A single document
    is its own next one. Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next: one row per row of `docs`.
    """
    chained = _chain(docs, key, text)
    count = n_blocks(text_bytes(docs, text))
    ordered = chained.repartition(min(MAX_RANGES, count), "bucket").sortWithinPartitions(
        F.col("bucket"), F.col("guest"), F.col("k").desc(), F.col("t")
    ).select("bucket", "guest", "doc_id", "t")
    return ordered.mapInArrow(
        _follow,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double",
    )


class _Row:
    """A document whose next one is still to come."""

    def __init__(self, doc_id, text: str):
        self.doc_id, self.text, half = doc_id, text, len(text) // 2
        self.kept = text[: len(text) - half]
        self.phrases: set[int] = set()
        self.state = parse(self.kept, self.phrases)
        whole = self.phrases.copy()
        parse(text[len(self.kept) :], whole, self.state)
        self.signature = signature(whole)

    def meet(self, other: _Row) -> tuple:
        tail = other.text[: len(self.text) // 2]
        parse(tail, self.phrases, self.state)
        edited = signature(self.phrases)
        return (
            self.doc_id, len(self.text), hashlib.sha256((self.kept + tail).encode()).hexdigest(),
            self.signature.tobytes().hex(), edited.tobytes().hex(),
            likeness(self.signature, edited), likeness(self.signature, other.signature),
        )


_TYPES = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
_NAMES = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def _follow(batches):
    last, at = None, None
    for batch in batches:
        out = []
        rows = zip(*[batch.column(i).to_pylist() for i in range(3)])
        texts = batch.column(3)
        for i, (bucket, guest, doc_id) in enumerate(rows):
            if guest and last is None:
                continue  # a further row with the key of the guest
            row = _Row(doc_id, texts[i].as_py() or "")
            if last is not None and bucket == at:
                out.append(last.meet(row))
            last, at = (None if guest else row), bucket
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(c), t) for c, t in zip(zip(*out) if out else [[]] * 7, _TYPES)], names=list(_NAMES)
        )
