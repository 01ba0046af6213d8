"""Language identification: averaged hashed subword embeddings and a linear softmax.

Subwords are runs of three and four UTF-8 bytes of the lower-cased text within a word, where ASCII
characters that are no letters count as word ends. A text is the mean of its subwords' embeddings;
embeddings and the softmax are trained together by stochastic gradient descent in numpy. A part of
the training sample is kept for calibration: it sets the temperature of the probabilities and the
least score at which accepted predictions reach `TARGET_PRECISION` (the rejection threshold).

A text that is null or has no letter is `und` with score 0 and is never rejected by score; a text
without subwords (a single letter) gets the prior of the model. Repeated rows are predicted alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsift.llm.common import row_slices, text_buffer

BUCKETS = 1 << 16
DIMENSIONS = 16
#: About so many rows of each language, drawn by a hash of the key, are the training sample.
ROWS_PER_LANGUAGE = 1500
TARGET_PRECISION = 0.99
UNKNOWN = "und"

_LETTER = np.full(256, 0x20, np.uint32)
_LETTER[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_LETTER[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_LETTER[0x80:] = np.arange(0x80, 0x100)


def subwords(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every subword, by row."""
    n_rows = len(offsets) - 1
    # A space before, between and after the rows: no subword crosses them.
    at = np.arange(len(data)) + np.repeat(np.arange(n_rows), np.diff(offsets)) + 1
    c = np.full(len(data) + n_rows + 1, 0x20, np.uint32)
    c[at] = _LETTER[data]
    letter = c != 0x20
    if len(c) < 4:
        c, letter = np.append(c, [0x20] * 4).astype(np.uint32), np.append(letter, [False] * 4)
    # Each has letters inside and a letter or a word end at both sides.
    a, b, d, e = c[:-3], c[1:-2], c[2:-1], c[3:]
    la, lb, ld, le = letter[:-3], letter[1:-2], letter[2:-1], letter[3:]
    three, four = np.flatnonzero(lb & (la | ld)), np.flatnonzero(lb & ld)
    with np.errstate(over="ignore"):
        tri = a | (b << np.uint32(8)) | (d << np.uint32(16))
        quad = tri[four] | (e[four] << np.uint32(24))
        h3 = (tri[three] ^ np.uint32(0x5BD1E995)) * np.uint32(0x9E3779B1)
        h4 = (quad ^ (quad >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    shift = np.uint32(16)
    found = np.concatenate([h3 >> shift, h4 >> shift]).astype(np.int64)
    starts = offsets[:-1] + np.arange(n_rows) + 1
    rows = np.searchsorted(starts, np.concatenate([three, four]) + 1, "right") - 1
    order = np.argsort(rows, kind="stable")
    return found[order], np.maximum(rows[order], 0)


@dataclass
class LanguageModel:
    """`scores` holds the log-odds of each subword bucket; `bias` those of a text without any."""

    languages: list[str]
    scores: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float

    def probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        buckets, rows = subwords(data, offsets)
        n = len(offsets) - 1
        logits = np.zeros((n, len(self.languages)))
        if len(rows):
            first = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
            sums = np.add.reduceat(self.scores[buckets], first, axis=0, dtype=np.float64)
            logits[rows[first]] = sums / np.diff(np.append(first, len(rows)))[:, None]
        return softmax((logits + self.bias) / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _features(batch: pa.RecordBatch, column: int) -> list[bytes]:
    data, offsets = text_buffer(batch.column(column))
    out = []
    for start, end in row_slices(offsets):
        buckets, rows = subwords(data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start])
        cuts = np.searchsorted(rows, np.arange(end - start + 1))
        for i in range(end - start):
            values, counts = np.unique(buckets[cuts[i] : cuts[i + 1]], return_counts=True)
            out.append(np.concatenate([values, counts]).astype(np.int32).tobytes())
    return out


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang",
        rows_per_language: int = ROWS_PER_LANGUAGE, epochs: int = 6, rate: float = 0.5, seed: int = 7) -> LanguageModel:
    """Train on about `rows_per_language` whole texts of each label; rows without text or label are left out."""
    rows = docs.select(docs[key].cast("long").alias("k"), docs[text].alias("t"), docs[label].cast("string").alias("y"))
    rows = rows.filter(F.col("t").isNotNull() & F.col("y").isNotNull())
    counts = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}  # one row per language
    if not counts:
        return LanguageModel([UNKNOWN], np.zeros((BUCKETS, 1)), np.zeros(1), 1.0, 0.0)
    languages = sorted(counts)
    share = F.create_map(*[F.lit(v) for y in languages for v in (y, min(1.0, rows_per_language / counts[y]))])
    draw = F.pmod(F.xxhash64("k", F.lit(seed)), F.lit(1_000_000)) / F.lit(1e6)
    sample = rows.filter(draw < share[F.col("y")]).select("y", "t")

    def pack(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(_features(batch, 1), pa.binary())], names=["y", "bag"]
            )

    found = sample.mapInArrow(pack, "y string, bag binary").toArrow()
    place = {y: i for i, y in enumerate(languages)}
    y = np.array([place[v] for v in found.column("y").to_pylist()], np.int64)
    bags = [np.frombuffer(b, np.int32).reshape(2, -1) for b in found.column("bag").to_pylist()]
    order = np.lexsort(([hash_of(b) for b in bags], y))  # no order of arrival
    y, bags = y[order], [bags[i] for i in order]
    return train(languages, y, bags, epochs, rate, seed)


def hash_of(bag: np.ndarray) -> int:
    import zlib

    return zlib.crc32(bag.tobytes())


def train(languages: list[str], y: np.ndarray, bags: list[np.ndarray], epochs: int, rate: float, seed: int) -> LanguageModel:
    rng = np.random.default_rng(seed)
    part = rng.random(len(y)) < 0.2
    if part.all() or not part.any():
        part = np.zeros(len(y), bool)
    ids = np.flatnonzero(~part)
    embed = rng.normal(0, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS))
    weights = rng.normal(0, 0.1, (DIMENSIONS, len(languages)))
    bias = np.zeros(len(languages))
    lengths = np.array([b.shape[1] for b in bags])
    shares = [b[1] / max(1, b[1].sum()) for b in bags]
    step, steps = 0, max(1, epochs * (len(ids) // 16 + 1))
    for _ in range(epochs):
        rng.shuffle(ids)
        for start in range(0, len(ids), 16):
            chosen = ids[start : start + 16]
            buckets = np.concatenate([bags[i][0] for i in chosen])
            share = np.concatenate([shares[i] for i in chosen])
            owner = np.repeat(np.arange(len(chosen)), lengths[chosen])
            mean = np.zeros((len(chosen), DIMENSIONS))
            np.add.at(mean, owner, embed[buckets] * share[:, None])
            error = softmax(mean @ weights + bias)
            error[np.arange(len(chosen)), y[chosen]] -= 1
            now = rate * (1 - step / steps)
            back = error @ weights.T
            weights -= now * mean.T @ error
            bias -= now * error.mean(axis=0)
            # Frequent subwords take small steps, as their share of a text is small; so scale them up.
            np.add.at(embed, buckets, -now * 20 * back[owner] * share[:, None])
            step += 1
    model = LanguageModel(languages, (embed @ weights).astype(np.float32), bias, 1.0, 0.0)
    calibrate(model, y[part], [bags[i] for i in np.flatnonzero(part)])
    return model


def calibrate(model: LanguageModel, y: np.ndarray, bags: list[np.ndarray]) -> None:
    """Set the temperature of least log loss, then the least score with enough right answers above it."""
    if not len(y):
        return
    logits = np.array([
        (model.scores[b[0]] * (b[1] / max(1, b[1].sum()))[:, None]).sum(axis=0) + model.bias for b in bags
    ])
    losses = {}
    for t in np.geomspace(0.05, 20, 60):
        losses[t] = -np.log(np.maximum(softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean()
    model.temperature = float(min(losses, key=losses.get))
    p = softmax(logits / model.temperature)
    score, right = p.max(axis=1), p.argmax(axis=1) == y
    order = np.argsort(-score)
    precision = np.cumsum(right[order]) / np.arange(1, len(y) + 1)
    good = np.flatnonzero(precision >= TARGET_PRECISION)
    model.threshold = float(score[order][good[-1]]) if len(good) else 1.0


def predict(docs: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text", reject: bool = True) -> DataFrame:
    """doc_id, lang_pred, score, rejected: the likeliest language of each whole text.

    `rejected` says that the score is under the calibrated threshold; with `reject` such rows are
    predicted `und`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages numbers
    rows = docs.select(
        docs[key].cast("long").alias("doc_id"),
        F.coalesce(docs[text].rlike(r"\p{L}"), F.lit(False)).alias("lettered"),
        F.lower(docs[text]).alias("t"),
    )

    def apply(batches):
        m = shared.value
        for batch in batches:
            data, offsets = text_buffer(batch.column(2))
            p = np.concatenate([np.zeros((0, len(m.languages)))] + [
                m.probabilities(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                for a, b in row_slices(offsets)
            ])
            lettered = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            score = np.where(lettered, p.max(axis=1), 0.0)
            rejected = lettered & (score < m.threshold)
            lang = np.array(m.languages, object)[p.argmax(axis=1)]
            lang[~lettered | (rejected & reject)] = UNKNOWN
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)],
                names=["doc_id", "lang_pred", "score", "rejected"],
            )

    return rows.mapInArrow(apply, "doc_id long, lang_pred string, score double, rejected boolean")


def held_out(key: str, modulus: int = 3, remainder: int = 1):
    """Whether the CRC-32 of the key as text leaves this remainder (null key: false)."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % modulus == remainder, F.lit(False))
