"""Ordinal quality classifier: cumulative-link regression on hashed text.

Grades are ordered; one weight per hashed feature is shared by all of them and ordered thresholds
separate them: P(grade <= k) = logistic(threshold_k - score). A text's score is the sum of the
weights of its distinct features: lower-cased words, with and without punctuation, the last two characters of
words that end in a symbol, and bands of five measures (share of distinct words, of capitals, of
symbols, mean word length, number of words). The expected grade and the probability of the best grade follow from score and thresholds.

Null and empty texts have only the measure features, so they get a grade as any other text.
Repeated rows are graded alike. Without labelled rows the model is flat: all grades are as likely.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsift.llm import words
from postsift.llm.common import row_slices, text_buffer

FEATURES = 1 << 18
#: About so many labelled rows, drawn by a hash of the key, are the training sample.
LABELLED_ROWS = 16_000
#: Hashed words of fewer sampled texts than this, or whose counts in all grades are within so many
#: standard deviations of chance, keep weight 0.
LEAST_TEXTS = 3
LEAST_Z = 4.0
#: Least probability of the best grade with which a text is kept.
KEEP = 0.5

_CAPITAL = np.zeros(256, bool)
_CAPITAL[ord("A") : ord("Z") + 1] = True
_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = _LETTER[ord("A") : ord("Z") + 1] = _LETTER[0x80:] = True
_SYMBOL = ~_LETTER
_SYMBOL[[0x20, *range(0x09, 0x0E), *b".,;:'\"?-()", *range(ord("0"), ord("9") + 1)]] = False


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers and their rows, sorted by row."""
    n = len(offsets) - 1
    plain_starts, plain_ends, plain_rows = words.spans(data, offsets, words.PLAIN_SPACE)
    plain = words.hashes(data, plain_starts, plain_ends)
    starts, ends, rows = words.spans(data, offsets)
    word = words.hashes(data, starts, ends)
    odd = np.flatnonzero(_SYMBOL[data[ends - 1]]) if len(ends) else np.empty(0, np.int64)
    ending = words.hashes(data, np.maximum(starts[odd], ends[odd] - 2), ends[odd], "ending")
    shift = np.uint64(46)
    every = np.concatenate([word >> shift, plain >> shift, ending >> shift]).astype(np.int64)
    owner = np.concatenate([rows, plain_rows, rows[odd]])
    keys = np.unique(owner * FEATURES + every)

    count = np.bincount(rows, minlength=n)
    different = np.bincount(np.unique(rows * (1 << 40) + (word >> np.uint64(24)).astype(np.int64)) >> 40, minlength=n)
    size = np.maximum(np.diff(offsets), 1)
    sums = lambda flag: np.diff(np.concatenate(([0], np.cumsum(flag[data])))[offsets])
    letters = np.maximum(sums(_LETTER), 1)
    measures = [
        different / np.maximum(count, 1) * 10,
        sums(_CAPITAL) / letters * 10,
        sums(_SYMBOL) / size * 30,
        size / np.maximum(count, 1),
        np.log2(np.maximum(count, 1)),
    ]
    bands = [np.minimum(m, 19).astype(np.int64) + 20 * i for i, m in enumerate(measures)]
    extra = (np.arange(n)[:, None] * FEATURES + np.stack(bands, axis=1)).ravel()
    keys = np.unique(np.concatenate([keys, extra]))
    return keys % FEATURES, keys // FEATURES


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        feature, rows = features(data, offsets)
        return np.bincount(rows, self.weights[feature], minlength=len(offsets) - 1)

    def cumulative(self, score: np.ndarray) -> np.ndarray:
        """P(grade <= k) for all grades but the last, a column each."""
        return 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - score[:, None], -40, 40)))


def fit(docs: DataFrame, graded: DataFrame, key: str = "doc_id", text: str = "text", grade: str = "grade",
        grades: int = 3, labelled_rows: int = LABELLED_ROWS, seed: int = 11) -> OrdinalModel:
    """Train on about `labelled_rows` whole texts whose grade (0 to grades - 1) is known.

    Rows of `graded` with a null or other grade are left out; of several grades of a key the least counts."""
    known = graded.select(graded[key].cast("long").alias("k"), graded[grade].cast("int").alias("y"))
    known = known.filter(F.col("y").between(0, grades - 1)).groupBy("k").agg(F.min("y").alias("y"))
    total = known.count()
    draw = F.pmod(F.xxhash64("k", F.lit(seed)), F.lit(1_000_000)) / F.lit(1e6)
    sample = known.filter(draw < min(1.0, labelled_rows / max(total, 1)))
    texts = docs.select(docs[key].cast("long").alias("k"), docs[text].alias("t"))
    joined = texts.join(F.broadcast(sample), "k").select("k", "y", "t")  # about labelled_rows small rows

    def pack(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column(2))
            bags = []
            for a, b in row_slices(offsets):
                feature, rows = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                cuts = np.searchsorted(rows, np.arange(b - a + 1))
                bags += [feature[cuts[i] : cuts[i + 1]].astype(np.int32).tobytes() for i in range(b - a)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(bags, pa.binary())], names=["k", "y", "bag"]
            )

    found = joined.mapInArrow(pack, "k long, y int, bag binary").toArrow()
    y = np.array(found.column("y").to_pylist(), np.int64)
    bags = [np.frombuffer(b, np.int32) for b in found.column("bag").to_pylist()]
    order = np.argsort(np.array(found.column("k").to_pylist(), np.int64), kind="stable")
    return train(y[order], [bags[i] for i in order], grades, seed)


def train(y: np.ndarray, bags: list[np.ndarray], grades: int, seed: int, epochs: int = 12, rate: float = 0.15,
          decay: float = 1e-3) -> OrdinalModel:
    """AdaGrad on the log loss; the thresholds stay ordered as sums of positive steps."""
    weights = np.zeros(FEATURES)
    if not len(y):
        return OrdinalModel(weights, np.log(np.arange(1, grades) / (grades - np.arange(1, grades))))
    # Only features that a grade has more or less often than chance explains: the others are noise.
    flat, grade_of = np.concatenate(bags), np.repeat(y, [len(b) for b in bags])
    seen, usable = np.bincount(flat, minlength=FEATURES), np.zeros(FEATURES, bool)
    for k in range(grades):
        prior = (y == k).mean()
        spread = np.sqrt(np.maximum(seen * prior * (1 - prior), 1e-9))
        usable |= np.abs(np.bincount(flat[grade_of == k], minlength=FEATURES) - seen * prior) >= LEAST_Z * spread
    usable &= seen >= LEAST_TEXTS
    usable[:100] = True
    bags = [b[usable[b]] for b in bags]
    below = np.clip(np.array([(y <= k).mean() for k in range(grades - 1)]), 0.01, 0.99)
    theta = np.log(below / (1 - below))
    lead, gaps = theta[0], np.log(np.maximum(np.diff(theta), 0.1))
    speed, lead_speed, gap_speed = np.full(FEATURES, 1e-6), 1e-6, np.full(len(gaps), 1e-6)
    rng, ids = np.random.default_rng(seed), np.arange(len(y))
    logistic = lambda v: 1 / (1 + np.exp(-np.clip(v, -40, 40)))
    for _ in range(epochs):
        rng.shuffle(ids)
        for start in range(0, len(ids), 64):
            chosen = ids[start : start + 64]
            flat = np.concatenate([bags[i] for i in chosen])
            owner = np.repeat(np.arange(len(chosen)), [len(bags[i]) for i in chosen])
            score = np.bincount(owner, weights[flat], minlength=len(chosen))
            theta = np.concatenate(([lead], lead + np.cumsum(np.exp(gaps))))
            ext = np.concatenate(([-np.inf], theta, [np.inf]))
            up, low = ext[y[chosen] + 1] - score, ext[y[chosen]] - score
            fu, fl = np.where(np.isinf(up), 1.0, logistic(up)), np.where(np.isinf(low), 0.0, logistic(low))
            p = np.maximum(fu - fl, 1e-9)
            du, dl = fu * (1 - fu) / p, fl * (1 - fl) / p  # of log p by the upper and lower threshold
            g_score = du - dl  # of the loss by the score
            grad = np.bincount(flat, g_score[owner], minlength=FEATURES) / len(chosen)
            hit = np.flatnonzero(grad)
            grad = grad[hit] + decay * weights[hit]
            speed[hit] += grad**2
            weights[hit] -= rate * grad / np.sqrt(speed[hit])
            g_theta = np.zeros(grades - 1)
            np.add.at(g_theta, y[chosen][y[chosen] < grades - 1], -du[y[chosen] < grades - 1])
            np.add.at(g_theta, y[chosen][y[chosen] > 0] - 1, dl[y[chosen] > 0])
            g_theta /= len(chosen)
            g_lead, g_gaps = g_theta.sum(), np.cumsum(g_theta[::-1])[::-1][1:] * np.exp(gaps)
            lead_speed += g_lead**2
            gap_speed += g_gaps**2
            lead -= rate * g_lead / np.sqrt(lead_speed)
            gaps = gaps - rate * g_gaps / np.sqrt(gap_speed)
    return OrdinalModel(weights, np.concatenate(([lead], lead + np.cumsum(np.exp(gaps)))))


def grade(docs: DataFrame, model: OrdinalModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score, expected_grade, tail (probability of the best grade), keep (tail at least KEEP)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES numbers

    def apply(batches):
        for batch in batches:
            score, below = _graded(shared.value, batch.column(1))
            tail = 1 - below[:, -1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score), pa.array((1 - below).sum(axis=1)), pa.array(tail), pa.array(tail >= KEEP)],
                names=["doc_id", "score", "expected_grade", "tail", "keep"],
            )

    return docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("t")).mapInArrow(
        apply, "doc_id long, score double, expected_grade double, tail double, keep boolean"
    )


def select_best(docs: DataFrame, model: OrdinalModel, text: str = "text") -> DataFrame:
    """The rows of `docs`, with all columns, whose best grade has a probability of at least KEEP."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text)

    def apply(batches):
        for batch in batches:
            _, below = _graded(shared.value, batch.column(place))
            yield batch.filter(pa.array(1 - below[:, -1] >= KEEP))

    return docs.mapInArrow(apply, docs.schema)


def _graded(model: OrdinalModel, texts) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = text_buffer(texts)
    score = np.concatenate([np.zeros(0)] + [
        model.score(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in row_slices(offsets)
    ])
    return score, model.cumulative(score)


def grades_of(labels: DataFrame) -> DataFrame:
    """Grades of `labels`: 0 toxic, 1 neither toxic nor good, 2 good; unknown where a rating is null."""
    return labels.select(
        "doc_id",
        F.when(F.col("toxic") == 1, 0).when(F.col("toxic").isNull(), None)
        .when(F.col("quality") == 1, 2).when(F.col("quality") == 0, 1).cast("int").alias("grade"),
    )
