"""Column functions over per-class score arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def label_array(labels: Sequence[str]) -> Column:
    return F.array(*[F.lit(x) for x in labels])


def _let(value: Column, body) -> Column:
    """Evaluate `value` once and use it in `body`, also inside its lambdas."""
    return F.transform(F.array(value), body)[0]


def softmax(scores: Column) -> Column:
    """Scores to values in (0, 1) that sum to one; shifted by the maximum against overflow."""
    shifted = _let(F.array_max(scores), lambda m: F.transform(scores, lambda x: F.exp(x - m)))
    return _let(
        shifted,
        lambda e: _let(
            F.aggregate(e, F.lit(0.0), lambda a, x: a + x),
            lambda total: F.transform(e, lambda x: x / total),
        ),
    )


def argmax_label(scores: Column, labels: Sequence[str]) -> Column:
    """Name of the highest score; the first one on a tie."""
    best = F.array_position(scores, F.array_max(scores)).cast("int")
    return F.element_at(label_array(labels), best)


def prob_map(scores: Column, labels: Sequence[str]) -> Column:
    return F.map_from_arrays(label_array(labels), scores)


def top_pairs(scores: Column, labels: Sequence[str], n: int) -> Column:
    """The n best (label, p) structs, best first, ties by label."""
    pairs = F.zip_with(
        label_array(labels),
        scores,
        lambda name, p: F.struct((-p).alias("neg"), name.alias("label"), p.alias("p")),
    )
    return F.transform(
        F.slice(F.array_sort(pairs), 1, n),
        lambda s: F.struct(s["label"].alias("label"), s["p"].alias("p")),
    )
