"""Learners: linear models, boosted trees, searches and out-of-fold stacking.

Every model offers `scores(df, out)`, which adds an ARRAY<DOUBLE> of class probabilities; nothing but
fitted parameters comes to the driver. Loops on the driver run over folds and trials only.
"""

from __future__ import annotations

import json
import math
import random
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postsift import fixed_values as fv
from postsift.functions.scores import softmax
from postsift.operators import boosting
from postsift.operators import evaluate as ev
from postsift.operators import linear
from postsift.operators import search as se
from postsift.operators.linear import Linear
from postsift.operators.sampling import union_all
from postsift.sources.staging import pin

# (kind, low, high); "log" draws are uniform in the logarithm.
LOGISTIC_SPACE = {"c": ("log", 1e-3, 10.0), "tol": ("log", 1e-4, 1e-3)}
SVM_SPACE = {"c": ("log", 1e-3, 5.0), "tol": ("log", 1e-4, 1e-3)}
BOOST_SPACE = {
    "num_leaves": ("int", 31, 255),
    "max_depth": ("int", 4, 12),
    "learning_rate": ("log", 0.01, 0.3),
    "n_estimators": ("int", 300, 2000),
    "min_child_samples": ("int", 10, 100),
    "reg_alpha": ("log", 1e-4, 10.0),
    "reg_lambda": ("log", 1e-4, 10.0),
    "subsample": ("float", 0.5, 1.0),
    "bagging_freq": ("int", 1, 7),
    "colsample_bytree": ("float", 0.5, 1.0),
}
BROADCAST_BYTES = 256 * 2**20
BOOST_DEFAULTS = boosting.DEFAULTS


def index_labels(df: DataFrame, label: str, out: str = "label") -> tuple[list[str], DataFrame]:
    """Names in alphabetical order and the rows with their number in `out`."""
    indexer = StringIndexer(inputCol=label, outputCol=out, stringOrderType="alphabetAsc")
    model = indexer.fit(df)
    return list(model.labels), model.transform(df)


def label_name(
    df: DataFrame, names: Sequence[str], index: str = "label", out: str = "label_name"
) -> DataFrame:
    table = F.array(*[F.lit(n) for n in names])
    return df.withColumn(out, table[F.col(index).cast("int")])


# --- linear models ----------------------------------------------------------------------


def fit_logistic(
    df: DataFrame, c: float = 1.0, tol: float = 1e-4, max_iter: int = 2000, n_classes: int | None = None,
    features: str = "features", label: str = "label", weight: str = "weight",
) -> Linear:
    """Multinomial logistic regression."""
    return linear.fit(df, "logistic", c, tol, max_iter, n_classes, features, label, weight)


def fit_linear_svm(
    df: DataFrame, c: float = 1.0, tol: float = 1e-4, max_iter: int = 2000, n_classes: int | None = None,
    features: str = "features", label: str = "label", weight: str = "weight",
) -> Linear:
    """One-vs-rest SVM with squared hinge loss; the balanced weight applies to the positive side of each problem."""
    return linear.fit(df, "svm", c, tol, max_iter, n_classes, features, label, weight)


# --- boosted trees ----------------------------------------------------------------------


def fit_boosted_flat(
    df: DataFrame, params: Mapping[str, Any] | None = None, n_classes: int = 2,
    features: str = "features", label: str = "label", valid: str | None = None, seed: int = fv.SEED,
) -> boosting.Boosted:
    """Boosted trees on the flat vector of term and lexicon features."""
    return boosting.fit(df, params, n_classes, features, label, seed=seed, valid=valid)


def fit_boosted_meta(
    df: DataFrame, params: Mapping[str, Any] | None = None, n_classes: int = 2,
    features: str = "meta", label: str = "label", valid: str | None = None, seed: int = fv.SEED,
) -> boosting.Boosted:
    """Boosted trees on the base models' probabilities beside the lexicon features."""
    return boosting.fit(df, params, n_classes, features, label, seed=seed, valid=valid)


# --- model selection --------------------------------------------------------------------


def draw(space: Mapping[str, tuple[str, float, float]], n: int, seed: int = fv.SEED) -> list[dict]:
    """`n` seeded random parameter sets."""
    rng = random.Random(seed)

    def one(kind: str, low: float, high: float) -> float | int:
        if kind == "log":
            return math.exp(rng.uniform(math.log(low), math.log(high)))
        return rng.randint(int(low), int(high)) if kind == "int" else rng.uniform(low, high)

    return [{name: one(*bounds) for name, bounds in space.items()} for _ in range(n)]


def predictions(df: DataFrame, p: str = "p", out: str = "prediction") -> DataFrame:
    best = F.array_position(p, F.array_max(p)) - 1
    return df.withColumn(out, best.cast("double"))


def macro_f1_of(scored: DataFrame, label: str = "label", p: str = "p") -> float:
    cm = ev.confusion(predictions(scored, p), label, "prediction")
    return float(ev.macro_f1(cm).first()[0])


def log_loss_of(scored: DataFrame, label: str = "label", p: str = "p") -> float:
    return float(ev.log_loss(scored, label, p).first()[0])


METRICS = {"macro_f1": (macro_f1_of, True), "log_loss": (log_loss_of, False)}


@dataclass
class Tuning:
    best: dict[str, Any]
    score: float
    trials: list[dict[str, Any]] = field(default_factory=list)

    @classmethod
    def of(cls, trials: list[dict[str, Any]], larger: bool) -> "Tuning":
        best = se.best_of(trials, larger)
        return cls(best["params"], best["score"], trials)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(se.as_rows(self.trials), "trial long, params string, score double")


def tune(
    df: DataFrame,
    fit: Callable[..., Any],
    space: Mapping[str, tuple[str, float, float]],
    n_trials: int,
    metric: str = "macro_f1",
    folds: int = fv.FOLDS,
    fold: str = "fold",
    seed: int = fv.SEED,
    parallelism: int = 2,
    early_stop: bool = False,
) -> Tuning:
    """Random search by the mean metric over given folds.

    For any learner, and for training tables of any size: fits are distributed. `fit(train, **params)` returns a model with `scores`; with `early_stop` the held-out fold is
    also given to it as the column `valid`. Trials run as concurrent Spark jobs.
    """
    measure, larger = METRICS[metric]

    def run(params: dict[str, Any]) -> dict[str, Any]:
        found = []
        for i in range(folds):
            held = df.filter(F.col(fold) == i)
            if early_stop:
                model = fit(df.withColumn("valid", F.col(fold) == i), valid="valid", **params)
            else:
                model = fit(df.filter(F.col(fold) != i), **params)
            found.append(measure(model.scores(held)))
        return {"params": params, "score": sum(found) / folds, "folds": found}

    with ThreadPoolExecutor(max(1, parallelism)) as pool:
        trials = list(pool.map(run, draw(space, n_trials, seed)))
    return Tuning.of(trials, larger)


def tune_linear(
    df: DataFrame, kind: str, n_trials: int, n_classes: int = 2, folds: int = fv.FOLDS, seed: int = fv.SEED,
    dealt: se.TooLarge | None = None, **more: Any,
) -> Tuning:
    """Search of `logistic` or `svm` parameters by Parzen estimates, each trial a task over the training table."""
    space = {"logistic": LOGISTIC_SPACE, "svm": SVM_SPACE}[kind]
    if dealt:
        width = df.select(more.pop("features", "features")).first()[0].size
        return Tuning.of(linear.search_dealt(dealt.rows, kind, space, n_trials, n_classes, width, folds, seed, **more), True)
    return Tuning.of(se.search_linear(df, kind, space, n_trials, n_classes, folds=folds, seed=seed, **more), True)


def tune_boosted(
    df: DataFrame, n_trials: int, n_classes: int = 2, features: str = "features", space=BOOST_SPACE, folds: int = fv.FOLDS,
    seed: int = fv.SEED, dealt: se.TooLarge | None = None, **more: Any,
) -> Tuning:
    """Search of boosting parameters by Parzen estimates and the mean held-out log loss."""
    if dealt:
        return Tuning.of(se.search_boosted_dealt(dealt.rows, dealt.bins, space, n_trials, n_classes, folds, seed, **more), False)
    return Tuning.of(se.search_boosted(df, space, n_trials, n_classes, features, folds=folds, seed=seed, **more), False)


def search(tune: Callable[..., Tuning], df: DataFrame, *args: Any, **more: Any) -> Tuning:
    """`tune_linear` or `tune_boosted`; where a task cannot hold the training table, the same trials with fits that stay dealt."""
    try:
        return tune(df, *args, **more)
    except se.TooLarge as large:
        return tune(df, *args, dealt=large, **more)


# --- stacking ---------------------------------------------------------------------------


def oof_union(parts: Sequence[DataFrame]) -> DataFrame:
    """Held-out predictions of all folds; each row was held out once."""
    return union_all(parts)


def oof_stack(
    train: DataFrame, learners: Mapping[str, Callable[[DataFrame], Any]],
    folds: int = fv.FOLDS, fold: str = "fold", key: str = "post_id",
) -> tuple[DataFrame, dict[str, list[Any]]]:
    """(key and one probability array per learner for every train row, models per learner).

    A train row is scored by the models that did not see its fold.
    """
    names = list(learners)
    with ThreadPoolExecutor(max(1, folds * len(names))) as pool:  # a fit is one task, or jobs that share the cluster
        jobs = {
            (name, i): pool.submit(learners[name], se.without_fold(train, fold, i)) for i in range(folds) for name in names
        }
        models = {name: [jobs[name, i].result() for i in range(folds)] for name in names}
    parts = []
    for i in range(folds):
        held = train.filter(F.col(fold) == i)
        for name in names:
            held = models[name][i].scores(held, name)
        parts.append(pin(held.select(key, *names), "oof"))
    return oof_union(parts), models


# --- linear scoring of any amount of text -------------------------------------------------


@dataclass
class LinearBank:
    """Several linear models applied to long-form term weights in one join and one aggregation.

    The coefficient table has one row per selected term with the coefficients of all classes of all
    models: its size is set by the selection (32 000 terms) and the classes, not by the rows. It is
    broadcast up to BROADCAST_BYTES and joined by a shuffle beyond. No vector is built and no row
    leaves the JVM; the sums combine on the map side.
    """

    blocks: dict[str, tuple[np.ndarray, np.ndarray]]  # name: (classes x terms, intercepts)

    @classmethod
    def of(cls, models: Mapping[str, Linear]) -> "LinearBank":
        return cls({name: m.linear() for name, m in models.items()})

    def table(self, spark: SparkSession) -> DataFrame:
        stacked = np.concatenate([c for c, _ in self.blocks.values()]).T
        used = np.flatnonzero(np.any(stacked != 0.0, axis=1))
        rows = pa.table(
            {
                "idx": pa.array(used.astype(np.int32)),
                "coefs": pa.array(stacked[used].tolist(), pa.list_(pa.float64())),
            }
        )
        return spark.createDataFrame(rows)

    def scores(self, posts: DataFrame, weights: DataFrame, key: str = "post_id") -> DataFrame:
        """`posts` with one probability array per model; a post without terms gets the intercepts."""
        intercepts = np.concatenate([b for _, b in self.blocks.values()])
        sums = [
            F.sum(F.col("weight") * F.col("coefs")[i]).alias(f"_m{i}") for i in range(len(intercepts))
        ]
        table = self.table(posts.sparkSession)
        if sum(c.nbytes for c, _ in self.blocks.values()) <= BROADCAST_BYTES:
            table = F.broadcast(table)
        margins = weights.join(table, "idx").groupBy(key).agg(*sums)
        p, at = [], 0
        for name, (_, own) in self.blocks.items():
            values = [
                F.coalesce(F.col(f"_m{at + i}"), F.lit(0.0)) + float(b) for i, b in enumerate(own)
            ]
            p.append(softmax(F.array(*values)).alias(name))
            at += len(own)
        return posts.join(margins, key, "left").select(*posts.columns, *p)


def fold_mean_scores(
    posts: DataFrame, weights: DataFrame, models: Mapping[str, Sequence[Any]], key: str = "post_id"
) -> DataFrame:
    """Each learner's probabilities as the mean over its fold models, taken inside the row."""
    bank = LinearBank.of({f"{n}_{i}": m for n, ms in models.items() for i, m in enumerate(ms)})
    scored = bank.scores(posts, weights, key)

    def mean(name: str, k: int):
        arrays = F.arrays_zip(*[F.col(f"{name}_{i}") for i in range(k)])
        return F.transform(
            arrays, lambda s: sum((s[f"{name}_{i}"] for i in range(1, k)), s[f"{name}_0"]) / k
        )

    return scored.select(*posts.columns, *[mean(n, len(ms)).alias(n) for n, ms in models.items()])
