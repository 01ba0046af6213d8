"""The two training plans: flat (three models on one vector) and stacked (two layers)."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field
from functools import partial
from typing import Any

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postsift import fixed_values as fv
from postsift.functions import text as tx
from postsift.operators import evaluate as ev
from postsift.operators import filters as fl
from postsift.operators import learners as ln
from postsift.operators import sampling as sp
from postsift.operators.boosting import Boosted
from postsift.operators.lexicon import Lexicons, psych_features, psych_names
from postsift.operators.vectorize import StandardScaling, TermModel, by_post, text_partitions
from postsift.plans.scoring import present
from postsift.sources.staging import _written, fingerprint, pin


@dataclass
class Config:
    seed: int = fv.SEED
    test_share: float = fv.TEST_SHARE
    folds: int = fv.FOLDS
    cap: int | None = None  # rows of a class that are trained on; all of them without it
    word_vocabulary: int = fv.WORD_VOCABULARY
    char_vocabulary: int = fv.CHAR_VOCABULARY
    word_selected: int = fv.WORD_SELECTED
    char_selected: int = fv.CHAR_SELECTED
    linear_trials: int = fv.LINEAR_TRIALS
    boost_trials: int = fv.META_BOOST_TRIALS
    linear_params: dict[str, Any] = field(default_factory=dict)  # fixed: max_iter, ...
    boost_params: dict[str, Any] = field(default_factory=dict)  # used when boost_trials is 0
    boost_space: dict[str, Any] = field(default_factory=lambda: dict(ln.BOOST_SPACE))


@dataclass
class Split:
    """Labelled texts ready for training: post_id, text, label, and on train also weight, fold."""

    labels: list[str]
    train: DataFrame
    test: DataFrame


def screen(
    posts: DataFrame, mapping: Mapping[str, str] = fv.LABELS, other_to: str | None = None,
    contractions=fv.CONTRACTIONS,
) -> DataFrame:
    """Relabel, both filters, incomplete rows dropped: post_id, text, class."""
    named = posts.withColumn("subreddit", tx.remap_label(F.col("subreddit"), mapping, other_to))
    kept = fl.clinical_filter(fl.noise_filter(named), contractions=contractions)
    kept = fl.drop_incomplete(kept, ["post_cleaned", "post_masked", "subreddit"])
    return kept.select("post_id", F.col("post_cleaned").alias("text"), F.col("subreddit").alias("class"))


def split(rows: DataFrame, cfg: Config, lower: bool) -> Split:
    """Index, split, fold and weigh (post_id, text, class).

    The train side holds every row past the test share, or with a `cap` at most so many of a class; the
    test side is only ever scored.
    """
    rows = pin(rows.select("post_id", "text", "class"), "screened")
    sp.assert_unique_key(rows, "post_id")
    labels, indexed = ln.index_labels(rows, "class")
    indexed = indexed.drop("class")
    if lower:
        indexed = indexed.withColumn("text", tx.lower_text(F.col("text")))
    # The split is a comparison on each row of the written table; it is not written again.
    parted = sp.stratified_split(indexed, "label", cfg.test_share, cfg.seed)
    train = parted.filter("not is_test").drop("is_test")
    if cfg.cap is not None:
        train = sp.cap_per_class(train, "label", cfg.cap, cfg.seed)
    folded = sp.stratified_folds(pin(train, "past_test"), "label", cfg.folds, cfg.seed)
    return Split(
        labels,
        pin(sp.balanced_weights(folded, "label"), "train"),
        parted.filter("is_test").drop("is_test"),
    )


def fit_terms(train: DataFrame, cfg: Config) -> TermModel:
    return TermModel.fit(
        train, "label", "text", cfg.word_vocabulary, cfg.char_vocabulary, cfg.word_selected,
        cfg.char_selected,
    )


def _evaluate(scored: DataFrame, label: str = "label") -> DataFrame:
    cm = ev.confusion(ln.predictions(scored), label, "prediction")
    return ev.classification_report(cm)


def _linear_params(df: DataFrame, kind: str, k: int, cfg: Config) -> dict[str, Any]:
    """Best parameters of the search, or the fixed ones alone when there are no trials."""
    if cfg.linear_trials == 0:
        return dict(cfg.linear_params)
    found = ln.search(ln.tune_linear, df, kind, cfg.linear_trials, k, cfg.folds, cfg.seed, **_only(cfg.linear_params, "max_iter"))
    return {**found.best, **cfg.linear_params}


def _boost_params(df: DataFrame, features: str, k: int, cfg: Config) -> dict[str, Any]:
    if cfg.boost_trials == 0:
        return dict(cfg.boost_params)
    return dict(ln.search(ln.tune_boosted, df, cfg.boost_trials, k, features, cfg.boost_space, cfg.folds, cfg.seed).best)


def _only(params: Mapping[str, Any], *names: str) -> dict[str, Any]:
    return {k: v for k, v in params.items() if k in names}


# --- flat -------------------------------------------------------------------------------


@dataclass
class FlatModel:
    labels: list[str]
    terms: TermModel
    scaling: StandardScaling
    lexicons: Lexicons
    models: dict[str, Any]
    reports: dict[str, DataFrame]
    params: dict[str, dict[str, Any]]

    def features(self, df: DataFrame) -> DataFrame:
        return flat_features(df, self.terms, self.scaling, self.lexicons)

    def score(self, df: DataFrame, clean: bool = True, top: int = 8, model: str = "logistic") -> DataFrame:
        """label, confidence, probabilities, top labels, display name and risk level per post, by one
        of the three models. Training texts were cleaned, so `clean` is the default."""
        text = tx.clean_text(F.col("text")) if clean else tx.blank_if_null(F.col("text"))
        scored = self.models[model].scores(self.features(df.select("post_id", text.alias("text"))))
        return present(scored.select("post_id", "p"), self.labels, top=top)

    def save(self, path: str) -> None:
        """Preprocessing and classifiers bundled, so that the folder alone can score."""
        spark = SparkSession.active()
        self.terms.save(f"{path}/terms")
        save_lexicons(self.lexicons, f"{path}/lexicons")
        for name, model in self.models.items():
            model.save(f"{path}/models/{name}")
        for name, report in self.reports.items():
            report.coalesce(1).write.mode("overwrite").json(f"{path}/reports/{name}")
        meta = {"labels": self.labels, "scaling": asdict(self.scaling), "params": self.params}
        _save_meta(spark, meta, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "FlatModel":
        meta = _load_meta(spark, path)
        readers = {"logistic": ln.Linear, "svm": ln.Linear, "boosted": Boosted}
        models = {n: readers[n].load(f"{path}/models/{n}") for n in meta["params"]}
        reports = {n: spark.read.json(f"{path}/reports/{n}") for n in meta["params"]}
        return cls(
            meta["labels"], TermModel.load(spark, f"{path}/terms"),
            StandardScaling(**meta["scaling"]), load_lexicons(spark, f"{path}/lexicons"),
            models, reports, meta["params"],
        )


def flat_features(
    df: DataFrame, terms: TermModel, scaling: StandardScaling, lexicons: Lexicons
) -> DataFrame:
    """Scaled lexicon columns beside the scaled term vector, in one vector per post."""
    psych = scaling.apply(psych_features(df, lexicons, "text"))
    joined = df.join(psych, "post_id").join(terms.vectors(df, "text"), "post_id")
    assembler = VectorAssembler(inputCols=[*psych_names(), "tfidf"], outputCol="features")
    return assembler.transform(joined).select(*df.columns, "features")


def train_flat(rows: DataFrame, lexicons: Lexicons, cfg: Config | None = None) -> FlatModel:
    """Logistic regression, linear SVM and boosted trees on term and lexicon features.

    `rows` is (post_id, text, class), for example from `screen`; the texts keep their case.
    """
    cfg = cfg or Config(boost_trials=fv.FLAT_BOOST_TRIALS)
    data = split(rows, cfg, lower=False)
    k = len(data.labels)
    terms = fit_terms(data.train, cfg)
    raw = pin(psych_features(data.train, lexicons, "text"), "psych")
    scaling = StandardScaling.fit(raw, psych_names())
    train = pin(flat_features(data.train, terms, scaling, lexicons), "flat_train")
    test = pin(flat_features(data.test, terms, scaling, lexicons), "flat_test")
    fits = {"logistic": partial(ln.fit_logistic, n_classes=k), "svm": partial(ln.fit_linear_svm, n_classes=k)}
    models, params = {}, {}
    for name, fit in fits.items():
        params[name] = _linear_params(train, name, k, cfg)
        models[name] = fit(train, **params[name])
    params["boosted"] = _boost_params(train, "features", k, cfg)
    models["boosted"] = ln.fit_boosted_flat(train, params["boosted"], k)
    reports = {n: _evaluate(m.scores(test)) for n, m in models.items()}
    return FlatModel(data.labels, terms, scaling, lexicons, models, reports, params)


# --- stacked ----------------------------------------------------------------------------


def meta_features(base: DataFrame, psych: DataFrame, key: str = "post_id") -> DataFrame:
    """(post_id, meta): logistic and SVM probabilities, then the lexicon features."""
    vectors = base.select(
        key, array_to_vector("logistic").alias("_lr"), array_to_vector("svm").alias("_svm")
    )
    names = [c for c in psych.columns if c != key]
    assembler = VectorAssembler(inputCols=["_lr", "_svm", *names], outputCol="meta")
    return assembler.transform(vectors.join(psych, key)).select(key, "meta")


@dataclass
class StackedModel:
    labels: list[str]
    terms: TermModel
    logistic: ln.Linear
    svm: ln.Linear
    boosted: Boosted
    lexicons: Lexicons
    params: dict[str, dict[str, Any]]
    report: DataFrame | None = None

    def probabilities(self, df: DataFrame, clean: bool = True) -> DataFrame:
        """(post_id, text) to (post_id, p). Training texts were cleaned, so `clean` is the default.

        The cleaned texts are shuffled by key once; terms, lexicon features and the joins of their
        results all start from that shuffle.
        """
        text = tx.clean_text(F.col("text")) if clean else tx.blank_if_null(F.col("text"))
        ready = by_post(
            df.select("post_id", tx.lower_text(text).alias("text")), "text", partitions=text_partitions(df, "text")
        )
        bank = ln.LinearBank.of({"logistic": self.logistic, "svm": self.svm})
        base = bank.scores(df.select("post_id"), self.terms.weights(ready, "text", True))
        meta = meta_features(base, psych_features(ready, self.lexicons, "text"))
        return self.boosted.scores(meta).select("post_id", "p")

    def score(self, df: DataFrame, clean: bool = True, top: int = 8) -> DataFrame:
        """label, confidence, probabilities, top labels, display name and risk level per post."""
        return present(self.probabilities(df, clean), self.labels, top=top)

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        self.terms.save(f"{path}/terms")
        self.logistic.save(f"{path}/logistic")
        self.svm.save(f"{path}/svm")
        self.boosted.save(f"{path}/boosted")
        save_lexicons(self.lexicons, f"{path}/lexicons")
        if self.report is not None:
            self.report.coalesce(1).write.mode("overwrite").json(f"{path}/report")
        _save_meta(spark, {"labels": self.labels, "params": self.params}, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "StackedModel":
        meta = _load_meta(spark, path)
        return cls(
            meta["labels"], TermModel.load(spark, f"{path}/terms"),
            ln.Linear.load(f"{path}/logistic"), ln.Linear.load(f"{path}/svm"),
            Boosted.load(f"{path}/boosted"), load_lexicons(spark, f"{path}/lexicons"),
            meta["params"],
        )


def train_stacked(rows: DataFrame, lexicons: Lexicons, cfg: Config | None = None) -> StackedModel:
    """Out-of-fold base models on terms, boosted trees over them and the lexicon features.

    The report uses fold-mean base predictions of the test rows; the saved base models are fitted
    once more on all training rows.
    """
    cfg = cfg or Config()
    data = split(rows, cfg, lower=True)
    k = len(data.labels)
    terms = fit_terms(data.train, cfg)

    train = pin(terms.attach(data.train, "text", "features").drop("text"), "term_train")
    params = {name: _linear_params(train, name, k, cfg) for name in ("logistic", "svm")}
    learners = {
        "logistic": partial(ln.fit_logistic, n_classes=k, **params["logistic"]),
        "svm": partial(ln.fit_linear_svm, n_classes=k, **params["svm"]),
    }
    oof, fold_models = ln.oof_stack(train, learners, cfg.folds)
    # The terms of the test side are scored in long form by all fold models at once.
    tested = ln.fold_mean_scores(
        data.test.select("post_id"), terms.weights(data.test, "text"), fold_models
    )
    meta_train = pin(
        meta_features(oof, psych_features(data.train, lexicons, "text")).join(
            train.select("post_id", "label", "fold"), "post_id"
        ),
        "meta_train",
    )
    meta_test = meta_features(tested, psych_features(data.test, lexicons, "text")).join(
        data.test.select("post_id", "label"), "post_id"
    )

    params["boosted"] = _boost_params(meta_train, "meta", k, cfg)
    top = ln.fit_boosted_meta(meta_train, params["boosted"], k)
    return StackedModel(
        data.labels, terms, learners["logistic"](train), learners["svm"](train), top, lexicons,
        params, _evaluate(top.scores(meta_test)),
    )


# --- storing ----------------------------------------------------------------------------

LEXICON_PARTS = ("emotion", "vad", "category", "tag", "sentiment")


def save_lexicons(lexicons: Lexicons, path: str) -> None:
    for part in LEXICON_PARTS:
        getattr(lexicons, part).write.mode("overwrite").parquet(f"{path}/{part}")


def load_lexicons(spark: SparkSession, path: str) -> Lexicons:
    return Lexicons(**{p: spark.read.parquet(f"{path}/{p}") for p in LEXICON_PARTS})


def _save_meta(spark: SparkSession, meta: dict[str, Any], path: str) -> None:
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode(
        "overwrite"
    ).text(f"{path}/meta")


def _load_meta(spark: SparkSession, path: str) -> dict[str, Any]:
    return json.loads(spark.read.text(f"{path}/meta").first()[0])


def save_model(model: FlatModel | StackedModel, path: str) -> None:
    model.save(path)


def load_model(spark: SparkSession, path: str) -> FlatModel | StackedModel:
    """Load what `save_model` wrote; the stored parameters tell the kind."""
    stacked = "scaling" not in _load_meta(spark, path)
    return (StackedModel if stacked else FlatModel).load(spark, path)


def train_or_load(rows: DataFrame, lexicons: Lexicons, cfg: Config, root: str, plan=train_stacked) -> FlatModel | StackedModel:
    """The model stored below `root` under this plan, configuration and content of rows and lexicons, or a new one.

    The folder's meta file is written last and tells a whole model from one whose training was broken off."""
    spark = rows.sparkSession
    inputs = [rows, *[getattr(lexicons, p) for p in LEXICON_PARTS]]
    path = f"{root.rstrip('/')}/{plan.__name__}/fingerprint={fingerprint(asdict(cfg), *inputs)}"
    if not _written(spark, f"{path}/meta"):
        save_model(plan(rows, lexicons, cfg), path)
    return load_model(spark, path)
