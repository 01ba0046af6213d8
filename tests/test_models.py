"""Training, stacking, storing and scoring: properties on a small language task."""

from __future__ import annotations

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from catalog.views import documents, lexicons, posts
from postsift.operators import evaluate as ev
from postsift.operators import learners as ln
from postsift.operators import lexicon as lx
from postsift.plans import stages as sg
from postsift.plans import training as tr
from postsift.sources import staging as st
from postsift.streaming.score import score_stream

CFG = tr.Config(
    word_vocabulary=1000, char_vocabulary=1000, word_selected=150, char_selected=100,
    linear_trials=0, boost_trials=0, linear_params={"max_iter": 8},
    boost_params={"n_estimators": 3, "max_depth": 2, "min_child_samples": 2},
)


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    return documents(spark, sf_dir).select(
        F.col("doc_id").alias("post_id"), "text",
        F.when(F.col("lang") == "en", "en").otherwise("other").alias("class"),
    )


@pytest.fixture(scope="module")
def lex(spark, sf_dir):
    return lexicons(spark, sf_dir)


@pytest.fixture(scope="module")
def stacked(rows, lex):
    return tr.train_stacked(rows, lex, CFG)


@pytest.fixture(scope="module")
def data(rows):
    return tr.split(rows, CFG, lower=True)


@pytest.fixture(scope="module")
def terms(data):
    return tr.fit_terms(data.train, CFG)


@pytest.fixture(scope="module")
def vectors(data, terms):
    v = terms.vectors(data.train, "text", "features")
    return st.pin(data.train.drop("text").join(v, "post_id"), "vectors")


def test_split_is_disjoint_and_complete(rows, data):
    assert data.train.join(data.test, "post_id").count() == 0
    assert data.train.count() + data.test.count() == rows.count()
    assert data.labels == ["en", "other"]


def test_stacked_beats_the_majority(stacked, data):
    report = {r["label"]: r for r in stacked.report.collect()}
    share = data.test.groupBy("label").count().agg(F.max("count") / F.sum("count")).first()[0]
    assert report["accuracy"]["f1"] > share
    assert report["macro avg"]["support"] == data.test.count()


def test_scores_are_probabilities(stacked, rows):
    out = stacked.score(rows.select("post_id", "text"))
    assert out.count() == rows.count()
    wrong = out.filter(
        (F.abs(F.aggregate("p", F.lit(0.0), lambda a, x: a + x) - 1) > 1e-9)
        | (F.col("confidence") != F.array_max("p"))
        | (F.col("top_labels")[0]["p"] != F.col("confidence"))
        | (F.col("probabilities")[F.col("label")] != F.col("confidence"))
    )
    assert wrong.count() == 0


def test_saved_model_scores_the_same(spark, stacked, rows, tmp_path):
    tr.save_model(stacked, str(tmp_path / "m"))
    loaded = tr.load_model(spark, str(tmp_path / "m"))
    texts = rows.select("post_id", "text")
    a = {r["post_id"]: r["confidence"] for r in stacked.score(texts).collect()}
    b = {r["post_id"]: r["confidence"] for r in loaded.score(texts).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_stream_equals_batch(spark, stacked, rows, tmp_path):
    texts = rows.select("post_id", "text")
    texts.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = (
        spark.readStream.schema("post_id long, text string")
        .option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    )
    score_stream(stacked, stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    from postsift.operators.filters import scorable

    got = {r["post_id"]: r["label"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r["post_id"]: r["label"] for r in stacked.score(scorable(texts, col="text")).collect()}
    assert got == want


def test_long_form_scores_equal_vector_scores(data, terms, vectors):
    models = {
        "logistic": ln.fit_logistic(vectors, max_iter=5),
        "svm": ln.fit_linear_svm(vectors, max_iter=5),
    }
    bank = ln.LinearBank.of(models).scores(data.train.select("post_id"), terms.weights(data.train))
    both = models["svm"].scores(models["logistic"].scores(vectors, "a"), "b").join(bank, "post_id")
    gap = F.greatest(*[
        F.abs(F.col(x)[i] - F.col(y)[i]) for x, y in (("a", "logistic"), ("b", "svm")) for i in (0, 1)
    ])
    row = both.agg(F.max(gap), F.count(F.lit(1))).first()
    assert row[0] < 1e-9 and row[1] == data.train.count()


def test_oof_covers_every_row_once(vectors):
    oof, models = ln.oof_stack(vectors, {"logistic": lambda d: ln.fit_logistic(d, max_iter=3)})
    assert len(models["logistic"]) == 3
    assert oof.count() == oof.select("post_id").distinct().count() == vectors.count()


def test_tune_picks_the_best_trial(vectors):
    found = ln.tune(
        vectors, lambda d, **p: ln.fit_logistic(d, max_iter=5, **p), ln.LOGISTIC_SPACE, 2, folds=2
    )
    assert found.score == max(t["score"] for t in found.trials)
    assert ln.draw(ln.LOGISTIC_SPACE, 5) == ln.draw(ln.LOGISTIC_SPACE, 5)
    for p in ln.draw(ln.BOOST_SPACE, 50):
        assert all(low <= p[k] <= high for k, (_, low, high) in ln.BOOST_SPACE.items())


def test_boosting_with_early_stop(vectors):
    found = ln.tune(
        vectors.select("post_id", "label", "fold", "features"),
        lambda d, valid=None, **p: ln.fit_boosted_flat(
            d, {"n_estimators": 3, "min_child_samples": 1, **p}, valid=valid
        ),
        {"max_depth": ("int", 1, 2)}, 1, "log_loss", folds=2, early_stop=True,
    )
    assert found.score > 0


def test_flat_model_round_trip(spark, rows, lex, tmp_path):
    model = tr.train_flat(rows, lex, CFG)
    assert set(model.reports) == {"logistic", "svm", "boosted"}
    tr.save_model(model, str(tmp_path / "flat"))
    loaded = tr.load_model(spark, str(tmp_path / "flat"))
    texts = rows.select("post_id", "text").filter("post_id < 40")
    a = {r["post_id"]: r["label"] for r in model.score(texts, model="svm").collect()}
    assert a == {r["post_id"]: r["label"] for r in loaded.score(texts, model="svm").collect()}
    text = ev.report_text(model.reports["svm"], model.labels)
    assert "macro avg" in text and "other" in text


def test_pipeline_stages_round_trip(spark, sf_dir, rows, lex, tmp_path):
    tr.save_lexicons(lex, str(tmp_path / "lex"))
    labelled = rows.withColumn("label", (F.col("class") == "en").cast("double"))
    pipeline = Pipeline(stages=[
        sg.TextCleaner(inputCol="text", outputCol="clean"),
        sg.TfidfChi2Vectorizer(inputCol="clean", sizes=[300, 300, 40, 20]),
        sg.PsychFeatures(lexicons=str(tmp_path / "lex"), inputCol="clean"),
    ])
    model = pipeline.fit(labelled)
    model.write().overwrite().save(str(tmp_path / "pipe"))
    again = PipelineModel.load(str(tmp_path / "pipe"))
    a = {r["post_id"]: (r["tfidf"], r["psych"]) for r in model.transform(labelled).collect()}
    b = {r["post_id"]: (r["tfidf"], r["psych"]) for r in again.transform(labelled).collect()}
    assert a == b and len(next(iter(a.values()))[1]) == 99 and len(next(iter(a.values()))[0]) == 60
    kept = sg.DisclosureFilter(drop=True).transform(posts(spark, sf_dir))
    assert kept.filter("reason = 'no_pattern'").count() == 0 and kept.count() > 0
    soft = sg.SoftmaxScores(inputCol="s").transform(spark.createDataFrame([([0.0, 0.0],)], "s array<double>"))
    assert soft.first()["p"] == [0.5, 0.5]


def test_macro_f1_evaluator(spark):
    rows = [(0.0, 0.0), (0.0, 0.0), (0.0, 1.0), (1.0, 1.0)]
    df = spark.createDataFrame(rows, "label double, prediction double")
    assert ev.MacroF1().evaluate(df) == pytest.approx((0.8 + 2 / 3) / 2)


def test_psych_features_of_empty_texts(spark, lex):
    df = spark.createDataFrame([(1, ""), (2, None), (3, "!!! ...")], "post_id long, post string")
    rows = lx.psych_features(df, lex).collect()
    assert len(rows) == 3 and len(lx.psych_names()) == 99
    assert all(r[n] == 0.0 for r in rows for n in lx.psych_names())


def test_sentiment_rules(spark):
    valence = spark.createDataFrame([("good", 2.0), ("bad", -2.5)], "word string, valence double")
    texts = {
        1: "good", 2: "very good", 3: "not good", 4: "good!!", 5: "good but bad", 6: "not very good",
        7: "nothing here", 8: "slightly bad",
    }
    df = spark.createDataFrame(list(texts.items()), "post_id long, post string")
    got = {r["post_id"]: r["sentiment_compound"] for r in lx.sentiment_compound(df, valence).collect()}

    def compound(s):
        return s / (s * s + 15) ** 0.5

    want = {
        1: compound(2), 2: compound(2.293), 3: compound(2 * -0.74), 4: compound(2 + 2 * 0.292),
        5: compound(2 * 0.5 - 2.5 * 1.5), 6: compound(2.293 * -0.74), 7: 0.0, 8: compound(-2.5 + 0.293),
    }
    assert got == pytest.approx(want)


def test_a_search_runs_in_the_stacked_plan_and_its_model_is_reused(spark, sf_dir, rows, lex, tmp_path, monkeypatch):
    from dataclasses import replace

    cfg = replace(CFG, linear_trials=3, boost_trials=3, linear_params={"max_iter": 50}, boost_params={},
                  boost_space={**ln.BOOST_SPACE, "n_estimators": ("int", 5, 15), "min_child_samples": ("int", 2, 5)})
    counted = []
    tune_linear, tune_boosted = ln.tune_linear, ln.tune_boosted
    monkeypatch.setattr(ln, "tune_linear", lambda *a, **k: counted.append(tune_linear(*a, **k)) or counted[-1])
    monkeypatch.setattr(ln, "tune_boosted", lambda *a, **k: counted.append(tune_boosted(*a, **k)) or counted[-1])
    rows = st.pin(rows.filter("post_id < 150"), "rows")
    model = tr.train_or_load(rows, lex, cfg, str(tmp_path))
    assert [len(c.trials) for c in counted] == [3, 3, 3]
    assert model.params["boosted"] == counted[2].best and model.params["logistic"] == {**counted[0].best, "max_iter": 50}
    again = tr.train_or_load(rows, lex, cfg, str(tmp_path))
    assert len(counted) == 3  # loaded, not trained
    texts = rows.select("post_id", "text")
    a, b = ({r["post_id"]: r["confidence"] for r in m.score(texts).collect()} for m in (model, again))
    assert a == b
    monkeypatch.setattr(tr, "save_model", lambda *a: counted.append("trained"))
    with pytest.raises(Exception):
        tr.train_or_load(rows.limit(100), lex, replace(CFG, linear_params={"max_iter": 1}), str(tmp_path))
    assert counted[-1] == "trained"  # other rows or another configuration are trained anew


def test_model_queries_search_with_the_trials_of_the_package():
    from inspect import signature

    from catalog import model_queries as mq

    trials = {name: {k: p.default for k, p in signature(getattr(mq, name)).parameters.items() if k.endswith("trials")}
              for name in ("tune", "train_flat", "train_stacked", "score")}
    assert trials == {
        "tune": {"n_trials": 30}, "train_flat": {"linear_trials": 30, "boost_trials": 50},
        "train_stacked": {"linear_trials": 30, "boost_trials": 75}, "score": {"linear_trials": 0, "boost_trials": 0},
    }
    assert mq.PLAN == tr.Config()
