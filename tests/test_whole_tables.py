"""Training reads every labelled document: nothing caps a class unless the plan asks for it."""

from __future__ import annotations

from functools import partial

import pytest
from pyspark.sql import functions as F

from catalog import model_queries as mq
from postsift import fixed_values as fv
from postsift.operators import learners as ln
from postsift.plans import training as tr


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """A class of more rows than the cap, and a small one."""
    n, path = fv.CLASS_CAP * 5 // 4, str(tmp_path_factory.mktemp("many"))
    ids = spark.range(n + 100).withColumnRenamed("id", "doc_id")
    ids.select("doc_id", F.concat(F.lit("some words "), F.col("doc_id") % 7).alias("text")).write.parquet(f"{path}/documents.parquet")
    ids.select("doc_id", (F.col("doc_id") < n).cast("int").alias("quality")).write.parquet(f"{path}/labels.parquet")
    return path, n


def test_a_split_keeps_every_row_past_the_test_share(spark, many):
    path, n = many
    data = tr.split(mq.rows(spark, path), mq.PLAN, lower=True)
    held = -(-n * 15 // 100)
    assert {r["label"]: r["count"] for r in data.train.groupBy("label").count().collect()} == {0.0: 85, 1.0: n - held}
    assert data.train.count() + data.test.count() == n + 100


def test_the_learner_queries_train_on_all_rows(spark, many, monkeypatch):
    path, n = many
    seen = []
    monkeypatch.setattr(tr, "fit_terms", lambda train, cfg: seen.append(train.count()) or 1 / 0)
    for cap in ((), (fv.CLASS_CAP,)):
        with pytest.raises(ZeroDivisionError):
            mq._prepared(spark, path, *cap)
    assert seen == [n + 100 - -(-n * 15 // 100) - 15, fv.CLASS_CAP + 85]  # the SQL of two queries has the cap


def _few_rounds(fit):
    return partial(fit, params={"n_estimators": 2, "max_depth": 2})


def test_flat_trees_score_the_held_out_documents_too(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(ln, "fit_boosted_flat", _few_rounds(ln.fit_boosted_flat))
    ids = [r["post_id"] for r in mq.fit_boosted_flat(spark, sf_dir).collect()]
    assert sorted(ids) == sorted(r["post_id"] for r in mq.rows(spark, sf_dir).select("post_id").collect())


def test_meta_trees_score_the_held_out_documents_too(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(ln, "fit_boosted_meta", _few_rounds(ln.fit_boosted_meta))
    for name in ("fit_logistic", "fit_linear_svm"):
        monkeypatch.setattr(ln, name, partial(getattr(ln, name), max_iter=5))
    ids = [r["post_id"] for r in mq.fit_boosted_meta(spark, sf_dir).collect()]
    assert sorted(ids) == sorted(r["post_id"] for r in mq.rows(spark, sf_dir).select("post_id").collect())
