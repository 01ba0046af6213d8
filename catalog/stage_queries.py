"""Queries for the Spark ML stages: each stage is saved, loaded, and applied within a Pipeline."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from catalog.feature_queries import (
    CHAR_TF, K, LABELLED_DOCS, VOCABULARY, WORD_TF, labelled_docs,
)
from catalog.model_queries import _folder
from catalog.registry import ORACLES, query
from catalog.sampling_queries import RANKING, score_rows
from catalog.text_queries import CLINICAL_OUT, SCREENED, clean_sql
from catalog.views import lexicons, posts, with_cte
from postsift import fixed_values as fv
from postsift.operators import filters as fl
from postsift.operators import lexicon as lx
from postsift.operators import vectorize as vz
from postsift.plans import stages as sg
from postsift.plans import training as tr


def _applied(spark, stage, df):
    """`df` through the fitted stage as a later session would load it."""
    path = _folder(spark, type(stage).__name__)
    Pipeline(stages=[stage]).fit(df).write().overwrite().save(path)
    return PipelineModel.load(path).transform(df)


@query("TextCleaner", with_cte("posts", f"SELECT post_id, lower({clean_sql('post')}) AS text FROM posts"))
def text_cleaner(spark, sf_dir):
    return _applied(spark, sg.TextCleaner(), posts(spark, sf_dir)).select("post_id", "text")


@query(
    "DisclosureFilter",
    with_cte("posts", "SELECT post_id, reason, post_cleaned, post_masked FROM clinical_out WHERE post_cleaned IS NOT NULL",
             **SCREENED, clinical_out=CLINICAL_OUT),
)
def disclosure_filter(spark, sf_dir):
    found = _applied(spark, sg.DisclosureFilter(drop=True), fl.noise_filter(posts(spark, sf_dir)))
    return found.select("post_id", "reason", "post_cleaned", "post_masked")


@query("SoftmaxScores", with_cte("", "SELECT vec_id, i, round(p, 6) AS p FROM long", **RANKING))
def softmax_scores(spark, sf_dir):
    found = _applied(spark, sg.SoftmaxScores(inputCol="s"), score_rows(spark, sf_dir))
    return found.select("vec_id", F.posexplode("p").alias("i", "p")).select(
        "vec_id", (F.col("i") + 1).cast("long").alias("i"), F.round("p", 6).alias("p")
    )


@query("PsychFeatures", ORACLES["psych_features"])
def psych_stage(spark, sf_dir):
    path = _folder(spark, "lexicons")
    tr.save_lexicons(lexicons(spark, sf_dir), path)
    found = _applied(spark, sg.PsychFeatures(lexicons=path, inputCol="post"), posts(spark, sf_dir))
    values = vector_to_array("psych")
    return found.select(
        "post_id", *[(F.round(values[i], 6) + F.lit(0.0)).alias(n) for i, n in enumerate(lx.psych_names())]
    )


_SCALED = """
SELECT post_id, term, weight / max(weight) OVER (PARTITION BY term) AS weight FROM (
  SELECT post_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY post_id)) AS weight FROM (
    SELECT post_id, term, (1 + ln(tf)) * (ln((1.0 + (SELECT count(*) FROM docs)) / (1.0 + df)) + 1) AS raw
    FROM {tf} JOIN {vocabulary} USING (term)) AS t) AS u
"""


@query(
    "TfidfChi2Vectorizer",
    with_cte(
        "",
        """
SELECT post_id, CAST(idx AS INTEGER) AS idx, round(weight, 6) AS weight FROM (
  SELECT 'word' AS kind, post_id, term, weight FROM word_weights
  UNION ALL SELECT 'char_wb' AS kind, post_id, term, weight FROM char_weights) AS w
JOIN (SELECT kind, term, row_number() OVER (ORDER BY kind DESC, term) - 1 AS idx FROM (
  SELECT 'word' AS kind, term FROM word_vocabulary
  UNION ALL SELECT 'char_wb' AS kind, term FROM char_vocabulary) AS v) AS n USING (kind, term)""",
        docs=LABELLED_DOCS,
        word_tf=WORD_TF, char_tf=CHAR_TF,
        word_vocabulary=VOCABULARY.replace("FROM tf", "FROM word_tf"),
        char_vocabulary=VOCABULARY.replace("FROM tf", "FROM char_tf").replace(str(K), str(fv.CHAR_VOCABULARY)),
        word_weights=_SCALED.format(tf="word_tf", vocabulary="word_vocabulary"),
        char_weights=_SCALED.format(tf="char_tf", vocabulary="char_vocabulary"),
    ),
)
def tfidf_chi2_vectorizer(spark, sf_dir):
    """Entries of the vectors of all labelled texts; the selection keeps the whole vocabulary, as terms
    of equal chi-square would be cut by their last bits (`select_k_best` holds the cut)."""
    sizes = [fv.WORD_VOCABULARY, fv.CHAR_VOCABULARY, fv.WORD_VOCABULARY, fv.CHAR_VOCABULARY]
    stage = sg.TfidfChi2Vectorizer(inputCol="post", labelCol="quality", sizes=sizes)
    values = vz.vector_rows(_applied(spark, stage, labelled_docs(spark, sf_dir)), "tfidf")
    return values.select("post_id", "idx", F.round("weight", 6).alias("weight"))
