"""Queries for sources, sinks, learners, training plans and scoring."""

from __future__ import annotations

import uuid
from dataclasses import replace
from functools import lru_cache

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from catalog.feature_queries import (
    ALL_TOKENS, CHAR_TF, EMOTION_SQL, LABELLED_DOCS, TOKENS, VAD_SQL, WORD_TF, _aggregate_sql,
)
from catalog.registry import query
from catalog.text_queries import CLINICAL_OUT, SCREENED, clean_sql
from catalog.views import (
    documents,
    emotion_rows,
    lexicons,
    posts,
    table,
    vad_rows,
    with_cte,
)
from postsift import fixed_values as fv
from postsift.functions import text as tx
from postsift.operators import evaluate as ev
from postsift.operators import filters as fl
from postsift.operators import joins as jn
from postsift.operators import learners as ln
from postsift.operators import lexicon as lx
from postsift.operators import sampling as sp
from postsift.operators import vectorize as vz
from postsift.plans import training as tr
from postsift.sources import readers as rd
from postsift.sources import staging as st
from postsift.streaming.score import score_stream

# The package's own values throughout: vocabulary, selection, folds, iterations, trees and trials.
PLAN = tr.Config()


def _folder(spark, name: str) -> str:
    return f"{st.shared_dir(spark)}/postsift-out/{name}-{uuid.uuid4().hex}"


# --- sources and sinks ------------------------------------------------------------------


@query("read_posts", with_cte("posts", """
SELECT post_id, subreddit, author, CASE WHEN post NOT IN ('', 'NA', 'nan', 'null') THEN post END AS post
FROM posts"""))
def read_posts(spark, sf_dir):
    """The posts written as quoted CSV with a header and read back."""
    path = _folder(spark, "posts-csv")
    df = posts(spark, sf_dir).select("post_id", "subreddit", "author", "post")
    df.write.options(header=True, quote='"', escape='"', quoteAll=True,
                     ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return rd.read_posts(spark, path, "csv", rd.POSTS).select("post_id", "subreddit", "author", "post")


@query("read_terms", "SELECT DISTINCT source AS term FROM documents")
def read_terms(spark, sf_dir):
    path = _folder(spark, "terms")
    lines = table(spark, sf_dir, "documents").select("source").distinct()
    padded = lines.select(F.concat(F.lit("  "), "source", F.lit(" \t")).alias("value"))
    padded.union(padded.select(F.lit("   "))).write.text(path)
    return rd.read_terms(spark, path)


@query("read_emotion_lexicon_tsv", with_cte("emotion_lex", "SELECT * FROM emotion_lex"))
def read_emotion_lexicon_tsv(spark, sf_dir):
    path = _folder(spark, "emotion-tsv")
    emotion_rows(spark, sf_dir).select("word", "emotion", "val").write.csv(path, sep="\t")
    return rd.read_emotion_lexicon(spark, path)


@query("read_vad_lexicon_tsv", with_cte("vad_lex", "SELECT * FROM vad_lex"))
def read_vad_lexicon_tsv(spark, sf_dir):
    path = _folder(spark, "vad-tsv")
    vad_rows(spark, sf_dir).select("word", "valence", "arousal", "dominance").write.csv(path, sep="\t")
    return rd.read_vad_lexicon(spark, path)


@query("stage", with_cte("posts", f"SELECT post_id, {clean_sql('post')} AS cleaned FROM posts"))
def stage(spark, sf_dir):
    root = _folder(spark, "stage")
    df = posts(spark, sf_dir).select("post_id", tx.clean_text(F.col("post")).alias("cleaned"))
    key = st.fingerprint({"step": "clean"}, posts(spark, sf_dir).select("post_id", "post"))
    st.stage(df, root, "cleaned", key)

    def again():
        raise AssertionError("a staged result was computed twice")

    return st.stage(again, root, "cleaned", key, spark)


@query(
    "resumable_apply",
    with_cte("posts", "SELECT post_id, reason, post_cleaned FROM clinical_out",
             **SCREENED, clinical_out=CLINICAL_OUT),
)
def resumable_apply(spark, sf_dir):
    """The disclosure filter in two committed slices; the second call finds both done."""
    out = _folder(spark, "resumable")
    source = st.pin(fl.noise_filter(posts(spark, sf_dir)), "noise_free")

    def fn(df):
        return fl.clinical_filter(df).select("post_id", "reason", "post_cleaned")

    st.resumable_apply(source, fn, out, slices=2)
    return st.resumable_apply(source, fn, out, slices=2)


@query(
    "write_report",
    with_cte("", "SELECT y, yhat, count(*) AS n FROM (SELECT quality AS y, CASE WHEN n_chars > 800 "
             "THEN 1 ELSE 0 END AS yhat FROM labels JOIN documents USING (doc_id)) AS t GROUP BY 1, 2"),
)
def write_report(spark, sf_dir):
    from catalog.sampling_queries import predicted

    path = _folder(spark, "report")
    rd.write_report(ev.confusion(predicted(spark, sf_dir)), path)
    return spark.read.schema("y int, yhat int, n long").json(path)


# --- training data ------------------------------------------------------------------------


def rows(spark, sf_dir):
    """(post_id, text, class) of every labelled document; the class is its quality mark."""
    labels = table(spark, sf_dir, "labels").select(
        "doc_id", F.concat(F.lit("quality_"), F.col("quality")).alias("class")
    )
    return documents(spark, sf_dir).join(labels, "doc_id").select(
        F.col("doc_id").alias("post_id"), "text", "class"
    )


@query(
    "screen",
    with_cte("posts", "SELECT post_id, post_cleaned AS text, CASE subreddit " + " ".join(
        f"WHEN '{k}' THEN '{v}'" for k, v in fv.LABELS.items()
    ) + " ELSE subreddit END AS class FROM clinical_out WHERE post_cleaned IS NOT NULL "
        "AND post_masked IS NOT NULL AND subreddit IS NOT NULL", **SCREENED, clinical_out=CLINICAL_OUT),
)
def screen(spark, sf_dir):
    return tr.screen(posts(spark, sf_dir))


@lru_cache(maxsize=4)
def _prepared(spark, sf_dir, cap=None):
    """(split, fitted terms, train rows with term vectors): shared by the learner queries. A `cap` is given only by
    the queries whose SQL has it."""
    data = tr.split(rows(spark, sf_dir), replace(PLAN, cap=cap), lower=True)
    terms = tr.fit_terms(data.train, PLAN)
    train = st.pin(terms.attach(data.train, "text", "features").drop("text"), "train")
    return data, terms, train


@lru_cache(maxsize=4)
def _stacked(spark, sf_dir, linear_trials, boost_trials):
    cfg = replace(PLAN, linear_trials=linear_trials, boost_trials=boost_trials)
    return tr.train_stacked(rows(spark, sf_dir), lexicons(spark, sf_dir), cfg)


def _with_trials(df, linear_trials, boost_trials):
    return df.withColumn("linear_trials", F.lit(linear_trials)).withColumn("boost_trials", F.lit(boost_trials))


def _p(df, *cols):
    return df.select("post_id", *[F.transform(c, lambda x: F.round(x, 6)).alias(c) for c in cols])


# The training rows of the labelled documents: past the test share and within the cap of a class.
TRAIN = dict(
    labelled_docs=LABELLED_DOCS,
    ranked="""
SELECT *, row_number() OVER (PARTITION BY quality ORDER BY md5('42|' || post_id), post_id)
  - ceil(count(*) OVER (PARTITION BY quality) * CAST(0.15 AS DOUBLE)) AS place FROM labelled_docs""",
    docs=f"""
SELECT post_id, post, CAST(dense_rank() OVER (ORDER BY quality) - 1 AS DOUBLE) AS label FROM ranked
WHERE place BETWEEN 1 AND {fv.CLASS_CAP}""",
)


@query(
    "save_features",
    with_cte(
        "",
        f"""
SELECT post_id, label, CAST((SELECT least(count(DISTINCT term), {fv.WORD_SELECTED}) FROM word_tf)
  + (SELECT least(count(DISTINCT term), {fv.CHAR_SELECTED}) FROM char_tf) AS INTEGER) AS width FROM docs""",
        **TRAIN, word_tf=WORD_TF, char_tf=CHAR_TF,
    ),
)
def save_features(spark, sf_dir):
    _, _, train = _prepared(spark, sf_dir, fv.CLASS_CAP)
    path = _folder(spark, "features")
    rd.save_features(train.select("post_id", "label", "features"), path)
    back = spark.read.parquet(path)
    return back.select("post_id", "label", F.size(vector_to_array("features")).alias("width"))


@query(
    "assemble",
    with_cte("posts emotion_lex vad_lex",
             f"SELECT post_id, [{', '.join([*lx.emotion_names(), *lx.vad_names()])}] AS features "
             "FROM emos JOIN vads USING (post_id)",
             tokens=TOKENS, all_tokens=ALL_TOKENS, emos=_aggregate_sql(EMOTION_SQL, "emotion_lex"),
             vads=_aggregate_sql(VAD_SQL, "vad_lex")),
)
def assemble(spark, sf_dir):
    df, lex = posts(spark, sf_dir), lexicons(spark, sf_dir)
    blocks = [lx.emotion_features(df, lex.emotion), lx.vad_features(df, lex.vad)]
    features = F.transform(vector_to_array("features"), lambda x: F.round(x, 6) + F.lit(0.0))
    return jn.assemble(blocks).select("post_id", features.alias("features"))


@query("fit_logistic")
def fit_logistic(spark, sf_dir):
    _, _, train = _prepared(spark, sf_dir)
    return _p(ln.fit_logistic(train).scores(train), "p")


@query(
    "fit_logistic_optimum",
    with_cte("", "SELECT label, count(*) AS n, CAST(0 AS DOUBLE) AS residual, CAST(1 AS DOUBLE) AS least, "
             "CAST(1 AS DOUBLE) AS most FROM docs GROUP BY label", **TRAIN),
)
def fit_logistic_optimum(spark, sf_dir):
    """What holds at the optimum: weighted p - y sums to zero for each class, and p to one for each row."""
    _, _, train = _prepared(spark, sf_dir, fv.CLASS_CAP)
    total = F.aggregate("p", F.lit(0.0), lambda a, x: a + x)
    scored = ln.fit_logistic(train).scores(train).select("label", "weight", "p", total.alias("total"))
    ends = scored.agg(F.round(F.min("total"), 6).alias("least"), F.round(F.max("total"), 6).alias("most"))
    per_class = scored.select("label", "weight", F.posexplode("p").alias("class", "v")).groupBy("class").agg(
        F.count_if(F.col("label") == F.col("class")).alias("n"),
        F.round(F.sum(F.col("weight") * (F.col("v") - (F.col("label") == F.col("class")).cast("double"))) / F.sum("weight"), 3).alias("residual"),
    )
    least, most = ends.first()
    return per_class.select(
        F.col("class").cast("double").alias("label"), "n", (F.col("residual") + F.lit(0.0)).alias("residual"),
        F.lit(least).alias("least"), F.lit(most).alias("most"),
    )


@query("fit_linear_svm")
def fit_linear_svm(spark, sf_dir):
    _, _, train = _prepared(spark, sf_dir)
    return _p(ln.fit_linear_svm(train).scores(train), "p")


@query("fit_boosted_flat")
def fit_boosted_flat(spark, sf_dir):
    """Trees on the whole train side; the scores of all labelled documents, held-out ones too."""
    data, terms, train = _prepared(spark, sf_dir)
    tested = terms.vectors(data.test, "text", "features")
    every = train.select("post_id", "features").unionByName(tested)
    return _p(ln.fit_boosted_flat(train).scores(every), "p")


@query("fit_boosted_meta")
def fit_boosted_meta(spark, sf_dir):
    """Trees on the base models' out-of-fold probabilities and all lexicon features of the whole train side; the scores
    of all labelled documents, the held-out ones by the mean of the fold models."""
    data, terms, train = _prepared(spark, sf_dir)
    lex = lexicons(spark, sf_dir)
    oof, fold_models = ln.oof_stack(train, {"logistic": ln.fit_logistic, "svm": ln.fit_linear_svm})
    psych = lx.psych_features(data.train, lex, "text")
    meta = tr.meta_features(oof, psych).join(train.select("post_id", "label"), "post_id")
    meta = st.pin(meta, "meta")
    tested = ln.fold_mean_scores(data.test.select("post_id"), terms.weights(data.test), fold_models)
    tested = tr.meta_features(tested, lx.psych_features(data.test, lex, "text"))
    return _p(ln.fit_boosted_meta(meta).scores(meta.select("post_id", "meta").unionByName(tested)), "p")


@query("tune")
def tune(spark, sf_dir, n_trials=PLAN.linear_trials):
    _, _, train = _prepared(spark, sf_dir)
    found = ln.search(ln.tune_linear, train, "logistic", n_trials)
    return found.table(spark).withColumn("n_trials", F.lit(n_trials))


@query("oof_stack")
def oof_stack(spark, sf_dir):
    _, _, train = _prepared(spark, sf_dir)
    oof, _ = ln.oof_stack(train, {"logistic": ln.fit_logistic, "svm": ln.fit_linear_svm})
    return _p(oof, "logistic", "svm")


@query("meta_features")
def meta_features(spark, sf_dir):
    data, terms, train = _prepared(spark, sf_dir)
    bank = ln.LinearBank.of(
        {"logistic": ln.fit_logistic(train), "svm": ln.fit_linear_svm(train)}
    )
    base = bank.scores(data.train.select("post_id"), terms.weights(data.train))
    psych = lx.psych_features(data.train, lexicons(spark, sf_dir), "text")
    return tr.meta_features(base, psych).select("post_id", vector_to_array("meta").alias("meta"))


@query("train_flat")
def train_flat(spark, sf_dir, linear_trials=PLAN.linear_trials, boost_trials=fv.FLAT_BOOST_TRIALS):
    cfg = replace(PLAN, linear_trials=linear_trials, boost_trials=boost_trials)
    model = tr.train_flat(rows(spark, sf_dir), lexicons(spark, sf_dir), cfg)
    named = [r.withColumn("model", F.lit(n)) for n, r in model.reports.items()]
    return _with_trials(sp.union_all(named), linear_trials, boost_trials)


@query("train_stacked")
def train_stacked(spark, sf_dir, linear_trials=PLAN.linear_trials, boost_trials=PLAN.boost_trials):
    return _with_trials(_stacked(spark, sf_dir, linear_trials, boost_trials).report, linear_trials, boost_trials)


@query("score")
def score(spark, sf_dir, linear_trials=0, boost_trials=0):
    """All documents scored; scoring needs a trained model, and no search unless asked for."""
    texts = documents(spark, sf_dir).select(F.col("doc_id").alias("post_id"), "text")
    out = _stacked(spark, sf_dir, linear_trials, boost_trials).score(texts)
    return _with_trials(out.select("post_id", "label", F.round("confidence", 6).alias("confidence"),
                                   "display", "risk_level"), linear_trials, boost_trials)


@query("save_load_model")
def save_load_model(spark, sf_dir, linear_trials=0, boost_trials=0):
    """Scores of the model before saving and after loading, side by side."""
    model, path = _stacked(spark, sf_dir, linear_trials, boost_trials), _folder(spark, "model")
    tr.save_model(model, path)
    texts = table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("post_id"), "text"
    )
    before = model.score(texts).select("post_id", "label", F.round("confidence", 6).alias("before"))
    after = tr.load_model(spark, path).score(texts)
    both = before.join(after.select("post_id", F.round("confidence", 6).alias("after")), "post_id")
    return _with_trials(both, linear_trials, boost_trials)


@query("score_stream")
def score_stream_query(spark, sf_dir, linear_trials=0, boost_trials=0):
    """Conversation turns as a file stream."""
    source = _folder(spark, "stream-in")
    table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("post_id"), "text"
    ).write.parquet(source)
    out = _folder(spark, "stream-out")
    stream = spark.readStream.schema("post_id long, text string").parquet(source)
    model = _stacked(spark, sf_dir, linear_trials, boost_trials)
    score_stream(model, stream, out, _folder(spark, "stream-state")).awaitTermination()
    found = spark.read.parquet(out).select("post_id", "label", F.round("confidence", 6).alias("confidence"))
    return _with_trials(found, linear_trials, boost_trials)
