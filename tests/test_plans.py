"""Physical plans: shuffles, broadcasts and columns read."""

from __future__ import annotations

from pyspark.sql import functions as F

from postsift.operators import filters as fl
from postsift.operators import lexicon as lx
from postsift.operators import sampling as sp
from postsift.operators import vectorize as vz
from postsift.sources.staging import pin


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.col("doc_id").alias("post_id"), F.col("text").alias("post"), "source"
    )


def test_term_weights_need_one_shuffle(spark, sf_dir):
    df = docs(spark, sf_dir)
    vocabulary = pin(vz.top_vocabulary(vz.term_counts(df), 50).withColumn("idf", vz.idf(200)))
    for analyzer in (vz.WORD, vz.CHAR):
        text = plan(vz.tfidf(vz.term_counts(df, analyzer), vocabulary))
        assert text.count("Exchange hashpartitioning") == 1
        assert "SortMergeJoin" not in text and "BroadcastHashJoin" in text


def test_top_vocabulary_sorts_no_more_than_needed(spark):
    rows = [(i, f"t{j}", 1) for i in range(20) for j in range(i, 20)]
    tf = spark.createDataFrame(rows, "post_id long, term string, tf long")
    got = [(r["term"], r["ctf"]) for r in vz.top_vocabulary(tf, 3).collect()]
    assert got == [("t19", 20), ("t18", 19), ("t17", 18)]
    assert vz.top_vocabulary(tf, 1000).count() == 20
    assert vz.top_vocabulary(tf.filter("false"), 5).count() == 0


def test_cut_of_the_vocabulary_is_the_kth_frequency(spark, monkeypatch):
    import random

    draw = random.Random(7)
    for bands in (3, 8, 1024):
        monkeypatch.setattr(vz, "BANDS", bands)
        for n in (1, 40):
            ctf = [draw.choice((1, 2, 5, draw.randrange(1, 5000))) for _ in range(n)]
            counts = spark.createDataFrame([(f"t{i}", c) for i, c in enumerate(ctf)], "term string, ctf long")
            ranked = sorted(ctf, reverse=True)
            for k in (1, n // 2, n, n + 1):
                want = ranked[k - 1] if 0 < k <= n else 0
                assert vz.kth_frequency(counts, k) == want, (bands, k, ctf)


def test_top_vocabulary_has_no_window(spark):
    tf = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "post_id long, term string, tf long")
    assert "Window" not in plan(vz.top_vocabulary(tf, 1))


def test_report_reads_and_shuffles_little(spark, sf_dir):
    text = plan(fl.noise_report(docs(spark, sf_dir)))
    assert "ReadSchema: struct<text:string>" in text
    assert "Join" not in text


def test_sample_is_decided_without_a_shuffle(spark, sf_dir):
    df = docs(spark, sf_dir)
    for out in (
        sp.stratified_split(df, "source"),
        sp.cap_per_class(df, "source", 3),
        sp.stratified_folds(df, "source"),
        sp.balanced_weights(df, "source"),
    ):
        text = plan(out)
        assert "BroadcastHashJoin" in text and "Exchange hashpartitioning" not in text


def test_lexicon_features_shuffle_partial_sums_only(spark, sf_dir):
    lexicon = pin(
        spark.createDataFrame([("the", 0.5, 0.5, 0.5)], "word string, valence double, arousal double, dominance double")
    )
    text = plan(lx.vad_features(docs(spark, sf_dir), lexicon))
    assert text.count("Exchange hashpartitioning") == 1
    assert text.index("partial_avg") > text.index("Exchange hashpartitioning")


def test_lexicon_join_without_broadcast_gives_the_same(spark, sf_dir):
    lexicon = pin(
        spark.createDataFrame(
            [("the", 0.5, 0.1, 0.2), ("of", 0.25, 0.3, 0.9)],
            "word string, valence double, arousal double, dominance double",
        )
    )
    df = docs(spark, sf_dir)
    a = lx.vad_features(df, lexicon).orderBy("post_id").collect()
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        out = lx.vad_features(df, lexicon).orderBy("post_id")
        assert "SortMergeJoin" in plan(out)
        b = out.collect()
    finally:
        spark.conf.set(key, before)
    assert [[round(x, 9) for x in r] for r in a] == [[round(x, 9) for x in r] for r in b]
