"""Sources, sinks, staging and resuming."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from postsift import fixed_values as fv
from postsift.operators import vectorize as vz
from postsift.sources import readers as rd
from postsift.sources import staging as st


def test_csv_with_line_breaks_quotes_and_missing(spark, tmp_path):
    path = tmp_path / "posts.csv"
    path.write_text(
        'post_id,subreddit,post\n1,adhd,"two\nlines, ""quoted"""\n2,NA,nan\n3,lonely,\n', encoding="utf-8"
    )
    rows = rd.read_posts(spark, str(path), "csv").orderBy("post_id").collect()
    assert [(r["post_id"], r["subreddit"], r["post"], r["author"]) for r in rows] == [
        (1, "adhd", 'two\nlines, "quoted"', None), (2, None, None, None), (3, "lonely", None, None),
    ]


def test_csv_binds_by_name_and_makes_keys(spark, tmp_path):
    path = tmp_path / "posts.csv"
    path.write_text("post,extra,author,subreddit\nhello there,x,bob,adhd\nsame,y,,lonely\nsame,y,,lonely\n")
    read = [rd.read_posts(spark, str(path), "csv", rd.POSTS).collect() for _ in range(2)]
    rows = sorted(read[0], key=lambda r: r["post"])
    assert [(r["subreddit"], r["author"], r["post"]) for r in rows] == [
        ("adhd", "bob", "hello there"), ("lonely", None, "same"), ("lonely", None, "same"),
    ]
    keys = [sorted(r["post_id"] for r in rows) for rows in read]
    assert keys[0] == keys[1] and len(set(keys[0])) == 3


def test_missing_column_is_named(spark, tmp_path):
    path = tmp_path / "posts.csv"
    path.write_text("post_id,subreddit\n1,adhd\n")
    with pytest.raises(ValueError, match="post"):
        rd.read_posts(spark, str(path), "csv")


def test_terms(spark, tmp_path):
    path = tmp_path / "terms.txt"
    path.write_text("  joy \n\n \t\nfear\n")
    assert [r["term"] for r in rd.read_terms(spark, str(path)).orderBy("term").collect()] == ["fear", "joy"]


def test_emotion_lexicon_means_and_zeros(spark, tmp_path):
    path = tmp_path / "emotion.tsv"
    path.write_text("a\tjoy\t1\na\tjoy\t0\na\tfear\t1\nb\ttrust\t1\n")
    rows = {r["word"]: r for r in rd.read_emotion_lexicon(spark, str(path)).collect()}
    assert rows["a"]["joy"] == 0.5 and rows["a"]["fear"] == 1.0 and rows["a"]["trust"] == 0.0
    assert rd.read_emotion_lexicon(spark, str(path)).columns == ["word", *fv.EMOTIONS]


def test_vad_lexicon_last_line_counts(spark, tmp_path):
    path = tmp_path / "vad.tsv"
    path.write_text("a\t0.1\t0.1\t0.1\nb\t0.5\t0.5\t0.5\na\t0.9\t0.8\t0.7\n")
    rows = {r["word"]: r for r in rd.read_vad_lexicon(spark, str(path)).collect()}
    assert (rows["a"]["valence"], rows["a"]["arousal"], rows["a"]["dominance"]) == (0.9, 0.8, 0.7)


def test_stage_reuses_and_recomputes(spark, tmp_path):
    calls = []

    def compute():
        calls.append(1)
        return spark.range(3)

    a = st.stage(compute, str(tmp_path), "s", "k1", spark)
    b = st.stage(compute, str(tmp_path), "s", "k1", spark)
    assert a.count() == b.count() == 3 and len(calls) == 1
    st.stage(compute, str(tmp_path), "s", "k2", spark)
    assert len(calls) == 2


def test_fingerprint_sees_content_not_order(spark):
    df = spark.range(100).withColumn("t", F.col("id").cast("string"))
    key = st.fingerprint({"a": 1}, df)
    assert key == st.fingerprint({"a": 1}, df.repartition(7).orderBy(F.desc("id")))
    assert key != st.fingerprint({"a": 2}, df)
    changed = df.withColumn("t", F.when(F.col("id") == 5, "x").otherwise(F.col("t")))
    assert key != st.fingerprint({"a": 1}, changed)


def test_resume_does_only_the_rest(spark, tmp_path):
    df = spark.range(50).withColumnRenamed("id", "post_id")
    done = []

    def fn(part):
        done.append(1)
        if len(done) == 3:
            raise RuntimeError("lost")
        return part.withColumn("twice", F.col("post_id") * 2)

    with pytest.raises(RuntimeError):
        st.resumable_apply(df, fn, str(tmp_path), slices=4)
    out = st.resumable_apply(df, fn, str(tmp_path), slices=4)
    assert len(done) == 5  # two finished, one failed, two more
    assert sorted((r["post_id"], r["twice"]) for r in out.collect()) == [(i, 2 * i) for i in range(50)]
    grown = spark.range(60).withColumnRenamed("id", "post_id")
    assert st.resumable_apply(grown, fn, str(tmp_path), slices=4).count() == 60


def test_features_round_trip(spark, tmp_path):
    rows = [(1, [(0, 0.5), (3, 1.0)]), (2, [])]
    df = spark.createDataFrame(rows, "post_id long, e array<struct<idx:int,weight:double>>")
    vectors = df.select("post_id", vz._sparse(F.lit(5), "e").alias("v"))
    rd.save_features(vectors, str(tmp_path / "f"))
    back = {r["post_id"]: r["v"].toArray().tolist() for r in spark.read.parquet(str(tmp_path / "f")).collect()}
    assert back == {1: [0.5, 0, 0, 1.0, 0], 2: [0.0] * 5}


def test_standard_scale_constant_column(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (2, 3.0, 5.0)], "post_id long, a double, b double")
    got = vz.standard_scale(df, ["a", "b"]).orderBy("post_id").collect()
    assert [(r["a"], r["b"]) for r in got] == [(-1.0, 0.0), (1.0, 0.0)]
