"""What a task holds and what is written follow the blocks of the input, not its whole size."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from postsift import fixed_values as fv
from postsift.operators import lexicon as lx
from postsift.operators import vectorize as vz
from postsift.sources.staging import pin


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def posts(spark):
    rows = [(1, "The good day, a BAD day"), (2, ""), (3, None), (4, "good but not good!"), (4, "very good"), (None, "bad good"), (5, "the the the")]
    return spark.createDataFrame(rows, "post_id long, post string")


@pytest.fixture()
def lexicons(spark):
    emotion = spark.createDataFrame(
        [("good", *[float(i % 2) for i in range(10)]), ("day", *[1.0] * 10)],
        "word string, " + ", ".join(f"{e} double" for e in fv.EMOTIONS),
    )
    return lx.Lexicons(
        emotion=emotion,
        vad=spark.createDataFrame([("good", 0.9, 0.5, None), ("bad", 0.1, 0.2, 0.3), ("bad", 0.3, 0.2, 0.3)],
                                  "word string, valence double, arousal double, dominance double"),
        category=spark.createDataFrame([("good", fv.CATEGORIES[0]), ("good", fv.CATEGORIES[3]), ("day", fv.CATEGORIES[0])], "word string, category string"),
        tag=spark.createDataFrame([("good", "ADJ"), ("good", "NOUN"), ("the", "PRON")], "word string, tag string"),
        sentiment=spark.createDataFrame([("good", 2.0), ("bad", -2.5)], "word string, valence double"),
    )


def test_word_features_equal_joined_tokens(posts, lexicons, monkeypatch):
    """Tokens joined one by one: repeated keys are one post, a repeated lexicon word counts twice."""
    joined = lx.lexicon_join(lx.explode_tokens(posts), lexicons.vad)
    want = joined.groupBy("post_id").agg(
        *[f(v).alias(f"nrc_vad_{v}_{s}") for s, f in (("mean", F.avg), ("max", F.max), ("std", F.stddev_pop)) for v in fv.VAD]
    )
    key = lambda r: (r[0] is None, r[0] or 0)
    for broadcast in (True, False):
        monkeypatch.setattr(lx, "_is_broadcast", lambda table: broadcast, raising=False)
        got = lx.vad_features(posts, lexicons.vad)
        assert got.columns == want.columns and ("FlatMapCoGroupsInArrow" in plan(got)) != broadcast
        for a, b in zip(sorted(got.collect(), key=key), sorted(want.collect(), key=key), strict=True):
            assert a[0] == b[0] and a[1:] == pytest.approx(b[1:], abs=1e-9)
    tags = {r["post_id"]: r["adj_ratio"] for r in lx.pos_ratio_features(posts, lexicons.tag).collect()}
    assert tags == pytest.approx({1: 1 / 6, 2: 0, 3: 0, 4: 3 / 6, None: 1 / 2, 5: 0})
    name = lx.category_names()[0]
    shares = {r["post_id"]: r[name] for r in lx.category_features(posts, lexicons.category).collect()}
    assert shares == pytest.approx({1: 3 / 6, 2: 0, 3: 0, 4: 3 / 4, None: 1 / 2, 5: 0})
    s = {r["post_id"]: r["sentiment_compound"] for r in lx.sentiment_compound(posts, lexicons.sentiment).collect()}
    close = lambda x: x / np.sqrt(x * x + fv.SENTIMENT_ALPHA)
    assert s[1] == pytest.approx(close(2.0 - 2.5)) and s[2] == s[3] == s[5] == 0.0
    second = 2.0 * fv.NEGATION_FACTOR * fv.BUT_AFTER  # "not good" after "but"
    total = 2.0 * fv.BUT_BEFORE + second + (2.0 + fv.BOOST)
    assert s[4] == pytest.approx(close(total + np.sign(total) * fv.EXCLAMATION))
    whole = {r["post_id"]: r for r in lx.psych_features(posts, lexicons).collect()}
    assert len(whole) == 6 and whole[4]["sentiment_compound"] == pytest.approx(s[4])
    assert whole[None][name] == 0.0  # rows without a key


def test_tokens_are_not_shuffled_for_the_lexicons(posts, lexicons):
    """Tokens were joined with each lexicon, six times in all for `psych_features`."""
    text = plan(lx.psych_features(posts, lexicons))
    assert text.count("Generate explode") == 1 and "posexplode" not in text
    assert "FlatMapCoGroupsInArrow" in text


def test_partitions_follow_the_bytes_of_the_texts(spark, monkeypatch):
    df = spark.createDataFrame([(i, "word " * 200) for i in range(100)], "post_id long, post string")
    monkeypatch.setattr(spark.conf, "get", lambda *_: "4")
    assert vz.text_partitions(df, "post") == 4
    assert vz.text_partitions(df, "post", size=1000) == 100
    assert vz.by_post(df, "post", partitions=7).rdd.getNumPartitions() == 7


def test_terms_outside_the_vocabulary_are_not_aggregated(spark):
    df = spark.createDataFrame([(1, "red blue red"), (2, "blue green"), (3, None)], "post_id long, post string")
    vocabulary = pin(spark.createDataFrame([("red", 1.0), ("blue", 1.0)], "term string, idf double"))
    tf = vz.term_counts(df, vocabulary=vocabulary)
    assert sorted(map(tuple, tf.collect())) == [(1, "blue", 1), (1, "red", 2), (2, "blue", 1)]
    text = plan(tf)
    assert text.index("HashAggregate") < text.index("BroadcastHashJoin")  # the join lies below


def test_vectors_are_made_of_arrays(spark):
    rows = [(1, [0, 3], [0.5, 1.0]), (2, [], [])]
    df = spark.createDataFrame(rows, "post_id long, idx array<int>, weight array<double>")
    made = vz._sparse_vectors(df, 5, "post_id", "v")
    assert "MapInArrow" in plan(made) and "EvalPython" not in plan(made)
    assert {r["post_id"]: r["v"].toArray().tolist() for r in made.collect()} == {1: [0.5, 0, 0, 1.0, 0], 2: [0.0] * 5}


@pytest.mark.parametrize("limit", ["-1", "10m"])
def test_tokens_are_not_sorted_for_a_large_lexicon(spark, posts, lexicons, limit):
    """They were: a task then held its tokens; 64 MB of shuffled tokens took 1 GB."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    tokens, vad, category = lx.explode_tokens(posts), pin(lexicons.vad), pin(lexicons.category)
    spark.conf.set(key, limit)
    try:
        valued, kinds = lx.lexicon_join(tokens, vad), lx.category_join(tokens, category)
        for out in (valued, kinds):
            text = plan(out)
            assert ("BroadcastHashJoin" if limit == "10m" else "ShuffledHashJoin") in text and "SortMergeJoin" not in text
        assert valued.columns == ["word", "post_id", *fv.VAD]
        rows = sorted((r["post_id"], r["word"], r["valence"], r["dominance"]) for r in valued.filter("post_id in (2, 4)").collect() if r["word"] in (None, "good", "but"))
        assert rows == [(2, None, 0.0, 0.0), (4, "but", 0.0, 0.0), *[(4, "good", 0.9, 0.0)] * 3]
        assert valued.filter("word = 'bad'").count() == 4  # two rows of the lexicon
        got = kinds.groupBy("post_id", "category").count().collect()
    finally:
        spark.conf.set(key, before)
    a, b = fv.CATEGORIES[0], fv.CATEGORIES[3]
    assert {tuple(r) for r in got} == {(1, a, 3), (1, b, 1), (4, a, 3), (4, b, 3), (None, a, 1), (None, b, 1)}


def test_broadcast_is_judged_by_all_columns(spark):
    """The word column alone was weighed, so tokens were sorted for a lexicon that was then too large."""
    lexicon = pin(spark.range(20000).selectExpr("concat('w', id) as word", *[f"rand({i}) as v{i}" for i in range(10)]))
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "1m")
    try:
        assert not lx._is_broadcast(lexicon) and lx._is_broadcast(lexicon.select("word"))
    finally:
        spark.conf.set(key, before)
