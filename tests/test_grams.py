"""Terms by array operations on blocks of posts equal those of rows, also for keys that repeat or are null."""

from __future__ import annotations

import random

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from postsift.operators import grams as gr
from postsift.operators import vectorize as vz
from postsift.sources.staging import pin

WORDS = ["red", "blue", "green", "WÖRLD", "日本語です", "x", "it's", "aaaaaa", "[b]"]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def texts(spark):
    draw = random.Random(3)
    rows = [(draw.choice([None, *range(40)]), " ".join(draw.choices(WORDS, k=draw.randrange(12))), draw.choice([0, 1, 1, None])) for _ in range(90)]
    rows += [(50, None, 0), (51, "", 1), (52, "zzz qqq", 1)]
    return pin(spark.createDataFrame(rows, "post_id long, post string, label int"), "texts")


def rounded(df) -> list:
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("analyzer", [vz.WORD, vz.CHAR])
@pytest.mark.parametrize("limit", [1, 100, 1 << 20])
def test_counts_and_weights_of_blocks_equal_those_of_rows(spark, texts, analyzer, limit, monkeypatch):
    monkeypatch.setattr(gr.slices, "__defaults__", (limit,))
    tf = vz.term_counts(texts, analyzer)
    plain = tf.select("*")  # rows only
    corpus = vz.corpus_counts(tf)
    assert "MapInArrow" in plan(corpus) and "Generate" not in plan(corpus)  # terms of posts were rows
    assert rounded(corpus) == rounded(vz.corpus_counts(plain)) and corpus.columns == ["term", "ctf", "df"]
    vocabulary = pin(vz.top_vocabulary(plain, 25).withColumn("idf", vz.idf(90)).withColumn("mark", F.length("term")))
    weights = vz.tfidf(tf, vocabulary, keep=("mark",))
    assert "MapInArrow" in plan(weights) and "Window" not in plan(weights)
    assert rounded(weights) == rounded(vz.tfidf(plain, vocabulary, keep=("mark",)))
    assert rounded(vz.tfidf(vz.term_counts(texts, analyzer, vocabulary=vocabulary), vocabulary)) == rounded(vz.tfidf(plain, vocabulary))


def test_vocabularies_too_large_for_a_task_are_joined_as_rows(texts, monkeypatch):
    tf = vz.term_counts(texts)
    vocabulary = pin(vz.top_vocabulary(tf, 25).withColumn("idf", vz.idf(90)))
    want = rounded(vz.tfidf(tf, vocabulary))
    monkeypatch.setattr(vz, "VOCABULARY_BYTES", 10)
    weights = vz.tfidf(vz.term_counts(texts), vocabulary)
    assert "MapInArrow" not in plan(weights) and rounded(weights) == want


def test_many_letters_need_ranks():
    letters = [chr(0x4E00 + i) for i in range(9000)]
    words = ["".join(letters[i : i + 4]) for i in range(0, 9000, 3)] + ["abc", "abc"]
    word, gram, terms = gr.char_grams(words)
    names = terms.to_pylist()
    got = [(int(w), names[g]) for w, g in zip(word, gram)]
    want = [(i, f" {w} "[j : j + n]) for i, w in enumerate(words) for n in gr.SIZES for j in range(len(w) + 3 - n)]
    assert sorted(got) == sorted(want) and len(set(names)) == len(names)


def test_class_sums_are_those_of_the_weights(spark, texts):
    """The weights were written and joined with the labels by a shuffle."""
    vocabularies, want = {}, []
    for a in (vz.WORD, vz.CHAR):
        top = pin(vz.top_vocabulary(vz.term_counts(texts, a), 25).withColumn("idf", vz.idf(90)))
        vocabularies[a] = top.select("term", "idf").toArrow().combine_chunks()
        weights = pin(vz.tfidf(vz.term_counts(texts, a), top))
        want += [(a, *r) for r in rounded(vz.chi2_scores(weights, texts.select("post_id", "label"), "label"))]
        want += [(a, *r) for r in rounded(vz.max_abs(weights))]
    sums = pin(vz._class_sums(texts, "label", "post", vocabularies))
    got = []
    for a, v in vocabularies.items():
        names = v.column("term").to_pylist()
        named = sums.filter(F.col("analyzer") == a).withColumn("term", F.array(*map(F.lit, names))[F.col("at")])
        got += [(a, *r) for r in rounded(vz._chi2(named.filter("class is not null").select("term", "class", "o"), texts, "label"))]
        got += [(a, *r) for r in rounded(named.groupBy("term").agg(F.max("top")))]
    assert got == want


def test_vectors_are_attached_without_a_shuffle_of_them(texts):
    model = vz.TermModel.fit(texts.filter("label is not null"), "label", "post", 60, 60, 25, 25)
    vectors = model.vectors(texts, "post", "v")
    assert vectors.count() == texts.count()
    attached = model.attach(texts, "post", "v")
    assert plan(attached).count("Exchange hashpartitioning") == 1 and "Join" not in plan(attached)
    joined = texts.join(vectors, "post_id")
    assert attached.columns == joined.columns
    assert rounded(attached.withColumn("v", vector_to_array("v"))) == rounded(joined.withColumn("v", vector_to_array("v")))
    # The vectors of posts are their weights.
    weights = {(r["post_id"], r["idx"]): r["weight"] for r in model.weights(texts, "post").collect()}
    rows = {(r["post_id"], r["idx"]): r["weight"] for r in vz.vector_rows(vectors.filter("post_id is not null"), "v").collect()}
    assert rows and rows == {k: w for k, w in weights.items() if k[0] is not None}
