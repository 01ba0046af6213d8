"""Duplicates under skew, null handling of the filters, and the report against the flags."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from catalog.views import posts
from postsift.operators import filters as fl


def skewed(spark):
    """A third of 900 rows are one text, 100 are blank or null, the rest singles and pairs."""
    rows = [(i, "the same words again") for i in range(300)]
    rows += [(300 + i, None if i % 2 else "") for i in range(100)]
    rows += [(400 + i, f"text {i // 2 if i < 200 else i}") for i in range(500)]
    return spark.createDataFrame(rows, "post_id long, post string"), rows


@pytest.mark.parametrize("threshold", ["10485760", "-1"])
@pytest.mark.parametrize("hot_copies", [1, 5, 100_000])
def test_duplicates_with_a_hot_group(spark, threshold, hot_copies):
    df, rows = skewed(spark)
    counts = Counter(t or "" for _, t in rows)
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, threshold)
    try:
        got = fl.is_duplicate(df, hot_copies=hot_copies).collect()
    finally:
        spark.conf.set(key, before)
    assert len(got) == len(rows)
    assert {r["post_id"]: r["is_duplicate"] for r in got} == {
        i: counts[t or ""] > 1 for i, t in rows
    }


def test_report_equals_flags(spark, sf_dir):
    df = posts(spark, sf_dir)
    flags = fl.noise_flags(df)
    anyone = F.greatest(*[F.col(r).cast("int") for r in fl.NOISE_REASONS])
    want = flags.agg(
        F.count(F.lit(1)).alias("input"),
        *[F.sum(F.col(r).cast("long")).alias(r) for r in fl.NOISE_REASONS],
        F.sum(anyone).alias("total_null"), F.sum(1 - anyone).alias("kept"),
    ).first().asDict()
    assert {r["measure"]: r["n"] for r in fl.noise_report(df).collect()} == want


def test_filters_keep_rows_and_columns(spark, sf_dir):
    df = posts(spark, sf_dir)
    noise = fl.noise_filter(df)
    assert noise.columns == df.columns and noise.count() == df.count()
    out = fl.clinical_filter(noise)
    assert out.count() == df.count()
    rejected = out.filter("reason = 'no_pattern'")
    assert rejected.filter("post is not null or post_cleaned is not null or post_masked is not null").count() == 0


def test_posts_without_author(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h i j")], "post_id long, post string")
    assert fl.noise_filter(df).first()["post"] is not None


def test_nullify_treats_unknown_as_false(spark):
    df = spark.createDataFrame([(1, None), (2, True), (3, False)], "k int, p boolean").withColumn(
        "v", F.lit("x")
    )
    got = fl.nullify_when(df, F.col("p"), ["v"]).orderBy("k").collect()
    assert [r["v"] for r in got] == ["x", None, "x"]


def test_no_text_is_shuffled_for_duplicates(spark, sf_dir):
    """With small tables of repeats the posts meet broadcast joins only."""
    plan = fl.noise_filter(spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.col("doc_id").alias("post_id"), F.col("text").alias("post")
    ))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
