"""Readers for posts and lexicons, and sinks for reports and feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postsift import fixed_values as fv

REQUIRED = ("subreddit", "post")
POSTS = T.StructType(
    [
        T.StructField("post_id", T.LongType()),
        T.StructField("subreddit", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("post", T.StringType()),
    ]
)


def missing_to_null(df: DataFrame) -> DataFrame:
    """Texts that stand for a missing value become NULL in every string column."""
    return df.select(
        *[
            F.when(~F.col(c).isin(*fv.MISSING_TEXTS), F.col(c)).alias(c)
            if t == "string" else F.col(c)
            for c, t in df.dtypes
        ]
    )


def read_posts(
    spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None
) -> DataFrame:
    """Posts with `subreddit`, `post`, optional `author`; other columns ride along.

    A CSV file has a header, and `schema` picks and casts its columns by name, in any order; quoted
    fields may hold line breaks and doubled quotes, so a CSV file is read by one task: write large
    inputs as Parquet once. Without `post_id` the rows get one by `with_post_id` over all columns.
    """
    if fmt == "csv":
        df = missing_to_null(spark.read.options(header=True, multiLine=True, quote='"', escape='"').csv(path))
        if schema:
            picked = [f for f in schema.fields if f.name in df.columns]
            df = df.select(*[F.col(f.name).cast(f.dataType) for f in picked])
    else:
        reader = spark.read.schema(schema) if schema else spark.read
        df = reader.format(fmt).load(path)
    lost = [c for c in REQUIRED if c not in df.columns]
    if lost:
        raise ValueError(f"{path}: missing column(s) {', '.join(lost)}")
    if "author" not in df.columns:
        df = df.withColumn("author", F.lit(None).cast("string"))
    if "post_id" not in df.columns:
        df = with_post_id(df, *df.columns)
    return df.withColumn("post_id", F.col("post_id").cast("long"))


def spread(df: DataFrame) -> DataFrame:
    """Use every core where the input has fewer splits than cores; large inputs stay untouched."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def with_post_id(df: DataFrame, *natural_key: str) -> DataFrame:
    """Add `post_id` as a 64-bit hash of columns that identify a post (for example url, time).

    Rows equal in all of them are numbered, so that their keys differ; the keys of a table are the
    same on every run. About n^2 / 2^65 keys collide: from some 10^9 rows on give the rows a key of
    their own, `assert_unique_key` tells.
    """
    once = F.xxhash64(*natural_key)
    copy = F.row_number().over(Window.partitionBy(*natural_key).orderBy(once))
    return df.withColumn("post_id", F.xxhash64(*natural_key, copy))


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """One term per line, trimmed, blank lines dropped, in one column `term`."""
    return (
        spark.read.text(path)
        .select(F.regexp_replace("value", r"(?U)^\s+|\s+$", "").alias("term"))
        .filter(F.length("term") > 0)
    )


def emotion_table(long: DataFrame) -> DataFrame:
    """(word, emotion, val) rows to one row per word: mean per emotion, 0 where there is none."""
    return (
        long.groupBy("word")
        .pivot("emotion", list(fv.EMOTIONS))
        .agg(F.avg("val"))
        .na.fill(0.0, list(fv.EMOTIONS))
    )


def read_emotion_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated word, emotion, value without header."""
    return emotion_table(
        spark.read.csv(path, sep="\t", schema="word string, emotion string, val double")
    )


def last_per_word(rows: DataFrame, order: str) -> DataFrame:
    """One row per word, the one with the highest `order`."""
    values = [c for c in rows.columns if c not in ("word", order)]
    return (
        rows.groupBy("word")
        .agg(F.max_by(F.struct(*values), order).alias("v"))
        .select("word", *[F.col(f"v.{c}").alias(c) for c in values])
    )


def read_vad_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated word, valence, arousal, dominance; of a repeated word the last line counts, over
    several files in the order of their names."""
    rows = spark.read.csv(
        path, sep="\t", schema="word string, valence double, arousal double, dominance double"
    )
    place = F.struct(
        F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()
    )
    return last_per_word(rows.withColumn("line", place), "line")


def save_features(df: DataFrame, path: str) -> None:
    """Feature rows, long form or with a vector column, as Parquet."""
    df.write.mode("overwrite").parquet(path)


def write_report(df: DataFrame, path: str, fmt: str = "json") -> None:
    """A report has a few rows per class: one file."""
    df.coalesce(1).write.mode("overwrite").format(fmt).option("header", True).save(path)
