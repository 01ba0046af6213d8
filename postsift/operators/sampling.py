"""Exact, repeatable stratified sampling without sorting whole classes.

Rows of a class are ordered by md5(seed | key). A sample is "all rows up to the q-th of this
order", so one border (hash, key) per class decides it. The border is found by counting hash
prefixes and ranking only the rows of the one prefix in which the border lies; the sample itself
is then a comparison on each row. A class that holds most of the data never meets in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postsift import fixed_values as fv
from postsift.sources.staging import pin


def order_hash(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def n_classes(df: DataFrame, label: str) -> DataFrame:
    return df.agg(F.countDistinct(label).alias("n_classes"))


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def assert_unique_key(df: DataFrame, key: str) -> None:
    twice = repeated_keys(df, key).first()
    if twice is not None:
        raise ValueError(f"{key} is not unique: {twice[key]} occurs {twice['n']} times")


def class_borders(
    df: DataFrame,
    label: str,
    ranks: Sequence[Column],
    key: str = "post_id",
    seed: int = fv.SEED,
    digits: int = 3,
) -> DataFrame:
    """One row per class: `borders`, the (hash, key) at each wanted rank in hash order.

    `ranks` are Columns over `n`, the class size. A rank of 0 or beyond the class gives no border.
    """
    rows = df.select(F.col(label).alias("c"), F.col(key).alias("k")).withColumn(
        "h", order_hash("k", seed)
    )
    rows = rows.withColumn("b", F.substring("h", 1, digits))
    sizes = rows.groupBy("c", "b").agg(F.count(F.lit(1)).alias("size"))
    # At most 16^digits rows per class meet here.
    up_to = Window.partitionBy("c").orderBy("b")
    spans = sizes.withColumns(
        {
            "n": F.sum("size").over(Window.partitionBy("c")),
            "end": F.sum("size").over(up_to),
        }
    )
    wanted = F.array(
        *[F.struct(F.lit(i).alias("i"), r.cast("long").alias("rank")) for i, r in enumerate(ranks)]
    )
    targets = (
        spans.select("c", "b", "size", "end", F.explode(wanted).alias("w"))
        .filter("w.rank > end - size and w.rank <= end")
        .select("c", "b", F.col("w.i").alias("i"), (F.expr("w.rank - end + size")).alias("rank"))
    )
    targets = pin(targets, "targets")  # ranks x classes rows
    inside = rows.join(targets, rows.c.eqNullSafe(targets.c) & (rows.b == targets.b)).select(
        rows.c, "i", "rank", "h", "k"
    )
    place = F.row_number().over(Window.partitionBy("c", "i").orderBy("h", "k"))
    return (
        inside.withColumn("place", place)
        .filter("place = rank")
        .groupBy("c")
        .agg(F.array_sort(F.collect_list(F.struct("i", "h", "k"))).alias("borders"))
        .select(F.col("c").alias("border_class"), "borders")
    )


def passed_borders(
    df: DataFrame, label: str, borders: DataFrame, name: str, key: str = "post_id",
    seed: int = fv.SEED,
) -> DataFrame:
    """Add `name`: how many of its class's borders lie before the row."""
    table = pin(borders, "borders")
    here = order_hash(key, seed)
    id_ = F.col(key)
    count = F.size(
        F.filter(
            F.coalesce(F.col("borders"), F.array().cast(table.schema["borders"].dataType)),
            lambda b: (here > b["h"]) | ((here == b["h"]) & (id_ > b["k"])),
        )
    )
    return (
        df.join(table, df[label].eqNullSafe(table["border_class"]), "left")
        .withColumn(name, count)
        .select(*df.columns, name)
    )


def stratified_split(
    df: DataFrame, label: str, test: float = fv.TEST_SHARE, seed: int = fv.SEED,
    key: str = "post_id",
) -> DataFrame:
    """Add BOOLEAN `is_test`: ceil(n * test) rows of each class."""
    rank = F.ceil(F.col("n") * F.lit(float(test)))
    borders = class_borders(df, label, [rank], key, seed)
    out = passed_borders(df, label, borders, "_passed", key, seed)
    return out.withColumn("is_test", F.col("_passed") == 0).drop("_passed")


def cap_per_class(
    df: DataFrame, label: str, cap: int = fv.CLASS_CAP, seed: int = fv.SEED, key: str = "post_id"
) -> DataFrame:
    """At most `cap` rows of each class, without replacement; smaller classes stay whole."""
    rank = F.when(F.col("n") > cap, F.lit(cap)).otherwise(F.lit(0))
    borders = class_borders(df, label, [rank], key, seed)
    return passed_borders(df, label, borders, "_passed", key, seed).filter("_passed = 0").drop(
        "_passed"
    )


def stratified_folds(
    df: DataFrame, label: str, k: int = fv.FOLDS, seed: int = fv.SEED, key: str = "post_id"
) -> DataFrame:
    """Add INT `fold` in 0..k-1; fold sizes within a class differ by at most one row."""
    n = F.col("n")
    # Fold i has floor(n / k) rows, and one more while i < n % k.
    ranks = [F.floor(n / k) * i + F.least(F.lit(i), n % k) for i in range(1, k)]
    borders = class_borders(df, label, ranks, key, seed)
    return passed_borders(df, label, borders, "fold", key, seed)


def balanced_weights(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Add N / (K * n_class), so that every class has the same total weight."""
    sizes = class_counts(df, label).withColumnRenamed(label, "weight_class")
    whole = Window.partitionBy()  # over one row per class
    table = sizes.select(
        "weight_class",
        (F.sum("n").over(whole) / (F.count(F.lit(1)).over(whole) * F.col("n"))).alias(name),
    )
    table = pin(table, "weights")
    return df.join(table, df[label].eqNullSafe(table["weight_class"])).select(*df.columns, name)


def take_ids(df: DataFrame, ids: DataFrame, key: str = "post_id") -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)
