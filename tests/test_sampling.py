"""Sampling against a brute-force ranking, with one class that holds most rows."""

from __future__ import annotations

import hashlib
import math
from collections import Counter, defaultdict

import pytest

from postsift.operators import sampling as sp


@pytest.fixture(scope="module")
def rows():
    names = ["big"] * 700 + ["mid"] * 200 + ["small"] * 7 + ["one"] + [None] * 5
    return list(enumerate(names))


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "post_id long, label string")


def places(rows):
    """(class size, rank in hash order) of each row."""
    groups = defaultdict(list)
    for i, label in rows:
        groups[label].append((hashlib.md5(f"42|{i}".encode()).hexdigest(), i))
    return {
        i: (len(g), rank) for g in groups.values() for rank, (_, i) in enumerate(sorted(g), 1)
    }


def test_split(df, rows):
    want = {i: r <= math.ceil(n * 0.15) for i, (n, r) in places(rows).items()}
    assert {r["post_id"]: r["is_test"] for r in sp.stratified_split(df, "label").collect()} == want


@pytest.mark.parametrize("cap", [1, 7, 150, 10_000])
def test_cap(df, rows, cap):
    want = {i for i, (_, r) in places(rows).items() if r <= cap}
    assert {r["post_id"] for r in sp.cap_per_class(df, "label", cap).collect()} == want


@pytest.mark.parametrize("k", [2, 3, 5])
def test_folds_are_balanced_and_complete(df, rows, k):
    got = sp.stratified_folds(df, "label", k).collect()
    assert sorted(r["post_id"] for r in got) == [i for i, _ in rows]
    sizes = Counter((r["label"], r["fold"]) for r in got)
    for label in {label for _, label in rows}:
        counts = [sizes[(label, f)] for f in range(k)]
        assert sum(counts) == sum(1 for _, x in rows if x == label)
        assert max(counts) - min(counts) <= 1


def test_weights_balance_the_classes(df):
    rows = sp.balanced_weights(df, "label").collect()
    sums = defaultdict(float)
    for r in rows:
        sums[r["label"]] += r["weight"]
    assert all(math.isclose(s, len(rows) / len(sums)) for s in sums.values())


def test_unique_key(spark):
    sp.assert_unique_key(spark.createDataFrame([(1,), (2,)], "post_id long"), "post_id")
    with pytest.raises(ValueError, match="not unique"):
        sp.assert_unique_key(spark.createDataFrame([(1,), (1,)], "post_id long"), "post_id")
