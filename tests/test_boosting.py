"""The histogram booster against a plain one, and the searches."""

from __future__ import annotations

import math
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.linalg import Vectors

from postsift.operators import boosting as bo
from postsift.operators import learners as ln
from postsift.operators import search as se

PARAMS = {"n_estimators": 6, "num_leaves": 9, "max_depth": 4, "min_child_samples": 8, "reg_alpha": 0.05, "reg_lambda": 0.7,
          "learning_rate": 0.2, "subsample": 0.8, "bagging_freq": 2, "colsample_bytree": 0.7}


@pytest.fixture(scope="module")
def rows():
    """500 rows of 16 features, dense and sparse ones, some constant, negative or rare."""
    rng = np.random.default_rng(0)
    x = np.round(rng.normal(size=(500, 16)), 1)
    x[:, 8:] *= rng.random((500, 8)) < 0.3
    x[:, 14], x[:, 15] = 0.0, (rng.random(500) < 0.004)
    y = np.where(x[:, 0] + x[:, 1] * x[:, 9] > 0.3, 2, np.where(x[:, 2] > 0, 1, 0))
    y[:25] = rng.integers(0, 3, 25)
    return x, y


@pytest.fixture(scope="module")
def df(spark, rows):
    x, y = rows

    def vector(i):
        return Vectors.dense(x[i]) if i % 2 else Vectors.sparse(16, [(j, float(v)) for j, v in enumerate(x[i]) if v])

    data = [(i, float(y[i]), i % 3, 1.0 + i % 2, vector(i), i % 4 == 0) for i in range(len(y))]
    return spark.createDataFrame(data, ["post_id", "label", "fold", "weight", "features", "held"])


def _plain(x, y, keys, k, p, bins, seed):
    """Rounds of trees on raw values, by trying every border of every feature in every leaf."""
    cuts = {int(c): bins.borders[bins.first[i] : bins.first[i + 1]] for i, c in enumerate(bins.columns)}
    names = list(cuts)
    counts = np.bincount(y, minlength=k)
    score = np.tile(np.log(counts / counts.sum()), (len(y), 1))
    trees = []
    for r in range(p["n_estimators"]):
        used = bo.bag(keys, p, r, seed)
        e = np.exp(score)
        prob = e / e.sum(axis=1, keepdims=True)
        step, grown = np.zeros_like(score), []
        for c in range(k):
            g = prob[:, c] - (y == c)
            h = k / (k - 1) * prob[:, c] * (1 - prob[:, c])
            usable = bo.columns_of(len(names), p, r, c, seed)

            def part(m):
                gg, hh = g[m & used].sum(), h[m & used].sum()
                return gg, hh, int((m & used).sum())

            def gain(m):
                gg, hh, _ = part(m)
                return max(abs(gg) - p["reg_alpha"], 0) ** 2 / (hh + p["reg_lambda"])

            def best(m, depth):
                found = None
                if depth == p["max_depth"]:
                    return None
                for i, f in enumerate(names):
                    for cut in cuts[f] if usable[i] else ():
                        left, right = m & (x[:, f] <= cut), m & (x[:, f] > cut)
                        if min(part(left)[2], part(right)[2]) < p["min_child_samples"] or min(part(left)[1], part(right)[1]) < 1e-3:
                            continue
                        value = gain(left) + gain(right) - gain(m)
                        if value > 1e-9 and (found is None or value > found[0] + 1e-9):
                            found = (value, f, cut, left, right)
                return found

            whole = np.ones(len(y), bool)
            leaves = [(whole, 0, best(whole, 0))]
            while len(leaves) < p["num_leaves"] and any(b for _, _, b in leaves):
                at = max((i for i, leaf in enumerate(leaves) if leaf[2]), key=lambda i: leaves[i][2][0])
                _, depth, (_, f, cut, left, right) = leaves.pop(at)
                grown.append((c, f, float(cut)))
                leaves += [(s, depth + 1, best(s, depth + 1)) for s in (left, right)]
            for m, _, _ in leaves:
                gg, hh, _ = part(m)
                step[m, c] = -math.copysign(max(abs(gg) - p["reg_alpha"], 0), gg) / (hh + p["reg_lambda"]) * p["learning_rate"]
        score = score + step
        trees.append(sorted(grown))
    return score, trees


def test_booster_equals_a_plain_one(df, rows):
    x, y = rows
    bins = bo.find_bins(df)
    assert 14 not in bins.columns and 15 in bins.columns
    table = bo.bin_rows(df, bins, "label", "post_id", "features", None).toArrow().sort_by("key")
    ids = {r.k: r.post_id for r in df.selectExpr("xxhash64(post_id) as k", "post_id").collect()}
    order = [ids[k] for k in table.column("key").to_pylist()]
    keys = np.array(table.column("key").to_pylist(), np.int64)
    p = {**bo.DEFAULTS, **PARAMS, "n_estimators": 2}
    score, trees = _plain(x[order], y[order], keys, 3, p, bins, 42)
    model = ln.fit_boosted_flat(df, p, 3)
    mine = [sorted((c, f, cut) for c, t in enumerate(grown) for f, cut in zip(t[0], t[1]) if f >= 0) for grown in model.trees]
    assert mine == trees
    found = {r.post_id: r.p for r in model.scores(df).select("post_id", "p").collect()}
    assert np.allclose([found[i] for i in order], bo.softmax(score), atol=1e-7)


def test_a_dealt_table_gives_the_same_trees(df, monkeypatch):
    monkeypatch.setattr(bo, "BLOCK_ROWS", 120)
    monkeypatch.setattr(bo, "CHUNK", 5)
    monkeypatch.setattr(bo, "SCORED_ROUNDS", 1)
    small = {**PARAMS, "n_estimators": 3}
    a, b = ln.fit_boosted_flat(df, small, 3), bo.fit(df, small, 3, task_bytes=0)
    assert a.trees == b.trees and a.begin == b.begin
    # Rows held out: the rounds up to their least loss, in either way.
    a = bo.fit(df, {**small, "n_estimators": 4, "learning_rate": 3.0}, 3, valid="held")
    b = bo.fit(df, {**small, "n_estimators": 4, "learning_rate": 3.0}, 3, valid="held", task_bytes=0)
    assert a.trees == b.trees and 1 <= len(a.trees) <= 4


def test_early_stop_ends_before_all_rounds(df):
    bins = bo.find_bins(df)
    block = bo.Block.of(bo.bin_rows(df, bins, "label", "post_id", "features", "fold").toArrow(), bins)
    _, _, curve = bo.boost(block, 3, {"n_estimators": 2000, "learning_rate": 0.3, "min_child_samples": 10}, folds=3, patience=5)
    assert len(curve) < 200 and len(curve) - 1 - int(np.argmin(curve)) == 5
    _, _, cut = bo.boost(block, 3, {"n_estimators": 50, "learning_rate": 0.01}, folds=3, patience=5, medians=[min(curve)] * 50)
    assert len(cut) == 5  # worse than the median of others


def test_saved_trees_score_the_same(df, tmp_path):
    model = ln.fit_boosted_flat(df, PARAMS, 3)
    model.save(str(tmp_path / "m"))
    again = bo.Boosted.load(str(tmp_path / "m"))
    assert again.trees == model.trees and again.begin == model.begin
    empty = ln.fit_boosted_flat(df.limit(0), PARAMS, 3)
    assert [round(p, 6) for p in empty.scores(df).first().p] == [0.333333] * 3


def test_parzen_search_beats_random_search():
    space = {"a": ("log", 1e-4, 10.0), "b": ("float", -5.0, 5.0), "n": ("int", 1, 40)}

    def loss(p):
        return (math.log10(p["a"]) + 2) ** 2 + (p["b"] - 1.5) ** 2 + ((p["n"] - 7) / 6) ** 2

    def best(seed, startup):
        sampler = se.Parzen(space, seed, startup=startup)
        for _ in range(12):
            for p in sampler.suggest(5):
                sampler.tell(p, loss(p))
                assert all(low <= p[k] <= high for k, (_, low, high) in space.items())
        return min(v for _, v in sampler.tried)

    assert np.median([best(s, 10) for s in range(30)]) < 0.6 * np.median([best(s, 1000) for s in range(30)])  # 1000: all random
    assert se.Parzen(space, 3).suggest(4) == se.Parzen(space, 3).suggest(4)


def test_linear_search_ends_at_small_gradients(df, rows):
    x, y = rows
    sparse = se.Sparse([np.flatnonzero(r) for r in x], [r[r != 0] for r in x])
    w = np.where(y == 0, 2.0, 1.0)
    loss = se.logistic_loss(sparse, y, w, 3, 0.5)
    found = se.minimise(loss, np.zeros((3, sparse.width)), 1e-6, 2000)
    assert np.abs(loss(found)[1]).max() <= 1e-6
    step = np.zeros_like(found)
    step[1, 2] = 1e-6
    assert math.isclose((loss(found + step)[0] - loss(found - step)[0]) / 2e-6, loss(found)[1][1, 2], abs_tol=1e-6)
    tuned = ln.tune_linear(df, "logistic", 5, 3)
    assert len(tuned.trials) == 5 and tuned.score == max(t["score"] for t in tuned.trials) > 0.5
    # A trial's score is that of distributed fits with its parameters.
    params = tuned.trials[0]["params"]
    scores = []
    for i in range(3):
        model = ln.fit_logistic(df.filter(f"fold <> {i}"), c=params["c"], tol=1e-8)
        scores.append(ln.macro_f1_of(model.scores(df.filter(f"fold = {i}"))))
    assert abs(tuned.trials[0]["score"] - sum(scores) / 3) < 0.02
    assert ln.tune_linear(df, "svm", 3, 3).score > 0.5


def test_boosted_search_and_its_bound(df, monkeypatch):
    found = ln.tune_boosted(df, 6, 3, space={**ln.BOOST_SPACE, "n_estimators": ("int", 10, 30)}, prune=True)
    assert len(found.trials) == 6 and found.score == min(t["score"] for t in found.trials) < math.log(3)
    assert all(len(t["curve"]) <= t["params"]["n_estimators"] for t in found.trials)
    monkeypatch.setattr(se, "TASK_BYTES", 10)
    with pytest.raises(ValueError):
        ln.tune_boosted(df, 1, 3)


def test_bins_part_zero_from_both_sides():
    bins = bo.Bins(np.array([3, 5]), np.array([0, 2, 4]), np.array([np.nextafter(0.0, -1.0), 0.0, 0.0, 2.0]))
    number, known = bins.of(np.array([3, 3, 4, 5, 5, 5]), np.array([-1.0, 4.0, 9.0, 1.0, 2.0, 7.0]))
    assert known.tolist() == [True, True, False, True, True, True]
    assert number.tolist() == [0, 2, 4, 4, 5] and bins.zero().tolist() == [1, 3]
    vectors = pa.array([{"type": 1, "size": None, "indices": None, "values": [0.0, 2.0]}])
    assert [x.tolist() for x in bo.entries(vectors)] == [[0], [1], [2.0]]


def _wide_block(n=4000, width=300, seed=5):
    rng = np.random.default_rng(seed)
    bins = bo.Bins(np.arange(width), np.arange(width + 1) * 3, np.tile([0.0, 1.0, 2.0], width))
    packed = [(np.sort(rng.choice(width, 100, replace=False)) * 4 + rng.integers(1, 4, 100)).astype(np.int32).tobytes() for _ in range(n)]
    table = pa.table({"key": pa.array(range(n), pa.int64()), "label": pa.array(rng.integers(0, 2, n), pa.int32()),
                      "fold": pa.array(np.arange(n) % 3, pa.int32()), "bins": pa.array(packed, pa.binary())})
    return bo.Block.of(table, bins)


def test_two_classes_grow_one_tree_a_round(monkeypatch):
    grown, one = [], bo._one_tree
    monkeypatch.setattr(bo, "_one_tree", lambda *a: grown.append(1) or one(*a))
    trees, _, _ = bo.boost(_wide_block(), 2, {"n_estimators": 3})
    assert len(grown) == 3
    monkeypatch.setattr(bo, "_opposite", lambda a, b: False)
    both, _, _ = bo.boost(_wide_block(), 2, {"n_estimators": 3})
    assert len(grown) == 9
    for mine, theirs in zip((t for r in trees for t in r), (t for r in both for t in r)):
        assert mine[:4] == theirs[:4] and np.allclose(mine[4], theirs[4], rtol=0, atol=0)


def test_histograms_and_bins_are_the_same_by_row_and_by_bin():
    plain, sorted_ = _wide_block(), _wide_block().by_bin()
    weights = np.stack([*np.random.default_rng(1).integers(-99, 99, (2, 4000)), np.ones(4000)], axis=1).astype(float)
    for rows in (np.arange(4000), np.arange(0, 4000, 2), np.array([7]), np.empty(0, np.int64)):
        assert (plain.histogram(rows, weights) == sorted_.histogram(rows, weights)).all()
        assert (plain.bin_of(rows, 17) == sorted_.bin_of(rows, 17)).all()


def test_memory_of_a_growing_tree_has_a_bound(monkeypatch):
    block = _wide_block().by_bin()
    weights = bo.gradients(np.zeros((4000, 2)), block.labels, 0)
    params = {**bo.DEFAULTS, "num_leaves": 60, "max_depth": 12, "min_child_samples": 5}
    free, at = bo._one_tree(block, weights, np.ones(300, bool), params)
    monkeypatch.setattr(bo, "KEPT_BYTES", 1)
    monkeypatch.setattr(bo, "SLICE", 10_000)
    tracemalloc.start()
    tight, same = bo._one_tree(block, weights, np.ones(300, bool), params)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert free.arrays() == tight.arrays() and (at == same).all()
    assert peak < 8 * len(block.flat)  # twice the entries, which are 4 bytes each


def _packed_batches(n=20_000, width=2000, per_row=100):
    rng = np.random.default_rng(3)
    for i in range(0, n, 1000):
        binary = [[x.tobytes() for x in rng.integers(0, width, (1000, per_row), np.int32)], [x.tobytes() for x in rng.random((1000, per_row))]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(i, i + 1000), pa.int64()), pa.array(rng.integers(0, 2, 1000), pa.int32()), pa.array(np.zeros(1000), pa.int32()),
             pa.array(np.ones(1000)), *(pa.array(b, pa.binary()) for b in binary)], names=["key", "label", "fold", "weight", "bins", "values"])


def test_a_trial_holds_its_rows_once():
    tracemalloc.start()
    x, labels, weights, _ = se.unpack_rows(_packed_batches())
    se.logistic_loss(x, labels, weights, 2, 1.0)(np.zeros((2, x.width)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2.5 * 12 * 20_000 * 100  # 12 bytes an entry; the batches' own copies and sums come on top


def test_trials_send_no_copies_of_the_rows(df):
    rows = se.pack_rows(df, "features", "label", "weight", "fold", "post_id")
    seen = []

    def run(batches, params, medians):
        keys = np.concatenate([b.column(0).to_numpy() for b in batches])
        assert len(keys) == 500 and (np.diff(keys) > 0).all()
        return float(params["c"]), [1.0]

    before = se.union_all
    se.union_all = lambda parts: seen.append(before(parts)) or seen[-1]
    try:
        found = se.waves(rows, {"c": ("float", 0.0, 1.0)}, 5, run, True, 1, wave=3)
    finally:
        se.union_all = before
    assert [t["score"] for t in found] == [t["params"]["c"] for t in found] and len(found) == 5
    # Rows are read in place: the plan has no exchange of them by trial.
    assert all("hashpartitioning" not in p and "rangepartitioning" not in p for p in (d._jdf.queryExecution().executedPlan().toString() for d in seen))


def test_a_search_of_dealt_rows_has_the_trials_of_a_task(df, monkeypatch):
    """A training table beyond the bound of a task was refused, so it had to be capped."""
    space = {**ln.BOOST_SPACE, "n_estimators": ("int", 3, 9), "num_leaves": ("int", 3, 4), "max_depth": ("int", 2, 2)}
    boosted, lines = ln.search(ln.tune_boosted, df, 2, 3, space=space), ln.search(ln.tune_linear, df, "logistic", 2, 3, max_iter=20)
    monkeypatch.setattr(se, "TASK_BYTES", 10)
    dealt = ln.search(ln.tune_boosted, df, 2, 3, space=space)
    assert [t["params"] for t in dealt.trials] == [t["params"] for t in boosted.trials]
    for a, b in zip(dealt.trials, boosted.trials):
        assert np.allclose(a["curve"], b["curve"])
    many = ln.search(ln.tune_linear, df, "logistic", 2, 3, max_iter=20)
    assert [t["params"] for t in many.trials] == [t["params"] for t in lines.trials]
    assert np.allclose([t["curve"] for t in many.trials], [t["curve"] for t in lines.trials], atol=0.02)
