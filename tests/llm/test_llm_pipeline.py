"""The pipeline's stages against plain versions on a small corpus."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

import corpus_pipeline
from postsift.llm import bpe, quality
from postsift.llm.queries import rank_file
from test_llm_operators import _plain_components, _plain_repeats, _text

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder with documents, labels and benchmark: copies, near copies, passages, leaks, junk, nulls."""
    rng = random.Random(21)
    folder = str(tmp_path_factory.mktemp("corpus"))
    passage = _text(rng, 60, 5000)
    items = [f"Why {_text(rng, 12, 5000)}? Because {_text(rng, 8, 5000)}." for _ in range(8)]
    texts: list[str | None] = [_text(rng, rng.randint(30, 200), 3000) for _ in range(60)]
    texts += [texts[0], texts[0], texts[1].replace("w", "W", 1)]
    texts += [t + " " + passage + " " + _text(rng, 40, 3000) for t in (_text(rng, 60, 3000) for _ in range(6))]
    texts += [_text(rng, 60, 3000) + " " + item + " " + _text(rng, 60, 3000) for item in items[:5]]
    texts += [" ".join(w + "!!" for w in _text(rng, 60).upper().split()) for _ in range(20)] + [None, "", "ä" * 30]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(not (t or "").endswith("!!")), 0) for i, t in enumerate(texts) if i % 4]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, items


def test_stages_equal_plain_versions(spark, corpus):
    import public_tokenizers
    import tiktoken

    folder, rows, items = corpus
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality classifier" and len(corpus_pipeline.STAGES) == 5
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = [f for _, f in corpus_pipeline.STAGES]

    model = quality.fit(docs, quality.grades_of(spark.read.parquet(f"{folder}/labels.parquet")))
    good = {r.doc_id for r in quality.grade(docs, model).collect() if r.keep}
    kept = [r for r in rows if r[0] in good]
    step = stages[0](spark, docs, folder)
    assert step.columns == docs.columns and sorted(map(tuple, step.collect())) == sorted(kept)
    assert sum((r[1] or "").endswith("!!") for r in kept) <= 1

    least = {i: c for i, _, c in _plain_components([(r[0], r[1]) for r in kept], 5, 80)}
    kept = [r for r in kept if least[r[0]] == r[0]]
    step = stages[1](spark, step, folder)
    assert step.columns == docs.columns and sorted(map(tuple, step.collect())) == sorted(kept)

    cut = {r[0]: r[5] for r in _plain_repeats([(r[0], r[1]) for r in kept])}
    kept = [(r[0], cut[r[0]], r[2], r[3], None if cut[r[0]] is None else len(cut[r[0]])) for r in kept]
    step = stages[2](spark, step, folder)
    assert step.columns == docs.columns and sorted(map(tuple, step.collect()), key=repr) == sorted(kept, key=repr)

    kept = [r for r in kept if not any(item in (r[1] or "") for item in items)]
    step = stages[3](spark, step, folder)
    assert step.columns == docs.columns and sorted(map(tuple, step.collect()), key=repr) == sorted(kept, key=repr)

    codec = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(rank_file()), special_tokens={}
    )
    expected = []
    for r in kept:
        ids = codec.encode_ordinary(r[1] or "")
        digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        expected.append((r[0], len(ids), digest, hashlib.sha256((r[1] or "").encode()).hexdigest(), ids))
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    assert sorted(map(tuple, stages[4](spark, step, folder).select(names).collect())) == sorted(expected)
    whole = corpus_pipeline.run(spark, folder)
    assert sorted(map(tuple, whole.select(names).collect())) == sorted(expected)


def test_empty_tables(spark, corpus, tmp_path):
    folder, _, _ = corpus
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_sketches_of_a_width_are_compared_as_a_matrix(monkeypatch):
    """Every pair of pivot and member was made and its sketches gathered byte by byte, whatever their sizes."""
    import numpy as np
    import pyarrow as pa

    from postsift.llm import partenum as pe

    draw = np.random.default_rng(5)
    base = [draw.integers(0, 1 << 63, k).astype(np.uint64) for k in (1, 3, 40, 70, 500)]
    sets = [np.unique(b[draw.integers(0, len(b) // 6 + 1):]) for b in base for _ in range(30)]
    n = np.array([len(x) for x in sets])
    bits = pe.sketches(np.concatenate(sets), np.repeat(np.arange(len(sets)), n), len(sets))
    group, pivot = draw.integers(0, 9, len(sets)), draw.random(len(sets)) < 0.4
    p, m = np.flatnonzero(pivot), np.flatnonzero(~pivot)
    want = {
        (a, b) for a in p.tolist() for b in m.tolist()
        if group[a] != group[b] and 100 * min(n[a], n[b]) >= 80 * max(n[a], n[b])
        and pe.sketch_distance(bits[a], bits[b]) <= (n[a] + n[b]) * 20 // 180
    }
    monkeypatch.setattr(pe, "_near", lambda *a: 1 / 0)  # the way for pairs
    for pairs in (1, 50, 100_000):
        monkeypatch.setattr(pe, "SKETCH_PAIRS", pairs)
        found = [x for a, b in pe._apart(p, m, group, n, pa.array(bits, pa.binary()), 80) for x in zip(a.tolist(), b.tolist())]
        assert len(found) == len(set(found)) and set(found) == want and want
