"""Fill-in-middle, filter audit and SimHash against plain versions, and their corner cases."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from postsift.llm import filter_audit, fim, simhash

CLASH = (
    "doc_id long, text string, source string, bits long, t string, n int, form int, key int, digest string, mask int, "
    "part int, h1 string, output string, least string, good int"
)
REST = (7, "t", 1, 2, 3, "d", 4, 5, "h", "o", "l", 6)


def _text(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join("w" + str(rng.randrange(vocabulary)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Nulls, empty, tiny, long, equal and repeated texts, a null key, characters of one to four bytes."""
    rng = random.Random(9)
    base = _text(rng, 300)
    out = [
        (0, base, "a"), (1, None, "a"), (2, "", None), (3, "A", ""), (4, base, "b"), (4, base, "b"), (4, base, "a"),
        (5, base.replace(" w1", " W1", 2), "b"), (6, _text(rng, 30000, 5000), "c"), (7, "häß  ünïcødé 😀😀 çé", "a"),
        (9, "two words", "b"), (10, "Two Words", "b"), (None, base, "a"), (11, "aaaa" * 60, "a"), (13, "\n\t ", "c"), (14, None, "c"),
        (15, "holds <S> itself", "a"), (16, "\n lead and  trail \t", "b"), (17, "x" * 200, "b"), (-8, base, "c"), (18, "a\0b & c", "a"),
    ]
    for i in range(20, 160):
        out.append((i, _text(rng, rng.randint(0, 90), rng.choice([5, 60, 2000])).replace("w", rng.choice("wW😀"), rng.randint(0, 40)), "abc"[i % 3]))
    return out + [(1000 + i, out[20 + i % 30][1], "d") for i in range(60)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, *REST) for r in rows], CLASH)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], CLASH)


def _plain_cut(key, text):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in fim.SENTINELS) or h[2] % 100 >= 50:
        return key, n, "plain", None, None, text
    if h[3] % 100 < 80:
        return key, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return key, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_cuts_equal_plain_cuts_and_are_undone(docs, rows, none):
    made = fim.transform(docs)
    found = made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", fim.restored(F.col("output"), F.col("form")).alias("back")).collect()
    assert Counter(tuple(r)[:6] for r in found) == Counter(_plain_cut(i, t) for i, t, _ in rows)
    assert Counter((r.doc_id, r.back) for r in found) == Counter((i, t or "") for i, t, _ in rows)
    assert {r.form for r in found} == {"plain", "spm", "psm"}
    assert fim.transform(none).count() == 0


def test_memory_of_cuts_goes_back_after_each_batch(monkeypatch):
    """A worker kept what every batch had used, until an executor had taken 3290 of 3000 MB."""
    import pyarrow as pa

    given, sizes, plain_slice = [], [], fim._slice
    monkeypatch.setattr(fim, "give_back", lambda cycles=True: given.append(cycles), raising=False)
    monkeypatch.setattr(fim, "_slice", lambda data, *a: sizes.append(len(data)) or plain_slice(data, *a))
    text = ["some words " * 20_000, None, "", *["a few words"] * 30_000]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(len(text))), pa.array(text), *[pa.array([7] * len(text))] * 4], names=["doc_id", "t", "h1", "h2", "h3", "h4"]
    )
    out = pa.Table.from_batches(fim._cut(iter([batch, batch]), 50, 80, [s.encode() for s in fim.SENTINELS]))
    assert out.num_rows == 2 * len(text) and len(given) == 2 and max(sizes) <= 250_000
    assert [len(x) for x in out.column("output").to_pylist()[:3]] == [len(text[0]) + 9, 0, 0]


def test_skip_lists_reach_every_rank():
    rng = np.random.default_rng(4)
    counts = np.array([0, 1, 2, 700, 0, 33, 5000])
    widths = rng.integers(0, 50, counts.sum())
    lists = fim.SkipLists(counts, widths)
    assert len(lists.lanes) > 3 and np.diff(lists.lanes[-1][0]).max() <= fim.TOP_LINKS
    for first, units, chars, _ in lists.lanes[1:]:
        assert (units[: first[-1]] >= 1).all() and len(chars) == len(units)
    which = np.repeat(np.arange(len(counts)), counts + 1)
    ranks = np.concatenate([np.arange(c + 1) for c in counts])
    expected = np.concatenate([np.concatenate(([0], np.cumsum(widths[a : a + c]))) for a, c in zip(np.cumsum(counts) - counts, counts)])
    assert (lists.descend(which, ranks) == expected).all()


def _plain_audit(rows, labels):
    least: dict[str, int] = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good, toxic = ({i for i, q, x in labels if (q, x)[k] == 1} for k in (0, 1))
    masks = []
    for i, t, part in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        tests = (len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
                 bool(re.search(r"[#$%&*|]", t)), i is not None and i > least[t])
        masks.append((part or "", {f for f, x in zip("ABCDE", tests) if x}, i in good, i in toxic))
    out, shapley = [], Counter()
    for order in itertools.permutations("ABCDE"):
        for part in {m[0] for m in masks}:
            mine = [m[1:] for m in masks if m[0] == part]
            for step, f in enumerate(order):
                past = set(order[:step])
                gone = [m for m in mine if f in m[0] and not m[0] & past]
                shapley[part, f] += len(gone)
                out.append((part, "".join(order), step + 1, f, sum(not m[0] & (past | {f}) for m in mine), len(gone),
                            sum(f in m[0] and bool(m[0] & past) for m in mine), sum(m[0] == {f} for m in mine),
                            sum(m[1] for m in gone), sum(m[2] for m in gone)))
    return Counter((*r, shapley[r[0], r[3]]) for r in out)


def test_audit_equals_a_plain_audit_in_any_order_of_files(spark, docs, rows, tmp_path):
    rng = random.Random(3)
    labels = [(i, rng.randrange(2), rng.randrange(2)) for i in range(0, 1060, 2)] + [(4, None, 1), (None, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    expected = _plain_audit(rows, labels)
    for name, order in (("up", F.col("doc_id").asc()), ("down", F.col("doc_id").desc())):
        path = str(tmp_path / name)
        docs.repartitionByRange(7, order).write.parquet(path)  # the least key of a text comes first or last
        counts = filter_audit.counters(spark, path, table, files=2)
        assert Counter(map(tuple, filter_audit.audit(counts).collect())) == expected


def test_audit_goes_on_with_later_files_after_a_restart(spark, docs, rows, tmp_path):
    path, folder = str(tmp_path / "docs"), str(tmp_path / "state")
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    docs.filter("doc_id > 20 or doc_id is null").coalesce(2).write.parquet(path)
    filter_audit.counters(spark, path, labels, folder=folder, files=1).count()
    docs.filter("doc_id <= 20").coalesce(3).write.mode("append").parquet(path)  # smaller keys retract
    counts = filter_audit.counters(spark, path, labels, folder=folder, files=1)
    assert Counter(map(tuple, filter_audit.audit(counts).collect())) == _plain_audit(rows, [(0, 1, 0)])
    changes = spark.read.parquet(f"{folder}/changes")
    assert changes.filter("n < 0").count() > 0 and changes.select("batch").distinct().count() >= 3


def test_audit_of_an_empty_table(spark, none, tmp_path):
    none.write.parquet(str(tmp_path / "docs"))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(filter_audit.counters(spark, str(tmp_path / "docs"), labels)).count() == 0


def _plain_fingerprint(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _plain_near(items, radius=3):
    """(key, fingerprint, component) by comparing all pairs; rows of one key are one document."""
    up: dict = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    known = [(i, f) for i, f in items if i is not None]
    for (i, f), (j, g) in itertools.combinations(known, 2):
        if i == j or (f ^ g).bit_count() <= radius:
            a, b = root(i), root(j)
            up[max(a, b)] = min(a, b)
    return Counter((i, f"{f:016x}", None if i is None else root(i)) for i, f in items)


def test_simhash_equals_all_pairs(docs, rows, none):
    more = [(2000 + i, " ".join(f"u{(i + k) % 7}" for k in range(8)), "x") for i in range(12)]  # few shingles, near fingerprints
    both = docs.unionByName(docs.sparkSession.createDataFrame([(*r, *REST) for r in more], CLASH))
    expected = _plain_near([(i, _plain_fingerprint(t)) for i, t, _ in rows + more])
    assert Counter(map(tuple, simhash.near_copies(both).collect())) == expected
    assert simhash.near_copies(none).count() == 0


def test_rows_of_one_key_link_their_fingerprints(spark):
    rng = random.Random(1)
    a, b = _text(rng, 40), _text(rng, 40)
    docs = spark.createDataFrame([(5, a), (5, b), (9, a), (3, b), (None, a), (4, _text(rng, 40))], "doc_id long, text string")
    found = {(r.doc_id, r.component_id) for r in simhash.near_copies(docs).collect()}
    assert found == {(5, 3), (9, 3), (3, 3), (None, None), (4, 4)}


def _clouds(rng, n):
    """Fingerprints in clouds around a few centres, so that shards are large and dense."""
    centres = [rng.getrandbits(64) for _ in range(max(1, n // 150))]
    out = set()
    while len(out) < n:
        x = rng.choice(centres)
        for _ in range(rng.randrange(8)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return sorted(out)


def test_bk_trees_find_all_pairs_within_the_radius():
    rng = random.Random(6)
    values = np.array(_clouds(rng, 900), np.uint64)
    groups = np.arange(len(values)) % 5
    forest = simhash.Forest(values, groups)
    found = set()
    for q, at in forest.within(values, groups, 3):
        found |= set(zip(q.tolist(), at.tolist()))
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 3
    near &= groups[:, None] == groups[None, :]
    assert found == set(zip(*(x.tolist() for x in np.nonzero(near))))


@pytest.mark.parametrize("shard", [20_000, 12])
def test_links_connect_what_all_pairs_connect(spark, monkeypatch, shard):
    monkeypatch.setattr(simhash, "SHARD", shard)  # with 12, shards of the clouds are split into parts
    rng = random.Random(7)
    values = _clouds(rng, 700)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    bits = spark.createDataFrame(signed, "bits long")
    for n in (len(values), 10**9, 10**13):  # every layout of blocks
        up = {v: v for v in values}

        def root(x):
            while up[x] != x:
                x = up[x]
            return x

        for r in simhash.links(bits, n).collect():
            a, b = (x % (1 << 64) for x in (r.a, r.b))
            up[root(a)] = root(b)
        mine = defaultdict(set)
        for v in values:
            mine[root(v)].add(v)
        left, parts = set(values), set()
        while left:
            todo, part = [left.pop()], set()
            while todo:
                x = todo.pop()
                part.add(x)
                near = {y for y in left if (x ^ y).bit_count() <= 3}
                left -= near
                todo += near
            parts.add(frozenset(part))
        assert parts == {frozenset(p) for p in mine.values()}
