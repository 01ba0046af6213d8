"""Operators for training data against plain versions, and their corner cases."""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from postsift.llm import (
    bpe, decontaminate, elias_fano, fingerprints, langid, lm, partenum, quality, suffix_dedup, suffixes, warc, words, wrappers,
)
from postsift.llm.components import components
from postsift.llm.queries import rank_file

CLASH = "doc_id long, text string, block int, row_key string, row_text int, t int, k int, bucket int, lang string"


def _text(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join("w" + str(rng.randrange(vocabulary)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Nulls, empty, tiny, long, equal and repeated texts, a null key, characters of one to four bytes."""
    rng = random.Random(5)
    base = _text(rng, 300)
    edited = base.replace(" w1", " x1", 2)
    long = _text(rng, 20000, 5000)
    return [
        (0, base), (1, None), (2, ""), (3, "A"), (4, base), (4, base), (5, edited), (6, long), (7, "häß  ünïcødé 😀😀 çé"),
        (8, base[200:500] + " " + _text(rng, 80)), (9, "two words"), (10, "Two Words"), (None, base), (11, "aaaa" * 60), (12, "aaaa" * 50),
        (13, "\n\t "), (14, None),
    ]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "r", 2, 3, 4, 5, "en") for i, t in rows], CLASH)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], CLASH)


def test_fingerprints_equal_a_plain_parse(docs, rows, none):
    def phrases(text):
        found, part = set(), ""
        for c in text:
            part += c
            if part not in found:
                found.add(part)
                part = ""
        return found

    for text in ("", "a", "abababab", "häß 😀😀😀", _text(random.Random(1), 50)):
        mine: set[int] = set()
        fingerprints.parse(text, mine)
        assert len(mine) == len(phrases(text))
    found = fingerprints.compare_next(docs).collect()
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(2**63)), r[1] is not None, r[1] or ""))
    after = {}
    for a, b in zip(order, order[1:] + order[:1]):
        text, nxt = a[1] or "", b[1] or ""
        half = len(text) // 2
        after.setdefault(a[0], []).append((len(text), hashlib.sha256((text[: len(text) - half] + nxt[:half]).encode()).hexdigest()))
    assert len(found) == len(rows)
    for key, group in itertools.groupby(sorted(found, key=lambda r: (r.doc_id is None, r.doc_id)), key=lambda r: r.doc_id):
        assert sorted((r.n_chars, r.edited_sha256) for r in group) == sorted(after[key])
    prints = defaultdict(set)
    text_of = dict(rows)
    for r in found:
        prints[text_of[r.doc_id] or ""].add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert all(len(v) == 1 for v in prints.values())
    assert fingerprints.compare_next(none).count() == 0
    alone = docs.filter("doc_id = 0")
    assert [r.near_next for r in fingerprints.compare_next(alone).collect()] == [1.0]


def test_fingerprint_likeness_follows_the_phrase_sets(docs):
    rng = random.Random(2)
    a, b = set(range(3000)), set(range(1000, 4000))
    mixed = [{rng.getrandbits(61) for _ in ()} or {(x * 2654435761 + 12345) % (1 << 61) for x in s} for s in (a, b)]
    near = fingerprints.likeness(fingerprints.signature(mixed[0]), fingerprints.signature(mixed[1]))
    assert abs(near - 0.5) < 0.12
    assert docs.transform(fingerprints.fingerprint).filter("length(fingerprint) <> 512").count() == 0


def test_two_stage_sort_and_prefixes():
    rng = random.Random(3)
    for trial in range(60):
        parts = [bytes(rng.choice(b"ab" if trial % 2 else b"abcd") for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(1, 6))]
        text = np.frombuffer(b"".join(p + b"\xff" for p in parts + [b"a" * (trial % 40 + 1)]), np.uint8)
        wanted = np.array([rng.random() < 0.6 and c != 255 for c in text])
        order = suffixes.sort_suffixes(text, wanted, 20)
        found = [bytes(text[i : i + 20]) for i in order]
        assert found == sorted(found) and sorted(order.tolist()) == np.flatnonzero(wanted).tolist()
        for k, common in enumerate(suffixes.common_prefixes(text, order, 20)[1:], 1):
            x, y = found[k - 1], found[k]
            assert common == len(list(itertools.takewhile(lambda p: p[0] == p[1], zip(x, y)))) or len(x) < 20


def _plain_repeats(rows, length=50):
    key = lambda i: math.inf if i is None else i
    first: dict[bytes, float] = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            first[b[k : k + length]] = min(key(i), first.get(b[k : k + length], math.inf))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < key(i):
                gone[k : k + length] = [True] * length
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest(), None if t is None else kept.decode(errors="ignore")))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_bytes", [8_000_000, 20_000])
def test_repeats_equal_brute_force(docs, rows, none, monkeypatch, block_bytes):
    monkeypatch.setattr(suffix_dedup, "n_blocks", lambda total: max(1, total // block_bytes))
    found = suffix_dedup.remove_repeats(docs, carry=["lang"])
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]
    assert sorted((tuple(r[n] for n in names) for r in found.collect()), key=repr) == _plain_repeats(rows)
    kept = suffix_dedup.without_repeats(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows)
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_bpe_equals_tiktoken(docs, rows, none):
    import public_tokenizers
    import tiktoken

    raw = rank_file()
    codec = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(raw), special_tokens={})
    expected = sorted(
        (
            (i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
            for i, t in rows for ids in [codec.encode_ordinary(t or "")]
        ), key=repr,
    )
    found = bpe.round_trip(docs, raw, public_tokenizers.PATTERN)
    assert sorted(map(tuple, found.collect()), key=repr) == expected
    assert bpe.round_trip(none, raw, public_tokenizers.PATTERN).count() == 0
    # Offsets cover the text; a character of several tokens is decoded whole.
    coded = bpe.encode(docs.filter("doc_id = 7"), raw, public_tokenizers.PATTERN, keep=["doc_id"], offsets=True)
    one = coded.first()
    text = dict(rows)[7]
    assert one.starts[0] == 0 and one.ends[-1] == len(text)
    assert bytes(bpe.decode(coded, raw).first().decoded).decode() == text
    rng = random.Random(0)
    strange = ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x80, 0xD800), rng.randrange(0x1F300, 0x1F700)])) for _ in range(60)) for _ in range(200)]
    coder = bpe.ByteBpe(raw, public_tokenizers.PATTERN)
    assert [list(x) for x in coder.encode(strange)] == [codec.encode_ordinary(s) for s in strange]


def test_language_id(spark, none):
    rng = random.Random(4)
    syllables = {"aa": ["ti", "on", "the", "re"], "bb": ["ueu", "ça", "lle", "ou"], "cc": ["sch", "ung", "ein", "ö"]}
    make = lambda y, n: " ".join("".join(rng.choice(syllables[y]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    rows = [(i, make(y, rng.randint(3, 60)), y) for i, y in enumerate(["aa", "bb", "cc"] * 60)]
    rows += [(1000, None, "aa"), (1001, "", None), (1002, "12 34 !?", "bb"), (1003, "Ö", None), (None, "the tion", None), (0, rows[0][1], "aa")]
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, lang string, t int, score int")
    model = langid.fit(table.filter(~langid.held_out("doc_id")))
    found = langid.predict(table, model, reject=False).collect()
    assert len(found) == len(rows)
    truth = {i: y for i, _, y in rows}
    held = [r for r in found if r.doc_id is not None and r.doc_id < 1000 and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(held) > 30 and sum(truth[r.doc_id] == r.lang_pred for r in held) / len(held) > 0.95
    by = {r.doc_id: r for r in found}
    assert [by[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and by[1003].lang_pred in model.languages
    assert all(0 <= r.score <= 1 for r in found)
    rejected = langid.predict(table, model).collect()
    assert all((r.lang_pred == "und") for r in rejected if r.rejected)
    empty = langid.fit(none)
    assert {r.lang_pred for r in langid.predict(table, empty).collect()} == {"und"}
    assert langid.predict(none, model).count() == 0


def _shingles(text, size):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not found:
        return frozenset()
    return frozenset(tuple(found[i : i + size]) for i in range(max(1, len(found) - size + 1)))


def _plain_components(rows, size, percent):
    sets = [(i, _shingles(t, size)) for i, t in rows]
    parent: dict = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in itertools.combinations([s for s in sets if s[0] is not None], 2):
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            x, y = sorted((root(i), root(j)))
            parent[y] = x
    return sorted(((i, len(s), None if i is None else root(i)) for i, s in sets), key=repr)


@pytest.mark.parametrize("size,percent", [(3, 90), (5, 80)])
def test_jaccard_join_equals_brute_force(spark, docs, rows, none, size, percent, monkeypatch):
    assert sorted(map(tuple, partenum.similar_sets(docs, size, percent).collect()), key=repr) == _plain_components(rows, size, percent)
    # Families at growing distance, so that chains, near misses and one large group occur.
    rng = random.Random(7)
    made, key = [], 100
    for family in range(12):
        base = _text(rng, rng.choice([4, 8, 20, 60, 200])).split()
        for _ in range(25 if family else 60):
            copy = base[:]
            for _ in range(rng.randrange(0, max(2, len(base) // 25))):
                copy[rng.randrange(len(copy))] = "e" + str(rng.randrange(50))
            made.append((key, " ".join(copy)))
            key += 1
            if rng.random() < 0.3:
                base = copy
    rng.shuffle(made)
    monkeypatch.setattr(partenum, "n_blocks", lambda total: 3)
    monkeypatch.setattr(partenum, "CELL_BYTES", 2000)
    table = spark.createDataFrame(made, "doc_id long, text string")
    assert sorted(map(tuple, partenum.similar_sets(table, size, percent).collect()), key=repr) == _plain_components(made, size, percent)
    assert partenum.similar_sets(none).count() == 0


def test_members_that_met_in_different_cells_still_link(spark, monkeypatch):
    """Candidates join two large components; pairs of other members, dealt to many cells, still link."""
    rng = random.Random(17)
    base = _text(rng, 40).split()
    made = [(i, " ".join(base[:i % 9] + ["n"] + base[i % 9 + 1 :]) if i else " ".join(base)) for i in range(81)]
    made += [(100 + 2 * i + side, text + (" end" if side else "")) for i, text in enumerate(_text(rng, 40) for _ in range(12)) for side in (0, 1)]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    sent = partenum._find(docs, 1, 3, 90, "doc_id", "text")
    sets = sent.filter("kind = 0").selectExpr("a as id", "n", "bits").filter("bits is not null").cache()
    whole = functools.partial(partenum._with_sets, docs=docs, key="doc_id", text="text", size=3)
    pairs = spark.createDataFrame([(i, 0) for i, _ in made if i], "a long, b long").join(sets.select("id").withColumnRenamed("id", "a"), "a")
    stars = spark.createDataFrame([(i, 0) for i in range(41)] + [(i, 41) for i in range(41, 81)], "node long, component long")
    expected = {frozenset((i, j)) for (i, s), (j, t) in itertools.combinations([(i, _shingles(t, 3)) for i, t in made], 2)
                if 100 * len(s & t) >= 90 * len(s | t)}
    for cell in (10_000_000, 1500):
        monkeypatch.setattr(partenum, "CELL_BYTES", cell)
        found = {frozenset((r.a, r.b)) for r in partenum._rest(pairs, stars, sets, 90, whole).collect()}
        assert found <= expected and {frozenset((100 + 2 * i, 101 + 2 * i)) for i in range(12)} <= found
        assert any(min(f) < 41 <= max(f) < 81 for f in found) == any(min(f) < 41 <= max(f) < 81 for f in expected)
    assert sorted(map(tuple, partenum.similar_sets(docs).collect()), key=repr) == _plain_components(made, 3, 90)


def test_partenum_signatures_lose_no_similar_pair():
    rng = random.Random(8)
    for percent in (80, 90):
        for n in (1, 2, 5, 9, 10, 11, 19, 20, 40, 100, 333):
            for _ in range(6):
                a = [rng.getrandbits(63) for _ in range(n)]
                for cut in range(n):
                    b = a[cut:] + [rng.getrandbits(63) for _ in range(rng.choice([0, cut]))]
                    union = len(set(a) | set(b))
                    if 100 * len(set(a) & set(b)) < percent * union:
                        break
                    h = np.array(sorted(a) + sorted(b), np.uint64)
                    r = np.array([0] * len(a) + [1] * len(b))
                    sig, owner = partenum.signatures(h, r, 2, percent)
                    assert set(sig[owner == 0].tolist()) & set(sig[owner == 1].tolist())
                    assert partenum.sketch_distance(*partenum.sketches(h, r, 2)) <= len(set(a) ^ set(b))


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(None, 3), (7, 7)]
    edges += [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    parent = {}
    root = lambda x: x if parent.setdefault(x, x) == x else root(parent[x])
    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: root(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def _items(spark):
    rng = random.Random(10)
    texts = [f"Question {_text(rng, 14, 3000)}. {_text(rng, 9, 3000)} answer." for _ in range(60)]
    texts += ["", None, "short item", texts[0]]
    return texts, spark.createDataFrame(list(enumerate(texts)) + [(None, "lonely item without key here now")], "item_id long, text string")


def test_decontamination_equals_brute_force(spark, none):
    rng = random.Random(11)
    texts, items = _items(spark)
    rows = [(i, _text(rng, rng.randint(5, 400), 3000)) for i in range(120)]
    plant = lambda t, part: f"{t[: len(t) // 2]} {part} {t[len(t) // 2 :]}"
    rows += [(200 + i, plant(_text(rng, 300), texts[i].upper())) for i in range(20)]
    rows += [(300 + i, plant(_text(rng, 300), texts[i].split(".")[0])) for i in range(10)]  # no answer
    rows += [(400, None), (401, ""), (200, rows[120][1])]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, item_id int, score int")
    found = decontaminate.find_leaks(docs, items).collect()

    norm = lambda t: re.findall(r"[a-z0-9]+", (t or "").lower())
    indexed = [(i, norm(t)) for i, t in [*enumerate(texts), (None, "lonely item without key here now")]]
    n, mean = len(indexed), sum(len(t) for _, t in indexed) / len(indexed)
    df = Counter(w for _, t in indexed for w in set(t))
    weight = []
    for i, t in indexed:
        tf = Counter(t)
        w = {x: math.log1p((n - df[x] + 0.5) / (df[x] + 0.5)) * tf[x] * 2.2 / (tf[x] + 1.2 * (0.25 + 0.75 * len(t) / mean)) for x in tf}
        weight.append((i, {x: v / sum(w.values()) for x, v in w.items()}))
    stride = max(32, max(len(t) for _, t in indexed))
    expected = defaultdict(float)
    for k, (key, text) in enumerate(rows):
        ws = norm(text)
        for start in range(0, max(len(ws), 1), stride):
            have = set(ws[start : start + 2 * stride])
            for j, (i, w) in enumerate(weight):
                s = sum(v for x, v in w.items() if x in have)
                if s >= 0.5 - 1e-9 and w:
                    expected[k, j] = max(expected[k, j], s)
    assert sorted((r.doc_id, repr(r.item_id), round(r.score, 6)) for r in found) == sorted(
        (rows[k][0], repr(weight[j][0]), round(min(s, 1.0), 6)) for (k, j), s in expected.items()
    )
    leaked = {(r.doc_id, r.item_id) for r in found if r.leaked}
    assert {(200 + i, i) for i in range(20)} <= leaked and not any(d is not None and 300 <= d < 400 for d, _ in leaked)
    kept = decontaminate.without_leaks(docs, items)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {k for k, _ in rows} - {d for d, _ in leaked}
    assert decontaminate.find_leaks(none, items).count() == 0
    assert decontaminate.find_leaks(docs, items.filter("false")).count() == 0


def test_warc_round_trip(spark, tmp_path):
    pages = [(3, "http://a/x?q=%20", "<p>eins</p>"), (1, None, "<p>zwei</p>"), (2, "http://ä/\r\nb", "<p>eins</p>"), (4, "http://c", None),
             (5, "http://d", ""), (1, "http://again", "<p>zwei</p>"), (None, "http://null", "<p>eins</p>"), (9, "http://long", "ß" * 700_000)]
    table = spark.createDataFrame([(*p, 1, 2) for p in pages], "page_id long, url string, html string, key int, size int")
    least = {}
    for k, _, h in pages:
        if k is not None:
            least[h or ""] = min(k, least.get(h or "", k))
    expected = sorted((
        (k, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if least[h or ""] == k else "revisit",
         None if least[h or ""] == k else least[h or ""]) for k, _, h in pages for b in [(h or "").encode()]
    ), key=repr)
    index = warc.write_archives(table, str(tmp_path / "archive"))
    found = warc.read_archives(index)
    names = ("key", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r[n] for n in names) for r in found.collect()), key=repr) == expected
    one = warc.read_archives(index.filter("key = 9")).collect()
    assert [bytes(r.payload).decode() for r in one] == ["ß" * 700_000] and one[0].url == "http://long"
    kept = warc.read_archives(warc.write_archives(table, str(tmp_path / "large"), min_revisit_bytes=11))
    assert {r.record_type for r in kept.filter("payload_bytes < 11").collect()} == {"response"}
    assert warc.read_archives(warc.write_archives(table.limit(0), str(tmp_path / "none"))).count() == 0


def test_seek_table_is_the_public_format(tmp_path):
    import zstandard

    writer = warc.BundleWriter(str(tmp_path / "b.warc.zst"), frame_bytes=100)
    places = [writer.add(bytes([i]) * 60) for i in range(5)]
    writer.close()
    reader = warc.BundleReader(str(tmp_path / "b.warc.zst"))
    assert [reader.frame(f)[o : o + n] for f, o, n in places] == [bytes([i]) * 60 for i in range(5)]
    raw = (tmp_path / "b.warc.zst").read_bytes()
    assert zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read() == b"".join(bytes([i]) * 60 for i in range(5))


def test_quality_orders_grades(spark, none):
    rng = random.Random(12)
    good = [(_text(rng, rng.randint(20, 200)), 1, 0) for _ in range(150)]
    junk = [(" ".join(w + "!!" for w in _text(rng, rng.randint(20, 200)).upper().split()), 0, 0) for _ in range(60)]
    toxic = [(" ".join(rng.choice(["idiot", "scum"]) if rng.random() < 0.05 else w for w in _text(rng, 90).split()) + " idiot", 1, 1) for _ in range(60)]
    rows = [(i, *r) for i, r in enumerate(good + junk + toxic)]
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t, _, _ in rows] + [(900, None, 0, "x"), (901, "", 0, "x"), (0, rows[0][1], 0, "x")],
                                 "doc_id long, text string, y int, keep string")
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in rows if i % 3] + [(901, None, None), (None, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    model = quality.fit(docs, quality.grades_of(labels))
    assert np.all(np.diff(model.thresholds) > 0)
    found = {r.doc_id: r for r in quality.grade(docs, model).collect()}
    right = [found[i].keep == (q == 1 and x == 0) for i, _, q, x in rows if i % 3 == 0]
    assert sum(right) / len(right) > 0.9
    assert quality.grade(docs, model).count() == len(rows) + 3
    kept = quality.select_best(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in found.items() if r.keep}
    assert quality.grade(none, quality.fit(none, quality.grades_of(labels))).count() == 0


def test_elias_fano_sequences():
    rng = np.random.default_rng(13)
    for n, top in ((0, 1), (1, 5), (1000, 50), (1000, 1 << 60), (5000, 1 << 33)):
        values = np.sort(rng.integers(0, top, n)).astype(np.uint64)
        data = elias_fano.EliasFano(np.frombuffer(elias_fano.EliasFano.encode(values), np.uint8))
        assert np.array_equal(data.get(np.arange(n)), values)
        asked = np.concatenate([values, rng.integers(0, top, 200).astype(np.uint64)])
        assert np.array_equal(data.successor(asked), np.searchsorted(values, asked, "left"))


@pytest.mark.parametrize("n_parts", [1, 4])
def test_bigram_scores_equal_brute_force(docs, rows, none, monkeypatch, n_parts):
    monkeypatch.setattr(lm, "n_blocks", lambda total, size: n_parts)
    train = ~langid.held_out("doc_id", 7, 2)
    found = lm.score(docs, train).collect()
    assert len(found) == len(rows)
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None] for _, t in rows]
    learn = [k for k, (i, _) in enumerate(rows) if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for k in learn for w in tokens[k])
    total, types = sum(c.values()), len(c)
    pairs = Counter(p for k in learn for p in zip([None] + tokens[k][:-1], tokens[k]))
    followers = Counter(a for a, _ in pairs)
    expected = []
    for (i, _), ws in zip(rows, tokens):
        base = [(c[w] + 1) / (total + types + 1) for w in ws]
        p = []
        for a, w, b in zip([None] + ws[:-1], ws, base):
            share = max(pairs[a, w] - lm.DISCOUNT, 0)
            share = lm.CODEBOOK[lm.quantise(np.array([share / c[a]]))[0]] if share else 0.0
            p.append(share + lm.DISCOUNT * followers[a] / c[a] * b if c[a] else b)
        expected.append((repr(i), len(ws), sum(c[w] > 0 for w in ws), total, sum(map(math.log10, base)), sum(map(math.log10, p))))
    for mine, plain in zip(sorted(((repr(r[0]), *r[1:]) for r in found)), sorted(expected)):
        assert mine[:4] == plain[:4] and mine[4:] == pytest.approx(plain[4:], rel=1e-6)
    assert lm.score(none, train).count() == 0


def test_bigrams_of_a_block_are_sorted_as_one_number(monkeypatch):
    """Two 64-bit keys per token were sorted: with the lookups 990 CPU seconds a GB."""
    rng = np.random.default_rng(8)
    words = np.sort(rng.integers(0, 1 << 63, 30).astype(np.uint64)) * np.uint64(2)
    words[7] = words[6] + np.uint64(1)  # the same follower in its upper 40 bits
    vocabulary = np.sort(np.append(words, np.uint64(lm.END)))
    code, row = rng.integers(0, len(vocabulary), 3000), np.sort(rng.integers(0, 40, 3000))
    counts, n = np.bincount(code, minlength=len(vocabulary)), 5
    counts[3] = 20_000  # hot: dealt to several buckets
    monkeypatch.setattr(lm.np, "lexsort", None)
    first, follower, index, before, named, fan = lm._bigrams(vocabulary, code, row, counts, int(counts.sum()), n)
    monkeypatch.undo()
    assert fan[3] > 1
    at = np.lexsort((follower, first))
    assert (at == np.arange(len(first))).all()
    assert len(set(zip(first.tolist(), follower.tolist()))) == len(first)
    assert (first[index] % len(vocabulary) == before).all()
    assert (follower[index] == vocabulary[code] >> np.uint64(64 - lm.FOLLOWER_BITS)).all()
    assert set(first.tolist()) <= set(named.tolist())
    buckets = {b for b in (first[first % len(vocabulary) == 3] // len(vocabulary)).tolist()}
    assert len(buckets) > 1


PAGE = (
    '<!DOCTYPE html><html><head><title>T{0}</title><style>p{{}}</style><script>var t="</p>";</script></head><body class="with-sidebar">'
    '<header><h2>Site</h2></header><nav><ul><li>Home{0}<li>About</ul></nav><div class="ad">Buy {0}</div>'
    '<div class="notice">We use cookies</div><aside>Side {0}</aside><article><h1>Title&amp;{0}</h1><p><b>Bold {0}<br><p>Text  \n {1} &eacute;'
    '<ul><li>one<li>two</ul><form><input>Mail</form><script>x()</script><section class="comments"><p>Nice!</p></section></article>'
    '<div id="comments-list"><p>First {0}</p></div><footer>&copy; me</footer></body></html>'
)


def test_wrappers_extract_articles(spark):
    rng = random.Random(14)
    pages, expected = [], {}
    for i in range(12):
        text = _text(rng, rng.randint(5, 60))
        pages.append((i, f"http://{'hot' if i % 2 else 'cold'}.example/{i}", PAGE.format(i, text)))
        expected[i] = f"Title&{i}\nBold {i}\nText {text} é\none\ntwo"
    plain = '<div class=page><div class=menu>Home</div><div class=body><p>{0}</p><p>more {1}</p></div><div>All rights reserved</div></div>'
    for i in range(20, 30):
        text = _text(rng, 40)
        pages.append((i, f"//plain.example/{i}", plain.format(text, i)))
        expected[i] = f"{text}\nmore {i}"
    pages += [(40, None, None), (41, "", ""), (42, "http://x", "no tags <b>at all"), (3, pages[3][1], pages[3][2]), (43, "http://y", "<article><p>a<p>b</article> tail")]
    expected |= {40: "", 41: "", 42: "no tags at all", 43: "a\nb"}
    table = spark.createDataFrame([(*p, 1, 2) for p in pages], "page_id long, url string, html string, host int, text int")
    found = wrappers.main_text(table).collect()
    assert len(found) == len(pages)
    for r in found:
        assert (r.page_id, r.text, r.n_chars) == (r.page_id, expected[r.page_id], len(expected[r.page_id]))
    shapes = {r.host: wrappers.pattern(json.loads(r.wrapper)) for r in wrappers.infer(table).collect()}
    assert "(<li>#</>)+" in shapes["hot.example"] and "<article>" in shapes["hot.example"]
    assert wrappers.main_text(table.limit(0)).count() == 0


def _extracted(pages):
    """The texts of the pages of one host, whose wrapper is made of two halves."""
    whole = [wrappers.expression(wrappers.parse(p)) for p in pages]
    halves = [functools.reduce(wrappers.merge, half) for half in (whole[::2], whole[1::2]) if half]
    wrapper = json.loads(json.dumps(functools.reduce(wrappers.merge, halves)))
    return [wrappers.extract(p, wrapper) for p in pages]


def test_wrappers_drop_only_texts_of_all_pages():
    page = "<body><article>{}<p>story {}</p></article></body>"
    pages = [page.format("bare text of one page" if i == 3 else "", i) for i in range(8)]
    assert _extracted(pages) == [f"bare text of one page\nstory {i}" if i == 3 else f"story {i}" for i in range(8)]
    assert _extracted([page.format("bare", 1)] * 9) == ["bare\nstory 1"] * 9  # copies of one page
    assert _extracted([page.format("bare", i // 3) for i in range(12)]) == [f"bare\nstory {i // 3}" for i in range(12)]
    assert _extracted([page.format("bare", i) for i in range(5)]) == [f"story {i}" for i in range(5)]


def test_wrappers_judge_each_child_by_its_own_entry():
    page = "<article><div>By staff</div><h1>Title {0}</h1><div>story {0}</div>{1}</article>"
    assert _extracted([page.format(i, "") for i in range(8)]) == [f"Title {i}\nstory {i}" for i in range(8)]
    last = "<article><div>story {0}</div><h1>Title {0}</h1><div>All rights reserved</div></article>"
    assert _extracted([last.format(i) for i in range(8)]) == [f"story {i}\nTitle {i}" for i in range(8)]
    # Optional and repeated groups between them.
    more = ["", "<hr>", "<h2>a</h2><div>b {0}</div><h2>c</h2><div>d</div>".format(7)]
    assert _extracted([page.format(i, more[i % 3]) for i in range(12)]) == [
        f"Title {i}\nstory {i}" + ("\na\nb 7\nc\nd" if i % 3 == 2 else "") for i in range(12)
    ]
    plain = "<div>Home</div><h2>Menu</h2><div><p>story {0}</p><p>and {0}</p></div>"
    assert all(f"story {i}\nand {i}" in text for i, text in enumerate(_extracted([plain.format(i) for i in range(8)])))


def test_wrapper_regions_leave_no_varying_text_outside():
    page = "<div><div class=menu>Home</div><div class=box>Site</div><div class=all><h1>Title</h1><div class=lead>lead {0}</div><div class=body><p>{1}</p></div></div></div>"
    long = "many words " * 40
    assert _extracted([page.format(i, f"{long}{i}") for i in range(8)]) == [f"Title\nlead {i}\n{long}{i}" for i in range(8)]
    two = "<div class=page><div>Site</div><div class=first><p>{0}</p></div><div class=second><p>{1}</p></div></div>"
    assert _extracted([two.format(f"{long}{i}", i) for i in range(8)]) == [f"{long}{i}\n{i}" for i in range(8)]
    # One page has its text elsewhere; a host with few pages loses nothing.
    odd = "<div class=page><div>Site</div><div class=body><p>{0}</p></div><div class=late>{1}</div></div>"
    assert _extracted([odd.format(i, "other text" if i == 5 else "") for i in range(8)]) == [f"{i}\nother text" if i == 5 else f"{i}" for i in range(8)]
    assert _extracted([odd.format(long, "x")] * 3) == [f"Site\n{long.strip()}\nx"] * 3


def test_names_of_layout_do_not_drop_the_article():
    side = "<div class=sidebar><p>Side {0}</p></div>"
    for around in ('div class="page with-sidebar"', 'div class="content has-header"', 'section class="related-and-story form-1"',
                   'div id=page-no-sidebar', 'div class="form-1" id="has-comments"'):
        tag = around.split()[0]
        for inner in ("article", "main", "div"):
            page = f"<body><{around}><{inner}><h1>Title</h1><p>a story of some words {{0}}</p></{inner}></{tag}>{side}</body>"
            for n in (1, 8):
                assert _extracted([page.format(i) for i in range(n)]) == [f"Title\na story of some words {i}" for i in range(n)], around
    # Long fixed footers, comments and teasers stay out.
    page = (
        "<body class=comments-open><div class=story><p>story {0}</p></div><div class=footer>" + "law " * 50
        + "</div><div class=comments><article><p>" + "I think {0} " * 20 + "</p></article></div></body>"
    )
    assert _extracted([page.format(i) for i in range(8)]) == [f"story {i}" for i in range(8)]
    page = "<article><p>story {0}</p></article><div class=related><article>next {0}</article></div>"
    assert _extracted([page.format(i) for i in range(8)]) == [f"story {i}" for i in range(8)]


def test_expressions_repeat_and_make_optional():
    one = wrappers.expression(wrappers.parse("<dl><dt>a<dd>b<dt>c<dd>d</dl><p>x"))
    two = wrappers.expression(wrappers.parse("<dl><dt>a<dd>b</dl><hr><p>y<p>z"))
    assert wrappers.pattern(one) == "<html><dl>(<dt>#</><dd>#</>)+</><p>#</></>"
    assert wrappers.pattern(wrappers.merge(one, two)).endswith("(<hr></>)?(<p>#</>)+</>")


def test_words_equal_a_plain_split():
    texts = ["A b\tC\x0bd  e", "", " x ", "ÀB çé z", "one"]
    data = "".join(texts).encode()
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    found, rows = words.word_hashes(np.frombuffer(data, np.uint8), offsets)
    plain = [(i, w) for i, t in enumerate(texts) for w in re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), t.encode()))]
    assert rows.tolist() == [i for i, _ in plain]
    names = {}
    assert all(names.setdefault(w, h) == h for (_, w), h in zip(plain, found.tolist())) and len(set(names.values())) == len(names)


def test_queries_cover_their_tables(spark, sf_dir):
    from postsift.llm.queries import QUERIES

    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 11))
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    for name in QUERIES:
        if not name.startswith("op6"):
            n = QUERIES[name](spark, sf_dir).count()
            assert n == (pages if name.startswith(("op7", "op10")) else documents), name


def test_pair_query_equals_its_sql(spark, sf_dir):
    import duckdb

    from postsift.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for name in ("documents", "pages"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    for name, sql in ORACLES.items():
        mine = QUERIES[name](spark, sf_dir)
        theirs = con.execute(sql)
        columns = [d[0] for d in theirs.description]
        assert sorted(mine.columns) == sorted(columns)
        assert sorted(map(tuple, mine.select(columns).collect()), key=repr) == sorted(theirs.fetchall(), key=repr), name


def test_held_out_follows_crc32(spark):
    table = spark.range(50).withColumnRenamed("id", "doc_id")
    found = {r.doc_id for r in table.filter(langid.held_out("doc_id")).collect()}
    assert found == {i for i in range(50) if zlib.crc32(str(i).encode()) % 3 == 1}
    assert table.select(F.lit(None).cast("long").alias("doc_id")).filter(langid.held_out("doc_id")).count() == 0


def _host(pages):
    wrapper = functools.reduce(wrappers.merge, [wrappers.expression(wrappers.parse(p)) for p in pages])
    return [wrappers.extract(p, json.loads(json.dumps(wrapper))) for p in pages]


@pytest.mark.parametrize("page", [
    "<body><header><h1>My Site</h1><p>Tagline</p></header><div><h2>{t}</h2>{b}</div></body>",
    "<body><ul><li>Home<li>About</ul><div><h1>{t}</h1>{b}</div><div class=bottom><p>All rights reserved</p></div></body>",
    "<body><article><div class='entry-header'><h1>{t}</h1></div>{b}<div class=bottom><p>All rights reserved</p></div></article></body>",
    "<body><p>Welcome<table><tr><td>Home<td>Shop</table><section><h3>{t}</h3>{b}</section></body>",
])
def test_text_of_all_pages_is_template_in_any_tag(page):
    body = [f"<p>Story {i} about {i * 7} things.</p><p>More {i * 3}.</p>" for i in range(8)]
    found = _host([page.format(t=f"Title {i}", b=b) for i, b in enumerate(body)])
    assert found == [f"Title {i}\nStory {i} about {i * 7} things.\nMore {i * 3}." for i in range(8)]


def test_deep_pages_keep_their_text(spark):
    deep = ["<div>" * 3000 + "deep" + "</div>" * 3000 + "<p>after", "<b>" * 3000 + "deep<p>after", "<ul><li>" * 2000 + "deep</ul><p>after"]
    table = spark.createDataFrame([(i, f"http://h{i}.x/", p) for i, p in enumerate(deep)], "page_id long, url string, html string")
    assert {r.page_id: r.text.split() for r in wrappers.main_text(table).collect()} == {i: ["deep", "after"] for i in range(3)}


def test_scanning_is_linear_in_unfinished_tags():
    import time

    times = []
    for n in (4_000, 64_000):
        start = time.perf_counter()
        for part in ('<a "', "<a x ", "<a<b", '<a "> " ', "</script", "<a '\">"):
            wrappers.parse(part * n + '"')
        times.append(time.perf_counter() - start)
    assert times[1] < 16 * 6 * times[0] + 1  # 16 times the text; quadratic would be 256 times as long
    assert wrappers.extract('<p title="a>b">x<p title=\'c>y<p "d>z', None).split() == ["x", "y", "z"]
