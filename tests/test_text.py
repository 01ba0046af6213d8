"""Text functions against hand-computed values and plain Python models."""

from __future__ import annotations

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from postsift import fixed_values as fv
from postsift.functions import scores as sc
from postsift.functions import text as tx
from postsift.functions import tokens as tk
from postsift.operators import filters as fl

SAMPLES = [
    None,
    "",
    "   ",
    "nan",
    "  [Deleted] ",
    "I know me. My",
    "I am 25. My 1,000,000 and 3.5 v2",
    "bipolar disorder and please ADD it, r/Depressions r/depression self-harm",
    "See http://x.y/1 www.z.com/2 https://q.r/3 now",
    "http://www.a.b/http://c www.d.e",
    "@bob #tag été @été end ",
    "café Å 각 plain",
    "one two three four five six seven eight nine ten",
    "one two three four five six seven eight nine",
    "I can't, won’t and I'VE seen it's Let's go; y'all shan't",
    "My mom has been diagnosed. I feel\rsad\nI was there",
    "me!me?me\nme mine's my-self MYSELF",
    "[num] a[num]b é[num] ab x",
    "@हिन्दी ok #नमस्ते",
    "\U0001D15E \U0001D1BB plain",
]


def column(spark, fn, dtype="string"):
    rows = list(enumerate(SAMPLES))
    df = spark.createDataFrame(rows, "i int, t string")
    return [r[0] for r in df.select("i", fn(F.col("t")).alias("v")).orderBy("i").select("v").collect()]


def model(fn, null=None):
    return [null if t is None else fn(t) for t in SAMPLES]


def test_nfc(spark):
    assert column(spark, tx.normalize_nfc) == model(lambda t: unicodedata.normalize("NFC", t))


def test_numbers_urls_handles(spark):
    assert column(spark, tx.mask_numbers) == model(lambda t: re.sub(fv.NUMBER, "[NUM]", t))
    assert column(spark, tx.strip_urls) == model(lambda t: re.sub(fv.URL, "", t))
    assert column(spark, tx.strip_handles) == model(lambda t: re.sub(fv.HANDLE, "", t))


def values(spark, fn, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r[1] for r in df.select("i", fn(F.col("t")).alias("v")).orderBy("i").collect()]


def test_mask_terms_by_hand(spark):
    assert values(
        spark, tx.mask_terms, "bipolar disorder", "please ADD it", "r/Depressions", "r/depression self-harm", "cutting-edge", None
    ) == ["[MH] disorder", "please [MH] it", "r/Depressions", "[MH] [MH]", "[MH]-edge", None]


def test_first_person_rate_by_hand(spark):
    assert values(
        spark, tx.first_person_rate, "I know me. My", "", None, "   ", "me!me?me\nme mine's my-self MYSELF", "No one here.", "I. My!"
    ) == [1.5, 0.0, 0.0, 0.0, 1.25, 0.0, 1.0]


def test_word_count_and_short(spark):
    assert column(spark, tx.word_count) == model(lambda t: len(t.split()), 0)
    for n in (0, 1, 3, 10):
        assert column(spark, lambda c, n=n: fl.is_short(c, n)) == model(
            lambda t: len(t.split()) < n, n > 0
        )


def test_spam_counts_urls(spark):
    for n in (0, 1, 2):
        assert column(spark, lambda c, n=n: fl.is_spam(c, n)) == model(
            lambda t: len(re.findall(fv.URL, t)) > n, False
        )


def test_spam_is_linear_on_long_texts(spark):
    text = "word " * 100_000 + "http://a.b www.c.d"
    df = spark.createDataFrame([(text,), (text + " http://e.f",)], "t string")
    assert [r[0] for r in df.select(fl.is_spam(F.col("t"))).collect()] == [False, True]


def test_deleted(spark):
    assert column(spark, fl.is_deleted) == model(
        lambda t: t.strip().lower() in fv.DELETED_TEXTS, True
    )


def test_disclosure_by_hand(spark):
    got = values(
        spark, fl.is_self_disclosure, "I feel hopeless", "My mom has been diagnosed. I feel sad", "A study found that", "", "plain prose"
    )
    assert got == [True, False, False, False, False]


def test_contractions_keep_case(spark):
    got = column(spark, tx.expand_contractions)[14]
    assert got == "I cannot, will not and I have seen it is Let us go; you all shall not"
    assert column(spark, lambda c: tx.expand_contractions(c, None)) == SAMPLES


def test_word_tokens(spark):
    pattern = re.compile(r"(?u)" + fv.WORD_TOKEN)
    got = column(spark, tk.word_tokens)
    for i, t in enumerate(SAMPLES):
        if t is not None:
            assert got[i] == pattern.findall(t.lower())


def test_word_ngrams(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "t array<string>")
    got = [r[0] for r in df.select(tk.word_ngrams(F.col("t"), 1, 2)).collect()]
    assert got == [["a", "b", "c", "a b", "b c"], ["a"], []]
    got = [r[0] for r in df.select(tk.word_ngrams(F.col("t"), 3, 3)).collect()]
    assert got == [["a b c"], [], []]


@pytest.mark.parametrize("word,count", [("x", 1), ("ab", 3), ("abc", 6), ("abcd", 9)])
def test_char_ngrams(spark, word, count):
    padded = f" {word} "
    want = [padded[i:i + n] for n in (3, 4, 5) for i in range(len(padded) - n + 1)]
    df = spark.createDataFrame([(f"  {word}\n",)], "t string")
    got = df.select(tk.char_wb_ngrams(F.col("t"))).first()[0]
    assert got == want and len(got) == count


def test_remap_label(spark):
    df = spark.createDataFrame([("adhd",), ("lonely",), ("jokes",), (None,)], "s string")
    c = F.col("s")
    assert [tuple(r) for r in df.select(
        tx.remap_label(c, fv.LABELS), tx.remap_label(c, fv.LABELS, "non-mental")
    ).collect()] == [
        ("adhd", "adhd"), ("social_isolation", "social_isolation"), ("jokes", "non-mental"), (None, None),
    ]


def test_softmax_of_large_scores(spark):
    df = spark.createDataFrame([([1000.0, 1000.0],), ([0.0, -1000.0],)], "s array<double>")
    got = [r[0] for r in df.select(sc.softmax(F.col("s"))).collect()]
    assert got == [[0.5, 0.5], [1.0, 0.0]]


def test_top_pairs_break_ties_by_name(spark):
    df = spark.createDataFrame([([0.4, 0.4, 0.2],)], "p array<double>")
    top = df.select(sc.top_pairs(F.col("p"), ["b", "a", "c"], 2)).first()[0]
    assert [(t["label"], t["p"]) for t in top] == [("a", 0.4), ("b", 0.4)]


def test_char_wb_counts_cut_each_word_once(spark):
    rows = [(1, "To be, or NOT to be"), (2, "to be"), (3, None), (4, ""), (5, " a ÉTÉ  to\n")] * 3
    df = spark.createDataFrame(rows, "post_id long, post string")
    counted = tk.char_wb_counts(df)
    plain = df.select(F.explode(tk.char_wb_ngrams(F.col("post"))).alias("gram")).groupBy("gram").count()
    assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, plain.collect()))
    # The query cuts words of a table that is grouped already.
    from catalog.text_queries import char_wb_ngrams

    plan = char_wb_ngrams(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 2 and plan.count("Generate") >= 2


def test_disclosure_patterns_are_tried_in_one_pass(spark):
    """Each of the 18 patterns was a pass of its own that tested a word border at every character."""
    df = spark.createDataFrame([("",)], "t string")
    text = df.select(fl.is_self_disclosure(F.col("t")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("RLIKE") == 2
    # As each pattern for itself says, in any case and with letters that Java folds to I, K and S.
    draw = random.Random(1)
    words = ["I", "ı", "İ", "i", "MY", "my", "ſtudy", "ſuffer", "I've", "feel", "diagnosed", "was", "have", "been", "not",
             "sure", "if", "Know", "don't", "know", "how", "to", "help", "someone", "me", "asking", "for", "mom", "has", "mind", "xI", "Í",
             "article", "found", "anyone else", "\n", ".", "need", "illness", "just", "_I", "é"]
    rows = [(" ".join(draw.choices(words, k=draw.randint(1, 12))),) for _ in range(3000)]
    rows += [(chr(i) + " feel " + chr(i) + "y life",) for i in range(0x20, 0x2200)] + [(None,), ("",)]
    df = spark.createDataFrame(rows, "t string")
    for patterns in (fv.DISCLOSURE_INCLUDE, fv.DISCLOSURE_EXCLUDE, [r"\bfoo|article", r"\b(not)?\s", r"\bmy [a-z]", r"\bI\b", r"(I|my) mind"]):
        alone = F.lit(False)
        for p in patterns:
            alone = alone | F.col("t").rlike(tx.UNICODE_ANY_CASE + p)
        got = df.select(tx.matches_any(F.col("t"), patterns).alias("a"), alone.alias("b"))
        assert got.filter(~F.col("a").eqNullSafe(F.col("b"))).count() == 0
        assert 10 < got.filter("a").count() < len(rows) - 10
    assert len(tx.any_of([r"\bfoo|article", r"\bmy [a-z]", r"\bI\b", r"\bmy\b"])) == 3


def test_trim_and_masks_as_their_plain_patterns(spark):
    rows = [(f"{chr(i)}{chr(i)} a{chr(i)}b {chr(i)}\n",) for i in range(0xD800)] + [(f"a{chr(i)}uicide {chr(i)}uicide {chr(i)}dd",) for i in range(0x20, 0x2200)] + [(None,), ("",), (" \n",)]
    t = F.col("t")
    plain = rf"{tx.UNICODE_ANY_CASE}{tx.WORD_BORDER}(?:s(?:uicide)|a(?:dd)|i(?:dd)|k(?:dd)){tx.WORD_BORDER}"
    out = spark.createDataFrame(rows, "t string").select(
        tx.strip_text(t).alias("a"), F.regexp_replace(t, r"(?U)^\s+|\s+$", "").alias("b"),
        tx.mask_terms(t, ["suicide", "add", "idd", "kdd"]).alias("c"), F.regexp_replace(t, plain, fv.MASK_TOKEN).alias("d"),
    )
    assert out.filter("not (a <=> b) or not (c <=> d)").count() == 0
    assert out.filter("c <> a").count() > 3
