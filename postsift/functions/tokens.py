"""Tokenisers and n-grams as array Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postsift import fixed_values as fv
from postsift.functions.text import WORD_BORDER


def _split_blank(col: Column) -> Column:
    return F.filter(F.split(col, r"(?U)\s+"), lambda w: w != "")


def lexicon_tokens(col: Column) -> Column:
    """Lower case, ASCII punctuation deleted, split on white space."""
    return _split_blank(F.translate(F.lower(col), fv.ASCII_PUNCTUATION, ""))


def sentiment_tokens(col: Column) -> Column:
    """Lower-case words without outer punctuation; one-character words are left out."""
    bare = F.transform(
        F.split(F.lower(col), r"(?U)\s+"),
        lambda w: F.regexp_replace(w, r"^\p{Punct}+|\p{Punct}+$", ""),
    )
    return F.filter(bare, lambda w: F.length(w) > 1)


def word_tokens(col: Column) -> Column:
    """Words of two or more ASCII letters or square brackets, with Unicode word borders."""
    return F.regexp_extract_all(F.lower(col), F.lit(fv.WORD_TOKEN.replace(r"\b", WORD_BORDER)), F.lit(0))


def word_ngrams(tokens: Column, lowest: int = 1, highest: int = 2) -> Column:
    """All n-grams of `tokens`, joined by one blank; every position may start one."""

    def grams(n: int) -> Column:
        if n == 1:
            return tokens
        shifted = [F.slice(tokens, F.lit(1 + i), F.size(tokens)) for i in range(n)]
        joined = shifted[0]
        for nxt in shifted[1:]:
            # zip_with pads the shorter side with null, and null || x is null.
            joined = F.zip_with(joined, nxt, lambda a, b: F.concat(a, F.lit(" "), b))
        return F.filter(joined, lambda g: g.isNotNull())

    parts = [grams(n) for n in range(lowest, highest + 1)]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def split_words(col: Column) -> Column:
    """Lower-case words between white space, the units that character n-grams stay inside."""
    return _split_blank(F.lower(col))


def padded_char_ngrams(word: Column, lowest: int = 3, highest: int = 5) -> Column:
    """Character n-grams of one word padded with a blank on both sides."""
    padded = F.concat(F.lit(" "), word, F.lit(" "))

    def grams(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(padded) - (n - 1))
        cut = F.transform(starts, lambda i: F.substring(padded, i, F.lit(n)))
        return F.when(F.length(padded) >= n, cut).otherwise(F.array().cast("array<string>"))

    return F.concat(*[grams(n) for n in range(lowest, highest + 1)])


def char_ngram_rows(
    df: DataFrame, word: str, out: str, lowest: int = 3, highest: int = 5
) -> DataFrame:
    """One row per character n-gram of the column `word`, instead of an array of them.

    The n-grams are numbered through all sizes, and each row cuts its own one: plain arithmetic that
    compiles, where the array form runs a lambda per n-gram.
    """
    keep = [c for c in df.columns if c != word]
    padded = df.select(*keep, F.concat(F.lit(" "), word, F.lit(" ")).alias("_padded"))
    sizes = list(range(lowest, highest + 1))
    counts = [F.greatest(F.length("_padded") - (n - 1), F.lit(0)) for n in sizes]
    total = sum(counts[1:], counts[0])
    numbered = padded.filter(total > 0).select(
        *keep, "_padded", F.explode(F.sequence(F.lit(1), total)).alias("_k")
    )
    gram, start = None, F.col("_k")
    for n, count in zip(sizes[:-1], counts):
        mine = (start <= count, F.substring("_padded", start, F.lit(n)))
        gram = F.when(*mine) if gram is None else gram.when(*mine)
        start = start - count
    last = F.substring("_padded", start, F.lit(sizes[-1]))
    return numbered.select(*keep, (last if gram is None else gram.otherwise(last)).alias(out))


def char_wb_ngrams(col: Column, lowest: int = 3, highest: int = 5) -> Column:
    """Character n-grams that do not cross a word border."""
    return F.flatten(
        F.transform(split_words(col), lambda w: padded_char_ngrams(w, lowest, highest))
    )


def char_wb_counts(df: DataFrame, col: str = "post", lowest: int = 3, highest: int = 5) -> DataFrame:
    """(gram, n): how often the table's texts hold each character n-gram.

    N-grams stay inside words, so a word is cut once, however often it occurs: the words are counted first.
    """
    words = df.select(F.explode(split_words(F.col(col))).alias("_word")).groupBy("_word").agg(F.count(F.lit(1)).alias("_n"))
    grams = words.select("_n", F.explode(char_wb_ngrams(F.col("_word"), lowest, highest)).alias("gram"))
    return grams.groupBy("gram").agg(F.sum("_n").alias("n"))
