"""Noise and disclosure filters, and their reports.

A filter nulls the post of a rejected row; `drop_incomplete` removes rows afterwards.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postsift import fixed_values as fv
from postsift.functions import text as tx
from postsift.sources.staging import pin

#: So many hot text hashes at most are broadcast, 24 MB.
MAX_HOT = 1_000_000
NOISE_REASONS = ("deleted", "short", "bot", "moderator", "spam", "duplicated")


def nullify_when(df: DataFrame, pred: Column, cols: Sequence[str]) -> DataFrame:
    """NULL in `cols` where `pred` holds; an unknown predicate counts as false."""
    keep = ~F.coalesce(pred, F.lit(False))
    return df.withColumns({c: F.when(keep, F.col(c)) for c in cols})


# --- single-row predicates ------------------------------------------------------------


def is_deleted(col: Column) -> Column:
    """Blank or a placeholder. One anchored match, so long texts are not copied."""
    texts = "|".join(re.escape(t) for t in fv.DELETED_TEXTS if t)
    return F.coalesce(col.rlike(rf"(?iUd)^\s*+(?:{texts})?\s*+\z"), F.lit(True))


def is_short(col: Column, min_words: int = fv.MIN_WORDS) -> Column:
    """Fewer than `min_words` words; reads no further than the last word needed."""
    if min_words <= 0:
        return F.lit(False)
    enough = col.rlike(rf"(?U)^\s*+(?:\S++\s++){{{min_words - 1}}}\S")
    return ~F.coalesce(enough, F.lit(False))


def is_bot(author: Column) -> Column:
    return F.coalesce(author.rlike(tx.UNICODE_ANY_CASE + fv.BOT_AUTHOR), F.lit(False))


def is_moderator(col: Column) -> Column:
    return F.coalesce(col.rlike(tx.UNICODE_ANY_CASE + fv.MODERATOR_POST), F.lit(False))


def is_spam(col: Column, max_urls: int = fv.MAX_URLS) -> Column:
    """More than `max_urls` URLs. The anchor and the atomic group keep the search linear: each
    round takes the next URL, and nothing is tried again from a later start."""
    urls = rf"(?sU)^(?:(?>.*?(?:https?://|www\.)\S++)){{{max_urls + 1}}}"
    return F.coalesce(col.rlike(urls), F.lit(False))


# --- exact duplicates -----------------------------------------------------------------


def _text_key(col: Column) -> list[Column]:
    """128 bits of the text in two longs: cheap to group on, and the text is not shuffled."""
    text = tx.blank_if_null(col)
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def is_duplicate(
    df: DataFrame,
    col: str = "post",
    flag: str = "is_duplicate",
    key: str = "post_id",
    hot_copies: int = 100_000,
) -> DataFrame:
    """Add `flag`: another row has exactly the same text. Null and blank are one text.

    Copies are counted by text hash with a map-side combine, so a group of any size arrives as one
    row per task. The repeated hashes are written out. Where they fit a broadcast by file size no
    post is shuffled at all. Otherwise hashes with more than `hot_copies` rows are broadcast, if
    there are at most MAX_HOT of them (24 bytes each), and their rows get a random-like join key of
    their own, so that no task receives a whole group of copies.
    """
    counted = (
        df.select(*_text_key(F.col(col)))
        .groupBy("k1", "k2")
        .agg(F.count(F.lit(1)).alias("copies"))
        .filter("copies > 1")
    )
    repeated = pin(counted, "repeated")
    hot = repeated.filter(F.col("copies") > hot_copies).select("k1", "k2", F.lit(True).alias("hot"))
    hot = F.broadcast(hot) if hot.count() <= MAX_HOT else hot
    cold = repeated.filter(F.col("copies") <= hot_copies).select(
        F.col("k1").alias("j1"), F.col("k2").alias("j2"), F.lit(True).alias("cold")
    )
    k1, k2 = _text_key(F.col(col))
    keyed = df.withColumns({"k1": k1, "k2": k2}).join(hot, ["k1", "k2"], "left")
    # A hot row needs no partner any more: it is spread by its own id and finds none.
    j1 = F.when(F.col("hot"), F.xxhash64(key)).otherwise(F.col("k1"))
    j2 = F.when(F.col("hot"), F.lit(None)).otherwise(F.col("k2"))
    return (
        keyed.withColumns({"j1": j1, "j2": j2})
        .join(cold, ["j1", "j2"], "left")
        .withColumn(flag, F.col("hot").isNotNull() | F.col("cold").isNotNull())
        .select(*df.columns, flag)
    )


# --- noise ----------------------------------------------------------------------------


def _with_author(df: DataFrame) -> DataFrame:
    return df if "author" in df.columns else df.withColumn("author", F.lit(None).cast("string"))


def _row_flags(min_words: int, max_urls: int) -> dict[str, Column]:
    post = F.col("post")
    return {
        "deleted": is_deleted(post),
        "short": is_short(post, min_words),
        "bot": is_bot(F.col("author")),
        "moderator": is_moderator(post),
        "spam": is_spam(post, max_urls),
    }


def noise_flags(
    df: DataFrame, min_words: int = fv.MIN_WORDS, max_urls: int = fv.MAX_URLS
) -> DataFrame:
    """One BOOLEAN column per noise reason beside the row."""
    flagged = is_duplicate(df, "post", "duplicated")
    base = _with_author(flagged)
    return base.withColumns(_row_flags(min_words, max_urls)).select(*df.columns, *NOISE_REASONS)


def noise_filter(
    df: DataFrame, min_words: int = fv.MIN_WORDS, max_urls: int = fv.MAX_URLS
) -> DataFrame:
    """NULL the post of every row that shows one of the six reasons; the row count stays."""
    flagged = _with_author(is_duplicate(df, "post", "duplicated"))
    noisy = F.col("duplicated")
    for flag in _row_flags(min_words, max_urls).values():
        noisy = noisy | flag
    return nullify_when(flagged, noisy, ["post"]).select(*df.columns)


def noise_report(
    df: DataFrame, min_words: int = fv.MIN_WORDS, max_urls: int = fv.MAX_URLS
) -> DataFrame:
    """Rows (measure, n, pct): input, each reason (they overlap), total nulled, kept.

    All copies of a text share every text-based flag, so one aggregation by text hash answers the
    report: no join, no post text in the shuffle, and a huge group of copies is combined map-side.
    """
    flags = _row_flags(min_words, max_urls)
    textual = [r for r in flags if r != "bot"]
    groups = (
        _with_author(df)
        .select(
            *_text_key(F.col("post")),
            flags["bot"].cast("long").alias("bot"),
            *[flags[r].alias(r) for r in textual],
        )
        .groupBy("k1", "k2")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("bot").alias("bot"),
            *[F.max(r).alias(r) for r in textual],
        )
    )
    n = F.col("n")
    sums = {"input": F.sum(n), "bot": F.sum("bot"), "duplicated": F.sum(F.when(n > 1, n))}
    sums |= {r: F.sum(F.when(F.col(r), n)) for r in textual}
    any_text = n > 1
    for r in textual:
        any_text = any_text | F.col(r)
    sums["total_null"] = F.sum(F.when(any_text, n).otherwise(F.col("bot")))
    wide = groups.agg(*[F.coalesce(c, F.lit(0)).cast("long").alias(k) for k, c in sums.items()])
    wide = wide.withColumn("kept", F.col("input") - F.col("total_null"))
    order = ("input", *NOISE_REASONS, "total_null", "kept")
    return wide.select(
        F.col("input").alias("total"),
        F.explode(
            F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("n")) for m in order])
        ).alias("r"),
    ).select(
        "r.measure", "r.n", F.round(F.col("r.n") * 100 / F.col("total"), 1).alias("pct")
    )


def compute_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that later filters must not compute again.

    A filter on a plain projected column is pushed below the projection with the expression copied
    into it, so a chain of regexes would run once per mention. A one-element generator stops that.
    """
    return df.select(*df.columns, F.explode(F.array(value)).alias(name))


# --- disclosure -----------------------------------------------------------------------


def is_self_disclosure(col: Column) -> Column:
    """Speaks of the writer's own condition: an include pattern and no exclude pattern."""
    return tx.matches_any(col, fv.DISCLOSURE_INCLUDE) & ~tx.matches_any(
        col, fv.DISCLOSURE_EXCLUDE
    )


def clinical_outcome(cleaned: Column, fp_threshold: float = fv.FIRST_PERSON_THRESHOLD) -> Column:
    """fp_high, pattern or no_pattern; the patterns run only where the rate is too low."""
    return (
        F.when(tx.first_person_rate(cleaned) >= fp_threshold, "fp_high")
        .when(is_self_disclosure(cleaned), "pattern")
        .otherwise("no_pattern")
    )


def clinical_filter(
    df: DataFrame,
    fp_threshold: float = fv.FIRST_PERSON_THRESHOLD,
    contractions=fv.CONTRACTIONS,
    nfc: bool = True,
) -> DataFrame:
    """Add `reason`, `post_cleaned`, `post_masked`; NULL all texts of a rejected row."""
    cleaned = compute_once(df, "post_cleaned", tx.clean_text(F.col("post"), contractions, nfc))
    judged = compute_once(cleaned, "reason", clinical_outcome(F.col("post_cleaned"), fp_threshold))
    kept = nullify_when(judged, F.col("reason") == "no_pattern", ["post", "post_cleaned"])
    return compute_once(kept, "post_masked", tx.mask_terms(F.col("post_cleaned"))).select(
        *df.columns, "reason", "post_cleaned", "post_masked"
    )


def clinical_report(filtered: DataFrame) -> DataFrame:
    """Rows per outcome and their share in percent."""
    counts = filtered.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # over the three outcome rows only
    return counts.select("reason", "n", F.round(F.col("n") * 100 / total, 1).alias("pct"))


def drop_incomplete(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(cols))


def scorable(df: DataFrame, min_words: int = fv.SCORABLE_WORDS, col: str = "post") -> DataFrame:
    """Texts with enough words to be scored."""
    return df.filter(~is_short(F.col(col), min_words))


def high_risk(df: DataFrame) -> DataFrame:
    """Predictions that need a notice."""
    return df.filter(F.col("risk_level").isin(*fv.NOTICE_LEVELS))
