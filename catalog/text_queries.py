"""Queries for text functions, tokenisers, filters and their reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.views import posts, with_cte
from postsift import fixed_values as fv
from postsift.functions import text as tx
from postsift.functions import tokens as tk
from postsift.operators import filters as fl

# --- oracle building blocks (RE2: \w, \d, \b are ASCII there) ---------------------------
WORD = r"[\p{L}\p{N}_]"
SPACE = r"[\s\p{Z}]"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip_sql(c: str) -> str:
    return rf"regexp_replace({c}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def urls_sql(c: str) -> str:
    return rf"regexp_replace({c}, {lit(fv.URL)}, '', 'g')"


def handles_sql(c: str) -> str:
    return rf"regexp_replace({c}, '@{WORD}+|#{WORD}+', '', 'g')"


def numbers_sql(c: str) -> str:
    return rf"regexp_replace({c}, '\p{{Nd}}+[.,]?\p{{Nd}}*', '[NUM]', 'g')"


def contractions_sql(c: str) -> str:
    for pattern, replacement in fv.CONTRACTIONS:
        to = replacement.replace("$1", r"\1")
        c = f"regexp_replace({c}, {lit('(?i)' + pattern)}, {lit(to)}, 'g')"
    return c


def clean_sql(c: str) -> str:
    text = f"nfc_normalize(coalesce({c}, ''))"
    return strip_sql(contractions_sql(numbers_sql(handles_sql(urls_sql(text)))))


def mask_sql(c: str) -> str:
    terms = "|".join(fv.MASKED_TERMS)
    return f"regexp_replace({c}, {lit(rf'(?i)\b({terms})\b')}, '[MH]', 'g')"


def words_sql(c: str) -> str:
    return rf"len(regexp_extract_all(coalesce({c}, ''), '[^\s\p{{Z}}]+'))"


def rate_sql(c: str) -> str:
    pronouns = ", ".join(lit(p) for p in fv.FIRST_PERSON)
    return rf"""(CAST(len(list_filter(regexp_split_to_array(lower({c}), '[\s\p{{Z}}.!?]+'),
      lambda w: w IN ({pronouns}))) AS DOUBLE) / greatest(1, len(list_filter(
      regexp_split_to_array({c}, '[.!?\n]+'), lambda s: {strip_sql('s')} <> ''))))"""


def any_sql(c: str, patterns) -> str:
    return "(" + " OR ".join(
        f"regexp_matches({c}, {lit('(?i)' + p)})" for p in patterns
    ) + ")"


def disclosure_sql(c: str) -> str:
    return f"({any_sql(c, fv.DISCLOSURE_INCLUDE)} AND NOT {any_sql(c, fv.DISCLOSURE_EXCLUDE)})"


DELETED = f"lower({strip_sql('p')}) IN ('[removed]', '[deleted]', '', 'nan')"
SHORT = f"{words_sql('p')} < {fv.MIN_WORDS}"
BOT = f"regexp_matches(lower(coalesce(author, '')), {lit(fv.BOT_AUTHOR)})"
MODERATOR = f"regexp_matches(lower(p), {lit(fv.MODERATOR_POST)})"
SPAM = f"len(regexp_extract_all(p, {lit(fv.URL)})) > {fv.MAX_URLS}"
DUPLICATED = "count(*) OVER (PARTITION BY p) > 1"
FLAGGED = f"""
SELECT *, {DELETED} AS deleted, {SHORT} AS short, {BOT} AS bot, {MODERATOR} AS moderator,
  {SPAM} AS spam, {DUPLICATED} AS duplicated
FROM (SELECT *, coalesce(post, '') AS p FROM posts) AS t
"""
ANY_NOISE = "deleted OR short OR bot OR moderator OR spam OR duplicated"
NOISE_FREE = f"""
SELECT post_id, subreddit, author, lang, CASE WHEN NOT ({ANY_NOISE}) THEN post END AS post
FROM flagged
"""
CLINICAL = f"""
SELECT *, CASE WHEN rate >= 0.35 THEN 'fp_high' WHEN {disclosure_sql('cleaned')} THEN 'pattern'
  ELSE 'no_pattern' END AS reason
FROM (SELECT *, {rate_sql('cleaned')} AS rate
      FROM (SELECT *, {clean_sql('post')} AS cleaned FROM noise_free) AS t) AS t
"""
CLINICAL_OUT = f"""
SELECT post_id, subreddit, lang, reason,
  CASE WHEN reason <> 'no_pattern' THEN post END AS post,
  CASE WHEN reason <> 'no_pattern' THEN cleaned END AS post_cleaned,
  CASE WHEN reason <> 'no_pattern' THEN {mask_sql('cleaned')} END AS post_masked
FROM clinical
"""
SCREENED = dict(flagged=FLAGGED, noise_free=NOISE_FREE, clinical=CLINICAL)


# --- projections ------------------------------------------------------------------------


def _projection(name: str, fn, sql: str, out: str = "value") -> None:
    """A query that applies one Column function to every post."""

    def run(spark, sf_dir):
        return posts(spark, sf_dir).select("post_id", fn(F.col("post")).alias(out))

    query(name, with_cte("posts", f"SELECT post_id, {sql} AS {out} FROM posts"))(run)


_projection("blank_if_null", tx.blank_if_null, "coalesce(post, '')")
_projection("normalize_nfc", tx.normalize_nfc, "nfc_normalize(post)")
_projection("strip_urls", tx.strip_urls, urls_sql("post"))
_projection("strip_handles", tx.strip_handles, handles_sql("post"))
_projection("mask_numbers", tx.mask_numbers, numbers_sql("post"))
_projection("expand_contractions", tx.expand_contractions, contractions_sql("post"))
_projection("clean_text", tx.clean_text, clean_sql("post"))
_projection("mask_terms", tx.mask_terms, mask_sql("post"))
_projection(
    "first_person_rate",
    lambda c: F.round(tx.first_person_rate(c), 6),
    f"coalesce(round({rate_sql('post')}, 6), 0.0)",
)
_projection(
    "word_count", lambda c: tx.word_count(c).cast("long"), f"CAST({words_sql('post')} AS BIGINT)"
)
_projection("lower_text", tx.lower_text, "lower(post)")
_projection(
    "lexicon_tokens",
    lambda c: F.array_join(tk.lexicon_tokens(c), "|"),
    f"""array_to_string(list_filter(regexp_split_to_array(
      translate(lower(post), {lit(fv.ASCII_PUNCTUATION)}, ''), '{SPACE}+'), lambda w: w <> ''), '|')""",
)
# Non-ASCII word characters become a digit: a word character that no token may hold.
WORD_TOKENS = r"""regexp_extract_all(regexp_replace(
  regexp_replace(lower(post), '[^\x00-\x7F\p{L}\p{N}]', ' ', 'g'), '[^\x00-\x7F]', '0', 'g'), '\b[a-zA-Z\[\]][a-zA-Z\[\]]+\b')"""
_projection(
    "word_tokens", lambda c: F.array_join(tk.word_tokens(c), "|"),
    f"array_to_string({WORD_TOKENS}, '|')",
)


@query(
    "word_ngrams",
    with_cte(
        "posts",
        """
SELECT post_id, CASE WHEN tokens IS NOT NULL THEN array_to_string(list_concat(tokens, list_transform(
  range(1, greatest(len(tokens), 1)), lambda i: tokens[i] || ' ' || tokens[i + 1])), '|') END AS value
FROM tokenised""",
        tokenised=f"SELECT post_id, {WORD_TOKENS} AS tokens FROM posts",
    ),
)
def word_ngrams(spark, sf_dir):
    grams = tk.word_ngrams(tk.word_tokens(F.col("post")), 1, 2)
    return posts(spark, sf_dir).select("post_id", F.array_join(grams, "|").alias("value"))


@query(
    "remap_label",
    with_cte(
        "posts",
        "SELECT post_id, CASE subreddit "
        + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in fv.LABELS.items())
        + " ELSE subreddit END AS label, CASE subreddit "
        + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in fv.LABELS.items())
        + " WHEN NULL THEN NULL ELSE CASE WHEN subreddit IS NULL THEN NULL ELSE 'non-mental' END"
        " END AS merged FROM posts",
    ),
)
def remap_label(spark, sf_dir):
    c = F.col("subreddit")
    return posts(spark, sf_dir).select(
        "post_id",
        tx.remap_label(c, fv.LABELS).alias("label"),
        tx.remap_label(c, fv.LABELS, fv.OTHER_LABEL).alias("merged"),
    )


@query(
    "char_wb_ngrams",
    with_cte(
        "posts",
        """
SELECT gram, count(*) AS n FROM (
  SELECT unnest(list_transform(range(1, len(w) + 2 - k + 1),
    lambda i: substr(w2, CAST(i AS BIGINT), k))) AS gram
  FROM (SELECT w, ' ' || w || ' ' AS w2 FROM words WHERE w <> '') AS t, (VALUES (3), (4), (5)) AS s(k)
) AS g GROUP BY gram
""".replace("len(w) + 2 - k + 1", "length(w2) - k + 2"),
        words=rf"SELECT unnest(regexp_split_to_array(lower(post), '{SPACE}+')) AS w FROM posts",
    ),
)
def char_wb_ngrams(spark, sf_dir):
    return tk.char_wb_counts(posts(spark, sf_dir))


@query(
    "nullify_when",
    with_cte("posts", "SELECT post_id, CASE WHEN lang = 'en' THEN NULL ELSE post END AS post, "
             "CASE WHEN lang = 'en' THEN NULL ELSE author END AS author FROM posts"),
)
def nullify_when(spark, sf_dir):
    df = posts(spark, sf_dir).select("post_id", "post", "author", "lang")
    return fl.nullify_when(df, F.col("lang") == "en", ["post", "author"]).drop("lang")


# --- predicates -------------------------------------------------------------------------


def _flag(name: str, fn, sql: str) -> None:
    def run(spark, sf_dir):
        return posts(spark, sf_dir).select("post_id", fn().alias("flag"))

    body = f"SELECT post_id, {sql} AS flag FROM (SELECT *, coalesce(post, '') AS p FROM posts) AS t"
    query(name, with_cte("posts", body))(run)


_flag("is_deleted", lambda: fl.is_deleted(F.col("post")), DELETED)
_flag("is_short", lambda: fl.is_short(F.col("post")), SHORT)
_flag("is_bot", lambda: fl.is_bot(F.col("author")), BOT)
_flag("is_moderator", lambda: fl.is_moderator(F.col("post")), MODERATOR)
_flag("is_spam", lambda: fl.is_spam(F.col("post")), SPAM)
_flag(
    "is_self_disclosure",
    lambda: F.coalesce(fl.is_self_disclosure(F.col("post")), F.lit(False)),
    disclosure_sql("p"),
)


@query(
    "is_duplicate",
    with_cte("posts", f"SELECT post_id, {DUPLICATED} AS is_duplicate "
             "FROM (SELECT *, coalesce(post, '') AS p FROM posts) AS t"),
)
def is_duplicate(spark, sf_dir):
    return fl.is_duplicate(posts(spark, sf_dir)).select("post_id", "is_duplicate")


# --- filters and reports ----------------------------------------------------------------


@query("noise_filter", with_cte("posts", "SELECT post_id, subreddit, author, post FROM noise_free",
                                flagged=FLAGGED, noise_free=NOISE_FREE))
def noise_filter(spark, sf_dir):
    return fl.noise_filter(posts(spark, sf_dir)).select("post_id", "subreddit", "author", "post")


@query(
    "noise_flags",
    with_cte("posts", "SELECT post_id, deleted, short, bot, moderator, spam, duplicated "
             "FROM flagged", flagged=FLAGGED),
)
def noise_flags(spark, sf_dir):
    return fl.noise_flags(posts(spark, sf_dir)).select("post_id", *fl.NOISE_REASONS)


_MEASURES = {
    "input": "count(*)",
    **{r: f"count(*) FILTER ({r})" for r in fl.NOISE_REASONS},
    "total_null": f"count(*) FILTER ({ANY_NOISE})",
    "kept": f"count(*) FILTER (NOT ({ANY_NOISE}))",
}


@query(
    "noise_report",
    with_cte(
        "posts",
        " UNION ALL ".join(
            f"SELECT '{m}' AS measure, {e} AS n, round({e} * 100.0 / count(*), 1) AS pct FROM flagged"
            for m, e in _MEASURES.items()
        ),
        flagged=FLAGGED,
    ),
)
def noise_report(spark, sf_dir):
    return fl.noise_report(posts(spark, sf_dir))


def screened(spark, sf_dir):
    """Posts after both filters, rejected rows still in."""
    return fl.clinical_filter(fl.noise_filter(posts(spark, sf_dir)))


@query(
    "clinical_filter",
    with_cte("posts", "SELECT post_id, reason, post, post_cleaned, post_masked FROM clinical_out",
             **SCREENED, clinical_out=CLINICAL_OUT),
)
def clinical_filter(spark, sf_dir):
    return screened(spark, sf_dir).select(
        "post_id", "reason", "post", "post_cleaned", "post_masked"
    )


@query(
    "clinical_report",
    with_cte("posts", "SELECT reason, count(*) AS n, "
             "round(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS pct FROM clinical GROUP BY reason",
             **SCREENED),
)
def clinical_report(spark, sf_dir):
    return fl.clinical_report(screened(spark, sf_dir))


@query(
    "drop_incomplete",
    with_cte("posts", "SELECT post_id, subreddit, post_cleaned FROM clinical_out "
             "WHERE post_cleaned IS NOT NULL AND post_masked IS NOT NULL AND subreddit IS NOT NULL",
             **SCREENED, clinical_out=CLINICAL_OUT),
)
def drop_incomplete(spark, sf_dir):
    return fl.drop_incomplete(
        screened(spark, sf_dir), ["post_cleaned", "post_masked", "subreddit"]
    ).select("post_id", "subreddit", "post_cleaned")


@query(
    "scorable",
    f"SELECT conv_id, turn, text FROM conversations WHERE {words_sql('text')} >= 3",
)
def scorable(spark, sf_dir):
    from catalog.views import table

    return fl.scorable(table(spark, sf_dir, "conversations"), col="text").select(
        "conv_id", "turn", "text"
    )
