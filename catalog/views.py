"""Input views over the supplied tables, the same text for Spark SQL and for the oracle.

The supplied prose is invented and has no first-person sentences, links or forum names, so `POSTS`
derives a forum from `source` and puts a sentence in front of most texts. Every document gives one
post with its whole text; posts without text or with a placeholder come on top, under negative keys.
The choice hangs mostly on `n_chars`, so exact copies mostly stay exact copies.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from postsift import fixed_values as fv
from postsift.operators.lexicon import Lexicons
from postsift.sources.readers import emotion_table, spread
from postsift.sources.staging import pin

POSTS = """
SELECT post_id, lang,
  CASE source
    WHEN 'src0' THEN 'EDAnonymous' WHEN 'src1' THEN 'addiction' WHEN 'src2' THEN 'adhd'
    WHEN 'src3' THEN 'alcoholism' WHEN 'src4' THEN 'anxiety' WHEN 'src5' THEN 'autism'
    WHEN 'src6' THEN 'bipolarreddit' WHEN 'src7' THEN 'bpd' WHEN 'src8' THEN 'depression'
    WHEN 'src9' THEN 'healthanxiety' WHEN 'src10' THEN 'lonely' WHEN 'src11' THEN 'socialanxiety'
    WHEN 'src12' THEN 'suicidewatch' WHEN 'src13' THEN 'ptsd' WHEN 'src14' THEN 'schizophrenia'
    WHEN 'src15' THEN 'non-mental' WHEN 'src16' THEN 'jokes' WHEN 'src17' THEN 'depression'
    WHEN 'src18' THEN 'depression' ELSE NULL END AS subreddit,
  CASE WHEN doc_id % 53 = 0 THEN NULL WHEN doc_id % 37 = 0 THEN 'AutoModerator'
       WHEN doc_id % 41 = 0 THEN 'helper_bot' ELSE concat('user_', source) END AS author,
  CASE WHEN kind = 1 THEN NULL
       WHEN kind = 2 THEN '[removed]'
       WHEN kind = 3 THEN '  [Deleted] '
       WHEN doc_id % 43 = 0 THEN concat('Weekly check-in thread. ', text)
       WHEN doc_id % 47 = 0 THEN concat(text, ' http://x.y/1 www.z.com/2 https://q.r/3')
       WHEN n_chars % 10 = 0 THEN concat('I am 25. My anxiety and I feel worse for me. Bipolar disorder, they say, is mine alone. ', text)
       WHEN n_chars % 10 = 1 THEN concat('I feel hopeless, my anxiety is very bad. I cannot sleep! ', text)
       WHEN n_chars % 10 = 2 THEN concat('I feel tired. My mom has been diagnosed with bipolar disorder. ', text)
       WHEN n_chars % 10 = 3 THEN concat('How to help a friend with ADD? See https://a.b/c and @bob #tag 3.5 or 1,000,000. ', text)
       WHEN n_chars % 10 = 4 THEN concat('Does anyone else struggle. I was 25 and got diagnosed. PTSD and social anxiety. ', text)
       WHEN n_chars % 10 = 5 THEN concat('A study found that me and mine suffer. ', text)
       WHEN n_chars % 10 = 6 THEN concat('I can', chr(39), 't sleep, I', chr(39), 've been tired, it', chr(39), 's late, but we won’t go to the café! ', text)
       WHEN n_chars % 10 = 7 THEN concat('I know me and my mind as mine, I am here. ', text)
       ELSE text END AS post
FROM (
  SELECT doc_id AS post_id, doc_id, lang, source, n_chars, text, 0 AS kind FROM documents
  UNION ALL SELECT -4 * doc_id - 1 AS post_id, doc_id, lang, source, n_chars, text, 1 AS kind FROM documents WHERE doc_id % 59 = 0
  UNION ALL SELECT -4 * doc_id - 2 AS post_id, doc_id, lang, source, n_chars, text, 2 AS kind FROM documents WHERE doc_id % 29 = 0
  UNION ALL SELECT -4 * doc_id - 3 AS post_id, doc_id, lang, source, n_chars, text, 3 AS kind FROM documents WHERE doc_id % 31 = 0
) AS d
"""

VOCAB = """
SELECT DISTINCT word FROM (
  SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents) AS t
"""

# Lexicon membership and values come from md5 digits of the word: both engines agree, and no
# licensed word list is needed.
EMOTION_LONG = (
    "SELECT word, CASE "
    + " ".join(
        f"WHEN substr(md5(word), 1, 1) = '{d:x}' THEN '{fv.EMOTIONS[d % len(fv.EMOTIONS)]}'"
        for d in range(16)
    )
    + """ END AS emotion,
  CASE WHEN substr(md5(word), 2, 1) < '8' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS val
FROM vocab WHERE substr(md5(word), 6, 1) < '8'
"""
)
VAD_ROWS = """
SELECT word,
  CAST(ascii(substr(md5(word), 3, 1)) AS DOUBLE) / CAST(127 AS DOUBLE) AS valence,
  CAST(ascii(substr(md5(word), 4, 1)) AS DOUBLE) / CAST(127 AS DOUBLE) AS arousal,
  CAST(ascii(substr(md5(word), 5, 1)) AS DOUBLE) / CAST(127 AS DOUBLE) AS dominance
FROM vocab WHERE substr(md5(word), 7, 1) < '8'
"""
# Two categories per word, so that the join is many-to-many.


def _category_case(first: int) -> str:
    digit = f"ascii(substr(md5(word), {first}, 1)) * 16 + ascii(substr(md5(word), {first + 1}, 1))"
    cases = " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(fv.CATEGORIES))
    return f"CASE ({digit}) % {len(fv.CATEGORIES)} {cases} END"


CATEGORY_ROWS = f"""
SELECT DISTINCT word, category FROM (
  SELECT word, {_category_case(8)} AS category FROM vocab WHERE substr(md5(word), 10, 1) < 'a'
  UNION ALL
  SELECT word, {_category_case(11)} AS category FROM vocab WHERE substr(md5(word), 13, 1) < '4') AS t
"""
TAG_ROWS = (
    "SELECT word, CASE "
    + " ".join(
        f"WHEN substr(md5(word), 14, 1) = '{d:x}' THEN '{fv.POS_TAGS[d % len(fv.POS_TAGS)]}'"
        for d in range(14)
    )
    + " ELSE 'X' END AS tag FROM vocab"
)
SENTIMENT_ROWS = """
SELECT word, (CAST(ascii(substr(md5(word), 15, 1)) AS DOUBLE) - CAST(75 AS DOUBLE)) / CAST(10 AS DOUBLE) AS valence
FROM vocab WHERE substr(md5(word), 16, 1) < '3'
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(
        POSTS.replace("FROM documents", "FROM {documents}"),
        documents=documents(spark, sf_dir),
    )


def vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(
        "SELECT DISTINCT word FROM (SELECT explode(regexp_extract_all(lower(text), '[a-z]+', 0)) "
        "AS word FROM {documents})",
        documents=documents(spark, sf_dir),
    )


_LEXICONS: dict[tuple[str, str], Lexicons] = {}


def _rows(spark: SparkSession, sql: str, words: DataFrame) -> DataFrame:
    return spark.sql(sql.replace("FROM vocab", "FROM {vocab}"), vocab=words)


def emotion_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, EMOTION_LONG, vocab(spark, sf_dir))


def vad_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, VAD_ROWS, vocab(spark, sf_dir))


def lexicons(spark: SparkSession, sf_dir: str) -> Lexicons:
    """The lexicon tables, written once per session as a real lexicon would lie in files."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _LEXICONS:
        words = pin(vocab(spark, sf_dir), "vocab")
        _LEXICONS[key] = Lexicons(
            emotion=pin(emotion_table(_rows(spark, EMOTION_LONG, words)), "emotion"),
            vad=pin(_rows(spark, VAD_ROWS, words), "vad"),
            category=pin(_rows(spark, CATEGORY_ROWS, words), "category"),
            tag=pin(_rows(spark, TAG_ROWS, words), "tag"),
            sentiment=pin(_rows(spark, SENTIMENT_ROWS, words), "sentiment"),
        )
    return _LEXICONS[key]


# --- common table expressions of the oracle ---------------------------------------------
CTE = {
    "posts": POSTS,
    "vocab": VOCAB,
    "emotion_long": EMOTION_LONG,
    "emotion_lex": "SELECT word, "
    + ", ".join(
        f"coalesce(avg(val) FILTER (emotion = '{e}'), 0) AS {e}" for e in fv.EMOTIONS
    )
    + " FROM emotion_long GROUP BY word",
    "vad_lex": VAD_ROWS,
    "category_lex": CATEGORY_ROWS,
    "tag_lex": TAG_ROWS,
    "sentiment_lex": SENTIMENT_ROWS,
}
NEEDS = {
    "emotion_long": ("vocab",),
    "emotion_lex": ("emotion_long",),
    "vad_lex": ("vocab",),
    "category_lex": ("vocab",),
    "tag_lex": ("vocab",),
    "sentiment_lex": ("vocab",),
}


def with_cte(names: str, body: str, **more: str) -> str:
    """`body` behind a WITH of the named views, their needs, and further named queries."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, ()):
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        add(name)
    parts = [f"{n} AS MATERIALIZED ({CTE[n].strip()})" for n in ordered]
    parts += [f"{n} AS ({q.strip()})" for n, q in more.items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body.strip()
