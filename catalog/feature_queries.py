"""Queries for lexicon tables, lexicon features, term vectors and scaling."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.text_queries import SPACE, WORD_TOKENS, lit
from catalog.views import (
    documents,
    emotion_rows,
    lexicons,
    posts,
    table,
    vad_rows,
    with_cte,
)
from postsift import fixed_values as fv
from postsift.operators import lexicon as lx
from postsift.operators import vectorize as vz
from postsift.sources import readers as rd
from postsift.sources.staging import pin, shared_dir

TOKENS = f"""
SELECT post_id, unnest(list_filter(regexp_split_to_array(
  translate(lower(post), {lit(fv.ASCII_PUNCTUATION)}, ''), '{SPACE}+'), lambda w: w <> '')) AS word
FROM posts
"""


def _round(df, *cols, digits=6):
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in cols})


# --- lexicon tables ---------------------------------------------------------------------


@query("read_emotion_lexicon", with_cte("emotion_lex", "SELECT * FROM emotion_lex"))
def read_emotion_lexicon(spark, sf_dir):
    return rd.emotion_table(emotion_rows(spark, sf_dir))


@query("read_vad_lexicon", with_cte("vad_lex", "SELECT * FROM vad_lex"))
def read_vad_lexicon(spark, sf_dir):
    """Each word stands in two files with other values; the file that comes last by name counts."""
    root = f"{shared_dir(spark)}/postsift-out/vad-twice-{uuid.uuid4().hex}"
    rows = vad_rows(spark, sf_dir).select("word", "valence", "arousal", "dominance")
    other = rows.select("word", *[(1 - F.col(c)).alias(c) for c in fv.VAD])
    other.write.csv(f"{root}/first", sep="\t")
    rows.write.csv(f"{root}/second", sep="\t")
    return rd.read_vad_lexicon(spark, f"{root}/*")


# --- token joins ------------------------------------------------------------------------


@query(
    "lexicon_join",
    with_cte(
        "posts vad_lex",
        "SELECT post_id, count(*) AS rows, count(word) AS tokens, round(sum(coalesce(valence, 0)), 4) AS valence, "
        "round(sum(coalesce(arousal, 0)), 4) AS arousal, round(sum(coalesce(dominance, 0)), 4) AS dominance "
        "FROM (SELECT post_id, word FROM tokens UNION ALL SELECT post_id, NULL FROM posts "
        "WHERE post_id NOT IN (SELECT post_id FROM tokens)) AS t LEFT JOIN vad_lex USING (word) GROUP BY post_id",
        tokens=TOKENS,
    ),
)
def lexicon_join(spark, sf_dir):
    tokens = lx.explode_tokens(posts(spark, sf_dir))
    joined = lx.lexicon_join(tokens, lexicons(spark, sf_dir).vad)
    return joined.groupBy("post_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count("word").alias("tokens"),
        *[F.round(F.sum(v), 4).alias(v) for v in fv.VAD],
    )


@query(
    "category_join",
    with_cte("posts category_lex", "SELECT post_id, category, count(*) AS n FROM tokens "
             "JOIN category_lex USING (word) GROUP BY 1, 2", tokens=TOKENS),
)
def category_join(spark, sf_dir):
    tokens = lx.explode_tokens(posts(spark, sf_dir))
    joined = lx.category_join(tokens, lexicons(spark, sf_dir).category)
    return joined.groupBy("post_id", "category").agg(F.count(F.lit(1)).alias("n"))


# --- features ---------------------------------------------------------------------------
ALL_TOKENS = """
SELECT post_id, word FROM tokens UNION ALL
SELECT post_id, NULL AS word FROM posts WHERE post_id NOT IN (SELECT post_id FROM tokens)
"""


def _aggregate_sql(columns: dict[str, str], lex: str) -> str:
    picks = ", ".join(f"round({e}, 6) + 0.0 AS {n}" for n, e in columns.items())
    return f"SELECT post_id, {picks} FROM all_tokens LEFT JOIN {lex} USING (word) GROUP BY post_id"


EMOTION_SQL = {
    n: f"stddev_pop(coalesce({e}, 0))" for e, n in zip(fv.EMOTIONS, lx.emotion_names())
}
_HOW = {"mean": "avg", "max": "max", "std": "stddev_pop"}
VAD_SQL = {
    f"nrc_vad_{v}_{s}": f"{_HOW[s]}(coalesce({v}, 0))" for s in fv.VAD_STATISTICS for v in fv.VAD
}


def _group_sql(lex: str, column: str, values, names) -> str:
    picks = ", ".join(
        f"round(count(*) FILTER ({column} = '{v}') / CAST(greatest(any_value(n), 1) AS DOUBLE), 6) AS {name}"
        for v, name in zip(values, names)
    )
    return f"""
SELECT post_id, {picks} FROM all_tokens LEFT JOIN {lex} USING (word)
JOIN (SELECT post_id, count(word) AS n FROM all_tokens GROUP BY post_id) AS sizes USING (post_id)
GROUP BY post_id"""


CATEGORY_SQL = _group_sql("category_lex", "category", fv.CATEGORIES, lx.category_names())
TAG_SQL = _group_sql("tag_lex", "tag", fv.POS_TAGS, lx.pos_names())


@query(
    "emotion_features",
    with_cte("posts emotion_lex", _aggregate_sql(EMOTION_SQL, "emotion_lex"),
             tokens=TOKENS, all_tokens=ALL_TOKENS),
)
def emotion_features(spark, sf_dir):
    out = lx.emotion_features(posts(spark, sf_dir), lexicons(spark, sf_dir).emotion)
    return _round(out, *lx.emotion_names())


@query(
    "vad_features",
    with_cte("posts vad_lex", _aggregate_sql(VAD_SQL, "vad_lex"),
             tokens=TOKENS, all_tokens=ALL_TOKENS),
)
def vad_features(spark, sf_dir):
    out = lx.vad_features(posts(spark, sf_dir), lexicons(spark, sf_dir).vad)
    return _round(out, *lx.vad_names())


@query(
    "category_features",
    with_cte("posts category_lex", CATEGORY_SQL, tokens=TOKENS, all_tokens=ALL_TOKENS),
)
def category_features(spark, sf_dir):
    out = lx.category_features(posts(spark, sf_dir), lexicons(spark, sf_dir).category)
    return _round(out, *lx.category_names())


@query(
    "pos_ratio_features", with_cte("posts tag_lex", TAG_SQL, tokens=TOKENS, all_tokens=ALL_TOKENS)
)
def pos_ratio_features(spark, sf_dir):
    out = lx.pos_ratio_features(posts(spark, sf_dir), lexicons(spark, sf_dir).tag)
    return _round(out, *lx.pos_names())


def _in(c: str, words) -> str:
    return f"{c} IN ({', '.join(lit(w) for w in words)})"


def _step(i: int, damping: float, before: str) -> str:
    boost = (
        f"(CASE WHEN {_in(f'w{i}', fv.BOOSTERS_UP)} THEN CAST(0.293 AS DOUBLE) "
        f"WHEN {_in(f'w{i}', fv.BOOSTERS_DOWN)} THEN CAST(-0.293 AS DOUBLE) ELSE 0 END)"
    )
    return (
        f"CASE WHEN w{i} IS NOT NULL AND NOT k{i} THEN ({before} + {boost} * CAST({damping} AS DOUBLE) * "
        f"(CASE WHEN valence < 0 THEN -1 ELSE 1 END)) * (CASE WHEN {_in(f'w{i}', fv.NEGATIONS)} "
        f"THEN CAST(-0.74 AS DOUBLE) ELSE 1 END) ELSE {before} END"
    )


SENTIMENT = dict(
    spoken=rf"""
SELECT post_id, post, list_filter(list_transform(regexp_split_to_array(lower(post), '{SPACE}+'),
  lambda w: regexp_replace(w, '^[[:punct:]]+|[[:punct:]]+$', '', 'g')), lambda w: length(w) > 1) AS ws
FROM posts""",
    placed="""
SELECT post_id, post, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos,
  list_position(ws, 'but') AS but FROM spoken""",
    known="""
SELECT *, lag(word, 1) OVER o AS w1, lag(word, 2) OVER o AS w2, lag(word, 3) OVER o AS w3,
  lag(hit, 1) OVER o AS k1, lag(hit, 2) OVER o AS k2, lag(hit, 3) OVER o AS k3
FROM (SELECT p.*, valence, valence IS NOT NULL AS hit FROM placed p LEFT JOIN sentiment_lex USING (word)) AS t
WINDOW o AS (PARTITION BY post_id ORDER BY pos)""",
    scored1=f"SELECT *, {_step(1, 1.0, 'valence')} AS s1 FROM known WHERE hit",
    scored2=f"SELECT *, {_step(2, 0.95, 's1')} AS s2 FROM scored1",
    scored3=f"SELECT *, {_step(3, 0.9, 's2')} AS s3 FROM scored2",
    summed="""
SELECT post_id, any_value(post) AS post, sum(s3 * (CASE WHEN but IS NULL THEN 1 WHEN pos < but THEN CAST(0.5 AS DOUBLE)
  WHEN pos > but THEN CAST(1.5 AS DOUBLE) ELSE 1 END)) AS s FROM scored3 GROUP BY post_id""",
    emphasised=r"""
SELECT post_id, s + sign(s) * (least(len(regexp_extract_all(post, '!')), 4) * CAST(0.292 AS DOUBLE) +
  (CASE WHEN q <= 1 THEN 0 WHEN q <= 3 THEN q * CAST(0.18 AS DOUBLE) ELSE CAST(0.96 AS DOUBLE) END)) AS s
FROM (SELECT *, len(regexp_extract_all(post, '\?')) AS q FROM summed) AS t""",
    compound="""
SELECT p.post_id, coalesce(s / sqrt(s * s + 15), 0.0) AS sentiment_compound
FROM posts p LEFT JOIN emphasised USING (post_id)""",
)


@query(
    "sentiment_compound",
    with_cte("posts sentiment_lex",
             "SELECT post_id, round(sentiment_compound, 6) + 0.0 AS sentiment_compound FROM compound",
             **SENTIMENT),
)
def sentiment_compound(spark, sf_dir):
    out = lx.sentiment_compound(posts(spark, sf_dir), lexicons(spark, sf_dir).sentiment)
    return _round(out, "sentiment_compound")


@query(
    "psych_features",
    with_cte(
        "posts emotion_lex vad_lex category_lex tag_lex sentiment_lex",
        """
SELECT t.*, c.* EXCLUDE (post_id), e.* EXCLUDE (post_id), v.* EXCLUDE (post_id),
  round(s.sentiment_compound, 6) + 0.0 AS sentiment_compound
FROM tags t JOIN cats c USING (post_id) JOIN emos e USING (post_id) JOIN vads v USING (post_id)
JOIN compound s USING (post_id)""",
        tokens=TOKENS, all_tokens=ALL_TOKENS, tags=TAG_SQL, cats=CATEGORY_SQL,
        emos=_aggregate_sql(EMOTION_SQL, "emotion_lex"), vads=_aggregate_sql(VAD_SQL, "vad_lex"),
        **SENTIMENT,
    ),
)
def psych_features(spark, sf_dir):
    out = lx.psych_features(posts(spark, sf_dir), lexicons(spark, sf_dir))
    return _round(out, *lx.psych_names())


@query(
    "standard_scale",
    with_cte(
        "posts vad_lex",
        "SELECT post_id, " + ", ".join(
            f"round(coalesce(({c} - avg({c}) OVER ()) / nullif(stddev_pop({c}) OVER (), 0), 0), 4) + 0.0 AS {c}"
            for c in lx.vad_names()
        ) + " FROM feats",
        tokens=TOKENS, all_tokens=ALL_TOKENS,
        feats=_aggregate_sql(VAD_SQL, "vad_lex"),
    ),
)
def standard_scale(spark, sf_dir):
    feats = pin(vad_features(spark, sf_dir), "vad_features")
    return _round(vz.standard_scale(feats, lx.vad_names()), *lx.vad_names(), digits=4)


# --- term vectors -----------------------------------------------------------------------
K = 60_000  # vocabulary, as in the training plans
BEST = 24_000
ALL_DOCS = "SELECT doc_id AS post_id, text AS post FROM documents"
LABELLED_DOCS = """
SELECT doc_id AS post_id, text AS post, quality FROM documents JOIN labels USING (doc_id)
"""
WORD_TF = f"""
SELECT post_id, term, count(*) AS tf FROM (
  SELECT post_id, unnest(list_concat(tokens, list_transform(
    range(1, greatest(len(tokens), 1)), lambda i: tokens[i] || ' ' || tokens[i + 1]))) AS term
  FROM (SELECT post_id, {WORD_TOKENS} AS tokens FROM docs) AS t) AS g GROUP BY 1, 2
"""
CHAR_TF = rf"""
SELECT post_id, term, count(*) AS tf FROM (
  SELECT post_id, unnest(list_transform(range(1, length(w2) - k + 2),
    lambda i: substr(w2, CAST(i AS BIGINT), k))) AS term
  FROM (SELECT post_id, ' ' || w || ' ' AS w2 FROM (
      SELECT post_id, unnest(regexp_split_to_array(lower(post), '{SPACE}+')) AS w FROM docs) AS s
    WHERE w <> '') AS t, (VALUES (3), (4), (5)) AS sizes(k)) AS g GROUP BY 1, 2
"""
VOCABULARY = f"""
SELECT term, sum(tf) AS ctf, count(*) AS df FROM tf GROUP BY term ORDER BY ctf DESC, term LIMIT {K}
"""
WEIGHTS = """
SELECT post_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY post_id)) AS weight FROM (
  SELECT post_id, term, (1 + ln(tf)) * (ln((1.0 + (SELECT count(*) FROM docs)) / (1.0 + df)) + 1) AS raw
  FROM tf JOIN vocabulary USING (term)) AS t
"""
CHI2 = """
SELECT term, sum((o - share * total) * (o - share * total) / (share * total)) AS chi2 FROM (
  SELECT t.term, t.total, c.share, coalesce(w.o, 0) AS o
  FROM (SELECT term, sum(weight) AS total FROM weights GROUP BY term) t
  CROSS JOIN (SELECT quality, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM docs) AS share
              FROM docs GROUP BY quality) c
  LEFT JOIN (SELECT term, quality, sum(weight) AS o FROM weights JOIN docs USING (post_id) GROUP BY 1, 2) w
    ON w.term = t.term AND w.quality = c.quality) AS x GROUP BY term
"""
TERMS = dict(docs=LABELLED_DOCS, tf=WORD_TF, vocabulary=VOCABULARY, weights=WEIGHTS, chi2=CHI2,
             best=f"SELECT term, round(chi2, 6) AS chi2 FROM chi2 ORDER BY round(chi2, 10) DESC, term LIMIT {BEST}")
EVERY = TERMS | {"docs": ALL_DOCS}


def all_docs(spark, sf_dir):
    return documents(spark, sf_dir).select(F.col("doc_id").alias("post_id"), F.col("text").alias("post"))


def labelled_docs(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return documents(spark, sf_dir).join(labels, "doc_id").select(
        F.col("doc_id").alias("post_id"), F.col("text").alias("post"), "quality"
    )


@query("term_counts", with_cte("", "SELECT term, sum(tf) AS ctf, count(*) AS df FROM tf GROUP BY term",
                               **{k: EVERY[k] for k in ("docs", "tf")}).replace("sum(tf)", "CAST(sum(tf) AS BIGINT)"))
def term_counts(spark, sf_dir):
    return vz.corpus_counts(vz.term_counts(all_docs(spark, sf_dir)))


@query("term_counts_char", with_cte("", "SELECT term, CAST(sum(tf) AS BIGINT) AS ctf, count(*) AS df FROM tf GROUP BY term",
                                    docs=ALL_DOCS, tf=CHAR_TF))
def term_counts_char(spark, sf_dir):
    return vz.corpus_counts(vz.term_counts(all_docs(spark, sf_dir), vz.CHAR))


@query("top_vocabulary", with_cte("", "SELECT term, CAST(ctf AS BIGINT) AS ctf, df FROM vocabulary",
                                  **{k: EVERY[k] for k in ("docs", "tf", "vocabulary")}))
def top_vocabulary(spark, sf_dir):
    return vz.top_vocabulary(vz.term_counts(all_docs(spark, sf_dir)), K)


def doc_weights(spark, sf_dir, analyzer=vz.WORD, docs_of=all_docs):
    """(documents, weights over the K most frequent terms)."""
    docs = docs_of(spark, sf_dir)
    n = docs.count()
    top = vz.top_vocabulary(vz.term_counts(docs, analyzer), K)
    vocabulary = pin(top.withColumn("idf", vz.idf(n)), "vocabulary")
    return docs, vz.tfidf(vz.term_counts(docs, analyzer, vocabulary=vocabulary), vocabulary)


@query("tfidf", with_cte("", "SELECT post_id, term, round(weight, 6) AS weight FROM weights",
                         **{k: EVERY[k] for k in ("docs", "tf", "vocabulary", "weights")}))
def tfidf(spark, sf_dir):
    return _round(doc_weights(spark, sf_dir)[1], "weight")


@query("tfidf_char", with_cte("", "SELECT post_id, term, round(weight, 6) AS weight FROM weights",
                              docs=ALL_DOCS, tf=CHAR_TF, vocabulary=VOCABULARY, weights=WEIGHTS))
def tfidf_char(spark, sf_dir):
    return _round(doc_weights(spark, sf_dir, vz.CHAR)[1], "weight")


@query("chi2_scores", with_cte("", "SELECT term, round(chi2, 6) AS chi2 FROM chi2",
                               **{k: v for k, v in TERMS.items() if k != "best"}))
def chi2_scores(spark, sf_dir):
    docs, weights = doc_weights(spark, sf_dir, docs_of=labelled_docs)
    return _round(vz.chi2_scores(weights, docs.select("post_id", "quality"), "quality"), "chi2")


@query("select_k_best", with_cte("", "SELECT term, chi2 FROM best", **TERMS))
def select_k_best(spark, sf_dir):
    docs, weights = doc_weights(spark, sf_dir, docs_of=labelled_docs)
    scores = vz.chi2_scores(weights, docs.select("post_id", "quality"), "quality")
    # Equal scores differ in their last bits between engines; ten digits make them equal again.
    return _round(vz.select_k_best(_round(scores, "chi2", digits=10), BEST), "chi2")


@query(
    "max_abs_scale",
    with_cte("", "SELECT post_id, term, round(weight / max(abs(weight)) OVER (PARTITION BY term), 6) AS weight "
             "FROM weights", **{k: EVERY[k] for k in ("docs", "tf", "vocabulary", "weights")}),
)
def max_abs_scale(spark, sf_dir):
    weights = pin(doc_weights(spark, sf_dir)[1], "weights")
    return _round(vz.max_abs_scale(weights), "weight")
