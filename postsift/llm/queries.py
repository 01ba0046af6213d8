"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rank_file(name: str = "byte_bpe_multi_50k.tiktoken") -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


@query("op1_lz_fingerprints")
def op1_lz_fingerprints(spark, sf_dir):
    from postsift.llm import fingerprints

    return fingerprints.compare_next(table(spark, sf_dir, "documents"))


@query("op3_byte_bpe")
def op3_byte_bpe(spark, sf_dir):
    import public_tokenizers

    from postsift.llm import bpe

    return bpe.round_trip(table(spark, sf_dir, "documents"), rank_file(), public_tokenizers.PATTERN)


@query("op4_language_id")
def op4_language_id(spark, sf_dir):
    from pyspark.sql import functions as F

    from postsift.llm import langid

    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(~langid.held_out("doc_id")))
    found = langid.predict(docs, model, reject=False)
    return found.select("doc_id", langid.held_out("doc_id").alias("held_out"), "lang_pred", F.round("score", 6).alias("score"), "rejected")


@query("op7_warc_bundles", """
WITH d AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(encode(coalesce(html, ''))) AS h FROM pages),
named AS (
  SELECT page_id, n, h, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) + 1, 1)), '') AS b32,
    min(page_id) OVER (PARTITION BY h, n) AS first
  FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, b32 AS payload_digest,
  CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM named
""")
def op7_warc_bundles(spark, sf_dir):
    from pyspark.sql import functions as F

    from postsift.llm import warc

    index = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_archives(index).select(
        F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query("op8_ordinal_quality")
def op8_ordinal_quality(spark, sf_dir):
    from postsift.llm import quality

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.grade(docs, quality.fit(docs, quality.grades_of(labels)))


@query("op6_decontaminate")
def op6_decontaminate(spark, sf_dir):
    from pyspark.sql import functions as F

    from postsift.llm import decontaminate

    found = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.filter("leaked").select(
        "doc_id", "item_id", *[F.round(c, 6).alias(c) for c in ("score", "question_overlap", "answer_overlap", "item_overlap")]
    )


@query("op10_html_wrappers")
def op10_html_wrappers(spark, sf_dir):
    from postsift.llm import wrappers

    return wrappers.main_text(table(spark, sf_dir, "pages"))


@query("op5_partenum_join", """
WITH RECURSIVE
words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS s
  FROM words),
one AS (SELECT s, min(doc_id) AS rep, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
items AS (SELECT rep, n, unnest(s) AS w FROM one),
links AS (
  SELECT a.rep AS x, b.rep AS y FROM items a JOIN items b ON a.w = b.w AND a.rep < b.rep
    AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (
  SELECT rep AS node, rep AS c FROM one
  UNION SELECT edges.y, reach.c FROM reach JOIN edges ON edges.x = reach.node WHERE reach.c < edges.y),
least_of AS (SELECT node, min(c) AS c FROM reach GROUP BY node)
SELECT sets.doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, coalesce(l.c, sets.doc_id) AS component_id
FROM sets LEFT JOIN one ON one.s = sets.s LEFT JOIN least_of l ON l.node = one.rep
""")
def op5_partenum_join(spark, sf_dir):
    from postsift.llm import partenum

    return partenum.similar_sets(table(spark, sf_dir, "documents"))


@query("op2_suffix_dedup")
def op2_suffix_dedup(spark, sf_dir):
    from postsift.llm import suffix_dedup

    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


@query("op9_bigram_lm")
def op9_bigram_lm(spark, sf_dir):
    from postsift.llm import lm
    from postsift.llm.langid import held_out

    docs = table(spark, sf_dir, "documents")
    found = lm.score(docs, ~held_out("doc_id", 7, 2))
    return found.select("doc_id", held_out("doc_id", 7, 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op11_fill_in_middle", """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS x, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
u AS (
  SELECT doc_id, x, regexp_extract_all(x, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS us,
    CAST('0x' || substr(d, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(d, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(d, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(d, 25, 8) AS BIGINT) AS h4
  FROM t),
c AS (
  SELECT *, len(us) AS n, least(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS a, greatest(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS b,
    CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h3 % 100 >= 50 THEN 'plain'
      WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM u),
p AS (
  SELECT *, coalesce(array_to_string(us[1:a], ''), '') AS pre, coalesce(array_to_string(us[a + 1:b], ''), '') AS mid,
    coalesce(array_to_string(us[b + 1:n], ''), '') AS suf
  FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
    ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(x) AS restored_sha256
FROM p
""")
def op11_fill_in_middle(spark, sf_dir):
    from pyspark.sql import functions as F

    from postsift.llm import fim

    made = fim.transform(table(spark, sf_dir, "documents"))
    back = fim.restored(F.col("output"), F.col("form"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"),
    )


@query("op12_filter_audit", """
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws,
    min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least
  FROM documents),
l AS (SELECT doc_id, max(coalesce(quality, 0) = 1) AS good, max(coalesce(toxic, 0) = 1) AS bad FROM labels GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, false) AS good, coalesce(bad, false) AS bad,
    (CASE WHEN len(ws) < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(ws)) < 65 * len(ws) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 5 * length(x) THEN 4 ELSE 0 END)
    + (CASE WHEN regexp_matches(x, '[#$%&*|]') THEN 8 ELSE 0 END) + (CASE WHEN doc_id > least THEN 16 ELSE 0 END) AS mask
  FROM d LEFT JOIN l USING (doc_id)),
c AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (bad) AS t FROM m GROUP BY part, mask),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS b),
o AS (
  SELECT f1.f || f2.f || f3.f || f4.f || f5.f AS filter_order, [f1.b, f2.b, f3.b, f4.b, f5.b] AS bs
  FROM f f1 JOIN f f2 ON f2.f <> f1.f JOIN f f3 ON f3.f NOT IN (f1.f, f2.f) JOIN f f4 ON f4.f NOT IN (f1.f, f2.f, f3.f)
    JOIN f f5 ON f5.f NOT IN (f1.f, f2.f, f3.f, f4.f)),
s AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, substr(filter_order, step, 1) AS filter, bs[step] AS b,
    coalesce(list_sum(bs[1:step - 1]), 0) AS past
  FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (
  SELECT part, filter_order, step, filter, b,
    coalesce(sum(n) FILTER (mask & CAST(past + b AS INTEGER) = 0), 0) AS kept,
    coalesce(sum(n) FILTER (mask & b <> 0 AND mask & CAST(past AS INTEGER) = 0), 0) AS removed,
    coalesce(sum(n) FILTER (mask & b <> 0 AND mask & CAST(past AS INTEGER) <> 0), 0) AS redundant,
    coalesce(sum(n) FILTER (mask = b), 0) AS unique_fails,
    coalesce(sum(g) FILTER (mask & b <> 0 AND mask & CAST(past AS INTEGER) = 0), 0) AS good_lost,
    coalesce(sum(t) FILTER (mask & b <> 0 AND mask & CAST(past AS INTEGER) = 0), 0) AS toxic_lost
  FROM c CROSS JOIN s GROUP BY ALL)
SELECT part, filter_order, step, filter, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM r
""")
def op12_filter_audit(spark, sf_dir):
    from postsift.llm import filter_audit

    labels = table(spark, sf_dir, "labels")
    return filter_audit.audit(filter_audit.counters(spark, f"{sf_dir}/documents.parquet", labels))


@query("op13_simhash")
def op13_simhash(spark, sf_dir):
    from postsift.llm import simhash

    return simhash.near_copies(table(spark, sf_dir, "documents"))
