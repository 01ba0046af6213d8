"""Queries for sampling, joins, class statistics, evaluation and ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.text_queries import CLINICAL_OUT, SCREENED, lit, screened
from catalog.views import posts, table, with_cte
from postsift import fixed_values as fv
from postsift.functions import scores as sc
from postsift.functions import text as tx
from postsift.operators import evaluate as ev
from postsift.operators import filters as fl
from postsift.operators import joins as jn
from postsift.operators import learners as ln
from postsift.operators import sampling as sp

LABELLED = "SELECT post_id, subreddit FROM posts WHERE subreddit IS NOT NULL"
RANKED = """
SELECT *, count(*) OVER (PARTITION BY subreddit) AS n,
  row_number() OVER (PARTITION BY subreddit ORDER BY md5('42|' || post_id), post_id) AS place
FROM labelled
"""
CAP = 40  # well below the largest classes of the supplied tables


def labelled(spark, sf_dir):
    return posts(spark, sf_dir).select("post_id", "subreddit").filter("subreddit is not null")


@query(
    "stratified_split",
    with_cte("posts", "SELECT post_id, subreddit, place <= ceil(n * CAST(0.15 AS DOUBLE)) AS is_test "
             "FROM ranked", labelled=LABELLED, ranked=RANKED),
)
def stratified_split(spark, sf_dir):
    return sp.stratified_split(labelled(spark, sf_dir), "subreddit")


@query(
    "cap_per_class",
    with_cte("posts", f"SELECT post_id, subreddit FROM ranked WHERE place <= {CAP}",
             labelled=LABELLED, ranked=RANKED),
)
def cap_per_class(spark, sf_dir):
    return sp.cap_per_class(labelled(spark, sf_dir), "subreddit", CAP)


@query(
    "stratified_folds",
    with_cte(
        "posts",
        "SELECT post_id, subreddit, CAST((place > n // 3 + least(1, n % 3)) AS INTEGER) + "
        "CAST((place > 2 * (n // 3) + least(2, n % 3)) AS INTEGER) AS fold FROM ranked",
        labelled=LABELLED, ranked=RANKED,
    ),
)
def stratified_folds(spark, sf_dir):
    return sp.stratified_folds(labelled(spark, sf_dir), "subreddit")


@query("class_counts", with_cte("posts", "SELECT subreddit, count(*) AS n FROM labelled GROUP BY 1",
                                labelled=LABELLED))
def class_counts(spark, sf_dir):
    return sp.class_counts(labelled(spark, sf_dir), "subreddit")


@query("n_classes", with_cte("posts", "SELECT count(DISTINCT subreddit) AS n_classes FROM posts"))
def n_classes(spark, sf_dir):
    return sp.n_classes(posts(spark, sf_dir), "subreddit")


@query(
    "assert_unique_key",
    "SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1 HAVING count(*) > 1",
)
def assert_unique_key(spark, sf_dir):
    sp.assert_unique_key(posts(spark, sf_dir), "post_id")
    return sp.repeated_keys(table(spark, sf_dir, "conversations"), "conv_id")


@query(
    "balanced_weights",
    with_cte(
        "posts",
        "SELECT post_id, subreddit, round(CAST((SELECT count(*) FROM labelled) AS DOUBLE) / "
        "((SELECT count(DISTINCT subreddit) FROM labelled) * count(*) OVER (PARTITION BY subreddit)), 6) "
        "AS weight FROM labelled",
        labelled=LABELLED,
    ),
)
def balanced_weights(spark, sf_dir):
    out = sp.balanced_weights(labelled(spark, sf_dir), "subreddit")
    return out.withColumn("weight", F.round("weight", 6))


@query(
    "index_labels",
    with_cte("posts", "SELECT post_id, subreddit, CAST(dense_rank() OVER (ORDER BY subreddit) - 1 AS DOUBLE) "
             "AS label, subreddit AS label_name FROM labelled", labelled=LABELLED),
)
def index_labels(spark, sf_dir):
    from postsift.operators import learners as ln

    names, indexed = ln.index_labels(labelled(spark, sf_dir), "subreddit")
    return ln.label_name(indexed, names).select("post_id", "subreddit", "label", "label_name")


# --- joins --------------------------------------------------------------------------------


@query(
    "align",
    with_cte(
        "posts",
        "SELECT p.post_id, q.rows AS result, coalesce(q.dropped, false) AS _drop FROM posts p "
        "LEFT JOIN (SELECT doc_id, quality AS rows, toxic = 1 AS dropped FROM labels) q "
        "ON p.post_id = q.doc_id",
    ),
)
def align(spark, sf_dir):
    results = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("post_id"), F.col("quality").alias("result"),
        (F.col("toxic") == 1).alias("_drop"),
    )
    return jn.align(posts(spark, sf_dir).select("post_id"), results)


@query(
    "take_ids",
    with_cte("posts", "SELECT post_id, subreddit FROM posts WHERE post_id IN (SELECT doc_id FROM labels)"),
)
def take_ids(spark, sf_dir):
    ids = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("post_id"))
    return sp.take_ids(posts(spark, sf_dir).select("post_id", "subreddit"), ids)


# --- evaluation: the forum as truth, a rule on the text as prediction -----------------------
PREDICTED = """
SELECT doc_id, quality AS y, CASE WHEN n_chars > 800 THEN 1 ELSE 0 END AS yhat
FROM labels JOIN documents USING (doc_id)
"""
CONFUSION = "SELECT y, yhat, count(*) AS n FROM predicted GROUP BY 1, 2"
PER_CLASS = """
SELECT label, sum(hit) AS hit, sum(truth) AS support, sum(said) AS said FROM (
  SELECT y AS label, CASE WHEN y = yhat THEN n ELSE 0 END AS hit, n AS truth, 0 AS said FROM cm
  UNION ALL SELECT yhat, 0, 0, n FROM cm) AS t GROUP BY label
"""
RATES = """
SELECT label, CASE WHEN said > 0 THEN CAST(hit AS DOUBLE) / said ELSE 0 END AS precision,
  CASE WHEN support > 0 THEN CAST(hit AS DOUBLE) / support ELSE 0 END AS recall,
  CASE WHEN said + support > 0 THEN CAST(2 * hit AS DOUBLE) / (said + support) ELSE 0 END AS f1,
  support, hit FROM per_class
"""
EVAL = dict(predicted=PREDICTED, cm=CONFUSION, per_class=PER_CLASS, rates=RATES)


def predicted(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select(
        "doc_id", F.col("quality").alias("y"),
        F.when(F.col("n_chars") > 800, 1).otherwise(0).alias("yhat"),
    )


@query("confusion", f"WITH predicted AS ({PREDICTED}) {CONFUSION}")
def confusion(spark, sf_dir):
    return ev.confusion(predicted(spark, sf_dir))


def _rounded(cols: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols.split())


@query(
    "classification_report",
    with_cte(
        "",
        f"""
SELECT CAST(label AS VARCHAR) AS label, {_rounded('precision recall f1')}, CAST(support AS BIGINT) AS support
FROM rates
UNION ALL SELECT 'accuracy', round(CAST(sum(hit) AS DOUBLE) / sum(support), 6),
  round(CAST(sum(hit) AS DOUBLE) / sum(support), 6), round(CAST(sum(hit) AS DOUBLE) / sum(support), 6),
  CAST(sum(support) AS BIGINT) FROM rates
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6),
  CAST(sum(support) AS BIGINT) FROM rates
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6),
  round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6),
  CAST(sum(support) AS BIGINT) FROM rates""",
        **EVAL,
    ),
)
def classification_report(spark, sf_dir):
    out = ev.classification_report(ev.confusion(predicted(spark, sf_dir)))
    return out.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("macro_f1", with_cte("", "SELECT round(avg(f1), 6) AS macro_f1 FROM rates", **EVAL))
def macro_f1(spark, sf_dir):
    out = ev.macro_f1(ev.confusion(predicted(spark, sf_dir)))
    return out.select(F.round("macro_f1", 6).alias("macro_f1"))


# --- ranking: the 64 floats of an embedding, four at a time, as scores of the 16 labels -----
NAMES = sorted(fv.RISK)
SCORES = "SELECT vec_id, label AS y, list_transform(range(0, 16), lambda i: " + " + ".join(
    f"CAST(embedding[4 * i + {j}] AS DOUBLE)" for j in (1, 2, 3, 4)
) + ") AS s FROM embeddings"
PROBS = """
SELECT vec_id, y, s, list_transform(s, lambda x: exp(x - list_max(s)) /
  list_sum(list_transform(s, lambda z: exp(z - list_max(s))))) AS p FROM scores
"""
NAME_LIST = "[" + ", ".join(lit(n) for n in NAMES) + "]"
RISK_VALUES = ", ".join(f"({lit(k)}, {lit(d)}, {lit(r)})" for k, (d, r) in fv.RISK.items())
LONG = f"""
SELECT vec_id, i, {NAME_LIST}[i] AS label, p[i] AS p,
  row_number() OVER (PARTITION BY vec_id ORDER BY p[i] DESC, {NAME_LIST}[i]) AS place
FROM probs, (SELECT unnest(range(1, 17)) AS i) AS t
"""
RANKING = dict(scores=SCORES, probs=PROBS, long=LONG,
               risk=f"SELECT * FROM (VALUES {RISK_VALUES}) AS t(label, display, risk_level)")


def score_rows(spark, sf_dir):
    def four(i):
        terms = [F.col("embedding")[4 * i + j].cast("double") for j in range(4)]
        return terms[0] + terms[1] + terms[2] + terms[3]

    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("label").alias("y"), F.array(*[four(i) for i in range(16)]).alias("s")
    )


def prob_rows(spark, sf_dir):
    return score_rows(spark, sf_dir).withColumn("p", sc.softmax(F.col("s")))


@query("softmax", with_cte("", "SELECT vec_id, i, round(p, 6) AS p FROM long", **RANKING))
def softmax(spark, sf_dir):
    return prob_rows(spark, sf_dir).select("vec_id", F.posexplode("p").alias("i", "p")).select(
        "vec_id", (F.col("i") + 1).cast("long").alias("i"), F.round("p", 6).alias("p")
    )


@query("argmax_label", with_cte("", "SELECT vec_id, label FROM long WHERE place = 1", **RANKING))
def argmax_label(spark, sf_dir):
    return prob_rows(spark, sf_dir).select("vec_id", sc.argmax_label(F.col("p"), NAMES).alias("label"))


@query("prob_map", with_cte("", "SELECT vec_id, label, round(p, 6) AS p FROM long", **RANKING))
def prob_map(spark, sf_dir):
    return prob_rows(spark, sf_dir).select(
        "vec_id", F.explode(sc.prob_map(F.col("p"), NAMES)).alias("label", "p")
    ).withColumn("p", F.round("p", 6))


@query("top_labels", with_cte("", "SELECT vec_id, place AS rank, label, round(p, 6) AS p FROM long "
                              "WHERE place <= 8", **RANKING))
def top_labels(spark, sf_dir):
    return prob_rows(spark, sf_dir).select(
        "vec_id", F.posexplode(sc.top_pairs(F.col("p"), NAMES, 8)).alias("rank", "t")
    ).select("vec_id", (F.col("rank") + 1).cast("long").alias("rank"), "t.label",
             F.round("t.p", 6).alias("p"))


@query(
    "ranked_distribution",
    with_cte("", "SELECT vec_id, place AS rank, label, round(p, 6) AS p, display, risk_level "
             "FROM long JOIN risk USING (label)", **RANKING),
)
def ranked_distribution(spark, sf_dir):
    from postsift.plans.scoring import ranked_distribution as ranked

    out = ranked(prob_rows(spark, sf_dir), NAMES, key="vec_id")
    return out.withColumn("p", F.round("p", 6))


@query(
    "risk_join",
    with_cte("posts", "SELECT post_id, p.label, coalesce(display, p.label) AS display, "
             "coalesce(risk_level, 'UNKNOWN') AS risk_level FROM mapped p LEFT JOIN risk USING (label)",
             mapped="SELECT post_id, CASE subreddit " + " ".join(
                 f"WHEN {lit(k)} THEN {lit(v)}" for k, v in fv.LABELS.items()
             ) + " ELSE subreddit END AS label FROM posts", risk=RANKING["risk"]),
)
def risk_join(spark, sf_dir):
    mapped = posts(spark, sf_dir).select(
        "post_id", tx.remap_label(F.col("subreddit"), fv.LABELS).alias("label")
    )
    return jn.risk_join(mapped).select("post_id", "label", "display", "risk_level")


@query(
    "high_risk",
    with_cte("", "SELECT vec_id, label, risk_level FROM long JOIN risk USING (label) "
             "WHERE place = 1 AND risk_level IN ('CRITICAL', 'HIGH')", **RANKING),
)
def high_risk(spark, sf_dir):
    best = argmax_label(spark, sf_dir)
    return fl.high_risk(jn.risk_join(best)).select("vec_id", "label", "risk_level")


@query(
    "log_loss",
    with_cte("", "SELECT round(avg(-ln(greatest(least(p[y + 1], 1 - 1e-15), 1e-15))), 6) AS log_loss "
             "FROM (SELECT p, y % 16 AS y FROM probs) AS t", **RANKING),
)
def log_loss(spark, sf_dir):
    rows = prob_rows(spark, sf_dir).withColumn("y", F.col("y") % 16)
    return ev.log_loss(rows).select(F.round("log_loss", 6).alias("log_loss"))


@query(
    "fold_average",
    with_cte("", "SELECT vec_id, i, round(avg(exp(f * s[i]) / list_sum(list_transform(s, lambda x: exp(f * x)))), 6) AS p "
             "FROM scores, (SELECT unnest(range(1, 17)) AS i) AS t, (SELECT unnest(range(1, 4)) AS f) AS models "
             "GROUP BY vec_id, i", **RANKING),
)
def fold_average(spark, sf_dir):
    """Mean class scores of each vector over three models, a row per vector and model."""
    scores = score_rows(spark, sf_dir)

    def model(f):
        return scores.select("vec_id", sc.softmax(F.transform("s", lambda x: x * f)).alias("p"))

    models = [model(f) for f in (1.0, 2.0, 3.0)]
    out = ev.fold_average(sp.union_all(models), key="vec_id", n=16)
    return out.select("vec_id", F.posexplode("p").alias("i", "p")).select(
        "vec_id", (F.col("i") + 1).cast("long").alias("i"), F.round("p", 6).alias("p")
    )


@query(
    "oof_union",
    with_cte("posts", "SELECT fold, count(*) AS n, count(DISTINCT post_id) AS keys FROM ("
             "SELECT post_id, CAST((place > n // 3 + least(1, n % 3)) AS INTEGER) + "
             "CAST((place > 2 * (n // 3) + least(2, n % 3)) AS INTEGER) AS fold FROM ranked) AS t GROUP BY fold",
             labelled=LABELLED, ranked=RANKED),
)
def oof_union(spark, sf_dir):
    folds = sp.stratified_folds(labelled(spark, sf_dir), "subreddit")
    parts = [folds.filter(F.col("fold") == i) for i in range(fv.FOLDS)]
    return ln.oof_union(parts).groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("post_id").alias("keys")
    )


@query(
    "screen_and_split",
    with_cte(
        "posts",
        "SELECT label, is_test, count(*) AS n FROM (SELECT label, row_number() OVER (PARTITION BY label "
        "ORDER BY md5('42|' || post_id), post_id) <= ceil(count(*) OVER (PARTITION BY label) * "
        "CAST(0.15 AS DOUBLE)) AS is_test FROM complete) AS t GROUP BY 1, 2",
        **SCREENED, clinical_out=CLINICAL_OUT,
        complete="SELECT post_id, CASE subreddit " + " ".join(
            f"WHEN {lit(k)} THEN {lit(v)}" for k, v in fv.LABELS.items()
        ) + " ELSE subreddit END AS label FROM clinical_out WHERE post_cleaned IS NOT NULL "
        "AND post_masked IS NOT NULL AND subreddit IS NOT NULL",
    ),
)
def screen_and_split(spark, sf_dir):
    """The front half of training in one query: both filters, labels, stratified split."""
    from postsift.sources.staging import pin

    kept = fl.drop_incomplete(
        screened(spark, sf_dir), ["post_cleaned", "post_masked", "subreddit"]
    ).select("post_id", tx.remap_label(F.col("subreddit"), fv.LABELS).alias("label"))
    out = sp.stratified_split(pin(kept, "kept"), "label")
    return out.groupBy("label", "is_test").agg(F.count(F.lit(1)).alias("n"))
