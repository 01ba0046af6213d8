"""Term counts, vocabulary, TF-IDF, chi-square selection and scaling in long form.

A feature matrix is a table (post_id, term, weight). Texts are partitioned by `post_id` once; what needs sums
over terms, weights or vectors gets them from array operations on blocks of whole posts (`grams.py`), so that
terms of posts are neither rows nor shuffled. Only per-term partial sums travel. Counts of another origin, and
vocabularies too large for a task, are worked off as rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from postsift import fixed_values as fv
from postsift.functions import tokens as tk
from postsift.operators import boosting as bo
from postsift.operators import grams as gr
from postsift.operators.sampling import class_counts
from postsift.sources.staging import pin

WORD, CHAR = gr.WORD, gr.CHAR
#: Bands of frequencies in one pass for the cut of a vocabulary.
BANDS = 1024
#: Bytes of text in one partition whose terms are counted: a task holds its posts' terms.
TEXT_BYTES = 2 * 2**20
#: Bytes of text in one block of posts, which array operations work off by slices.
BLOCK_BYTES = 8 * 2**20
#: A vocabulary of up to this many bytes is broadcast.
VOCABULARY_BYTES = 64 * 2**20


def text_partitions(df: DataFrame, *cols: str, size: int = TEXT_BYTES) -> int:
    """Partitions of about `size` bytes of text, at least as many as a shuffle has."""
    return _partitions(df, _text_bytes(df, *cols), size)


def _text_bytes(df: DataFrame, *cols: str) -> int:
    texts = df.select(sum((F.coalesce(F.octet_length(c), F.lit(0)).cast("long") for c in cols), F.lit(0)).alias("n"))
    return texts.agg(F.sum("n")).first()[0] or 0


def _partitions(df: DataFrame, total: int, size: int) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / size))


def by_post(df: DataFrame, *cols: str, key: str = "post_id", partitions: int | None = None) -> DataFrame:
    """Only the needed columns, partitioned by the row key.

    Branches that start from the same such table share one shuffle. The number of partitions is
    given, so that adaptive execution does not merge them: it sees the bytes of the texts, but their
    terms are many times that. It follows the bytes of the texts, so that a task's terms have a bound.
    """
    return df.select(key, *cols).repartition(partitions or text_partitions(df, *cols), key)


def _small(vocabulary: DataFrame) -> DataFrame:
    """The table of terms, marked for a broadcast if it has at most VOCABULARY_BYTES."""
    row = vocabulary.agg(F.count(F.lit(1)), F.sum(F.octet_length("term").cast("long"))).first()
    return F.broadcast(vocabulary) if 64 * row[0] + (row[1] or 0) <= VOCABULARY_BYTES else vocabulary


def term_counts(
    df: DataFrame, analyzer: str = WORD, col: str = "post", key: str = "post_id",
    partitioned: bool = False, vocabulary: DataFrame | None = None,
) -> DataFrame:
    """(post_id, term, tf) for word 1-2-grams or for 3-5 character n-grams inside words.

    `partitioned` says that `df` comes from `by_post` already. With a `vocabulary` only its terms are
    counted: others are dropped before they are aggregated.

    `corpus_counts` and `tfidf` of the result work on its texts, block by block, and not on its rows.
    """
    total = 0 if partitioned else _text_bytes(df, col)
    tf = _term_rows(df.select(key, col) if partitioned else by_post(df, col, key=key, partitions=_partitions(df, total, TEXT_BYTES)), analyzer, col, key, vocabulary)
    texts = df.select(key, col) if partitioned else by_post(df, col, key=key, partitions=_partitions(df, total, BLOCK_BYTES))
    tf.counted = _Counted(texts, analyzer, col, key, vocabulary)
    return tf


def _term_rows(texts: DataFrame, analyzer: str, col: str, key: str, vocabulary: DataFrame | None) -> DataFrame:
    known = None if vocabulary is None else _small(vocabulary.select("term"))

    def inside(rows: DataFrame) -> DataFrame:
        return rows if known is None else rows.join(known, "term", "left_semi")

    if analyzer == WORD:
        grams = tk.word_ngrams(tk.word_tokens(F.col(col)), 1, 2)
        return inside(texts.select(key, F.explode(grams).alias("term"))).groupBy(key, "term").agg(
            F.count(F.lit(1)).alias("tf")
        )
    # A repeated word is cut into n-grams once per post.
    words = (
        texts.select(key, F.explode(tk.split_words(F.col(col))).alias("word"))
        .groupBy(key, "word")
        .agg(F.count(F.lit(1)).alias("tf"))
    )
    return (
        inside(tk.char_ngram_rows(words, "word", "term"))
        .groupBy(key, "term")
        .agg(F.sum("tf").alias("tf"))
    )


def _units(analyzer: str, col: str) -> Column:
    return tk.word_tokens(F.col(col)) if analyzer == WORD else tk.split_words(F.col(col))


def _unit_list(table: pa.Table, name: str) -> pa.ListArray:
    return gr._one(table.column(name))


@dataclass
class _Counted:
    """The texts that a table of counts comes from, all rows of a post in one partition."""

    texts: DataFrame
    analyzer: str
    col: str
    key: str
    vocabulary: DataFrame | None

    def _blocks(self, run: Callable, schema: StructType | str) -> DataFrame:
        """`run` gives the record batches of a slice of posts."""
        key = self.key

        def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in gr.slices(batches, key, ["_units"]):
                yield from run(part)

        return self.texts.select(key, _units(self.analyzer, self.col).alias("_units")).mapInArrow(block, schema)

    def corpus(self) -> DataFrame:
        analyzer = self.analyzer

        def run(part: gr.Slice) -> Iterator[pa.RecordBatch]:
            _, place, tf, terms = gr.counted(analyzer, _unit_list(part.table, "_units"), part.post)
            ctf = np.bincount(place, tf, len(terms)).astype(np.int64)
            df = np.bincount(place, minlength=len(terms))
            yield pa.RecordBatch.from_arrays([terms, pa.array(ctf), pa.array(df)], names=["term", "ctf", "df"])

        parts = self._blocks(run, "term string, ctf long, df long")
        return parts.groupBy("term").agg(F.sum("ctf").alias("ctf"), F.sum("df").alias("df"))

    def weights(self, vocabulary: pa.Table, keep: Sequence[str]) -> DataFrame:
        spark, analyzer, key = self.texts.sparkSession, self.analyzer, self.key
        known = spark.sparkContext.broadcast((gr._one(vocabulary.column("term")), vocabulary.column("idf").to_numpy()))
        terms = vocabulary.select(["term", *keep]).append_column("_at", pa.array(np.arange(len(vocabulary), dtype=np.int32)))

        def run(part: gr.Slice) -> Iterator[pa.RecordBatch]:
            held, idf = known.value
            post, place, tf, _ = gr.counted(analyzer, _unit_list(part.table, "_units"), part.post, held)
            weight = gr.weighed(post, place, tf, idf)
            yield pa.RecordBatch.from_arrays([part.keys.take(pa.array(post)), pa.array(place.astype(np.int32)), pa.array(weight)], names=[key, "_at", "weight"])

        schema = StructType([self.texts.schema[key], StructField("_at", IntegerType()), StructField("weight", DoubleType())])
        rows = self._blocks(run, schema).join(F.broadcast(spark.createDataFrame(terms)), "_at")
        return rows.select(key, "term", *keep, "weight")


def _collected(vocabulary: DataFrame, *cols: str) -> pa.Table | None:
    """The columns of a vocabulary of distinct terms of at most VOCABULARY_BYTES, else nothing."""
    row = vocabulary.agg(F.count(F.lit(1)), F.sum(F.octet_length("term").cast("long"))).first()
    if 64 * row[0] + (row[1] or 0) > VOCABULARY_BYTES:
        return None
    table = vocabulary.select(*cols).toArrow().combine_chunks()
    return table if pc.count_distinct(table.column("term"), mode="all").as_py() == len(table) and not table.column("term").null_count else None


def corpus_counts(tf: DataFrame) -> DataFrame:
    """(term, ctf, df): occurrences in the corpus and posts that hold the term."""
    counted = tf.__dict__.get("counted")
    if counted is not None and counted.vocabulary is None:
        return counted.corpus()
    return tf.groupBy("term").agg(F.sum("tf").alias("ctf"), F.count(F.lit(1)).alias("df"))


def kth_frequency(counts: DataFrame, k: int) -> int:
    """The frequency of the k-th most frequent term, 0 if there are fewer terms.

    Terms are counted per band of frequencies: small frequencies have a band each, and a band of larger
    ones that holds the k-th term is cut into bands again. At most BANDS + 1 rows reach the driver.
    """
    first = counts.groupBy(F.least("ctf", F.lit(BANDS)).alias("band")).agg(
        F.count(F.lit(1)).alias("n"), F.max("ctf").alias("top")
    ).collect()
    sizes, low, width, above = {r["band"]: r["n"] for r in first}, 0, 1, 0
    if sum(sizes.values()) < k or k < 1:
        return 0
    high = max(r["top"] for r in first)
    while True:
        for band in sorted(sizes, reverse=True):
            if above + sizes[band] >= k:
                break
            above += sizes[band]
        # The open last band of small frequencies ends at the largest one.
        low, high = low + band * width, high if low == 0 and band == BANDS else low + (band + 1) * width - 1
        if low >= high:
            return low
        width = -(-(high - low + 1) // BANDS)
        inside = counts.filter(F.col("ctf").between(low, high))
        rows = inside.groupBy(F.expr(f"(ctf - {low}) div {width}").alias("band")).agg(F.count(F.lit(1)).alias("n"))
        sizes = {r["band"]: r["n"] for r in rows.collect()}


def top_vocabulary(tf: DataFrame, k: int) -> DataFrame:
    """The k most frequent terms, ties in term order.

    The frequency of the k-th term is found first. Only terms that reach it are sorted, so the sort
    sees about k terms and not k from every partition.
    """
    counts = pin(corpus_counts(tf), "corpus_counts")
    cut = kth_frequency(counts, k)
    return counts.filter(F.col("ctf") >= cut).orderBy(F.desc("ctf"), "term").limit(k)


def idf(n_posts: int) -> Column:
    """Smooth inverse document frequency over the column `df`."""
    return F.log((F.lit(1.0) + n_posts) / (F.lit(1.0) + F.col("df"))) + 1.0


def tfidf(
    tf: DataFrame, vocabulary: DataFrame, key: str = "post_id", keep: Sequence[str] = ()
) -> DataFrame:
    """(post_id, term, weight): (1 + ln tf) * idf, each post scaled to length one.

    `vocabulary` has `term`, `idf` and the columns to `keep`; terms outside it are dropped before
    the weights are built.
    """
    counted = tf.__dict__.get("counted")
    if counted is not None and counted.key == key and (counted.vocabulary is None or counted.vocabulary is vocabulary):
        known = _collected(vocabulary, "term", "idf", *keep)
        if known is not None:
            return counted.weights(known, keep)
    raw = tf.join(_small(vocabulary.select("term", "idf", *keep)), "term").withColumn(
        "raw", (F.log("tf") + 1.0) * F.col("idf")
    )
    length = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(key)))
    return raw.select(key, "term", *keep, (F.col("raw") / length).alias("weight"))


def chi2_scores(weights: DataFrame, labels: DataFrame, label: str, key: str = "post_id") -> DataFrame:
    """(term, chi2) of the total weight per class against the share of posts per class.

    `labels` has one row per post.
    """
    observed = (
        weights.join(labels.select(key, F.col(label).alias("class")), key)
        .groupBy("term", "class")
        .agg(F.sum("weight").alias("o"))
    )
    return _chi2(observed, labels, label)


def _chi2(observed: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """(term, chi2) of (term, class, o). A class in which a term never occurs has O = 0 and adds its
    expected weight E, so all such classes together add T * (1 - their counterpart's share) and no
    term x class product is built."""
    sizes = class_counts(labels, label)
    share = sizes.select(
        F.col(label).alias("class"),
        (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"),  # one row per class
    )
    share = pin(share, "class_share")
    with_total = observed.join(share, "class").withColumn(
        "total", F.sum("o").over(Window.partitionBy("term"))
    )
    expected = F.col("share") * F.col("total")
    return with_total.groupBy("term").agg(
        (
            F.sum((F.col("o") - expected) * (F.col("o") - expected) / expected)
            + F.max("total") * (1.0 - F.sum("share"))
        ).alias("chi2")
    )


def select_k_best(scores: DataFrame, k: int) -> DataFrame:
    """The k terms with the highest score, ties in term order."""
    return scores.select("term", "chi2").orderBy(F.desc("chi2"), "term").limit(k)


def max_abs(weights: DataFrame) -> DataFrame:
    return weights.groupBy("term").agg(F.max(F.abs("weight")).alias("max_abs"))


def max_abs_scale(weights: DataFrame, maxima: DataFrame | None = None) -> DataFrame:
    """Divide each term by its largest absolute weight; a term of zeros stays as it is."""
    maxima = pin(max_abs(weights), "max_abs") if maxima is None else maxima
    scale = F.when(F.col("max_abs") > 0, F.col("max_abs")).otherwise(F.lit(1.0))
    return weights.join(maxima, "term").withColumn("weight", F.col("weight") / scale).select(
        *weights.columns
    )


@dataclass
class StandardScaling:
    """Mean and population deviation of dense columns: two numbers per column."""

    means: dict[str, float]
    deviations: dict[str, float]

    @classmethod
    def fit(cls, df: DataFrame, cols: Sequence[str]) -> "StandardScaling":
        row = df.agg(
            *[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
            *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)],
        ).first()
        return cls(
            {c: row[f"m{i}"] or 0.0 for i, c in enumerate(cols)},
            {c: row[f"s{i}"] or 0.0 for i, c in enumerate(cols)},
        )

    def apply(self, df: DataFrame) -> DataFrame:
        """Centre and scale; a constant column becomes 0."""
        return df.withColumns(
            {c: (F.col(c) - m) / (self.deviations[c] or 1.0) for c, m in self.means.items()}
        )


def standard_scale(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return StandardScaling.fit(df, cols).apply(df)


@F.udf(VectorUDT(), useArrow=True)
def _sparse(size, entries):
    return Vectors.sparse(size, [e[0] for e in entries], [e[1] for e in entries])


def _sparse_vectors(rows: DataFrame, size: int, key: str, out: str) -> DataFrame:
    """(key, sparse vector) of the sorted arrays `idx` and `weight`: the arrays become the vector's
    own, no entry becomes a Python object."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            fields = [pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, size, np.int32)), batch.column(1), batch.column(2)]
            vectors = pa.StructArray.from_arrays(fields, ["type", "size", "indices", "values"])
            yield pa.RecordBatch.from_arrays([batch.column(0), vectors], [key, out])

    schema = StructType([rows.schema[key], StructField(out, VectorUDT())])
    return rows.select(key, "idx", "weight").mapInArrow(run, schema)


def vector_rows(df: DataFrame, vector: str, key: str = "post_id") -> DataFrame:
    """(key, idx, weight) of the entries of a column of sparse or dense ML vectors that are not zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, idx, weight = bo.entries(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(idx.astype(np.int32)), pa.array(weight)], [key, "idx", "weight"])

    schema = StructType([df.schema[key], StructField("idx", IntegerType()), StructField("weight", DoubleType())])
    return df.select(key, vector).mapInArrow(run, schema)


def _entries(weights: DataFrame, key: str) -> DataFrame:
    """(key, idx, weight): the column numbers of a post's terms in order, and their weights."""
    entries = F.array_sort(F.collect_list(F.struct("idx", "weight"))).alias("entries")
    return weights.groupBy(key).agg(entries).select(
        key, F.col("entries.idx").alias("idx"), F.col("entries.weight").alias("weight")
    )


def to_sparse(
    weights: DataFrame, terms: DataFrame, size: int, key: str = "post_id", out: str = "tfidf"
) -> DataFrame:
    """One sparse vector per post; `terms` maps each term to its column `idx`."""
    rows = _entries(weights.join(terms.select("term", "idx"), "term"), key)
    return _sparse_vectors(rows, size, key, out)


def _class_sums(train: DataFrame, label: str, col: str, vocabularies: dict[str, pa.Table], key: str = "post_id") -> DataFrame:
    """(analyzer, at, class, o, top): total and largest weight of each term, by its place in the vocabulary, over the
    rows of each class; rows without a key or a class count for `top` only, under a null class."""
    names = list(vocabularies)
    shared = train.sparkSession.sparkContext.broadcast(
        {a: (gr._one(v.column("term")), v.column("idf").to_numpy()) for a, v in vocabularies.items()}
    )
    texts = by_post(train, label, col, key=key, partitions=text_partitions(train, col, size=BLOCK_BYTES))
    texts = texts.select(key, F.col(label).alias("_class"), *[_units(a, col).alias(a) for a in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}  # (analyzer, class) -> total weight by place
        tops = {a: np.zeros(len(t)) for a, (t, _) in shared.value.items()}
        kind = None
        for part in gr.slices(batches, key, names):
            labels = gr._one(part.table.column("_class"))
            kind, of = labels.type, labels.dictionary_encode()
            named = np.asarray(pc.and_(labels.is_valid(), part.table.column(key).combine_chunks().is_valid()).to_numpy(zero_copy_only=False), bool)
            cls = np.asarray(pc.fill_null(of.indices, -1), np.int64)
            for a in names:
                known, idf = shared.value[a]
                post, place, tf, _ = gr.counted(a, gr._one(part.table.column(a)), part.post, known)
                weight = gr.weighed(post, place, tf, idf)
                np.maximum.at(tops[a], place, weight)
                for i, value in enumerate(of.dictionary.to_pylist()):
                    rows = np.bincount(part.post[named & (cls == i)], minlength=len(part.keys))  # a post's rows of the class
                    total = np.bincount(place, weight * rows[post], len(known))
                    sums[a, value] = sums.get((a, value), 0) + total
        for a in names if kind is not None else ():
            for value, o, top in [(None, None, tops[a]), *((v, t, None) for (b, v), t in sums.items() if b == a)]:
                at = np.flatnonzero(top if o is None else o)
                both = [pa.nulls(len(at), pa.float64()) if x is None else pa.array(x[at]) for x in (o, top)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([a] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array([value] * len(at), kind), *both],
                    names=["analyzer", "at", "class", "o", "top"],
                )

    schema = StructType([StructField("analyzer", StringType()), StructField("at", IntegerType()), StructField("class", train.schema[label].dataType),
                         StructField("o", DoubleType()), StructField("top", DoubleType())])
    return texts.mapInArrow(run, schema).groupBy("analyzer", "at", "class").agg(F.sum("o").alias("o"), F.max("top").alias("top"))


@dataclass
class TermModel:
    """Fitted word and character features: term, analyzer, idf, max_abs and column number."""

    terms: DataFrame  # analyzer, term, idf, df, max_abs, idx; chosen = kept by the selection
    size: int

    @classmethod
    def fit(
        cls,
        train: DataFrame,
        label: str,
        col: str = "text",
        word_vocabulary: int = fv.WORD_VOCABULARY,
        char_vocabulary: int = fv.CHAR_VOCABULARY,
        word_selected: int = fv.WORD_SELECTED,
        char_selected: int = fv.CHAR_SELECTED,
    ) -> "TermModel":
        """Fit both blocks on the training posts. The model has at most 80 000 rows."""
        n, spark = train.count(), train.sparkSession
        vocabularies = {}
        for analyzer, size in ((WORD, word_vocabulary), (CHAR, char_vocabulary)):
            top = top_vocabulary(term_counts(train, analyzer, col), size)
            vocabularies[analyzer] = top.withColumn("idf", idf(n)).select("term", "idf").toArrow().combine_chunks()
        sums = pin(_class_sums(train, label, col, vocabularies), "class_sums")
        labels, blocks = train.select("post_id", label), []
        for analyzer, k in ((WORD, word_selected), (CHAR, char_selected)):
            at = pa.array(np.arange(len(vocabularies[analyzer]), dtype=np.int32))
            vocab = spark.createDataFrame(vocabularies[analyzer].append_column("at", at))
            mine = sums.filter(F.col("analyzer") == analyzer).join(vocab.select("at", "term"), "at")
            best = pin(select_k_best(_chi2(mine.filter("class is not null").select("term", "class", "o"), labels, label), k), "selected")
            top = mine.groupBy("term").agg(F.max("top").alias("max_abs"))
            chosen = best.join(top, "term").select("term", "max_abs", F.lit(True).alias("chosen"))
            blocks.append(vocab.join(chosen, "term", "left").select(
                F.lit(analyzer).alias("analyzer"), "term", "idf",
                F.coalesce("max_abs", F.lit(0.0)).alias("max_abs"),
                F.coalesce("chosen", F.lit(False)).alias("chosen"),
            ))
        # Number the chosen terms: the vocabulary is bounded, so one ordered window is enough.
        order = Window.partitionBy().orderBy(F.desc("analyzer"), "term")
        both = blocks[0].unionByName(blocks[1])
        chosen = both.filter("chosen").withColumn("idx", F.row_number().over(order) - 1)
        rest = both.filter("not chosen").withColumn("idx", F.lit(None).cast("int"))
        terms = pin(chosen.unionByName(rest), "terms")
        return cls(terms, terms.filter("chosen").count())

    def _entries(self) -> Callable[[gr.Slice], tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """A function that gives (post, idx, weight) of a slice that has the units of both analyzers, by post and idx."""
        table = self.terms.select("analyzer", "term", "idf", "max_abs", "idx").toArrow()
        held = {}
        for a in (WORD, CHAR):
            mine = table.filter(pc.equal(table.column("analyzer"), a)).combine_chunks()
            top = mine.column("max_abs").to_numpy()
            idx = np.asarray(pc.fill_null(mine.column("idx"), -1), np.int64)
            held[a] = gr._one(mine.column("term")), mine.column("idf").to_numpy(), np.where(top > 0, top, 1.0), idx
        shared, size = self.terms.sparkSession.sparkContext.broadcast(held), max(1, self.size)

        def run(part: gr.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            posts, columns, weights = [], [], []
            for a, (known, own, top, idx) in shared.value.items():
                post, place, tf, _ = gr.counted(a, gr._one(part.table.column(a)), part.post, known)
                weight = gr.weighed(post, place, tf, own) / top[place]
                kept = idx[place] >= 0
                posts.append(post[kept])
                columns.append(idx[place[kept]])
                weights.append(weight[kept])
            post, idx, weight = (np.concatenate(x) for x in (posts, columns, weights))
            order = np.argsort(post * size + idx, kind="stable")
            return post[order], idx[order].astype(np.int32), weight[order]

        return run

    @staticmethod
    def _texts(df: DataFrame, col: str, *keep: str, partitioned: bool = False, key: str = "post_id") -> DataFrame:
        """The posts by key, with the units of both analyzers and the columns to keep."""
        cols = list(dict.fromkeys([*keep, col]))
        texts = df.select(key, *cols) if partitioned else by_post(df, *cols, key=key, partitions=text_partitions(df, col, size=BLOCK_BYTES))
        return texts.select(key, *keep, *[_units(a, col).alias(a) for a in (WORD, CHAR)])

    def weights(self, df: DataFrame, col: str = "text", partitioned: bool = False) -> DataFrame:
        """(post_id, idx, weight) of the selected terms, scaled by their training maximum.

        The length of a post's vector counts the whole vocabulary, selected or not.
        """
        entries = self._entries()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in gr.slices(batches, "post_id", [WORD, CHAR]):
                post, idx, weight = entries(part)
                yield pa.RecordBatch.from_arrays([part.keys.take(pa.array(post)), pa.array(idx), pa.array(weight)], names=["post_id", "idx", "weight"])

        schema = StructType([df.schema["post_id"], StructField("idx", IntegerType()), StructField("weight", DoubleType())])
        return self._texts(df, col, partitioned=partitioned).mapInArrow(run, schema)

    def vectors(self, df: DataFrame, col: str = "text", out: str = "tfidf") -> DataFrame:
        """(post_id, vector); a post without any known term gets the empty vector, and so does a row without a key."""
        return self._vectors(df, col, out, [], lambda part, known: np.arange(len(part.post)))

    def attach(self, df: DataFrame, col: str = "text", out: str = "tfidf") -> DataFrame:
        """What `df` joined with its `vectors` by post_id gives, without a shuffle of vectors."""

        def rows(part: gr.Slice, known: np.ndarray) -> np.ndarray:
            times = np.bincount(part.post)[part.post]  # rows of one key meet all vectors of the key
            return np.repeat(np.arange(len(part.post)), np.where(known, times, 0))

        return self._vectors(df, col, out, [c for c in df.columns if c != "post_id"], rows)

    def _vectors(self, df: DataFrame, col: str, out: str, keep: list[str], rows_of: Callable[[gr.Slice, np.ndarray], np.ndarray]) -> DataFrame:
        entries, size = self._entries(), self.size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in gr.slices(batches, "post_id", [WORD, CHAR]):
                post, idx, weight = entries(part)
                keys = gr._one(part.table.column("post_id"))
                known = np.asarray(keys.is_valid().to_numpy(zero_copy_only=False), bool)
                at = rows_of(part, known)
                lists = pa.array(np.where(known, part.post, len(part.keys))[at])  # the last list is empty
                n = len(at)
                both = [gr.listed(x, post, len(part.keys) + 1).take(lists) for x in (idx, weight)]
                fields = [pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, size, np.int32)), *both]
                vectors = pa.StructArray.from_arrays(fields, ["type", "size", "indices", "values"])
                kept = [gr._one(part.table.column(c)).take(pa.array(at)) for c in ("post_id", *keep)]
                yield pa.RecordBatch.from_arrays([*kept, vectors], ["post_id", *keep, out])

        schema = StructType([*[df.schema[c] for c in ("post_id", *keep)], StructField(out, VectorUDT())])
        return self._texts(df, col, *keep).mapInArrow(run, schema)

    def save(self, path: str) -> None:
        self.terms.write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark, path: str) -> "TermModel":
        terms = spark.read.parquet(path)
        return cls(terms, terms.filter("chosen").count())
