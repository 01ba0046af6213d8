"""Training-data pipeline over `documents`: five stages, each written and read again before the next.

A stage takes (spark, docs, sf_dir) and returns the rows that it keeps, with the columns of
`documents`; the last one returns the encoded texts. Documents without text pass the stages like any
other; an empty table passes as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from postsift.llm import bpe, decontaminate, partenum, quality, suffix_dedup
from postsift.llm.queries import rank_file, table
from postsift.sources.staging import pin


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the ordinal classifier, trained on the labelled rows of `docs`, does not grade good."""
    graded = quality.grades_of(table(spark, sf_dir, "labels"))
    return quality.select_best(docs, quality.fit(docs, graded))


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each component of near copies (five words, 0.8)."""
    return partenum.without_near_copies(docs, size=5, percent=80)


def repeated_strings_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts strings of 50 bytes that an earlier document has; n_chars is counted anew."""
    from pyspark.sql import functions as F

    kept = suffix_dedup.without_repeats(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a test item."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the digests of ids and of the decoded bytes."""
    import public_tokenizers

    return bpe.round_trip(docs, rank_file(), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_copies_stage),
    ("suffix-array dedup", repeated_strings_stage),
    ("benchmark decontamination", benchmark_stage),
    ("byte-level BPE encoding and decoding", encode_stage),
]

#: The classifier and the suffix arrays have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = pin(docs, name.replace(" ", "-"))
    return docs
