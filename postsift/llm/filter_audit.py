"""Filter interaction audit by incremental retraction over a stream of files.

Five filters, each failing a text (null is empty; words are `[^\\x20\\x09-\\x0D]+`, case-sensitive):
A under 50 words; B 100 * distinct words < 65 * words; C 100 * `[A-Z]` > 5 * code points; D one of
`#$%&*|`; E identical to the text of any smaller key, table-wide. A document's mask has a bit per
failed filter. All figures of the audit follow from the number of documents per part and mask.

All files are worked off as available-now micro-batches. A to D are known from the text itself; E depends
on what other files hold. The state holds, for the digest of each text, the least key so far and the
counters of its rows. When a smaller key arrives, the masks counted for the former least key are retracted
from the counters of their parts and counted again with E. So after each batch the counters are those
of all rows so far, whatever the order of the files.

State is kept by ranges of digests, `BUCKET_BYTES` of text a range, since a call per text would cost
milliseconds each; a range is a table of its texts, merged with the arriving rows by one sort. Before
rows are sent there, each task keeps one candidate per text, its rows of the least key, and sums the
others, which are copies for certain; a text that a third of all rows have costs one row per task. A
batch that runs again after a failure starts from the last committed state and overwrites its own
counters.

Rows that share a key are no copies of each other. A null key is smaller than none: the row never
fails E, nor does another because of it. Labels may have several rows per key; one that says so counts.
Null parts count as the empty string. An empty table gives no row.
"""

from __future__ import annotations

import itertools
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from postsift.sources.staging import shared_dir

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
#: Texts that a task keeps candidates of, before it sends them on.
CANDIDATES = 200_000
#: Micro-batches that the files are dealt to, at least; more if a batch would pass BATCH_BYTES.
BATCHES = 4
BATCH_BYTES = 256 << 30
#: File bytes whose texts share one range of digests, and the least number of ranges.
BUCKET_BYTES = 16 << 20
BUCKETS = 64

#: Rows of a text's least key, and rows that are settled, without digest and key.
_ROW = "bucket int, settled boolean, digest binary, key long, part string, mask int, good boolean, toxic boolean, n long"
_DELTA = "part string, mask int, good boolean, toxic boolean, n long"
_WHAT = ["part", "mask", "good", "toxic"]


def failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    t = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(t, r"[\x20\x09-\x0D]+"), "")
    counted = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d")))[0]
    capitals = F.length(t) - F.length(F.regexp_replace(t, "[A-Z]+", ""))
    tests = F.transform(F.array(counted), lambda c: (
        F.when(c["n"] < 50, 1).otherwise(0) + F.when(100 * c["d"] < 65 * c["n"], 2).otherwise(0)
    ))[0]
    return tests + F.when(100 * capitals > 5 * F.length(t), 4).otherwise(0) + F.when(t.rlike(r"[#$%&*|]"), 8).otherwise(0)


def _candidates(buckets: int):
    """For each task: the rows of the least key of each of its texts; all other rows are settled, and summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple[int, Counter]] = {}
        settled: Counter = Counter()

        def flush() -> pa.RecordBatch:
            rows = [(int.from_bytes(d[:4], "big") * buckets >> 32, False, d, k, *what, n)
                    for d, (k, counts) in held.items() for what, n in counts.items()]
            rows += [(hash(what[1:]) % buckets, True, None, None, *what, n) for what, n in settled.items()]
            held.clear()
            settled.clear()
            kinds = (pa.int32(), pa.bool_(), pa.binary(), pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.bool_(), pa.int64())
            names = [c.split()[0] for c in _ROW.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            for digest, key, *what in zip(*(c.to_pylist() for c in batch.columns)):
                what = tuple(what)
                if key is None:
                    settled[what] += 1
                    continue
                least, counts = held.get(digest) or (None, None)
                if least is None or key < least:
                    if counts:
                        settled.update(_copies(counts))
                    held[digest] = (key, Counter([what]))
                elif key == least:
                    counts[what] += 1
                else:
                    settled.update(_copies(Counter([what])))
            if len(held) + len(settled) >= CANDIDATES:
                yield flush()
        if held or settled:
            yield flush()

    return run


def _copies(counts: Counter) -> Counter:
    return Counter({(part, mask | COPY, good, toxic): n for (part, mask, good, toxic), n in counts.items()})


def _retract(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Changes of the part counters that the rows of one range of digests bring."""
    new = pd.concat(list(frames))
    change = [new.loc[new["settled"], [*_WHAT, "n"]]]
    rows = new.loc[~new["settled"], ["digest", "key", *_WHAT, "n"]]
    if len(rows):
        if state.exists:
            known = pa.ipc.open_stream(state.get[0]).read_all().to_pandas()
            change.append(known[[*_WHAT, "n"]].assign(n=-known["n"]))  # retracted, and counted anew below
            rows = pd.concat([known, rows])
        least = rows.groupby("digest", sort=False)["key"].transform("min")
        own = rows["key"] == least
        change += [rows.loc[own, [*_WHAT, "n"]], rows.loc[~own, [*_WHAT, "n"]].assign(mask=rows.loc[~own, "mask"] | COPY)]
        kept = rows[own].groupby(["digest", "key", *_WHAT], sort=False, as_index=False)["n"].sum()
        held = pa.Table.from_pandas(kept, preserve_index=False).replace_schema_metadata(None)
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, held.schema) as writer:
            writer.write_table(held)
        state.update((out.getvalue().to_pybytes(),))
    summed = pd.concat(change).groupby(_WHAT, as_index=False)["n"].sum()
    yield summed[summed["n"] != 0]


def _layout(spark: SparkSession, path: str) -> tuple[int, int]:
    """Files of one micro-batch, from a listing, and ranges of digests, from the bytes of the files."""
    files = spark.read.parquet(path).inputFiles()
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    total = root.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(root).getLength()
    return max(1, len(files) // max(BATCHES, -(-total // BATCH_BYTES))), max(BUCKETS, total // BUCKET_BYTES)


def _exists(spark: SparkSession, path: str) -> bool:
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root)


def counters(
    spark: SparkSession, path: str, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source",
    folder: str | None = None, files: int | None = None,
) -> DataFrame:
    """part, mask, good, toxic, n: the counters after all micro-batches over the Parquet table at `path`.

    `folder` holds the stream's progress, its state and the changes of each batch; a later call with it
    goes on with the files that came since. `files` is the number of files of a micro-batch."""
    folder = folder or f"{shared_dir(spark)}/postsift/audit-{uuid.uuid4().hex}"
    path = path.rstrip("/")
    per_batch, buckets = _layout(spark, path)
    if _exists(spark, f"{folder}/layout/_SUCCESS"):  # a state keeps the ranges that it began with
        buckets = spark.read.parquet(f"{folder}/layout").first()["buckets"]
    else:
        spark.createDataFrame([(buckets,)], "buckets long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/layout")
    schema = spark.read.parquet(path).schema
    # A pattern that matches the path alone: the source takes a pattern for a single file, too.
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files or per_batch)
    rows = stream.parquet(f"{path[:-1]}[{path[-1]}]")
    rows = rows.select(
        F.col(key).cast("long").alias("key"), F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 32)).alias("digest"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), failures(F.col(text)).alias("mask"),
    )
    flags = labels.filter(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("key")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("bad"),
    )
    rows = rows.join(flags, "key", "left").select(
        "digest", "key", "part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("bad", F.lit(False)).alias("toxic")
    )
    rows = rows.select("digest", "key", "part", "mask", "good", "toxic")
    changes = rows.mapInArrow(_candidates(buckets), _ROW).groupBy("bucket").applyInPandasWithState(
        _retract, _DELTA, "texts binary", "update", GroupStateTimeout.NoTimeout
    )

    def write(batch: DataFrame, number: int) -> None:
        summed = batch.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))
        summed.write.mode("overwrite").parquet(f"{folder}/changes/batch={number}")

    sink = changes.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{folder}/stream")
    sink.trigger(availableNow=True).start().awaitTermination()
    if not _exists(spark, f"{folder}/changes"):
        return spark.createDataFrame([], _DELTA)
    summed = spark.read.schema(_DELTA).parquet(f"{folder}/changes").groupBy("part", "mask", "good", "toxic")
    return summed.agg(F.sum("n").alias("n")).filter("n <> 0")


def _steps() -> tuple[list[str], list[int], list[str], dict[str, np.ndarray]]:
    """Order, step and filter of each of the 600 steps, and per figure which masks a step counts, with what weight."""
    mask = np.arange(32)
    size = np.bitwise_count(mask)
    orders, numbers, letters, bits, past = [], [], [], [], []
    for order in itertools.permutations(FILTERS):
        for i, f in enumerate(order):
            orders.append("".join(order))
            numbers.append(i + 1)
            letters.append(f)
            bits.append(1 << FILTERS.index(f))
            past.append(sum(1 << FILTERS.index(g) for g in order[:i]))
    fails = (mask & np.array(bits)[:, None]) != 0
    gone = (mask & np.array(past)[:, None]) != 0
    weights = {
        "kept": ~fails & ~gone, "removed": fails & ~gone, "redundant": fails & gone, "unique_fails": fails & (size == 1),
        "good_lost": fails & ~gone, "toxic_lost": fails & ~gone,
        "shapley": fails * (120 // np.maximum(size, 1)),  # orders in which the filter is the first of the mask's
    }
    return orders, numbers, letters, {k: w.astype(np.int64).T for k, w in weights.items()}


def audit(counts: DataFrame) -> DataFrame:
    """part, filter_order, step, filter and the figures of each step of all orders of the filters."""
    # One row per part first, with its numbers by mask; the steps are made from that row.
    names = ["all", "good", "toxic"]
    by_mask = {"all": F.col("n"), "good": F.when(F.col("good"), F.col("n")), "toxic": F.when(F.col("toxic"), F.col("n"))}
    sums = [F.sum(F.when(F.col("mask") == m, v)).alias(f"{name}{m}") for name, v in by_mask.items() for m in range(32)]
    parts = counts.groupBy("part").agg(*sums).select("part", *[
        F.array(*[F.coalesce(f"{name}{m}", F.lit(0).cast("long")) for m in range(32)]).alias(name) for name in by_mask
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders, numbers, letters, weights = _steps()
        for batch in batches:
            for at in range(batch.num_rows):
                n = {name: np.array(batch.column(1 + i)[at].as_py()) for i, name in enumerate(names)}
                of = {"good_lost": "good", "toxic_lost": "toxic"}
                yield pa.RecordBatch.from_arrays([
                    pa.array([batch.column(0)[at].as_py()] * len(orders), pa.string()), pa.array(orders),
                    pa.array(numbers, pa.int32()), pa.array(letters),
                    *(pa.array(n[of.get(name, "all")] @ w, pa.int64()) for name, w in weights.items()),
                ], names=["part", "filter_order", "step", "filter", *weights])

    return parts.mapInArrow(run, (
        "part string, filter_order string, step int, filter string, kept long, removed long, redundant long, "
        "unique_fails long, good_lost long, toxic_lost long, shapley long"
    ))
