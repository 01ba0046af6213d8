"""Materialised phase results: tables that cut lineage and tell Catalyst their true size.

A table written here outlives a lost executor. Reading it back gives the optimiser the size of
its files, so a small fitted table is broadcast under `spark.sql.autoBroadcastJoinThreshold` and
a large one is joined by a shuffle, without a hint that could be wrong.
"""

from __future__ import annotations

import hashlib
import json
import re
import tempfile
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Temporary folders of local sessions without a shared one, by application.
_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one for a local session without it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master, app = spark.sparkContext.master, spark.sparkContext.applicationId
    if not re.match(r"local(\[|$)", master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="postsift-")
    return _LOCAL_DIRS[app]


def _read_back(df: DataFrame, path: str) -> DataFrame:
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pin(df: DataFrame, name: str = "table") -> DataFrame:
    """Write `df` once to the shared folder and go on from the written table."""
    path = f"{shared_dir(df.sparkSession)}/postsift/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return _read_back(df, path)


def fingerprint(config: dict[str, Any], *inputs: DataFrame) -> str:
    """Hash of a configuration and of the inputs' schema, row count and content."""
    parts: list[Any] = [json.dumps(config, sort_keys=True, default=str)]
    for df in inputs:
        # Two sums of row hashes: independent of row order, and one row of output.
        row = F.struct(*[F.to_json(c) if t.startswith("map") else F.col(c) for c, t in df.dtypes])
        stats = df.agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.xxhash64(row).cast("decimal(38,0)")).alias("a"),
            F.sum(F.xxhash64(F.lit(1), row).cast("decimal(38,0)")).alias("b"),
        ).first()
        parts.append([df.schema.simpleString(), stats["n"], str(stats["a"]), str(stats["b"])])
    return hashlib.sha256(json.dumps(parts).encode()).hexdigest()[:24]


def _written(spark: SparkSession, path: str) -> bool:
    """True when `path` holds a table whose write was committed."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def stage(
    df: DataFrame | Callable[[], DataFrame], root: str, name: str, key: str,
    spark: SparkSession | None = None,
) -> DataFrame:
    """Reuse the phase result `name` written under this fingerprint, or compute and write it.

    `df` may be a function, which is then called only when there is nothing to reuse.
    """
    spark = spark or (df.sparkSession if isinstance(df, DataFrame) else SparkSession.active())
    path = f"{root.rstrip('/')}/{name}/fingerprint={key}"
    if not _written(spark, path):
        result = df if isinstance(df, DataFrame) else df()
        # An uncommitted leftover of a failed run is overwritten.
        result.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def resumable_apply(
    df: DataFrame,
    fn: Callable[[DataFrame], DataFrame],
    out: str,
    key: str = "post_id",
    slices: int = 1,
    run: str | None = None,
) -> DataFrame:
    """Apply a row-wise `fn` and keep finished rows on disk, so that a rerun does the rest only.

    The rows are worked off in `slices` by a hash of the key; each slice is one committed write and
    one scan of the input, so a few slices are enough: within a slice Spark retries lost tasks.
    The result belongs to one fingerprint of the input: a changed input starts anew.
    """
    spark = df.sparkSession
    run = run or fingerprint({"key": key}, df)
    root = f"{out.rstrip('/')}/run={run}"
    for i in range(slices):
        path = f"{root}/slice={i}-of-{slices}"
        if not _written(spark, path):
            part = df if slices == 1 else df.filter(F.pmod(F.xxhash64(key), F.lit(slices)) == i)
            fn(part).write.mode("overwrite").parquet(path)
    return spark.read.option("basePath", root).parquet(
        *[f"{root}/slice={i}-of-{slices}" for i in range(slices)]
    ).drop("slice")
