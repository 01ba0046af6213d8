"""Streaming score: the batch plan applied to each arriving batch of texts.

Scoring a text needs no other text, so there is no state and no watermark. Counting copies needs all
texts and stays a batch filter.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from postsift import fixed_values as fv
from postsift.operators.filters import scorable


def score_stream(
    model: Any, stream: DataFrame, out: str, checkpoint: str, min_words: int = fv.SCORABLE_WORDS,
    clean: bool = True, trigger: dict[str, Any] | None = None,
) -> StreamingQuery:
    """Score (post_id, text) and write one Parquet folder per batch below `out`.

    A batch that runs again after a failure overwrites its own folder, so no row comes out twice.
    `trigger` are the arguments of the writer's trigger, by default all that has arrived so far.
    """

    def one(batch: DataFrame, number: int) -> None:
        ready = scorable(batch.select("post_id", "text"), min_words, "text")
        scored = model.score(ready, clean=clean)
        scored.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return (
        stream.writeStream.foreachBatch(one)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
