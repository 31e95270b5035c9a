"""Verdicts over changes that keep arriving: fusion is a function of one change, so each micro-batch is a batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.fusion import fuse


def fuse_stream(changes: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Fuse each arriving micro-batch of change rows (fusion.NEEDS) and hand it to the sink."""
    return changes.writeStream.foreachBatch(lambda df, n: sink(fuse(df), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
