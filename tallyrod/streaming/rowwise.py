"""Row-wise operators on streams: those without a global order run on a streaming DataFrame as they are."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def run_available(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Applies an operator to what the stream holds now and appends the result as Parquet; a later call goes on from the
    checkpoint, which is how resumed batch work is done here."""
    return operator(stream).writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)
