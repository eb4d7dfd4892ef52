"""Detection on a stream of artifacts: detectors are stateless, the rest runs by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from idlens.plans.scan import scan


def scan_stream(artifacts: DataFrame, sink: Callable[[dict[str, DataFrame], int], None], checkpoint: str, key: bytes, arrived: str = "arrived_at", late: str = "1 hour", run: Callable[[DataFrame, bytes], dict[str, DataFrame]] = scan) -> StreamingQuery:
    """``run`` each micro-batch of new artifacts; the same content at the same path counts once within ``late``."""
    fresh = artifacts.withWatermark(arrived, late).dropDuplicatesWithinWatermark(["repo", "path", "content_sha"])

    def batch(df: DataFrame, number: int) -> None:
        sink(run(df, key), number)

    return fresh.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
