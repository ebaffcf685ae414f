"""Scans of streams: each micro-batch is a ready batch, planned and decided by itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..operators.scan import DecisionEngine


def scan_stream(stream: DataFrame, engine: DecisionEngine, question: str, out: str, key: str, **options) -> DataStreamWriter:
    """A writer that decides each micro-batch of ``stream`` and writes (key, decision, probabilities) to ``out`` by batch.

    A batch that is run again after a failure overwrites its own folder, so each row has one decision.
    """

    def decide(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        batch = batch.orderBy(key)
        result = engine.scan(batch, question, order_by=[key], **options)
        from ..sources.cells import of_dataframe

        keys = of_dataframe(batch, order_by=[key]).frame
        at = batch.columns.index(key)
        keys.selectExpr("_pos", f"_c{at} as `{key}`").join(result.frame.select("_pos", "decision", "probabilities"), "_pos").drop("_pos").write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(decide)
