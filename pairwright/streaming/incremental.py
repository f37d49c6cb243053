"""Linking a stream of new records against a stored table: blocking is per record, so each micro-batch stands alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import blocking, embedding
from ..sources.shared import materialise


def link_stream(records: DataFrame, stored: DataFrame, attributes: list[str], out: str, checkpoint: str, table_count: int = 5, planes: int = 8, flips: int = 1, top_k: int = 5, embedder=None, key: str = "id", seed: int = 42, once: bool = False) -> StreamingQuery:
    """Writes (idA, idB, sim, rank) of every record of a streaming DataFrame to Parquet at `out`.

    The stored records are embedded once, before the first batch.  The batch number is part of a batch's folder, so
    a batch that runs again replaces its own output.
    """
    known = materialise(embedding.embed(stored, attributes, embedder, key), "stored-vectors")

    def batch(df: DataFrame, number: int) -> None:
        found = blocking.block(embedding.embed(df, attributes, embedder, key), known, table_count, planes, flips, top_k, seed)
        found.write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = records.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
