"""Masking a stream: detection and masking keep no state; the ledger grows batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from veilspark.operators.detect import detect, exploded
from veilspark.operators.ledger import entries_of
from veilspark.operators.mask import mask
from veilspark.sources.documents import read_ledger, write_ledger


def masked_stream(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """A streaming DataFrame with masked texts and marks."""
    return mask(detect(docs, text_col, **options), text_col)


def ledger_stream(docs: DataFrame, folder: str, checkpoint: str, id_col: str = "doc_id", **options) -> StreamingQuery:
    """Adds each batch's new entries to a ledger folder, as a part named by the stream and the batch: a batch that runs twice replaces its own part, and another stream over the same folder goes on after what is there. One stream at a time may write to a folder."""

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        name = f"stream-{spark.sparkContext.getLocalProperty('sql.streaming.queryId')}-{number}"
        found = exploded(detect(df, **options), id_col).withColumnRenamed(id_col, "doc_id")
        write_ledger(entries_of(found, read_ledger(spark, folder, but=name)), folder, name)

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
