"""From a stream of records to tables by class."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from keelson.operators.dispatch import dispatch
from keelson.operators.retention import EPHEMERAL, classified


def start(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Classify, route and append each micro-batch once: a batch's number is part of its path, so a
    batch that is run again replaces what it wrote before. Ephemeral records are never written."""

    def write(batch: DataFrame, number: int) -> None:
        kept = dispatch(classified(batch)).where((F.col("class") != EPHEMERAL) & F.col("stored"))
        kept.write.mode("overwrite").partitionBy("class").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
