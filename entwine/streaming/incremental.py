"""Linking records as they arrive (an extension: the batch operators over micro-batches)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from entwine.functions.similarity import jaccard_col
from entwine.operators.decision import decide


def link_stream(arriving: DataFrame, entities: DataFrame, out: str, checkpoint: str, tau: float = 0.5) -> StreamingQuery:
    """Match each arriving record (c, words) to its best entity (s, words) by shared words, exactly once per micro-batch.

    A micro-batch overwrites its own folder, so a repeated one leaves no double rows.
    """
    index = entities.select("s", F.col("words").alias("ws"), F.explode(F.array_distinct("words")).alias("w"))

    def batch(df: DataFrame, number: int) -> None:
        new = df.select("c", F.col("words").alias("wc"), F.explode(F.array_distinct("words")).alias("w"))
        pairs = new.join(index, "w").dropDuplicates(["s", "c"]).select("s", "c", jaccard_col(F.col("ws"), F.col("wc")).alias("p"))
        decide(pairs, tau).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return arriving.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
