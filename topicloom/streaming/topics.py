"""Streaming forms: token counts by window, topic counts by window with late data, and scoring with a fitted model.

The stateless text functions apply to a stream unchanged. Corpus-level steps (document frequencies, phrases, fitting)
stay batch work; ``each_batch`` runs them on micro-batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def token_counts(stream: DataFrame, time: str, tokens: str, window: str = "1 day", late: str = "1 day", slide: str | None = None) -> DataFrame:
    """(start, token, n) for tumbling or sliding windows; rows later than ``late`` are dropped, state is bounded by it."""
    w = F.window("t", window, slide) if slide else F.window("t", window)
    rows = stream.select(F.col(time).cast("timestamp").alias("t"), F.explode(tokens).alias("token")).withWatermark("t", late)
    return rows.groupBy(w.alias("w"), "token").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "token", "n")


def topic_counts(stream: DataFrame, time: str, topic: str, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """(start, topic_id, n)."""
    rows = stream.select(F.col(time).cast("timestamp").alias("t"), F.col(topic).alias("topic_id")).withWatermark("t", late)
    return rows.groupBy(F.window("t", window).alias("w"), "topic_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "topic_id", "n")


def sessions(stream: DataFrame, time: str, who: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """(who, start, end, n): sessions of each user."""
    rows = stream.select(F.col(time).cast("timestamp").alias("t"), F.col(who).alias("who")).withWatermark("t", late)
    got = rows.groupBy("who", F.session_window("t", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return got.select("who", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def scored(stream: DataFrame, model, key: str) -> DataFrame:
    """(key, topic_id, score) of a stream by a fitted model of features and LDA."""
    from pyspark.ml.functions import vector_to_array

    from topicloom.operators.topics import assignments

    return assignments(model.transform(stream).withColumn("theta", vector_to_array("topicDistribution")), key, "theta")


def each_batch(stream: DataFrame, job: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """Run a batch job on every micro-batch; with ``once`` until what is there is used up."""
    writer = stream.writeStream.foreachBatch(job).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
