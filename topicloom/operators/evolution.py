"""Topics over time: counts by period and the links between the topics of consecutive retained periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRAINS = {"M": "month", "Q": "quarter", "Y": "year", "W": "week", "D": "day"}


def period(time: Column | str, grain: str = "M") -> Column:
    """The start of the period, without zone; what is no time gives null."""
    c = F.col(time) if isinstance(time, str) else time
    return F.date_trunc(GRAINS[grain], c.try_cast("timestamp_ntz")).cast("timestamp_ntz")


def counts(df: DataFrame, time: str, topic: str, grain: str = "M") -> DataFrame:
    """(period, topic_id, n)."""
    rows = df.select(period(time, grain).alias("period"), F.col(topic).alias("topic_id")).where("period is not null")
    return rows.groupBy("period", "topic_id").agg(F.count(F.lit(1)).alias("n"))


def retained(rows: DataFrame, least: int = 10) -> DataFrame:
    """(period, topic_id, n, ord) of the periods with enough documents, numbered in order.

    The numbering is a window over the distinct periods alone.
    """
    totals = rows.groupBy("period").agg(F.sum("n").alias("total")).where(F.col("total") >= least)
    order = totals.select("period", F.row_number().over(Window.orderBy("period")).alias("ord"))
    return rows.join(order, "period")


def edges(rows: DataFrame, words: DataFrame, least: float = 0.35) -> DataFrame:
    """(source_period, source_topic, target_period, target_topic, value) from retained counts and (topic_id, words array).

    The similarity is the Jaccard index of the word sets, or 1 and 0 for equal and different topics where a set is
    empty; the value is the smaller count times the similarity. Weights of 0 give no edge.
    """
    sets = words.select(F.col("topic_id"), F.array_distinct(F.coalesce("words", F.array().cast("array<string>"))).alias("s"))
    full = rows.join(sets, "topic_id", "left").withColumn("s", F.coalesce("s", F.array().cast("array<string>")))
    a = full.select(F.col("ord").alias("o"), F.col("period").alias("source_period"), F.col("topic_id").alias("source_topic"), F.col("n").alias("c0"), F.col("s").alias("s0"))
    b = full.select((F.col("ord") - 1).alias("o"), F.col("period").alias("target_period"), F.col("topic_id").alias("target_topic"), F.col("n").alias("c1"), F.col("s").alias("s1"))
    empty = (F.size("s0") == 0) | (F.size("s1") == 0)
    overlap = F.size(F.array_intersect("s0", "s1")) / F.greatest(F.lit(1), F.size(F.array_union("s0", "s1")))
    similar = F.when(empty, F.when(F.col("source_topic") == F.col("target_topic"), 1.0).otherwise(0.0)).otherwise(overlap)
    out = a.join(b, "o").withColumn("sim", similar).where(F.col("sim") >= least).withColumn("value", F.round(F.least("c0", "c1") * F.col("sim"), 6)).where("value > 0")
    return out.select("source_period", "source_topic", "target_period", "target_topic", "value")


def nodes(rows: DataFrame, links: DataFrame) -> DataFrame:
    """(id, period, topic_id, label): topics of all retained periods but the last, and targets of edges in the last."""
    last = rows.agg(F.max("ord").alias("last"))
    left = rows.where(F.col("ord") < last.scalar()).select("period", "topic_id")
    right = links.select(F.col("target_period").alias("period"), F.col("target_topic").alias("topic_id"))
    all_ = left.union(right).distinct()
    label = F.concat(F.date_format("period", "yyyy-MM"), F.lit(" · T"), (F.col("topic_id") + 1).cast("string"))
    return all_.select((F.row_number().over(Window.orderBy("period", "topic_id")) - 1).alias("id"), "period", "topic_id", label.alias("label"))
