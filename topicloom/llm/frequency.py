"""Occurrences and records of every distinct token, with the too rare and too common ones marked (problem 6).

Last-seen counters: records are hash-partitioned by their id and read in the order of the id. Each token holds its
occurrences, its records and the last record it was seen in; the records go up only when the last record is another
one, so no set is kept for a record, and a record delivered twice counts once. The partial counters of the partitions
are added by an ordinary aggregate, which is exact because no record lies in two partitions.

Equal deliveries of one record within an Arrow batch are merged before the shuffle. A record with more than
``HOT_DELIVERIES`` rows left, as null may be, isn't put into one partition: its tokens are counted by ordinary aggregates, occurrences by
their sum and records by distinct pairs of record and token. Counters are handed on at the end of a record when there
are many, which bounds a task's memory whatever the vocabulary.

Defined cases: null and blank token texts give no token and no record; a null record id counts as one record of its
own; tokens are taken as written and separated by white space; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.session import written

#: Counters held by a task before they are handed on.
MOST_COUNTERS = 500_000
#: Deliveries of one record, from which on its rows are spread.
HOT_DELIVERIES = 50_000
RARE_BELOW = 10
COMMON_SHARE = 0.6


# the characters that Python's split() divides at
WHITE = r"[\s\x0b\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = pa.Table.from_batches([batch]).group_by(["rec", "tokens"]).aggregate([([], "count_all")])
        yield from got.rename_columns(["rec", "tokens", "times"]).select(["rec", "tokens", "times"]).to_batches()


def _last_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(counters: dict[str, list], records: int) -> pa.RecordBatch:
        # the null token carries the number of records
        tokens = [*counters, None]
        return pa.RecordBatch.from_arrays(
            [pa.array(tokens, pa.string()), pa.array([*(c[0] for c in counters.values()), 0], pa.int64()), pa.array([*(c[1] for c in counters.values()), records], pa.int64())],
            ["token", "occurrences", "records"],
        )

    counters: dict[str, list] = {}
    records, current, at = 0, object(), 0
    for batch in batches:
        for rec, tokens, times in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            words = tokens.split()
            if not words:
                continue
            if rec != current:
                if len(counters) > MOST_COUNTERS:
                    yield out(counters, records)
                    counters, records = {}, 0
                current, at = rec, at + 1
                records += 1
            for word, n in Counter(words).items():
                seen = counters.get(word)
                if seen is None:
                    counters[word] = [n * times, 1, at]
                else:
                    seen[0] += n * times
                    if seen[2] != at:
                        seen[1] += 1
                        seen[2] = at
    if counters or records:
        yield out(counters, records)


def token_counts(df: DataFrame, rec: str, tokens: str) -> DataFrame:
    """(token, occurrences, records) over the whole table, and one row with a null token whose records are N.

    Occurrences are counted in every delivery, records once.
    """
    kind = df.schema[rec].dataType.simpleString()
    rows = df.select(F.col(rec).alias("rec"), F.col(tokens).cast("string").alias("tokens")).where(F.col("tokens").isNotNull())
    rows = rows.where(F.col("tokens").rlike(r"\S"))
    counts = rows.groupBy("rec").agg(F.count(F.lit(1)).alias("n"))
    hot = written(counts.where(F.col("n") > HOT_DELIVERIES).select(F.col("rec").alias("hot"), F.lit(True).alias("is_hot")), "hot")
    parts = []
    if not hot.isEmpty():
        # there can't be many hot records: all rows by HOT_DELIVERIES
        rows = rows.join(F.broadcast(hot), F.col("rec").eqNullSafe(F.col("hot")), "left").drop("hot")
        long = rows.where("is_hot").select("rec", F.explode(F.filter(F.split("tokens", WHITE), lambda t: t != "")).alias("token"))
        pairs = long.groupBy("rec", "token").agg(F.count(F.lit(1)).alias("occurrences"))
        parts.append(pairs.select("token", "occurrences", F.lit(1).cast("bigint").alias("records")))
        parts.append(hot.select(F.lit(None).cast("string").alias("token"), F.lit(0).cast("bigint").alias("occurrences"), F.lit(1).cast("bigint").alias("records")))
        rows = rows.where("is_hot is null").drop("is_hot")
    merged = rows.mapInArrow(_merged, f"rec {kind}, tokens string, times bigint")
    ordered = merged.repartition(F.col("rec")).sortWithinPartitions("rec")
    partial = ordered.mapInArrow(_last_seen, "token string, occurrences bigint, records bigint")
    for part in parts:
        partial = partial.unionByName(part)
    return partial.groupBy("token").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def marked_tokens(df: DataFrame, rec: str, tokens: str, rare_below: int = RARE_BELOW, common_share: float = COMMON_SHARE) -> DataFrame:
    """(token, occurrences, records, mark); the mark is ``rare``, ``common`` or null. Rare wins where both would hold."""
    counts = written(token_counts(df, rec, tokens), "tokens")
    total = counts.where("token is null").select("records").first()
    least = math.ceil(round(common_share * (total.records if total else 0), 9))
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") >= least, "common")
    return counts.where("token is not null").withColumn("mark", mark)
