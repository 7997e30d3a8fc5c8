"""Word frequencies, the spelling index and the repair of cut words, as joins.

No frequency list is shipped: the Zipf value of a word, log10 of its occurrences per thousand million, is taken from a
table (token, zipf) that the caller has or that ``zipf_table`` counts over a collection.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicloom.operators.joins import lookup
from topicloom.session import ship, written


def zipf_table(tokens: DataFrame) -> DataFrame:
    """(token, n, zipf) over the long form of a collection."""
    counts = written(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")), "counts")
    total = counts.agg(F.sum("n").alias("total"))
    return counts.select("token", "n", F.round(F.log10(F.col("n") * 1e9 / total.scalar()), 6).alias("zipf"))


def spelling_index(lexicon: DataFrame, words: int = 80_000) -> DataFrame:
    """(key, word, zipf): for each key the most frequent word that it may stand for.

    The keys of a word are itself, itself without its first letter (from 4 letters on), without its last (4) or last
    two (5), and its prefixes of 4 to 10 letters; keys of 3 letters at least. Equal frequencies go to the earlier word.
    """
    top = lexicon.where(F.col("token").rlike("^[a-z]{3,30}$")).orderBy(F.desc("zipf"), "token").limit(words)
    n = F.length("token")
    keys = F.array_distinct(
        F.filter(
            F.concat(
                F.array(F.col("token")),
                F.when(n >= 4, F.array(F.expr("substr(token, 2)"), F.expr("left(token, length(token) - 1)"))).otherwise(F.array().cast("array<string>")),
                F.when(n >= 5, F.array(F.expr("left(token, length(token) - 2)"))).otherwise(F.array().cast("array<string>")),
                F.when(n >= 4, F.transform(F.sequence(F.lit(4), F.least(F.lit(10), n)), lambda i: F.substr("token", F.lit(1), i))).otherwise(F.array().cast("array<string>")),
            ),
            lambda k: F.length(k) >= 3,
        )
    )
    rows = top.select(F.explode(keys).alias("key"), F.col("token").alias("word"), "zipf")
    return rows.groupBy("key").agg(F.min_by(F.struct("word", "zipf"), F.struct((-F.col("zipf")).alias("z"), "word")).alias("best")).select("key", "best.word", "best.zipf")


def corrections(types: DataFrame, lexicon: DataFrame, index: DataFrame, threshold: float = 2.5) -> DataFrame:
    """(token, repaired) of the token types (token) that are mended: plain words that aren't frequent enough, where the index's
    word for them is."""
    known = types.select("token").distinct().join(lexicon.select("token", "zipf"), "token", "left").join(index.select(F.col("key").alias("token"), "word", F.col("zipf").alias("word_zipf")), "token")
    rare = F.col("token").rlike("^[a-z]{3,30}$") & (F.coalesce("zipf", F.lit(-1.0)) < threshold)
    return known.where(rare & (F.col("word_zipf") >= threshold) & (F.col("word") != F.col("token"))).select("token", F.col("word").alias("repaired"))


def repaired(tokens: DataFrame, lexicon: DataFrame, index: DataFrame, threshold: float = 2.5) -> DataFrame:
    """The long form with ``repaired``: a token itself if frequent enough or no plain word, else the index's word for it if
    that is frequent enough. Only the types that change are looked up, and a hot token isn't sent to one task."""
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("__n"))
    table = written(counts.join(corrections(counts, lexicon, index, threshold), "token"), "corrections")
    rows = lookup(tokens, table, ["token"], "__n", "left").drop("__n")
    return rows.withColumn("repaired", F.coalesce("repaired", "token"))


#: Corrections that tasks hold; more are joined.
HELD_WORDS = 500_000


def mend(rows: DataFrame, key: str, table: DataFrame) -> DataFrame:
    """(key, tokens) with the tokens of ``table`` (token, repaired) replaced where they stand."""
    table = written(table.select("token", "repaired"), "corrections")
    got = table.limit(HELD_WORDS + 1).collect()
    if len(got) > HELD_WORDS:
        rows = written(rows.select(key, "tokens").withColumn("__row", F.monotonically_increasing_id()), "unmended")
        long = rows.select("__row", F.posexplode("tokens").alias("pos", "token"))
        counts = long.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
        fixed = lookup(long, written(counts.join(table, "token"), "corrections"), ["token"], "n", "left")
        lists = fixed.groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("repaired", "token").alias("t")))).alias("l"))
        return rows.join(lists, "__row", "left").select(key, F.coalesce(F.col("l.t"), F.array().cast("array<string>")).alias("tokens"))
    ship(rows.sparkSession)
    held = rows.sparkSession.sparkContext.broadcast(([r.token for r in got], [r.repaired for r in got]))
    rows = rows.select(F.col(key), F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        old, new = (pa.array(x, pa.string()) for x in held.value)
        for batch in batches:
            lists = batch.column(1)
            values = lists.flatten().cast(pa.string())
            values = pc.coalesce(new.take(pc.index_in(values, old)), values)
            sizes = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), values)], [key, "tokens"])

    return rows.mapInArrow(run, rows.schema)


def merge_prefixes(df: DataFrame, key: str, prefixes: list[str], vocabulary: DataFrame) -> DataFrame:
    """Join words that a line break cut in two: a prefix of the list and the next token become one token if that is in
    the vocabulary (token). Input and output are the long form (key, pos, token)."""
    w = Window.partitionBy(key).orderBy("pos")
    rows = df.withColumn("next", F.lead("token").over(w)).withColumn("whole", F.when(F.col("token").isin(*prefixes), F.concat("token", "next")))
    wanted = rows.where("whole is not null").groupBy("whole").agg(F.count(F.lit(1)).alias("__n"))
    hits = written(wanted.join(vocabulary.select(F.col("token").alias("whole")), "whole", "left_semi"), "whole")
    rows = lookup(rows, hits, ["whole"], "__n", "left").withColumn("hit", F.col("__n").isNotNull()).drop("__n")
    rows = rows.withColumn("eaten", F.coalesce(F.lag("hit").over(w), F.lit(False)))
    return rows.where(~F.col("eaten")).select(key, "pos", F.when(F.col("hit"), F.col("whole")).otherwise(F.col("token")).alias("token"))
