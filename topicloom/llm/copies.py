"""Records that differ only in formatting: one record for each, with the number of copies (problem 2).

Each field is reduced to its letters and digits in sequence, without case. Every (field name, value) pair is hashed
and the hashes are combined by addition, which doesn't depend on the order of the pairs: a commutative multiset hash.
Fields that may stand for each other carry the same name. Records are grouped by the 128-bit fingerprint; the fields
of the members of a group are then held against each other by grouping them by their values, in any order and without
sorting. Where a group turns out to hold different values (a hash collision), its records are told apart by these.

The reduced fields are written once. Only ids and fingerprints go through the first aggregate, so a group that holds a
third of all rows costs one long a row and is combined on the map side; so is the grouping by values, which
covers the repeated fingerprints alone. The table of these finds its rows by ``operators.joins.lookup``: the texts stay where they are as long
as it can be broadcast, and a hot group never meets in one task.

Defined cases: a null, blank or letterless field is absent; a record without letters or digits in any of its fields
is no case; unchanged repeats are copies; the same row id twice counts as two copies; extra columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicloom.operators.joins import lookup
from topicloom.session import written

#: What is no letter, mark or digit.
OTHER = r"[^\p{L}\p{M}\p{Nd}]"


@F.pandas_udf(T.StringType())
def _composed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield s.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def essence(c: Column) -> Column:
    """The letters and digits of a text in sequence without case; null where there are none.

    Upper case first, then lower, since some letters have two small forms; the sharp s counts as two. Accents are kept: composed and decomposed
    ones are the same letter. Only texts with combining marks leave the JVM for that.
    """
    c = F.regexp_replace(F.replace(F.lower(F.upper(c)), F.lit("ß"), F.lit("ss")), OTHER, "")
    return F.when(F.length(c) > 0, c)


def with_essence(df: DataFrame, names: list[str]) -> DataFrame:
    """Replace the columns by their essence."""
    for name in names:
        c = F.col(name)
        composed = _composed(F.when(c.rlike(r"\p{M}"), c))
        df = df.withColumn(name, F.coalesce(composed, c))
    for name in names:
        df = df.withColumn(name, essence(F.col(name)))
    return df


def fingerprints(df: DataFrame, key: str, pairs: dict[str, str], alone: str | None = None) -> DataFrame:
    """(id, a, b, h1, h2): the two reduced fields, and the multiset hash of the (name, value) pairs.

    ``pairs`` maps two columns to their names: the same name for both makes them interchangeable. Where both columns are
    null, column ``alone`` is taken instead, under a name of its own.
    """
    (one, name_one), (two, name_two) = pairs.items()
    rows = df.select(F.col(key).alias("id"), F.col(one).cast("string").alias("a"), F.col(two).cast("string").alias("b"), (F.col(alone) if alone else F.lit(None)).cast("string").alias("c"))
    neither = F.col("a").isNull() & F.col("b").isNull()
    rows = rows.withColumn("c", F.when(neither, F.col("c")))
    rows = with_essence(rows, ["a", "b", "c"])
    only = F.col("c").isNotNull()

    def part(name: str, value: Column, seed: int) -> Column:
        # 62 bits of each hash, so that three of them can be added without overflow
        return F.coalesce(F.shiftright(F.xxhash64(F.lit(seed), F.lit(name), value), 2), F.lit(0))

    def total(seed: int) -> Column:
        a = F.when(F.col("a").isNotNull(), part(name_one, F.col("a"), seed)).otherwise(0)
        b = F.when(F.col("b").isNotNull(), part(name_two, F.col("b"), seed)).otherwise(0)
        c = F.when(only, part("alone", F.col("c"), seed)).otherwise(0)
        return F.shiftright(a, 1) + F.shiftright(b, 1) + F.shiftright(c, 1)

    rows = rows.where(F.coalesce("a", "b", "c").isNotNull())
    return rows.select("id", F.coalesce("a", "c").alias("a"), "b", only.alias("alone"), total(1).alias("h1"), total(2).alias("h2"))


def groups(df: DataFrame, key: str, pairs: dict[str, str], alone: str | None = None) -> DataFrame:
    """(id, first): each record that has copies, with the smallest id of its group; the first itself included."""
    swap = len(set(pairs.values())) == 1
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    low, high = (F.least("a", "b"), F.when(both, F.greatest("a", "b"))) if swap else (F.col("a"), F.col("b"))
    prints = written(fingerprints(df, key, pairs, alone).select("id", "h1", "h2", low.alias("lo"), high.alias("hi"), "alone"), "prints")
    hashes, values = ["h1", "h2"], ["lo", "hi", "alone"]
    first = written(prints.groupBy(*hashes).agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "repeated")
    # equality: the members of one fingerprint by their values; the map side leaves one row a task and group
    classes = lookup(prints, first.select(*hashes, "n"), hashes, "n").groupBy(*hashes, *values).agg(F.min("id").alias("leader"), F.count(F.lit(1)).alias("members"))
    mixed = written(classes.withColumn("classes", F.count(F.lit(1)).over(Window.partitionBy(*hashes))).where("classes > 1"), "collisions")
    collided = mixed.groupBy(*hashes).agg(F.sum("members").alias("n"))
    whole = first.join(collided.select(*hashes), hashes, "left_anti")
    good = lookup(prints.select("id", *hashes), whole, hashes, "n").select("id", "first")
    # null-safe keys for the values of collided fingerprints
    safe = [F.to_json(F.array("lo", "hi")).alias("v"), "alone"]
    rest = lookup(prints.select("id", *hashes, *safe), mixed.where("members > 1").select(*hashes, *safe, F.col("leader").alias("first"), F.col("members").alias("n")), [*hashes, "v", "alone"], "n")
    return good.unionByName(rest.select("id", "first"))


def redundant_copies(df: DataFrame, key: str, pairs: dict[str, str], alone: str | None = None) -> DataFrame:
    """(row_id_a, row_id_b): each redundant copy with the first record of its group."""
    return groups(df, key, pairs, alone).where("id <> first").select(F.col("first").alias("row_id_a"), F.col("id").alias("row_id_b"))


def collapsed(df: DataFrame, key: str, pairs: dict[str, str], alone: str | None = None) -> DataFrame:
    """(key, copies): one row for each group of copies and each record without any; letterless records stay single."""
    many = written(groups(df, key, pairs, alone), "copies")
    counts = many.groupBy("first").agg(F.count(F.lit(1)).alias("copies"))
    drop = many.where("id <> first").select(F.col("id").alias(key))
    kept = df.select(key).dropDuplicates([key]).join(drop, key, "left_anti")
    return kept.join(counts.withColumnRenamed("first", key), key, "left").select(key, F.coalesce("copies", F.lit(1)).cast("bigint").alias("copies"))
