"""Joining many rows with a table of one row a key, where one key may hold any share of the rows.

A table of at most ``BROADCAST_ROWS`` rows and about ``BROADCAST_BYTES``, counted first, is broadcast, so that the rows stay where they are. Of a larger
one only the rows of hot keys are: a key is hot from ``HOT_ROWS`` rows on, of which there can't be many. All other rows
meet by an ordinary shuffle, in which no key is large.

Defined cases: a null key finds nothing; rows keep their repetitions; an empty table finds nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes, by the width of its columns, of a table that is broadcast whole.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 8 << 20
#: Rows from which a key is hot, and the most hot keys that are broadcast, the largest first.
HOT_ROWS, MOST_HOT = 100_000, 100_000


def _width(field: T.StructField) -> int:
    return 40 if isinstance(field.dataType, T.StringType) else 8


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], n: str, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``table``, which has one row for each key, short keys and values, and in ``n`` how many rows the key has.

    ``how`` is inner or left. The table is read several times, so it should be a written one.
    """
    most = min(BROADCAST_ROWS, BROADCAST_BYTES // sum(map(_width, table.schema)))
    if table.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(table), keys, how)
    others = [c for c in table.columns if c not in keys]
    # a null key finds nothing, and as a join key it would send all its rows to one task
    known = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    nothing = rows.where(~known).select(*rows.columns, *(F.lit(None).cast(table.schema[c].dataType).alias(c) for c in others))
    rows = rows.where(known)
    hot = table.where(F.col(n) >= HOT_ROWS).orderBy(F.desc(n), *keys).limit(MOST_HOT)
    tagged = rows.join(F.broadcast(hot.select(*keys, F.struct(*others).alias("__hot"))), keys, "left")
    found = tagged.where("__hot is not null").select(*rows.columns, "__hot.*")
    cold = table.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    rest = tagged.where("__hot is null").drop("__hot").join(cold, keys, how)
    out = found.unionByName(rest.select(*rows.columns, *others))
    return out.unionByName(nothing) if how == "left" else out
