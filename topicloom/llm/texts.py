"""The two text tables of the llm queries under one schema, and a helper for Arrow-batched text functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicloom.session import ship, table


def all_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tab, rec_id, text) of documents and docs_out; null texts are left out."""
    docs = table(spark, sf_dir, "documents").select(F.lit("documents").alias("tab"), F.col("doc_id").alias("rec_id"), "text")
    outs = table(spark, sf_dir, "docs_out").select(F.lit("docs_out").alias("tab"), F.col("row_id").alias("rec_id"), F.col("analysis_text").alias("text"))
    return docs.unionAll(outs).where(F.col("text").isNotNull())


def map_text(df: DataFrame, text: str, columns: dict[str, T.DataType], function: Callable[[], Callable[[str | None], tuple | None]], keep: list[str]) -> DataFrame:
    """``keep`` plus ``columns`` computed from one text column, batch by batch, without a shuffle.

    ``function`` is called once in each task and gives the function of one text, which returns the values of ``columns``
    or None to drop the row. Nulls reach it as None. A column of ``keep`` and one of ``columns`` may not share a name.
    """
    if clash := {k.lower() for k in keep} & {c.lower() for c in columns}:
        raise ValueError(f"column names clash: {sorted(clash)}")
    ship(df.sparkSession)
    source = df.select(*keep, F.col(text).cast("string").alias("__text"))
    schema = T.StructType([source.schema[k] for k in keep] + [T.StructField(c, t) for c, t in columns.items()])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = function()
        for batch in batches:
            rows, where = [], []
            for i, text_ in enumerate(batch.column("__text").to_pylist()):
                got = one(text_)
                if got is not None:
                    rows.append(got)
                    where.append(i)
            kept = batch if len(where) == batch.num_rows else batch.take(pa.array(where, pa.int64()))
            values = list(zip(*rows, strict=True)) if rows else [()] * len(columns)
            arrays = [kept.column(k).cast(arrow.field(k).type) for k in keep] + [pa.array(v, arrow.field(c).type) for v, c in zip(values, columns, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, [*keep, *columns])

    return source.mapInArrow(run, schema)
