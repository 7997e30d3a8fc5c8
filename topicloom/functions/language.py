"""The script of a whole collection, from the first rows by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.functions.text import CJK


def _first(df: DataFrame, key: str, text: str, rows: int) -> DataFrame:
    return df.where(F.col(key).isNotNull()).orderBy(key).limit(rows).select(F.coalesce(F.col(text), F.lit("")).alias("t"))


def _count(pattern: str) -> Column:
    return F.coalesce(F.sum(F.length(F.regexp_replace("t", f"[^{pattern}]", ""))), F.lit(0))


def detect_lite(df: DataFrame, key: str, text: str, rows: int = 200) -> DataFrame:
    """One row (language, cjk, latin) from the first rows: zh, en or mixed by the counts of characters."""
    got = _first(df, key, text, rows).agg(_count(CJK).alias("cjk"), _count("A-Za-z").alias("latin"), F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("chars"))
    # texts are joined by blanks, so only no row or one empty row gives an empty text
    language = F.when((F.col("n") <= 1) & (F.col("chars") == 0), "mixed").when((F.col("cjk") > 0) & (F.col("latin") == 0), "zh").when((F.col("latin") > 0) & (F.col("cjk") == 0), "en")
    language = language.when(F.col("cjk") >= F.col("latin") * 0.8, "zh").when(F.col("latin") >= F.col("cjk") * 0.8, "en").otherwise("mixed")
    return got.select(language.alias("language"), "cjk", "latin")


def detect_academic(df: DataFrame, key: str, text: str, rows: int = 200) -> DataFrame:
    """One row (language, cjk, other, spanish): zh, es or en."""
    wide = r"\x{3400}-\x{4dbf}" + CJK
    got = _first(df, key, text, rows).agg(
        _count(wide).alias("cjk"),
        F.coalesce(F.sum(F.length(F.regexp_replace("t", rf"[{wide}]|[^\p{{L}}]", ""))), F.lit(0)).alias("other"),
        F.coalesce(F.bool_or(F.lower("t").rlike("[ñ¿¡áéíóúü]")), F.lit(False)).alias("spanish"),
    )
    language = F.when((F.col("cjk") > 0) & (F.col("cjk") >= F.col("other")), "zh").when(F.col("spanish"), "es").otherwise("en")
    return got.select(language.alias("language"), "cjk", "other", "spanish")
