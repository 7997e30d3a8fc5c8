"""Corpus statistics and vocabulary filters over a tokenised collection.

A collection is (doc_id, tokens array<string>); its long form is (doc_id, pos, token). Document frequencies explode the
distinct tokens of each document, so that the map side already combines a token that occurs everywhere. Filters work inside
the arrays; ties are broken by the token.

Defined cases: null token arrays count as empty; documents with a repeated id are separate documents; empty collections
give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.functions import lexicon, stopwords, text, tokens
from topicloom.operators.joins import lookup
from topicloom.session import ship, written


def preprocess_basic(df: DataFrame, key: str, column: str, language: str = "en", extra: list[str] | None = None) -> DataFrame:
    """(key, tokens): normalised, tokenised, without stop words; the older of the two lite pipelines."""
    toks = tokens.tokenize(text.normalize_basic(column), language, "basic")
    return df.select(key, tokens.without(toks, sorted(set(stopwords.base(language)) | set(extra or []))).alias("tokens"))


def preprocess(df: DataFrame, key: str, column: str, language: str = "en", extra: list[str] | None = None, least: int = 4, nouns_only: bool = False, emoji: bool = True, collocations: tuple[str, ...] = text.COLLOCATIONS, mojibake: bool = True, repair: DataFrame | None = None) -> DataFrame:
    """(key, tokens): the lite pipeline in its order: wrong encoding, emoji, normalising, tokens, spelling, stop words, length, verb
    heuristic.

    ``repair`` is the table (token, repaired) of ``lexicon.corrections``; without one no spelling is mended. Extra stop words are normalised as the text is.
    """
    raw = text.fix_mojibake(column) if mojibake else F.col(column)
    raw = text.emoji_words(raw) if emoji else raw
    toks = tokens.tokenize(text.normalize(raw, collocations), language)
    more: list[str] = []
    if extra:
        got = df.sparkSession.createDataFrame([(w,) for w in extra], "w string").select(text.normalize("w", collocations).alias("w"))
        more = [r.w for r in got.collect() if r.w]
    rows = df.select(key, toks.alias("tokens"))
    if repair is not None and language in ("en", "mixed"):
        rows = lexicon.mend(rows, key, repair)
    toks = tokens.at_least(tokens.without("tokens", sorted(set(stopwords.base(language)) | set(more))), least)
    return rows.select(key, (tokens.nouns_and_adjectives(toks) if nouns_only and language != "zh" else toks).alias("tokens"))


def document_frequency(df: DataFrame, column: str = "tokens") -> DataFrame:
    """(token, doc_count)."""
    return df.select(F.explode(F.array_distinct(column)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("doc_count"))


def _size(df: DataFrame, nonempty: bool, column: str) -> int:
    return (df.where(F.size(column) > 0) if nonempty else df).count()


def high_df_tokens(df: DataFrame, share: float = 0.8, column: str = "tokens") -> DataFrame:
    """Tokens in at least ceil(share * N) documents, N counting the empty ones too; a share outside (0, 1) bans nothing."""
    counts = document_frequency(df, column)
    if not 0 < share < 1:
        return counts.where("false")
    total = df.agg(F.ceil(F.round(F.count(F.lit(1)) * share, 9)).alias("least"))
    return counts.where(F.col("doc_count") >= total.scalar())


#: Tokens of a filter that tasks hold; a longer list is joined.
HELD_TOKENS = 500_000


def keep_tokens(df: DataFrame, key: str, kept: DataFrame, how: str = "left_semi", column: str = "tokens") -> DataFrame:
    """(key, tokens) with only the kept tokens, or with ``left_anti`` without them, in their order; emptied documents stay.

    A list of up to ``HELD_TOKENS`` tokens goes to the tasks, which filter the arrays where they are. Beyond that tokens meet the list
    by a join, and documents, told apart by row, are put together again.
    """
    kept = written(kept.select("token").distinct(), "kept")
    got = [r.token for r in kept.limit(HELD_TOKENS + 1).collect()]
    if len(got) > HELD_TOKENS:
        return _kept_by_join(df, key, kept, how, column)
    ship(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(got)
    rows = df.select(F.col(key), F.coalesce(F.col(column), F.array().cast("array<string>")).alias("tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = pa.array(held.value, pa.string())
        for batch in batches:
            lists = batch.column(1)
            values = lists.flatten().cast(pa.string())
            good = pc.is_in(values, words) if how == "left_semi" else pc.invert(pc.is_in(values, words))
            before = np.concatenate([[0], np.cumsum(good.to_numpy(zero_copy_only=False))])
            sizes = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(before[sizes], pa.int32()), values.filter(good))], [key, "tokens"])

    return rows.mapInArrow(run, rows.schema)


def _kept_by_join(df: DataFrame, key: str, kept: DataFrame, how: str, column: str) -> DataFrame:
    rows = written(df.select(F.col(key), F.col(column).alias("tokens")).withColumn("__row", F.monotonically_increasing_id()), "unfiltered")
    long = rows.select("__row", F.posexplode("tokens").alias("pos", "token"))
    counts = long.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    table = written(counts.join(kept, "token", how), "kept")
    lists = lookup(long, table, ["token"], "n").groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("l"))
    out = rows.select("__row", key).join(lists, "__row", "left")
    return out.select(key, F.coalesce(F.col("l.token"), F.array().cast("array<string>")).alias("tokens"))


def drop_high_df(df: DataFrame, key: str, share: float = 0.8, column: str = "tokens", guard: bool = False) -> DataFrame:
    """The collection without its high-frequency tokens; with ``guard`` unchanged where that would empty every document."""
    out = keep_tokens(df, key, high_df_tokens(df, share, column), "left_anti", column)
    if guard and out.where(F.size("tokens") > 0).isEmpty():
        return df.select(key, F.col(column).alias("tokens"))
    return out


def df_limits(df: DataFrame, no_below: int, no_above: float, column: str = "tokens") -> DataFrame:
    """(token, doc_count, mark): ``high`` from ceil(no_above * non-empty documents) on, else ``low`` under no_below."""
    total = df.agg(F.coalesce(F.ceil(F.round(F.count_if(F.size(column) > 0) * no_above, 9)), F.lit(0)).alias("least"))
    high = F.col("doc_count") >= total.scalar() if 0 < no_above < 1 else F.lit(False)
    low = F.col("doc_count") < no_below if no_below > 1 else F.lit(False)
    return document_frequency(df, column).select("token", "doc_count", F.when(high, "high").when(low, "low").alias("mark"))


def academic_filter(df: DataFrame, key: str, no_below: int = 10, no_above: float = 0.6, column: str = "tokens") -> DataFrame:
    """The collection without the tokens marked high or low."""
    return keep_tokens(df, key, df_limits(df, no_below, no_above, column).where("mark is null"), "left_semi", column)


def filter_extremes(df: DataFrame, no_below: int = 2, no_above: float = 0.9, keep_n: int = 20_000, column: str = "tokens") -> DataFrame:
    """(token, doc_count): tokens in no_below to int(no_above * N) documents, the keep_n most frequent."""
    total = df.agg(F.floor(F.round(F.count(F.lit(1)) * no_above, 9)).alias("most"))
    rows = document_frequency(df, column).where((F.col("doc_count") >= no_below) & (F.col("doc_count") <= total.scalar()))
    return rows.orderBy(F.desc("doc_count"), "token").limit(keep_n).select("token", "doc_count")


def bag_of_words(df: DataFrame, key: str, column: str = "tokens") -> DataFrame:
    """(key, token, n)."""
    return df.select(key, F.explode(column).alias("token")).groupBy(key, "token").agg(F.count(F.lit(1)).alias("n"))


def nonempty(df: DataFrame, column: str = "tokens") -> DataFrame:
    return df.where(F.size(column) > 0)


def report(df: DataFrame, raw: str, column: str = "tokens") -> DataFrame:
    """One row of counters: documents, non-empty, characters before and after, tokens, average (2 decimals), vocabulary."""
    size = F.greatest(F.size(F.coalesce(column, F.array().cast("array<string>"))), F.lit(0))
    one = df.agg(
        F.count(F.lit(1)).alias("total_docs"),
        F.count_if(size > 0).alias("nonempty_docs"),
        F.coalesce(F.sum(F.length(F.coalesce(raw, F.lit("")))), F.lit(0)).alias("chars_before"),
        F.coalesce(F.sum(F.length(F.array_join(column, " "))), F.lit(0)).alias("chars_after"),
        F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("tokens"),
    )
    words = df.select(F.explode(column).alias("token")).agg(F.countDistinct("token").alias("vocabulary"))
    average = F.round(F.when(F.col("nonempty_docs") > 0, F.col("tokens") / F.col("nonempty_docs")).otherwise(0.0), 2)
    return one.withColumn("vocabulary", words.scalar()).withColumn("avg_tokens", average)


def text_column(df: DataFrame, preferred: list[str] | None = None) -> str:
    """The column that holds the text: a preferred name, exact and then in any case, else the longest string column in total."""
    preferred = preferred or "text content Content Comment_Content replies_content transcript caption comment body description message review title Title Text".split()
    for name in preferred:
        hit = next((c for c in df.columns if c == name), None) or next((c for c in df.columns if c.lower() == name.lower()), None)
        if hit:
            return hit
    strings = [c for c, kind in df.dtypes if kind == "string"]
    if not strings:
        raise ValueError("no text column")
    totals = df.agg(*(F.coalesce(F.sum(F.length(f"`{c}`")), F.lit(0)).alias(str(i)) for i, c in enumerate(strings))).first()
    return max(strings, key=lambda c: (totals[str(strings.index(c))], -strings.index(c)))


def unique_columns(df: DataFrame) -> DataFrame:
    """Drop columns whose name came before."""
    names, keep = [f"__{i}" for i in range(len(df.columns))], {}
    for name, alias in zip(df.columns, names, strict=True):
        keep.setdefault(name, alias)
    return df.toDF(*names).select(*(F.col(a).alias(n) for n, a in keep.items()))
