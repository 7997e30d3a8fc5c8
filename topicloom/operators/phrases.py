"""Adjacent tokens: counts, phrase scores and merging.

Counting and scoring are relational. Merging is sequential inside a document, so it runs over Arrow batches with the
phrase table in each task. A table of more than ``MAX_PHRASES`` stays on the shared folder and is joined to the neighbours;
the tasks then get the places of the phrases in each document.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicloom.session import ship, written

#: Phrases that a task holds at most; more are joined.
MAX_PHRASES = 200_000


def adjacent(df: DataFrame, key: str, tokens: str = "tokens") -> DataFrame:
    """(key, pos, a, b) for each pair of neighbours; pairs come from the array itself, without a shuffle."""
    n = F.size(tokens)
    pairs = F.when(n > 1, F.arrays_zip(F.slice(tokens, F.lit(1), n - 1).alias("a"), F.slice(tokens, F.lit(2), n - 1).alias("b"))).otherwise(F.array().cast("array<struct<a:string,b:string>>"))
    return df.select(key, F.posexplode(pairs.cast("array<struct<a:string,b:string>>")).alias("pos", "p")).select(key, "pos", "p.a", "p.b")


def bigram_counts(df: DataFrame, key: str, least: int = 5, tokens: str = "tokens") -> DataFrame:
    """(a, b, n) of the neighbours that occur at least so often."""
    return adjacent(df, key, tokens).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def scores(df: DataFrame, key: str, least: int = 5, threshold: float = 10.0, tokens: str = "tokens") -> DataFrame:
    """(a, b, n, score) above the threshold: (n - least) * |V| / (n_a * n_b), |V| the distinct tokens and pairs."""
    df = written(df.select(key, F.col(tokens).alias("tokens")), "tokens")  # read four times below
    tokens = "tokens"
    pairs = written(adjacent(df, key, tokens).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")), "pairs")
    single = df.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("k"))
    size = single.agg(F.count(F.lit(1))).scalar() + pairs.agg(F.count(F.lit(1))).scalar()
    rows = pairs.where(F.col("n") >= least).join(single.select(F.col("token").alias("a"), F.col("k").alias("na")), "a").join(single.select(F.col("token").alias("b"), F.col("k").alias("nb")), "b")
    score = (F.col("n") - least) * size / (F.col("na") * F.col("nb"))
    return rows.withColumn("score", F.round(score.cast("double"), 6)).where(F.col("score") > threshold).select("a", "b", "n", "score")


def _merge_once(words: list[str], phrases: set[tuple[str, str]]) -> list[str]:
    out, i = [], 0
    while i < len(words):
        if i + 1 < len(words) and (words[i], words[i + 1]) in phrases:
            out.append(f"{words[i]}_{words[i + 1]}")
            i += 2
        else:
            out.append(words[i])
            i += 1
    return out


def _merge_at(words: list[str], places: set[int]) -> list[str]:
    out, i = [], 0
    while i < len(words):
        if i in places:
            out.append(f"{words[i]}_{words[i + 1]}")
            i += 2
        else:
            out.append(words[i])
            i += 1
    return out


def _merge_joined(df: DataFrame, key: str, table: DataFrame, tokens: str) -> DataFrame:
    """One round of a merge with a table of any size (a, b): a join finds the places, by row, as keys may repeat."""
    rows = written(df.select(key, F.col(tokens).alias("tokens")).withColumn("_row", F.monotonically_increasing_id()), "unmerged")
    hits = adjacent(rows, "_row").join(table.select("a", "b").distinct(), ["a", "b"], "left_semi")
    places = hits.groupBy("_row").agg(F.collect_list("pos").alias("places"))

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(lists: pd.Series, at: pd.Series) -> pd.Series:
        return pd.Series([_merge_at([] if words is None else list(words), set() if p is None else set(p)) for words, p in zip(lists, at, strict=True)])

    return rows.join(places, "_row", "left").select(key, run("tokens", "places").alias("tokens"))


def merge(df: DataFrame, key: str, rounds: list[list[tuple[str, str]] | DataFrame], tokens: str = "tokens") -> DataFrame:
    """(key, tokens) with phrases joined by "_", from left to right, one round after the other; a round is a list of pairs or a
    table (a, b)."""
    ship(df.sparkSession)
    for n, table in enumerate(rounds):
        if isinstance(table, DataFrame):
            before = merge(df, key, rounds[:n], tokens) if n else df.select(key, F.col(tokens).alias("tokens"))
            after = _merge_joined(before, key, table, "tokens")
            return merge(after, key, rounds[n + 1 :]) if rounds[n + 1 :] else after
    tables = [set(r) for r in rounds]

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            done = []
            for words in s:
                words = [] if words is None else list(words)
                for table in tables:
                    words = _merge_once(words, table)
                done.append(words)
            yield pd.Series(done)

    return df.select(key, run(F.col(tokens)).alias("tokens"))


def _round(rows: DataFrame) -> list[tuple[str, str]] | DataFrame:
    """The pairs as a list, or as a table where they are more than a task may hold."""
    table = written(rows.select("a", "b"), "phrases")
    got = table.limit(MAX_PHRASES + 1).collect()
    return [(r.a, r.b) for r in got] if len(got) <= MAX_PHRASES else table


def learn(df: DataFrame, key: str, least: int = 5, threshold: float = 10.0, bigram_only: bool = False) -> list[list[tuple[str, str]] | DataFrame]:
    """The rounds of a merge: two-word phrases, then phrases over the merged documents, with softer limits."""
    first = _round(scores(df, key, least, threshold))
    if bigram_only:
        return [first]
    again = merge(df, key, [first])
    return [first, _round(scores(again, key, max(2, least // 2), max(3.0, 0.6 * threshold)))]


def learn_by_count(df: DataFrame, key: str, least: int = 5) -> list[list[tuple[str, str]] | DataFrame]:
    """The plain fallback: every pair of neighbours that occurs often enough."""
    return [_round(bigram_counts(df, key, least))]


def windows(df: DataFrame, key: str, words: list[str], size: int = 110, tokens: str = "tokens") -> DataFrame:
    """(a, b, n): sliding windows of ``size`` tokens that hold both words, a <= b; a = b counts the windows with the word,
    and the row of two nulls counts all windows. Only the listed words are followed; a document shorter than the window is
    one window."""
    ship(df.sparkSession)
    wanted = set(words)
    if len(wanted) > 20_000:
        raise ValueError("at most 20,000 words")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[tuple, int] = {}
        for f in frames:
            for row in f.tokens:
                row = [] if row is None else list(row)
                if not row:
                    continue
                n = max(1, len(row) - size + 1)
                counts[None, None] = counts.get((None, None), 0) + n
                inside: dict[str, int] = {}
                last: dict[tuple, int] = {}
                for i, w in enumerate(row):
                    if i >= size and (old := row[i - size]) in wanted:
                        inside[old] -= 1
                        if not inside[old]:
                            del inside[old]
                            for other in list(inside) + [old]:
                                pair = (min(old, other), max(old, other))
                                if pair in last:
                                    counts[pair] = counts.get(pair, 0) + max(0, i - size + 1) - last.pop(pair)
                    if w in wanted:
                        fresh = w not in inside
                        inside[w] = inside.get(w, 0) + 1
                        if fresh:
                            for other in inside:
                                last.setdefault((min(w, other), max(w, other)), max(0, i - size + 1))
                for pair, start in last.items():
                    counts[pair] = counts.get(pair, 0) + n - start
            if len(counts) > 500_000:
                yield pd.DataFrame([(a, b, n) for (a, b), n in counts.items()], columns=["a", "b", "n"])
                counts = {}
        yield pd.DataFrame([(a, b, n) for (a, b), n in counts.items()], columns=["a", "b", "n"])

    return df.select(F.col(tokens).alias("tokens")).mapInPandas(run, "a string, b string, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))


def neighbours(df: DataFrame, key: str) -> DataFrame:
    """The pairs of a long form (key, pos, token) by position, where no arrays are at hand."""
    w = Window.partitionBy(key).orderBy("pos")
    return df.select(key, "pos", F.col("token").alias("a"), F.lead("token").over(w).alias("b")).where("b is not null")
