"""The academic preprocessing: cleaning, annotation, filters, phrases and document frequencies, with its report.

Rows are told apart by a number of their own, so ids may repeat. Defined cases: null texts count as empty; a table without rows, or
without a text column, is refused by ``preprocess_for_lda`` and gives an empty result in ``preprocess``; an existing output column is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.functions import annotate, language, stopwords, text, tokens
from topicloom.operators import corpus, phrases
from topicloom.session import written

PRESETS = {
    "loose": {"min_token_len": 3, "max_token_len": 25, "pos_keep": ("NOUN", "PROPN", "ADJ", "VERB"), "df_no_below": 5, "df_no_above": 0.8},
    "paper": {"min_token_len": 4, "max_token_len": 25, "pos_keep": ("NOUN", "PROPN", "ADJ"), "df_no_below": 10, "df_no_above": 0.6},
}
NAMES = {"loose_for_youtube": "loose", "paper_default": "paper"}
#: Lengths where a preset says nothing, by language.
LENGTHS = {"zh": (2, 12)}
OUT = "text_preprocessed_academic"


def settings(preset: str | dict, language_: str = "en") -> dict:
    """A preset by name, or given values over the defaults. A named preset's lengths hold for Chinese too."""
    if isinstance(preset, str):
        return {"ngrams": True, "ngram_min_count": 5, "ngram_threshold": 10.0, "ngram_bigram_only": False} | PRESETS.get(NAMES.get(preset, preset), PRESETS["paper"])
    least, most = LENGTHS.get(language_, (4, 25))
    return settings("paper") | {"min_token_len": least, "max_token_len": most} | preset


@dataclass
class Processed:
    """tokens (row, key, tokens) and the report, one row of counters."""

    tokens: DataFrame
    report: DataFrame


def _filtered(rows: DataFrame, p: dict, stop: list[str]) -> DataFrame:
    """tokens of each row and what became of the others: short, long, other parts of speech, stop words."""
    def short(t):
        return F.length(t["lemma"]) < p["min_token_len"]

    def long(t):
        return F.length(t["lemma"]) > p["max_token_len"]

    def kept_pos(t):
        return t["pos"].isin(*p["pos_keep"])

    fitting = F.filter("tagged", lambda t: ~short(t) & ~long(t))
    rows = rows.select("row", "key", "before", "after", F.size("tagged").alias("all"), F.size(F.filter("tagged", short)).alias("short"), F.size(F.filter("tagged", long)).alias("long"), fitting.alias("fitting"))
    rows = rows.withColumn("kept", F.filter("fitting", kept_pos))
    rows = rows.withColumn("lemmas", tokens.without(F.transform("kept", lambda t: t["lemma"]), stop))
    def of(pos: str):
        return F.size(F.filter("kept", lambda t: t["pos"] == pos)).alias(f"pos_{pos.lower()}")

    parts = [of(pos) for pos in sorted(p["pos_keep"])]
    return rows.select("row", "key", "before", "after", "short", "long", (F.size("fitting") - F.size("kept")).alias("pos_dropped"), *parts, (F.size("kept") - F.size("lemmas")).alias("stopped"), F.col("lemmas").alias("tokens"))


def preprocess(df: DataFrame, key: str, column: str, language_: str = "auto", preset: str | dict = "paper", extra: list[str] | None = None, annotator=None, compat: bool = False) -> Processed:
    """Clean, tag, lemma, length, part of speech, stop words, phrases, document frequency, in this order."""
    if language_ in ("auto", "mixed"):
        language_ = language.detect_academic(df, key, column).first().language
    elif language_ not in ("en", "es", "zh"):
        language_ = "en"
    p = settings(preset, language_)
    more: list[str] = []
    if extra:
        got = df.sparkSession.createDataFrame([(w.strip(),) for w in extra if w and w.strip()], "w string")
        more = [r.w for r in got.select(text.clean("w", language_, compat).alias("w")).collect() if r.w]
    stop = stopwords.academic(language_, more)
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(column).cast("string").alias("raw"))
    rows = rows.select("row", "key", F.length(F.coalesce("raw", F.lit(""))).alias("before"), text.clean("raw", language_, compat).alias("clean"))
    tagged = annotate.annotate(rows.withColumn("after", F.length("clean")), "clean", annotator or (lambda: annotate.rules(language_)), "tagged", lambda: text.lemma_cleaner(language_))
    # phrases and frequencies read the tokens several times, so the annotator's work is kept
    base = written(_filtered(tagged, p, stop), "lemmas")
    out, found = base.select("row", "tokens"), {"bigrams": 0, "trigrams": 0}
    if p["ngrams"]:
        rounds = phrases.learn(out, "row", p["ngram_min_count"], p["ngram_threshold"], p["ngram_bigram_only"])
        out = written(phrases.merge(out, "row", rounds), "phrases")
        sizes = [len(r) if isinstance(r, list) else r.count() for r in rounds]
        found = {"bigrams": sizes[0], "trigrams": sizes[1] if len(sizes) > 1 else 0}
    limits = written(corpus.df_limits(out, p["df_no_below"], p["df_no_above"]), "limits")
    done = written(corpus.keep_tokens(out, "row", limits.where("mark is null")), "academic")
    return Processed(done.join(base.select("row", "key"), "row").select("row", "key", "tokens"), _report(base, done, limits, found, language_, p))


def _report(base: DataFrame, done: DataFrame, limits: DataFrame, found: dict, language_: str, p: dict) -> DataFrame:
    parts = [f"pos_{pos.lower()}" for pos in sorted(p["pos_keep"])]
    first = base.agg(
        F.count(F.lit(1)).alias("input_docs"), F.coalesce(F.sum("before"), F.lit(0)).alias("chars_before"), F.coalesce(F.sum("after"), F.lit(0)).alias("chars_after"),
        F.coalesce(F.sum("short"), F.lit(0)).alias("dropped_too_short"), F.coalesce(F.sum("long"), F.lit(0)).alias("dropped_too_long"), F.coalesce(F.sum("pos_dropped"), F.lit(0)).alias("pos_dropped"),
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in parts), F.coalesce(F.sum("stopped"), F.lit(0)).alias("stopwords_removed"), F.coalesce(F.sum(F.size("tokens")), F.lit(0)).alias("kept_tokens"),
    )
    marks = limits.agg(F.count_if(F.col("mark") == "high").alias("banned_high"), F.count_if(F.col("mark") == "low").alias("banned_low"), F.count(F.lit(1)).alias("vocab_before_filter"), F.count_if(F.col("mark").isNull()).alias("kept_vocab"))
    last = done.agg(F.count_if(F.size("tokens") > 0).alias("non_empty_docs"), F.coalesce(F.sum(F.size("tokens")), F.lit(0)).alias("total_tokens"))
    row = {"language": language_} | first.first().asDict() | marks.first().asDict() | last.first().asDict()
    row |= {"found_bigrams": found["bigrams"], "found_trigrams": found["trigrams"], "avg_tokens": round(row["total_tokens"] / max(1, row["non_empty_docs"]), 2)}
    kinds = {"language": "string", "avg_tokens": "double"}
    return base.sparkSession.createDataFrame([tuple(row.values())], ", ".join(f"{k} {kinds.get(k, 'bigint')}" for k in row))


def preprocess_for_lda(df: DataFrame, mode: str | dict = "loose", extra: list[str] | None = None, lang: str = "auto", text_col: str | None = None, annotator=None) -> tuple[DataFrame, DataFrame]:
    """The input with ``__text_col_used``, ``text_preprocessed_academic``, ``..._tokens`` and ``..._token_count``, and the report with
    the column used and the numbers of rows and of documents left."""
    column = text_col or corpus.text_column(df)
    names = ["__text_col_used", OUT, f"{OUT}_tokens", f"{OUT}_token_count"]
    rows = written(df.drop(*names).withColumn("__row", F.monotonically_increasing_id()), "input")
    if rows.isEmpty():
        raise ValueError("the table has no rows")
    got = preprocess(rows, "__row", column, "auto" if lang is None else lang, mode, extra, annotator)
    joined = F.array_join("tokens", " ")
    out = rows.join(got.tokens.select(F.col("key").alias("__row"), "tokens"), "__row")
    out = out.select(*(F.col(f"`{c}`") for c in rows.columns if c != "__row"), F.lit(column).alias(names[0]), joined.alias(names[1]), joined.alias(names[2]), F.size("tokens").alias(names[3]))
    meta = got.report.select("*", F.lit(column).alias("_meta_text_col"), F.col("input_docs").alias("_meta_n_rows"), F.col("non_empty_docs").alias("_meta_nonempty_docs"))
    return out, meta
