"""Queries of corpus statistics, vocabulary filters and neighbouring tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.functions import lexicon, tokens
from topicloom.operators import academic, corpus, models, phrases
from topicloom.plans import sql
from topicloom.session import spread, table, written


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.preprocess_basic(spread(table(spark, sf_dir, "documents")), "doc_id", "text")


def _joined(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.array_join("tokens", " ").alias("tokens"))


def token_doc_freq(spark, sf_dir):
    return corpus.document_frequency(_docs(spark, sf_dir))


def token_doc_freq_top(spark, sf_dir):
    return token_doc_freq(spark, sf_dir).orderBy(F.desc("doc_count"), "token").limit(20)


def high_df_tokens(spark, sf_dir):
    return corpus.high_df_tokens(_docs(spark, sf_dir), 0.1)


def banned_tokens_head(spark, sf_dir):
    return high_df_tokens(spark, sf_dir).orderBy(F.desc("doc_count"), "token").limit(200)


def drop_high_df(spark, sf_dir):
    return _joined(corpus.drop_high_df(_docs(spark, sf_dir), "doc_id", 0.1))


def df_limits(spark, sf_dir):
    return corpus.df_limits(_docs(spark, sf_dir), 10, 0.1)


def df_filter_academic(spark, sf_dir):
    return _joined(corpus.academic_filter(_docs(spark, sf_dir), "doc_id", 10, 0.1))


def filter_extremes(spark, sf_dir):
    return corpus.filter_extremes(_docs(spark, sf_dir), 2, 0.1, 500)


def bag_of_words(spark, sf_dir):
    return corpus.bag_of_words(_docs(spark, sf_dir), "doc_id")


def preprocess_report(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return corpus.report(docs.join(_docs(spark, sf_dir), "doc_id"), "text")


def preprocess_lite(spark, sf_dir):
    """With the spelling mended by the frequent words of the collection itself."""
    docs = spread(table(spark, sf_dir, "documents"))
    long = tokens.exploded(_docs(spark, sf_dir), "doc_id")
    words = written(lexicon.zipf_table(long), "words")
    fixed = lexicon.corrections(words, words, lexicon.spelling_index(words), 4.2)
    return _joined(corpus.preprocess(docs, "doc_id", "text", "mixed", ["Las Vegas", "Check-in"], repair=fixed))


def preprocess_academic(spark, sf_dir):
    got = academic.preprocess(spread(table(spark, sf_dir, "documents")), "doc_id", "text", "en", "loose")
    return _joined(got.tokens.withColumnRenamed("key", "doc_id"))


def preprocess_for_lda(spark, sf_dir):
    frame, _ = academic.preprocess_for_lda(spread(table(spark, sf_dir, "documents")), "loose", lang="en")
    return frame.select("doc_id", "__text_col_used", "text_preprocessed_academic_tokens", "text_preprocessed_academic_token_count")


def preprocess_for_lda_report(spark, sf_dir):
    return academic.preprocess_for_lda(spread(table(spark, sf_dir, "documents")), "paper", lang="en")[1]


def bigram_counts(spark, sf_dir):
    return phrases.bigram_counts(_docs(spark, sf_dir), "doc_id", 5)


def neighbour_pairs(spark, sf_dir):
    long = tokens.exploded(_docs(spark, sf_dir), "doc_id")
    return phrases.neighbours(long, "doc_id").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n >= 5")


def phrase_scores(spark, sf_dir):
    return phrases.scores(_docs(spark, sf_dir), "doc_id", 5, 10.0)


def phrase_merge(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return _joined(phrases.merge(docs, "doc_id", phrases.learn(docs, "doc_id")))


def phrase_merge_by_count(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return _joined(phrases.merge(docs, "doc_id", phrases.learn_by_count(docs, "doc_id", 20)))


def tfidf(spark, sf_dir):
    return models.tfidf(_docs(spark, sf_dir), "doc_id").withColumn("weight", F.round("weight", 6))


_WORDS = ["minibar", "elevator", "robot", "breakfast", "spa", "lobby"]


def _ranked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, i + 1, w) for i, w in enumerate(_WORDS)], "topic_id int, rank int, word string")


def umass_pairs(spark, sf_dir):
    return models.umass_pairs(_docs(spark, sf_dir), _ranked(spark), "doc_id")


def cooccur_windows(spark, sf_dir):
    return phrases.windows(_docs(spark, sf_dir), "doc_id", _WORDS, 20).where("a is not null")


QUERIES = {
    f.__name__: f
    for f in (token_doc_freq, token_doc_freq_top, high_df_tokens, banned_tokens_head, drop_high_df, df_limits, df_filter_academic, filter_extremes, bag_of_words, preprocess_report, preprocess_lite, preprocess_academic, preprocess_for_lda, preprocess_for_lda_report, bigram_counts, neighbour_pairs, phrase_scores, phrase_merge, phrase_merge_by_count, tfidf, umass_pairs, cooccur_windows)
}

_T = sql.TOKENS
_HIGH = ", high AS (SELECT token, doc_count FROM df WHERE doc_count >= (SELECT ceil(round(count(*) * 0.1, 9)) FROM d))\n"
_MARKS = ", m AS (SELECT token, doc_count, CASE WHEN doc_count >= (SELECT ceil(round(count(*) FILTER (WHERE len(tokens) > 0) * 0.1, 9)) FROM d) THEN 'high' WHEN doc_count < 10 THEN 'low' END AS mark FROM df)\n"
_KEPT = "SELECT d.doc_id, coalesce(k.tokens, '') AS tokens FROM d LEFT JOIN (SELECT doc_id, string_agg(token, ' ' ORDER BY pos) AS tokens FROM l WHERE {0} GROUP BY doc_id) k USING (doc_id)"
_PAIRS = ", p AS (SELECT token AS a, lead(token) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM l), q AS (SELECT a, b, count(*) AS n FROM p WHERE b IS NOT NULL GROUP BY a, b)\n"
_LIST = ", ".join(f"({i + 1}, '{w}')" for i, w in enumerate(_WORDS))
_W = f", v(rank, word) AS (VALUES {_LIST})\n"
SQL = {
    "token_doc_freq": _T + "SELECT token, doc_count FROM df",
    "token_doc_freq_top": _T + "SELECT token, doc_count FROM df ORDER BY doc_count DESC, token LIMIT 20",
    "high_df_tokens": _T + _HIGH + "SELECT token, doc_count FROM high",
    "banned_tokens_head": _T + _HIGH + "SELECT token, doc_count FROM high ORDER BY doc_count DESC, token LIMIT 200",
    "drop_high_df": _T + _HIGH + _KEPT.format("token NOT IN (SELECT token FROM high)"),
    "df_limits": _T + _MARKS + "SELECT token, doc_count, mark FROM m",
    "df_filter_academic": _T + _MARKS + _KEPT.format("token IN (SELECT token FROM m WHERE mark IS NULL)"),
    "filter_extremes": _T + "SELECT token, doc_count FROM df WHERE doc_count >= 2 AND doc_count <= (SELECT floor(round(count(*) * 0.1, 9)) FROM d) ORDER BY doc_count DESC, token LIMIT 500",
    "bag_of_words": _T + "SELECT doc_id, token, count(*) AS n FROM l GROUP BY doc_id, token",
    "preprocess_report": _T + """SELECT count(*) AS total_docs, count(*) FILTER (WHERE len(tokens) > 0) AS nonempty_docs, sum(length(coalesce(text, '')))::BIGINT AS chars_before,
 sum(length(array_to_string(tokens, ' ')))::BIGINT AS chars_after, sum(len(tokens))::BIGINT AS tokens, (SELECT count(DISTINCT token) FROM l) AS vocabulary,
 round(sum(len(tokens)) / count(*) FILTER (WHERE len(tokens) > 0), 2) AS avg_tokens FROM d""",
    "bigram_counts": _T + _PAIRS + "SELECT a, b, n FROM q WHERE n >= 5",
    "neighbour_pairs": _T + _PAIRS + "SELECT a, b, n FROM q WHERE n >= 5",
    "phrase_scores": _T + _PAIRS + """, s AS (SELECT token, count(*) AS k FROM l GROUP BY token), v AS (SELECT (SELECT count(*) FROM s) + (SELECT count(*) FROM q) AS v),
r AS (SELECT a, b, n, round((n - 5) * v.v / (x.k * y.k)::DOUBLE, 6) AS score FROM q JOIN s x ON x.token = a JOIN s y ON y.token = b, v WHERE n >= 5)
SELECT a, b, n, score FROM r WHERE score > 10""",
    "tfidf": _T + """, c AS (SELECT doc_id, token, count(*) AS n FROM l GROUP BY doc_id, token),
s AS (SELECT token, count(*) AS df, sum(n) AS tf FROM c GROUP BY token), t AS (SELECT count(*) AS total FROM d),
k AS (SELECT token, ln((1 + total) / (1 + df)) + 1 AS idf FROM s, t WHERE df >= 2 AND df <= total * 0.95 ORDER BY tf DESC, token LIMIT 5000),
w AS (SELECT doc_id, token, n * idf AS w FROM c JOIN k USING (token)), z AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY doc_id)
SELECT doc_id, token, round(w / norm, 6) AS weight FROM w JOIN z USING (doc_id)""",
    "umass_pairs": _T + _W + """, o AS (SELECT DISTINCT doc_id, token FROM l WHERE token IN (SELECT word FROM v)),
g AS (SELECT a.word AS a, b.word AS b FROM v a JOIN v b ON b.rank < a.rank)
SELECT 0 AS topic_id, a, b, (SELECT count(*) FROM o x JOIN o y USING (doc_id) WHERE x.token = a AND y.token = b) AS n_ab, (SELECT count(*) FROM o WHERE token = b) AS n_b FROM g""",
    "cooccur_windows": _T + _W + """, s AS (SELECT doc_id, unnest(range(1, greatest(1, len(tokens) - 19) + 1)) AS start FROM d WHERE len(tokens) > 0),
h AS (SELECT DISTINCT s.doc_id, s.start, l.token FROM s JOIN l ON l.doc_id = s.doc_id AND l.pos >= s.start AND l.pos < s.start + 20 WHERE l.token IN (SELECT word FROM v))
SELECT x.token AS a, y.token AS b, count(*) AS n FROM h x JOIN h y ON x.doc_id = y.doc_id AND x.start = y.start AND x.token <= y.token GROUP BY x.token, y.token""",
    "phrase_merge": _T + f""", {sql.scored("l", 5, 10.0, "p1")}, {sql.merged("l", "p1", "l1")}, {sql.scored("l1", 2, 6.0, "p2")}, {sql.merged("l1", "p2", "l2")}
SELECT d.doc_id, coalesce(t.tokens, '') AS tokens FROM d LEFT JOIN (SELECT doc_id, string_agg(token, ' ' ORDER BY pos) AS tokens FROM l2 GROUP BY doc_id) t USING (doc_id)""",
    "phrase_merge_by_count": _T + _PAIRS + f""", p1 AS (SELECT a, b FROM q WHERE n >= 20), {sql.merged("l", "p1", "l1")}
SELECT d.doc_id, coalesce(t.tokens, '') AS tokens FROM d LEFT JOIN (SELECT doc_id, string_agg(token, ' ' ORDER BY pos) AS tokens FROM l1 GROUP BY doc_id) t USING (doc_id)""",
    "preprocess_academic": sql.academic() + "SELECT doc_id, tokens FROM f",
    "preprocess_for_lda": sql.academic() + "SELECT doc_id, 'text' AS __text_col_used, tokens AS text_preprocessed_academic_tokens, n AS text_preprocessed_academic_token_count FROM f",
}
