"""Queries of the text functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.functions import annotate as tagging
from topicloom.functions import language, lexicon, text, tokens
from topicloom.operators import corpus
from topicloom.plans import sql
from topicloom.session import spread, table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def _joined(c) -> Column:
    return F.array_join(c, " ")


def normalize_basic(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.normalize_basic("text").alias("norm"))


def normalize_app(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.normalize("text").alias("norm"))


def tokenize_en(spark, sf_dir):
    toks = tokens.tokenize(text.normalize_basic("text"), "en")
    return _docs(spark, sf_dir).select("doc_id", _joined(toks).alias("tokens"), F.size(toks).cast("bigint").alias("n"))


def tokenize_basic(spark, sf_dir):
    toks = tokens.tokenize(text.normalize_basic("text"), "en", "basic")
    return _docs(spark, sf_dir).select("doc_id", _joined(toks).alias("tokens"), F.size(toks).cast("bigint").alias("n"))


def tokenize_zh_ngrams(spark, sf_dir):
    toks = tokens.tokenize(text.normalize_basic("text"), "zh")
    return _docs(spark, sf_dir).select("doc_id", _joined(toks).alias("tokens"), F.size(toks).cast("bigint").alias("n"))


def tokenize_mixed(spark, sf_dir):
    toks = tokens.tokenize(text.normalize_basic("text"), "mixed")
    return _docs(spark, sf_dir).select("doc_id", _joined(toks).alias("tokens"))


def token_len_filter(spark, sf_dir):
    toks = tokens.at_least(tokens.tokenize(text.normalize_basic("text"), "mixed"), 5)
    return _docs(spark, sf_dir).select("doc_id", _joined(toks).alias("tokens"))


def noun_adj_filter(spark, sf_dir):
    toks = tokens.nouns_and_adjectives(tokens.tokenize(text.normalize_basic("text"), "en"))
    return _docs(spark, sf_dir).select("doc_id", _joined(toks).alias("tokens"))


def stopword_filter(spark, sf_dir):
    return corpus.preprocess_basic(_docs(spark, sf_dir), "doc_id", "text").select("doc_id", _joined("tokens").alias("tokens"))


def nonempty_docs(spark, sf_dir):
    return corpus.nonempty(corpus.preprocess_basic(_docs(spark, sf_dir), "doc_id", "text")).select("doc_id", F.size("tokens").cast("bigint").alias("n"))


def compose_title_content(spark, sf_dir):
    return table(spark, sf_dir, "docs_out").select("row_id", text.compose("Title", "content").alias("composed"))


def build_analysis_text(spark, sf_dir):
    return text.analysis_text(table(spark, sf_dir, "docs_out").drop("analysis_text")).select("row_id", "analysis_text")


def snippet_260(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.snippet("text").alias("snippet"))


def abbreviate(spark, sf_dir):
    return table(spark, sf_dir, "topic_dictionary").select("topic_id", text.abbreviate("topic_description").alias("short"))


def short_hash(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.short_hash("text").alias("h"), F.sha1(F.coalesce("text", F.lit(""))).alias("sha"))


def lang_detect_corpus(spark, sf_dir):
    return language.detect_lite(_docs(spark, sf_dir), "doc_id", "text")


def lang_detect_academic(spark, sf_dir):
    return language.detect_academic(_docs(spark, sf_dir), "doc_id", "text")


def text_column_pick(spark, sf_dir):
    """The longest of the string columns, since none has a preferred name."""
    df = table(spark, sf_dir, "docs_out")
    return spark.createDataFrame([(corpus.text_column(df, ["none of these"]),)], "picked string")


def split_tokens(spark, sf_dir):
    toks = tokens.split_tokens("text_preprocessed_academic_tokens")
    return table(spark, sf_dir, "preprocessed").groupBy("doc_id").agg(F.max(F.size(toks)).cast("bigint").alias("n"))


def strip_accents(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.strip_accents("text").alias("plain"), text.strip_accents("text", True).alias("with_enie"))


def clean_en(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.clean("text", "en").alias("cleaned"))


def clean_es(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.clean("text", "es").alias("cleaned"))


def clean_zh(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.clean("text", "zh").alias("cleaned"))


def emoji_words(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.emoji_words("text").alias("named"))


def fix_mojibake(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.fix_mojibake("text").alias("fixed"))


def annotate(spark, sf_dir):
    cleaned = _docs(spark, sf_dir).select("doc_id", text.clean("text", "en").alias("c"))
    rows = tagging.annotate(cleaned, "c", lambda: tagging.rules("en"))
    return rows.select("doc_id", F.explode("tagged").alias("t")).groupBy("t.pos").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("t.lemma").alias("lemmas"))


def _long(spark, sf_dir):
    return tokens.exploded(corpus.preprocess_basic(_docs(spark, sf_dir), "doc_id", "text"), "doc_id")


def zipf(spark, sf_dir):
    return lexicon.zipf_table(_long(spark, sf_dir))


def spell_index(spark, sf_dir):
    return lexicon.spelling_index(lexicon.zipf_table(_long(spark, sf_dir)))


def lexicon_repair(spark, sf_dir):
    long = _long(spark, sf_dir)
    words = lexicon.zipf_table(long)
    fixed = lexicon.repaired(long, words, lexicon.spelling_index(words), 4.2)
    return fixed.where("token <> repaired").groupBy("token", "repaired").agg(F.count(F.lit(1)).alias("n"))


def merge_prefixes(spark, sf_dir):
    long = _long(spark, sf_dir)
    merged = lexicon.merge_prefixes(long, "doc_id", ["sur", "break", "out", "room"], long.select("token"))
    return merged.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (normalize_basic, normalize_app, tokenize_en, tokenize_basic, tokenize_zh_ngrams, tokenize_mixed, token_len_filter, noun_adj_filter, stopword_filter, nonempty_docs, compose_title_content, build_analysis_text, snippet_260, abbreviate, short_hash, lang_detect_corpus, lang_detect_academic, text_column_pick, split_tokens, strip_accents, clean_en, clean_es, clean_zh, fix_mojibake, emoji_words, annotate, zipf, spell_index, lexicon_repair, merge_prefixes)
}

_N = f"WITH n AS (SELECT doc_id, {sql.normalized('text')} AS norm FROM documents)\n"
_APP = sql.words("norm", "[a-z_]{3,35}")
_MIXED = f"list_concat({_APP}, {sql.chinese('norm')})"
_COMPOSE = """CASE WHEN t <> '' AND c <> '' AND NOT starts_with(lower(c), lower(t)) THEN t || ' ' || c WHEN c <> '' THEN c ELSE t END"""
_COMPOSED = "WITH p AS (SELECT row_id, trim(coalesce(\"Title\", '')) AS t, trim(coalesce(content, '')) AS c FROM docs_out)\n"
_ZIPF = sql.TOKENS + """, z AS (SELECT token, count(*) AS n FROM l GROUP BY token),
x AS (SELECT token, n, round(log10(n * 1e9 / (SELECT sum(n) FROM z)), 6) AS zipf FROM z)
"""
_INDEX = _ZIPF + """, w AS (SELECT token, zipf, length(token) AS k FROM x WHERE regexp_full_match(token, '[a-z]{3,30}') ORDER BY zipf DESC, token LIMIT 80000),
k AS (SELECT token AS word, zipf, unnest(list_distinct(list_concat([token],
  CASE WHEN k >= 4 THEN [substr(token, 2), substr(token, 1, k - 1)] ELSE [] END,
  CASE WHEN k >= 5 THEN [substr(token, 1, k - 2)] ELSE [] END,
  CASE WHEN k >= 4 THEN list_transform(range(4, least(10, k) + 1), lambda i: substr(token, 1, i)) ELSE [] END))) AS key FROM w),
i AS (SELECT key, word, zipf FROM k WHERE length(key) >= 3 QUALIFY row_number() OVER (PARTITION BY key ORDER BY zipf DESC, word) = 1)
"""
_FIRST = "WITH f AS (SELECT coalesce(text, '') AS t FROM documents WHERE doc_id IS NOT NULL ORDER BY doc_id LIMIT 200)\n"
SQL = {
    "normalize_basic": _N + "SELECT doc_id, norm FROM n",
    "tokenize_en": _N + f"SELECT doc_id, array_to_string({_APP}, ' ') AS tokens, len({_APP})::BIGINT AS n FROM n",
    "tokenize_basic": _N + f"SELECT doc_id, array_to_string({sql.words('norm')}, ' ') AS tokens, len({sql.words('norm')})::BIGINT AS n FROM n",
    "tokenize_zh_ngrams": _N + f"SELECT doc_id, array_to_string({sql.chinese('norm')}, ' ') AS tokens, len({sql.chinese('norm')})::BIGINT AS n FROM n",
    "tokenize_mixed": _N + f"SELECT doc_id, array_to_string({_MIXED}, ' ') AS tokens FROM n",
    "token_len_filter": _N + f"SELECT doc_id, array_to_string(list_filter({_MIXED}, lambda t: NOT regexp_full_match(t, '[a-z_]+') OR length(t) >= 5), ' ') AS tokens FROM n",
    "noun_adj_filter": _N + f"SELECT doc_id, array_to_string(list_filter({_APP}, lambda t: t NOT IN ({sql.VERB_LIST}) AND NOT (length(t) >= 6 AND (ends_with(t, 'ing') OR ends_with(t, 'ed')))), ' ') AS tokens FROM n",
    "stopword_filter": sql.TOKENS + "SELECT doc_id, array_to_string(tokens, ' ') AS tokens FROM d",
    "nonempty_docs": sql.TOKENS + "SELECT doc_id, len(tokens)::BIGINT AS n FROM d WHERE len(tokens) > 0",
    "compose_title_content": _COMPOSED + f"SELECT row_id, {_COMPOSE} AS composed FROM p",
    "build_analysis_text": _COMPOSED + f"SELECT row_id, {_COMPOSE} AS analysis_text FROM p",
    "snippet_260": r"SELECT doc_id, substr(trim(regexp_replace(coalesce(text, ''), '[ \t\n\x0b\f\r]+', ' ', 'g')), 1, 260) AS snippet FROM documents",
    "abbreviate": "SELECT topic_id, CASE WHEN length(s) > 32 THEN substr(s, 1, 31) || '…' ELSE s END AS short FROM (SELECT topic_id, coalesce(topic_description, '') AS s FROM topic_dictionary)",
    "short_hash": "SELECT doc_id, substr(md5(coalesce(text, '')), 1, 12) AS h, sha1(coalesce(text, '')) AS sha FROM documents",
    "lang_detect_corpus": _FIRST + r""", c AS (SELECT coalesce(sum(length(regexp_replace(t, '[^\x{4e00}-\x{9fff}]', '', 'g'))), 0)::BIGINT AS cjk, coalesce(sum(length(regexp_replace(t, '[^A-Za-z]', '', 'g'))), 0)::BIGINT AS latin, sum(length(t)) AS chars FROM f)
SELECT CASE WHEN chars = 0 THEN 'mixed' WHEN cjk > 0 AND latin = 0 THEN 'zh' WHEN latin > 0 AND cjk = 0 THEN 'en' WHEN cjk >= latin * 0.8 THEN 'zh' WHEN latin >= cjk * 0.8 THEN 'en' ELSE 'mixed' END AS language, cjk, latin FROM c""",
    "lang_detect_academic": _FIRST + r""", c AS (SELECT coalesce(sum(length(regexp_replace(t, '[^\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]', '', 'g'))), 0)::BIGINT AS cjk, coalesce(sum(length(regexp_replace(t, '[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]|[^\p{L}]', '', 'g'))), 0)::BIGINT AS other, coalesce(bool_or(regexp_matches(lower(t), '[ñ¿¡áéíóúü]')), false) AS spanish FROM f)
SELECT CASE WHEN cjk > 0 AND cjk >= other THEN 'zh' WHEN spanish THEN 'es' ELSE 'en' END AS language, cjk, other, spanish FROM c""",
    "text_column_pick": """SELECT name AS picked FROM (UNPIVOT (SELECT sum(length(video_id)) AS video_id, sum(length(channel)) AS channel, sum(length("Title")) AS "Title", sum(length(content)) AS content,
 sum(length(analysis_text)) AS analysis_text, sum(length(lang)) AS lang, sum(length("Topic")) AS "Topic" FROM docs_out) ON COLUMNS(*) INTO NAME name VALUE total) ORDER BY total DESC LIMIT 1""",
    "split_tokens": r"SELECT doc_id, max(len(regexp_extract_all(coalesce(text_preprocessed_academic_tokens, ''), '[^\s]+')))::BIGINT AS n FROM preprocessed GROUP BY doc_id",
    "zipf": _ZIPF + "SELECT token, n, zipf FROM x",
    "spell_index": _INDEX + "SELECT key, word, zipf FROM i",
    "lexicon_repair": _INDEX + """, r AS (SELECT x.token, x.n, CASE WHEN NOT regexp_full_match(x.token, '[a-z]{3,30}') OR x.zipf >= 4.2 THEN x.token WHEN i.zipf >= 4.2 THEN i.word ELSE x.token END AS repaired FROM x LEFT JOIN i ON i.key = x.token)
SELECT token, repaired, n FROM r WHERE token <> repaired""",
    "merge_prefixes": sql.TOKENS + """, a AS (SELECT *, lead(token) OVER (PARTITION BY doc_id ORDER BY pos) AS nx FROM l),
b AS (SELECT a.*, token IN ('sur', 'break', 'out', 'room') AND token || nx IN (SELECT token FROM l) AS hit FROM a),
c AS (SELECT *, coalesce(lag(coalesce(hit, false)) OVER (PARTITION BY doc_id ORDER BY pos), false) AS eaten FROM b)
SELECT doc_id, count(*) AS n FROM c WHERE NOT eaten GROUP BY doc_id""",
    "strip_accents": f"SELECT doc_id, {sql.accents_stripped("coalesce(text, '')")} AS plain, {sql.accents_stripped("coalesce(text, '')", True)} AS with_enie FROM documents",
    "clean_en": f"SELECT doc_id, {sql.cleaned('text', 'en')} AS cleaned FROM documents",
    "clean_es": f"SELECT doc_id, {sql.cleaned('text', 'es')} AS cleaned FROM documents",
    "clean_zh": f"SELECT doc_id, {sql.cleaned('text', 'zh')} AS cleaned FROM documents",
    "annotate": f"WITH c AS (SELECT doc_id, {sql.cleaned('text', 'en')} AS clean FROM documents), {sql.tagged_english('c').replace('g AS (SELECT doc_id, pos, pos_tag, coalesce', 'g AS (SELECT doc_id, pos, pos_tag, raw_lemma, coalesce')} SELECT pos_tag AS pos, count(*) AS n, count(DISTINCT raw_lemma) AS lemmas FROM g GROUP BY pos_tag",
    "normalize_app": f"""WITH n AS (SELECT doc_id, lower({sql.accents_stripped("regexp_replace(coalesce(text, ''), '[\\p{Cf}\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x9f]', '', 'g')")}) AS s FROM documents)
SELECT doc_id, regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, 'https?://[^\\s]+|www\\.[^\\s]+', ' ', 'g'), '@[\\p{{L}}\\p{{N}}_]+', ' ', 'g'), '#([\\p{{L}}\\p{{N}}_]+)', ' \\1 ', 'g'), '[\\r\\n\\t]+', ' ', 'g'), '[^a-z0-9\\x{{4e00}}-\\x{{9fff}} ]+', ' ', 'g'), ' {{2,}}', ' ', 'g')),
 '\\blas\\s+vegas\\b', 'las_vegas', 'g'), '\\bcasa\\s+playa\\b', 'casa_playa', 'g') AS norm FROM n""",
}
