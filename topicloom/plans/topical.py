"""Queries of the topic layer, over given assignments and topic words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.operators import corpus, evolution, models, topics
from topicloom.plans import sql
from topicloom.session import table


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "docs_out").select("row_id", F.col("Topic_ID").alias("topic_id"), F.col("Topic_Score").alias("score"), "analysis_text", "published_at")


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "topic_words_long").select(F.col("Topic_ID").alias("topic_id"), F.col("Word").alias("word"), F.col("Weight").alias("weight"))


def _lists(spark: SparkSession, sf_dir: str, n: int = 80) -> DataFrame:
    rows = topics.top_words(_words(spark, sf_dir), n).groupBy("topic_id").agg(F.array_sort(F.collect_list(F.struct("rank", "word"))).alias("l"))
    return rows.select("topic_id", F.col("l.word").alias("words"))


def topic_doc_counts_dense(spark, sf_dir):
    return topics.dense_counts(_assigned(spark, sf_dir), 16)


def topic_pct(spark, sf_dir):
    return topics.shares(_assigned(spark, sf_dir))


def cumulative_share(spark, sf_dir):
    return topics.cumulative_share(topics.shares(_assigned(spark, sf_dir)).select("topic_id", "n"))


def topic_names_default(spark, sf_dir):
    names = table(spark, sf_dir, "topic_dictionary").select("topic_id", F.col("topic_short_name").alias("name")).where("topic_id < 6")
    return topics.with_names(topic_doc_counts_dense(spark, sf_dir), names)


def top_words_per_topic(spark, sf_dir):
    return topics.top_words(_words(spark, sf_dir), 15)


def topic_table(spark, sf_dir):
    return topics.topic_table(_words(spark, sf_dir), 20)


def topic_words_long(spark, sf_dir):
    rows = topics.top_words(_words(spark, sf_dir), 10).groupBy("topic_id").agg(F.array_sort(F.collect_list(F.struct("rank", "word", "weight"))).alias("l"))
    return topics.words_long(rows.select("topic_id", F.col("l.word").alias("words"), F.col("l.weight").alias("weights")))


def normalized_weights(spark, sf_dir):
    return topics.normalized(_words(spark, sf_dir)).withColumn("weight", F.round("weight", 6))


def representative_docs(spark, sf_dir):
    return topics.representatives(_assigned(spark, sf_dir), "row_id")


def argmax_assignment(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))
    return topics.assignments(df, "vec_id", "v").withColumn("score", F.round("score", 6))


def best_topic_of_word(spark, sf_dir):
    return topics.best_topic_of_word(_words(spark, sf_dir), 0.01, 100)


def label_top_words(spark, sf_dir):
    return topics.best_topic_of_word(_words(spark, sf_dir), 0.0, 20)


def cosine_pairs(spark, sf_dir):
    return topics.word_similarity(_words(spark, sf_dir))


def jaccard_topics(spark, sf_dir):
    return topics.jaccard(_words(spark, sf_dir))


def topic_naming_rules(spark, sf_dir):
    return topics.named(_lists(spark, sf_dir, 25)).select("topic_id", "short_name", "description")


def topic_dictionary_rows(spark, sf_dir):
    names = topics.named(_lists(spark, sf_dir, 25))
    docs = _assigned(spark, sf_dir)
    rows = topics.dictionary(docs, _words(spark, sf_dir), names, "row_id", "analysis_text")
    return rows.select("topic_id", "topic_short_name", "num_docs_assigned", "pct_training_docs", "repr_doc_1_theta", "repr_doc_2_theta", "top_15_words")


def docs_with_topics(spark, sf_dir):
    docs = table(spark, sf_dir, "docs_out").select("row_id", "video_id")
    tops, names = topics.top_words(_words(spark, sf_dir), 25), topics.named(_lists(spark, sf_dir, 25))
    assigned = _assigned(spark, sf_dir).where("topic_id >= 0")
    return topics.attached(docs, "row_id", assigned, names, tops).select("row_id", "video_id", "topic_id", "topic_name", "score", "top3_words")


def cluster_centroids(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings").select("label", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return topics.centroids(df, "label", "x", "y")


def cluster_top_terms(spark, sf_dir):
    docs = corpus.preprocess_basic(table(spark, sf_dir, "documents"), "doc_id", "text")
    kinds = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("doc_kind", F.lit("")).alias("topic_id"))
    return models.cluster_terms(models.tfidf(docs, "doc_id"), kinds, "doc_id", 10).withColumn("weight", F.round("weight", 4))


def period_topic_counts(spark, sf_dir):
    return evolution.counts(_assigned(spark, sf_dir), "published_at", "topic_id", "M")


def period_topic_counts_quarter(spark, sf_dir):
    return evolution.counts(table(spark, sf_dir, "orders"), "o_orderdate", "o_orderpriority", "Q").withColumnRenamed("topic_id", "priority")


def retained_periods(spark, sf_dir):
    return evolution.retained(period_topic_counts(spark, sf_dir), 30).select("period", "topic_id", "n", F.col("ord").cast("bigint").alias("ord"))


def topic_evolution_edges(spark, sf_dir):
    rows = evolution.retained(period_topic_counts(spark, sf_dir), 30)
    return evolution.edges(rows, _lists(spark, sf_dir), 0.05)


def topic_evolution_nodes(spark, sf_dir):
    rows = evolution.retained(period_topic_counts(spark, sf_dir), 30)
    return evolution.nodes(rows, evolution.edges(rows, _lists(spark, sf_dir), 0.05)).select(F.col("id").cast("bigint").alias("id"), "period", "topic_id", "label")


def ordered_split(spark, sf_dir):
    return models.ordered_split(table(spark, sf_dir, "docs_out").select("row_id"), "row_id")


def sample_docs(spark, sf_dir):
    return models.sampled(table(spark, sf_dir, "docs_out").select("row_id"), "row_id")


def _sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sweep as a table: K from the topic ids of the dictionary, with the numbers of documents and shares as its two curves."""
    rows = table(spark, sf_dir, "topic_dictionary").where("num_docs_assigned is not null and pct_training_docs is not null")
    return rows.select((F.col("topic_id") + 2).alias("K"), (F.col("num_docs_assigned") * 1.0).alias("perplexity"), (F.col("pct_training_docs") / 100.0 + F.col("topic_id") * 0.003).alias("coherence_cv"))


def kneedle(spark, sf_dir):
    return models.turning_points(_sweep(spark, sf_dir))


def best_grid_row(spark, sf_dir):
    return models.best_row(_sweep(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (topic_doc_counts_dense, topic_pct, cumulative_share, topic_names_default, top_words_per_topic, topic_table, topic_words_long, normalized_weights, representative_docs, argmax_assignment, best_topic_of_word, label_top_words, cosine_pairs, jaccard_topics, topic_naming_rules, topic_dictionary_rows, docs_with_topics, cluster_centroids, cluster_top_terms, period_topic_counts, period_topic_counts_quarter, retained_periods, topic_evolution_edges, topic_evolution_nodes, ordered_split, sample_docs, kneedle, best_grid_row)
}


def _naming() -> str:
    from topicloom.plans.sql import quoted

    hits = ", ".join(f"struct_pack(h := len(list_filter(ws, lambda w: w IN ({quoted(c)}))), i := -{i}, name := '{name}')" for i, (name, c) in enumerate(topics.CLUES.items()))
    cases = " ".join(f"WHEN list_has_any(ws, [{quoted(list(one))}])" + (f" AND list_has_any(ws, [{quoted(list(two))}])" if two else "") + f" THEN '{name}'" for name, one, two in topics.RULES)
    return f""", s AS (SELECT topic_id, list_transform(words[1:15], lambda w: lower(w)) AS ws, words FROM w25),
u AS (SELECT *, list_filter([{hits}], lambda x: x.h >= 3) AS found FROM s),
x AS (SELECT *, CASE {cases} ELSE '{topics.DEFAULT_SUFFIX}' END AS suffix FROM u),
names AS (SELECT topic_id, 'T' || lpad(topic_id::VARCHAR, 2, '0') || '_' || CASE WHEN len(found) > 0 THEN 'MULTI_' || regexp_replace(replace(list_max(found).name, ' ', ''), '[^a-zA-Z0-9]', '_', 'g') ELSE 'EN' END || '_' || suffix AS short_name,
 'Top-10 words: ' || array_to_string(ws[1:10], ', ') || '.' || CASE WHEN len(found) > 0 THEN ' Detected multilingual function-word signal: [' || array_to_string(list_transform(found, lambda f: '(' || chr(39) || f.name || chr(39) || ', ' || f.h || ')'), ', ') || '].' ELSE '' END
 || ' Auto-suffix label=' || suffix || '. Review top-words + representative docs below to refine name.' AS description FROM x)
"""


_A = 'WITH a AS (SELECT row_id, "Topic_ID" AS topic_id, "Topic_Score" AS score, analysis_text, published_at FROM docs_out)\n'
_R = """, r AS (SELECT "Topic_ID" AS topic_id, "Word" AS word, "Weight" AS weight, (row_number() OVER (PARTITION BY "Topic_ID" ORDER BY "Weight" DESC, "Word"))::INTEGER AS rank FROM topic_words_long),
w25 AS (SELECT topic_id, list(word ORDER BY rank) AS words FROM r WHERE rank <= 25 GROUP BY topic_id)
"""
_RW = "WITH" + _R[1:]
_C = _A + ", c AS (SELECT topic_id, count(*) AS n FROM a WHERE topic_id >= 0 GROUP BY topic_id)\n"
_DENSE = ", e AS (SELECT g.i::INTEGER AS topic_id, count(a.row_id) AS n FROM range(16) g(i) LEFT JOIN a ON a.topic_id = g.i GROUP BY g.i)\n"
_BEST = _RW + ", b AS (SELECT word, topic_id, weight AS prob FROM r QUALIFY row_number() OVER (PARTITION BY word ORDER BY weight DESC, topic_id) = 1)\n"
_P = _A + ", p AS (SELECT date_trunc('month', published_at)::TIMESTAMP AS period, topic_id, count(*) AS n FROM a WHERE published_at IS NOT NULL GROUP BY ALL)\n"
_K = _P + ", k AS (SELECT period, row_number() OVER (ORDER BY period) AS ord FROM (SELECT period FROM p GROUP BY period HAVING sum(n) >= 30)), q AS (SELECT p.*, ord FROM p JOIN k USING (period))\n"
_E = _K + _R + """, f AS (SELECT q.*, coalesce(words, []) AS s FROM q LEFT JOIN w25 USING (topic_id)),
g AS (SELECT x.period AS source_period, x.topic_id AS source_topic, y.period AS target_period, y.topic_id AS target_topic, least(x.n, y.n) AS c,
 CASE WHEN len(x.s) = 0 OR len(y.s) = 0 THEN CASE WHEN x.topic_id = y.topic_id THEN 1.0 ELSE 0.0 END::DOUBLE ELSE len(list_intersect(x.s, y.s)) / greatest(1, len(list_distinct(list_concat(x.s, y.s)))) END AS sim
 FROM f x JOIN f y ON y.ord = x.ord + 1),
e AS (SELECT source_period, source_topic, target_period, target_topic, round(c * sim, 6) AS value FROM g WHERE sim >= 0.05 AND round(c * sim, 6) > 0)
"""
_V = """WITH s AS (SELECT topic_id + 2 AS K, num_docs_assigned * 1.0::DOUBLE AS perplexity, pct_training_docs / 100.0::DOUBLE + topic_id * 0.003::DOUBLE AS coherence_cv FROM topic_dictionary
 WHERE num_docs_assigned IS NOT NULL AND pct_training_docs IS NOT NULL)
"""
SQL = {
    "topic_doc_counts_dense": _A + _DENSE + "SELECT topic_id, n FROM e",
    "topic_pct": _C + "SELECT topic_id, n, round(100.0 * n / (SELECT sum(n) FROM c), 2)::DOUBLE AS pct FROM c",
    "cumulative_share": _C + "SELECT topic_id, n, round((sum(n) OVER (ORDER BY n DESC, topic_id ROWS UNBOUNDED PRECEDING))::DOUBLE / (SELECT sum(n) FROM c), 6) AS cum_share FROM c",
    "topic_names_default": _A + _DENSE + "SELECT e.topic_id, n, coalesce(topic_short_name, 'Topic ' || (e.topic_id + 1)) AS name FROM e LEFT JOIN (SELECT * FROM topic_dictionary WHERE topic_id < 6) t ON t.topic_id = e.topic_id",
    "top_words_per_topic": _RW + "SELECT topic_id, rank, word, weight FROM r WHERE rank <= 15",
    "topic_table": _RW + "SELECT topic_id, string_agg(word, ', ' ORDER BY rank) AS words FROM r WHERE rank <= 20 GROUP BY topic_id",
    "topic_words_long": _RW + 'SELECT topic_id AS "Topic_ID", rank AS "Rank", word AS "Word", weight AS "Weight" FROM r WHERE rank <= 10',
    "normalized_weights": _RW + "SELECT topic_id, word, round(weight / sum(weight) OVER (PARTITION BY topic_id), 6) AS weight FROM r",
    "representative_docs": _A + "SELECT topic_id, rank, row_id, score FROM (SELECT *, (row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, row_id))::INTEGER AS rank FROM a WHERE topic_id >= 0 AND score IS NOT NULL) WHERE rank <= 2",
    "argmax_assignment": "SELECT vec_id, (list_position(v, list_max(v)) - 1)::INTEGER AS topic_id, round(list_max(v), 6) AS score FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)",
    "best_topic_of_word": _BEST + "SELECT word, topic_id, prob FROM b WHERE prob >= 0.01 ORDER BY prob DESC, word LIMIT 100",
    "label_top_words": _BEST + "SELECT word, topic_id, prob FROM b ORDER BY prob DESC, word LIMIT 20",
    "cosine_pairs": _RW + """, n AS (SELECT word, sqrt(sum(weight * weight)) AS norm FROM r GROUP BY word),
p AS (SELECT a.word AS a, b.word AS b, sum(a.weight * b.weight) AS dot FROM r a JOIN r b ON a.topic_id = b.topic_id AND a.word < b.word GROUP BY a.word, b.word)
SELECT a, b, greatest(0.0, round(1 - dot / (x.norm * y.norm), 6)) AS distance FROM p JOIN n x ON x.word = a JOIN n y ON y.word = b""",
    "jaccard_topics": _RW + """, p AS (SELECT x.topic_id AS a, y.topic_id AS b, count(*) AS c FROM r x JOIN r y ON x.word = y.word AND x.topic_id < y.topic_id GROUP BY ALL), z AS (SELECT topic_id, count(*) AS k FROM r GROUP BY topic_id)
SELECT a, b, round(c / (x.k + y.k - c), 6) AS jaccard FROM p JOIN z x ON x.topic_id = a JOIN z y ON y.topic_id = b""",
    "topic_naming_rules": _RW + _naming() + "SELECT topic_id, short_name, description FROM names",
    "topic_dictionary_rows": _C + _R + _naming() + """, b AS (SELECT topic_id, score, row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, row_id) AS k FROM a WHERE topic_id >= 0 AND score IS NOT NULL)
SELECT names.topic_id, short_name AS topic_short_name, coalesce(n, 0) AS num_docs_assigned, coalesce(round(100.0 * n / (SELECT sum(n) FROM c), 2), 0)::DOUBLE AS pct_training_docs,
 (SELECT score FROM b WHERE b.topic_id = names.topic_id AND k = 1) AS repr_doc_1_theta, (SELECT score FROM b WHERE b.topic_id = names.topic_id AND k = 2) AS repr_doc_2_theta,
 (SELECT string_agg(word, ', ' ORDER BY rank) FROM r WHERE r.topic_id = names.topic_id AND rank <= 15) AS top_15_words FROM names LEFT JOIN c USING (topic_id)""",
    "docs_with_topics": "WITH o AS (SELECT row_id, video_id, \"Topic_ID\" AS topic_id, \"Topic_Score\" AS score FROM docs_out)\n" + _R + _naming() + """SELECT o.row_id, o.video_id, o.topic_id, CASE WHEN o.topic_id < 0 THEN 'N/A (empty preprocessing)' ELSE short_name END AS topic_name,
 CASE WHEN o.topic_id >= 0 THEN score END AS score, t.words AS top3_words FROM o LEFT JOIN names USING (topic_id) LEFT JOIN (SELECT topic_id, string_agg(word, ', ' ORDER BY rank) AS words FROM r WHERE rank <= 3 GROUP BY topic_id) t USING (topic_id)""",
    "cluster_centroids": "SELECT label AS topic_id, round(avg(embedding[1]::DOUBLE), 6) AS x, round(avg(embedding[2]::DOUBLE), 6) AS y, count(*) AS n FROM embeddings GROUP BY label",
    "period_topic_counts": _P + "SELECT period, topic_id, n FROM p",
    "period_topic_counts_quarter": "SELECT date_trunc('quarter', o_orderdate)::TIMESTAMP AS period, o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY ALL",
    "retained_periods": _K + "SELECT period, topic_id, n, ord FROM q",
    "topic_evolution_edges": _E + "SELECT source_period, source_topic, target_period, target_topic, value FROM e",
    "topic_evolution_nodes": _E + """, n AS (SELECT period, topic_id FROM q WHERE ord < (SELECT max(ord) FROM q) UNION SELECT target_period, target_topic FROM e)
SELECT row_number() OVER (ORDER BY period, topic_id) - 1 AS id, period, topic_id, strftime(period, '%Y-%m') || ' · T' || (topic_id + 1) AS label FROM n""",
    "sample_docs": "SELECT row_id FROM docs_out ORDER BY md5('42|' || row_id), row_id LIMIT 800",
    "ordered_split": "SELECT row_id, row_number() OVER (ORDER BY row_id) <= greatest(5, floor(round(count(*) OVER () * 0.8, 9))) AS train FROM docs_out",
    "kneedle": _V + """, e AS (SELECT min(K) AS k0, max(K) AS k1, arg_min(coherence_cv, K) AS c0, arg_max(coherence_cv, K) AS c1, arg_min(-perplexity, K) AS p0, arg_max(-perplexity, K) AS p1 FROM s),
d AS (SELECT s.*, coherence_cv - (c0 + (c1 - c0) / (k1 - k0) * (K - k0)) AS dc, -perplexity - (p0 + (p1 - p0) / (k1 - k0) * (K - k0)) AS dp, lead(coherence_cv) OVER (ORDER BY K) - coherence_cv AS jump, lead(K) OVER (ORDER BY K) AS nk FROM s, e),
r AS (SELECT arg_max(K, dc) AS a, arg_max(K, dp) AS b, arg_max(K, coherence_cv) AS c, arg_min(K, perplexity) AS p, arg_max(K, jump) AS jf, arg_max(nk, jump) AS jt FROM d)
SELECT a AS "cv_knee_K", b AS "perplexity_elbow_K", c AS "cv_best_K", p AS "perplexity_best_K", floor(list_aggregate(list_distinct(CASE WHEN len(list_filter([a, b, c], lambda k: k BETWEEN 4 AND 14)) > 0 THEN list_filter([a, b, c], lambda k: k BETWEEN 4 AND 14) ELSE [a, b, c] END), 'median'))::INTEGER AS "recommended_K_composite", jf AS jump_from, jt AS jump_to FROM r""",
    "best_grid_row": _V + "SELECT K, perplexity, coherence_cv FROM s ORDER BY coherence_cv DESC, K LIMIT 1",
    "cluster_top_terms": sql.TOKENS + """, c AS (SELECT doc_id, token, count(*) AS n FROM l GROUP BY doc_id, token),
q AS (SELECT token, count(*) AS df, sum(n) AS tf FROM c GROUP BY token), t AS (SELECT count(*) AS total FROM d),
k AS (SELECT token, ln((1 + total) / (1 + q.df)) + 1 AS idf FROM q, t WHERE q.df >= 2 AND q.df <= total * 0.95 ORDER BY tf DESC, token LIMIT 5000),
w AS (SELECT doc_id, token, n * idf AS w FROM c JOIN k USING (token)), z AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY doc_id),
y AS (SELECT coalesce(doc_kind, '') AS topic_id, token AS word, round(sum(w / norm), 6) AS weight FROM w JOIN z USING (doc_id) JOIN documents USING (doc_id) GROUP BY 1, 2)
SELECT topic_id, rank, word, round(weight, 4) AS weight FROM (SELECT *, (row_number() OVER (PARTITION BY topic_id ORDER BY weight DESC, word))::INTEGER AS rank FROM y) WHERE rank <= 10""",
}
