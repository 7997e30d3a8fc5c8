"""Queries that fit models or run streams; SQL can't express them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.operators import corpus, models, topics
from topicloom.session import shared_dir, spread, table
from topicloom.streaming import topics as streams


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.preprocess_basic(spread(table(spark, sf_dir, "documents")), "doc_id", "text")


def lda_topics(spark, sf_dir):
    return models.lda_topics(models.fit_lda(_docs(spark, sf_dir), "doc_id", 8, 10, "auto"), 20)


def lda_assignments(spark, sf_dir):
    return models.lda_assignments(models.fit_lda(_docs(spark, sf_dir), "doc_id", 8, 10, "auto"), "doc_id")


def lite_cluster(spark, sf_dir):
    got = models.fit_clusters(_docs(spark, sf_dir), "doc_id", 6)
    return got.labels.join(got.points, "doc_id")


def lite_cluster_terms(spark, sf_dir):
    return models.fit_clusters(_docs(spark, sf_dir), "doc_id", 6).words


def k_sweep(spark, sf_dir):
    return models.k_sweep(_docs(spark, sf_dir), "doc_id")


def tuning_grid(spark, sf_dir):
    return models.tune(_docs(spark, sf_dir), "doc_id", [4, 6], ["symmetric", 0.1])[0]


def word_map(spark, sf_dir):
    words = table(spark, sf_dir, "topic_words_long").select(F.col("Topic_ID").alias("topic_id"), F.col("Word").alias("word"), F.col("Weight").alias("weight"))
    return models.word_map(words, 0.01, 150)


def coherence(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    words = topics.top_words(models.fit_lda(docs, "doc_id", 6, alpha="symmetric").words, 10).cache()
    return spark.createDataFrame([(models.c_v(docs, words, "doc_id"), models.umass(docs, words, "doc_id"))], "c_v double, u_mass double")


def train_and_assign(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return models.train_and_assign(docs, _docs(spark, sf_dir), "doc_id", "text", 6).dictionary


def _stream(spark: SparkSession, sf_dir: str, make) -> DataFrame:
    """Run a stream over events until all is read, into a table in the shared folder, and return it."""
    schema = table(spark, sf_dir, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    where = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    out = make(source)
    spark.createDataFrame([], out.schema).write.parquet(f"{where}/out")  # stays where there are no events
    # complete, since a finite run never closes the windows after its last watermark; the last batch holds every window
    query = out.writeStream.outputMode("complete").foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(f"{where}/out")).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{where}/out")


def stream_topic_counts(spark, sf_dir):
    """All windows of the events, the last ones too."""
    got = _stream(spark, sf_dir, lambda s: streams.topic_counts(s, "ts", "event_type", "1 day", "1 day"))
    return got.withColumn("start", F.col("start").cast("timestamp_ntz"))


def stream_sessions(spark, sf_dir):
    """All sessions of the events, the last ones too."""
    got = _stream(spark, sf_dir, lambda s: streams.sessions(s, "ts", "user_id", "6 hours", "1 day"))
    return got.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz"))


QUERIES = {f.__name__: f for f in (lda_topics, lda_assignments, lite_cluster, lite_cluster_terms, k_sweep, tuning_grid, word_map, coherence, train_and_assign, stream_topic_counts, stream_sessions)}
SQL = {
    "stream_topic_counts": "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type AS topic_id, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL",
    "stream_sessions": """WITH a AS (SELECT user_id AS who, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WHERE ts IS NOT NULL),
b AS (SELECT *, sum(fresh) OVER (PARTITION BY who ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a)
SELECT who, min(ts)::TIMESTAMP AS start, (max(ts) + INTERVAL 6 HOUR)::TIMESTAMP AS "end", count(*) AS n FROM b GROUP BY who, s""",
}
