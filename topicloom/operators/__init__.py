"""Corpus, topic, ranking and record operators: DataFrame in, DataFrame out."""
