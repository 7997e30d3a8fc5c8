import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from topicloom.llm import packing


@pytest.fixture
def docs(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["hotel", "robot", "酒店", "café"]) for _ in range(rng.choice([1, 5, 20, 60, 400]))), "big" if i % 3 else rng.choice([None, "a", "b"]), 9) for i in range(400)]
    return spark.createDataFrame([*rows, (900, None, "a", 9), (901, "", "a", 9), (5, "twice", "a", 9)], "doc_id bigint, text string, source string, tokens int")


def test_whole_and_fitting(spark, docs, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_TOKENS", 8000)  # several shards
    limits = spark.createDataFrame([(1, 64), (2, 256)], "limit_id int, capacity int")
    count = packing.token_counter()
    size = defaultdict(list)
    for r in docs.where("length(text) > 0").collect():
        size[r.doc_id].append(count(r.text))
    rows = packing.pack(docs, limits).collect()
    assert {r.level for r in rows} == {1, 2}
    for capacity in (64, 256):
        own = [r for r in rows if r.capacity == capacity]
        fill = defaultdict(int)
        pieces = defaultdict(list)
        for r in own:
            fill[r.level, r.shard, r.container] += r.tokens
            pieces[r.doc_id].append((r.first_token, r.tokens))
        assert max(fill.values()) <= capacity
        for doc, sizes in size.items():
            want = sorted((a, min(capacity, n - a)) for n in sizes for a in range(0, n, capacity))
            assert sorted(pieces[doc]) == want
        assert set(pieces) == set(size)
        assert len(fill) <= 1.03 * sum(map(sum, size.values())) / capacity + 1
    assert packing.pack(docs.limit(0), limits).count() == 0 and packing.pack(docs, limits.limit(0)).count() == 0
    with pytest.raises(ValueError, match="capacities"):
        packing.pack(docs, spark.createDataFrame([(1, 0)], "limit_id int, capacity int"))


def test_mixture_is_kept_while_sources_last():
    rng = random.Random(6)
    texts = [(rng.randrange(5, 40), s, i, 0, 0) for i, s in enumerate(["x"] * 600 + ["y"] * 200 + ["z"] * 200)]
    queues = packing.Queues(texts, {"x": 0.5, "y": 0.3, "z": 0.2})
    got = defaultdict(int)
    for k, container in enumerate(queues.fill(100)):
        for t in container:
            got[t[1]] += t[0]
        if k > 20 and k < 80:
            total = sum(got.values())
            assert all(abs(got[s] / total - p) < 0.05 for s, p in {"x": 0.5, "y": 0.3, "z": 0.2}.items())
    assert sum(got.values()) == sum(t[0] for t in texts)


def test_deficits_are_carried():
    texts = [(10, s, i, 0, 0) for i, s in enumerate("xy" * 50)]
    first = next(iter(packing.Queues(texts, {"x": 0.5, "y": 0.5}, {"y": 200}).fill(100)))
    assert {t[1] for t in first} == {"y"}


def test_summary(spark, docs):
    limits = spark.createDataFrame([(1, 128)], "limit_id int, capacity int")
    packed = packing.pack(docs, limits)
    row = packing.summary(packed).first()
    assert row.fill > 0.95 and row.tokens == packed.agg(F.sum("tokens")).first()[0]
    assert abs(packing.mixture(packed).groupBy("level", "shard", "window").agg(F.sum("share").alias("s")).first().s - 1) < 1e-9


def test_sizes_are_those_of_the_tokenizer():
    import base64
    import importlib.util
    from pathlib import Path

    import tiktoken

    spec = importlib.util.spec_from_file_location("files", Path(packing.TOKENIZERS) / "__init__.py")
    files = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(files)
    with open(f"{packing.TOKENIZERS}/byte_bpe_multi_50k.tiktoken", "rb") as f:
        plain = tiktoken.Encoding("x", pat_str=files.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})
    count = packing.token_counter()
    word = "unforgettable hotel, 12 "
    for text in (word * 20_000, "x" * 300_000, "酒店" * 60_000, word + " " * 30_000 + word, "a" + "\n" * 20_000, " " * 20_001 + "b", "a" + " \t" * 9_000):
        assert count(text) == len(plain.encode_ordinary(text))
    assert count("a" + " " * 2_000_000 + "b") > 2


def test_every_source_brings_its_share(spark, monkeypatch):
    from topicloom.operators import joins

    rows = [(i, "hotel robot " * (1 + i % 4), f"s{i % 40}") for i in range(400)] + [(1000 + i, "room " * 3, None) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    limits = spark.createDataFrame([(1, 32)], "limit_id int, capacity int")
    want = sorted(map(tuple, packing.pack(df, limits).collect()), key=str)
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(joins, "HOT_ROWS", 100)
    assert sorted(map(tuple, packing.pack(df, limits).collect()), key=str) == want and len(want) == 600


def test_a_target_mixture(spark):
    rng = random.Random(9)
    rows = [(i, "hotel " * rng.randrange(1, 30), ["x", "x", "x", "x", "y", None][i % 6]) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    limits = spark.createDataFrame([(1, 128)], "limit_id int, capacity int")
    target = {"x": 0.4, "y": 0.3, None: 0.3}
    got = packing.deviations(packing.pack(df, limits, shares=target), target, 16).where("level = 1 and lasting").collect()
    assert len(got) >= 3 and max(r.deviation for r in got) < 0.03


def test_many_sources_take_near_linear_time():
    import time

    texts = [(1 + i % 9, f"s{i}", i, 0, 0) for i in range(20_000)]
    began = time.process_time()
    placed = sum(len(c) for c in packing.Queues(texts, {}).fill(2_000))
    assert placed == 20_000 and time.process_time() - began < 10
