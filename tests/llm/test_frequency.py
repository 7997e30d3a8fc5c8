import random
from collections import Counter, defaultdict

import pyarrow as pa

from topicloom.llm import frequency


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    rows = []
    for d in range(200):
        words = [f"w{int(rng.paretovariate(0.7)) % 90}" for _ in range(rng.randrange(0, 12))] + ["all"]
        for _ in range(rng.choice([1, 1, 1, 3])):
            rows.append((d if d else None, "  ".join(words) + "\n", "x"))
    rows += [(1000, None, "x"), (1001, "  ", "x"), (5, "other delivery all", "x")] + [(7, "hot one", "x")] * 300
    df = spark.createDataFrame(rows, "doc_id bigint, toks string, token string").repartition(5)
    occ, recs = Counter(), defaultdict(set)
    for d, t, _ in rows:
        for w in (t or "").split():
            occ[w] += 1
            recs[w].add(d)
    n = len({d for d, t, _ in rows if (t or "").split()})
    got = {r.token: (r.occurrences, r.records, r.mark) for r in frequency.marked_tokens(df, "doc_id", "toks").collect()}
    want = {w: (occ[w], len(s), "rare" if len(s) < 10 else "common" if len(s) >= -(-6 * n // 10) else None) for w, s in recs.items()}
    assert got == want
    assert frequency.marked_tokens(df.limit(0), "doc_id", "toks").count() == 0


def test_handing_on_early_is_exact(monkeypatch):
    batches = [pa.RecordBatch.from_pydict({"rec": [1, 1, 2], "tokens": ["a b", "a c", "a"], "times": [1, 2, 1]}), pa.RecordBatch.from_pydict({"rec": [2, 3], "tokens": ["a d", "a"], "times": [1, 1]})]
    totals = []
    for most in (0, 10**6):
        monkeypatch.setattr(frequency, "MOST_COUNTERS", most)
        sums = defaultdict(lambda: [0, 0])
        for b in frequency._last_seen(iter(batches)):
            for t, o, r in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                sums[t][0] += o
                sums[t][1] += r
        totals.append(dict(sums))
    assert totals[0] == totals[1] == {"a": [6, 3], "b": [1, 1], "c": [2, 1], "d": [1, 1], None: [0, 3]}


def test_hot_records_are_spread(spark, monkeypatch):
    rows = [(None if i % 3 == 0 else i, f"w{i % 7} all\u00a0w{i % 5}\x1cx") for i in range(300)] + [(None, " "), (None, None)]
    df = spark.createDataFrame(rows, "doc_id int, toks string")
    want = sorted(map(tuple, frequency.token_counts(df, "doc_id", "toks").collect()), key=str)
    monkeypatch.setattr(frequency, "HOT_DELIVERIES", 20)
    assert sorted(map(tuple, frequency.token_counts(df, "doc_id", "toks").collect()), key=str) == want
    assert ("all", 300, 201) in want and (None, 0, 201) in want
