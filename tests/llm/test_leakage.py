import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from topicloom.llm import leakage
from topicloom.llm.visual import Form, unicode_patterns

FORM = Form(unicode_patterns())


def brute(docs, items, least):
    out = {}
    for d, dt in docs:
        a = leakage.words(FORM, dt)
        for i, it in items:
            b = leakage.words(FORM, it)
            best = 0
            row = [0] * (len(b) + 1)
            for x in a:
                new = [0] * (len(b) + 1)
                for k, y in enumerate(b):
                    if x == y:
                        new[k + 1] = row[k] + 1
                        best = max(best, new[k + 1])
                row = new
            if best >= least:
                out[d, i] = max(best, out.get((d, i), 0))
    return out


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    items = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 30)))) for i in range(12)] + [(90, None), (91, "")]
    docs = []
    for d in range(60):
        text = [rng.choice("abcdefghxyz") for _ in range(rng.randrange(0, 60))]
        i = rng.choice(items[:12])[1].split()
        k = rng.randrange(0, len(i))
        docs.append((d, "  ".join(text + [w.upper() + "," for w in i[k : k + rng.randrange(1, 20)]] + text[:5])))
    docs += [(200, None), (201, ""), (5, items[0][1])]
    monkeypatch.setattr(leakage, "BLOCK_CHARS", 60)  # several blocks of items
    df = spark.createDataFrame([(*d, 0) for d in docs], "doc_id int, text string, words int")
    it = spark.createDataFrame(items, "item_id int, text string")
    got = {(r.doc_id, r.item_id): r.words for r in leakage.matches(df, "doc_id", "text", it, "item_id", "text", 5).collect()}
    assert got == brute(docs, items, 5)
    found = leakage.matches(df, "doc_id", "text", it, "item_id", "text", 5)
    left = {r.doc_id for r in leakage.without_leaks(df, found, "doc_id").collect()}
    assert left == {d for d, _ in docs} - {d for d, _ in got}
    assert leakage.matches(df.limit(0), "doc_id", "text", it, "item_id", "text").count() == 0
    assert leakage.matches(df, "doc_id", "text", it.limit(0), "item_id", "text").count() == 0


def test_looks_and_places(spark):
    df = spark.createDataFrame([(1, "so: The ｃafé  оf— Lyon, WAS​ closed!")], "doc_id int, text string")
    it = spark.createDataFrame([(7, "the café of lyon was closed again")], "item_id int, text string")
    assert [tuple(r) for r in leakage.matches(df, "doc_id", "text", it, "item_id", "text", 6).collect()] == [(1, 7, 6, 1, 0)]
    assert leakage.matches(df, "doc_id", "text", it, "item_id", "text", 7).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40), st.integers(1, 5))
def test_suffix_hashes(ids, least):
    hashes, where = leakage.suffix_hashes(np.array(ids, np.uint32), least)
    assert list(where) == [i for i in range(len(ids) - least + 1) if all(ids[i : i + least])]
    assert len(hashes) == len(where)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=1, max_size=60))
def test_rank_tables_sort_in_full(ids):
    seq = np.array([*ids, 0])
    tables = leakage.rank_tables(seq)
    marked = [(0, i) if w else (1, 10 + i, 0) for i, w in enumerate(seq)]
    full = [[(w, 0) if w else (9, i) for i, w in list(enumerate(seq))[k:]] for k in range(len(seq))]
    assert len(marked) == len(full)
    assert list(np.argsort(tables[-1], kind="stable")) == sorted(range(len(seq)), key=lambda k: full[k])
    for a in range(len(seq)):
        for b in range(len(seq)):
            same = 0
            while a != b and same < min(len(full[a]), len(full[b])) and full[a][same] == full[b][same]:
                same += 1
            assert a == b or leakage.common_words(tables, np.array([a]), np.array([b]))[0] == same


def test_a_passage_shared_by_many_items_and_documents():
    import tracemalloc

    form = Form(unicode_patterns())
    passage = " ".join(f"word{i}" for i in range(30))
    tests = leakage.TestSet([(i, f"item{i} {passage} end{i}") for i in range(300)], 12, form)
    ids = np.array([*([*(tests.number[f"word{i}"] for i in range(30)), 0] * 1000)], np.uint32)
    tracemalloc.start()
    pairs = 0
    for found in leakage.longest(tests, ids, 12):
        assert set(found[:, 3]) == {30}
        pairs += len(found)
    assert pairs == 300 * 1000  # one row for each document and item
    assert tracemalloc.get_traced_memory()[1] < 150e6
    tracemalloc.stop()
