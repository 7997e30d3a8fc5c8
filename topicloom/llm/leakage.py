"""Evaluation passages inside training text: which documents hold them and which items leak (problem 8).

Each task builds suffix arrays over shards of its training text, as sequences of words, and binary-searches every
suffix of the test items in them. A match counts from ``least`` words on; the longest verbatim match of each document and
item comes out with its place in both.

Words are runs of letters and digits of the visual form, without case. A passage can only match where all its words
occur in some test item, so words outside the test vocabulary end a run, and only suffixes whose first ``least`` words
begin some test suffix, judged by a hash first, enter the array: that drops no match. Training and test suffixes are
ranked together by prefix doubling, which sorts them in full and leaves a table of ranks for each power of two; from
these the length of any match is read off in a few steps. A test suffix matches an interval of the array. Of an interval
only the suffixes with another word before them begin a match, so a passage that many items and documents share gives one row for each
document and item, not one for each of its words; rows are made ``CHUNK`` at a time.

The test set goes to the tasks by broadcast, in blocks of a checked size, each block against all rows: a large test set costs
more passes but no more memory, at the driver neither. Documents are never shuffled; only the matches are.

Defined cases: null and empty texts have no words; items shorter than ``least`` words can't leak; items that share a
passage are each reported; a document id that repeats is reported once for an item; empty tables give no matches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import chain, repeat
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from topicloom.llm.visual import Form, unicode_patterns
from topicloom.session import ship, written

LEAST_WORDS = 12
#: Characters of test text that a task holds at once.
BLOCK_CHARS = 32_000_000
#: Words of training text in one shard.
SHARD_WORDS = 1_000_000
#: Matches that are held at once.
CHUNK = 500_000
_WORD = re.compile(r"[^\W_]+")


def words(form: Form, text: str | None) -> list[str]:
    return _WORD.findall(form(text).casefold()) if text else []


def item_blocks(items: DataFrame, item: str, text: str) -> Iterator[list[tuple]]:
    """The test items in blocks of at most ``BLOCK_CHARS`` characters, a longer item alone; one block after the other is fetched."""
    rows = items.select(F.col(item).alias("i"), F.col(text).cast("string").alias("t")).where(F.length("t") > 0)
    block, size = [], 0
    for r in rows.toLocalIterator():
        if block and size + len(r.t) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((r.i, r.t))
        size += len(r.t)
    if block:
        yield block


class TestSet:
    """The test items as numbered words, with the hashes of all their suffixes."""

    __test__ = False

    def __init__(self, block: list[tuple], least: int, form: Form) -> None:
        self.number: dict[str, int] = {}
        ids, item, offset = [], [], []
        for i, (_, text) in enumerate(block):
            got = [self.number.setdefault(w, len(self.number) + 1) for w in words(form, text)]
            ids += [*got, 0]
            item += [i] * (len(got) + 1)
            offset += range(len(got) + 1)
        self.ids, self.item, self.offset = np.array(ids, np.uint32), np.array(item, np.int64), np.array(offset, np.int64)
        self.hashes, self.where = suffix_hashes(self.ids, least)
        self.sorted = np.unique(self.hashes)


def suffix_hashes(ids: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of the suffixes that begin with ``least`` words none of which is 0."""
    stop = np.where(ids == 0, np.arange(len(ids)), len(ids))
    stop = np.minimum.accumulate(stop[::-1])[::-1]
    where = np.flatnonzero(stop - np.arange(len(ids)) >= least)
    out = np.zeros(len(where), np.uint64)
    for k in range(least):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + ids[where + k]
    return out, where


def among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which of the values are in a sorted array."""
    at = np.searchsorted(ordered, values)
    return (at < len(ordered)) & (ordered[np.minimum(at, len(ordered) - 1)] == values) if len(ordered) else np.zeros(len(values), bool)


def stretches(ids: np.ndarray, where: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(words, places): the words from each position on for ``least`` words, a 0 between stretches and at the end, and where
    the positions went."""
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, where, 1)
    np.add.at(edge, where + least, -1)
    kept = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
    gaps = np.flatnonzero(np.diff(kept) > 1) + 1
    places = np.searchsorted(kept, where)
    return np.append(np.insert(ids[kept], gaps, 0), 0).astype(np.int64), places + np.searchsorted(gaps, places, "right")


def rank_tables(seq: np.ndarray) -> list[np.ndarray]:
    """For each power of two the ranks of all suffixes by so many first words; no 0 equals another. The last sorts in full."""
    seq = seq.copy()
    zero = np.flatnonzero(seq == 0)
    longest = int(np.diff(np.append(-1, zero)).max())
    seq[zero] = seq.max() + 1 + np.arange(len(zero))
    tables = [np.unique(seq, return_inverse=True)[1].astype(np.int64)]
    step = 1
    while step < longest and tables[-1].max() < len(seq) - 1:
        later = np.zeros(len(seq), np.int64)
        later[:-step] = tables[-1][step:] + 1
        tables.append(np.unique(tables[-1] * (len(seq) + 1) + later, return_inverse=True)[1].astype(np.int64))
        step *= 2
    return tables


def common_words(tables: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words the suffixes at ``a`` and ``b`` have in common at their beginnings."""
    start = a.copy()
    for k in reversed(range(len(tables))):
        same = (tables[k][a] == tables[k][b]).astype(np.int64) << k
        a, b = a + same, b + same
    return a - start


def longest(tests: TestSet, ids: np.ndarray, least: int) -> Iterator[np.ndarray]:
    """Rows (item, position in the shard, offset in the item, words) of the matches that can't be longer, ``CHUNK`` at a time."""
    hashes, where = suffix_hashes(ids, least)
    hit = among(hashes, tests.sorted)
    where = where[hit]
    if not len(where):
        return
    test = tests.where[among(tests.hashes, np.unique(hashes[hit]))]
    train_seq, train = stretches(ids, where, least)
    test_seq, test_at = stretches(tests.ids, test, least)
    tables = rank_tables(np.concatenate([train_seq, test_seq]))
    test_at = test_at + len(train_seq)
    level = least.bit_length() - 1
    if len(tables) <= level:
        return  # nothing is common but hashes

    def prefix(at: np.ndarray) -> np.ndarray:
        # ranks by the first ``least`` words: two overlapping powers of two
        return tables[level][at] * len(tables[0]) + tables[level][at + least - (1 << level)]

    array = np.argsort(tables[-1][train], kind="stable")  # the suffix array
    heads, wanted = prefix(train[array]), prefix(test_at)
    lo, hi = np.searchsorted(heads, wanted, "left"), np.searchsorted(heads, wanted, "right")
    # the suffixes of each interval by the word before them
    before = np.where(where > 0, ids[np.maximum(where, 1) - 1], 0).astype(np.int64)[array]
    begins = np.append(True, heads[1:] != heads[:-1])
    block = np.cumsum(begins) - 1
    most = len(tests.number) + 1
    order = np.lexsort((before, block))
    by_word = (block * most + before)[order]
    array = array[order]
    test_before = np.where(test > 0, tests.ids[np.maximum(test, 1) - 1], 0).astype(np.int64)
    key = np.where(lo < hi, block[np.minimum(lo, len(block) - 1)], -1) * most + test_before
    same_lo, same_hi = np.searchsorted(by_word, key, "left"), np.searchsorted(by_word, key, "right")
    open_ = (test_before == 0) | (lo == hi)  # no word before it: every suffix of the interval begins a match
    same_lo, same_hi = np.where(open_, hi, same_lo), np.where(open_, hi, same_hi)
    starts, stops = np.concatenate([lo, same_hi]), np.concatenate([same_lo, hi])
    owner = np.tile(np.arange(len(test)), 2)
    some = np.flatnonzero(stops > starts)
    starts, owner, sizes = starts[some], owner[some], (stops - starts)[some]
    ends = np.cumsum(sizes)
    for c in range(0, int(ends[-1]) if len(ends) else 0, CHUNK):
        flat = np.arange(c, min(c + CHUNK, int(ends[-1])))
        of = np.searchsorted(ends, flat, "right")
        got = array[starts[of] + flat - (ends[of] - sizes[of])]
        q = owner[of]
        size = common_words(tables, train[got], test_at[q])
        yield np.stack([tests.item[test[q]], where[got], tests.offset[test[q]], size], 1)


def best_of(docs: np.ndarray, found: np.ndarray) -> np.ndarray:
    """The rows of the longest match of each document and item, the earliest one on ties."""
    order = np.lexsort((found[:, 2], found[:, 1], -found[:, 3], found[:, 0], docs))
    d, i = docs[order], found[order, 0]
    first = np.append(True, (d[1:] != d[:-1]) | (i[1:] != i[:-1]))
    return order[first]


_SETS: dict[tuple, TestSet] = {}


def _test_set(held: tuple[str, list[tuple]], least: int, form: Form) -> TestSet:
    """The test set of a broadcast (name, block), made once in each Python process."""
    key = held[0], least
    if key not in _SETS:
        _SETS.clear()
        _SETS[key] = TestSet(held[1], least, form)
    return _SETS[key]


def matches(docs: DataFrame, doc: str, text: str, items: DataFrame, item: str, item_text: str, least: int = LEAST_WORDS) -> DataFrame:
    """(doc, item, words, doc_word, item_word): for each document and item the longest match and where it begins (0-based)."""
    ship(docs.sparkSession)
    if doc.lower() == item.lower():
        raise ValueError("the keys of documents and items need different names")
    source = docs.select(F.col(doc).alias("d"), F.col(text).cast("string").alias("t")).where(F.length("t") > 0)
    kind, item_kind = docs.schema[doc].dataType.simpleString(), items.schema[item].dataType.simpleString()
    schema = f"d {kind}, i {item_kind}, words bigint, doc_word bigint, item_word bigint"
    patterns = unicode_patterns()
    doc_type, item_type = to_arrow_type(docs.schema[doc].dataType), to_arrow_type(items.schema[item].dataType)

    def search(held) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            form = Form(patterns)
            tests = _test_set(held.value, least, form)
            names = pa.array([b[0] for b in held.value[1]], item_type)
            get = tests.number.get
            parts: list[np.ndarray] = []
            docs_, sizes, total = [], [], 0

            def flush() -> Iterator[pa.RecordBatch]:
                nonlocal parts, docs_, sizes, total
                starts = np.cumsum([0, *sizes[:-1]])
                ids_ = pa.array(docs_, doc_type)
                for found in longest(tests, np.concatenate(parts), least):
                    which = np.searchsorted(starts, found[:, 1], "right") - 1
                    best = best_of(which, found)
                    found, which = found[best], which[best]
                    yield pa.RecordBatch.from_arrays(
                        [ids_.take(pa.array(which)), names.take(pa.array(found[:, 0])), pa.array(found[:, 3]), pa.array(found[:, 1] - starts[which]), pa.array(found[:, 2])],
                        ["d", "i", "words", "doc_word", "item_word"],
                    )
                parts, docs_, sizes, total = [], [], [], 0

            for batch in batches:
                for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    got = list(map(get, words(form, t), repeat(0)))
                    parts.append(np.array([*got, 0], np.uint32))
                    docs_.append(d)
                    sizes.append(len(got) + 1)
                    total += len(got) + 1
                    if total >= SHARD_WORDS:
                        yield from flush()
            if total:
                yield from flush()

        best = F.max(F.struct("words", (-F.col("doc_word")).alias("d0"), (-F.col("item_word")).alias("i0"))).alias("m")
        return source.mapInArrow(run, schema).groupBy("d", "i").agg(best)

    # one block is searched when the result is read; of more, each is searched before the next is fetched
    context = docs.sparkSession.sparkContext
    blocks = item_blocks(items, item, item_text)
    first, second = next(blocks, None), next(blocks, None)
    if first is None:
        top = docs.sparkSession.createDataFrame([], f"d {kind}, i {item_kind}, m struct<words bigint, d0 bigint, i0 bigint>")
    elif second is None:
        top = search(context.broadcast((uuid4().hex, first)))
    else:
        found = []
        for block in chain((first, second), blocks):
            held = context.broadcast((uuid4().hex, block))
            found.append(written(search(held), "leaks"))
            held.destroy()
        top = reduce(DataFrame.unionAll, found).groupBy("d", "i").agg(F.max("m").alias("m"))
    return top.select(F.col("d").alias(doc), F.col("i").alias(item), F.col("m.words").alias("words"), (-F.col("m.d0")).alias("doc_word"), (-F.col("m.i0")).alias("item_word"))


def without_leaks(docs: DataFrame, found: DataFrame, doc: str) -> DataFrame:
    """The documents in which nothing was found."""
    return docs.join(found.select(doc).distinct(), doc, "left_anti")
