"""Packing texts into containers of a fixed number of tokens, with a controlled mixture (problem 7).

Texts are measured in tokens of a public tokenizer. A text longer than the capacity is cut into full pieces and a
rest; no other text is ever split. The sources of the texts are queues, and a deficit round-robin fills each container:
every source earns its target share of each container's capacity, the source that is owed most goes first and gives
its largest text that still fits, and what a source is owed is carried into the next container. When no queue
has a text that fits, the container is closed.

Shards are packed apart, each holding an even hash sample of every source, however frequent the source is. Containers
that a shard leaves emptier than ``FULL`` are opened again, and their texts are packed with those of the other shards,
starting from the sum of the deficits that the shards ended with: so deficits pass from partition to partition too.

Target shares are given or, without that, the sources' shares of all tokens. Defined cases: null and empty texts have no tokens and are
left out; a null source is a source; the same id twice is two texts, told apart by the piece's ``copy``; empty
tables give no containers; a capacity below 1 is refused.
"""

from __future__ import annotations

import base64
import heapq
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.operators.joins import lookup
from topicloom.session import ship, written

TOKENIZERS = "/opt/tokenizers"
#: White space that is counted apart.
LONG_BLANKS = re.compile("[\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")
#: A container filled less than this is opened again by the second level.
FULL = 0.97
#: Tokens in a shard, about.
SHARD_TOKENS = 3_000_000
#: Shards of the second level take at most this many texts.
REST_TEXTS = 50_000


def token_counter(folder: str = TOKENIZERS, name: str = "byte_bpe_multi_50k.tiktoken"):
    """A function from a text to its number of tokens, made from a vocabulary file of ranks."""
    import importlib.util
    from pathlib import Path

    import tiktoken

    spec = importlib.util.spec_from_file_location("tokenizer_files", Path(folder) / "__init__.py")
    files = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(files)
    with open(Path(folder) / name, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding(name, pat_str=files.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def count(text: str) -> int:
        # the tokenizer's pattern fails on very long runs of white space: such a run, but for its last character before
        # other text, is one piece of the pattern, so the text can be cut there without changing its tokens
        total, at = 0, 0
        for run in LONG_BLANKS.finditer(text):
            end = run.end() - (run.end() < len(text))
            total += len(encoding.encode_ordinary(text[at : run.start()])) + len(encoding._encode_single_piece(text[run.start() : end]))
            at = end
        return total + len(encoding.encode_ordinary(text[at:]))

    return count


def measured(df: DataFrame, key: str, text: str, source: str | None, folder: str = TOKENIZERS) -> DataFrame:
    """(id, copy, source, tokens) of the texts that have tokens."""
    ship(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = token_counter(folder)
        for f in frames:
            f["tokens"] = [count(t) for t in f.pop("t")]
            yield f[f.tokens > 0]

    rows = df.select(F.col(key).alias("id"), (F.col(source).cast("string") if source else F.lit(None).cast("string")).alias("source"), F.col(text).cast("string").alias("t")).where(F.length("t") > 0)
    return rows.mapInPandas(run, f"id {kind}, source string, tokens bigint")


class Queues:
    """The texts of each source by size, and what each source is owed."""

    def __init__(self, texts: list[tuple], shares: dict, owed: dict | None = None) -> None:
        self.sizes: dict = defaultdict(list)
        for n, text in enumerate(texts):
            self.sizes[text[1]].append((text[0], n))
        for queue in self.sizes.values():
            queue.sort()
        self.texts, self.left = texts, len(texts)
        self.share = {s: shares.get(s) or 0.0 for s in self.sizes}
        self.owed = {s: (owed or {}).get(s, 0.0) for s in self.sizes}
        self.carried = {s: v for s, v in (owed or {}).items() if s not in self.sizes}

    def fill(self, capacity: int) -> Iterator[list[tuple]]:
        """The containers. Sources wait in a heap by what they are owed; one without a fitting text is out of it until the next
        container, since the room only shrinks."""
        open_ = list(self.sizes)
        while self.left:
            total = sum(self.share[s] for s in open_)
            for s in open_:
                # where no source left has a share, all have the same
                self.owed[s] += capacity * (self.share[s] / total if total else 1.0 / len(open_))
            room, container, emptied = capacity, [], False
            heap = [(-self.owed[s], k) for k, s in enumerate(open_)]
            heapq.heapify(heap)
            while room and heap:
                _, k = heap[0]
                source = open_[k]
                queue = self.sizes[source]
                at = bisect_right(queue, (room, 1 << 60)) - 1
                if at < 0:
                    heapq.heappop(heap)
                    emptied = emptied or not queue
                    continue
                size, n = queue.pop(at)
                self.owed[source] -= size
                self.left -= 1
                room -= size
                container.append(self.texts[n])
                emptied = emptied or not queue
                heapq.heapreplace(heap, (-self.owed[source], k))
            if emptied:
                open_ = [s for s in open_ if self.sizes[s]]
            yield container


PIECES = "limit_id int, capacity int, level int, shard int, container int, place int, id {0}, source string, piece int, first_token bigint, tokens bigint"


def _packer(level: int, full: float):
    """A function of one shard's texts: containers that are full enough, and the texts of the others with container -1.

    Deficits at the end of a first-level shard come out as rows with piece -1.
    """

    def pack(f: pd.DataFrame) -> pd.DataFrame:
        capacity, limit, shard = int(f.capacity.iloc[0]), int(f.limit_id.iloc[0]), int(f.shard.iloc[0])
        owed_rows = f[f.piece == -1]
        f = f[f.piece >= 0].sort_values(["id", "piece", "tokens"], kind="stable")
        shares = {(None if s is None or s != s else s): v for s, v in zip(f.source, f.share, strict=True)}
        owed = {(None if pd.isna(s) else s): v for s, v in owed_rows.groupby("source", dropna=False).tokens.sum().items()}
        texts = [(int(t), None if s is None or s != s else s, i, int(p), int(a)) for t, s, i, p, a in zip(f.tokens, f.source, f.id, f.piece, f.first_token, strict=True)]
        queues, out, number = Queues(texts, shares, owed), [], 0
        for container in queues.fill(capacity):
            filled = sum(t[0] for t in container)
            closed = level > 1 or filled >= full * capacity
            for place, (size, source, i, piece, first) in enumerate(container):
                out.append((limit, capacity, level, shard, number if closed else -1, place, i, source, piece, first, size))
                if not closed:
                    queues.owed[source] += size
            number += closed
        if level == 1:
            out += [(limit, capacity, level, shard, -1, 0, None, s, -1, 0, round(v)) for s, v in {**queues.owed, **queues.carried}.items() if round(v)]
        g = pd.DataFrame(out, columns=["limit_id", "capacity", "level", "shard", "container", "place", "id", "source", "piece", "first_token", "tokens"])
        g["id"] = g["id"].astype("Int64") if f.id.dtype.kind in "iu" or not len(f) else g["id"]
        return g

    return pack


def pack(df: DataFrame, limits: DataFrame, key: str = "doc_id", text: str = "text", source: str | None = "source", shares: dict | None = None, folder: str = TOKENIZERS) -> DataFrame:
    """(limit_id, capacity, level, shard, container, place, <key>, source, piece, first_token, tokens): the place of each
    text or piece for each capacity. ``level, shard, container`` name a container."""
    capacities = [(r.limit_id, r.capacity) for r in limits.select("limit_id", "capacity").where("capacity is not null").limit(1001).collect()]
    if len(capacities) > 1000 or any(c < 1 for _, c in capacities):
        raise ValueError("capacities: at most 1000, each at least 1")
    kind = df.schema[key].dataType.simpleString()
    if kind not in ("bigint", "int", "string"):
        raise ValueError("the key must be an integer or a string")
    sized = written(measured(df, key, text, source, folder), "sizes")
    total = sized.agg(F.sum("tokens")).first()[0] or 0
    natural = _natural_shares(sized, total) if shares is None else None
    sized = _with_shares(sized, shares, natural)
    shards = max(1, -(-total // SHARD_TOKENS))
    # full pieces of over-long texts and one rest; texts that fit are one piece
    pieces = _with_limits(sized, capacities)
    pieces = pieces.withColumn("piece", F.explode(F.sequence(F.lit(0), ((F.col("tokens") - 1) / F.col("capacity")).cast("int"))))
    pieces = pieces.withColumn("first_token", F.col("piece").cast("bigint") * F.col("capacity")).withColumn("tokens", F.least(F.col("tokens") - F.col("first_token"), F.col("capacity").cast("bigint")))
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("id", "piece"), F.lit(shards)).cast("int"))
    schema = PIECES.format(kind)
    pack_columns = ["limit_id", "capacity", "shard", "id", "source", "share", "piece", "first_token", "tokens"]
    first = written(pieces.select(*pack_columns).groupBy("limit_id", "shard").applyInPandas(_packer(1, FULL), schema), "packed")
    rest = first.where("container = -1")
    per = rest.groupBy("limit_id").agg(F.count(F.lit(1)).alias("n"))
    groups = max([1, *(-(-r.n // REST_TEXTS) for r in per.collect())])
    rest = _with_shares(rest, shares, natural).withColumn("shard", F.pmod(F.xxhash64("id", "piece", F.when(F.col("piece") < 0, F.col("shard"))), F.lit(groups)).cast("int")).select(*pack_columns)
    second = rest.groupBy("limit_id", "shard").applyInPandas(_packer(2, FULL), schema)
    return first.where("container >= 0").unionAll(second).withColumnRenamed("id", key)


def _source_key() -> list[Column]:
    return [F.col("source").isNull().alias("__null"), F.coalesce("source", F.lit("")).alias("__name")]


def _natural_shares(sized: DataFrame, total: int) -> DataFrame:
    """The part of all tokens that each source has."""
    sums = sized.select(*_source_key(), "tokens").groupBy("__null", "__name").agg((F.sum("tokens") / F.lit(float(max(1, total)))).alias("share"), F.count(F.lit(1)).alias("__n"))
    return written(sums, "shares")


def _with_shares(rows: DataFrame, shares: dict | None, natural: DataFrame | None) -> DataFrame:
    """``rows`` with the target share of their source: a given one, 0 where none is given, or the natural one.

    However many sources there are, each brings its own share into the shards where it has texts.
    """
    if natural is not None:
        return lookup(rows.select("*", *_source_key()), natural, ["__null", "__name"], "__n", "left").drop("__null", "__name", "__n")
    share = F.lit(0.0)
    for source, v in shares.items():
        share = F.when(F.col("source").eqNullSafe(F.lit(source)), float(v)).otherwise(share)
    return rows.withColumn("share", share)


def _with_limits(sized: DataFrame, capacities: list[tuple[int, int]]) -> DataFrame:
    """Each text once for each capacity, by exploding a short literal array."""
    options = F.array(*(F.struct(F.lit(i).cast("int").alias("limit_id"), F.lit(c).cast("int").alias("capacity")) for i, c in capacities))
    return sized.withColumn("o", F.explode(options)).select("*", "o.limit_id", "o.capacity").drop("o") if capacities else sized.select("*", F.lit(0).alias("limit_id"), F.lit(1).alias("capacity")).where("false")


def summary(packed: DataFrame) -> DataFrame:
    """(limit_id, capacity, containers, tokens, fill): how full the containers of each capacity are."""
    one = packed.groupBy("limit_id", "capacity", "level", "shard", "container").agg(F.sum("tokens").alias("tokens"))
    return one.groupBy("limit_id", "capacity").agg(F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"), F.round(F.avg(F.col("tokens") / F.col("capacity")), 6).alias("fill"))


def mixture(packed: DataFrame, window: int = 64) -> DataFrame:
    """(limit_id, level, shard, window, source, share): the share of each source in windows of consecutive containers."""
    rows = packed.withColumn("window", F.floor(F.col("container") / window))
    w = Window.partitionBy("limit_id", "level", "shard", "window")
    return rows.groupBy("limit_id", "level", "shard", "window", "source").agg(F.sum("tokens").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(w)).drop("n")


def deviations(packed: DataFrame, shares: dict, window: int = 64) -> DataFrame:
    """(limit_id, level, shard, window, lasting, deviation): by how much the mixture of a window misses the target, as the
    largest difference of a source's share; ``lasting`` tells whether every source with a target still has texts for a later window."""
    key = ["limit_id", "level", "shard"]
    got = mixture(packed, window)
    per = got.groupBy(*key, "window").agg(F.map_from_arrays(F.collect_list(F.coalesce("source", F.lit("<null>"))), F.collect_list("share")).alias("m"))
    last = got.groupBy(*key, "source").agg(F.max("window").alias("last")).where(F.coalesce("source", F.lit("<null>")).isin(*(s if s is not None else "<null>" for s in shares)))
    lasts = last.groupBy(*key).agg(F.min("last").alias("last"), F.count(F.lit(1)).alias("present"))
    worst = F.greatest(*(F.abs(F.coalesce(F.element_at("m", s if s is not None else "<null>"), F.lit(0.0)) - F.lit(float(v))) for s, v in shares.items()), F.lit(0.0))
    rows = per.withColumn("deviation", F.round(worst, 6)).join(lasts, key, "left")
    lasting = (F.coalesce("present", F.lit(0)) == len(shares)) & (F.col("window") < F.col("last"))
    return rows.select(*key, "window", F.coalesce(lasting, F.lit(False)).alias("lasting"), "deviation")
