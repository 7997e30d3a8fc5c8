"""The language of every text and of every passage in another language, with a confidence (problem 4).

Evidence is fused by Bayes' rule: the likelihood of the text's words and letters, the declared label, the suffixes of
web addresses in the text, and a prior of the host that the text comes from. Host priors are smoothed hierarchically:
part of a host towards the host, the host towards the whole collection, each from one grouped aggregation of soft
counts over all rows; a row's own count is taken out of them. Hosts are looked up by ``operators.joins.lookup``, so a host that holds a third of
all rows doesn't send them to one task.

The likelihood model is trained here: word counts by language from a bounded hash sample of labelled rows
(``SAMPLE_ROWS``), started with Spark's stop-word lists, and estimated a second time from the sentences as the first
model sorts them, which removes wrong labels and mixed texts. Words outside the vocabulary are judged by their letter
trigrams, with little weight; Chinese characters speak for Chinese. Texts are restored from wrong encodings and
brought into their visual form first.

A text has several languages when at least one full sentence of each is certain. Where no punctuation divides the
text, pieces of ``LONGEST`` words are judged, and again those that begin half a piece later, so that no sentence falls between two. ``segments``
gives each stretch of one language with its place in the text and its confidence. Everything but the training sample
covers all rows.

Defined cases: null texts and texts without letters get no language; a text whose words say nothing gets the language
of label and host with a low confidence; null hosts form a host; repeated rows are each reported; extra columns are
ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.llm.encoding import repair
from topicloom.llm.visual import Form, unicode_patterns
from topicloom.operators.joins import lookup
from topicloom.session import ship, written

LANGUAGES = ("en", "es", "zh", "fr", "de", "pt")
#: Labelled rows in the training sample, about; a hash of the ids chooses them.
SAMPLE_ROWS = 20_000
#: How sure a label is: the chance that the right one is written.
LABEL_RIGHT = 0.85
#: Soft rows that a host's parent counts for.
SMOOTHING = 20.0
#: A sentence is certain from this many telling words or Chinese characters and this lead in nats on.
TELLING, HAN, LEAD = 4, 7, 12.0
#: Words in a piece where no punctuation divides the text.
LONGEST = 24
_STOP_LISTS = {"en": "english", "es": "spanish", "fr": "french", "de": "german", "pt": "portuguese"}

# Spellings of the labels, by language; regions and case aside.
LABELS = {
    "en": "en eng english inglés ingles anglais englisch inglês",
    "es": "es spa spanish español espanol castellano espagnol spanisch espanhol",
    "zh": "zh zho chi chinese cmn mandarin 中文 汉语 chino chinois chinesisch chinês",
    "fr": "fr fra fre french français francais francés französisch francês",
    "de": "de deu ger german deutsch alemán aleman allemand alemão",
    "pt": "pt por portuguese português portugues portugués portugais portugiesisch",
}
# Country and language suffixes of web addresses.
SUFFIXES = {"en": "uk us au nz ie", "es": "es mx ar cl co pe uy", "zh": "cn tw hk", "fr": "fr", "de": "de at", "pt": "pt br"}
_LABEL_OF = {spelling: code for code, all_ in LABELS.items() for spelling in all_.split()}
_SUFFIX_OF = {s: LANGUAGES.index(code) for code, all_ in SUFFIXES.items() for s in all_.split()}
_ADDRESS = re.compile(r"https?://[^\s/?#]*\.([a-z]{2})(?=[/?#:\s]|$)", re.I)
_TOKEN = re.compile(r"[㐀-鿿]+|[^\W\d_㐀-鿿]+|[.!?。！？\n]")
_MARKS = set(".!?。！？\n")
_LETTER = re.compile(r"[^\W\d_]")
_URL = re.compile(r"(?:https?://|www\.)[!-~]+|[!-~]*@[!-~]+", re.I)


_REGION = re.compile(r"[-_(].*$", re.S)


@lru_cache(maxsize=100_000)
def label_of(label: str | None) -> str | None:
    """The language a label names in any spelling, or None."""
    return _LABEL_OF.get(_REGION.sub("", label.strip()).strip().lower()) if label else None


def label_code(label: Column) -> Column:
    """``label_of`` as a column expression."""
    base = F.lower(F.trim(F.regexp_replace(F.trim(label), r"[-_(].*$", "")))
    return F.coalesce(*(F.when(base.isin(*spellings.split()), code) for code, spellings in LABELS.items()))


class Prepared:
    """From raw text to tokens. ``patterns`` are those of ``unicode_patterns``."""

    def __init__(self, patterns: dict[str, str]) -> None:
        self.form = Form(patterns)
        # punctuation in another form divides sentences as well as before, so only letters call for the visual form
        self.odd = {p for p in patterns if len(p) == 1 and unicodedata.category(p)[0] not in "PSZ"}

    def __call__(self, text: str) -> list[str]:
        if not text.isascii():
            text = repair(text)
            if not self.odd.isdisjoint(text):
                text = self.form(text)
        if "://" in text or "@" in text or "www." in text:
            text = _URL.sub(" ", text)
        return _TOKEN.findall(text.casefold())


# --- the model -----------------------------------------------------------------------------------------------------


class Model:
    """Log-likelihoods of words in each language, centred over the languages."""

    def __init__(self, counts: dict[str, dict[str, float]]) -> None:
        """``counts``: language -> word -> count, Chinese aside."""
        self.latin = [i for i, code in enumerate(LANGUAGES) if code != "zh"]
        vocabulary = Counter()
        for of in counts.values():
            vocabulary.update(of)
        words = [w for w, _ in sorted(vocabulary.items(), key=lambda x: (-x[1], x[0]))]
        table = np.full((len(words), len(LANGUAGES)), 0.0)
        for i in self.latin:
            of = counts.get(LANGUAGES[i], {})
            total = sum(of.values()) + 0.3 * len(words) + 1
            table[:, i] = np.log([(of.get(w, 0.0) + 0.3) / total for w in words]) if words else 0
        table[:, LANGUAGES.index("zh")] = table[:, self.latin].min(1) - 1 if words else 0
        table -= table.mean(1, keepdims=True)
        self.trigrams = self._trigrams(counts)
        self.index = {w: i for i, w in enumerate(words)}
        self.table = np.zeros((max(1024, 2 * len(words)), len(LANGUAGES)), np.float32)
        self.table[: len(words)] = table
        self.size = self.own = len(words)
        self.mark = -1

    def _trigrams(self, counts: dict[str, dict[str, float]]) -> dict[str, np.ndarray]:
        of: dict[str, np.ndarray] = defaultdict(lambda: np.full(len(LANGUAGES), 0.5))
        for i in self.latin:
            for word, n in counts.get(LANGUAGES[i], {}).items():
                padded = f" {word} "
                for k in range(len(padded) - 2):
                    of[padded[k : k + 3]][i] += min(n, 5.0)
        total = sum(of.values()) if of else np.ones(len(LANGUAGES))
        out = {}
        for tri, v in of.items():
            p = np.log(v / total)
            p[LANGUAGES.index("zh")] = p.min()
            out[tri] = p - p.mean()
        return out

    def _row(self, word: str) -> np.ndarray:
        zh = LANGUAGES.index("zh")
        v = np.zeros(len(LANGUAGES))
        if "㐀" <= word[0] <= "鿿":
            v[zh] = 2.0 * len(word)
            return v - v.mean()
        padded = f" {word} "
        got = [self.trigrams[t] for k in range(len(padded) - 2) if (t := padded[k : k + 3]) in self.trigrams]
        if got:
            v = np.clip(np.mean(got, 0), -0.7, 0.7)
        return v

    def rows(self, words: list[str]) -> np.ndarray:
        """The table's row of each word; unknown words get one, up to a bound, beyond which theirs are dropped again."""
        if self.size > 400_000:
            self.index = {w: i for w, i in self.index.items() if i < self.own}
            self.size = self.own
        index = self.index
        out = list(map(index.get, words))
        for k, got in enumerate(out):
            if got is None:
                word = words[k]
                got = index.get(word)
                if got is None:
                    if self.size == len(self.table):
                        self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                    self.table[self.size] = self._row(word)
                    got = index[word] = self.size
                    self.size += 1
                out[k] = got
        return np.array(out, np.int64)


def pieces(tokens: list[str]) -> Iterator[list[str]]:
    """Sentences; where one is longer than ``LONGEST`` words, parts of it."""
    part: list[str] = []
    for t in tokens:
        if t in _MARKS:
            if part:
                yield part
                part = []
        else:
            part.append(t)
            if len(part) >= LONGEST:
                yield part
                part = []
    if part:
        yield part


def between(parts: list[list[str]], whole: list[str]) -> list[list[str]]:
    """The pieces of a text that begin half a piece later, where a sentence was cut into several; ``whole`` are its tokens."""
    if not any(len(p) == LONGEST for p in parts):
        return []
    out, at = [], 0
    for k, part in enumerate(parts):
        while whole[at] in _MARKS:
            at += 1
        at += len(part)
        if len(part) == LONGEST and k + 1 < len(parts) and at < len(whole) and whole[at] not in _MARKS:
            out.append(part[LONGEST // 2 :] + parts[k + 1][: LONGEST // 2])
    return out


def scores(model: Model, parts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log-likelihoods, telling words, Chinese characters) of each part."""
    flat = [w for p in parts for w in p]
    starts = np.cumsum([0, *map(len, parts[:-1])])
    rows = model.rows(flat)
    each = model.table[rows]
    two = np.partition(each, -2, axis=1)[:, -2:]
    telling = ((two[:, 1] - two[:, 0] > 0.9) & (rows < model.own)).astype(np.int64)
    han = np.fromiter((len(w) if "㐀" <= w[0] <= "鿿" else 0 for w in flat), np.int64, len(flat))
    return np.add.reduceat(each, starts), np.add.reduceat(telling, starts), np.add.reduceat(han, starts)


def certain(s: np.ndarray, telling: np.ndarray, han: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(best language, whether it is certain) of each part."""
    best = s.argmax(1)
    two = np.partition(s, -2, axis=1)[:, -2:]
    zh = LANGUAGES.index("zh")
    return best, (two[:, 1] - two[:, 0] >= LEAD) & np.where(best == zh, han >= HAN, telling >= TELLING)


# --- training ------------------------------------------------------------------------------------------------------


def seeds() -> dict[str, dict[str, float]]:
    """Stop words of each language, each counted three times."""
    out = {}
    for code, name in _STOP_LISTS.items():
        words = {w for line in StopWordsRemover.loadDefaultStopWords(name) for w in _TOKEN.findall(line.casefold())}
        out[code] = dict.fromkeys(words, 3.0)
    return out


def _prepared(labelled: DataFrame) -> DataFrame:
    """(code, pieces): the labelled texts as sentences of words joined by blanks."""
    ship(labelled.sparkSession)
    patterns = unicode_patterns()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prepare = Prepared(patterns)
        for batch in batches:
            parts = [[" ".join(p) for p in pieces(prepare(t))] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(parts, pa.list_(pa.string()))], ["code", "pieces"])

    return labelled.select("code", "text").where("code <> 'zh'").mapInArrow(run, "code string, pieces array<string>")


def _word_counts(sample: DataFrame, model: Model | None) -> dict[str, dict[str, float]]:
    """language -> word -> count over the prepared sample, by label or, with a model, by the language of each sentence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            codes, parts = [], []
            for code, of in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts += [p.split(" ") for p in of]
                codes += [code] * len(of)
            if model is not None and parts:
                best, sure = certain(*scores(model, parts))
                codes = [LANGUAGES[k] if ok else "zh" for k, ok in zip(best, sure, strict=True)]
            for code, p in zip(codes, parts, strict=True):
                if code != "zh":
                    found.update((code, w) for w in p if w[0] < "㐀")
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(found.values(), pa.int64())], ["code", "word", "n"])

    totals = sample.mapInArrow(run, "code string, word string, n bigint").groupBy("code", "word").agg(F.sum("n").alias("n")).where("n > 1")
    out: dict[str, dict[str, float]] = defaultdict(dict)
    # the words of a bounded sample; a word met once tells as much by its letters
    for r in totals.collect():
        out[r.code][r.word] = float(r.n)
    return out


def train(texts: DataFrame) -> Model:
    """The model from the labelled rows of (tab, rec_id, text, label)."""
    labelled = texts.withColumn("code", label_code(F.col("label"))).where(F.col("code").isNotNull() & F.col("text").isNotNull())
    share = min(1.0, SAMPLE_ROWS / max(1, texts.count()))
    if share < 1:
        labelled = labelled.where(F.pmod(F.xxhash64("tab", "rec_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    sample = written(_prepared(labelled), "labelled")
    base = seeds()

    def mixed(counts: dict[str, dict[str, float]]) -> dict[str, dict[str, float]]:
        return {code: dict(Counter(base.get(code, {})) + Counter(counts.get(code, {}))) for code in _STOP_LISTS}

    first = Model(mixed(_word_counts(sample, None)))
    return Model(mixed(_word_counts(sample, first)))


# --- classification ------------------------------------------------------------------------------------------------


def text_evidence(texts: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` (with ``label``), code (the language of the label), l0 ... (the likelihood of each language), s0 ... (its share
    by the text alone), certain (the languages with a certain sentence), said (telling words and Chinese characters) and
    parts (language of each certain sentence in order) of the texts with letters."""
    ship(texts.sparkSession)
    source = texts.select(*keep, F.col("text").cast("string").alias("__text")).where(F.col("__text").isNotNull())
    kinds = ", ".join(f"{k} {source.schema[k].dataType.simpleString()}" for k in keep)
    patterns = unicode_patterns()
    numbers = [f"{c}{i}" for c in "ls" for i in range(len(LANGUAGES))]
    held = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prepare = Prepared(patterns)
        model = held.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                parts, owner, where, suffixes = [], [], [], []
                half, half_owner = [], []
                for i, text in enumerate(batch.column("__text").to_pylist()):
                    if not _LETTER.search(text):
                        continue
                    tokens = prepare(text)
                    got = list(pieces(tokens))
                    more = between(got, tokens)
                    half += more
                    half_owner += [len(where)] * len(more)
                    owner += [len(where)] * len(got)
                    parts += got
                    where.append(i)
                    suffixes.append([_SUFFIX_OF[x.lower()] for x in _ADDRESS.findall(text) if x.lower() in _SUFFIX_OF] if "://" in text else [])
                total = np.zeros((len(where), len(LANGUAGES)))
                said = np.zeros(len(where), np.int64)
                lists: list[list[str]] = [[] for _ in where]
                also: list[set[str]] = [set() for _ in where]
                if parts:
                    s, telling, han = scores(model, parts)
                    best, sure = certain(s, telling, han)
                    owners = np.array(owner)
                    np.add.at(total, owners, s)
                    np.add.at(said, owners, telling + han)
                    for k in np.flatnonzero(sure):
                        lists[owner[k]].append(LANGUAGES[best[k]])
                if half:
                    best, sure = certain(*scores(model, half))
                    for k in np.flatnonzero(sure):
                        also[half_owner[k]].add(LANGUAGES[best[k]])
                for k, of in enumerate(suffixes):
                    for lang in of:
                        total[k, lang] += 1.5
                soft = np.exp(total - total.max(1, keepdims=True)) if len(where) else total
                soft = soft / soft.sum(1, keepdims=True) if len(where) else soft
                kept = batch.take(pa.array(where, pa.int64()))
                codes = pa.array(list(map(label_of, kept.column("label").to_pylist())), pa.string())
                columns = [pa.array(np.ascontiguousarray(m[:, i])) for m in (total, soft) for i in range(len(LANGUAGES))]
                yield pa.RecordBatch.from_arrays(
                    [*(kept.column(k) for k in keep), codes, *columns, pa.array([sorted(also[k].union(x)) for k, x in enumerate(lists)], pa.list_(pa.string())), pa.array(said), pa.array(lists, pa.list_(pa.string()))],
                    [*keep, "code", *numbers, "certain", "said", "parts"],
                )

    return source.mapInArrow(run, f"{kinds}, code string, {', '.join(f'{n} double' for n in numbers)}, certain array<string>, said bigint, parts array<string>")


def _host_keys(hosts: list[str]) -> list[Column]:
    """The hosts as keys that are never null."""
    return [c for i, h in enumerate(hosts) for c in (F.coalesce(F.col(h).cast("string"), F.lit("")).alias(f"__h{i}"), F.col(h).isNull().alias(f"__n{i}"))]


def host_counts(rows: DataFrame, hosts: list[str]) -> tuple[DataFrame, list[float]]:
    """(tab, host keys, n, n0 ..., h, h0 ...): for each part of a host the rows, the soft counts of each language in it and those
    of the whole host; and the shares of the languages everywhere."""
    n = len(LANGUAGES)
    keys = ["tab", *(f"__{c}{i}" for i in range(len(hosts)) for c in "hn")]
    fine = rows.select("tab", *_host_keys(hosts), *(f"s{i}" for i in range(n))).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *(F.sum(f"s{i}").alias(f"n{i}") for i in range(n)))
    fine = written(fine, "hosts")
    upper = ["tab", "__h0", "__n0"]
    coarse = fine.groupBy(*upper).agg(F.count(F.lit(1)).alias("parts"), F.sum("n").alias("h"), *(F.sum(f"n{i}").alias(f"h{i}") for i in range(n)))
    total = fine.agg(*(F.sum(f"n{i}").alias(f"n{i}") for i in range(n))).first()
    whole = [(total[i] or 0.0) + 1.0 for i in range(n)]
    return written(lookup(fine, written(coarse, "hosts"), upper, "parts").drop("parts"), "hosts"), [x / sum(whole) for x in whole]


def with_priors(rows: DataFrame, hosts: list[str]) -> DataFrame:
    """``rows`` with p0 ...: the smoothed share of each language at the row's host, the row itself left out."""
    n = len(LANGUAGES)
    counts, everywhere = host_counts(rows, hosts)
    keys = ["tab", *(f"__{c}{i}" for i in range(len(hosts)) for c in "hn")]
    joined = lookup(rows.select("*", *_host_keys(hosts)), counts, keys, "n", "left")

    # the soft counts of a row add up to 1, those of its host to the host's rows
    def smoothed(rows_: str, count: str, i: int, parent: Column) -> Column:
        return (F.greatest(F.lit(0.0), F.col(f"{count}{i}") - F.col(f"s{i}")) + SMOOTHING * parent) / (F.col(rows_) - 1 + SMOOTHING)

    priors = [smoothed("n", "n", i, smoothed("h", "h", i, F.lit(everywhere[i]))).alias(f"p{i}") for i in range(n)]
    return joined.select(*rows.columns, *priors)


def languages(texts: DataFrame, hosts: list[str], model: Model | None = None) -> DataFrame:
    """(tab, rec_id, label, code, language, confidence, languages, parts, said) of the texts (tab, rec_id, text, label, *hosts).

    ``languages`` holds every language with a certain sentence, or the one language of the text; ``language`` and
    ``confidence`` are of the posterior over the whole text.
    """
    model = train(texts) if model is None else model
    keep = ["tab", "rec_id", "label", *hosts]
    rows = with_priors(written(text_evidence(texts, model, keep), "evidence"), hosts)
    n = len(LANGUAGES)
    named, other = float(np.log(LABEL_RIGHT)), float(np.log((1 - LABEL_RIGHT) / (n - 1)))
    declared = [F.when(F.col("code").isNull(), 0.0).when(F.col("code") == code, named).otherwise(other) for code in LANGUAGES]
    rows = posterior(rows.select("*", *((0.5 * (F.col(f"l{i}") + F.log(f"p{i}") + declared[i])).alias(f"o{i}") for i in range(n))))
    several = F.when(F.size("certain") > 1, F.col("certain")).otherwise(F.array(F.col("language")))
    return rows.select("tab", "rec_id", "label", "code", "language", "confidence", several.alias("languages"), "parts", "said")


def posterior(rows: DataFrame) -> DataFrame:
    """``rows`` with language and confidence from the log-odds o0 ..."""
    n = len(LANGUAGES)
    rows = rows.withColumn("top", F.greatest(*(f"o{i}" for i in range(n))))
    rows = rows.withColumn("confidence", F.round(1.0 / sum((F.exp(F.col(f"o{i}") - F.col("top")) for i in range(n)), F.lit(0.0)), 6))
    return rows.withColumn("language", F.coalesce(*(F.when(F.col(f"o{i}") == F.col("top"), code) for i, code in enumerate(LANGUAGES))))


# --- segments ------------------------------------------------------------------------------------------------------

_SENTENCE = re.compile(r"[^.!?。！？\n]*[.!?。！？\n]*")
_WORDS = re.compile(r"[一-鿿]{1,%d}|\S+" % LONGEST)
#: What a change of language costs, in nats.
CHANGE = 8.0


def stretches(text: str) -> list[tuple[int, int]]:
    """The places of the sentences of a text, and of parts of ``LONGEST`` words where one is longer."""
    out = []
    for m in _SENTENCE.finditer(text):
        words = [w.span() for w in _WORDS.finditer(text, m.start(), m.end())]
        for k in range(0, len(words), LONGEST):
            out.append((words[k][0], words[min(k + LONGEST, len(words)) - 1][1]))
    return out


def best_path(s: np.ndarray) -> np.ndarray:
    """The most likely language of each sentence where a change between neighbours costs ``CHANGE``."""
    total, back = s[0].copy(), []
    for row in s[1:]:
        stay, change = total, total.max() - CHANGE
        back.append(np.where(stay >= change, np.arange(len(row)), total.argmax()))
        total = np.maximum(stay, change) + row
    path = [int(total.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return np.array(path[::-1])


def segments(texts: DataFrame, hosts: list[str], model: Model | None = None) -> DataFrame:
    """(tab, rec_id, segment, start, stop, language, confidence): the stretches of one language of each text with letters, in order,
    with their places in the text (characters from 0, the end exclusive) and a confidence from words and host.

    A language other than that of its neighbours needs a certain sentence, so foreign words, names and short phrases make no segment.
    """
    ship(texts.sparkSession)
    model = train(texts) if model is None else model
    keep = ["tab", "rec_id", "label", *hosts]
    held = texts.sparkSession.sparkContext.broadcast(model)
    patterns = unicode_patterns()
    n = len(LANGUAGES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prepare = Prepared(patterns)
        model = held.value
        for batch in batches:
            where, columns = [], [[] for _ in range(3 + n)]
            for i, text in enumerate(batch.column("__text").to_pylist()):
                if not _LETTER.search(text):
                    continue
                places = stretches(text)
                parts = [[t for t in prepare(text[a:b]) if t not in _MARKS] for a, b in places]
                places = [p for p, words in zip(places, parts, strict=True) if words]
                parts = [words for words in parts if words]
                if not parts:
                    places, s, path = [(0, len(text))], np.zeros((1, n)), np.zeros(1, int)
                else:
                    s, telling, han = scores(model, parts)
                    best, sure = certain(s, telling, han)
                    path = best_path(np.where(sure[:, None], s, 0.3 * s))
                    # a run without a certain sentence of its language belongs to its neighbour
                    for k in range(len(path)):
                        if not any(sure[j] and best[j] == path[k] for j in _run_of(path, k)):
                            path[k] = path[k - 1] if k else path[k]
                cuts = [0, *(np.flatnonzero(np.diff(path)) + 1), len(path)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    where.append(i)
                    for column, value in zip(columns, [k, places[a][0], places[b - 1][1], *s[a:b].sum(0)], strict=True):
                        column.append(value)
            kept = batch.take(pa.array(where, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*(kept.column(k) for k in keep), *(pa.array(c, pa.int32()) for c in columns[:3]), *(pa.array(c, pa.float64()) for c in columns[3:])],
                [*keep, "segment", "start", "stop", *(f"l{i}" for i in range(n))],
            )

    source = texts.select(*keep, F.col("text").cast("string").alias("__text")).where(F.col("__text").isNotNull())
    kinds = ", ".join(f"{k} {source.schema[k].dataType.simpleString()}" for k in keep)
    rows = written(source.mapInArrow(run, f"{kinds}, segment int, start int, stop int, {', '.join(f'l{i} double' for i in range(n))}"), "segments")
    # the soft counts of a segment, as those of a text
    top = F.greatest(*(f"l{i}" for i in range(n)))
    weight = sum((F.exp(F.col(f"l{i}") - top) for i in range(n)), F.lit(0.0))
    rows = with_priors(rows.select("*", *((F.exp(F.col(f"l{i}") - top) / weight).alias(f"s{i}") for i in range(n))), hosts)
    rows = posterior(rows.select("*", *((0.5 * (F.col(f"l{i}") + F.log(f"p{i}"))).alias(f"o{i}") for i in range(n))))
    return rows.select("tab", "rec_id", "segment", "start", "stop", "language", "confidence")


def _run_of(path: np.ndarray, k: int) -> range:
    """The neighbours of a place with the same value, itself included."""
    a, b = k, k + 1
    while a and path[a - 1] == path[k]:
        a -= 1
    while b < len(path) and path[b] == path[k]:
        b += 1
    return range(a, b)


def wrong_labels(found: DataFrame, least_said: int = 2) -> DataFrame:
    """(tab, rec_id, language): texts of one language whose label is missing, or names another by ``least_said`` telling words or
    Chinese characters at least, once; texts with sentences in several languages, once for each."""
    missing = F.col("code").isNull()
    wrong = (F.col("code") != F.col("language")) & (F.col("said") >= least_said)
    case = (F.size("languages") > 1) | missing | F.coalesce(wrong, F.lit(False))
    # no filter before the explode: it would be pushed down and repeat the whole posterior in one function
    return found.select("tab", "rec_id", F.explode_outer(F.when(case, F.col("languages"))).alias("language")).where("language is not null")
