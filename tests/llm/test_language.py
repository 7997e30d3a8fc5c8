import random

import pytest

from topicloom.llm import language as lang

WORDS = {
    "en": "the hotel was quiet and we walked home because nobody told us about this evening".split(),
    "es": "el hotel estaba tranquilo y nosotros volvimos porque nadie avisó sobre esta noche pero mañana".split(),
    "fr": "le jardin était calme et nous sommes partis parce que personne ne savait pourquoi cette chambre".split(),
    "de": "das zimmer war ruhig und wir gingen nach hause weil niemand etwas über diesen abend sagte".split(),
    "pt": "o quarto estava calmo e nós voltamos porque ninguém falou sobre esta noite mas amanhã não".split(),
}


def sentence(rng, code):
    if code == "zh":
        return "没有人告诉我们今天晚上酒店很安静。"
    return " ".join(rng.choice(WORDS[code]) for _ in range(12)).capitalize() + ". "


@pytest.fixture(scope="module")
def found(spark):
    rng = random.Random(8)
    rows, truth = [], {}
    for i in range(600):
        code = rng.choice(lang.LANGUAGES)
        text = "".join(sentence(rng, code) for _ in range(3))
        label = {0: None, 1: "", 2: "und", 3: rng.choice([x for x in lang.LANGUAGES if x != code]), 4: {"en": "English", "es": "es-MX", "zh": "zh-CN", "fr": "FR", "de": " de ", "pt": "por"}[code]}.get(i % 10, code)
        truth[i] = {code} if i % 10 < 4 else set()
        if i % 10 == 9:
            other = rng.choice([x for x in lang.LANGUAGES if x != code])
            text += sentence(rng, other)
            truth[i] = {code, other}
        rows.append(("t", i, text, label, "host" if i % 3 == 0 else None, str(i % 4)))
    rows += [("t", 9000, None, "en", "h", "p"), ("t", 9001, "", "en", "h", "p"), ("t", 9002, "12 - 5", None, "h", "p")]
    df = spark.createDataFrame(rows, "tab string, rec_id bigint, text string, label string, host string, part string")
    return lang.languages(df, ["host", "part"]).cache(), truth


def test_cases(found):
    got = {}
    for r in lang.wrong_labels(found[0]).collect():
        got.setdefault(r.rec_id, set()).add(r.language)
    assert got == {i: t for i, t in found[1].items() if t}


def test_everything_else(found):
    rows = {r.rec_id: r for r in found[0].collect()}
    assert set(rows) == set(range(600))
    assert all(0 < r.confidence <= 1 for r in rows.values())
    assert rows[9].parts[-1] != rows[9].parts[0] or len(set(rows[9].parts)) > 1


def test_labels(spark):
    spellings = ["EN", "en-US", "English", " spa ", "Español", "zh-CN", "deu", "nl", "und", "", "  ", None, "unknown", "pt_BR"]
    want = ["en", "en", "en", "es", "es", "zh", "de", None, None, None, None, None, None, "pt"]
    assert list(map(lang.label_of, spellings)) == want
    df = spark.createDataFrame(list(enumerate(spellings)), "i int, l string")
    from pyspark.sql import functions as F

    assert [r.c for r in df.select("i", lang.label_code(F.col("l")).alias("c")).orderBy("i").collect()] == want


def test_empty(spark):
    df = spark.createDataFrame([], "tab string, rec_id bigint, text string, label string, host string, part string")
    assert lang.wrong_labels(lang.languages(df, ["host", "part"])).count() == 0


def test_segments(spark):
    rng = random.Random(3)
    rows, truth = [], {}
    for i in range(400):
        first, second = rng.sample(lang.LANGUAGES, 2)
        a, b = (" ".join(sentence(rng, c).strip() for _ in range(2)) for c in (first, second))
        mixed = i % 3 == 0
        text = f"{a} {b}" if mixed else a
        rows.append(("t", i, text, first, "host" if i % 2 else None, str(i % 4)))
        truth[i] = [(first, 0, len(a)), (second, len(a) + 1, len(text))] if mixed else [(first, 0, len(a))]
    rows += [("t", 9000, None, "en", "h", "p"), ("t", 9001, "", "en", "h", "p"), ("t", 9002, "12 - 5", None, "h", "p"), ("t", 9003, "ok", None, None, None)]
    df = spark.createDataFrame(rows, "tab string, rec_id bigint, text string, label string, host string, part string")
    got = {}
    for r in lang.segments(df, ["host", "part"]).orderBy("rec_id", "segment").collect():
        got.setdefault(r.rec_id, []).append((r.language, r.start, r.stop))
        assert 0 < r.confidence <= 1
    assert set(got) == set(truth) | {9003}
    right = sum(got[i] == t for i, t in truth.items())
    assert right >= 0.97 * len(truth)


def test_a_sentence_between_two_pieces_is_seen():
    words = [f"w{i}" for i in range(70)]
    tokens = [*words[:50], ".", *words[50:]]
    parts = list(lang.pieces(tokens))
    assert [len(p) for p in parts] == [24, 24, 2, 20]
    assert lang.between(parts, tokens) == [words[12:36], words[36:50]]


def test_a_hot_host(spark, monkeypatch):
    from topicloom.operators import joins

    rng = random.Random(4)
    rows = [("t", i, sentence(rng, "es" if i % 3 else "fr"), None, "hot" if i % 3 == 0 else f"h{i % 30}", None) for i in range(300)]
    df = spark.createDataFrame(rows, "tab string, rec_id bigint, text string, label string, host string, part string")
    model = lang.train(df)
    want = sorted(map(str, lang.languages(df, ["host", "part"], model).collect()))
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 2)
    monkeypatch.setattr(joins, "HOT_ROWS", 50)
    assert sorted(map(str, lang.languages(df, ["host", "part"], model).collect())) == want
