import pytest
from pyspark.sql import functions as F

from topicloom.functions import annotate, language, lexicon, text, tokens
from topicloom.operators import corpus


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "t string").select(make(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(("raw", "basic", "full"), [
    (None, "", ""), ("", "", ""), ("Visit HTTPS://a.b/c now www.x.y", "visit now", "visit now"), ("@naïve hi #tag", "hi", "hi tag"),
    ("Café Ａ１", "caf", "cafe a1"), ("Las  Vegas!", "las vegas", "las_vegas"), ("酒店 ok", "酒店 ok", "酒店 ok"), ("a​b\tc", "a b c", "ab c"),
])
def test_normalize(spark, raw, basic, full):
    assert one(spark, raw, text.normalize_basic) == basic
    assert one(spark, raw, text.normalize) == full


def test_tokenize(spark):
    assert one(spark, "abc123 xy hello_you 7 42", lambda c: tokens.tokenize(c, "en")) == ["abc", "hello_you", "123", "42"]
    assert one(spark, "一", lambda c: tokens.tokenize(c, "zh")) == ["一"]
    assert one(spark, "一二三", lambda c: tokens.tokenize(c, "zh")) == ["一二", "二三", "一二三", "一二三"]
    assert one(spark, "一二三四五六七", lambda c: tokens.tokenize(c, "zh"))[-2:] == ["一二三四五六", "七"]
    assert one(spark, "a" * 40, lambda c: tokens.tokenize(c, "en")) == ["a" * 35, "a" * 5]
    assert one(spark, None, lambda c: tokens.tokenize(c, "mixed")) == []
    assert one(spark, "abcd abc 12", lambda c: tokens.at_least(tokens.tokenize(c, "en"), 4)) == ["abcd", "12"]
    assert one(spark, "robot going seed planned bring", lambda c: tokens.nouns_and_adjectives(tokens.tokenize(c, "en"))) == ["robot", "seed", "bring"]
    assert one(spark, " a  b\n", tokens.split_tokens) == ["a", "b"]


def test_emoticons_keep_words(spark):
    assert one(spark, "experience check-out :) <3", lambda c: F.trim(text.without_emoticons(c))) == "experience check-out"
    assert one(spark, "experience", lambda c: text.without_emoticons(c, True)) == "e erience"
    assert one(spark, "check-out", lambda c: text.without_emoticons(c, True)) == "check ut"


def test_clean_and_accents(spark):
    assert one(spark, "El niño Está #x 12 https://a.b", lambda c: text.clean(c, "es")) == "el niño esta"
    assert one(spark, "這個 hotel 很好", lambda c: text.clean(c, "zh")) == "这个 很好"
    assert one(spark, "Ñandú á", lambda c: text.strip_accents(c, True)) == "Ñandu a"
    assert one(spark, "Ñandú", text.strip_accents) == "Nandu"
    assert one(spark, "hi 😀 ❤️ 👍", text.emoji_words) == "hi 开心 爱 点赞"
    assert "grinning face" in one(spark, "hi 😀", lambda c: text.emoji_words(c, words={}))


@pytest.mark.parametrize(("raw", "want"), [
    ("a great e xperience with t echnology", "a great experience with technology"), ("the xperience was cellent", "the experience was excellent"), ("ho tel ex ample te chnology", "hotel example technology"), ("samples of expression", "samples of expression"),
])
def test_cut_words(spark, raw, want):
    assert one(spark, raw, lambda c: text.clean(c, "en")) == want


def test_lemmas():
    assert [text.lemma_cleaner("en")(w) for w in ("Café", "xciting", "pressed", "hotel's")] == ["cafe", "exciting", "expressed", "hotels"]
    assert [text.lemma_cleaner("es")(w) for w in ("habitación", "abitacion", "Niño")] == ["habitacion", "habitacion", "niño"]
    assert text.lemma_cleaner("zh")("酒店a1") == "酒店"


@pytest.mark.parametrize(("raw", "want"), [
    ("cafÃ© â‚¬5 naÃ¯ve", "café €5 naïve"), ("cafÃƒÂ©", "café"), ("itâ€™s straÃŸe", "it’s straße"), ("ATENÇÃO “É” café", "ATENÇÃO “É” café"), (None, ""), ("plain", "plain"), ("å¥½é…’åº—", "好酒店"),
])
def test_mojibake(spark, raw, want):
    assert one(spark, raw, text.fix_mojibake) == want


def test_sql_functions(spark):
    from topicloom.functions import register

    assert "tokens" in register.register(spark)
    row = spark.sql("SELECT normalize_text('Visit @me NOW #x 酒店!') AS a, strip_accents_text('Ñandú') AS b, fix_mojibake_text('cafÃ©') AS c, snippet_text(' a \n b ') AS d, normalize_text(NULL) AS e").first()
    assert tuple(row) == ("visit now 酒店", "Nandu", "café", "a b", "")
    assert [tuple(r) for r in spark.sql("SELECT * FROM tokens('the Robot 42')").collect()] == [(0, "the"), (1, "robot"), (2, "42")]

def test_compose(spark):
    rows = [(1, "A", "a b"), (2, "A", "b"), (3, None, " c "), (4, "t", None), (5, None, None), (6, "", "  ")]
    df = spark.createDataFrame(rows, "id int, Title string, content string")
    assert [r.x for r in df.select("id", text.compose("Title", "content").alias("x")).orderBy("id").collect()] == ["a b", "A b", "c", "t", "", ""]
    assert text.analysis_text(df.select("id")).first().analysis_text == ""
    assert text.analysis_text(df.select("id"), variant="basic").orderBy("id").first().analysis_text == "1"


def test_cells(spark):
    df = spark.createDataFrame([(1.0, 2.5, float("nan"), [1], bytearray(b"x"), None)], "a double, b double, c double, d array<int>, e binary, f string")
    got = df.select(*(text.cell_text(df, c).alias(c) for c in df.columns)).first()
    assert list(got) == ["1", "2.5", "", "[1]", "x", ""]


def test_language(spark):
    def lite(*texts):
        return language.detect_lite(spark.createDataFrame(list(enumerate(texts)), "id int, t string"), "id", "t").first().language

    assert [lite("abc"), lite("酒店"), lite(""), lite("...", "!"), lite("abcde 酒")] == ["en", "zh", "mixed", "zh", "en"]
    df = spark.createDataFrame([(1, "el niño")], "id int, t string")
    assert language.detect_academic(df, "id", "t").first().language == "es"


def test_lexicon(spark, monkeypatch):
    long = spark.createDataFrame([(1, i, w) for i, w in enumerate(["hotel"] * 50 + ["hote", "otel", "zzz"])], "doc int, pos int, token string")
    words = lexicon.zipf_table(long)
    fixed = lexicon.repaired(long, words, lexicon.spelling_index(words), 8.9)
    assert {(r.token, r.repaired) for r in fixed.where("token <> repaired").collect()} == {("hote", "hotel"), ("otel", "hotel")}
    df = spark.createDataFrame([(1, ["hote", "zzz"]), (1, None)], "doc int, tokens array<string>")
    table = lexicon.corrections(words, words, lexicon.spelling_index(words), 8.9)
    want = [(1, ["hotel", "zzz"]), (1, [])]
    assert [tuple(r) for r in lexicon.mend(df, "doc", table).collect()] == want
    with monkeypatch.context() as m:
        m.setattr(lexicon, "HELD_WORDS", 0)
        assert sorted(map(tuple, lexicon.mend(df, "doc", table).collect()), reverse=True) == want
    merged = lexicon.merge_prefixes(spark.createDataFrame([(1, 0, "ho"), (1, 1, "tel"), (1, 2, "ho")], "doc int, pos int, token string"), "doc", ["ho"], words)
    assert sorted(r.token for r in merged.collect()) == ["ho", "hotel"]


def test_annotate(spark):
    df = spark.createDataFrame([(1, "beautiful hotels slowly going"), (2, None)], "id int, t string")
    rows = {r.id: [tuple(t) for t in r.tagged] for r in annotate.annotate(df, "t", lambda: annotate.rules("en")).collect()}
    assert rows == {1: [("beautiful", "ADJ", "beautiful"), ("hotels", "NOUN", "hotel"), ("slowly", "ADV", "slowly"), ("going", "VERB", "going")], 2: []}


def test_text_column(spark):
    df = spark.createDataFrame([("a", "long text")], "x string, y string")
    assert corpus.text_column(df) == "y"
    assert corpus.text_column(df.withColumnRenamed("x", "CAPTION")) == "CAPTION"
    assert corpus.unique_columns(df.toDF("a", "a")).columns == ["a"]


def test_lists():
    assert text.word_list("a, b\nc，d,,") == ["a", "b", "c", "d"]
    assert text.topic_numbers("5, 3 99 3 12") == [3, 5, 12]
    with pytest.raises(ValueError, match="two"):
        text.topic_numbers("5")
    assert text.signature({"b": 1, "a": 2}) == text.signature({"a": 2, "b": 1})


def test_a_token_that_is_a_third_of_all(spark, monkeypatch):
    from topicloom.operators import joins

    long = spark.createDataFrame([(i, 0, "hote" if i % 3 == 0 else "hotel" if i % 3 == 1 else f"room{i % 7}") for i in range(300)] + [(i, 1, "s") for i in range(300)], "doc int, pos int, token string")
    words = spark.createDataFrame([("hotel", 6.0), ("hote", 1.0)], "token string, zipf double")
    index = lexicon.spelling_index(words)

    def results():
        fixed = lexicon.repaired(long, words, index, 2.5)
        merged = lexicon.merge_prefixes(long, "doc", ["hote"], spark.createDataFrame([("hotes",)], "token string"))
        return sorted(map(str, fixed.select("doc", "pos", "token", "repaired").collect())), sorted(map(str, merged.collect()))

    want = results()
    assert sum("repaired='hotel'" in r for r in want[0]) == 200 and sum("hotes" in r for r in want[1]) == 100 and len(want[1]) == 500
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(joins, "HOT_ROWS", 50)
    assert results() == want
