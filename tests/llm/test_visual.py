import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from topicloom.llm import visual

FORM = visual.Form(visual.unicode_patterns())
LETTERS = "aeéñoc АЕаеосі Ａｅ１ ﬁ ́̃​­ -‐‑Ⅳ酒⼈ ï"


def test_same_looks():
    for a, b in [("ｈｏｔｅｌ", "hotel"), ("café", "café"), ("cafе́", "café"), ("ho​tel­", "hotel"), ("a\u00a0b\u2009c", "a b c"), ("ﬁne", "fine"), ("Отel", "Oтel"), ("co‑op", "co-op"), ("⼈", "人"), ("ї", "ï"), ("…", "...")]:
        assert FORM(a) == FORM(b), (a, b)


def test_letters_of_many_scripts():
    for a, b in [("раураӏ", "paypal"), ("Ꭺnna", "Anna"), ("ꓐank", "Bank"), ("ɑnna", "anna"), ("ⲟⲞ", "oO"), ("ꓮꮯ", "Ac"), ("ᴏᴠᴢ", "ovz"), ("ΐ", "ḯ"), ("Ѵа", "Va")]:
        assert FORM(a) == FORM(b), (a, b)


def test_real_differences():
    for a, b in [("Hotel", "hotel"), ("a b", "a  b"), ("a\tb", "a b"), ("a\nb", "a b"), ("a.", "a"), ("e", "é"), ("a–b", "a-b"), ("l", "I"), ("’", "'")]:
        assert FORM(a) != FORM(b), (a, b)


@settings(max_examples=400, deadline=None)
@given(st.text(LETTERS + "́̈", max_size=14))
def test_form_is_stable(text):
    form = FORM(text)
    assert FORM(form) == form
    for kind in ("NFC", "NFD", "NFKC", "NFKD"):
        assert FORM(unicodedata.normalize(kind, text)) == form


def test_classes_are_transitive_and_frequency_decides():
    out = visual.rewriting({ord("о"): 100, ord("o"): 1, ord("ο"): 1, ord("ｏ"): 5})
    assert {out[x] for x in "oοｏ"} == {"о"} and "о" not in out


def test_pairs(spark):
    texts = ["hotel", "hоtel", "ｈotel", "hotel", "Hotel", "123", "１２３", "", "x y", "x\u00a0y"]
    rows = [("a", i, t, 0) for i, t in enumerate(texts)] + [("b", 0, "hotel", 0), ("a", 99, None, 0)]
    df = spark.createDataFrame(rows, "tab string, rec_id int, text string, f1 int")
    got = {tuple(r) for r in visual.same_look_pairs(df).collect()}
    want = {("a", i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if texts[i] != texts[j] and FORM(texts[i]) == FORM(texts[j]) and any(map(str.isalpha, texts[i]))}
    assert got == want == {("a", 0, 1), ("a", 0, 2), ("a", 1, 2), ("a", 1, 3), ("a", 2, 3), ("a", 8, 9)}
    assert visual.same_look_pairs(df.limit(0)).count() == 0
    classes = {(r.tab, r.rec_id): (r.class_id, r.members, r.strings) for r in visual.same_look_classes(df).collect()}
    assert classes == {("a", i): (0, 4, 3) for i in range(4)} | {("a", i): (8, 2, 2) for i in (8, 9)}
    assert visual.same_look_classes(df.limit(0)).count() == 0
    forms = {r.rec_id: r.form for r in visual.visual_form(df.where("tab = 'a'"), "text", ["rec_id"]).collect()}
    assert forms[99] is None and forms[1] == forms[0]


def test_a_third_of_all_rows_look_alike(spark, monkeypatch):
    rows = [("t", i, "same words" if i % 2 else "sаme words") if i % 3 == 0 else ("t", i, f"other {i}") for i in range(300)]
    df = spark.createDataFrame(rows, "tab string, rec_id int, text string")
    want = sorted(map(tuple, visual.same_look_pairs(df).collect()))
    assert len(want) == 50 * 50
    monkeypatch.setattr(visual, "HOT_STRING", 10)
    monkeypatch.setattr(visual, "SPREAD", 4)
    assert sorted(map(tuple, visual.same_look_pairs(df).collect())) == want
