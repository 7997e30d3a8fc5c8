import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from topicloom.llm import encoding as e

TEXTS = ["Nadie nos avisó de que el café’s menú era “caro” – 9 €", "Où est passé le charme ? Ça va, très bien à côté", "Wir zahlten 8 € für größere Zimmer, übernachtet", "Pagamos 5 euros, não é confortável, é ótimo"]
CHINESE = "没有人告诉我们夜班经理整晚放着轻音乐。又一次，管家应用需要重新启动"


def lenient(raw: bytes, codec: str) -> str:
    return "".join(_one(b, codec) for b in raw)


def _one(b: int, codec: str) -> str:
    try:
        return bytes([b]).decode(codec)
    except UnicodeDecodeError:
        return chr(b)


@pytest.mark.parametrize("codec", e.SINGLE)
@pytest.mark.parametrize("text", [*TEXTS, CHINESE])
def test_single_byte_round_trip(codec, text):
    garbled = lenient(text.encode(), codec)
    assert e.garbled(garbled) == (True, text)
    assert e.garbled("plain start. " + garbled) == (True, "plain start. " + text)


@pytest.mark.parametrize("text", TEXTS)
def test_nested(text):
    garbled = lenient(lenient(text.encode(), "cp1252").encode(), "cp1252")
    assert e.garbled(garbled) == (True, text)


@pytest.mark.parametrize("layers", [3, 5, 6, 8])
def test_any_number_of_layers(layers):
    garbled = "Où est le café ?"
    for _ in range(layers):
        garbled = lenient(garbled.encode(), "cp1252")
    assert e.garbled(garbled) == (True, "Où est le café ?")


def test_double_byte():
    assert e.garbled(lenient(CHINESE.encode("gbk"), "cp1252")) == (True, CHINESE)
    done = 0
    for a in range(len(CHINESE) - 8):
        part = CHINESE[a : a + 8]
        try:
            garbled = part.encode().decode("gbk")
        except UnicodeDecodeError:
            continue
        done += 1
        assert e.garbled(garbled) == (True, part)
    assert done > 3


def test_unrestorable_is_reported():
    assert e.garbled("caf� noir") == (True, "caf� noir")
    assert e.garbled("it\x92s")[0]


@pytest.mark.parametrize("text", [None, "", "plain", *TEXTS, CHINESE, "ATENÇÃO: NÃO É confortável", "«IRMû foi", "“IRMÔ foi", "(Отель «Беломорье»)", "(Θάλασσα)", "«¡Ñandú!»", "🏨👍 10/10", "Ä“ und “Ü”", "2024年酒店 hotel 5º D", "ｆｕｌｌ１２"])
def test_sound_text_stays(text):
    assert e.garbled(text) == (False, text)


@settings(max_examples=200, deadline=None)
@given(st.text("abc éñ“”’€ßüãÇ", max_size=30))
def test_sound_letters_stay_after_repair(text):
    assert e.repair(e.repair(text)) == e.repair(text)


def test_rows(spark):
    df = spark.createDataFrame([(1, "cafÃ© bar", 0), (2, "fine", 0), (3, None, 0), (4, "x� y", 0), (1, "cafÃ© bar", 0)], "id int, text string, restored int")
    got = sorted((r.id, r.restored, r.complete) for r in e.find_garbled(df, "text", ["id"]).collect())
    assert got == [(1, "café bar", True), (1, "café bar", True), (4, "x� y", False)]
    assert e.find_garbled(df, "text", ["id"], all_rows=True).count() == 5
    with pytest.raises(ValueError, match="clash"):
        e.find_garbled(df, "text", ["restored"])
