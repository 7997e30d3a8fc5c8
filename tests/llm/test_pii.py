import pytest

from topicloom.llm import pii

NAMES = pii.Names(frozenset(pii.GIVEN), frozenset({"oskazarel", "trevikten"}), frozenset({"the", "and"}))


def kinds(text):
    return {s[2] for s in pii.spans(text, NAMES)}


@pytest.mark.parametrize(("text", "kind"), [
    ("write to me at a.b+c@mail.example.", "email"), ("mailto:x@y.org", "email"), ("ana at inbox dot test", "email"), ("ana_t [at] posada.example", "email"), ("ana.t(arroba)example.net", "email"), ("sven dot x at mail dot example", "email"), ("ｘ.y＠mail.example", "email"),
    ("Call me on 212-555-0109 after six", "phone"), ("+44 (0)20 7946 0123", "phone"), ("Llámame al 555014481 por la tarde", "phone"), ("au 06.39.98.92.74 le soir", "phone"), ("unter (030) 23125 194 an", "phone"), ("Tel: four one five, five five five, oh one four four", "phone"), ("请拨打 13800138000 找我", "phone"), ("Meu telefone é (00) 95550-0113.", "phone"),
    ("my passport no. XZ6028384", "id_number"), ("puse D.N.I.: 00.251.829-R.", "id_number"), ("my SSN 000-33-9111", "id_number"), ("social is 000178756", "id_number"), ("CPF 000.739.494-00", "id_number"), ("Steuer-ID 00 304 513 120.", "id_number"), ("numéro de sécurité sociale 9 00 00 27 700 501 00 sans", "id_number"), ("护照号 E12345678", "id_number"),
    ("I live at 326 Wilquinis Avenue if", "address"), ("Vivo en C/ Falfesca nº 304 por", "address"), ("Envoyez la veste au 393 bis, avenue Yarnesca.", "address"), ("Ich wohne Orriwenweg 42a, falls", "address"), ("Moro na Rua Brorilin, 215 caso", "address"), ("para Av. Tolduvia, nº 476 - Jaskawen", "address"), ("在南京路12号等", "address"),
    ("My name is Mateo Oskazarel and", "name"), ("— MATEO TREVIKTEN", "name"), ("thanks to O. Trevikten at", "name"), ("Trevikten, Ana del turno", "name"), ("mateo oskazarel", "name"), ("Ana Trevi​kten", "name"), ("My name is Rosa Quendel and", "name"),
])
def test_found(text, kind):
    assert kinds(text) == {kind}


@pytest.mark.parametrize("text", [
    "", "@slowtravel_70 said it", "https://reviews.example/v/55840?t=632s", "Booking ref BK-56240-1788.", "Ticket #77064850 is open", "$1,681.17", "€34", "Flight XQ 7080 landed at 14:56.", "40.7646, -3.3916 on the map", "7,714,273 views so far", "Total $1,468.44 on 2023-04-11.", "Room 5467, floor 41.",
    "ISBN 000-4-7536-3630-6", "firmware v4.74.6651", "4 nights @ 526 each", "[00:37:71]", "Casa Mateo is nice", "Hotel Ana Trevikten", "Saint Mateo Cathedral is five minutes away", "In 2014 Residencia Ilzidor opened", "después de un largo retraso en 2021", "meet me at noon", "a ten minute drive", "I would rate it 52 out of 100",
])
def test_left_alone(text):
    assert kinds(text) == set()


def test_checksums():
    assert pii.luhn("79927398713") and not pii.luhn("79927398710")
    assert pii.mod23_letter("12345678Z") and pii.mod23_letter("X1234567L") and not pii.mod23_letter("12345678A")
    assert pii.mod97_key("255081416802538") and not pii.mod97_key("255081416802539")
    assert pii.mod11_pair("52998224725") and not pii.mod11_pair("52998224724")
    assert pii.mod11_10("86095742719") and not pii.mod11_10("86095742718")
    assert pii.mod11_2("11010519491231002X") and not pii.mod11_2("110105194912310021")


def test_the_rest_of_the_text_stays():
    text = "Ｈi, ана: mail a​b@mail.example or call 212-555-0109 now 🏨"
    found = pii.spans(text, NAMES)
    assert pii.redacted(text, found) == "Ｈi, ана: mail [EMAIL] or call [PHONE] now 🏨"


def test_learning_and_rows(spark):
    people = ["Zora Quixwell", "Ivo Brandwick", "Zora Brandwick", "Ivo Quixwell"]
    rows = [(i, f"My name is {people[i % 4]} and we were happy there.", "k") for i in range(12)] + [(50, "then zora quixwell left", "k"), (51, None, "k"), (52, "", "k"), (50, "x@y.org " * 3, "k")]
    df = spark.createDataFrame(rows, "doc_id int, text string, kind string")
    names = pii.learn_names(df, "text")
    assert {"zora", "ivo"} <= names.given and {"quixwell", "brandwick"} <= names.family
    got = sorted((r.doc_id, r.kind) for r in pii.kinds_found(df, "text", "doc_id").collect())
    assert got == [(i, "name") for i in range(12)] + [(50, "email"), (50, "name")]
    out = {r.doc_id: (r.redacted, r.kinds) for r in pii.redact(df, "text", ["doc_id"], names).collect()}
    assert out[51] == (None, []) and out[52] == ("", []) and out[0][0] == "My name is [NAME] and we were happy there."
    assert pii.kinds_found(df.limit(0), "text", "doc_id").count() == 0


@pytest.mark.parametrize(("text", "kind"), [
    ("write to me at marisol.vandon(arroba)mail.example. The", "email"), ("Tel: (312) 555-0113 now", "phone"), ("The owner gave us 6175550139 as the direct line", "phone"), ("right next to the station. — Ana Oskazarel What", "name"), ("numéro de sécurité sociale 9 00 00 55 907 555 00. 40.2390, -3.8733", "id_number"), ("前台的Ana Oskazarel很好", "name"),
])
def test_found_in_awkward_places(text, kind):
    assert kinds(text) == {kind}


def test_very_long_texts_take_linear_time():
    assert len(pii.spans("Ana Oskazarel, " * 20_000, NAMES)) == 20_000
    assert pii.spans("9" * 300_000, NAMES) == [] and pii.spans("a.b " * 100_000, NAMES) == []


FIRST = "Zbigniew Ngozi Thandiwe Øyvind Saoirse Kwabena Yevgenia Tuomas Ayşe Dragoslav".split()
LAST = "Kowalczyk Okonkwo Mkhwanazi Håkonsen MacGiolla Asante-Boadu Rybakova Väisänen Yıldırım O'Sullivan".split()
PLACES = [
    "My name is {} and we stayed a week.", "Thanks to {} for the tour.", "We spoke with {} at the desk.", "This is {} from room nine.", "Me llamo {} y volveremos.", "Gracias a {} por todo.", "Je m'appelle {} et tout allait bien.", "Merci à {} pour la visite.",
    "Mein Name ist {} und es war schön.", "Ich heiße {}, bis bald.", "Meu nome é {} e gostei.", "Obrigado a {} pela ajuda.", "Great stay, signed: {}", "We met Mrs {} there.",
]


def test_introduced_names_need_no_lexicon():
    names = pii.Names(pii.GIVEN)
    texts = [p.format(f"{a} {b}") for p in PLACES for a in FIRST for b in LAST]
    hits = [any(t[s[0] : s[1]].endswith(t.split(b)[0][-1:] + b) or b in t[s[0] : s[1]] for s in pii.spans(t, names) if s[2] == "name") for t, b in zip(texts, LAST * (len(texts) // len(LAST)), strict=True)]
    assert sum(hits) / len(hits) >= 0.9


@pytest.mark.parametrize("text", ["This is Park Plaza Hotel again", "Thanks to Hotel Arts for it", "thanks to everybody here", "Thanks to Casa Mateo", "i am very happy", "This Is The Best Hotel", "Soy de Valencia", "Ich bin Gast hier"])
def test_introductions_of_no_person(text):
    assert "name" not in kinds(text)


def test_chinese_names_after_an_introduction():
    assert pii.redacted("你好，我叫王小明，住三晚", pii.spans("你好，我叫王小明，住三晚", NAMES)) == "你好，我叫[NAME]，住三晚"
    assert kinds("我叫不到出租车") == set()


def test_addresses_of_any_length_are_covered():
    text = "Write to " + "a" * 500 + " at example dot com now"
    assert pii.redacted(text, pii.spans(text, NAMES)) == "Write to [EMAIL] now"
    text = "to " + " dot ".join(["ana"] * 60) + " (at) " + " dot ".join(["mail"] * 60) + " dot org please"
    assert pii.redacted(text, pii.spans(text, NAMES)) == "to [EMAIL] please"
    assert pii.spans(("x" * 20_000 + " at ") * 10, NAMES) == []


def test_a_lexicon_of_any_size(spark, monkeypatch):
    letters = "abcdefghijklmnop"
    people = [f"Zor{a} Quix{b}well" for a in letters for b in letters]
    rows = [(i, f"Thanks to {p} we came back. MADRID", i) for i, p in enumerate(people)] * 2 + [(1000 + i, f"then {p.lower()} left, as did Ana Zorb", i) for i, p in enumerate(people)] + [(5000, None, 0), (5001, "", 0)]
    df = spark.createDataFrame(rows, "doc_id int, text string, word int")
    held = sorted(map(tuple, pii.redact(df, "text", ["doc_id"]).collect()), key=str)
    monkeypatch.setattr(pii, "MAX_NAMES", 3)
    assert sorted(map(tuple, pii.redact(df, "text", ["doc_id"]).collect()), key=str) == held
    assert all("[NAME] left" in t for i, t, _ in held if 1000 <= i < 5000)
    assert sorted(map(tuple, pii.kinds_found(df, "text", "doc_id").collect())) == sorted((i, "name") for i, t, k in held if k)
