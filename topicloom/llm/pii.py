"""Personal information in free text: typed placeholders for e-mail addresses, phone numbers, identity numbers, street
addresses and names (problem 9).

Regular expressions propose spans, each with a base score. Validators (mod-97, mod-23, mod-11, mod-11-10, Luhn) raise
the score of numbers that they confirm, words nearby raise or lower it, and a span counts from ``THRESHOLD`` on.
Where spans overlap, the higher score wins, then the longer span. Matching looks at the visual form of the text
(full-width digits, look-alike letters, invisible characters) with a map back to the original positions, so that the
rest of the text stays exactly as it was.

One multi-pattern automaton reads each text once and gives the places of phrases, names and keywords; the regular
expressions are then tried at these places and at digits alone, never at every position.

Names need a lexicon. It is learned from the collection itself: words that follow phrases of introduction, thanks and
signature are counted by a grouped aggregation, as given and as family names, and so are the texts in which these words
stand in lower case. Words that are mostly written in lower case, and words that follow names of hotels, saints or
dishes, are no names. Right after an introduction two capitalised words are a name whatever the lexicon says.

A lexicon of up to ``MAX_NAMES`` words is held by every task. A larger one stays a table: the words of each text are
looked up in it by a join and the tasks get each text with its own names, so no name is lost.

Defined cases: null and empty texts have no spans; a text of any length is searched whole; a kind is reported once
for a row however often it occurs; repeated rows are reported each; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicloom.llm.texts import map_text
from topicloom.llm.visual import unicode_patterns
from topicloom.session import ship, written

KINDS = ("email", "phone", "id_number", "address", "name")
THRESHOLD = 0.6
#: The learned names that every task holds at most; a larger lexicon is joined.
MAX_NAMES = 200_000


# --- positions -----------------------------------------------------------------------------------------------------


@lru_cache(maxsize=1)
def _single() -> tuple[dict[str, str], dict[int, str]]:
    one = {p: r for p, r in unicode_patterns().items() if len(p) == 1}
    return one, {ord(p): r for p, r in one.items()}


def visual(text: str) -> str:
    """The text with each character in its visual form and accents composed."""
    if text.isascii():
        return text
    one, table = _single()
    form = text if one.keys().isdisjoint(text) else text.translate(table)
    return form if unicodedata.is_normalized("NFC", form) else aligned(text)[0]


def aligned(text: str) -> tuple[str, list[tuple[int, int]]]:
    """The visual form, and for each position of it the stretch of the original that it stands for."""
    one = _single()[0]
    out: list[str] = []
    where: list[tuple[int, int]] = []
    for i, ch in enumerate(text):
        for c in one.get(ch, ch):
            if out and unicodedata.combining(c) and len(both := unicodedata.normalize("NFC", out[-1] + c)) == 1:
                out[-1], where[-1] = both, (where[-1][0], i + 1)
            else:
                out.append(c)
                where.append((i, i + 1))
    return "".join(out), where


def _lowered(o: int) -> int:
    ch = chr(o)
    if not ch.isalpha() or "\u4e00" <= ch <= "\u9fff":
        return 32
    low = ch.lower()
    return ord(low) if len(low) == 1 else o


#: Letters in lower case and all else as blanks, Chinese characters too, position by position.
_PLAIN = {o: _lowered(o) for block in (range(0x3400), range(0x4DC0, 0xAC00), range(0xD7A4, 0xD800), range(0xE000, 0x10000), range(0x1F000, 0x1FB00)) for o in block}


# --- checksums -----------------------------------------------------------------------------------------------------


def luhn(digits: str) -> bool:
    total = sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def mod97_key(digits: str) -> bool:
    """The French social security number: the last two digits are 97 minus the rest modulo 97."""
    return len(digits) == 15 and int(digits[13:]) == 97 - int(digits[:13]) % 97


def mod23_letter(number: str) -> bool:
    """The Spanish identity number: its letter follows from the number modulo 23."""
    number = number.upper()
    digits = number[:-1].translate(str.maketrans("XYZ", "012"))
    return digits.isdigit() and "TRWAGMYFPDXBNJZSQVHLCKE"[int(digits) % 23] == number[-1]


def mod11_pair(digits: str) -> bool:
    """The Brazilian tax number: two check digits modulo 11."""
    for n in (9, 10):
        s = sum(int(d) * w for d, w in zip(digits[:n], range(n + 1, 1, -1), strict=True))
        if (s * 10 % 11) % 10 != int(digits[n]):
            return False
    return True


def mod11_10(digits: str) -> bool:
    """The German tax number: ISO 7064, modulo 11,10."""
    product = 10
    for d in digits[:10]:
        s = (int(d) + product) % 10 or 10
        product = s * 2 % 11
    return (11 - product) % 10 == int(digits[10])


def mod11_2(number: str) -> bool:
    """The Chinese identity number: ISO 7064, modulo 11,2."""
    s = sum(int(d) * pow(2, 17 - i, 11) for i, d in enumerate(number[:17]))
    return "10X98765432"[s % 11] == number[17].upper()


# --- patterns ------------------------------------------------------------------------------------------------------

_ID_WORD = r"passport|passaporte|pasaporte|passeport|reisepass(?:nummer)?|(?:personal)?ausweis(?:nummer)?|carte d['’ ]identit[ée]|carte nationale|national id(?: card)?|identity card|id card|d\.?n\.?i\.?|n\.?i\.?e\.?|n\.?i\.?f\.?|cpf|rg|cédula|c[ée]dula|ssn|social security(?: number| no\.?)?|social(?= is)|seguro social|seguridad social|segurança social|s[ée]curit[ée] sociale|sozialversicherungsnummer|steuer-?\s?id(?:entifikationsnummer)?|steuernummer|tax (?:id|number)|nin|nino|national insurance(?: number)?|documento de identidad|bilhete de identidade|cart[ãa]o de cidad[ãa]o|护照(?:号码|号)?|身份证(?:号码|号)?"
_PHONE_WORD = r"call|phone|tel|tél|telephone|mobile|cell|whatsapp|text|fax|number is|direct line|reach me|ring|teléfono|telefono|móvil|llám|llam[ae]|numero es|número es|appelez|téléphone|telephone|portable|numéro|rufen|anruf|telefon|handy|nummer|ligue|telefone|celular|contato|contacto|kontakt|拨打|电话|手机|致电|联系"
_NOT_PERSONAL = r"isbn|issn|ticket|booking|book ref|ref\.?|reference|order|invoice no|flight|firmware|version|room|floor|zimmer|habitación|chambre|quarto|views|on the map|coordinates|gps|total|订单|航班|房间"

_LABEL = r"[a-z0-9](?:[a-z0-9\-]*[a-z0-9])?"
_DOT_WORD = r"(?:dot|punto|ponto|point|punkt|点)"
_AT_WORDS = ("at", "arroba", "arobase", "ät")
_LOCAL = r"[a-z0-9](?:[a-z0-9._+\-]*[a-z0-9_])?"
EMAIL = re.compile(rf"(?<![a-z0-9._+\-@]){_LOCAL}@{_LABEL}(?:\.{_LABEL})*\.[a-z]{{2,24}}(?![a-z0-9@])", re.I)
_LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._+-")
_OPENED = re.compile(r"\s*[\(\[{<]\s*$|\s$")
_DOT_BEFORE = re.compile(rf"\s{_DOT_WORD}\s$", re.I)
_ANY_DOT = rf"(?:\.|\s?[\(\[{{]\s?(?:{_DOT_WORD}|\.)\s?[\)\]}}]\s?|\s{_DOT_WORD}\s)"
_AFTER_AT = re.compile(rf"(?P<close>\s*[\)\]}}>]\s*|\s)(?P<domain>{_LABEL}(?:{_ANY_DOT}{_LABEL})*{_ANY_DOT}[a-z]{{2,24}})(?![a-z0-9@(\[])", re.I)
_AT_SIGN = re.compile(r"(?<=\s)@(?=\s)|(?<=[\[({<])@")
URL = re.compile(r"(?:https?:|www\.)\S+", re.I)
ID = re.compile(rf"(?<![a-zà-ÿ])(?:{_ID_WORD})(?![a-zà-ÿ])(?P<gap>[\s:.,(（#=\-–]*(?:(?:number|no|nr|n[º°o]|núm|num|numéro|número|nummer|is|es|ist|est|é|是|为|als)[\s.:]*)?[\s:.(（#]*)(?P<value>[a-z]{{0,3}}[\s\-.]?\d[\da-z]*(?:[\s.\-/]?\d[\da-z]*)*(?:-[a-z](?![a-z]))?)", re.I)
# The beginnings of the words for identity numbers, letters only.
_ID_HEADS = """
passport passaporte pasaporte passeport reisepass personalausweis ausweis carte national identity id d dni n nie nif cpf rg cédula cedula ssn social
seguro seguridad segurança sécurité securité sécurite sozialversicherungsnummer steuer tax nin nino documento bilhete cartão cartao
""".split()
_ID_CHINESE = re.compile("护照|身份证")
_ID_SHAPES = [
    (re.compile(r"(?<![\w\-.])\d{8}-?[A-Z](?![\w\-])"), 0.3, lambda v: mod23_letter(v.replace("-", ""))),
    (re.compile(r"(?<![\w\-.])\d{2}\.\d{3}\.\d{3}-[A-Z](?!\w)"), 0.5, lambda v: mod23_letter(re.sub(r"[.\-]", "", v))),
    (re.compile(r"(?<![\w\-.])[XYZ]-?\d{7}-?[A-Z](?![\w\-])"), 0.5, lambda v: mod23_letter(v.replace("-", ""))),
    (re.compile(r"(?<![\w\-.])\d{3}\.\d{3}\.\d{3}-\d{2}(?![\w\-])"), 0.65, lambda v: mod11_pair(re.sub(r"\D", "", v))),
    (re.compile(r"(?<![\w\-.])\d{3}-\d{2}-\d{4}(?![\w\-])"), 0.6, lambda v: not v.startswith(("000", "666", "9"))),
    (re.compile(r"(?<![\w\-.])[12789](?:[\s]?\d\d){3}\s?\d{2,3}\s?\d{3}\s?\d{3}\s?\d\d(?![\w\-])"), 0.3, lambda v: mod97_key(re.sub(r"\D", "", v))),
    (re.compile(r"(?<![\w\-.])\d{2}\s?\d{3}\s?\d{3}\s?\d{3}(?![\w\-.])"), 0.1, lambda v: mod11_10(re.sub(r"\D", "", v))),
    (re.compile(r"(?<![\w\-.])\d{17}[\dXx](?![\w\-])"), 0.3, mod11_2),
    (re.compile(r"(?<![\w\-.])\d{3}[\s-]\d{3}[\s-]\d{3}(?![\w\-])"), 0.0, lambda v: luhn(re.sub(r"\D", "", v))),
    (re.compile(r"(?<![\w\-.])[A-Z]{2}\s?\d{6}\s?[A-D](?!\w)"), 0.62, lambda v: False),
]
PHONE = re.compile(r"(?<![\w.,@#/$€£\-])(?:\(?\+\s?|\()?\d[\d\s().\-/–]{5,22}\d(?![\w@]|[.,]\d)")
_PHONE_SHAPES = [
    (re.compile(r"\(?\+\d{1,3}\)?[\s.\-]?(?:\(0\)\s?)?[\d\s.\-()/–]{6,16}"), 0.8),
    (re.compile(r"00\d{2}[\s.\-]?\d[\d\s.\-/]{6,12}"), 0.7),
    (re.compile(r"\(?\d{2}\)?[\s]9\d{4}[\-.\s]\d{4}"), 0.7),
    (re.compile(r"(?:1[\s.\-])?\(?[02-9]\d{2}\)?[\s.\-]\d{3}[\s.\-]\d{4}"), 0.65),
    (re.compile(r"07\d{3}\s?\d{3}\s?\d{3}"), 0.65),
    (re.compile(r"0\d{2,4}[\s]\d{3,4}[\s]\d{3,4}"), 0.65),
    (re.compile(r"0[1-9](?:[\s.\-]?\d\d){4}"), 0.65),
    (re.compile(r"\(?0\d{2,4}\)?[\s/\-]\d{3,6}(?:[\s\-]?\d{2,4})?"), 0.62),
    (re.compile(r"\d{3}(?:\s\d\d){3}"), 0.62),
    (re.compile(r"1[3-9]\d[\s-]?\d{4}[\s-]?\d{4}"), 0.6),
    (re.compile(r"\d{3}[\s\-]\d{6}"), 0.45),
    (re.compile(r"\d{7,12}"), 0.3),
]
#: Six digits on, one separator at most between two of them.
_CHAIN = re.compile(r"\d(?:[\s.\-/]?\d){5,20}")
_LETTERS_BEFORE = re.compile(r"[A-Z]{1,2}[\s\-]?$")
# The digits in words, from zero to nine, in the languages that write them as words.
_DIGIT_WORDS = """
zero oh one two three four five six seven eight nine double triple
cero uno dos tres cuatro cinco seis siete ocho nueve
zéro un deux trois quatre cinq six sept huit neuf
null eins zwei zwo drei vier fünf sechs sieben acht neun
um dois três quatro cinco seis sete oito nove
""".split()
_W = "|".join(sorted(set(_DIGIT_WORDS), key=len, reverse=True))
PHONE_WORDS = re.compile(rf"(?<!\w)(?:(?:{_W})(?:[\s,.\-]+(?={_W})|(?!\w))){{7,}}|[零〇一二三四五六七八九幺]{{7,}}", re.I)

_NAME_WORD = r"[^\W\d_][\w'’\-]*"
_FLAT = re.compile(r"\b(?:flat|apt\.?|apartment|unit)\s\d{1,6}[a-z]?,\s$", re.I)
_NUMBER_STREET = re.compile(r"(?<![\w.,$€£#\-])(?<!in )\d{1,5}[a-z]?\s(?!min|hour|percent|night|day|mile|km|star|lane\b|euro|out\b)(?:[^\W\d_][\w'’\-]*\s){1,3}?(?:street|st\b\.?|road|rd\b\.?|avenue|ave\b\.?|lane|drive|court|close|boulevard|blvd\b\.?|square|terrace|crescent|way(?=[,.\n]|$))(?!\w)(?:,?\s(?:apt|flat)\.?\s\d+[a-z]?)?(?:,\s[A-Z]\w+(?:\s\d{5})?)?", re.I)
_NUMBER_RUE = re.compile(rf"(?<![\w.,])\d{{1,4}}(?:\s(?:bis|ter|quater))?,?\s(?:rue|avenue|boulevard|allée|impasse|chemin|quai|cours|place|route|bd\.?|av\.)\s(?:d['’]|de\sla\s|des?\s|du\s|de\sl['’])?{_NAME_WORD}", re.I)
_CALLE_NUMBER = re.compile(rf"(?<!\w)(?:calle|c/|avenida|av(?:da?)?\.|paseo|plaza|pza\.|camino|carretera|ronda|rua|(?-i:R\.|Largo|Via|Viale)|travessa|trav\.|alameda|praça|estrada)\s(?:d[aeo]s?\s|del\s|de\sla\s|de\slos\s)?{_NAME_WORD}(?:\s{_NAME_WORD}){{0,2}}?,?\s?(?:(?:n\.?[ºo°]?\.?|núm\.?|num\.?)\s?)?\d{{1,4}}(?!\d)[a-z]?(?:,\s(?:\d+\s?[ºo°]\s?[a-z]?\b|apto\.?\s\d+))?", re.I)
_STRASSE_NUMBER = re.compile(r"(?<!\w)[^\W\d_][\w\-]*(?:straße|strasse|str\.|weg|platz|allee|gasse|ring|damm|ufer|chaussee)\s\d{1,4}\s?[a-z]?(?!\w|[.,]\d)", re.I)
_AM = re.compile(r"(?<!\w)(?:am|an der|auf dem|im|in der)\s$", re.I)
_LU_NUMBER = re.compile(r"[一-鿿]{1,8}(?:路|街|大道|大街|巷|弄|胡同)\s?\d{1,5}\s?(?:号|弄)")
# The words a street begins with, letters only, and the ends of German street names.
_STREET_HEADS = "calle c avenida av avd avda paseo plaza pza camino carretera ronda rua r largo via viale travessa trav alameda praça estrada".split()
_STREET_ENDS = "straße strasse str weg platz allee gasse ring damm ufer chaussee".split()

# Phrases before a personal name, with apostrophes as blanks. Those of the first list say that it is one.
_NAME_IS = """
my name is / name s / names / me llamo / mi nombre es / je m appelle / mon nom est / mein name ist / ich heiße / ich heisse / meu nome é / meu nome e / me chamo
"""
_SELF = "i am / i m / this is / soy / ich bin / sou"
_MENTION = """
thanks to / thank you / thanks / interviewed / reviewed by / written by / posted by / signed / by our guest / our guest / for our guest / booked for / spoke to / spoke with
gracias a / hablamos con / hablamos con la / hablamos con el / firmado / reseña de / merci à / merci a / nous avons parlé à / nous avons parlé avec / signé / avis de
danke an / gezeichnet / wir sprachen mit / gast / obrigado a / obrigada a / obrigado ao / obrigada ao / assinado / falamos com / falamos com a / falamos com o / hóspede / huésped / huéspeda
"""
_TITLE = "mr mrs ms miss dr prof sr sra srta señor señora don doña mme mlle madame monsieur herr frau senhor senhora dona".split()
_CHINESE_PHRASE = re.compile(r"(?:(?P<name>我叫|我的名字是|署名)|我是|感谢|谢谢)[\s:：,，]{0,3}")
# Frequent Chinese family names.
_CHINESE_FAMILY = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛"
_CHINESE_NAME = re.compile(f"[{_CHINESE_FAMILY}][一-鿿]{{1,2}}(?![一-鿿])")
_DASH = re.compile(r"(?:(?<![^\n.!?»”\"])|(?<=[\n.!?»”\"]\s)|(?<=\s))[—–]\s(?=[^\W\d_])")
NAME_IS, SELF, MENTION, TITLE, SIGNED = 1, 2, 4, 8, 16


def phrases(listed: str) -> list[str]:
    return [p.strip() for line in listed.strip().splitlines() for p in line.split("/") if p.strip()]


# Words that make the words beside them the name of a house, place, saint or dish.
NOT_A_PERSON = set(
    "hotel casa residencia pousada palace lodge suites suite inn capsule hostal hostel villa resort hotels saint san santa santo são sankt sainte st church "
    "cathedral catedral iglesia igreja church basilica bay beach playa praia plage island isla isle mount monte lake lago park parque parc street calle rue rua avenue avenida boulevard "
    "road lane court drive close paseo plaza platz weg straße travessa bridge puente airport station café cafe restaurant bar tarta sopa salsa ensalada pizza torte salade pastel".split()
)
# Common given names of the languages at hand, the start of the lexicon.
GIVEN = set(
    "maria josé jose ana antonio carlos laura marta luis juan pedro lucía lucia sofía sofia elena carmen pablo javier miguel rosa beatriz rafael mateo marisol carla "
    "john mary james robert michael william david richard thomas sarah emma olivia peter owen edwin helen helena alice george harry jack emily charlotte paul mark anna kate "
    "jean pierre marie camille noémie noemie julie claire louis michel nicolas sophie luc élise chloé antoine "
    "hans klaus jürgen greta ingrid ilse jonas felix tobias anja petra stefan wolfgang lena lukas sven karl friedrich heike uwe "
    "joão joao paulo joaquim bruno tiago rita inês francisca duarte gonçalo fernanda ricardo "
    "priya amara yusuf tariq nadia mei fatima ahmed omar aisha wei li chen ravi anil ivan olga dmitri natasha".split()
)

_PERSON = re.compile(rf"(?P<a>{_NAME_WORD}|[^\W\d_]\.)(?P<c>,)?\s?(?P<b>{_NAME_WORD}\.?)(?:\s(?P<d>{_NAME_WORD}))?")
# a word of letters; Chinese characters beside a Latin word end it
_TOKENS = re.compile(r"[^\W\d_一-鿿](?:\.(?=\s?[^\W\d_])|(?:[^\W一-鿿]|['’\-])*)|[一-鿿]+")


# what a hit of the automaton is, beyond the five kinds of phrases
NAME, AT, ID_HEAD, STREET, STREET_END, DIGIT = 32, 64, 128, 256, 512, 1024


def automaton(words: dict[str, int]) -> ahocorasick.Automaton:
    """An automaton over plain text: pattern -> (what it is, its length, whether it begins with a blank, whether it ends with one)."""
    machine = ahocorasick.Automaton()
    for word, what in words.items():
        machine.add_word(word, (what, len(word), word[0] == " ", word[-1] == " "))
    machine.make_automaton()
    return machine


def _phrases() -> dict[str, int]:
    out: dict[str, int] = {}
    for what, of in ((NAME_IS, phrases(_NAME_IS)), (SELF, phrases(_SELF)), (MENTION, phrases(_MENTION)), (TITLE, _TITLE)):
        for p in of:
            out[f" {p} "] = out.get(f" {p} ", 0) | what
    return out


def _keywords() -> dict[str, int]:
    out = _phrases()
    for what, of in ((AT, [f" {w} " for w in _AT_WORDS]), (ID_HEAD, [f" {w}" + " " * (len(w) < 5) for w in _ID_HEADS]), (STREET, [f" {w} " for w in _STREET_HEADS]), (STREET_END, [f"{w} " for w in _STREET_ENDS]), (DIGIT, [f" {w} " for w in set(_DIGIT_WORDS)])):
        for p in of:
            out[p] = out.get(p, 0) | what
    return out


def _plain(text: str) -> str:
    return f" {text.translate(_PLAIN)} "


class Names:
    """The lexicon: given and family names, and words that are usually lower case."""

    def __init__(self, given: Iterable[str] = (), family: Iterable[str] = (), common: Iterable[str] = ()) -> None:
        self.given, self.family, self.common = frozenset(given), frozenset(family), frozenset(common)
        self.machine: ahocorasick.Automaton | None = None

    def __reduce__(self):
        return Names, (self.given, self.family, self.common)

    def hits(self, plain: str) -> Iterator[tuple[int, tuple]]:
        if self.machine is None:
            words = _keywords()
            for w in self.given | self.family:
                key = f" {w.translate(_PLAIN)} "
                words[key] = words.get(key, 0) | NAME
            self.machine = automaton(words)
        return self.machine.iter(plain)


# --- learning names ------------------------------------------------------------------------------------------------


def _capital(word: str) -> bool:
    return word[:1].isupper()


def place_after(form: str, end: int) -> int | None:
    """Where the word begins that follows a phrase, at most three characters behind it."""
    for p in range(end, min(end + 4, len(form))):
        if form[p].isalnum() or form[p] == "_":
            return p
    return None


def dashes(form: str) -> Iterator[int]:
    """The places behind a dash that may begin a signature."""
    if "—" in form or "–" in form:
        for m in _DASH.finditer(form):
            yield m.end()


_ONLY = {what: re.compile(gap) for what, gap in ((NAME_IS, r"[\s:：]{0,2}"), (SELF, r"\s?"), (MENTION, r"[\s:：,]{0,3}"), (TITLE, r"\.?\s"))}


def introductions(form: str, hits: Iterable[tuple[int, tuple]]) -> dict[int, int]:
    """place of a word -> what kind of phrase stands before it with nothing else between."""
    out: dict[int, int] = {}
    for end, (what, _, _, trail) in hits:
        what &= NAME_IS | SELF | MENTION | TITLE
        if what:
            end -= trail
            p = place_after(form, end)
            if p is not None:
                for kind, gap in _ONLY.items():
                    if what & kind and gap.fullmatch(form, end, p):
                        out[p] = out.get(p, 0) | kind
    for m in _CHINESE_PHRASE.finditer(form):
        out[m.end()] = out.get(m.end(), 0) | (NAME_IS if m["name"] else MENTION)
    for p in dashes(form):
        out[p] = out.get(p, 0) | SIGNED
    return out


@lru_cache(maxsize=1)
def _phrase_machine() -> ahocorasick.Automaton:
    return automaton(_phrases())


def introduced(form: str) -> Iterator[tuple[str, str]]:
    """(role, word) for the words in the places of names after an introduction, a mention or a title."""
    for p, what in introductions(form, _phrase_machine().iter(_plain(form))).items():
        m = _PERSON.match(form, p)
        if not m:
            continue
        a, b = m["a"], m["b"].rstrip(".")
        if not (_capital(a) and _capital(b)) or a.lower() in NOT_A_PERSON or b.lower() in NOT_A_PERSON or len(b) < 4:
            continue
        if m["c"]:
            a, b = b, a
        for _ in range(what.bit_count()):
            if len(a.rstrip(".")) > 1 and not a.endswith("."):
                yield "given", a.lower()
            yield "family", b.lower()
            if m["d"] and _capital(m["d"]) and not m["c"]:
                yield "maybe", m["d"].lower()


_BOUND = frozenset("@.+-_")


def in_lower_case(text: str, machine: ahocorasick.Automaton) -> set[str]:
    """The words of the automaton that stand in a text as they are."""
    out = set()
    for end, word in machine.iter(text):
        a = end - len(word)
        if (a < 0 or not (text[a].isalnum() or text[a] in _BOUND)) and (end + 1 == len(text) or not (text[end + 1].isalnum() or text[end + 1] in _BOUND)):
            out.add(word)
    return out


def _counted(found: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["word", "n"])


def learn_names(df: DataFrame, text: str) -> Names | DataFrame:
    """The lexicon of a collection from two aggregates: of words in the places of names, and of the texts in which these words
    stand in lower case. Both are combined in the tasks, so only candidates are shuffled. A lexicon of more than
    ``MAX_NAMES`` words comes as a table (word, given, family, common)."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for t in batch.column(0).to_pylist():
                found.update(introduced(visual(t)))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(found.values(), pa.int64())], ["role", "word", "n"])

    source = df.select(F.col(text).cast("string").alias("t")).where(F.col("t").isNotNull())
    words = source.mapInArrow(run, "role string, word string, n bigint").groupBy("word").pivot("role", ["given", "family", "maybe"]).agg(F.sum("n"))
    words = written(words.fillna(0), "names")
    got = [r.word for r in words.select("word").limit(MAX_NAMES + 1).collect()]
    if not got:
        return Names(GIVEN)
    # in which a candidate stands in lower case though the text has capitals
    mixed = source.where(F.col("t") != F.lower("t"))
    if len(got) <= MAX_NAMES:

        def ordinary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            machine = ahocorasick.Automaton()
            for w in got:
                machine.add_word(w, w)
            machine.make_automaton()
            for batch in batches:
                found: Counter = Counter()
                for t in batch.column(0).to_pylist():
                    found.update(in_lower_case(t, machine))
                yield _counted(found)

        counts = mixed.mapInArrow(ordinary, "word string, n bigint")
    else:
        pieces = mixed.select(F.explode(F.array_distinct(F.split("t", r"[^\p{L}\p{N}_@.+\-]+"))).alias("word"))
        counts = pieces.groupBy("word").agg(F.count(F.lit(1)).alias("n")).join(words.select("word"), "word", "left_semi")
    low = counts.groupBy("word").agg(F.sum("n").alias("low"))
    rows = words.join(low, "word", "left").withColumn("low", F.coalesce("low", F.lit(0))).withColumn("known", F.col("word").isin(*GIVEN))
    rows = rows.withColumn("common", (F.col("low") > 2 * (F.col("given") + F.col("family"))) & ~F.col("known"))
    is_given = (F.col("given") >= 2) & (F.col("given") >= F.col("family")) & (F.col("low") <= F.col("given"))
    is_family = (F.col("family") >= 1) & (F.col("family") >= F.col("given")) & (F.col("low") <= F.col("family")) & ~F.col("known")
    rows = rows.select("word", ((is_given | F.col("known")) & ~F.col("common")).alias("given"), (is_family & ~F.col("common")).alias("family"), "common")
    rows = rows.where("given or family or common")
    if len(got) <= MAX_NAMES:
        return _names(rows.collect())
    spark = df.sparkSession
    start = spark.createDataFrame([(w,) for w in sorted(GIVEN)], "word string").select("word", F.lit(True).alias("given"), F.lit(False).alias("family"), F.lit(False).alias("common"))
    return written(rows.unionByName(start).groupBy("word").agg(*(F.max(c).alias(c) for c in ("given", "family", "common"))), "lexicon")


def _names(rows: Iterable) -> Names:
    rows = list(rows)
    return Names(GIVEN | {r.word for r in rows if r.given}, {r.word for r in rows if r.family}, {r.word for r in rows if r.common})


# --- spans ---------------------------------------------------------------------------------------------------------


def _near(form: str, a: int, b: int, before: int = 40, after: int = 24) -> tuple[str, str]:
    return form[max(0, a - before) : a], form[b : b + after]


_DIGITS = re.compile(r"\d+")
_LINE_AFTER = re.compile(r"\W{0,3}(?:as |is |como |comme |als )?(?:the |my |our |a |mi |mon |ma |meu |unser |mein )?(?:direct line|phone|mobile|cell|whatsapp|teléfono|telefone|téléphone|telefon|handy)", re.I)
_CHINESE_DIGITS = re.compile("[零〇一二三四五六七八九幺]{7}")
_PHONE_NEAR = re.compile(_PHONE_WORD, re.I)
_ID_NEAR = re.compile(rf"(?<![a-zà-ÿ])(?:{_ID_WORD})(?![a-zà-ÿ])", re.I)
_NEGATIVE = re.compile(rf"(?<!\w)(?:{_NOT_PERSONAL})\W{{0,3}}(?:no\.?|nr\.?|#|is|:)?\s?\W{{0,2}}$", re.I)
_NEGATIVE_AFTER = re.compile(r"\W{0,3}(?:views|on the map|nights?|each)\b", re.I)


def local_before(form: str, end: int) -> tuple[int, bool] | None:
    """(where the local part of an address that ends at ``end`` begins, whether a bracket stands between), for any length."""
    opened = _OPENED.search(form, max(0, end - 8), end)
    if not opened:
        return None
    begin = opened.start()
    while True:
        a = begin
        while a and form[a - 1] in _LOCAL_CHARS:
            a -= 1
        if a == begin or not form[a].isalnum() or not (form[begin - 1].isalnum() or form[begin - 1] == "_") or a and form[a - 1] == "@":
            return None
        dot = _DOT_BEFORE.search(form, max(0, a - 9), a)
        if not dot or not dot.start() or form[dot.start() - 1] not in _LOCAL_CHARS:
            return a, bool(opened[0].strip())
        begin = dot.start()


def emails(form: str, ats: list[tuple[int, int]]) -> Iterator[tuple[int, int, str, float]]:
    """Addresses, plain and written to avoid harvesting; ``ats`` are the places of words for the sign."""
    if "@" in form:
        for m in EMAIL.finditer(form):
            yield m.start(), m.end(), "email", 0.95
        ats = ats + [m.span() for m in _AT_SIGN.finditer(form)]
    for a, b in ats:
        right = _AFTER_AT.match(form, b)
        left = right and local_before(form, a)
        if not left or left[1] != bool(right["close"].strip()):
            continue
        score = 0.4
        if left[1]:
            score += 0.4
        if not re.fullmatch(rf"{_LABEL}(?:\.{_LABEL})+", right["domain"], re.I):
            score += 0.4
        if re.search(r"[._+\d\-]", form[left[0] : a].strip(" ([{<")):
            score += 0.25
        if form[a:b] in ("AT", "@"):
            score += 0.2
        yield left[0], right.end(), "email", min(score, 0.94)


def id_numbers(form: str, runs: list[tuple[int, int]], heads: list[int]) -> Iterator[tuple[int, int, str, float]]:
    """Numbers after their words, and numbers of a known shape, at the runs of digits."""
    heads = heads + [m.start() for m in _ID_CHINESE.finditer(form)]
    for at in heads:
        m = ID.match(form, at)
        if m and 5 <= sum(ch.isdigit() for ch in m["value"]) <= 20:
            yield m.start("value"), m.end("value"), "id_number", 0.9
    last = [0] * len(_ID_SHAPES)
    for a, _ in runs:
        if not _CHAIN.match(form, a):
            continue
        starts = [a]
        if letters := _LETTERS_BEFORE.search(form, max(0, a - 3), a):
            starts.insert(0, letters.start())
        for start in starts:
            for k, (pattern, base, valid) in enumerate(_ID_SHAPES):
                if start < last[k] or not (m := pattern.match(form, start)):
                    continue
                last[k] = m.end()
                before, _ = _near(form, m.start(), m.end())
                score = base + 0.35 * bool(valid(m[0])) + 0.4 * bool(_ID_NEAR.search(before)) - 0.6 * bool(_NEGATIVE.search(before)) - 0.3 * bool(_PHONE_NEAR.search(before[-20:]))
                yield m.start(), m.end(), "id_number", score


_PLUS = re.compile(r"(?:\(?\+\s?|\()$")


def phones(form: str, runs: list[tuple[int, int]]) -> Iterator[tuple[int, int, str, float]]:
    last = 0
    for a, _ in runs:
        if a < last:
            continue
        m = (plus := _PLUS.search(form, max(0, a - 3), a)) and PHONE.match(form, plus.start()) or PHONE.match(form, a)
        if not m:
            continue
        last = m.end()
        value, score, end = m[0], 0.1, m.end()
        for pattern, s in _PHONE_SHAPES:
            got = pattern.match(value)
            if got and s > score and not value[got.end() : got.end() + 1].isdigit() and got[0][-1].isdigit():
                score, end = s, m.start() + got.end()
        value = form[m.start() : end]
        if not 7 <= sum(ch.isdigit() for ch in value) <= 15:
            continue
        before, after = _near(form, m.start(), end)
        score += 0.35 * bool(_PHONE_NEAR.search(before[-30:]) or _LINE_AFTER.match(after))
        score -= 0.6 * bool(_NEGATIVE.search(before) or _NEGATIVE_AFTER.match(after))
        score -= 0.6 * bool((word := _ID_NEAR.search(before[-24:])) and not _PHONE_NEAR.search(before[-24:], word.end()))
        if re.fullmatch(r"\d{4}-\d\d-\d\d(?:\s\d.*)?|\d{1,2}[./]\d{1,2}[./]\d{2,4}", value):
            score = 0
        yield m.start(), end, "phone", min(score, 0.89)


def addresses(form: str, runs: list[tuple[int, int]], heads: list[int], ends: list[int]) -> Iterator[tuple[int, int, str, float]]:
    """Streets with a house number: number first at the runs of digits, number last at the words of the street."""
    for a, b in runs:
        if b - a <= 5:
            if m := _NUMBER_STREET.match(form, a):
                flat = _FLAT.search(form, max(0, a - 24), a)
                yield flat.start() if flat else a, m.end(), "address", 0.8
            if m := _NUMBER_RUE.match(form, a):
                yield a, m.end(), "address", 0.8
    for a in heads:
        if m := _CALLE_NUMBER.match(form, a):
            yield a, m.end(), "address", 0.8
    for b in ends:
        a = b
        while a and (form[a - 1].isalnum() or form[a - 1] in "_-"):
            a -= 1
        while a < b and not (form[a].isalpha() and not (a and (form[a - 1].isalnum() or form[a - 1] == "_"))):
            a += 1
        if m := _STRASSE_NUMBER.match(form, a):
            am = _AM.search(form, max(0, a - 9), a)
            yield am.start() if am else a, m.end(), "address", 0.75
    if "号" in form or "弄" in form:
        for m in _LU_NUMBER.finditer(form):
            yield m.start(), m.end(), "address", 0.8


def _edge(form: str, at: int, step: int, words: int) -> int:
    """The place some words before or behind another place; each Chinese character is one word."""
    inside = False
    while 0 <= at < len(form):
        ch = form[at]
        if ch.isspace() or "\u4e00" <= ch <= "\u9fff":
            words -= inside or not ch.isspace()
            inside = False
            if words <= 0:
                break
        else:
            inside = True
        at += step
    return max(0, min(at, len(form)))


def surroundings(form: str, places: Iterable[int]) -> list[tuple[int, int]]:
    """The stretches of text around places, three words before and six behind, joined where they touch."""
    out: list[tuple[int, int]] = []
    for p in sorted(places):
        if out and p < out[-1][1]:
            lo = out[-1][0]
            hi = max(out[-1][1], _edge(form, p, 1, 6))
            out[-1] = (lo, hi)
            continue
        lo, hi = _edge(form, p - 1, -1, 3), _edge(form, p, 1, 6)
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], hi)
        else:
            out.append((lo, hi))
    return out


def people(form: str, names: Names, lo: int, hi: int, intros: dict[int, int], after: set[int]) -> Iterator[tuple[int, int, str, float]]:
    """Names after an introduction, and pairs of a given name or initial with a family name of the lexicon. ``intros`` are the
    places right behind a phrase, ``after`` those with some punctuation between."""
    tokens = [(m.start(), m.end(), m[0]) for m in _TOKENS.finditer(form, lo, hi)]
    low = [t.rstrip(".").lower() for _, _, t in tokens]

    def between(i: int) -> str:
        return form[tokens[i][1] : tokens[i + 1][0]]

    def joined(i: int) -> bool:
        return i + 1 < len(tokens) and between(i) in (" ", ", ", "\n", "")

    def initial(i: int) -> bool:
        return len(low[i]) == 1 and form[tokens[i][1] - 1 : tokens[i][1] + 1].find(".") >= 0

    def house(i: int) -> bool:
        return 0 <= i < len(low) and low[i] in NOT_A_PERSON

    given, family = names.given, names.family
    done = -1
    for i, (a, (start, _, word)) in enumerate(zip(low, tokens, strict=True)):
        kind = intros.get(start, 0)
        if i <= done or not (kind or a in given or a in family or len(a) == 1) or not joined(i):
            continue
        b = low[i + 1]
        upper = _capital(word) and _capital(tokens[i + 1][2])
        first = a in given or initial(i)
        if len(a) == 1 and not _capital(word) and len(b) < 5:
            continue
        sure = good = first and b in family or a in family and (b in given or initial(i + 1)) or a in given and b in given and upper
        plain = b not in names.common and not house(i) and not house(i + 1)
        if not good and first and len(b) > 2 and plain and between(i) in (" ", "\n", ""):
            good = (upper or len(b) > 5 and not _capital(word) and not _capital(tokens[i + 1][2])) and (bool(kind) or start in after)
        if not good and kind & (NAME_IS | SELF | MENTION | TITLE) and upper and plain and a not in names.common and min(len(a), len(b)) > 1 and between(i) == " " and (form[tokens[i + 1][1] : tokens[i + 1][1] + 1] + " ")[0] not in "@/_" and not house(i + 2):
            # two capitalised words right behind the phrase, and in running text only
            good = not (word.isupper() and len(word) > 1 and form[max(0, start - 12) : start].isupper())
        if good:
            end = i + 1
            if joined(end) and low[end + 1] in family and between(end) == " ":
                end += 1
            score = (0.8 if sure else 0.7) - 0.5 * bool(house(i - 1) and between(i - 1) in (" ", "-") or house(end + 1) and between(end) == " ")
            yield start, tokens[end][1], "name", score
            done = end


def spans(text: str, names: Names) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, score) of the accepted spans in the original text, in order and without overlap."""
    form = visual(text)
    rest = URL.sub(lambda m: " " * len(m[0]), form) if "://" in form or "www." in form else form
    hits = list(names.hits(_plain(rest)))
    ats, heads, streets, ends, places = [], [], [], [], []
    after: set[int] = set()
    spoken = 0
    for end, (what, size, lead, trail) in hits:
        a, b = end - size + lead, end - trail
        if what & (NAME_IS | SELF | MENTION | TITLE) and (p := place_after(rest, b)) is not None:
            after.add(p)
        if what & AT:
            ats.append((a, b))
        if what & NAME:
            places.append(a)
        if what & ID_HEAD:
            heads.append(a)
        if what & STREET:
            streets.append(a)
        if what & STREET_END:
            ends.append(b)
        spoken += what & DIGIT > 0
    intros = introductions(rest, hits)
    after.update(p for p in (place_after(rest, m.end()) for m in re.finditer("[—–]", rest)) if p is not None)
    mails = [s for s in emails(rest, ats) if s[3] >= THRESHOLD]
    found = list(mails)
    if mails:
        parts, at = [], 0
        for a, b, _, _ in sorted(mails):
            parts += (rest[at:a], "\x00" * (b - max(a, at)))
            at = max(at, b)
        rest = "".join(parts) + rest[at:]
    runs = [m.span() for m in _DIGITS.finditer(rest)]
    if runs:
        found += id_numbers(rest, runs, heads)
        found += phones(rest, runs)
        found += addresses(rest, runs, streets, ends)
    if spoken > 6 or _CHINESE_DIGITS.search(rest):
        found += [(m.start(), m.end(), "phone", 0.85) for m in PHONE_WORDS.finditer(rest)]
    for lo, hi in surroundings(rest, {*places, *intros}):
        found += people(rest, names, lo, hi, intros, after)
    for p, kind in intros.items():
        if kind & NAME_IS and (m := _CHINESE_NAME.match(rest, p)):
            found.append((p, m.end(), "name", 0.7))
    taken: list[tuple[int, int, str, float]] = []
    for span in sorted((s for s in found if s[3] >= THRESHOLD), key=lambda s: (-s[3], s[0] - s[1], s[0])):
        k = bisect_left(taken, span)
        if (k == 0 or taken[k - 1][1] <= span[0]) and (k == len(taken) or taken[k][0] >= span[1]):
            taken.insert(k, span)
    if taken and form is not text and form != text:
        where = aligned(text)[1]
        taken = [(where[a][0], where[b - 1][1], kind, score) for a, b, kind, score in taken]
    return sorted(taken)


def redacted(text: str, found: list[tuple[int, int, str, float]]) -> str:
    out, at = [], 0
    for a, b, kind, _ in found:
        out += (text[at:a], f"[{kind.upper()}]")
        at = b
    return "".join(out) + text[at:]


def _with_own_names(df: DataFrame, text: str, keep: list[str], lexicon: DataFrame) -> DataFrame:
    """keep, __text and __names: the rows with the words of the lexicon that occur in each, for a lexicon of any size."""
    ship(df.sparkSession)
    rows = written(df.select(*keep, F.col(text).cast("string").alias("__text")).withColumn("__row", F.monotonically_increasing_id()), "texts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, words = [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = {w.rstrip(".").lower() for w in _TOKENS.findall(visual(t))}
                ids += [i] * len(own)
                words += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words, pa.string())], ["__row", "word"])

    pairs = rows.where("__text is not null").select("__row", "__text").mapInArrow(run, "__row bigint, word string")
    own = pairs.join(lexicon, "word").groupBy("__row").agg(F.collect_list(F.struct("word", "given", "family", "common")).alias("__names"))
    return rows.join(own, "__row", "left").select(*keep, "__text", F.to_json("__names").alias("__names"))


def _map_spans(df: DataFrame, text: str, keep: list[str], names: Names | DataFrame | None, columns: dict[str, T.DataType], result) -> DataFrame:
    """``result`` of a text and the function that gives its spans, row by row."""
    names = learn_names(df, text) if names is None else names
    if isinstance(names, Names):
        held = df.sparkSession.sparkContext.broadcast(names)

        def make():
            lexicon = held.value
            return lambda t: result(t, lambda: spans(t, lexicon))

        return map_text(df, text, columns, make, keep)
    rows = _with_own_names(df, text, keep, names)

    def make_own():
        import json
        from types import SimpleNamespace

        def one(both: str):
            t, own = json.loads(both)
            return result(t, lambda: spans(t, _own(SimpleNamespace(**r) for r in json.loads(own or "[]"))))

        return one

    both = F.to_json(F.array("__text", "__names"))
    return map_text(rows.withColumn("__both", both), "__both", columns, make_own, keep)


_START: list[Names] = []


def _own(rows: Iterable) -> Names:
    """The names of one text: only the automaton of the keywords and its own words are searched."""
    rows = list(rows)
    own = Names({r.word for r in rows if r.given}, {r.word for r in rows if r.family}, {r.word for r in rows if r.common})
    if not _START:
        _START.append(Names())
    keys = {f" {w.translate(_PLAIN)} " for w in own.given | own.family}
    own.hits = lambda plain: [*_START[0].hits(plain), *((i + len(k) - 1, (NAME, len(k), True, True)) for k in keys for i in _found(plain, k))]
    return own


def _found(plain: str, key: str) -> Iterator[int]:
    at = plain.find(key)
    while at >= 0:
        yield at
        at = plain.find(key, at + 1)


def redact(df: DataFrame, text: str, keep: list[str], names: Names | DataFrame | None = None) -> DataFrame:
    """``keep``, redacted (text) and kinds (array, sorted) for every row; null texts stay null with no kinds."""

    def result(t: str | None, found_in):
        if t is None:
            return None, []
        found = found_in()
        return redacted(t, found), sorted({s[2] for s in found})

    return _map_spans(df, text, keep, names, {"redacted": T.StringType(), "kinds": T.ArrayType(T.StringType())}, result)


def kinds_found(df: DataFrame, text: str, key: str, names: Names | DataFrame | None = None) -> DataFrame:
    """(key, kind): one row for each kind in a row's text."""

    def result(t: str | None, found_in):
        kinds = sorted({s[2] for s in found_in()}) if t else None
        return (kinds,) if kinds else None

    return _map_spans(df, text, [key], names, {"kinds": T.ArrayType(T.StringType())}, result).select(key, F.explode("kinds").alias("kind"))
