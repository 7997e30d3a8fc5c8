"""Normalising and composing text as column expressions.

Every function maps null to the empty string. Only what has no built-in expression (compatibility decomposition, emoji
names) runs as an Arrow-batched function; all else stays in generated code.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

URL = r"https?://[^\s]+|www\.[^\s]+"
HANDLE = r"@[\p{L}\p{N}_]+"
HASHTAG = r"#([\p{L}\p{N}_]+)"
CJK = r"\x{4e00}-\x{9fff}"
#: Word pairs that are joined to one token after normalising; a parameter everywhere.
COLLOCATIONS = ("las vegas", "casa playa")

# Western emoticons of eyes, a nose at most, and a mouth; hearts; caret eyes; faces between brackets or without.
EMOTICON = r"[:;=8xX][\-~^oO]?[DPp)(\]\[\\/|3O0*]"
HEARTS = r"<3+"
CARETS = r"\^\^"
KAOMOJI = r"[（(]?[>﹡\*＠#・.。~\-_^・][_\-~\.]?[TtOo0\^><DdpPqQ_\-~][)）]?"
EMOJI = r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}\x{FE0F}\x{200D}]"

# Traditional characters and below them their simplified forms; a parameter of ``simplify``, for a fuller map.
TRADITIONAL = (
    "這邊還說點裡裏個們麼對會來過時長開門間關係員動電視燈風機東買賣讀覺錯錢銀飲館務衛態體驗燒餅雞鴨魚蝦貝葉醬麵鹽豐適牀鋪飯廳後單雙層潔淨氣溫熱親響歡認為難簡準備價評論確實現訂寬"
    "靜雜亂舊裝設計齊專業禮環優購娛樂灑壓穩龍頭壞損異髮漬塵網螞蟻蠅蟲滅騷擾聲夢遊兒戲區嬰議請覽聞發佈處燙遞車場調獨統頻節線絡帶無號強碼錄櫃險費膠壺礦罐乾類紅煙鎖監樓應廣語韓訴總滿薦選"
)
SIMPLIFIED = (
    "这边还说点里里个们么对会来过时长开门间关系员动电视灯风机东买卖读觉错钱银饮馆务卫态体验烧饼鸡鸭鱼虾贝叶酱面盐丰适床铺饭厅后单双层洁净气温热亲响欢认为难简准备价评论确实现订宽"
    "静杂乱旧装设计齐专业礼环优购娱乐洒压稳龙头坏损异发渍尘网蚂蚁蝇虫灭骚扰声梦游儿戏区婴议请览闻发布处烫递车场调独统频节线络带无号强码录柜险费胶壶矿罐干类红烟锁监楼应广语韩诉总满荐选"
)
# Words of emoji names that become Chinese words.
EMOJI_IN_CHINESE = {
    "party popper": "庆祝", "red heart": "爱", "blue heart": "爱", "green heart": "爱", "purple heart": "爱", "sparkling heart": "爱", "smiling face": "开心", "grinning face": "开心",
    "face with tears of joy": "大笑", "loudly crying face": "难过", "thumbs up": "点赞", "clapping hands": "鼓掌", "fire": "火爆", "hundred points": "满分",
}
#: Emoji whose usual name isn't that of the Unicode data.
EMOJI_NAMES = {"❤": "red heart", "👍": "thumbs up", "👎": "thumbs down", "👏": "clapping hands", "💯": "hundred points", "☺": "smiling face"}

# Words that a line break of subtitles cuts in two, as head-rest: joined again where both parts stand side by side.
CUT_WORDS = {
    "en": """
e-xperience e-xperiment e-xcitement e-xpression e-xplanation e-xcellent e-xecutive e-xercise e-xample t-echnology t-emperature t-ravel t-our s-ervice s-ystem
a-utomation a-rtificial c-ustomer c-heck c-ompan i-nformation r-obot r-eception ex-perience ex-periment ex-citement ex-pression ex-planation ex-cellent ex-ecutive
ex-ercise ex-ample te-chnology te-mperature in-formation ar-tificial cus-tomer ser-vice sys-tem ho-spitality ho-tel
""",
    "es": "e-xperiencia te-cnolog i-nformacion e-xcelente",
}
# Rests that are no words, as head-rest: the head comes back where the rest stands alone, with endings in some words.
LOST_HEADS = {
    "en": """
exp-erience exp-erienced exp-eriences exp-eriencing ex-periment ex-periments ex-perimented ex-perimenting ex-citement ex-pression ex-pressions ex-planation ex-planations
ex-cellent exe-cutive exe-cutives ex-ercise ex-ercises ex-ample ex-amples te-chnology te-chnologies te-chnological te-mperature te-mperatures a-utomation a-rtificial
i-nformation r-eception r-eceptionist h-ospitality e-xperience e-xperienced e-xperiences e-xperiment e-xperiments e-xcitement e-xpression e-xpressions e-xplanation e-xplanations e-xcellent
""",
    "es": "e-xperiencia e-xperiencias te-cnologia te-cnologias e-xcelente",
}
# The same for lemmas, in addition.
LOST_HEADS_OF_LEMMAS = {
    "en": """
ex-cited ex-citing ex-pressed ex-pressing ex-plained ex-plaining ex-cellence exe-cuted exe-cuting ex-ercised ex-ercising ex-amined ex-amining ex-amination ex-aminations a-utomated
i-nformed i-nteresting i-nterest i-nteraction i-nteractions h-ospital c-ustom c-ustomer c-ustomers e-xperiencing e-xcited e-xciting e-xpressed e-xpressing e-xplained e-xplaining e-xcellence
e-xecutive e-xecutives e-xercise e-xercises e-xample e-xamples t-echnology t-echnologies t-emperature t-emperatures c-ompanion c-ompanions c-omfortable c-omfort ex-perience ex-periences
ex-perienced ex-periencing in-formation ar-tificial ho-spitality cu-stomer cu-stomers
""",
    "es": "e-xperimento e-xperimentos i-nformacion se-rvicio se-rvicios h-ospitalidad h-abitacion h-abitaciones",
}


def _text(c: Column | str) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def _spaced(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, " {2,}", " "))


def normalize_basic(c: Column | str) -> Column:
    """Lower case; URLs, handles and hashtags go; only a-z, digits, Chinese characters and single spaces stay."""
    s = F.regexp_replace(F.lower(_text(c)), URL, " ")
    s = F.regexp_replace(s, HANDLE, " ")
    s = F.regexp_replace(s, r"#[\p{L}\p{N}_]+", " ")
    return _spaced(F.regexp_replace(s, f"[^a-z0-9{CJK} ]+", " "))


def _plain(text: str) -> str:
    keep = []
    for ch in unicodedata.normalize("NFKD", text):
        kind = unicodedata.category(ch)
        if kind in ("Mn", "Me") or kind in ("Cf", "Cc") and ch not in "\n\t\r":
            continue
        keep.append(ch)
    return "".join(keep)


@F.pandas_udf(T.StringType())
def decomposed(s: pd.Series) -> pd.Series:
    """Compatibility decomposition without marks, format and control characters."""
    return s.map(lambda t: t if t.isascii() and t.isprintable() else _plain(t), na_action="ignore")


def normalize(c: Column | str, collocations: tuple[str, ...] = COLLOCATIONS) -> Column:
    """As ``normalize_basic``, after decomposition, keeping the word of a hashtag; collocations become one token."""
    s = F.regexp_replace(F.lower(decomposed(_text(c))), URL, " ")
    s = F.regexp_replace(s, HANDLE, " ")
    s = F.regexp_replace(s, HASHTAG, " $1 ")
    s = _spaced(F.regexp_replace(F.regexp_replace(s, r"[\r\n\t]+", " "), f"[^a-z0-9{CJK} ]+", " "))
    for words in collocations:
        s = F.regexp_replace(s, r"\b" + words.replace(" ", r"\s+") + r"\b", words.replace(" ", "_"))
    return s


def _accents(text: str, enie: bool) -> str:
    if enie:
        text = unicodedata.normalize("NFC", text).replace("ñ", "\ue000").replace("Ñ", "\ue001")
    text = "".join(ch for ch in unicodedata.normalize("NFKD", text) if unicodedata.category(ch) not in ("Mn", "Me", "Mc"))
    return text.replace("\ue000", "ñ").replace("\ue001", "Ñ") if enie else text


@F.pandas_udf(T.StringType())
def _strip(s: pd.Series) -> pd.Series:
    return s.map(lambda t: t if t.isascii() else _accents(t, False), na_action="ignore")


@F.pandas_udf(T.StringType())
def _strip_but_enie(s: pd.Series) -> pd.Series:
    return s.map(lambda t: t if t.isascii() else _accents(t, True), na_action="ignore")


def strip_accents(c: Column | str, keep_enie: bool = False) -> Column:
    return (_strip_but_enie if keep_enie else _strip)(_text(c))


def simplify(c: Column | str, traditional: str = TRADITIONAL, simplified: str = SIMPLIFIED) -> Column:
    """Traditional to simplified Chinese characters by a map of single characters."""
    return F.translate(_text(c), traditional, simplified)


def without_emoticons(c: Column | str, compat: bool = False) -> Column:
    """Emoji and emoticons become spaces. Emoticons only count where they don't touch letters or digits; ``compat`` takes
    them anywhere, faces too, which cuts letters out of words ("xp" of "experience", "-o" of "check-out")."""
    s = F.regexp_replace(_text(c), EMOJI, " ")
    s = F.regexp_replace(s, EMOTICON if compat else r"(?<![\p{L}\p{N}])" + EMOTICON + r"(?![\p{L}\p{N}])", " ")
    s = F.regexp_replace(F.regexp_replace(s, HEARTS, " "), CARETS, " ")
    return F.regexp_replace(s, KAOMOJI, " ") if compat else s


def _pairs(listed: str) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for word in listed.split():
        head, rest = word.split("-")
        out.setdefault(head, []).append(rest)
    return out


def rejoined(c: Column, language: str) -> Column:
    """Words that subtitles cut in two or whose first letters were lost, put right; lower-case text without accents."""
    for head, rests in _pairs(CUT_WORDS.get(language, "")).items():
        c = F.regexp_replace(c, rf"\b{head}\s+((?:{'|'.join(rests)})\w*)\b", f"{head}$1")
    for head, rests in _pairs(LOST_HEADS.get(language, "")).items():
        c = F.regexp_replace(c, rf"\b({'|'.join(sorted(rests, key=len, reverse=True))})\b", f"{head}$1")
    return c


def lemma_cleaner(language: str):
    """A function that brings a lemma into the form of the cleaned text: letters of the language only, lost heads put back."""
    if language == "zh":
        return lambda w: re.sub("[^\u4e00-\u9fff\u3400-\u4dbf]", "", w)
    lost = {}
    for listed in (LOST_HEADS, LOST_HEADS_OF_LEMMAS):
        for head, rests in _pairs(listed.get(language, "")).items():
            lost |= {rest: head + rest for rest in rests}
    other = re.compile("[^a-zñ]+" if language == "es" else "[^a-z]+")

    def one(word: str) -> str:
        word = word.strip().lower()
        if not word.isascii():
            word = _accents(word, language == "es")
        word = other.sub("", word)
        return lost.get(word, word)

    return one


def clean(c: Column | str, language: str, compat: bool = False, to_simplified: bool = True) -> Column:
    """The academic cleaning of a raw text in ``en``, ``es`` or ``zh``: URLs, handles, hashtags, emoticons and digits go,
    then all but the language's letters; cut words are joined."""
    s = F.regexp_replace(_text(c), URL, " ")
    s = F.regexp_replace(F.regexp_replace(s, HANDLE, " "), r"#[^\s]+", " ")
    s = F.regexp_replace(without_emoticons(s, compat), r"\p{Nd}+", " ")
    if language == "zh":
        s = F.regexp_replace(simplify(s) if to_simplified else s, r"[^\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]+", " ")
    else:
        s = F.regexp_replace(strip_accents(F.lower(s), language == "es"), "[^a-zñ]+" if language == "es" else "[^a-z]+", " ")
    return _spaced(s) if language == "zh" else rejoined(_spaced(s), language)


def emoji_words(c: Column | str, names: dict[str, str] | None = None, words: dict[str, str] | None = None) -> Column:
    """Emoji become their names in words: given ones first, then those of the Unicode data. Names of ``words`` become the words given
    there, wherever they stand; without it those of ``EMOJI_IN_CHINESE``."""
    names = EMOJI_NAMES | (names or {})
    words = EMOJI_IN_CHINESE if words is None else words

    def word(ch: str) -> str:
        return names.get(ch) or unicodedata.name(ch, "").lower().replace("-", " ")

    pattern = re.compile("[\U0001f000-\U0001faff☀-➿]")

    @F.pandas_udf(T.StringType())
    def named(s: pd.Series) -> pd.Series:
        return s.map(lambda t: t if t.isascii() else pattern.sub(lambda m: f" {word(m[0])} ", t.replace("\ufe0f", "")), na_action="ignore")

    out = named(_text(c))
    for name, other in words.items():
        out = F.regexp_replace(out, rf"\b{name}\b", f" {other} ")
    return _spaced(F.regexp_replace(out, r"\s{2,}", " "))


def _western() -> tuple[dict[str, int], re.Pattern]:
    byte = {bytes([b]).decode("cp1252", "ignore") or chr(b): b for b in range(0x80, 0x100)} | {chr(b): b for b in range(0x80, 0xA0)}

    def of(lo: int, hi: int) -> str:
        return "[" + "".join(re.escape(ch) for ch, b in byte.items() if lo <= b <= hi) + "]"

    more = of(0x80, 0xBF)
    return byte, re.compile(f"(?:{of(0xC2, 0xDF)}{more}|{of(0xE0, 0xEF)}{more}{{2}}|{of(0xF0, 0xF4)}{more}{{3}})+")


_BYTE, _GARBLED = _western()
#: What restored text may hold: letters of European languages, general punctuation, Chinese, emoji.
_SOUND = re.compile("[\u00a0-\u017f\u2010-\u2044\u20a0-\u20bf\u2122\u3000-\u303f\u4e00-\u9fff\uff00-\uffef\u2600-\u27bf\ufe0f\U0001f000-\U0001faff]+")


def ungarbled(text: str) -> str:
    """UTF-8 that was read as the Western encoding, undone layer by layer; every layer makes the text shorter."""

    def one(m: re.Match) -> str:
        old = m[0]
        try:
            new = bytes(map(_BYTE.__getitem__, old)).decode()
        except UnicodeDecodeError:
            return old
        closing = len(old) == 2 and old[0].isupper() and old[1] in "”’“»›" and m.string[m.start() - 1 : m.start()].isupper()
        return old if closing or not (_SOUND.fullmatch(new) or _GARBLED.search(new)) else new

    while (new := _GARBLED.sub(one, text)) != text:
        text = new
    return text


@F.pandas_udf(T.StringType())
def _ungarbled(s: pd.Series) -> pd.Series:
    return s.map(ungarbled, na_action="ignore")


def fix_mojibake(c: Column | str) -> Column:
    """Text whose UTF-8 was read as the Western encoding, put right; only texts that may need it leave the JVM."""
    s = _text(c)
    return F.coalesce(_ungarbled(F.when(s.rlike("[\u00c2-\u00f4][\u0080-\u00bf\u0152-\u0192\u02c6\u02dc\u2013-\u203a\u20ac\u2122]"), s)), s)


def compose(title: Column | str, content: Column | str) -> Column:
    """Title and content as one text: content alone if it starts with the title in any case."""
    t, c = F.trim(_text(title)), F.trim(_text(content))
    both = (F.length(t) > 0) & (F.length(c) > 0)
    return F.when(both & ~F.startswith(F.lower(c), F.lower(t)), F.concat(t, F.lit(" "), c)).when(F.length(c) > 0, c).otherwise(t)


def analysis_text(df: DataFrame, text_col: str | None = None, variant: str = "app") -> DataFrame:
    """Add ``analysis_text``: the named column, or title and content by their usual names, or what the variant does
    without them: "" (``app``) or the first column (``basic``). An existing column of that name is replaced."""
    titles = ["Title", "title"] + ([] if variant == "app" else ["TITLE"])
    contents = ["content", "Content", "text", "Text"] + ([] if variant == "app" else ["CONTENT", "TEXT", "Comment", "comment"])
    if text_col in df.columns:
        return df.withColumn("analysis_text", _text(f"`{text_col}`"))
    title = next((c for c in titles if c in df.columns), None)
    content = next((c for c in contents if c in df.columns), None)
    if title is None and content is None:
        first = F.lit("") if variant == "app" or not df.columns else cell_text(df, df.columns[0])
        return df.withColumn("analysis_text", first)
    return df.withColumn("analysis_text", compose(F.col(title) if title else F.lit(""), F.col(content) if content else F.lit("")))


def _ten_digits(c: Column) -> Column:
    """A double in ten significant digits without trailing zeros."""
    s = F.regexp_replace(F.format_string("%.10g", c), r"(\.[0-9]*?)0+(?=e|$)", "$1")
    return F.regexp_replace(s, r"\.(?=e|$)", "")


def cell_text(df: DataFrame, name: str) -> Column:
    """A cell of any type as text: whole doubles as integers, others in up to ten digits, no NaN; nested values as JSON."""
    c, kind = F.col(f"`{name}`"), df.schema[name].dataType
    if isinstance(kind, T.DoubleType | T.FloatType):
        whole = (F.abs(c - F.round(c)) < 1e-9) & (F.abs(c) < 1e15)
        return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), "").when(whole, F.round(c).cast("bigint").cast("string")).otherwise(_ten_digits(c))
    if isinstance(kind, T.ArrayType | T.MapType | T.StructType):
        return F.coalesce(F.to_json(c), F.lit(""))
    if isinstance(kind, T.BinaryType):
        return F.coalesce(F.decode(c, "UTF-8"), F.lit(""))
    return _text(c)


def snippet(c: Column | str, size: int = 260) -> Column:
    """The start of a text with white space collapsed."""
    return F.substring(F.trim(F.regexp_replace(_text(c), r"\s+", " ")), 1, size)


def abbreviate(c: Column | str, size: int = 32) -> Column:
    s = _text(c)
    return F.when(F.length(s) > size, F.concat(F.substring(s, 1, size - 1), F.lit("…"))).otherwise(s)


def signature(config: dict) -> str:
    """A stable hash of a configuration."""
    return hashlib.sha1(json.dumps(config, sort_keys=True, ensure_ascii=False, default=str).encode()).hexdigest()


def short_hash(c: Column | str) -> Column:
    return F.substring(F.md5(_text(c)), 1, 12)


def word_list(text: str | None, pattern: str = r"[\n,，]+") -> list[str]:
    """Words of a user's list."""
    return [w for w in (p.strip() for p in re.split(pattern, text or "")) if w]


def topic_numbers(text: str, least: int = 2, most: int = 60) -> list[int]:
    """The topic numbers to try: digits only, distinct, in order, at least two of them."""
    out = sorted({int(x) for x in re.findall(r"\d+", text or "") if least <= int(x) <= most})
    if len(out) < 2:
        raise ValueError("at least two topic numbers are needed")
    return out
