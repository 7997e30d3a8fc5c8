"""Text decoded with the wrong character encoding: find it and restore it (problem 5).

Round trip: a garbled stretch is encoded back under the legacy encoding it was wrongly read with and decoded strictly
as what it was meant to be; nested layers are undone one after the other. A result is accepted when the garbling
cost, a weight for each character by how unlikely it is in running text, drops.

Three kinds of stretch are tried:

* UTF-8 read as a single-byte encoding: a lead character followed by the right number of continuation characters;
* UTF-8 read as the Chinese double-byte encoding;
* Chinese double-byte text read as the Western single-byte encoding.

Undefined bytes of a single-byte encoding stand for the control characters of the same number, as lenient decoders
give them. What can't be restored (replacement characters, stray control characters, cut sequences) is reported and
left as it is.

Defined cases: null and empty texts are sound; a text of any length is handled whole; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from topicloom.llm.texts import map_text

#: Single-byte encodings that UTF-8 is often taken for, with Latin-1 inside the first.
SINGLE = ("cp1252", "cp1250", "cp1251", "mac_roman", "cp437", "cp850")
# Letters and signs beyond ASCII that are usual in English, Spanish, French, German and Portuguese text.
USUAL = set("áéíóúüñçàèìòùâêîôûãõäöëïœæßÁÉÍÓÚÜÑÇÀÈÌÒÙÂÊÎÔÛÃÕÄÖËÏŒÆ’‘“”„«»…–—€¿¡ºª°·£\u00a0")
CLOSING = set("»”’“›")
CJK_PUNCTUATION = set("，。！？、；：（）《》“”‘’")


@lru_cache(maxsize=200_000)
def weight(ch: str) -> float:
    """How unlikely a character is in running text."""
    o = ord(ch)
    if o < 128 or ch in USUAL or ch in CJK_PUNCTUATION:
        return 1.0 if o >= 32 or ch in "\n\r\t" else 5.0
    if ch == "\ufffd":
        return 8.0
    kind = unicodedata.category(ch)
    if kind in ("Cc", "Co", "Cn", "Cs"):
        return 6.0
    if 0x4E00 <= o <= 0x9FFF:
        try:
            return 1.0 if 0xB0 <= ch.encode("gb2312")[0] <= 0xD7 else 2.5
        except UnicodeEncodeError:
            return 3.0
    if o >= 0x1F300:
        return 1.5
    if kind[0] == "L":
        return 2.5
    return 3.0


def cost(text: str) -> float:
    return sum(map(weight, text))


class Single:
    """UTF-8 that was read as one single-byte encoding."""

    def __init__(self, codec: str) -> None:
        self.byte: dict[str, int] = {}
        for b in range(0x80, 0x100):
            try:
                self.byte[bytes([b]).decode(codec)] = b
            except UnicodeDecodeError:
                pass
        for b in range(0x80, 0xA0):
            self.byte.setdefault(chr(b), b)
        if codec == "cp1252":
            for b in range(0x80, 0x100):
                self.byte.setdefault(chr(b), b)

        def of(lo: int, hi: int) -> str:
            return "[" + "".join(re.escape(ch) for ch, b in self.byte.items() if lo <= b <= hi) + "]"

        more = of(0x80, 0xBF)
        self.sequence = f"{of(0xC2, 0xDF)}{more}|{of(0xE0, 0xEF)}{more}{{2}}|{of(0xF0, 0xF4)}{more}{{3}}"
        self.find = re.compile(f"(?:{self.sequence})+")

    def repair(self, text: str) -> str:
        def one(m: re.Match) -> str:
            old = m[0]
            try:
                new = bytes(map(self.byte.__getitem__, old)).decode()
            except UnicodeDecodeError:
                return old
            before, after = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
            if len(old) == 2 and old[0].isupper() and old[1] in CLOSING and before.isupper() and not after.isalpha():
                return old  # the end of a word in capitals and a closing quote
            return new if cost(new) < cost(old) else old

        return self.find.sub(one, text)


class ReadAsDouble:
    """UTF-8 that was read as the Chinese double-byte encoding."""

    wide = re.compile("[^\x00-\x7f]+")
    valid = re.compile(rb"(?:[\xc2-\xdf][\x80-\xbf]|[\xe1-\xef][\x80-\xbf]{2}|\xe0[\xa0-\xbf][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\x40-\x7e])+")

    def repair(self, text: str) -> str:
        def one(m: re.Match) -> str:
            run = m[0]
            try:
                raw = run.encode("gbk")
            except UnicodeEncodeError:
                return "".join(one_plain(p) for p in re.split("([^\u3000-\u9fff\uff00-\uffef\u2010-\u2642\u0391-\u0451\u00a4-\u00f7]+)", run)) if len(run) > 1 else run
            if len(raw) != 2 * len(run):
                return run
            latin = (text[m.start() - 1 : m.start()] + text[m.end() : m.end() + 1]).isascii() and re.search("[A-Za-z]", text[max(0, m.start() - 1) : m.start()] or text[m.end() : m.end() + 1] or "") is not None
            return self._stretch(run, raw, latin)

        def one_plain(part: str) -> str:
            try:
                raw = part.encode("gbk")
            except UnicodeEncodeError:
                return part
            return self._stretch(part, raw, False) if part and len(raw) == 2 * len(part) else part

        return self.wide.sub(one, text)

    def _stretch(self, run: str, raw: bytes, latin: bool) -> str:
        out, at = [], 0
        for m in self.valid.finditer(raw):
            a = -(-m.start() // 2) * 2
            if a < at:
                continue
            piece = raw[a : m.end()]
            b = a + len(piece) // 2 * 2
            piece = raw[a:b]
            if len(piece) < 2:
                continue
            new, rest = None, b
            for cut in range(0, 8, 2):  # the stretch may end inside a character
                try:
                    if len(piece) - cut >= 2:
                        new, rest = piece[: len(piece) - cut].decode(), b - cut
                        break
                except UnicodeDecodeError:
                    continue
            if not new or new.isascii():
                continue
            old = run[a // 2 : rest // 2]
            if cost(new) < cost(old) + 2.0 * (latin and len(run) <= 2 and len(old) == len(run)):
                out += (run[at // 2 : a // 2], new)
                at = rest
        return "".join(out) + run[at // 2 :] if out else run


class DoubleReadAs:
    """Chinese double-byte text that was read as the Western single-byte encoding."""

    def __init__(self) -> None:
        self.byte = Single("cp1252").byte
        chars = "".join(re.escape(ch) for ch, b in self.byte.items() if b >= 0x81 and b != 0xFF)
        self.find = re.compile(f"[{chars}]{{2,}}")

    def repair(self, text: str) -> str:
        if not re.search(r"[^\x00-\x7f“”‘’„…–—«»¿¡]{4}", text):
            return text

        def one(m: re.Match) -> str:
            old = m[0]
            raw = bytes(map(self.byte.__getitem__, old))
            try:
                new = raw.decode("gb2312")
            except UnicodeDecodeError:
                return old
            return new if cost(new) < 0.75 * cost(old) and all(weight(ch) <= 2.5 for ch in new) else old

        found = self.find.sub(one, text)
        longest = max((len(m[0]) for m in self.find.finditer(text)), default=0)
        return found if longest >= 4 else text


_REPAIRS: list = []


def repairs() -> list:
    if not _REPAIRS:
        _REPAIRS.extend([*map(Single, SINGLE), ReadAsDouble(), DoubleReadAs()])
    return _REPAIRS


def _classes() -> tuple[str, str]:
    """All lead and continuation characters of UTF-8 under any of the single-byte encodings, as the insides of classes."""
    tools = [Single(c) for c in SINGLE]
    lead = {ch for t in tools for ch, b in t.byte.items() if 0xC2 <= b <= 0xF4}
    more = {ch for t in tools for ch, b in t.byte.items() if 0x80 <= b <= 0xBF}
    return "".join(map(re.escape, sorted(lead))), "".join(map(re.escape, sorted(more)))


_LEAD, _MORE = _classes()
_WESTERN = "".join(re.escape(ch) for ch in Single("cp1252").byte if ch not in "“”‘’„…–—«»¿¡")
#: Where nothing of this kind occurs, a text is sound: a lead before a continuation, four Western characters beyond ASCII
#: in a row, a character that is never right, or Chinese and Latin letters side by side.
SUSPECT = re.compile(f"[{_LEAD}][{_MORE}]|[{_WESTERN}]{{4}}|[\x80-\x9f�]")
BESIDE = re.compile("[A-Za-z][一-鿿]|[一-鿿][a-z]")
WIDE = re.compile("[^\x00-\x7f]+")


def _unusual() -> frozenset:
    """Characters that Chinese text garbled by a double-byte encoding can't do without: rare ones and other scripts."""
    wide = (chr(c) for c in range(0x3040, 0xA000) if c < 0x3400 or c >= 0x4E00)
    return frozenset(ch for ch in wide if weight(ch) > 1)


UNUSUAL = _unusual()
#: Left by garbling that can't be undone: control and replacement characters and sequences that lost their end.
BROKEN = re.compile("[\x80-\x84\x86-\x9f\ufffd]|â€|Ã[\u0080-\u00bf\u2013-\u20ac\u2122]|(?<![A-ZÀ-Þ])Ã(?=\\s)|ï»¿|ï¿½|Â[\u00a1-\u00bf]|锟斤|鈥|[\u4e00-\u9fff]?[ÃÂ]\x20[\u0080-\u00bf]")


def suspect(text: str) -> bool:
    """Whether a text can be garbled at all, judged by its characters beyond ASCII alone."""
    runs = WIDE.findall(text)
    beyond = " ".join(runs)
    if SUSPECT.search(beyond) or not UNUSUAL.isdisjoint(beyond):
        return True
    return any(len(r) < 3 and "\u4e00" <= r[0] <= "\u9fff" for r in runs) and BESIDE.search(text) is not None


def repair(text: str | None) -> str | None:
    """The text with every garbled stretch restored that can be."""
    if not text or text.isascii() or not suspect(text):
        return text
    while True:  # each layer costs less than the one before, so this ends
        best, least = text, cost_beyond(text)
        for tool in repairs():
            new = tool.repair(text)
            if new != text and (c := cost_beyond(new)) < least:
                best, least = new, c
        if best == text:
            return text
        text = best


def cost_beyond(text: str) -> float:
    """The cost of the characters beyond ASCII; those of ASCII don't change."""
    return sum(weight(ch) for ch in text if ch > "\x7f")


def garbled(text: str | None) -> tuple[bool, str | None]:
    """(whether the text holds anything left by a wrong decoding, the text as restored)."""
    fixed = repair(text)
    return bool(text) and (fixed != text or BROKEN.search(text) is not None), fixed


def find_garbled(df: DataFrame, text: str, keep: list[str], all_rows: bool = False) -> DataFrame:
    """``keep``, restored (text) and complete (whether nothing garbled is left) of the garbled rows.

    With ``all_rows`` every row comes out, with ``was_garbled`` telling them apart.
    """

    def make():
        def one(t: str | None):
            bad, fixed = garbled(t)
            if not bad and not all_rows:
                return None
            complete = fixed is None or BROKEN.search(fixed) is None
            return (fixed, complete, bad) if all_rows else (fixed, complete)

        return one

    columns: dict[str, T.DataType] = {"restored": T.StringType(), "complete": T.BooleanType()}
    return map_text(df, text, columns | ({"was_garbled": T.BooleanType()} if all_rows else {}), make, keep)
