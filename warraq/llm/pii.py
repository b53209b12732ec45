"""Personal information inside free text (problem 1).

Regular expressions propose spans; a span's score starts from its shape and is
moved by validators (dialling plan, Luhn, mod-97) and by context words near
it; spans of at least ``THRESHOLD`` stand.  A number that the text presents as
an identity number stands with or without a key; card and bank account numbers
and keyed national numbers that nothing presents stand by a right checksum and
fall by a wrong one.  Kinds: ``email`` (also written to
hide it), ``phone``, ``id_number``, ``address``, ``person_name``.

Matching looks through diacritics, tatweel and invisible characters; spans and
placeholders refer to the text as it is.  Texts are scanned whole, a row at a
time, so long texts, hot sources and repeats need nothing special.

Defined cases: null and empty texts hold nothing and stay as they are; rows
with a null id are scanned like others; overlapping spans keep the better
score, then the longer, then the earlier; extra columns are ignored
(``find``) or kept (``redact``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.common import spread

THRESHOLD = 0.5
#: Code points around a span in which context words count.
NEAR = 48
KINDS = ("email", "phone", "id_number", "address", "person_name")

_MARKS = re.compile("[\u064b-\u065f\u0670\u0640\u200b-\u200f\u2066-\u2069\ufeff]")
_DIGITS = {ord(c): str(k % 10) for k, c in enumerate("٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹")}


@dataclass(frozen=True)
class Span:
    """Code points ``start:end`` of the text, its kind and score."""

    start: int
    end: int
    kind: str
    score: float


# --- validators -------------------------------------------------------------


def luhn(digits: str) -> bool:
    """Luhn checksum."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97(digits: str) -> bool:
    """ISO 7064 mod 97-10, or a two-digit key 97 - (rest mod 97)."""
    return int(digits) % 97 == 1 or (len(digits) > 2 and (97 - int(digits[:-2]) % 97) % 97 == int(digits[-2:]) % 97)


def iban(number: str) -> bool:
    """Bank account number: country, key and account, mod 97-10 over the account, country and key with letters as numbers."""
    bare = re.sub(r"[^0-9A-Za-z]", "", number).upper()
    if not re.fullmatch(r"[A-Z]{2}\d{2}[0-9A-Z]{11,30}", bare) or sum(map(str.isdigit, bare)) < 10:
        return False
    return int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1


def card(digits: str) -> bool:
    """Payment card: 13 to 19 digits of a known leading range, Luhn."""
    return 13 <= len(digits) <= 19 and digits[0] in "3456" and len(set(digits)) > 1 and luhn(digits)


def keyed(digits: str) -> bool:
    """National number of 15 digits whose last two are the key of the others (97 less the rest), of a plausible sex, month and place."""
    return len(digits) == 15 and digits[0] in "1278" and 1 <= int(digits[3:5]) <= 12 and (97 - int(digits[:13]) % 97) == int(digits[13:])


_PLAN = re.compile(r"(?:(?:\+|00)?213(?:0)?)?(?:[567]\d{8}|[234]\d{7})|0(?:[567]\d{8}|[234]\d{7})")


def dialable(number: str) -> bool:
    """National dialling plan: mobiles 05-07 with nine digits, lines 02-04 with eight, with or without the country code."""
    d = re.sub(r"[^\d+]", "", number)
    bare = d.lstrip("+")
    if not (bare.startswith("0") or bare.startswith("213")):
        return False
    return _PLAN.fullmatch(d) is not None


# --- proposals --------------------------------------------------------------

_AT_SIGN, _AT_WORD = r"[@\uff20]", r"(?:at|arobase?)"
_AT = rf"(?:\s?{_AT_SIGN}\s?|\s?[\[({{<]\s?(?:{_AT_WORD}|@)\s?[\])}}>]\s?|\s(?:at|arobase)\s(?=[\w-]+\s(?:dot|point)\s))"
_DOT = r"(?:\.|\s?[\[({<]\s?(?:dot|point|\.)\s?[\])}>]\s?|\s(?:dot|point)\s)"
_EMAIL = re.compile(rf"(?<![\w.+@-])[A-Za-z0-9][A-Za-z0-9._%+-]*{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)*{_DOT}[A-Za-z]{{2,}}(?![A-Za-z0-9-])", re.I)
# One blank alone before the sign is a mention after a word, not an address.
_MENTION = re.compile(r"\S\s@\S")
# Hints are cheap first looks; they are made of the patterns' own parts, so that all that a pattern takes passes its hint.
_EMAIL_HINT = re.compile(rf"{_AT_SIGN}|\b{_AT_WORD}\b", re.I)

_NUMBER = re.compile(r"(?<![\w+.,/-])(?:\(\s?\+?\s?\d{2,3}\s?\)|\+|[A-Z])?\s?\d(?:[ .\-\u00a0]?\d){7,23}(?![\d/]|[.,-]\d|[^\W\d])")
_IBAN = re.compile(r"(?<![\w/])[A-Za-z]{2}\d{2}(?:[ \u00a0-]?[0-9A-Za-z]{4}){2,7}(?:[ \u00a0-]?[0-9A-Za-z]{1,3})?(?![\w/])")
# A number with a country code other than the national one: the code, then groups of digits.
_ABROAD = re.compile(r"(?<![\w+.,/-])(?:\+|00)(?!\s?213)[1-9]\d{0,2}[ .\-\u00a0]?\(?\d(?:[ .\-()\u00a0]{0,2}\d){6,11}(?![\d/]|[.,-]\d|[^\W\d])")
_MONEY_WORDS = re.compile(r"(?:\bcards?\b|\bvisa\b|master ?card|\bcb\b|carte (?:bancaire|bleue|de cr[eé]dit)|\biban\b|\brib\b|\bccp\b|compte|account|بطاقة|الحساب|حسابي)(?:(?!\d\d)[^\n]){0,24}$", re.I)
_PHONE_WORDS = re.compile(r"(?:\bt[eé]l|phone|whats?app|\bnum|appell?e|joignable|call|3ayt|رقمي|هاتف|اتصل|واتساب|للحجز|نمر)", re.I)
_OTHER_NUMBER = re.compile(r"(?:\bcolis|\br[ée]f|\bsuivi|tracking|command|order|\bprix|price|\bvues?\b|views|طلبية|الطرد|البلاغ|السعر|مشاهد)\W{0,3}(?:\w{1,4}\W{1,3})?$", re.I)
_ID_WORDS = re.compile(
    r"(?:الرقم الوطني|رقم التعريف|الضمان الاجتماعي|جواز|رقم البطاقة|بطاقة التعريف|\bNIN\b|\bNSS\b|ta[3a]rif|\bs[eé]cu\b|s[eé]curit[eé] sociale|social security"
    r"|identification nationale|national id|\bid number|identity (?:card|number)|carte (?:nationale|d.identit[eé])|pass?e?port|paspor|basbor)(?:(?!\d\d)[^\n]){0,24}$",
    re.I,
)

_TOWN_LAT = r"(?:a[iï]n|djebel|tizi|hammam|ksar|sidi|bordj|oued|beni|ouled|bab|bir|el|dar|ben|souk|kef|ras|borj|wad)\s+[^\W\d_]{2,}|[A-ZÀ-Ý][^\W\d_]{2,}"
_TOWN_AR = r"(?:عين|جبل|تيزي|حمام|قصر|سيدي|برج|واد|وادي|بني|أولاد|باب|بئر|دار|سوق|راس)\s+[^\W\d_]+|[^\W\d_]{3,}"
_WAY = r"(?:rue|avenue|av\.?|bd|boulevard|chemin|route|impasse|place|all[ée]e|quai)"
_ROAD = r"(?:street|road|avenue|lane|st\.|rd\.)"
_HOMES = r"(?:sakan|maskan|logts?)"
_OF = r"(?:de\s+la\s+|de\s+l['’]|des\s+|du\s+|de\s+|d['’])?"
_N = r"(?:no?\.?|n°|num[eé]ro|رقم)?\s?\d{1,5}"
_SEP = r"\s*[,،\-–]?\s*"
_ADDRESS = [
    re.compile(p, f)
    for p, f in (
        # number, kind of way, its name, (postcode,) town
        (rf"(?<!\w)(?:lot\s+n?[°o]?\s?)?\d{{1,4}}(?:\s*,)?\s*(?:bis|ter)?\s*(?i:{_WAY})\s+(?i:{_OF})[^\W\d_]+(?:\s+(?i:aux|du|de|des|la|les)?\s*[A-ZÀ-Ý][^\W\d_]+)*{_SEP}(?:\d{{5}}\s+)?(?:(?i:{_TOWN_LAT.split('|[A-Z')[0]})|[A-ZÀ-Ý][^\W\d_]{{2,}})", 0),
        (rf"(?<!\w)(?i:lot\s+n?[°o]?\s?)\d{{1,4}}\s+(?i:{_WAY})\s+(?i:{_OF})[^\W\d_]+(?:\s+(?i:aux|du|de|des|la|les)?\s*[A-ZÀ-Ý][^\W\d_]+)*{_SEP}(?:\d{{5}}\s+)?(?:(?i:{_TOWN_LAT.split('|[A-Z')[0]})|[A-ZÀ-Ý][^\W\d_]{{2,}})", 0),
        (rf"(?i:\bno\.?\s*)?(?<!\w)\d{{1,4}},?\s+(?:[A-Z][^\W\d_]+\s+){{1,3}}(?i:{_ROAD})\s*[,\-–]?\s*(?:[A-ZÀ-Ý][^\W\d_]+)", 0),
        # estates and blocks
        (rf"\bcit[eé]\s+(?:des?\s+)?\d{{1,5}}\s*(?:logts?|logements?)\.?{_SEP}(?:b(?:[aâ]t|t)?(?:iment)?|bloc)\.?\s*n?°?\s*\w{{1,4}}{_SEP}(?:(?:porte|appt?|app)\s*)?n?°?\s*\d{{1,4}}{_SEP}(?:{_TOWN_LAT})", re.I),
        (rf"(?<!\w)(?:7ay|hay)\s+\d{{1,5}}\s+{_HOMES}\s+(?:3imara|imara|bt|bat)\s+\d{{1,4}}\s+(?:bab|n°?|ra9m)\s*\d{{1,4}}{_SEP}(?:{_TOWN_LAT})", re.I),
        (rf"\b(?:building|block)\s+\w{{1,4}}\s*,\s*(?:flat|apt\.?|apartment|door)\s+\d{{1,4}}\s*,\s*(?:{_TOWN_LAT})", re.I),
        (rf"(?<!\w)حي\s+(?:\d{{1,5}}\s+(?:مسكن|مسكنا|سكن)|[^\W\d_]+(?:\s+[^\W\d_]+)?)\s+عمارة\s+\d{{1,4}}\s+(?:رقم|باب|شقة)\s+\d{{1,4}}{_SEP}(?:{_TOWN_AR})", 0),
        (rf"(?<!\w)عمارة\s+\d{{1,4}}\s+(?:باب|رقم|شقة)\s+\d{{1,4}}{_SEP}حي\s+[^\W\d_]+(?:\s+[^\W\d_]+)?{_SEP}(?:{_TOWN_AR})", 0),
        (rf"(?<!\w)(?:نهج|شارع|طريق)\s+[^\W\d_]+(?:\s+[^\W\d_]+){{0,2}}\s+رقم\s+\d{{1,4}}{_SEP}(?:{_TOWN_AR})", 0),
        (rf"(?<!\w)\d{{1,4}}\s+(?:نهج|شارع|طريق)\s+[^\W\d_]+(?:\s+[^\W\d_]+){{0,2}}\s*[،,\-]\s*(?:{_TOWN_AR})", 0),
    )
]
# A way follows a number, a comma, white space, bis or ter, a road white space.
_ADDRESS_HINT = re.compile(rf"(?:[\s\d,]|bis|ter){_WAY}\s|\s{_ROAD}|{_HOMES}|cit[eé]|building|block|شارع|نهج|عمارة|طريق", re.I)

_PARTICLES = frozenset("ould aït ait ben bou bel bent el بن ولد آيت ايت أيت بو بنت بل ابن".split())
_BEFORE = frozenset("السيد السيدة الأستاذ الأستاذة الأخ الأخت تحيات اسمي إسمي أنا ismi ana m3a mme m mr mrs ms m'appelle signé signe à to is monsieur madame".split())
# Frames that present a full name, known given name or not; the weak ones need capitals.
_FRAME = re.compile(
    r"(?<!\w)(?:(?P<strong>السيدة?|اسمي|إسمي|مع تحيات|ismi|je m['’]appelle|my name is|signé)|(?P<weak>merci à|thanks to|salam m3a|ana|mme|monsieur|madame|mr|mrs))[ \u00a0]+(?=[^\W\d_])", re.I
)
_CLOSE = re.compile(r"(?<=[^\W\d_])[ \u00a0]+(?:كان(?:ت)? معنا|يشكركم|تشكركم|howa li 9al|hiya li 9alet|told us|l['’]a dit)(?!\w)", re.I)
_THREE = re.compile(r"([^\W\d_]+)[ \u00a0]+([^\W\d_]+)(?:[ \u00a0]+([^\W\d_]+))?")
_TAIL = re.compile(r"(?:([^\W\d_]+)[ \u00a0]+)?([^\W\d_]+)[ \u00a0]+([^\W\d_]+)$")
_NOT_FAMILY = frozenset("الله كان معنا يشكركم ربي bravo merci salam thanks contact khouya howa hiya told et and w و هو هي يا".split())
_AFTER = re.compile(r"\s*(?:كان(?:ت)? معنا|يشكركم|تشكركم|howa li 9al|hiya li 9alet|told us|l['’]a dit|khouya|khti)", re.I)
_NAME_TOKEN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")


class Finder:
    """Finds spans in texts; ``given_names`` are the known given names."""

    def __init__(self, given_names: list[str]) -> None:
        self.given = {g.lower() for g in given_names if g}
        # The first three letters of a name, as a cheap first look at a word.
        self.heads = {g[:3] for g in self.given}

    def spans(self, text: str | None) -> list[Span]:
        """Spans of a text in order, not overlapping."""
        if not text:
            return []
        plain, where = text, None
        if not text.isascii() and _MARKS.search(text):
            where = [k for k, ch in enumerate(text) if not _MARKS.match(ch)]
            plain = _MARKS.sub("", text)
        found: list[Span] = []
        masked = plain
        if _EMAIL_HINT.search(plain):
            for m in _EMAIL.finditer(plain):
                if not (_MENTION.search(m.group()) and not re.search(r"\s@\s", m.group())):
                    found.append(Span(m.start(), m.end(), "email", 0.9))
            masked = self._mask(plain, found)
        if any(map(str.isdecimal, plain)):
            found += self._numbers(masked)
            if _ADDRESS_HINT.search(masked):
                for pattern in _ADDRESS:
                    found += [Span(m.start(), m.end(), "address", 0.8) for m in pattern.finditer(masked)]
        found += self._names(masked)
        found += self._framed(masked)
        kept: list[Span] = []
        for s in sorted((s for s in found if s.score >= THRESHOLD), key=lambda s: (-s.score, s.start - s.end, s.start)):
            a, z = s.start, s.end
            for k in kept:
                # A small overlap is cut off; more than that gives way to the better span.
                if a < k.end and k.start < z:
                    a, z = (k.end, z) if k.start <= a else (a, k.start)
            if z - a == s.end - s.start or (z - a) * 10 >= (s.end - s.start) * 6:
                kept.append(Span(a, z, s.kind, s.score))
        kept.sort(key=lambda s: s.start)
        if where is not None:
            kept = [Span(where[s.start], where[s.end - 1] + 1, s.kind, s.score) for s in kept]
        return kept

    @staticmethod
    def _mask(text: str, spans: list[Span]) -> str:
        for s in spans:
            text = text[: s.start] + "\x00" * (s.end - s.start) + text[s.end :]
        return text

    @staticmethod
    def _numbers(text: str) -> Iterator[Span]:
        for m in _NUMBER.finditer(text):
            start = m.start() + len(m.group()) - len(m.group().lstrip())
            raw = m.group().strip().translate(_DIGITS)
            digits = re.sub(r"\D", "", raw)
            before = text[max(0, start - NEAR) : start]
            after = text[m.end() : m.end() + NEAR // 2]
            if _OTHER_NUMBER.search(before):
                continue
            presented = _ID_WORDS.search(before) is not None
            if presented:
                # The text says what it is: its key adds to that, a wrong one doesn't take it back.
                shape = 0.35 if len(digits) in (8, 9, 10, 12, 18) else 0.25
                yield Span(start, m.end(), "id_number", shape + 0.45 + 0.1 * (luhn(digits) or mod97(digits)))
            elif dialable(raw):
                near = _PHONE_WORDS.search(before) or _PHONE_WORDS.match(after.lstrip())
                mobile = re.search(r"^(?:(?:\+|00|\()*\s*\+?213\)?|0)\D?0?\D?[567]", raw) is not None
                yield Span(start, m.end(), "phone", 0.3 + 0.2 * mobile + 0.15 * ("213" in raw[:6]) + 0.3 * (near is not None) + 0.2 * (len(digits) == 9))
            else:
                # Nothing presents it: a card or keyed number stands by its checksum alone, and by nothing else.
                told = _MONEY_WORDS.search(before) is not None
                key = (card(digits) and not raw[0].isalpha()) or keyed(digits)
                yield Span(start, m.end(), "id_number", 0.2 + 0.2 * told + 0.4 * key)
        for m in _ABROAD.finditer(text) if "+" in text or "00" in text else ():
            before = text[max(0, m.start() - NEAR) : m.start()]
            if not (_ID_WORDS.search(before) or _OTHER_NUMBER.search(before) or _MONEY_WORDS.search(before)):
                yield Span(m.start(), m.end(), "phone", 0.35 + 0.3 * (_PHONE_WORDS.search(before) is not None) + 0.25 * (m.group()[0] == "+"))
        for m in _IBAN.finditer(text):
            yield Span(m.start(), m.end(), "id_number", 0.2 + 0.2 * (_MONEY_WORDS.search(text[max(0, m.start() - NEAR) : m.start()]) is not None) + 0.5 * iban(m.group()))

    def _names(self, text: str) -> Iterator[Span]:
        tokens = None
        heads, given = self.heads, self.given
        for m in _NAME_TOKEN.finditer(text):
            if m.group()[:3].lower() in heads and m.group().lower() in given:
                if tokens is None:
                    tokens = list(_NAME_TOKEN.finditer(text))
                    at = {t.start(): k for k, t in enumerate(tokens)}
                span = self._full_name(text, tokens, at[m.start()])
                if span:
                    yield span

    @staticmethod
    def _framed(text: str) -> Iterator[Span]:
        for m in _FRAME.finditer(text):
            n = _THREE.match(text, m.end())
            if n is None or n[1].lower() in _NOT_FAMILY or n[2].lower() in _NOT_FAMILY:
                continue
            has_particle = n[3] is not None and (n[2].lower() in _PARTICLES or n[1].lower() in _PARTICLES)
            end = n.end(3) if has_particle else n.end(2)
            capitals = n[1][0].isupper() and n[2][0].isupper()
            closed = _AFTER.match(text, end) is not None
            if m["strong"] or capitals or closed:
                yield Span(n.start(), end, "person_name", 0.6 + 0.2 * closed + 0.1 * has_particle)
        for m in _CLOSE.finditer(text):
            n = _TAIL.search(text, max(0, m.start() - 80), m.start())
            if n is not None and n[3].lower() not in _NOT_FAMILY and n[2].lower() not in _NOT_FAMILY:
                particle = n[1] is not None and (n[2].lower() in _PARTICLES or n[1].lower() in _PARTICLES)
                yield Span(n.start(1) if particle else n.start(2), m.start(), "person_name", 0.6)

    @staticmethod
    def _full_name(text: str, tokens: list[re.Match], k: int) -> Span | None:
        def joined(a: int, b: int) -> bool:
            gap = text[tokens[a].end() : tokens[b].start()]
            return bool(gap) and gap.strip(" \u00a0\t") == ""

        def word(j: int) -> str:
            return tokens[j].group()

        me, n = word(k), len(tokens)
        latin = me.isascii() or "a" <= me[0].lower() <= "\u024f"
        before = word(k - 1).lower() if k and joined(k - 1, k) else ""
        # given name, (particle,) family name
        if k + 1 < n and joined(k, k + 1):
            nxt = word(k + 1)
            if nxt.lower() in _PARTICLES and k + 2 < n and joined(k + 1, k + 2):
                return Span(tokens[k].start(), tokens[k + 2].end(), "person_name", 0.9)
            framed = before in _BEFORE or _AFTER.match(text, tokens[k + 1].end()) is not None
            capital = latin and me[0].isupper() and nxt[0].isupper()
            if nxt.lower() not in _NOT_FAMILY and before not in ("يا", "bravo") and (framed or capital):
                same_script = (nxt[0] < "\u0250") == (me[0] < "\u0250")
                if same_script and not (latin and me[0].isupper() and nxt[0].islower()):
                    return Span(tokens[k].start(), tokens[k + 1].end(), "person_name", 0.5 + 0.2 * framed + 0.2 * capital)
        # (particle,) family name, given name
        if before and before not in _BEFORE and before not in _NOT_FAMILY:
            prev = word(k - 1)
            if k > 1 and joined(k - 2, k - 1) and word(k - 2).lower() in _PARTICLES:
                return Span(tokens[k - 2].start(), tokens[k].end(), "person_name", 0.85)
            if before in _PARTICLES and k > 1 and joined(k - 2, k - 1):
                # A family name that is a given name by its form, after a given name we don't know.
                framed = (k > 2 and word(k - 3).lower() in _BEFORE) or _AFTER.match(text, tokens[k].end()) is not None
                return Span(tokens[k - 2].start(), tokens[k].end(), "person_name", 0.4 + 0.4 * framed)
            if latin and prev[0].isupper() and me[0].isupper() and (prev.isupper() or word(k - 1)[:3].lower() in ("bou", "ben")):
                return Span(tokens[k - 1].start(), tokens[k].end(), "person_name", 0.75)
        return None

    def redact(self, text: str | None) -> str | None:
        """The text with ``[EMAIL]``, ``[PHONE]``, ``[ID_NUMBER]``, ``[ADDRESS]``, ``[PERSON_NAME]`` in place of its spans."""
        if not text:
            return text
        out, at = [], 0
        for s in self.spans(text):
            out += [text[at : s.start], f"[{s.kind.upper()}]"]
            at = s.end
        return "".join(out) + text[at:]


def read_names(names: DataFrame) -> list[str]:
    """The table of known given names: a word list that does not grow with the corpus."""
    return [r[0] for r in names.select("given_name").filter("given_name is not null").distinct().collect()]


def find(df: DataFrame, id_col: str, text_col: str, given_names: list[str]) -> DataFrame:
    """(rec_id, kind, start, end, score), one row a span; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(given_names)
        for b in batches:
            took, rows = [], []
            for k, text in enumerate(b.column(1).to_pylist()):
                for s in finder.spans(text):
                    took.append(k)
                    rows.append(s)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(took, pa.int64())),
                    pa.array([s.kind for s in rows], pa.string()),
                    pa.array([s.start for s in rows], pa.int32()),
                    pa.array([s.end for s in rows], pa.int32()),
                    pa.array([s.score for s in rows], pa.float64()),
                ],
                names=["rec_id", "kind", "start", "end", "score"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    return spread(df.select(id_col, text_col).filter(F.col(text_col).isNotNull())).mapInArrow(run, f"rec_id {kind}, kind string, start int, end int, score double")


def kinds(df: DataFrame, id_col: str, text_col: str, given_names: list[str]) -> DataFrame:
    """(rec_id, kind), one row for each kind a row holds; no shuffle, as a row is scanned in one place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(given_names)
        for b in batches:
            took, found = [], []
            for k, text in enumerate(b.column(1).to_pylist()):
                own = sorted({s.kind for s in finder.spans(text)})
                took += [k] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(took, pa.int64())), pa.array(found, pa.string())], names=["rec_id", "kind"])

    kind = df.schema[id_col].dataType.simpleString()
    return spread(df.select(id_col, text_col).filter(F.col(text_col).isNotNull())).mapInArrow(run, f"rec_id {kind}, kind string")


def redact(text: Column, given_names: list[str]) -> Column:
    """The text with typed placeholders; the rest untouched."""

    @F.pandas_udf("string")
    def redact_udf(s: pd.Series) -> pd.Series:
        return s.map(Finder(given_names).redact)

    return redact_udf(text)
