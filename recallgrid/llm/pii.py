"""Personal data with offset-preserving deobfuscation.

Base kinds are plain patterns. The method adds what a disguise hides from them: a text goes through
transducers (homoglyphs and full-width forms to ASCII, spelled digits to digits, spelled "at" and
"dot" to signs), each of which carries the source place of every character it writes. Identifiers
found in the normalised text are mapped back to source code points.

Defined results: null and empty texts have no spans; repeated rows give repeated result rows; of equal added
spans one stays; a text of any length is scanned whole, in time in proportion to its length (patterns start
only where a run of their characters starts); an empty table gives no rows; other columns are ignored, whatever
their names. An added span that overlaps a base span is dropped, so base spans stay as they are.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession

from recallgrid.llm.common import documents
from recallgrid.llm.spans import Span, apart, digest, joined, scan

# The base patterns (an address is LOCAL_CHARS, @ and a domain).
EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone")

# Look-alikes of ASCII letters and signs (Greek and Cyrillic), besides the full-width block.
HOMOGLYPHS = dict(zip("аеорсухіјѕԁһкмтвнАВЕКМНОРСТХІЈЅαοιντρυΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhkmtbhABEKMHOPCTXIJSaoivtpuABEZHIKMNOPTYX"))
HOMOGLYPHS |= {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)} | {"․": ".", "。": ".", "﹒": ".", "﹫": "@", "‐": "-", "‑": "-", "–": "-", "−": "-", " ": " ", " ": " "}
HOMOGLYPHS |= {c: str(i) for base in (0x0660, 0x06F0, 0x0966) for i, c in ((i, chr(base + i)) for i in range(10))}
ZERO_WIDTH = "​‌‍⁠﻿­"
# Spelled digits in the four languages of the corpus.
DIGITS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
DOT_WORD = r"(?:dot|punkt|punto|point)"
DOMAIN = r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*"
AT = re.compile(rf"(?<!\x20)[\x20]*[\[({{<][\x20]*(?:at|arroba|chez)[\x20]*[\])}}>][\x20]*|(?<!\x20)[\x20]+(?:at|arroba)[\x20]+(?={DOMAIN}[\x20]*(?:[\[({{<][\x20]*(?:{DOT_WORD}|\.)|[\x20]{DOT_WORD}[\x20]))", re.IGNORECASE)
DOT = re.compile(rf"(?<!\x20)[\x20]*[\[({{<][\x20]*(?:{DOT_WORD}|\.)[\x20]*[\])}}>][\x20]*|(?<!\x20)[\x20]+{DOT_WORD}[\x20]+(?=[A-Za-z0-9-])", re.IGNORECASE)
SIGNED = re.compile(rf"[\[({{<][\x20]*(?:at|arroba|chez|@)[\x20]*[\])}}>]|[\x20](?:at|arroba)[\x20]+{DOMAIN}[\x20]*(?:[\[({{<\x20]+{DOT_WORD}|[\[({{<][\x20]*\.)", re.IGNORECASE)
SPELLED = re.compile(r"(?<!\w)(?:" + "|".join(sorted(DIGITS, key=len, reverse=True)) + r")(?:[\x20-]+(?:" + "|".join(sorted(DIGITS, key=len, reverse=True)) + r"|[0-9])(?!\w)){5,}", re.IGNORECASE)
SPELLED_DIGIT = re.compile("|".join(sorted(DIGITS, key=len, reverse=True)), re.IGNORECASE)
SPELLED_PART = re.compile(SPELLED_DIGIT.pattern + r"|[\x20-]+", re.IGNORECASE)
WORD = "(?:" + "|".join(sorted(DIGITS, key=len, reverse=True)) + r")(?!\w)"
OCTET = rf"(?:{WORD}(?:[\x20-]+(?:{WORD}|[0-9](?!\w))){{0,2}}|[0-9]{{1,3}}(?!\w))"
SPELLED_IP = re.compile(rf"(?<!\w){OCTET}(?:(?:{DOT.pattern}|\.){OCTET}){{3}}", re.IGNORECASE)
SIGN = re.compile(r"(?<!\x20)[\x20]*[\[({<][\x20]*@[\x20]*[\])}>][\x20]*")
PLAIN_DOT = re.compile(r"\.(?=\w)")
ODD = re.compile("[" + "".join(map(re.escape, [*HOMOGLYPHS, *ZERO_WIDTH])) + "]")


ODD_CHARS = frozenset([*HOMOGLYPHS, *ZERO_WIDTH])
UNITS = frozenset([*DIGITS, *"0123456789"])
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN_CHARS = LOCAL_CHARS - frozenset("_%+")
SPELLED_WORDS = tuple(DIGITS)


def spelled_digits(text: str) -> bool:
    """Whether SPELLED can match: the units between the first and the last of a run stand alone."""
    words = text.lower().replace("-", " ").split()
    return b"\1\1\1\1" in bytes(map(UNITS.__contains__, words)) and bool(SPELLED.search(text))


def signed(text: str) -> bool:
    """Whether AT or SIGN can match: every text is searched."""
    return bool(SIGNED.search(text))


def dots(text: str) -> list[re.Match]:
    """The dot disguises of a text."""
    return list(DOT.finditer(text))


def spelled_ip(text: str, found: list[re.Match]) -> bool:
    """Whether SPELLED_IP can match beyond plain digits: one of its dots stands next to a spelled digit."""
    def beside(m: re.Match) -> bool:
        s, e = m.span()
        return text[max(0, s - 6) : s].lower().endswith(SPELLED_WORDS) or text[e : e + 6].lower().startswith(SPELLED_WORDS)

    return (any(map(beside, found)) or "." in text and any(map(beside, PLAIN_DOT.finditer(text)))) and bool(SPELLED_IP.search(text))


def plain_ip(m: re.Match) -> str | None:
    """A match of SPELLED_IP in digits and dots, if it holds a spelled digit."""
    s = DOT.sub(".", m[0])
    return re.sub(r"[\x20-]", "", SPELLED_DIGIT.sub(lambda x: DIGITS[x[0].lower()], s)) if SPELLED_DIGIT.search(s) else None


def joining_dots(text: str, found: list[re.Match]) -> set[int]:
    """Starts of the dot disguises that join parts of a number or of an address around an @."""
    out = {m.start() for m in found if text[max(0, m.start() - 1) : m.start()].isdigit() and text[m.end() : m.end() + 1].isdigit()} if found else set()
    begins, ends = {m.start(): m.end() for m in found}, {m.end(): m.start() for m in found}
    for m in re.finditer("@", text) if found else ():
        at = m.start()
        while at > 0 and (text[at - 1] in LOCAL_CHARS or at in ends and text[ends[at] - 1 : ends[at]] in LOCAL_CHARS):
            if text[at - 1] not in LOCAL_CHARS:
                out.add(at := ends[at])
            else:
                at -= 1
        at = m.end()
        while at < len(text) and (text[at] in DOMAIN_CHARS or at in begins):
            if at in begins:
                out.add(at)
            at = begins.get(at, at + 1)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses: at each @, the run of local characters before it and the domain after it."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        s = at
        while s > end and text[s - 1] in LOCAL_CHARS:
            s -= 1
        if s < at and (m := EMAIL_DOMAIN.match(text, at + 1)):
            out.append((s, end := m.end()))
        at = text.find("@", max(at + 1, end))
    return out


def plain_spans(text: str) -> list[Span]:
    """Base matches, by kind as listed, then start."""
    out: list[Span] = []
    if "@" in text:
        out += [("email", s, e) for s, e in emails(text)]
    if "." in text:
        out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-3:] if len(p) > 3 else p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := re.sub(r"[\x20-]", "", m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


class Tape:
    """A text and, for each of its characters, the source span that made it."""

    def __init__(self, text: str) -> None:
        self.text, self.start, self.end = text, list(range(len(text))), list(range(1, len(text) + 1))

    def replace(self, pattern: re.Pattern, write) -> Tape:
        """Every match becomes write(match), or stays where that is None; its characters all stand for the whole match's source."""
        out, start, end, at = [], [], [], 0
        for m in pattern.finditer(self.text):
            if (new := write(m)) is None:
                continue
            out += [self.text[at : m.start()], new]
            start += self.start[at : m.start()] + [self.start[m.start()]] * len(new)
            end += self.end[at : m.start()] + [self.end[m.end() - 1]] * len(new)
            at = m.end()
        if at:
            self.text, self.start, self.end = "".join([*out, self.text[at:]]), start + self.start[at:], end + self.end[at:]
        return self


def hidden_spans(text: str, base: list[Span]) -> list[Span]:
    odd = not text.isascii() and not ODD_CHARS.isdisjoint(text)
    found = dots(text)
    if not (odd or spelled_digits(text) or signed(text) or joining_dots(text, found) or spelled_ip(text, found)):
        return []
    tape = Tape(text)
    if odd:
        tape.replace(ODD, lambda m: HOMOGLYPHS.get(m[0], ""))
    # each spelled run is rewritten digit by digit, so that places stay exact; text outside the runs stays
    if runs := [m.span() for m in SPELLED.finditer(tape.text)]:
        begins = [a for a, _ in runs]

        def unit(m: re.Match) -> str | None:
            k = bisect.bisect_right(begins, m.start()) - 1
            if k < 0 or m.end() > runs[k][1]:
                return None
            return DIGITS.get(m[0].lower(), "")

        tape.replace(SPELLED_PART, unit)
    if spelled_ip(tape.text, dots(tape.text)):
        tape.replace(SPELLED_IP, plain_ip)
    if SIGNED.search(tape.text):
        tape.replace(AT, lambda m: "@")
        tape.replace(SIGN, lambda m: "@")
        if "@" in tape.text:
            tape.replace(DOT, lambda m: ".")
    if joins := joining_dots(tape.text, dots(tape.text)):
        tape.replace(DOT, lambda m: "." if m.start() in joins else None)
    found = [(k, tape.start[s], tape.end[e - 1]) for k, s, e in plain_spans(tape.text)]
    return apart(dict.fromkeys(found), base)


def find_pii(text: str) -> tuple:
    base = plain_spans(text)
    hidden = hidden_spans(text, base)
    n = Counter(k for k, _, _ in base)
    every = sorted(base + hidden, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))
    return n["email"], n["ip"], n["card"], n["phone"], digest(base), joined(every), len(hidden)


def pii_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_hidden for each row of docs (doc_id, text)."""
    return scan(docs, find_pii, "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_hidden long")


def op10_pii_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_scan(documents(spark, sf_dir))
