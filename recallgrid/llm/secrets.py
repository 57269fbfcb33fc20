"""Secret scan with multipart credential linking.

Base kinds are plain patterns. The method adds credentials that come in parts: access identifiers,
weak secret candidates and endpoints are laid out as intervals and joined within scopes (paragraphs,
cut at blank lines); a weak candidate is reported only where a complementary part
stands within LINK_CHARS of it in the same scope.

Defined results: null and empty texts have no spans; repeated rows give repeated result rows; a part at the same
distance on both sides links with both; a text of any length is scanned whole; an empty table gives no
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallgrid.llm.common import documents
from recallgrid.llm.spans import Span, apart, digest, joined, scan

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "identifier", "weak", "endpoint")
# Names that make an assigned value an identifier, and words of endpoints.
IDENTIFIER = re.compile(r"\b(?:user(?:name)?|login|account|client_?id|access_?key_?id|tenant)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9_.@-]{3,})", re.IGNORECASE | re.ASCII)
ENDPOINT = re.compile(r"\b(?:https?|ftp|ssh|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s\"'<>]+|\b(?:host(?:name)?|endpoint|server)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9.-]+(?::[0-9]+)?)", re.IGNORECASE | re.ASCII)
WEAK = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{16,}={0,2}(?![A-Za-z0-9+/_=-])", re.ASCII)
HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")

LINK_CHARS, WEAK_BITS = 300, 3.2


def entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def weak_secret(s: str) -> bool:
    """Mixed letters and digits of high entropy."""
    classes = bool(re.search("[a-z]", s)) + bool(re.search("[A-Z]", s)) + bool(re.search("[0-9]", s))
    return classes >= 2 and bool(re.search("[0-9]", s)) and entropy(s) >= WEAK_BITS


def base_spans(text: str) -> list[Span]:
    out: list[Span] = []
    low = text.lower()
    if any(h in low for h in HINTS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def scopes(text: str) -> list[int]:
    """Starts of the scopes."""
    return [0, *(m.end() for m in re.finditer(r"\n[\x20\t]*\n", text))]


def linked_spans(text: str, base: list[Span]) -> list[Span]:
    """Parts of credentials that complete each other: the interval join."""
    weak = [(m.start(), m.end()) for m in WEAK.finditer(text) if weak_secret(m[0])] if re.search("[0-9]", text) else []
    weak = [(s, e) for _, s, e in apart([("weak", s, e) for s, e in weak], base)]
    strong = [(s, e, k) for k, s, e in base if k in ("access",)]
    ids = [(m.start(1), m.end(1), "identifier") for m in IDENTIFIER.finditer(text)] if ":" in text or "=" in text else []
    ends = [(m.start(), m.end(), "endpoint") for m in ENDPOINT.finditer(text)] if ":" in text or "=" in text else []
    # parts of one kind don't overlap: their starts and their ends rise, so a window of each is found by two searches
    kinds = [(x, [p[0] for p in x], [p[1] for p in x]) for x in (strong, ids, ends) if x]
    if not kinds or not (weak or base):
        return []
    starts = scopes(text)
    scope = lambda at: bisect.bisect_right(starts, at)

    def near(s: int, e: int) -> list[tuple[int, int, str]]:
        found = (p for x, begins, stops in kinds for p in x[bisect.bisect_left(stops, s - LINK_CHARS) : bisect.bisect_right(begins, e + LINK_CHARS)])
        return [p for p in found if scope(p[0]) == scope(s) and not (p[0] < e and s < p[1])]

    out: set[Span] = set()
    for s, e in weak:
        if found := near(s, e):
            out.add(("weak", s, e))
            out |= {(k, a, b) for a, b, k in found if k != "access"}
    for kind, s, e in base:
        if kind != "access":
            out |= {(k, a, b) for a, b, k in near(s, e) if k != "access"}
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def find_secrets(text: str) -> tuple:
    base = base_spans(text)
    linked = linked_spans(text, base)
    n = Counter(k for k, _, _ in base)
    every = sorted(base + linked, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))
    return n["assign"], n["access"], n["hex"], digest(base), joined(every), len(linked)


def secret_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked for each row of docs (doc_id, text)."""
    return scan(docs, find_secrets, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long")


def mask(text: str | None) -> str | None:
    """The text with every secret span (base and weak) replaced by [SECRET]."""
    if not text:
        return text
    base = base_spans(text)
    spans = sorted((s, e) for k, s, e in base + linked_spans(text, base) if k in ("assign", "access", "hex", "weak"))
    out, at = [], 0
    for s, e in spans:
        if s >= at:
            out += [text[at:s], "[SECRET]"]
        at = max(at, e)
    return "".join([*out, text[at:]]) if spans else text


def masked(docs: DataFrame) -> DataFrame:
    """docs with secrets masked in text; n_chars follows where it is a column."""
    names = docs.columns

    @F.pandas_udf("string")
    def hide(texts):
        return texts.map(mask, na_action="ignore")

    hide = hide.asNondeterministic()
    out = docs.withColumn("text", hide("text"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*names) if "n_chars" in names else out


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(documents(spark, sf_dir))
