"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Null text counts as empty and has no spans. Offsets are code points, end exclusive. Repeated rows are scored one by one.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from binframe.llm._util import map_text, table

#: Order of kinds in every listing; the first four are the base kinds, which a low score never removes.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "phone_local", "secret")
BASE = KINDS[:4]
THRESHOLD = 0.5
#: Code points on each side in which context words count.
CONTEXT = 48

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
# Starts only where a digit run starts and takes runs whole, so no text costs more than linear time.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_LOCAL = re.compile(r"(?<![0-9+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])")

#: Words without which no text is searched for secrets, long runs, and fixed beginnings of well-known keys.
_HINT = re.compile(r"(?i)token|secret|key|passw|pwd|auth|ghp_|AKIA")
_RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}+")
_KNOWN = re.compile(r"AKIA[0-9A-Z]{16}\Z|gh[pousr]_[A-Za-z0-9]{36}\Z|sk_live_[A-Za-z0-9]{16,}\Z|xox[bap]-[A-Za-z0-9-]{10,}\Z")
#: Bits to a character that a secret has at least; words and numbers repeat their letters.
_ENTROPY = 3.0

_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.9, "phone": 0.7, "iban": 0.9, "ssn": 0.45, "phone_local": 0.35, "secret": 0.35}
_RAISE, _LOWER = 0.25, 0.3
_NEAR = {
    "email": re.compile(r"(?i)\b(?:e-?mail|contact|write|mailto|correo|courriel)\b"),
    "ip": re.compile(r"(?i)\b(?:ip|address|host|server|login|adresse)\b"),
    "card": re.compile(r"(?i)\b(?:card|visa|credit|debit|karte|carte|tarjeta)\b"),
    "phone": re.compile(r"(?i)\b(?:phone|tel|call|mobile|fax|telefon|tel[eé]fono|t[eé]l[eé]phone)\b"),
    "iban": re.compile(r"(?i)\b(?:iban|bank|account|konto|compte|cuenta)\b"),
    "ssn": re.compile(r"(?i)\b(?:ssn|social|security|taxpayer)\b"),
    "phone_local": re.compile(r"(?i)\b(?:phone|tel|call|mobile|fax|telefon|tel[eé]fono|t[eé]l[eé]phone)\b"),
    "secret": re.compile(r"(?i)(?<![A-Za-z])(?:token|secret|api[ _-]?key|access[ _-]?key|key|password|passwd|pwd|auth|bearer|authorization)(?![A-Za-z])"),
}
_AGAINST = re.compile(r"(?i)\b(?:version|release|isbn|issn|section|invoice|order|part|serial|build)\b")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 7064 check of an IBAN without spaces."""
    if not 15 <= len(iban) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _emails(text: str) -> Iterable[tuple[int, int]]:
    """The matches of the plain pattern, found from each @ outwards: a local part is the run before its @."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and not _NOT_LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        else:
            done = at
        at = text.find("@", max(done, at + 1))


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def _proposed(text: str) -> Iterable[tuple[str, int, int]]:
    if "@" in text:
        for s, e in _emails(text):
            yield "email", s, e
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield "card", m.start(), m.end()
    if "." in text:
        for m in _IP.finditer(text):
            if all(map(_small, m.groups())):
                yield "ip", m.start(), m.end()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                yield "phone", m.start(), m.end()
    for m in _IBAN.finditer(text):
        if mod97(m[0].replace(" ", "")):
            yield "iban", m.start(), m.end()
    if "-" in text:
        for m in _SSN.finditer(text):
            yield "ssn", m.start(), m.end()
    for m in _LOCAL.finditer(text):
        yield "phone_local", m.start(), m.end()
    if _HINT.search(text):
        for m in _RUN.finditer(text):
            if random_looking(m[0]):
                yield "secret", m.start(), m.end()


def random_looking(run: str) -> bool:
    """Whether a run has letters and digits (or is one of the well-known keys) and letters that hardly repeat."""
    if _KNOWN.match(run):
        return True
    if not _DIGIT.search(run) or run.isdigit():
        return False
    n = len(run)
    return -sum(c / n * math.log2(c / n) for c in Counter(run).values()) >= _ENTROPY


_ORDER = {k: i for i, k in enumerate(KINDS)}
_DIGIT = re.compile(r"[0-9]")


def find(text: str | None, threshold: float = THRESHOLD) -> list[Span]:
    """Spans of one text by kind (as in KINDS), then start. Added kinds need ``threshold`` and no overlap with a base span."""
    if not text:
        return []
    if "AKIA" not in text and not _DIGIT.search(text):
        found = [("email", s, e) for s, e in _emails(text)] if "@" in text else []
    else:
        found = list(_proposed(text))
    if not found:
        return []
    base = [(s, e) for k, s, e in found if k in BASE]
    out = []
    numbered = [(s, e) for k, s, e in found if k == "iban"]
    for kind, s, e in found:
        if kind == "secret" and any(s < y and x < e for x, y in numbered):
            continue
        score = 0.9 if kind == "secret" and _KNOWN.match(text[s:e]) else _SCORE[kind]
        around = f"{text[max(0, s - CONTEXT):s]} {text[e:e + CONTEXT]}"
        if _NEAR[kind].search(around):
            score += _RAISE
        if _AGAINST.search(around):
            score -= _LOWER
        score = min(1.0, max(0.0, score))
        if kind in BASE or score >= threshold and not any(s < y and x < e for x, y in base):
            out.append(Span(kind, s, e, round(score, 4)))
    return sorted(out, key=lambda x: (_ORDER[x.kind], x.start))


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())]))


def detect(df: DataFrame, text: str = "text", *, threshold: float = THRESHOLD, output: str = "pii", keep: list[str] | None = None) -> DataFrame:
    """Append ``output``: array of (kind, start, end, score). A column of that name is replaced."""

    def make():
        def fn(texts: pa.Array) -> list[pa.Array]:
            return [pa.array([[x._asdict() for x in find(t, threshold)] for t in texts.to_pylist()], _ARROW)]

        return fn

    return map_text(df, make, [T.StructField(output, SPANS)], text, keep)


_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def mask_text(text: str | None, spans: list[Span]) -> str | None:
    """Replace each span by its kind in brackets; of overlapping spans the earliest, then longest, decides."""
    if not text or not spans:
        return text
    parts, at = [], 0
    for x in sorted(spans, key=lambda x: (x.start, -x.end)):
        if x.start >= at:
            parts += [text[at : x.start], f"[{x.kind.upper()}]"]
        at = max(at, x.end)
    return "".join([*parts, text[at:]])


def mask(df: DataFrame, text: str = "text", *, threshold: float = THRESHOLD) -> DataFrame:
    """Replace personal data in ``text``; all columns and rows stay, null text stays null."""

    def make():
        def fn(texts: pa.Array) -> list[pa.Array]:
            return [pa.array([mask_text(t, find(t, threshold)) for t in texts.to_pylist()], pa.string())]

        return fn

    order = df.columns
    return map_text(df, make, [T.StructField(text, T.StringType())], text).select(*[F.col(f"`{c}`") for c in order])


def _digest(spans: list[Span]) -> tuple:
    base = [x for x in spans if x.kind in BASE]
    join = lambda xs: ",".join(f"{x.kind}:{x.start}:{x.end}" for x in xs)
    return (*(sum(x.kind == k for x in base) for k in BASE), len(spans), hashlib.sha256(join(base).encode()).hexdigest(), join(spans))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts (n_private: of all kinds), digest and list of the spans of every document."""

    def make():
        def fn(texts: pa.Array) -> list[pa.Array]:
            rows = [_digest(find(t)) for t in texts.to_pylist()]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            return [pa.array(c, pa.int64()) for c in cols[:5]] + [pa.array(c, pa.string()) for c in cols[5:]]

        return fn

    fields = [T.StructField(f"n_{k}", T.LongType()) for k in (*BASE, "private")] + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
    return map_text(table(spark, sf_dir, "documents"), make, fields, keep=["doc_id"])
