"""Personal data: patterns propose spans, checksums confirm them, words near by adjust the score.

Base kinds (email, ip, card, phone) follow fixed patterns, leftmost and non-overlapping for each kind; a match that fails
its check is dropped without a retry. The method adds ``iban`` (ISO 7064 mod 97; of a match that fails, shorter ends at its
blanks are tried, then later starts) and ``ssn`` (nine digits in groups, kept
only where a context word supports it). Scans are written so that their time is linear in the text: each pattern starts
only where a run of its characters starts.

Defined results: null text counts as empty; repeated rows each get a row; whole texts are read; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
ODD_IP = re.compile(r"\.[0-9]")
#: words that make a kind more likely, looked for in the 40 characters before a span
CONTEXT = {
    "email": ("mail", "contact", "@", "write"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "payment", "pay"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "transfer"),
    "ssn": ("ssn", "social", "security"),
}
#: score without and with a context word
SCORES = {"email": (0.9, 1.0), "ip": (0.6, 0.9), "card": (0.8, 1.0), "phone": (0.6, 0.9), "iban": (0.9, 1.0), "ssn": (0.2, 0.8)}
THRESHOLD = 0.5
NEAR = 40


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if i % 2 == 0 else x * 2 - 9 * (x > 4)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        end = at + 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = end = m.end()
        at = text.find("@", end)


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of the kind, end), sorted."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if ODD_IP.search(text):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out)


def context_score(text: str, kind: int, start: int) -> float:
    low, high = SCORES[KINDS[kind]]
    near = text[max(0, start - NEAR) : start].lower()
    return high if any(w in near for w in CONTEXT[KINDS[kind]]) else low


def ibans(text: str) -> Iterator[tuple[int, int]]:
    m = IBAN.search(text)
    while m:
        start, end = m.span()
        while end > start and not (IBAN.fullmatch(text, start, end) and mod97(text[start:end])):
            end = text.rfind(" ", start, end)
        if end > start:
            yield start, end
        m = IBAN.search(text, max(end, start + 1))


def added_spans(text: str) -> list[tuple[int, int, int]]:
    out = [(a, 4, b) for a, b in ibans(text)]
    if "-" in text:
        out += [(m.start(), 5, m.end()) for m in SSN.finditer(text) if context_score(text, 5, m.start()) >= THRESHOLD]
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def analyse(text: str | None) -> tuple:
    """Counts of the base kinds, digest of the base spans, all spans, and the highest score."""
    if not text:
        return (0, 0, 0, 0, hashlib.sha256(b"").hexdigest(), "", 0.0)
    base = base_spans(text)
    spans = sorted(base + added_spans(text))
    n = [0] * len(BASE)
    for _, k, _ in base:
        n[k] += 1
    return (*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), max((context_score(text, k, a) for a, k, _ in spans), default=0.0))


NAMES = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "score"]
TYPES = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64()]


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts and spans (code points, end exclusive)."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [analyse(t) for t in b.column(1).to_pylist()]
            cols = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[] for _ in TYPES], TYPES, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["doc_id", *NAMES])

    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, score double")


def redact(text: str | None) -> str | None:
    """The text with every span replaced by its kind in brackets; of overlapping spans the earlier one counts."""
    if not text:
        return text
    out, done = [], 0
    for a, k, b in sorted(base_spans(text) + added_spans(text)):
        if a >= done:
            out += [text[done:a], f"[{KINDS[k].upper()}]"]
            done = b
    return "".join([*out, text[done:]])
