"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text
from .spans import base_only, count_of, listed, with_spans

#: Kinds of the base patterns, then those that the method adds.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "short_card", "local_phone", "ssn")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a digit inside a run can't begin a match that the run's first digit doesn't begin
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}(?![0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")

#: Score of a span before its surroundings are seen; added spans need ``REPORT`` in the end.
START = {"email": 0.8, "ip": 0.5, "card": 0.7, "phone": 0.6, "iban": 0.8, "short_card": 0.4, "local_phone": 0.4, "ssn": 0.4}
REPORT = 0.5
#: Code points on each side in which context words count, and what they add or take.
WINDOW = 48
STEP = 0.2
HINTS = {k: re.compile(rf"(?i)\b(?:{v})\b") for k, v in {
    "email": "e-?mail|mail|contact|write|reach|correo|kontakt",
    "ip": "ip|host|server|address|client|login|adresse",
    "card": "card|visa|mastercard|credit|debit|payment|pay|karte|tarjeta|carte",
    "phone": "phone|tel|telephone|call|mobile|cell|fax|telefon|telefono|appel",
    "iban": "iban|account|bank|transfer|konto|cuenta|compte",
    "ssn": "ssn|social|security|tax|tin",
}.items()}
HINTS |= {"short_card": HINTS["card"], "local_phone": HINTS["phone"]}
DOUBT = re.compile(r"(?i)\b(?:version|release|example|isbn|issn|order|serial|sku|part|build)\b")


def luhn(digits: str) -> bool:
    """The weighted digit sum of card numbers is a multiple of ten."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) << (i & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def mod97(code: str) -> bool:
    """The check of bank account numbers: moved and spelled out, the remainder is one."""
    moved = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local part, @ and dotted domain. The local part is the run in
    front of an @, which is sought first: long runs without one cost nothing."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return found


def _score(text: str, kind: str, start: int, end: int) -> float:
    near = text[max(0, start - WINDOW) : start] + " " + text[end : end + WINDOW]
    score = START[kind] + STEP * bool(HINTS[kind].search(near)) - STEP * bool(DOUBT.search(near))
    return round(min(1.0, max(0.0, score)), 3)


def find(text: str) -> list[tuple[str, int, int, float, bool]]:
    """All spans of a text: kind, start, end, score, base.

    Base spans are the leftmost matches of each base pattern that pass its check; a match
    that fails is dropped whole. Added kinds (account numbers by mod-97, cards of 13 to 15
    digits by Luhn, local phone and social security numbers) need a score of ``REPORT`` and
    must not overlap a base span.
    """
    base: list[tuple[str, int, int]] = [("email", *s) for s in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            base.append(("ip", *m.span()))
    more: list[tuple[str, int, int]] = []
    for m in _DIGITS.finditer(text):
        if 13 <= m.end() - m.start() <= 37 and 13 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            (base if len(d) >= 16 else more).append(("card" if len(d) >= 16 else "short_card", *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            base.append(("phone", *m.span()))
    more += [("iban", *m.span()) for m in _IBAN.finditer(text) if mod97(m[0].replace(" ", ""))]
    more += [("local_phone", *m.span()) for m in _LOCAL_PHONE.finditer(text)]
    more += [("ssn", *m.span()) for m in _SSN.finditer(text)]
    out = [(*s, _score(text, *s), True) for s in base]
    for kind, start, end in more:
        score = _score(text, kind, start, end)
        if score >= REPORT and not any(b[1] < end and start < b[2] for b in base):
            out.append((kind, start, end, score, False))
    return out


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` with a column ``pii_spans`` (kind, start, end, score, base).

    Whole texts are scanned; null and empty texts have no spans. Rows are independent, so
    repeated rows get equal spans, and an empty table stays empty.
    """
    return with_spans(docs, "pii_spans", lambda: find, whole_text())


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans, and all spans."""
    found = scan(docs.select("doc_id", "text"))
    spans = F.col("pii_spans")
    return found.select("doc_id", *[count_of(spans, k).alias(f"n_{k}") for k in BASE_KINDS],
                        F.sha2(listed(base_only(spans), KINDS, True), 256).alias("base_sha256"),
                        listed(spans, KINDS, True).alias("spans"))
