"""Secret scan: fixed patterns, and dictionary-primed zstandard novelty.

A candidate is a string of 16 or more code characters that mixes letters and digits and
stands shortly behind a sensitive word, or is joined to one. Its novelty is what it adds to
the compressed size of its surroundings, with the compressor primed by a dictionary of
identifiers: text that the dictionary or the neighbourhood explains costs a few bytes, a
random key costs most of its own length. Copies of the candidate don't count as
surroundings, so a key doesn't explain itself. Candidates that don't compress are reported.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable
from functools import partial

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text
from .spans import base_only, count_of, listed, with_spans

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "novel")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
_SENSITIVE = re.compile(r"pass(?:word|wd|phrase)|secret|token|api[_-]?key|credential|bearer|private[_-]?key|authorization|signature", re.I | re.A)
_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]+={0,2}")
_RUN_CHARACTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")

#: Shortest candidate.
SHORTEST = 16
#: Code points behind a sensitive word in which a candidate begins, and those on each side
#: of a candidate that count as its surroundings.
REACH = 48
AROUND = 256
#: Added compressed bytes for each byte of a candidate from which it is reported.
NOVELTY = 0.68
#: Identifiers that code and configuration use (fixed values).
IDENTIFIERS = (
    "access account address admin api application argument array async auth authorization aws backup base64 bearer bool "
    "boolean bucket buffer build byte cache callback certificate char checksum class client cloud cluster code column "
    "commit config configuration connection const container content context cookie count credential data database date "
    "debug default define delete description digest directory document domain double email enable encoding endpoint "
    "environment error event example export expires false field file filename filter float folder format from function "
    "github global group handler hash header hostname http https identifier image import include index info input insert "
    "instance int integer interface internal issuer item json key label language length level library license list local "
    "localhost location log login main manager map master message metadata method model module name namespace network "
    "node none null number object offset option order output owner package page param parameter parent password path "
    "payload permission pipeline policy port prefix private process production profile project property protocol public "
    "query random read record region release remote replace request resource response result return role root route row "
    "schema scope script secret security select self server service session setting sha256 signature size source staging "
    "start state static status storage stream string struct system table target task template test text thread timeout "
    "timestamp title token true type undefined update upload user username uuid value variable vector version void write"
)


def primed_compressor() -> zstandard.ZstdCompressor:
    primed = zstandard.ZstdCompressionDict(IDENTIFIERS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=3, dict_data=primed, write_content_size=False)


def _without(text: str, own: str, start: int, end: int) -> str:
    """text[start:end] without the parts of it that belong to copies of ``own``."""
    out, at = [], start
    found = text.find(own, max(0, start - len(own) + 1), end + len(own) - 1)
    while found >= 0:
        out.append(text[at:found])
        at = found + len(own)
        found = text.find(own, at, end + len(own) - 1)
    return "\n".join([*out, text[at:end]])


def novelty(c: zstandard.ZstdCompressor, text: str, start: int, end: int, around: int = AROUND) -> float:
    """Compressed bytes that the span adds to its surroundings, for each of its bytes."""
    bare = text[start:end].rstrip("=")
    before, behind = _without(text, bare, max(0, start - around), start), _without(text, bare, end, min(len(text), end + around))
    near = f"{before}\n{behind}\n".encode("utf-8", "surrogatepass")
    own = text[start:end].encode("utf-8", "surrogatepass")
    return (len(c.compress(near + own)) - len(c.compress(near))) / len(own)


def _joined(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """The parts of a run between its sensitive words, without the joining _ and -, and the
    run itself."""
    cuts = [start, *(x for word in _SENSITIVE.finditer(text, start, end) for x in word.span()), end]
    parts = []
    for a, b in zip(cuts[::2], cuts[1::2], strict=True):
        part = text[a:b]
        parts.append((a + len(part) - len(part.lstrip("_-")), b - len(part) + len(part.rstrip("_-"))))
    return [*parts, (start, end)]


def _covered(spans: list[tuple]) -> tuple[list[int], list[int]]:
    """Starts and ends of the union of the spans, in order."""
    starts, ends = [], []
    for _, start, end, *_ in sorted(spans, key=lambda b: b[1:3]):
        if ends and start < ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return starts, ends


def find(text: str, c: zstandard.ZstdCompressor, least: float = NOVELTY, shortest: int = SHORTEST, reach: int = REACH,
         around: int = AROUND) -> list[tuple[str, int, int, float, bool]]:
    """All spans of a text: kind, start, end, score, base.

    Base spans are the leftmost matches of each fixed pattern that pass its length test; a
    match that fails is dropped whole. A ``novel`` span overlaps no base span; its score is
    its novelty. In a run that holds a sensitive word the parts beside the word are taken,
    and the whole run if no part is reported. The time grows with the length of the text,
    whatever runs and words it holds.
    """
    out: list[tuple[str, int, int, float, bool]] = []
    if "=" in text or ":" in text:
        out += [("assign", *m.span(), 1.0, True) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [("access", *m.span(), 1.0, True) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [("hex", *m.span(), 1.0, True) for m in _HEX.finditer(text)]
    (starts, ends), seen, known, held = _covered(out), set(), set(), 0

    def novel(start: int, end: int) -> bool:
        own = text[start:end]
        if (start, end) in seen or end - start < shortest or not (re.search("[0-9]", own) and re.search("[A-Za-z]", own)):
            return False
        near = bisect_right(ends, start)  # the first base span that ends behind the start
        if near < len(starts) and starts[near] < end:
            return False
        seen.add((start, end))
        if (score := novelty(c, text, start, end, around)) < least:
            return False
        out.append(("novel", start, end, round(score, 4), False))
        return True

    for word in _SENSITIVE.finditer(text):
        if word.start() >= held:
            begin = word.start()
            while begin and text[begin - 1] in _RUN_CHARACTERS:
                begin -= 1
            held = _RUN.match(text, begin).end()
            if begin not in known:
                *parts, whole = _joined(text, begin, held)
                if not sum([novel(*p) for p in parts]):
                    novel(*whole)
                known.add(begin)
        # no other run begins within the word's own run
        if held > word.end() + reach:
            continue
        for m in _RUN.finditer(text, max(held, word.end())):
            if m.start() > word.end() + reach:
                break
            if m.start() not in known and not _SENSITIVE.search(m[0]):
                known.add(m.start())
                novel(*m.span())
    return out


def finder(**limits) -> Callable[[str], list[tuple]]:
    c = primed_compressor()
    return lambda text: find(text, c, **limits)


def scan(docs: DataFrame, **limits) -> DataFrame:
    """``docs`` with a column ``secret_spans`` (kind, start, end, score, base).

    Whole texts are scanned, very long ones too, in time that grows with their length; null
    and empty texts have no spans. Rows are independent, so repeated rows get equal spans,
    and an empty table stays empty. ``limits`` are those of :func:`find` (``least``,
    ``shortest``, ``reach``, ``around``).
    """
    return with_spans(docs, "secret_spans", partial(finder, **limits), whole_text())


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans, and all spans."""
    found = scan(docs.select("doc_id", "text"))
    spans = F.col("secret_spans")
    return found.select("doc_id", *[count_of(spans, k).alias(f"n_{k}") for k in BASE_KINDS],
                        F.sha2(listed(base_only(spans), KINDS, False), 256).alias("base_sha256"),
                        listed(spans, KINDS, False).alias("spans"))
