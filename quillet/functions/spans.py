"""Spans of personal data in one text: patterns, check digits, context words, overlaps. Plain
Python, applied a batch of texts at a time by ``operators/privacy.py``."""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Callable, Iterable
from typing import NamedTuple


class Span(NamedTuple):
    type: str
    start: int
    end: int
    score: float


class Recognizer(NamedTuple):
    """A type's pattern, its score, a check that decides (True: certain, False: none, None: no matter), and words
    that make it likelier if one stands shortly before."""

    type: str
    pattern: re.Pattern
    score: float
    check: Callable[[str], bool | None] | None = None
    context: frozenset[str] = frozenset()


#: Words before a span that are looked at, what one of them adds to the score, and the least score then.
CONTEXT_WORDS, CONTEXT_GAIN, CONTEXT_LEAST = 5, 0.35, 0.4
#: Types that are reported, and the least score.
SENSITIVE = frozenset(
    "EMAIL_ADDRESS PHONE_NUMBER CREDIT_CARD IBAN_CODE IP_ADDRESS PERSON LOCATION MEDICAL_LICENSE US_SSN US_PASSPORT "
    "US_DRIVER_LICENSE US_BANK_NUMBER UK_NHS SG_NRIC_FIN AU_ABN AU_ACN AU_TFN AU_MEDICARE".split()
)
LEAST_SCORE = 0.7


def _digits(text: str) -> list[int]:
    return [int(c) for c in text if c in "0123456789"]


def _weighted(weights: list[int], modulus: int, minus_first: int = 0):
    """Whether the digits' weighted sum is divisible."""

    def check(text: str) -> bool:
        d = _digits(text)
        if len(d) != len(weights):
            return False
        d[0] -= minus_first
        return sum(w * x for w, x in zip(weights, d)) % modulus == 0

    return check


def luhn(text: str) -> bool:
    """Every second digit from the right doubled, digits of the results summed: divisible by 10."""
    d = _digits(text)[::-1]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


def iban(text: str) -> bool:
    """The first four characters moved to the end, letters as two digits: 1 modulo 97."""
    s = re.sub(r"\s", "", text)
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _address(text: str) -> bool | None:
    try:
        ipaddress.ip_address(text)
    except ValueError:
        return False
    return None


def _ssn(text: str) -> bool | None:
    d = re.sub(r"\D", "", text)
    return False if d[:3] in ("000", "666") or d[0] == "9" or d[3:5] == "00" or d[5:] == "0000" else None


def _nhs(text: str) -> bool:
    d = _digits(text)
    return len(d) == 10 and sum((10 - i) * x for i, x in enumerate(d)) % 11 == 0


def _acn(text: str) -> bool:
    d = _digits(text)
    return len(d) == 9 and (10 - sum((8 - i) * x for i, x in enumerate(d[:8])) % 10) % 10 == d[8]


def _medicare(text: str) -> bool:
    d = _digits(text)
    return len(d) == 10 and sum(w * x for w, x in zip((1, 3, 7, 9, 1, 3, 7, 9), d)) % 10 == d[8]


def _dea(text: str) -> bool:
    d = _digits(text)
    return len(d) == 7 and (d[0] + d[2] + d[4] + 2 * (d[1] + d[3] + d[5])) % 10 == d[6]


def _of(type_: str, pattern: str, score: float, check=None, context: str = "") -> Recognizer:
    return Recognizer(type_, re.compile(pattern, re.ASCII), score, check, frozenset(context.split()))


_PHONE = "phone number telephone cell cellphone mobile call"
_AU = "australian business company tax file medicare abn acn tfn"

RECOGNIZERS = [
    _of("EMAIL_ADDRESS", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}\b", 1.0),
    _of("CREDIT_CARD", r"\b[0-9](?:[ -]?[0-9]){12,18}\b", 0.3, luhn, "credit card visa mastercard cc amex discover"),
    _of("IBAN_CODE", r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}\b", 0.5, iban, "iban bank transaction"),
    _of("IP_ADDRESS", r"\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b", 0.6, _address, "ip ipv4 address"),
    _of("IP_ADDRESS", r"(?<![\w:])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![\w:])", 0.6, _address, "ip ipv6 address"),
    _of("PHONE_NUMBER", r"(?<![\w.])\+?[0-9]{0,3}[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![\w])", 0.4, None, _PHONE),
    _of("US_SSN", r"\b[0-9]{3}[- .][0-9]{2}[- .][0-9]{4}\b", 0.5, _ssn, "social security ssn ssns ssid"),
    _of("US_PASSPORT", r"\b(?:[0-9]{9}|[A-Z][0-9]{8})\b", 0.1, None, "us united states passport travel document"),
    _of("US_DRIVER_LICENSE", r"\b[A-Z][0-9]{3,6}(?:[0-9]{1,3}|[A-Z])\b", 0.3, None, "driver license permit lic identification dl dls"),
    _of("US_BANK_NUMBER", r"\b[0-9]{8,17}\b", 0.05, None, "check account acct save debit bank"),
    _of("UK_NHS", r"\b[0-9]{3}[- ]?[0-9]{3}[- ]?[0-9]{4}\b", 0.5, _nhs, "national health service nhs"),
    _of("SG_NRIC_FIN", r"\b[STFGM][0-9]{7}[A-Z]\b", 0.5, None, "fin nric"),
    _of("AU_ABN", r"\b[0-9]{2} ?[0-9]{3} ?[0-9]{3} ?[0-9]{3}\b", 0.1, _weighted([10, 1, 3, 5, 7, 9, 11, 13, 15, 17, 19], 89, 1), _AU),
    _of("AU_ACN", r"\b[0-9]{3} ?[0-9]{3} ?[0-9]{3}\b", 0.1, _acn, _AU),
    _of("AU_TFN", r"\b[0-9]{3} ?[0-9]{3} ?[0-9]{3}\b", 0.1, _weighted([1, 4, 3, 7, 5, 8, 6, 9, 10], 11), _AU),
    _of("AU_MEDICARE", r"\b[2-6][0-9]{3} ?[0-9]{5} ?[0-9]\b", 0.1, _medicare, _AU),
    _of("MEDICAL_LICENSE", r"\b[A-HJ-MPRSTUXa-hj-mprstux][A-Za-z][0-9]{7}\b", 0.4, _dea, "medical certificate dea"),
]

_WORD = re.compile(r"\w+")


def _near(text: str, start: int, words: frozenset[str]) -> bool:
    """Whether one of ``words`` is among the last few before ``start``; twenty characters a word are looked at."""
    before = _WORD.findall(text[max(0, start - 20 * CONTEXT_WORDS) : start].lower())
    return any(w in words for w in before[-CONTEXT_WORDS:])


def candidates(text: str, recognizers: Iterable[Recognizer]) -> list[Span]:
    """All spans with their scores, those that a check refuses left out."""
    out = []
    for r in recognizers:
        for m in r.pattern.finditer(text):
            sure = r.check(m.group()) if r.check else None
            if sure is False:
                continue
            score = 1.0 if sure else r.score
            if score < 1 and r.context and _near(text, m.start(), r.context):
                score = min(1.0, max(score + CONTEXT_GAIN, CONTEXT_LEAST))
            out.append(Span(r.type, m.start(), m.end(), round(score, 4)))
    return out


def resolved(spans: list[Span]) -> list[Span]:
    """Spans that do not overlap, in order: the highest score first, then the longest, then the first, then by
    the type's name. Found by bisection, so that a text with very many spans takes no square."""
    from bisect import bisect

    starts: list[int] = []
    kept: list[Span] = []
    for s in sorted(spans, key=lambda s: (-s.score, s.start - s.end, s.start, s.type)):
        at = bisect(starts, s.start)
        if (at and kept[at - 1].end > s.start) or (at < len(kept) and kept[at].start < s.end):
            continue
        starts.insert(at, s.start)
        kept.insert(at, s)
    return kept


def find(text: str | None, least: float = LEAST_SCORE, types: Iterable[str] = SENSITIVE, more: Iterable[Callable[[str], list[Span]]] = ()) -> list[Span]:
    """The spans of a text, of these types and with this score at least. ``more``: other recognizers, such as models
    that find persons and places, each from a text to its spans."""
    if not text:
        return []
    found = candidates(text, [r for r in RECOGNIZERS if r.type in types])
    for model in more:
        found += [s for s in model(text) if s.type in types]
    return resolved([s for s in found if s.score >= least])


def anonymized(text: str | None, spans: list[Span]) -> str:
    """The text with each span replaced by its type in angle brackets; a null text is empty."""
    out, at = [], 0
    for s in spans:
        out += [(text or "")[at : s.start], f"<{s.type}>"]
        at = s.end
    return "".join(out) + (text or "")[at:]
