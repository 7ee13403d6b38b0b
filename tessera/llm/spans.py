"""Kinds of spans that patterns fix, found in whole texts.

Each finder gives the leftmost non-overlapping matches of its pattern, and drops those that
fail the kind's condition without trying again inside them. All run in time linear in the
text: candidates are found by a character that every match holds, then widened.
"""

from __future__ import annotations

import hashlib
import re

Span = tuple[int, int]


def _matches(pattern: str, flags: int = 0):
    return re.compile(pattern, flags).finditer


# The kinds of personal data and secrets, in the order that breaks ties.
PERSONAL = ("email", "ip", "card", "phone")
SECRET = ("assign", "access", "hex")

# The patterns. Possessive runs, and starts only where a run of digits starts,
# leave the matches as they are and keep failing starts from being tried again and again.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = _matches(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_DIGIT = re.compile(r"[0-9]")
_CARD = _matches(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = _matches(r"\+[0-9][\x20().0-9-]+[0-9]")
_ASSIGN = _matches(r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*+[:=]\x20*+[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = _matches(r"AKIA[A-Z0-9]+")
# A match is a whole run, and shorter ones are dropped.
_HEX = _matches(r"(?<![0-9a-f])[0-9a-f]{24,}+")
_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")


def emails(text: str) -> list[Span]:
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append((start, m.end()))
            free = m.end()
            at = text.find("@", free)
        else:
            at = text.find("@", at + 1)
    return out


def ips(text: str) -> list[Span]:
    if not _DIGIT.search(text):
        return []
    parts = lambda m: (p.lstrip("0") for p in m[0].split("."))
    return [m.span() for m in _IP(text) if all(len(p) <= 3 and int(p or "0") <= 255 for p in parts(m))]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += (2 * d - 9 if d > 4 else 2 * d) if k % 2 else d
    return total % 10 == 0


def cards(text: str) -> list[Span]:
    out = []
    for m in _CARD(text):
        digits = m[0].replace(" ", "").replace("-", "") if m.end() - m.start() < 60 else ""
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append(m.span())
    return out


def phones(text: str) -> list[Span]:
    if "+" not in text:
        return []
    return [m.span() for m in _PHONE(text) if 10 <= sum(map(m[0].count, "0123456789")) <= 15]


def assigns(text: str) -> list[Span]:
    low = text.lower()
    if not any(w in low for w in _WORDS):
        return []
    return [m.span() for m in _ASSIGN(text) if m.end(1) - m.start(1) >= 6]


def accesses(text: str) -> list[Span]:
    return [m.span() for m in _ACCESS(text) if m.end() - m.start() >= 20] if "AKIA" in text else []


def hexes(text: str) -> list[Span]:
    return [m.span() for m in _HEX(text)]


FINDERS = {"email": emails, "ip": ips, "card": cards, "phone": phones, "assign": assigns, "access": accesses, "hex": hexes}


def base_spans(text: str, kinds: tuple[str, ...]) -> list[tuple[int, int, str]]:
    """(start, end, kind), by start, then in the order of kinds."""
    found = [(s, k, e) for k, kind in enumerate(kinds) for s, e in FINDERS[kind](text)]
    return [(s, e, kinds[k]) for s, k, e in sorted(found)]


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
