r"""Secret scan with structural confirmation.

Base spans come from fixed patterns (``spans``). Beyond these, runs of base64 or hex are
decoded and reported only if what they hold parses to the last byte: DER key structures by
their nested lengths (PKCS#1, PKCS#8, SEC1), OpenSSH private keys by their length-prefixed
fields, signed tokens by a JSON header with an algorithm and a JSON body, PEM blocks by
what lies between their lines, and encoded text that itself holds one of these or an access
key. A structure may be wrapped into lines of one width, the last one shorter, and line ends
may be escaped (``\n`` and ``\r`` as two characters). Public keys and certificates aren't
secrets and aren't reported.

Kinds added: ``jwt``, ``pem``, ``der``, ``ssh``, ``encoded``. Defined cases: null text is
empty; equal spans of several kinds are all listed; an empty table gives an empty result;
further columns pass through.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_left

from pyspark.sql import DataFrame

from tessera.llm.common import add_columns
from tessera.llm.spans import SECRET, accesses, base_spans

ADDED = ("jwt", "pem", "der", "ssh", "encoded")
KINDS = SECRET + ADDED
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{4,}+\.[A-Za-z0-9_-]*+")
_BEGIN = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40})-----")
_END = re.compile(r"-----END ([A-Z0-9 ]{0,40})-----")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])([A-Za-z0-9+/_-]{22,}+)={0,2}")
_NEXT = re.compile(r"[ \t]*\r?\n[ \t]*([A-Za-z0-9+/_-]++)(={0,2})")
_ESCAPED = re.compile(r"(?:\\+r)?\\+n|\\+r")
#: How the base64 of a key structure's first bytes begins.
_STARTS = ("M", "b3BlbnNzaC1rZXk")
_HEX_RUN = re.compile(r"(?:[0-9a-f]{2})+|(?:[0-9A-F]{2})+")
DEEPEST = 4


def from_base64(text: str) -> bytes | None:
    text = text.replace("-", "+").replace("_", "/").rstrip("=")
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der(data: bytes, at: int = 0, end: int | None = None, depth: int = 0) -> list | None:
    """The values of data[at:end] as (tag, content or nested list); None unless every length
    fits to the last byte."""
    end = len(data) if end is None else end
    out = []
    while at < end:
        if end - at < 2:
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size & 0x80:
            wide = size & 0x7F
            if not 1 <= wide <= 4 or end - at < wide or data[at] == 0:
                return None
            size = int.from_bytes(data[at : at + wide])
            at += wide
            if size < 0x80:
                return None
        if size > end - at:
            return None
        if tag & 0x20:
            inner = der(data, at, at + size, depth + 1) if depth < 12 else None
            if inner is None:
                return None
            out.append((tag, inner))
        else:
            out.append((tag, data[at : at + size]))
        at += size
    return out


def der_key(data: bytes) -> str | None:
    """Which private key structure these bytes are."""
    if len(data) < 24 or data[0] != 0x30:
        return None
    top = der(data)
    if not top or len(top) != 1:
        return None
    parts = top[0][1]
    tags = [t for t, _ in parts]
    if len(tags) >= 9 and set(tags[:9]) == {2} and parts[0][1] in (b"\0", b"\1"):
        return "rsa"
    if len(tags) == 6 and set(tags) == {2} and parts[0][1] == b"\0":
        return "dsa"
    if tags[:3] == [2, 0x30, 4] and parts[0][1] in (b"\0", b"\1") and parts[1][1] and parts[1][1][0][0] == 6:
        return "pkcs8"
    if tags[:2] == [2, 4] and parts[0][1] == b"\1" and len(parts[1][1]) in (20, 24, 28, 32, 48, 64, 66):
        return "ec"
    if tags == [0x30, 4] and parts[0][1] and parts[0][1][0][0] == 6:
        return "encrypted"
    return None


def ssh_key(data: bytes) -> bool:
    """An OpenSSH private key: its magic, then fields whose lengths fit to the last byte."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at = len(magic)

    def field():
        nonlocal at
        size = int.from_bytes(data[at : at + 4]) if len(data) - at >= 4 else len(data)
        if size > len(data) - at - 4:
            raise ValueError
        at += 4 + size
        return data[at - size : at]

    try:
        for _ in range(3):
            field()
        n = int.from_bytes(data[at : at + 4])
        at += 4
        if not 1 <= n <= 64:
            return False
        for _ in range(n + 1):
            field()
    except ValueError:
        return False
    return at == len(data)


def signed_token(text: str) -> bool:
    """header.body.signature, the first two JSON objects in base64, the header with alg."""
    parts = text.split(".")
    values = []
    for part in parts[:2]:
        data = from_base64(part)
        try:
            value = json.loads(data) if data else None
        except (ValueError, RecursionError):
            return False
        if not isinstance(value, dict):
            return False
        values.append(value)
    return isinstance(values[0].get("alg"), str) and (bool(parts[2]) or values[0]["alg"].lower() == "none")


def key_kind(data: bytes) -> str | None:
    return "ssh" if ssh_key(data) else "der" if der_key(data) else None


def pem_blocks(text: str) -> list[tuple[int, int]]:
    """Private keys from a line that begins one to the next that ends one of its label, with
    no other beginning between; every beginning and end is looked at once."""
    ends: dict[str, list[int]] = {}
    for m in _END.finditer(text):
        ends.setdefault(m[1], []).append(m.start())
    begins = list(_BEGIN.finditer(text)) if ends else []
    out, done = [], 0
    for m, next_ in zip(begins, [*(x.start() for x in begins[1:]), len(text)], strict=False):
        own = ends.get(m[1], [])
        k = bisect_left(own, m.end())
        if m.start() < done or k == len(own) or own[k] > next_ or "PRIVATE" not in m[1]:
            continue
        body = text[m.end() : own[k]]
        plain = "\n".join(x.strip(" \t") for x in body.replace("\r", "").split("\n"))
        if "\n\n" in plain.strip("\n"):  # headers come before a blank line
            plain = plain.strip("\n").split("\n\n", 1)[1]
        data = from_base64("".join(plain.split()))
        if data and (key_kind(data) or ("ENCRYPTED" in body and len(data) >= 16)):
            done = own[k] + len(f"-----END {m[1]}-----")
            out.append((m.start(), done))
    return out


def apart(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans in order, those that meet joined."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def meets(spans: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether one of the spans, in order and apart, meets this one."""
    k = bisect_left(spans, (end, 0)) - 1
    return k >= 0 and start < spans[k][1]


def wrapped(text: str, m: re.Match) -> list[tuple[str, int]]:
    """(run, end) of the runs that begin with this one and go on in the next lines, longest
    first. Where the first bytes are those of a sequence, its length says which line is last."""
    head = from_base64(m[1][:8])
    most = 0
    if head and head[0] == 0x30:
        wide = head[1] & 0x7F if head[1] & 0x80 else 0
        size = 2 + wide + (int.from_bytes(head[2 : 2 + wide]) if wide else head[1]) if wide <= 4 else 0
        most = -(-(-(-size * 4 // 3)) // len(m[1]))
    parts, ends, at = [m[1]], [m.end()], m.end()
    while m.end() == m.end(1) and (not most or len(parts) <= most) and (n := _NEXT.match(text, at)) and len(n[1]) <= len(m[1]):
        parts.append(n[1])
        ends.append(at := n.end())
        if len(n[1]) < len(m[1]) or n[2]:
            break
    out = {len(parts), len(parts) - 1} - {0, 1}
    out |= {most} if 1 < most < len(parts) else set()
    return [("".join(parts[:k]), ends[k - 1]) for k in sorted(out, reverse=True)]


def run_kind(run: str, depth: int) -> str | None:
    readings = [binascii.unhexlify(run)] if _HEX_RUN.fullmatch(run) else []
    readings.append(from_base64(run))
    for data in readings:
        if data and (kind := key_kind(data)):
            return kind
        if data and depth < DEEPEST and data.isascii() and len(data) >= 16:
            inner = data.decode()
            if accesses(inner) or confirmed(inner, depth + 1):
                return "encoded"
    return None


def confirmed(text: str, depth: int = 0) -> list[tuple[int, int, str]]:
    """(start, end, kind) of what decodes to a secret's structure."""
    out = confirmed_in(text, depth)
    if "\\" in text:  # once more with escaped line ends as such, each as long as before
        plain = _ESCAPED.sub(lambda m: " " * (len(m[0]) - 1) + "\n", text)
        if plain != text:
            more = confirmed_in(plain, depth)
            known = apart([x[:2] for x in more])
            out = more + [x for x in out if not meets(known, *x[:2])]
    return out


def confirmed_in(text: str, depth: int) -> list[tuple[int, int, str]]:
    out = [(s, e, "pem") for s, e in pem_blocks(text)] if "-----BEGIN " in text else []
    inside = [(s, e) for s, e, _ in out]
    if "." in text:
        out += [(*m.span(), "jwt") for m in _TOKEN.finditer(text) if signed_token(m[0])]
    done = tried = 0  # the ends of what was found, and of the lines tried together
    for m in _RUN.finditer(text):
        if m.start() < done or meets(inside, m.start(), m.start() + 1):
            continue
        longer = wrapped(text, m) if m.start() >= tried or m[1].startswith(_STARTS) else []
        if longer:
            tried = max(tried, longer[0][1])
        for run, end in [*longer, (m[0], m.end())]:
            if kind := run_kind(run, depth):
                out.append((m.start(), end, kind))
                done = end
                break
    return out


def secrets(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then in the order of KINDS."""
    text = text or ""
    found = base_spans(text, SECRET) + confirmed(text)
    return sorted(set(found), key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def scan(docs: DataFrame) -> DataFrame:
    """docs with found: array of (start, end, kind, base), code points, end exclusive."""
    make = lambda texts: [[[{"start": s, "end": e, "kind": k, "base": k in SECRET} for s, e, k in secrets(t.as_py())] for t in texts]]
    return add_columns(docs, make, "found array<struct<start long, end long, kind string, base boolean>>", ["text"])
