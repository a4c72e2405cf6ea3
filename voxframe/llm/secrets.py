"""Secrets by pattern, with structural confirmation of encoded ones.

Three base kinds are found by pattern alone: assignments of long values, access
key ids and hexadecimal runs. Whatever looks like base64, its URL-safe form or
hexadecimal digits, over line wraps too, is decoded first, at every alignment, and
reported only if a structure stands in the bytes:

* ``jwt``: a header that decodes to JSON with ``alg``, a JSON payload and a third
  dotted part, behind whatever letters;
* ``pem``: an armoured private key whose body decodes to a key encoding;
* ``der``: a base64 run in which a private key encoding lies;
* ``hexkey``: a hexadecimal run in which one lies;
* ``wrapped``: an encoded run whose text holds one of these, :data:`DEPTH` layers deep.

A key encoding is a DER sequence whose nested lengths add up exactly and that
opens with a small version number, or the binary private-key format of SSH. It may
start and end anywhere in a run; its span is that of the characters that hold it.
Patterns are linear in the text; NULL and empty texts have no spans.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import arrow_udf

from .common import hand_back

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "jwt", "pem", "der", "hexkey", "wrapped")
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
DOTTED = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]*+){2,}+")
PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ ){0,3})PRIVATE KEY-----")
WRAP = r"(?:[ \t]*(?:\r?\n|\\n)[ \t]*"
# five hyphens are an armour line and no URL-safe letters
URL_LETTER = "(?:[A-Za-z0-9_]|-(?!----))"
# letters of a run, and what to leave out of it
ENCODINGS = {
    "base64": (re.compile(rf"[A-Za-z0-9+/]{{16,}}+{WRAP}[A-Za-z0-9+/]{{2,}}+)*+={{0,2}}"), re.compile(r"\\n|[^A-Za-z0-9+/]")),
    "url": (re.compile(rf"{URL_LETTER}{{16,}}+{WRAP}{URL_LETTER}{{2,}}+)*+={{0,2}}"), re.compile(r"\\n|[^A-Za-z0-9_-]")),
    "hex": (re.compile(rf"[0-9A-Fa-f]{{16,}}+{WRAP}[0-9A-Fa-f]{{2,}}+)*+"), re.compile(r"\\n|[^0-9A-Fa-f]")),
}
LEAST_BASE64, LEAST_HEX, DEPTH = 40, 64, 3
SSH_PRIVATE = b"openssh-key-v1\x00"
# a sequence that opens with version 0 or 1
DER_START = re.compile(rb"\x30(?:[\x00-\x7f]|\x81.|\x82..|\x83...)\x02\x01[\x00\x01]", re.DOTALL)
PRINTED = re.compile(rb"[\t\n\r\x20-\x7e]{40,}+")
SPAN = "struct<kind:string,start:bigint,end:bigint>"


def _der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """Tag and content of the DER items that fill ``data`` exactly."""
    items, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size & 0x80:
            width = size & 0x7F
            if not 1 <= width <= 4 or at + width > len(data):
                return None
            size, at = int.from_bytes(data[at : at + width], "big"), at + width
        if at + size > len(data):
            return None
        items.append((tag, data[at : at + size]))
        at += size
    return items


def _ssh_strings(data: bytes) -> bool:
    """Cipher, key derivation and options, a key count, then that many public keys and the private part."""
    def take(at: int) -> int | None:
        if at + 4 > len(data):
            return None
        end = at + 4 + int.from_bytes(data[at : at + 4], "big")
        return end if end <= len(data) else None

    at = 0
    for _ in range(3):
        if (at := take(at)) is None:
            return False
    if at + 4 > len(data):
        return False
    count, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    if not 1 <= count <= 16:
        return False
    for _ in range(count + 1):
        if (at := take(at)) is None:
            return False
    return at == len(data)


def is_private_key(data: bytes) -> bool:
    if data.startswith(SSH_PRIVATE):
        return _ssh_strings(data[len(SSH_PRIVATE) :])
    outer = _der_items(data) if data[:1] == b"\x30" else None
    if not outer or len(outer) != 1:
        return False
    inner = _der_items(outer[0][1])
    if not inner or len(inner) < 2 or inner[0][0] != 0x02 or inner[0][1] not in (b"\x00", b"\x01"):
        return False
    # numbers of an RSA key, an octet string (EC), or an algorithm and an octet string (PKCS 8)
    tags = [tag for tag, _ in inner[1:]]
    return (len(tags) >= 8 and set(tags[:8]) == {0x02}) or tags[0] == 0x04 or (tags[:2] == [0x30, 0x04] and _der_items(inner[1][1]) is not None)


def is_encrypted_key(data: bytes) -> bool:
    """PKCS 8 encryption: a sequence of an algorithm and an octet string."""
    outer = _der_items(data) if data[:1] == b"\x30" else None
    inner = _der_items(outer[0][1]) if outer and len(outer) == 1 else None
    return bool(inner) and [tag for tag, _ in inner] == [0x30, 0x04] and _der_items(inner[0][1]) is not None


def _decode(run: str, url: bool = False) -> bytes | None:
    body = run.rstrip("=")
    if len(body) % 4 == 1:
        return None
    try:
        return (base64.urlsafe_b64decode if url else base64.b64decode)(body + "=" * (-len(body) % 4))
    except (binascii.Error, ValueError):
        return None


def _sequence_end(data: bytes, at: int) -> int | None:
    """Where the DER item at ``at`` ends, if it does within ``data``."""
    size, low = data[at + 1], at + 2
    if size & 0x80:
        width = size & 0x7F
        size, low = int.from_bytes(data[low : low + width], "big"), low + width
    return low + size if low + size <= len(data) else None


def _ssh_end(data: bytes, at: int) -> int | None:
    """Where a binary SSH key at ``at`` ends: after as many strings as its parts say."""
    low = at + len(SSH_PRIVATE)
    for count in (3, None):
        if count is None:
            if low + 4 > len(data):
                return None
            keys, low = int.from_bytes(data[low : low + 4], "big"), low + 4
            if not 1 <= keys <= 16:
                return None
            count = keys + 1
        for _ in range(count):
            if low + 4 > len(data):
                return None
            low += 4 + int.from_bytes(data[low : low + 4], "big")
            if low > len(data):
                return None
    return low


def key_ranges(data: bytes) -> list[tuple[int, int]]:
    """Byte ranges of private key encodings, one after the other."""
    found, free = [], 0
    starts = [(m.start(), _sequence_end) for m in DER_START.finditer(data)]
    at = data.find(SSH_PRIVATE)
    while at >= 0:
        starts.append((at, _ssh_end))
        at = data.find(SSH_PRIVATE, at + 1)
    for at, end_of in sorted(starts, key=lambda s: s[0]):
        if at >= free and (end := end_of(data, at)) and is_private_key(data[at:end]):
            found.append((at, end))
            free = end
    return found


def _holds_secret(data: bytes, depth: int) -> bool:
    """Does the decoded text hold a confirmed secret itself?"""
    return any(confirmed_spans(m[0].decode("ascii"), depth - 1) for m in PRINTED.finditer(data)) if depth > 1 else False


def _encoded_spans(text: str, encoding: str, depth: int) -> list[tuple[int, int, str]]:
    """Keys in the base64 (``der``) or hexadecimal (``hexkey``) runs of a text."""
    pattern, other = ENCODINGS[encoding]
    kind, least, group = ("hexkey", LEAST_HEX, 2) if encoding == "hex" else ("der", LEAST_BASE64, 4)
    found = []
    for m in pattern.finditer(text):
        run = m[0]
        if m.end() - m.start() < least or (encoding == "url" and "-" not in run and "_" not in run):
            continue  # too short, or plain base64
        if plain := not other.search(run):
            letters = run
        else:
            letters = other.sub("", run)
            if len(letters) < least:
                continue
        own, nested = [], False
        for shift in range(group):
            piece = letters[shift:]
            piece = piece[: len(piece) - (len(piece) % group == 1 if kind == "der" else len(piece) % 2)]
            if kind == "der":
                data = base64.b64decode(piece.replace("-", "+").replace("_", "/") + "=" * (-len(piece) % 4))
                own += [(shift + low * 4 // 3, shift - (-high * 4 // 3)) for low, high in key_ranges(data)]
            else:
                data = bytes.fromhex(piece)
                own += [(shift + 2 * low, shift + 2 * high) for low, high in key_ranges(data)]
            nested = nested or (not own and _holds_secret(data, depth))
        if own:
            places = None if plain else [i for i, c in enumerate(other.sub(lambda x: "\n" * len(x[0]), run)) if c != "\n"]
            free = 0
            for low, high in sorted(own):
                if low < free:
                    continue
                free = high
                start, last = (low, high - 1) if plain else (places[low], places[min(high, len(places)) - 1])
                end = m.start() + last + 1
                # padding belongs to a key that ends its run
                while kind == "der" and end < m.end() and high >= len(letters) and text[end] == "=":
                    end += 1
                found.append((m.start() + start, end, kind))
        elif nested:
            found.append((m.start(), m.end(), "wrapped"))
    return found


def _token_start(head: str) -> int | None:
    """Where in ``head`` the base64url of a JSON object with ``alg`` starts that ends with it; the leftmost such place."""
    best = None
    for shift in range(4):
        piece = head[shift:]
        data = _decode(piece, url=True)
        if not data or not data.rstrip().endswith(b"}"):
            continue
        body = data.decode("latin-1")
        at = body.find("{")
        while at >= 0:
            # the object, with white space before it, must start at a whole character
            low = at
            while low and body[low - 1] in " \t\r\n":
                low -= 1
            starts = [k for k in range(low, at + 1) if k * 4 % 3 == 0]
            if starts:
                try:
                    value, end = json.JSONDecoder().raw_decode(body, at)
                except (ValueError, RecursionError):
                    value, end = None, 0
                if isinstance(value, dict) and isinstance(value.get("alg"), str) and not body[end:].strip():
                    place = shift + starts[0] * 4 // 3
                    best = place if best is None else min(best, place)
                    break
            at = body.find("{", at + 1)
    return best


def _token_spans(text: str) -> list[tuple[int, int, str]]:
    found = []
    for m in DOTTED.finditer(text):
        parts, at, free = m[0].split("."), m.start(), m.start()
        for i in range(len(parts) - 2):
            if len(parts[i]) >= 12 and at >= free and len(parts[i + 1]) >= 2:
                start = _token_start(parts[i])
                if start is not None and _json_object(parts[i + 1]) is not None:
                    free = at + len(parts[i]) + len(parts[i + 1]) + len(parts[i + 2]) + 2
                    found.append((at + start, free, "jwt"))
            at += len(parts[i]) + 1
    return found


def _json_object(part: str) -> dict | None:
    data = _decode(part, url=True)
    try:
        value = json.loads(data) if data else None
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def _pem_end(text: str, begin: re.Match) -> int | None:
    """End of an armoured key whose body is a key encoding."""
    closing = f"-----END {begin[1]}PRIVATE KEY-----"
    end = text.find("-----", begin.end())  # the next armour line must close this one
    if end < 0 or not text.startswith(closing, end):
        return None
    lines = text[begin.end() : end].replace("\\n", "\n").split("\n")
    if any("ENCRYPTED" in line for line in lines if ":" in line):
        return end + len(closing)  # a legacy encrypted body has no structure of its own
    data = _decode("".join("".join(line.split()) for line in lines if ":" not in line))
    return end + len(closing) if data and (is_private_key(data) or is_encrypted_key(data)) else None


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Leftmost non-overlapping matches of each base kind that are long enough."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


def confirmed_spans(text: str, depth: int = DEPTH) -> list[tuple[int, int, str]]:
    """Candidates whose decoded structure holds."""
    armoured = []
    if "-----BEGIN " in text:
        armoured = [(m.start(), end, "pem") for m in PEM.finditer(text) if (end := _pem_end(text, m))]
    inside = [s for encoding in ENCODINGS for s in _encoded_spans(text, encoding, depth)]
    # the body of an armoured key is no second one
    return _token_spans(text) + armoured + [s for s in inside if not any(a <= s[0] and s[1] <= b for a, b, _ in armoured)]


def spans_of(text: str) -> list[tuple[int, int, str]]:
    return sorted(base_spans(text) + confirmed_spans(text), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def find(text: str = "text") -> Column:
    """All spans of a text in code points, by start, then kind."""

    def scan(texts: pa.Array) -> pa.Array:
        return pa.array([[{"kind": k, "start": a, "end": b} for a, b, k in spans_of(t or "")] for t in texts.to_pylist()],
                        pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))

    return arrow_udf(scan, f"array<{SPAN}>")(F.col(text))


def redact_text(text: str, spans: list[dict]) -> str:
    out, at = [], 0
    for span in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if span["start"] < at:
            if span["end"] <= at:
                continue
            at = span["end"]  # overlaps what is gone already
            continue
        out += [text[at : span["start"]], f"<{span['kind'].upper()}>"]
        at = span["end"]
    return "".join([*out, text[at:]])


def redact(text: Column, spans: Column) -> Column:
    """The text with each span, or union of overlapping spans, replaced by its kind."""

    def replace(texts: pa.Array, found: pa.Array) -> pa.Array:
        return pa.array([t if t is None or not s else redact_text(t, s) for t, s in zip(texts.to_pylist(), found.to_pylist())], pa.string())

    return arrow_udf(replace, "string")(text, spans)


def clean(text: str = "text") -> Column:
    """Finds and replaces in one pass."""

    def replace(texts: pa.Array) -> pa.Array:
        out = []
        for scalar in texts:
            body = scalar.as_py()
            found = [{"kind": k, "start": a, "end": b} for a, b, k in spans_of(body or "")]
            out.append(redact_text(body, found) if found else body)
        found = pa.array(out, pa.string())
        del out
        hand_back()
        return found

    return arrow_udf(replace, "string")(F.col(text))


def digest(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
