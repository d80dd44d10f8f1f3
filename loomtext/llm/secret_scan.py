"""Secrets in texts: patterns first, then candidates that are decoded and whose structure confirms what they are."""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import lean

#: Kinds in the order in which spans of the same start are told: three by pattern, the others confirmed by structure.
PATTERNS = ("assign", "access", "hex")
KINDS = (*PATTERNS, "pkcs1", "pkcs8", "sec1", "dsa", "openssh", "jwt")

# The patterns of the three plain kinds. A maximal run of 24 or more is what `[0-9a-f]+` leaves of 24 or more.
_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_LEAST_ASSIGNED = 6

#: Line ends inside an encoded key: real ones with the next line's indent, or escaped as in JSON and source code.
_TURN = r"(?:\r?\n[\x20\t]*|(?:\\r)?\\n)"
_B64 = "[A-Za-z0-9+/_-]"
#: An ASN.1 sequence in base64 begins with M and one of A to I; the other is the magic of an OpenSSH key.
_STARTS = (re.compile(rf"M[A-I]{_B64}{{20}}"), re.compile("b3BlbnNzaC1rZXktdjEA"))
_BEFORE = re.compile(_B64)
_LINES, _LINE = re.compile(rf"{_B64}+(?:{_TURN}{_B64}+)*"), re.compile(_TURN)
_HEX_KEY = re.compile(r"(?<![0-9A-Fa-f])(?:30|6[Ff]70656[Ee]737368)(?:[0-9A-Fa-f]{2}){20,}(?![0-9A-Fa-f])")
_TOKEN = re.compile(r"e(?<![A-Za-z0-9_-]e)[w-z0-9_-][A-Za-z0-9_-]{8,}(\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]+)?")
_MAGIC = b"openssh-key-v1\0"
#: Bytes of a signature by algorithm; RSA's are those of its modulus, 1,024 bits at least.
_SIGNATURES = {"HS256": (32,), "HS384": (48,), "HS512": (64,), "ES256": (64,), "ES256K": (64,), "ES384": (96,), "ES512": (132,), "EdDSA": (64, 114)}
_RSA = {"RS256", "RS384", "RS512", "PS256", "PS384", "PS512"}
#: Object identifiers of password-based encryption: PKCS 5, PKCS 12.
_ENCRYPTED = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
#: Elements of a sequence that are read at most; a key has 10 at most.
_MOST_PARTS = 12

Peek = Callable[[int, int], bytes]


def _b64(code: str, first: int) -> Peek:
    """Reads n bytes from byte `at` on of the base64 text, in either alphabet, that begins at `first`, decoding only those."""

    def peek(at: int, n: int) -> bytes:
        piece = code[first + at // 3 * 4 : first + -(-(at + n) // 3) * 4].replace("-", "+").replace("_", "/")
        if len(piece) % 4 == 1:
            piece = piece[:-1]
        return base64.b64decode(piece + "=" * (-len(piece) % 4))[at % 3 :][:n]

    return peek


def _hexadecimal(code: str) -> Peek:
    return lambda at, n: bytes.fromhex(code[2 * at : 2 * (at + n)])


def _element(peek: Peek, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, begin and end of the contents of the DER element at `at`; None if its length isn't minimal or doesn't nest in what ends at `end`."""
    head = peek(at, 6)
    if len(head) < 2:
        return None
    n, begin = head[1], at + 2
    if n >= 0x80:
        width = n - 0x80
        if not 1 <= width <= 4 or len(head) < 2 + width:
            return None
        n, begin = int.from_bytes(head[2 : 2 + width]), begin + width
        if n < 0x80 or head[2] == 0:
            return None
    return (head[0], begin, begin + n) if begin + n <= end else None


def _elements(peek: Peek, at: int, end: int) -> list[tuple[int, int, int]]:
    """The elements that fill a span exactly, else none."""
    out = []
    while at < end and len(out) < _MOST_PARTS:
        got = _element(peek, at, end)
        if not got:
            return []
        out.append(got)
        at = got[2]
    return out if at == end else []


def _der_key(peek: Peek, size: int) -> tuple[str, int] | None:
    """The kind of the private key that begins at byte 0, and its length in bytes."""
    top = _element(peek, 0, size)
    if not top or top[0] != 0x30:
        return None
    parts, end = _elements(peek, top[1], top[2]), top[2]
    tags = [p[0] for p in parts]
    whole = [p for p in parts if p[0] == 2]
    if any(a == b or (b - a > 1 and peek(a, 1)[0] == 0 and peek(a + 1, 1)[0] < 0x80) for _, a, b in whole):
        return None  # an integer takes the fewest bytes
    version = peek(parts[0][1], 1)[0] if tags[:1] == [2] and parts[0][2] - parts[0][1] == 1 else None
    if version in (0, 1) and tags[:9] == [2] * 9 and (version == 0) == (len(tags) == 9) and tags[9:] in ([], [0x30]):
        n, d, p, q = (parts[k][2] - parts[k][1] for k in (1, 3, 4, 5))
        return ("pkcs1", end) if n >= 64 and 0 <= p + q - n <= 2 and d <= n + 1 else None
    if version == 0 and tags == [2] * 6:
        return ("dsa", end) if parts[1][2] - parts[1][1] >= 64 else None
    if version in (0, 1) and tags[1:3] == [0x30, 4] and parts[2][2] > parts[2][1] and all(t in (0xA0, 0x81, 0xA1) for t in tags[3:]):
        named = _elements(peek, *parts[1][1:])
        return ("pkcs8", end) if named and named[0][0] == 6 else None
    if version == 1 and tags[1:2] == [4] and all(t in (0xA0, 0xA1) for t in tags[2:]) and 16 <= parts[1][2] - parts[1][1] <= 80:
        inner = [_elements(peek, a, b) for _, a, b in parts[2:]]
        return ("sec1", end) if all(len(x) == 1 and x[0][0] == (6 if t == 0xA0 else 3) for x, t in zip(inner, tags[2:])) else None
    if tags == [0x30, 4]:
        named = _elements(peek, *parts[0][1:])
        if named and named[0][0] == 6 and peek(named[0][1], 9).startswith(_ENCRYPTED):
            return "pkcs8", end
    return None


def _openssh_key(peek: Peek, size: int) -> tuple[str, int] | None:
    """The same of an OpenSSH private key: magic, three strings, the number of keys, so many public keys, the private section."""
    if peek(0, len(_MAGIC)) != _MAGIC:
        return None
    at, spans = len(_MAGIC), []

    def number() -> int:
        nonlocal at
        got = peek(at, 4)
        at += 4
        return int.from_bytes(got) if len(got) == 4 else size + 1

    def string() -> bool:
        nonlocal at
        n = number()
        spans.append((at, n))
        at += n
        return at <= size

    if not (string() and string() and string()):
        return None
    keys = number()
    if not 1 <= keys <= _MOST_PARTS or not all(string() for _ in range(keys + 1)):
        return None
    first, n = spans[-1]
    plain = peek(*spans[0]) == b"none" if spans[0][1] <= 64 else False
    check = peek(first, 8)
    if n < 8 or n % 8 or (plain and check[:4] != check[4:]):
        return None  # an unencrypted section begins with the same number twice
    return "openssh", at


def _key(peek: Peek, size: int) -> tuple[str, int] | None:
    return _openssh_key(peek, size) if peek(0, 2) == _MAGIC[:2] else _der_key(peek, size)


def _base64_keys(text: str) -> Iterator[tuple[str, int, int]]:
    for start in _STARTS:
        lines, done = (0, 0, "", [], []), 0
        for m in start.finditer(text):
            at = m.start()
            inside = at > 0 and _BEFORE.match(text[at - 1]) and text[max(0, at - 2) : at] != "\\n"
            if at < done or inside:
                continue
            if at >= lines[1]:  # the lines from here on, read once however many candidates they hold
                whole = _LINES.match(text, at)
                pieces, places, total = _LINE.split(whole[0]), [at], 0
                places += [at + t.end() for t in _LINE.finditer(whole[0])]
                begins = []
                for p in pieces:
                    begins.append(total)
                    total += len(p)
                lines = (at, whole.end(), "".join(pieces), begins, places)
            _, stop, code, begins, places = lines
            k = bisect_right(places, at) - 1
            first = begins[k] + at - places[k]
            got = _key(_b64(code, first), (len(code) - first) * 3 // 4)
            if not got:
                continue
            last = first + -(-got[1] * 4 // 3) - 1  # the code's last character
            if last >= len(code):
                continue
            k = bisect_right(begins, last) - 1
            end = places[k] + last - begins[k] + 1
            if end < stop and not _LINE.match(text, end):
                continue  # what follows belongs to it
            while end < len(text) and text[end] == "=" and (last + 1 - first) % 4:
                end, last = end + 1, last + 1
            done = end
            yield got[0], at, end


def _hex_keys(text: str) -> Iterator[tuple[str, int, int]]:
    for m in _HEX_KEY.finditer(text):
        got = _key(_hexadecimal(m[0]), len(m[0]) // 2)
        if got and got[1] == len(m[0]) // 2:
            yield got[0], m.start(), m.end()


def _object(code: str) -> dict | None:
    try:
        got = json.loads(base64.urlsafe_b64decode(code + "=" * (-len(code) % 4)))
    except (ValueError, binascii.Error, RecursionError):
        return None
    return got if isinstance(got, dict) else None


def _signed(token: str) -> bool:
    """A header that names a signature algorithm, a payload that is an object, and a signature of the algorithm's length."""
    head, body, signature = token.split(".")
    names = _object(head)
    alg = names.get("alg") if names else None
    n = len(signature) * 3 // 4
    fits = n >= 128 if alg in _RSA else isinstance(alg, str) and n in _SIGNATURES.get(alg, ())
    return fits and len(signature) % 4 != 1 and (names.get("b64") is False or _object(body) is not None)


def _tokens(text: str) -> Iterator[tuple[str, int, int]]:
    at = 0
    while m := _TOKEN.search(text, at):
        at = m.start(1) if m[1] else m.end()
        if m[1] and _signed(m[0]):
            at = m.end()
            yield "jwt", m.start(), at


def secrets(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every secret, in code points, by start and then by the order of KINDS."""
    found = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[1]) >= _LEAST_ASSIGNED]
    found += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    found += [*_base64_keys(text), *_hex_keys(text), *_tokens(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


_SECRETS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [[{"kind": k, "start": a, "end": b} for k, a, b in secrets(t or "")] for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _SECRETS)], ["doc_id", "secrets"])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and secrets, an array of (kind, start, end), of every row of docs (doc_id, text).

    Kinds by pattern: `assign` (a named credential and its value), `access` (a cloud access key's id), `hex` (24 or more hex
    digits). Candidates in base64 of either alphabet, over several lines too, or in hex are decoded and told as `pkcs1`, `pkcs8`,
    `sec1`, `dsa` or `openssh` only if they parse as a private key: nested lengths that fill each other exactly, the elements of
    that encoding in order, and an end where the candidate ends. `jwt` is a signed token whose header names an algorithm, whose
    payload is an object and whose signature has that algorithm's length. Only the heads of nested elements are decoded, and
    lines are read once, so that a text takes time and memory in proportion to its length. Spans count code points; spans of
    different kinds may overlap. Whole texts are searched, without a shuffle. A null or empty text has an empty array; null and
    repeated ids stay, a row each; an empty table gives an empty result; other columns play no part.
    """
    return lean(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(_scan, "doc_id long, secrets array<struct<kind:string,start:long,end:long>>")
