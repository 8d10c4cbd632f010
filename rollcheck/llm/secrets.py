"""Secrets in texts, confirmed by their structure.

Three base kinds are plain patterns. Two more are reported only after a candidate is decoded and parsed:
`private_key`, whose base64 or hex decodes to a key encoding with all nested lengths right, and
`signed_token`, whose header names an algorithm that fits its other parts. A candidate may also decode to text
that holds one of these (a PEM file inside base64, say); that is followed WRAPS levels deep.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ids_and_texts, small_batches, texts

#: Kinds in the order in which spans with equal starts are listed; the first three are the base kinds.
KINDS = ("assign", "access", "hex", "private_key", "signed_token")
BASE = KINDS[:3]
#: Least length of an undelimited candidate: an Ed25519 key in PKCS#8, the shortest of all, has 48 bytes.
LEAST_BYTES = 48
#: Levels of encoding inside an encoding that are followed.
WRAPS = 2

ASSIGN = re.compile(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")

FRAME = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----")
#: Runs are met once each: none starts inside another.
RUNS = (
    re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{64,}+={0,2}"),
    re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{64,}+={0,2}"),
    re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{96,}+"),
)
HEX_RUN = re.compile(r"(?:[0-9A-Fa-f]{2})+")
DOTTED = re.compile(r"(?<![A-Za-z0-9_.-])[A-Za-z0-9_-]*+(?:\.[A-Za-z0-9_-]*+){2,}+")

#: DER tags.
INTEGER, BITS, OCTETS, OID, SEQUENCE = 0x02, 0x03, 0x04, 0x06, 0x30
#: Bytes of a signature by algorithm; RS and PS sign with 1024 bits or more.
SIGNATURES = {"HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES256K": 64, "ES384": 96, "ES512": 132, "EDDSA": (64, 114), "NONE": 0}


def _elements(data: bytes, at: int = 0, end: int | None = None) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the DER elements that fill data[at:end] exactly; None if they don't."""
    end = len(data) if end is None else end
    out = []
    while at < end:
        if at + 2 > end or data[at] & 0x1F == 0x1F:
            return None
        tag, n, at = data[at], data[at + 1], at + 2
        if n & 0x80:
            more = n & 0x7F
            if not 1 <= more <= 4 or at + more > end:
                return None
            n = int.from_bytes(data[at : at + more], "big")
            at += more
            if n < 0x80 or n < 1 << 8 * (more - 1):  # not the shortest form
                return None
        if at + n > end:
            return None
        out.append((tag, at, at + n))
        at += n
    return out


def _der_key(data: bytes) -> bool:
    """PKCS#1, DSA, SEC1, PKCS#8 or encrypted PKCS#8, with every length inside its parent's."""
    outer = _elements(data)
    if not outer or len(outer) != 1 or outer[0][0] != SEQUENCE:
        return False
    inner = _elements(data, *outer[0][1:])
    if not inner or len(inner) < 2:
        return False
    tags = [t for t, _, _ in inner]
    if any(t == INTEGER and s == e for t, s, e in inner):
        return False
    if tags[:2] == [SEQUENCE, OCTETS]:  # encrypted: an algorithm with parameters, then the secret bytes
        scheme = _elements(data, *inner[0][1:])
        return len(tags) == 2 and bool(scheme) and len(scheme) == 2 and scheme[0][0] == OID and scheme[1][0] == SEQUENCE and inner[1][2] - inner[1][1] >= 16
    if tags[0] != INTEGER or inner[0][2] - inner[0][1] != 1:
        return False
    version = data[inner[0][1]]
    if set(tags) == {INTEGER}:
        wide = [e - s for _, s, e in inner]
        return version == 0 and (len(tags) == 9 and wide[1] >= 64 or len(tags) == 6 and wide[1] >= 64)
    if tags[1] == OCTETS:
        return version == 1 and inner[1][2] - inner[1][1] >= 16 and set(tags[2:]) <= {0xA0, 0xA1}
    if tags[1:3] == [SEQUENCE, OCTETS] and version in (0, 1) and set(tags[3:]) <= {0xA0, 0xA1, 0x81}:
        scheme, key = _elements(data, *inner[1][1:]), _elements(data, *inner[2][1:])
        return bool(scheme) and scheme[0][0] == OID and bool(key) and len(key) == 1 and key[0][0] in (SEQUENCE, OCTETS, INTEGER)
    return False


def _openssh_key(data: bytes) -> bool:
    """The length-prefixed form: cipher, key derivation, its options, public keys and one private block."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at = len(magic)

    def part() -> bytes | None:
        nonlocal at
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + n > len(data):
            return None
        at += 4 + n
        return data[at - n : at]

    cipher, derivation, options = part(), part(), part()
    if not cipher or not derivation or options is None or at + 4 > len(data):
        return False
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    if not 1 <= keys <= len(data) // 4:
        return False
    if any(not part() for _ in range(keys)):
        return False
    return bool(part()) and at == len(data)


def _unbase64(run: str) -> bytes | None:
    run = run.rstrip("=")
    if len(run) % 4 == 1:
        return None
    try:
        return base64.b64decode(run.replace("-", "+").replace("_", "/") + "=" * (-len(run) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _unhex(run: str) -> bytes | None:
    return bytes.fromhex(run) if HEX_RUN.fullmatch(run) else None


def _header(part: str) -> dict | None:
    raw = _unbase64(part)
    if not raw or raw.lstrip()[:1] != b"{":
        return None
    try:
        found = json.loads(raw)
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) and isinstance(found.get("alg"), str) else None


def _token_parts(parts: list[str]) -> int:
    """How many of the parts are one signed (3) or encrypted (5) token; 0 if none is."""
    head = _header(parts[0])
    if not head:
        return 0
    n = 5 if isinstance(head.get("enc"), str) else 3
    if len(parts) < n:
        return 0
    raw = [_unbase64(p) for p in parts[1:n]]
    if any(r is None for r in raw):
        return 0
    if n == 5:
        return 5 if raw[2] and raw[3] else 0
    alg, size = head["alg"].upper(), len(raw[1])
    want = SIGNATURES.get(alg)
    if alg[:2] in ("RS", "PS"):
        return 3 if raw[0] and size >= 128 else 0
    if isinstance(want, tuple):
        return 3 if raw[0] and size in want else 0
    return 3 if raw[0] and (size == want if want is not None else size > 0) else 0


def _frames(text: str) -> Iterator[tuple[str, int, int]]:
    for m in FRAME.finditer(text):
        stop = text.find("-----", m.end())
        tail = f"-----END {m[1]}-----"
        if stop < 0 or not text.startswith(tail, stop):
            continue
        lines = text[m.end() : stop].replace("\\r", "\n").replace("\\n", "\n").split("\n")
        named = [x for x in lines if ":" in x]
        body = "".join("".join(x.split()) for x in lines if ":" not in x)
        raw = _unbase64(body)
        if raw and (_der_key(raw) or _openssh_key(raw) or (any("DEK-Info" in x for x in named) and len(raw) >= LEAST_BYTES and len(raw) % 8 == 0)):
            yield "private_key", m.start(), stop + len(tail)


def confirmed(text: str, wraps: int = WRAPS) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the private keys and tokens whose structure holds."""
    out = list(_frames(text))
    for m in DOTTED.finditer(text):
        parts, at, k = m[0].split("."), m.start(), 0
        while k < len(parts) - 2:
            n = _token_parts(parts[k : k + 5]) if len(parts[k]) >= 12 else 0
            size = sum(map(len, parts[k : k + n])) + n - 1 if n else len(parts[k])
            if n:
                out.append(("signed_token", at, at + size))
            at += size + 1
            k += n or 1
    framed = [(s, e) for _, s, e in out]
    coded = {m.span() for pattern in RUNS for m in pattern.finditer(text)}
    k = 0
    for start, end in sorted(coded):
        while k < len(framed) and framed[k][1] <= start:
            k += 1
        if k < len(framed) and framed[k][0] <= start:  # the body of a frame that is found already
            continue
        raws = {_unbase64(text[start:end]), _unhex(text[start:end])} - {None}
        out += [(kind, start, end) for raw in raws if len(raw) >= LEAST_BYTES for kind in _inside(raw, wraps)]
    return out


def _inside(raw: bytes, wraps: int) -> set[str]:
    if _der_key(raw) or _openssh_key(raw):
        return {"private_key"}
    if wraps < 1 or not raw.isascii():
        return set()
    return {kind for kind, _, _ in confirmed(raw.decode("ascii"), wraps - 1)}


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then kind."""
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in HEX.finditer(text) if len(m[0]) >= 24]
    return sorted(set(out + confirmed(text)), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): array of (kind, start, end) for every row, empty where nothing is found.

    assign, access and hex are leftmost matches, not overlapping within a kind. private_key and signed_token are
    confirmed by decoding and may overlap the others: a key in a PEM frame (line ends may be written as \\n), or one
    unbroken run of base64, base64url or hex; a token is three or five dotted parts. Equal spans of one kind are one.
    A null text counts as empty; repeated rows and ids stay; other columns are not read. Time is in proportion to
    the text.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in find_spans(t)] for t in texts(b)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, SPANS)], names=["doc_id", "spans"])

    return ids_and_texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")
