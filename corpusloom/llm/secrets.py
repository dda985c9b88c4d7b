"""Secrets in texts, with structural confirmation: what looks like a key or a signed token is decoded and parsed before it is reported.

Patterns find credentials that are assigned, access ids and long hex runs. Beyond these, base64 and hex candidates are decoded: a
private key must parse as one (nested DER lengths that add up, or the length-prefixed fields of an OpenSSH key), a signed token must
have a JSON header that names its algorithm. A text is looked at in one task, without a shuffle; Arrow's linear-time matcher passes
over the texts that hold nothing.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from corpusloom.llm.common import pieces, text_or_empty

#: Kinds in the order in which spans of one place stand; the first three are patterns, the others are confirmed by their structure.
KINDS = ("assign", "access", "hex", "token", "pem", "key")
BASE = 3

# The patterns of the base kinds, ASCII only.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # 16 characters: a shorter run has no longer one inside
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")

_URL = "[A-Za-z0-9_-]"
#: Three or five segments, of which the first can be a JSON object: a brace, then a quote, a brace or white space.
TOKEN = re.compile(rf"(?<![A-Za-z0-9_.-])e[w-y]{_URL}+(?:\.{_URL}*){{2,}}")
#: An armour ends at the next five dashes.
PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----((?:[^-]|-(?!----))*)-----END \1-----")
#: Base64 of a DER sequence of 60 bytes or more, or of an OpenSSH key.
RUN = re.compile(r"(?<![A-Za-z0-9+/_-])(?:M[A-I]|b3BlbnNzaC1rZXktdjE)[A-Za-z0-9+/_-]{40,}={0,2}")
HEX_RUN = re.compile(r"(?<![0-9A-Fa-f])(?:30|(?i:6f70656e7373682d6b65792d7631))[0-9A-Fa-f]{62,}")

#: What Arrow's matcher looks for before anything else does; it lets more texts through, never fewer.
ANY = r"(?i:password|passwd|secret|token|api_?key)|AKIA|[0-9A-Fa-f]{32}|e[w-y][A-Za-z0-9_-]+\.|-----BEGIN |M[A-I][A-Za-z0-9+/_-]{40}|b3BlbnNzaC1rZXktdjE"


def unbase64(text: str) -> bytes | None:
    """Bytes of base64 in either alphabet, with padding or without; None where it is none."""
    bare = text.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(bare + "=" * (-len(bare) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def elements(data: bytes) -> list[tuple[int, bytes]] | None:
    """Tags and contents of DER elements that fill data exactly; None where lengths don't add up."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, n = data[at], data[at + 1]
        at += 2
        if n >= 0x80:
            size = n & 0x7F
            if not 1 <= size <= 4 or at + size > len(data):
                return None
            n = int.from_bytes(data[at : at + size])
            at += size
        if at + n > len(data):
            return None
        out.append((tag, data[at : at + n]))
        at += n
    return out


INTEGER, OCTETS, OID, SEQUENCE, NAMED, PUBLIC = 0x02, 0x04, 0x06, 0x30, 0xA0, 0xA1


def is_der_key(data: bytes) -> bool:
    """A private key: numbers of RSA or DSA, an EC key, or a key with its algorithm, encrypted or not."""
    outer = elements(data)
    if outer is None or len(outer) != 1 or outer[0][0] != SEQUENCE or not (parts := elements(outer[0][1])):
        return False
    tags, version = [t for t, _ in parts], parts[0][1]
    if tags in ([INTEGER] * 9, [INTEGER] * 9 + [SEQUENCE], [INTEGER] * 6):
        return version in (b"\0", b"\1") and len(parts[1][1]) >= 16
    if tags[:3] == [INTEGER, SEQUENCE, OCTETS] and version in (b"\0", b"\1"):
        algorithm = elements(parts[1][1])
        return bool(algorithm) and algorithm[0][0] == OID and elements(parts[2][1]) is not None
    if tags[:2] == [INTEGER, OCTETS] and version == b"\1":
        return len(parts[1][1]) >= 16 and all(t in (NAMED, PUBLIC) and elements(x) is not None for t, x in parts[2:])
    if tags == [SEQUENCE, OCTETS]:
        algorithm = elements(parts[0][1])
        return bool(algorithm) and [t for t, _ in algorithm] == [OID, SEQUENCE] and elements(algorithm[1][1]) is not None
    return False


def is_ssh_key(data: bytes) -> bool:
    """OpenSSH's form: its name, then fields with 32-bit lengths that end with the data."""
    if not data.startswith(b"openssh-key-v1\0"):
        return False
    at = 15

    def field() -> bytes | None:
        nonlocal at
        n = int.from_bytes(data[at : at + 4])
        if at + 4 + n > len(data):
            return None
        at += 4 + n
        return data[at - n : at]

    if any(field() is None for _ in range(3)) or at + 4 > len(data):  # cipher, derivation and its options
        return False
    keys = int.from_bytes(data[at : at + 4])
    at += 4
    if not 1 <= keys <= 64 or any(not field() for _ in range(keys)):
        return False
    private = field()
    return bool(private) and len(private) % 8 == 0 and at == len(data)


def is_key(data: bytes | None) -> bool:
    return bool(data) and (is_der_key(data) or is_ssh_key(data))


def is_armoured_key(body: str) -> bool:
    """A PEM body, with line breaks as such or as escapes; one encrypted under headers must have whole cipher blocks."""
    lines = body.replace("\\r", "\n").replace("\\n", "\n").split("\n")
    headed = any(x.strip().startswith("Proc-Type: 4,ENCRYPTED") for x in lines)
    data = unbase64("".join("".join(x.split()) for x in lines if ":" not in x))
    return is_key(data) or (headed and bool(data) and len(data) % 8 == 0)


def _object(segment: str) -> dict | None:
    data = unbase64(segment)
    try:
        found = json.loads(data) if data else None
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def is_signed_token(text: str) -> bool:
    """Header, payload and signature, or the five parts of an encrypted token, with a header that names its algorithm."""
    segments = text.split(".")
    header = _object(segments[0])
    if not header or not isinstance(header.get("alg"), str) or any(unbase64(x) is None for x in segments[1:]):
        return False
    if len(segments) == 5:
        return isinstance(header.get("enc"), str)
    return len(segments) == 3 and bool(segments[1]) and bool(segments[2]) == (header["alg"].lower() != "none") and (header.get("b64") is False or "cty" in header or "crit" in header or _object(segments[1]) is not None)


def base_spans(text: str) -> Iterator[tuple[int, int, int]]:
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= 8:
            yield m.start(), 0, m.end()
    for kind, pattern in ((1, ACCESS), (2, HEX)):
        for m in pattern.finditer(text):
            yield m.start(), kind, m.end()


def confirmed_spans(text: str) -> Iterator[tuple[int, int, int]]:
    for m in TOKEN.finditer(text):
        ends = (m[0], m[0].removesuffix("."), m[0].rstrip("."))  # dots at the end can be the sentence's
        if whole := next((x for x in ends if is_signed_token(x)), None):
            yield m.start(), 3, m.start() + len(whole)
    armoured = [m.span() for m in PEM.finditer(text) if is_armoured_key(m[2])]
    for start, end in armoured:
        yield start, 4, end
    at = 0
    runs = [(m.start(), m.end(), unbase64(m[0])) for m in RUN.finditer(text)]
    runs += [(m.start(), m.end(), bytes.fromhex(m[0])) for m in HEX_RUN.finditer(text) if (m.end() - m.start()) % 2 == 0]
    for start, end, data in sorted(runs, key=lambda x: x[:2]):
        while at < len(armoured) and armoured[at][1] <= start:
            at += 1
        if not (at < len(armoured) and armoured[at][0] <= start) and is_key(data):
            yield start, 5, end


def find(text: str) -> list[tuple[str, int, int]]:
    """Kind, start and end (code points, end exclusive) of all secrets, by start, kind and end."""
    return [(KINDS[k], a, b) for a, k, b in sorted([*base_spans(text), *confirmed_spans(text)])]


SPANS = ArrayType(StructType().add("kind", "string").add("start", "long").add("end", "long"))
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """text with each run of overlapping spans replaced by the kind of the first in brackets."""
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def find_secrets(docs: DataFrame, text: str = "text", out: str = "secrets", redacted: str | None = None) -> DataFrame:
    """docs with the array `out` of (kind, start, end), and with `redacted` as the name of a column, the text without secrets.

    Spans stand by start, kind (in the order of KINDS) and end. Null and empty texts have no secrets (and null stays null when
    redacted). Repeated rows are each reported. A column that has the name of a result is replaced; all others stay as they are. A text
    is handled as a whole, however long; slices of a batch hold some 4 MB of texts or one text. An empty table gives no rows.
    """
    names = [out, *([redacted] if redacted else [])]
    rows = docs.drop(*names)
    schema = StructType([*rows.schema.fields]).add(out, SPANS)
    if redacted:
        schema = schema.add(redacted, "string")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, column=text):
            texts = batch.column(text)
            maybe = pc.fill_null(pc.match_substring_regex(texts, ANY), False).to_pylist()
            found = [find(t.as_py()) if hit else [] for t, hit in zip(texts, maybe)]
            columns = [*batch.columns, pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in x] for x in found], _SPANS)]
            if redacted:
                columns.append(pa.array([redact(t.as_py(), x) if x else t.as_py() for t, x in zip(texts, found)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, *names])

    return rows.mapInArrow(scan, schema)


def secret_digests(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: id_col, numbers of the base kinds, digest of their spans, and all spans as text: kind:start:end."""
    rows = find_secrets(docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text).alias("text")))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    number = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda s: s["kind"].isin(*KINDS[:BASE]))
    return rows.select(F.col("doc_id").alias(id_col), *(number(k) for k in KINDS[:BASE]), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))
