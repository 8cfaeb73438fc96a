"""Secret scans with structural confirmation.

Plain patterns give base spans. Base64 and hex candidates are decoded and confirmed by structure: PEM
blocks and bare DER by nested lengths that add up, SSH keys by their length-prefixed fields, signed tokens
by a JSON header that names a signing algorithm, a JSON object behind it, and a signature. Only what parses is
reported; an encrypted key can't be parsed, so its block needs a header with cipher and start value. What is
encoded twice, or has its line ends written out, is decoded again. Structures that hold nothing secret (public keys,
certificates, requests, signatures) are told by their parsed items: `structures` gives them, the scan does not.

Edge cases: a null text counts as empty and has no spans; repeated rows each get their row; other
columns don't matter; an empty table gives an empty result. Spans count code points, end exclusive.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Encodings inside one another that are undone.
NESTED = 3
KINDS = ("assign", "access", "hex", "pem", "ssh", "der", "jwt")
_ASSIGN = re.compile(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
_ASSIGN_HINTS = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
#: Marks of an armoured block, its header lines, and its body; marks are paired in order, so a text is read once.
_MARK = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]+)-----")
_HEADER = re.compile(r"\s*+((?:[A-Za-z][A-Za-z0-9-]*+:[^\r\n]*+\r?\n)*+)")
_BODY = re.compile(r"[A-Za-z0-9+/=\s]+")
_CIPHER = re.compile(r"^DEK-Info: *[A-Z0-9-]+, *(?:[0-9A-Fa-f]{2}){8,}\s*$", re.MULTILINE)
#: A JSON object in base64 begins with these letters, whether a quote or white space follows the brace.
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(e[wy][A-Za-z0-9_-]{6,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]+)")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}")
_LONG_HEX = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{40,}(?![0-9A-Fa-f])")


def decoded(text: str) -> bytes | None:
    """Bytes of base64 in either alphabet, with or without padding."""
    body = "".join(text.split()).rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def is_der(raw: bytes, least: int = 2) -> bool:
    """Whether ``raw`` is one DER sequence of at least ``least`` items whose nested lengths all add up."""

    def items(at: int, end: int, depth: int) -> int:
        n = 0
        while at < end:
            if end - at < 2 or depth > 16:
                return -1
            tag, size, at = raw[at], raw[at + 1], at + 2
            if tag & 0x1F == 0x1F:
                return -1
            if size & 0x80:
                width = size & 0x7F
                if not 1 <= width <= 4 or at + width > end:
                    return -1
                size, at = int.from_bytes(raw[at : at + width], "big"), at + width
                if size < 0x80:
                    return -1
            if at + size > end or (tag & 0x20 and items(at, at + size, depth + 1) < 0):
                return -1
            if tag == 0x02 and size == 0 or tag & 0xC0 == 0 and tag & 0x1F in (0, 14, 15):
                return -1
            at, n = at + size, n + 1
        return n

    if len(raw) < 16 or raw[0] != 0x30 or items(0, len(raw), 0) != 1:
        return False
    skip = 2 + (raw[1] & 0x7F if raw[1] & 0x80 else 0)
    return items(skip, len(raw), 1) >= least


def is_ssh(raw: bytes) -> bool:
    """Whether ``raw`` is an SSH key: the private container, or fields whose lengths end with it."""
    if raw.startswith(b"openssh-key-v1\0"):
        raw, most = raw[15:], 3
    else:
        most = 99
    at, fields = 0, []
    while at < len(raw) and len(fields) < most:
        size = int.from_bytes(raw[at : at + 4], "big")
        if at + 4 + size > len(raw):
            return False
        fields.append(raw[at + 4 : at + 4 + size])
        at += 4 + size
    if most == 3:
        return len(fields) == 3 and all(f.isascii() for f in fields[:2])
    return len(fields) >= 2 and re.fullmatch(rb"(sk-)?(ssh|ecdsa)-[a-z0-9@.-]+", fields[0]) is not None


def is_token(header: str, payload: str) -> bool:
    """Whether a signed token's first two parts are JSON objects and the first names its algorithm (one that signs)."""
    try:
        parts = [json.loads(decoded(x) or b"") for x in (header, payload)]
    except (ValueError, RecursionError):
        return False
    return all(isinstance(p, dict) for p in parts) and isinstance(parts[0].get("alg"), str) and parts[0]["alg"].lower() != "none"


def is_public(raw: bytes) -> bool:
    """Whether a confirmed DER or SSH structure holds nothing secret: what its parsed items are.

    Two numbers are a public RSA key or a signature; an algorithm and bits, a public key; a body, an algorithm and
    bits, a certificate or request; an identifier and its content, a message. SSH keys are secret in their container only.
    """
    if raw[:1] != b"\x30":
        return not raw.startswith(b"openssh-key-v1\0")
    at, tags = 2 + (raw[1] & 0x7F if raw[1] & 0x80 else 0), []
    while at < len(raw) and len(tags) < 4:
        size, skip = raw[at + 1], 2
        if size & 0x80:
            skip += size & 0x7F
            size = int.from_bytes(raw[at + 2 : at + skip], "big")
        tags.append(raw[at])
        at += skip + size
    return tags in ([0x02, 0x02], [0x30, 0x03], [0x30, 0x30, 0x03], [0x06, 0xA0])


def armoured(kind: str, content: str) -> bool | None:
    """Whether an armoured block's content is secret: its encoding parses, or its header names a cipher and the body is
    whole blocks. None if it is no key."""
    content = content.replace("\\r", "").replace("\\n", "\n")
    lead = _HEADER.match(content)
    body = content[lead.end() :]
    raw = decoded(body) if _BODY.fullmatch(body) else None
    if not raw:
        return None
    if is_der(raw) or is_ssh(raw):
        return "PRIVATE" in kind or not is_public(raw)
    return True if "ENCRYPTED" in lead[1] and _CIPHER.search(lead[1]) is not None and len(raw) % 8 == 0 else None


def blocks(text: str) -> Iterator[tuple[int, int, bool]]:
    """Start, end and secrecy of each armoured block that is a key: a mark that begins one and, next to it, its end."""
    begun = None
    for m in _MARK.finditer(text):
        if m[1] == "BEGIN":
            begun = m
        elif begun is not None:
            secret = armoured(m[2], text[begun.end() : m.start()]) if begun[2] == m[2] else None
            if secret is not None:
                yield begun.start(), m.end(), secret
            begun = None


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    low = text.lower()
    if any(h in low for h in _ASSIGN_HINTS):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    return out + [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]


def _within(spans: list[tuple[str, int, int, bool]]):
    """A test whether a range lies in one of the spans: the furthest end of those that begin before it."""
    by_start = sorted((s, e) for _, s, e, _ in spans)
    starts, ends = [s for s, _ in by_start], list(accumulate((e for _, e in by_start), max))
    return lambda a, b: (i := bisect_right(starts, a)) > 0 and b <= ends[i - 1]


def _kind_of(raw: bytes, depth: int) -> tuple[str, bool] | None:
    """Kind and secrecy of decoded bytes; of a text, that of a secret structure in it, or else of the first one."""
    if is_ssh(raw):
        return "ssh", not is_public(raw)
    if is_der(raw):
        return "der", not is_public(raw)
    if depth < NESTED and raw.isascii():
        inner = structures(raw.decode("ascii"), depth + 1)
        return min(((k, secret) for k, _, _, secret in inner), key=lambda x: not x[1], default=None)
    return None


def structures(text: str, depth: int = 1) -> list[tuple[str, int, int, bool]]:
    """Kind, start, end and secrecy of all encodings that parse."""
    out = []
    if "-----BEGIN " in text:
        out += [("pem", s, e, secret) for s, e, secret in blocks(text)]
    out += [("jwt", m.start(), m.end(), True) for m in _TOKEN.finditer(text) if is_token(m[1], m[2])]
    inside = _within(out)
    for m in _BASE64.finditer(text):
        if not inside(m.start(), m.end()) and (raw := decoded(m[0])) and (found := _kind_of(raw, depth)):
            out.append((found[0], m.start(), m.end(), found[1]))
    inside = _within(out)
    for m in _LONG_HEX.finditer(text):
        if len(m[0]) % 2 == 0 and not inside(m.start(), m.end()) and (found := _kind_of(bytes.fromhex(m[0]), depth)):
            out.append((found[0], m.start(), m.end(), found[1]))
    return out


def confirmed_spans(text: str) -> list[tuple[str, int, int]]:
    """All structures that parse, public ones too."""
    return [x[:3] for x in structures(text)]


def secret_spans(text: str) -> list[tuple[str, int, int]]:
    """Structures that parse and hold a secret."""
    return [x[:3] for x in structures(text) if x[3]]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


def scan(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: base counts, the base spans' digest and all spans."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch["text"].to_pylist():
                base = base_spans(text or "")
                kinds = [k for k, _, _ in base]
                more = secret_spans(text or "")
                rows.append((*(kinds.count(k) for k in KINDS[:3]), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more), len(more)))
            n_assign, n_access, n_hex, digest, spans, confirmed = zip(*rows, strict=True) if rows else ((),) * 6
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    *(pa.array(x, pa.int64()) for x in (n_assign, n_access, n_hex)),
                    pa.array(digest, pa.string()),
                    pa.array(spans, pa.string()),
                    pa.array(confirmed, pa.int64()),
                ],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_confirmed"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        find, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long"
    )


def blank(text: str | None, mark: str = "[SECRET]") -> str | None:
    """The text with every span, overlaps joined, replaced by a mark."""
    if not text:
        return text
    out, at = [], 0
    for s, e in sorted((s, e) for _, s, e in base_spans(text) + secret_spans(text)):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join(out) + text[at:] if out else text


def without_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with secrets blanked out in ``text``; ``n_chars`` follows where it is present."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = pa.array([blank(t) for t in batch["text"].to_pylist()], batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([texts if i == at else batch.column(i) for i in range(batch.num_columns)], schema=batch.schema)

    out = docs.mapInArrow(clean, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
