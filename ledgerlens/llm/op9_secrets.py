"""Secret scan with structural confirmation.

Base kinds, leftmost non-overlapping each: ``assign``, ``access``, ``hex``. The method adds what it can
prove by parsing; a span is reported only if its structure holds:

    token  header.payload[.signature] in base64url whose header is a JSON object with a text "alg"
    der    base64 or hex that decodes to a DER SEQUENCE whose nested lengths add up exactly and whose
           fields are those of an RSA, DSA, EC, PKCS#8 or encrypted PKCS#8 private key
    armor  BEGIN ... PRIVATE KEY lines around base64 that decodes to such a key, to the magic and nested
           length-prefixed fields of the OpenSSH key encoding, or, below headers that name the cipher and
           its start vector, to whole blocks of that cipher

The length in a DER key's first bytes says how much base64 it takes, so a key is found behind other base64
characters and over line ends (plain, or written as \\n), with or without armor. It has to end where the
base64 does.

Offsets are code points, ends exclusive. Null and empty texts have no spans. Long texts are searched as they
are. doc_id is carried, never compared: each row gives one row, repeated rows alike. Only doc_id and text are
read, so other columns may have any name; spans that begin together are ordered by kind.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text

KINDS = ("assign", "access", "hex", "token", "der", "armor")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
NAMES = ("password", "passwd", "secret", "token", "api_key", "apikey")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # the same runs as with +, where all shorter ones are dropped
HEX = re.compile(r"[0-9a-f]{32,}")
HEADER = re.compile(r"e[yw][A-Za-z0-9_-]{2,}(?=\.)")
AFTER = re.compile(r"\.([A-Za-z0-9_-]+)(?:\.([A-Za-z0-9_-]*))?")
KEY_START = re.compile(r"M(?:[A-H]|I[E-L])[A-Za-z0-9+/]{14,}")
BASE64 = re.compile(r"[A-Za-z0-9+/]+")
LINE_END = re.compile(r"[ \t]*(?:(?:\\r)?\\n|\r?\n)[ \t]*")
LONG_HEX = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{64,}")
ARMOR = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*)PRIVATE KEY-----((?:[^-]|-(?!----END ))*)-----END \1PRIVATE KEY-----", re.ASCII)
HEADERS = re.compile(r"(?:[ \t]*[A-Za-z-]+: [^\n]*\n)+\s*\n")
CIPHER = re.compile(r"DEK-Info: [A-Z0-9-]+,([0-9A-Fa-f]+)\s")
#: The object identifiers of password-based encryption in PKCS#5 and PKCS#12.
ENCRYPTION = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))


def der(data: bytes, at: int, end: int, depth: int = 0) -> list[tuple[int, object]] | None:
    """(tag, contents) of the DER values in data[at:end], constructed ones parsed; None unless the lengths fit exactly."""
    out: list[tuple[int, object]] = []
    while at < end:
        if end - at < 2 or depth > 8:
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size >= 128:
            n = size & 127
            if not 1 <= n <= 4 or at + n > end:
                return None
            size = int.from_bytes(data[at : at + n], "big")
            at += n
            if size < 128 or size >> 8 * (n - 1) == 0:
                return None
        if tag & 31 == 31 or at + size > end:
            return None
        if tag & 32:
            inner = der(data, at, at + size, depth + 1)
            if inner is None:
                return None
            out.append((tag, inner))
        else:
            out.append((tag, data[at : at + size]))
        at += size
    return out


def private_key(data: bytes) -> str | None:
    """rsa, dsa, ec, pkcs8 or encrypted if the whole of ``data`` is such a key encoding."""
    if len(data) < 24 or data[0] != 0x30:
        return None
    tree = der(data, 0, len(data))
    if not tree or len(tree) != 1 or not isinstance(tree[0][1], list):
        return None
    fields = tree[0][1]
    tags = [t for t, _ in fields]
    if tags == [0x30, 4] and fields[0][1] and fields[0][1][0][0] == 6 and fields[0][1][0][1].startswith(ENCRYPTION):
        return "encrypted"
    if tags[:1] != [2]:
        return None
    version = fields[0][1]
    if version in (b"\0", b"\1") and len(tags) >= 9 and set(tags[:9]) == {2}:
        return "rsa"
    if version == b"\0" and tags == [2] * 6 and len(fields[1][1]) >= 64 and len(fields[2][1]) >= 20:
        return "dsa"
    if version == b"\1" and tags[1:2] == [4] and all(t in (0xA0, 0xA1) for t in tags[2:]):
        return "ec"
    if version in (b"\0", b"\1") and tags[1:3] == [0x30, 4] and fields[1][1] and fields[1][1][0][0] == 6:
        return "pkcs8"
    return None


def key_size(head: bytes) -> int:
    """Bytes of the DER value that begins with ``head``; 0 if it cannot be a private key."""
    n = head[1] & 127 if head[1] >= 128 else 0
    if head[0] != 0x30 or n > 4 or head[1] == 128:
        return 0
    size = int.from_bytes(head[2 : 2 + n], "big") if n else head[1]
    return 2 + n + size if head[2 + n] in (2, 0x30) else 0


def key_at(text: str, start: int) -> int:
    """The end of the base64 private key that begins at ``start``, line ends inside it or not; 0 if there is none."""
    wanted = -(-key_size(base64.b64decode(text[start : start + 12])) * 4 // 3)
    parts: list[str] = []
    at, have = start, 0
    while have < wanted:
        run = BASE64.match(text, at)
        if not run:
            return 0
        parts.append(run[0])
        have, at = have + len(run[0]), run.end()
        if have < wanted:
            gap = LINE_END.match(text, at)
            if not gap:
                return 0
            at = gap.end()
    if not wanted or have > wanted:
        return 0
    data = unbase64("".join(parts))
    if not data or not private_key(data):
        return 0
    return at + len(text[at : at + 2]) - len(text[at : at + 2].lstrip("="))


def armored(headers: str, body: str) -> bool:
    """Whether what stands between the armor lines is a key."""
    data = unbase64(re.sub(r"\\[rn]|\s", "", body))
    if not data:
        return False
    if "ENCRYPTED" in headers:
        cipher = CIPHER.search(headers)
        return bool(cipher) and len(cipher[1]) in (16, 32) and len(data) % (len(cipher[1]) // 2) == 0
    return bool(private_key(data) or openssh_key(data))


def openssh_key(data: bytes) -> bool:
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at = len(magic)

    def field() -> bool:
        nonlocal at
        size = int.from_bytes(data[at : at + 4], "big") if at + 4 <= len(data) else len(data)
        at += 4 + size
        return at <= len(data)

    if not (field() and field() and field()):
        return False
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    return 1 <= keys <= 64 and all(field() for _ in range(keys + 1)) and at == len(data)


def unbase64(text: str) -> bytes | None:
    text = text.rstrip("=")
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def signed_header(text: str) -> str | None:
    """The "alg" of a token's header."""
    data = unbase64(text.replace("-", "+").replace("_", "/"))
    if data is None or data[:1] != b"{":
        return None
    try:
        header = json.loads(data)
    except (ValueError, RecursionError):
        return None
    return header["alg"] if isinstance(header, dict) and isinstance(header.get("alg"), str) else None


def tokens(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of signed tokens, leftmost first, also behind other base64url characters."""
    at = 0
    while (m := HEADER.search(text, at)) is not None:
        at = m.start() + 2
        if (after := AFTER.match(text, m.end())) is None or (alg := signed_header(m[0])) is None:
            continue
        if unbase64(after[1].replace("-", "+").replace("_", "/")) is not None and (alg == "none" or after[2]):
            yield m.start(), after.end()
            at = after.end()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds."""
    out = []
    low = text.lower()
    if any(n in low for n in NAMES):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def keys(text: str, taken: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """(start, end) of base64 private keys outside of armor, leftmost first."""
    at = 0
    while (m := KEY_START.search(text, at)) is not None:
        at = m.start() + 1
        if inside := [e for s, _, e in taken if s <= m.start() < e]:
            at = max(inside)
        elif end := key_at(text, m.start()):
            yield m.start(), end
            at = end


def confirmed_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what parses as a signed token or a key."""
    out = []
    if "-----BEGIN " in text:
        for m in ARMOR.finditer(text):
            headers = found[0] if (found := HEADERS.match(m[2].lstrip())) else ""
            if armored(headers, m[2].lstrip()[len(headers) :]):
                out.append((m.start(), 5, m.end()))
    out += [(s, 4, e) for s, e in keys(text, out)]
    if "ey" in text or "ew" in text:  # base64 of '{"' and of '{' before white space
        out += [(s, 3, e) for s, e in tokens(text)]
    for m in LONG_HEX.finditer(text):
        if m[0].startswith("30") and len(m[0]) % 2 == 0 and private_key(bytes.fromhex(m[0])):
            out.append((m.start(), 4, m.end()))
    return sorted(out)


def spell(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_confirmed."""
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_confirmed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in names[1:]]
            for text in batch["text"]:
                text = text.as_py()
                base, more = base_spans(text), confirmed_spans(text)
                kinds = [k for _, k, _ in base]
                row = (kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(spell(base).encode()).hexdigest(), spell(sorted(base + more)), len(more))
                for col, x in zip(cols, row, strict=True):
                    col.append(x)
            kinds_of = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.record_batch([batch["doc_id"], *(pa.array(c, k) for c, k in zip(cols, kinds_of, strict=True))], names)

    return id_text(docs).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long")
