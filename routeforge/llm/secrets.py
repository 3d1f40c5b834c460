"""Secret scan: pattern candidates, and encoded candidates confirmed by their structure.

Patterns find candidates for assignments, access keys and long hex strings. Encoded secrets are only reported once
their bytes parse: base64 or hex is decoded, and the result must be a whole DER sequence of a key (every nested length
ending exactly at its parent's end), an SSH key blob (length-prefixed fields that fill it) or a signed token whose header
is a JSON object with an algorithm.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from routeforge.llm.arrow_text import slices, texts_of

#: Kinds in the order in which spans of equal start are listed.
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "jwt", "pem_key", "der_key", "ssh_key")

_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
# A maximal run of 24 or more is found the same way with the least length in the pattern.
_HEX = re.compile(r"[0-9a-f]{24,}")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----((?:[A-Za-z0-9+/=\s]|\\+[nr])+)-----END \1-----")
# Where an encoded key can start: with a SEQUENCE (M in base64), a short field length or the magic of OpenSSH's private keys. A line end
# written out as \n ends in a letter.
_ENCODED = re.compile(r"(?:(?<![A-Za-z0-9+/_-])|(?<=\\[nr])|(?<=-----))(?:M[A-P]|AAAA|b3BlbnNzaC1rZXktdjE)")
#: Runs of the standard and the URL-safe alphabet. The first line of a key has 32 characters at least.
_RUNS = (re.compile(r"[A-Za-z0-9+/]+"), re.compile(r"[A-Za-z0-9_-]+"))
_LEAST_RUN = 32
_LINE_END = re.compile(r"[\x20\t]*(?:\r?\n|\r|(?:\\+r)?\\+n|\\+r)[\x20\t]*")
#: Fields of an SSH public key by type; others have two or more.
_SSH_TYPE = re.compile(rb"(ssh|ecdsa|sk)-[a-z0-9@.-]+$")
_SSH_FIELDS = {b"ssh-rsa": 3, b"ssh-dss": 5, b"ssh-ed25519": 2, b"sk-ssh-ed25519@openssh.com": 3, b"sk-ecdsa-sha2-nistp256@openssh.com": 4}
#: No key has more fields than this, in either form; a candidate with more is none.
_MOST_FIELDS = 16
_OPENSSH = b"openssh-key-v1\x00"
_ANY_HEX = re.compile(r"(?<![A-Za-z0-9])(?:[0-9A-Fa-f]{2}){16,}(?![A-Za-z0-9])")

Span = tuple[str, int, int]


def _unbase64(text: str) -> bytes | None:
    body = re.sub(r"\s|\\+[nr]", "", text).rstrip("=")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body.replace("-", "+").replace("_", "/") + "=" * (-len(body) % 4), validate=True)
    except binascii.Error:
        return None


def _der_items(data: bytes | _Wrapped, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the values that fill data[start:end] exactly; None where they don't, or are too many for a key."""
    items = []
    while start < end:
        if start + 2 > end or len(items) == _MOST_FIELDS:
            return None
        tag, length, start = data[start], data[start + 1], start + 2
        if length & 0x80:
            n = length & 0x7F
            if not 1 <= n <= 4 or start + n > end or data[start] == 0:
                return None
            length, start = int.from_bytes(data[start : start + n], "big"), start + n
        if start + length > end:
            return None
        items.append((tag, start, start + length))
        start += length
    return items


def is_der_key(data: bytes | _Wrapped) -> bool:
    """A private or public key: one SEQUENCE that fills the data, with the fields of a known key layout.

    Layouts: integers only (RSA, DSA), version and algorithm and OCTET STRING (PKCS #8), version and OCTET STRING (EC),
    algorithm and BIT STRING (public key).
    """
    if len(data) < 16 or data[0] != 0x30:
        return False
    outer = _der_items(data, 0, len(data))
    if not outer or len(outer) != 1:
        return False
    fields = _der_items(data, outer[0][1], outer[0][2])
    if not fields:
        return False
    tags = [t for t, _, _ in fields]

    def algorithm(field: tuple[int, int, int]) -> bool:
        inner = _der_items(data, field[1], field[2])
        return bool(inner) and inner[0][0] == 0x06

    if all(t == 0x02 for t in tags):
        return len(tags) in (2, 6, 9) and max(e - s for _, s, e in fields) >= 16
    if tags[:3] == [0x02, 0x30, 0x04]:
        return algorithm(fields[1])
    if tags[:2] == [0x02, 0x04]:
        return fields[0][2] - fields[0][1] == 1 and fields[1][2] - fields[1][1] >= 16
    return tags == [0x30, 0x03] and algorithm(fields[0])


def _ssh_fields(data: bytes | _Wrapped) -> Iterator[int]:
    """The ends of the length-prefixed fields that ``data`` starts with."""
    at = 0
    for _ in range(_MOST_FIELDS):
        end = at + 4 + int.from_bytes(data[at : at + 4], "big")
        if at + 4 > len(data) or end > len(data):
            return
        at = end
        yield at


def is_ssh_key(data: bytes) -> bool:
    """An OpenSSH private key, or length-prefixed fields that fill the data and start with a key type."""
    if data.startswith(_OPENSSH):
        return True
    ends = list(_ssh_fields(data))
    return len(ends) >= 2 and ends[-1] == len(data) and _SSH_TYPE.match(data[4 : ends[0]]) is not None


def _der_end(data: bytes | _Wrapped) -> int | None:
    """Where the value that ``data`` starts with ends, by its header; None without a whole header."""
    n = data[1] & 0x7F if data[1] & 0x80 else 0
    if n > 4 or data[1] == 0x80:
        return None
    return 2 + n + (int.from_bytes(data[2 : 2 + n], "big") if n else data[1])


def _openssh_end(data: bytes | _Wrapped) -> int | None:
    """Where an OpenSSH private key ends: magic, three fields, the number of keys, a field for each and one for the private part."""
    at = len(_OPENSSH)
    for _ in range(3):
        if at + 4 > len(data):
            return None
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    if keys > _MOST_FIELDS:
        return None
    for _ in range(keys + 1):
        if at + 4 > len(data):
            return None
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    return at


def is_signed_token(header: str, payload: str) -> bool:
    head, body = _unbase64(header), _unbase64(payload)
    if not head or not body:
        return False
    try:
        head = json.loads(head)
        return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(json.loads(body), dict)
    except (ValueError, RecursionError):
        return False


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches per kind; matches that fail their length rule are dropped after matching."""
    spans: list[Span] = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        spans += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    spans += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return spans


class _Lines:
    """Runs of one alphabet that follow each other from line to line, up to the first padded one or other text: where they start and end, and the
    characters before each."""

    def __init__(self, text: str, start: int, run: re.Pattern):
        self.starts, self.ends, self.before, self.padded = [], [], [0], 0
        m = run.match(text, start)
        while m:
            self.starts.append(m.start())
            self.ends.append(m.end())
            self.before.append(self.before[-1] + m.end() - m.start())
            self.padded = _padding(text, m.end())
            broken = None if self.padded else _LINE_END.match(text, m.end())
            m = run.match(text, broken.end()) if broken else None


def _padding(text: str, at: int) -> int:
    return text.startswith("=", at) + text.startswith("==", at)


class _Wrapped:
    """The bytes that a run and the lines after it encode. Only what is asked for is decoded, so that lengths can be followed at once
    over any number of lines. ``known`` has lines by their start, so that each is read once for an alphabet."""

    def __init__(self, text: str, start: int, run: re.Pattern, known: dict[int, tuple[_Lines, int]]):
        self.text, self.start = text, start
        m = run.match(text, start)
        self.end = m.end() if m else start
        self.head = self.end - start
        self.padded = _padding(text, self.end)
        self.lines, self.first = _NONE, 0
        broken = None if self.padded or not m else _LINE_END.match(text, self.end)
        if broken:
            if broken.end() not in known:
                lines = _Lines(text, broken.end(), run)
                known.update((at, (lines, k)) for k, at in enumerate(lines.starts))
            self.lines, self.first = known.get(broken.end(), (_NONE, 0))
        self.skipped = self.lines.before[self.first]
        self.characters = self.head + self.lines.before[-1] - self.skipped
        self.size = self.characters * 6 // 8

    def __len__(self) -> int:
        return self.size

    def _encoded(self, start: int, end: int) -> str:
        end = min(end, self.characters)
        out = [self.text[self.start + start : self.start + min(end, self.head)]]
        at, end = max(start, self.head) - self.head + self.skipped, end - self.head + self.skipped
        lines = self.lines
        k = bisect.bisect_right(lines.before, at) - 1
        while at < end:
            stop = min(end, lines.before[k + 1])
            shift = lines.starts[k] - lines.before[k]
            out.append(self.text[at + shift : stop + shift])
            at, k = stop, k + 1
        return "".join(out).replace("-", "+").replace("_", "/")

    def __getitem__(self, place: int | slice):
        if isinstance(place, int):
            return self[place : place + 1][0]
        start, stop = place.start or 0, min(place.stop, self.size)
        if start >= stop:
            return b""
        quads = self._encoded(start // 3 * 4, -(-stop // 3) * 4)
        if len(quads) % 4 == 1:
            quads = quads[:-1]
        return base64.b64decode(quads + "=" * (-len(quads) % 4))[start - start // 3 * 3 :][: stop - start]

    def place_of_end(self, size: int) -> tuple[int, int] | None:
        """Where the line ends, padding included, at whose end exactly so many bytes are encoded, and its number from 1; None if there is none."""
        needed = -(-size * 8 // 6)
        if needed <= self.head:
            held, place = self.head, (self.end + self.padded, 1)
        else:
            lines = self.lines
            k = bisect.bisect_left(lines.before, needed - self.head + self.skipped) - 1
            if k >= len(lines.ends):
                return None
            held = self.head + lines.before[k + 1] - self.skipped
            place = (lines.ends[k] + (lines.padded if k == len(lines.ends) - 1 else 0), k - self.first + 2)
        return place if held % 4 != 1 and held * 6 // 8 == size else None


_NONE = _Lines("", 0, re.compile("x"))


def _encoded_key(data: _Wrapped) -> tuple[str, int, int] | None:
    """Kind, end and lines of the key that starts with a run, over as many lines as its own lengths ask for. It ends at the end of a line."""
    if data.head < _LEAST_RUN:
        return None
    seen = data[:24]

    def found(kind: str, size: int) -> tuple[str, int, int] | None:
        place = data.place_of_end(size)
        return None if place is None else (kind, *place)

    if seen[0] == 0x30:
        size = _der_end(seen)
        if size is None or size > len(data):
            return None
        key = found("der_key", size)
        data.size = size
        return key if key and is_der_key(data) else None
    if seen.startswith(_OPENSSH):
        size = _openssh_end(data)
        return (found("ssh_key", size) if size is not None and size <= len(data) else None) or ("ssh_key", data.end + data.padded, 1)
    if not re.match(rb"\x00\x00\x00.(ssh|ecdsa|sk)-", seen, re.DOTALL):
        return None
    kind, one_line = b"", None
    for fields, end in enumerate(_ssh_fields(data), 1):
        if fields == 1:
            kind = data[4:end] if end <= 64 else b""
            if not _SSH_TYPE.match(kind):
                return None
            continue
        key = found("ssh_key", end)
        if key and fields >= _SSH_FIELDS.get(kind, 3 if kind.startswith(b"ecdsa-") else 2):
            return key
        if key and key[2] == 1:
            one_line = key
    return one_line


def structural_spans(text: str) -> list[Span]:
    """Encoded candidates whose decoded bytes have the structure of a key or signed token."""
    spans: list[Span] = []
    if "eyJ" in text:
        spans += [("jwt", m.start(), m.end()) for m in _JWT.finditer(text) if is_signed_token(m[1], m[2])]
    if "PRIVATE KEY-----" in text:
        for m in _PEM.finditer(text):
            data = _unbase64(m[2])
            if data and (is_der_key(data) or is_ssh_key(data)):
                spans.append(("pem_key", m.start(), m.end()))
    armoured = [(a, b) for kind, a, b in spans if kind == "pem_key"]
    armours = [a for a, _ in armoured]
    known: list[dict[int, tuple[_Lines, int]]] = [{} for _ in _RUNS]
    done = 0
    for m in _ENCODED.finditer(text):
        if m.start() < done:
            continue
        found = None
        for run, lines in zip(_RUNS, known, strict=True):
            found = found or _encoded_key(_Wrapped(text, m.start(), run, lines))
        # The lines of an armoured key are no second find.
        around = bisect.bisect_right(armours, m.start()) - 1
        if found and not (found[2] > 1 and around >= 0 and m.start() < armoured[around][1]):
            spans.append((found[0], m.start(), found[1]))
            done = found[1]
    # A DER SEQUENCE is 30 in hex.
    for m in _ANY_HEX.finditer(text):
        if m[0].startswith(("30", "0000", "6f70656e7373682d")):
            data = bytes.fromhex(m[0])
            if is_der_key(data):
                spans.append(("der_key", m.start(), m.end()))
            elif is_ssh_key(data):
                spans.append(("ssh_key", m.start(), m.end()))
    return spans


def _listed(spans: list[Span]) -> str:
    ordered = sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in ordered)


SCAN_SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_encoded long, base_spans string, spans string"


def find_secrets(docs: DataFrame) -> DataFrame:
    """Scan (doc_id, text): counts per kind, base_spans and spans as kind:start:end lists (code points, end exclusive).

    One row per input row, in no order; null text is empty, null doc_id stays null, other columns are not read. A row needs no
    other row, so nothing is shuffled.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in slices(batches, "text"):
            out: list[list] = [[], [], [], [], [], []]
            for text in texts_of(table).to_pylist():
                base, more = base_spans(text), structural_spans(text)
                for i, kind in enumerate(BASE_KINDS):
                    out[i].append(sum(k == kind for k, _, _ in base))
                out[3].append(len(more))
                out[4].append(_listed(base))
                out[5].append(_listed(base + more))
            numbers = [pa.array(c, pa.int64()) for c in out[:4]]
            strings = [pa.array(c, pa.string()) for c in out[4:]]
            ids = table.column("doc_id").combine_chunks().cast(pa.int64())
            yield pa.record_batch(
                [ids, *numbers, *strings],
                ["doc_id", "n_assign", "n_access", "n_hex", "n_encoded", "base_spans", "spans"],
            )

    return docs.select("doc_id", "text").mapInArrow(scan, SCAN_SCHEMA)


def redact(text: str, spans: str, mark: str = "[SECRET]") -> str:
    """``text`` with the listed spans replaced, overlapping ones as one."""
    cuts = sorted((int(a), int(b)) for _, a, b in (s.split(":") for s in spans.split(",") if s))
    out, at, end = [], 0, -1
    for a, b in cuts:
        if a >= end:
            out += [text[at:a], mark]
        at = end = max(end, b)
    return "".join([*out, text[at:]])


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
