"""Operator 7: secret scans with structural confirmation.

Base patterns give spans (assign, access, hex). Candidates in base64 or hexadecimal are then decoded
and reported only if what they hold is built like a key: DER with lengths that nest exactly, a PEM
block around such a body, an OpenSSH key with its length-prefixed fields, or a signed token whose
header is a JSON object naming an algorithm. Base64 may use either alphabet, be wrapped at line breaks
(also written-out ones, as in JSON) and hold escaped slashes, plus and equals signs; what begins like a
key is read as far as its own lengths say, and has to end there. Hexadecimal may stand in one run, behind
or before other digits, or in pairs with a colon or a blank between.

Null text counts as empty; every row gives one row; repeated rows repeat; an empty table gives none.
Each run of digits is decoded once, however many places of it may begin a key, so long texts take time
in proportion. Spans count code points, end exclusive. Other columns may have any name and are not read.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passbook.llm.common import text_of

# Patterns of the base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
# Shapes of candidates for decoding.
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]+)-----((?:[A-Za-z0-9+/=\s]|\\+(?:[nrt/]|u00(?:2[BbFf]|3[Dd])))+)-----END \1-----")
SIGNED = re.compile(r"([A-Za-z0-9_-]++)(?:\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]*+)?")
# A sequence of a short length that begins with an integer or a sequence, or one of a long length; OpenSSH.
START = re.compile(r"M(?:[A-H][AEIMQUYcgkosw048][Cw]|I[E-T])|b3BlbnNzaC1rZXktdjE|AAAA[B-K]")
CHUNK = re.compile(r"(?:[A-Za-z0-9+/_]|-(?!----))+")
BREAK = re.compile(r"(?:[ \t]*(?:[\r\n]|\\+[nr]))+[ \t]*")
ESCAPE = re.compile(r"\\+(?:(/)|u00(2[BbDdFf]|5[Ff]|3[Dd]))")
PADDING = re.compile(r"(?:=|\\+u003[Dd]|%3[Dd]){0,2}")
STANDARD, URL = re.compile(r"[A-Za-z0-9+/]"), re.compile(r"[A-Za-z0-9_]|-(?!----)")
TO_STANDARD = str.maketrans("-_", "+/")
# Digits in one run, or in pairs with one mark between all of them; bytes that may begin a key.
HEXRUN = re.compile(r"[0-9A-Fa-f]{2}(?:([: ])[0-9A-Fa-f]{2}(?:\1[0-9A-Fa-f]{2}){14,}|[0-9A-Fa-f]{30,})")
HEXSTART = re.compile(rb"\x30|openssh-key-v1\x00|\x00\x00\x00[\x07-\x28](?:ssh-|ecdsa-)", re.S)
KINDS = ("assign", "access", "hex", "pem", "der", "ssh", "jwt")
OPENSSH = b"openssh-key-v1\x00"


def element(data: bytes, at: int, end: int) -> tuple[int, int]:
    """Where the content of the DER element at a place begins and ends; (0, 0) if it is none or passes the end."""
    if at + 2 > end:
        return 0, 0
    tag, size, body = data[at], data[at + 1], at + 2
    if size & 0x80:
        more = size & 0x7F
        if not 1 <= more <= 4 or body + more > end:
            return 0, 0
        size, body = int.from_bytes(data[body : body + more], "big"), body + more
        if size < 0x80:
            return 0, 0
    return (body, body + size) if body + size <= end and tag & 0x1F != 0x1F and tag else (0, 0)


def der_whole(data: bytes, at: int, end: int, depth: int = 0) -> bool:
    """Whether bytes are a run of DER elements whose nested lengths add up exactly."""
    if at >= end or depth > 16:
        return False
    while at < end:
        tag = data[at]
        body, at = element(data, at, end)
        if not body or (tag & 0x20 and not der_whole(data, body, at, depth + 1)):
            return False
    return True


def der_end(data: bytes, at: int = 0) -> int:
    """Where a sequence that begins with an integer or a sequence, and is whole, ends; 0 if there is none."""
    if data[at : at + 1] != b"\x30":
        return 0
    body, end = element(data, at, len(data))
    right = body and end - at >= 16 and data[body] in (0x02, 0x30) and der_whole(data, body, end)
    return end if right else 0


def der_key(data: bytes) -> bool:
    """Whether bytes are one such sequence and no more."""
    return len(data) > 0 and der_end(data) == len(data)


def named_start(data: bytes, at: int) -> bool:
    """Whether a sequence begins as key encodings do: with a small version, or with a sequence that names its kind."""
    body, _ = element(data, at, len(data))
    inner = element(data, body, len(data))[0] if data[body] == 0x30 else 0
    return data[body : body + 2] == b"\x02\x01" and data[body + 2] < 4 or bool(inner) and data[inner] == 0x06


def ssh_fields(data: bytes, at: int, least: int) -> bool:
    """Whether at least so many fields with four-byte lengths follow one another from a place on."""
    for _ in range(least):
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at : at + 4], "big")
        if at > len(data):
            return False
    return True


def ssh_key(data: bytes, at: int = 0) -> bool:
    if data.startswith(OPENSSH, at):
        return ssh_fields(data, at + len(OPENSSH), 3)
    size = int.from_bytes(data[at : at + 4], "big")
    return 7 <= size <= 40 and data[at + 4 : at + 4 + size].startswith((b"ssh-", b"ecdsa-")) and ssh_fields(data, at, 2)


def from_base64(text: str, url: bool = False) -> bytes:
    """Decoded bytes; none if the text is no base64. Missing padding is added."""
    text = text.rstrip("=")
    if len(text) % 4 == 1:
        return b""
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), b"-_" if url else None, validate=True)
    except (binascii.Error, ValueError):
        return b""


def signed_header(text: str) -> bool:
    """Whether the first part is a JSON object with an algorithm and the second one a JSON object."""
    head, body, _ = text.split(".")
    try:
        first, second = json.loads(from_base64(head, True)), json.loads(from_base64(body, True))
    except (ValueError, RecursionError):
        return False
    return isinstance(first, dict) and isinstance(first.get("alg"), str) and isinstance(second, dict)


def key_bytes(data: bytes) -> str | None:
    """The kind of key that bytes are built like."""
    return "der" if der_key(data) else "ssh" if ssh_key(data) else None


def unescaped(m: re.Match) -> str:
    return m[1] or chr(int(m[2], 16))


class Run:
    """The base64 characters from a place on, across line breaks and escapes, each decoding done once."""

    def __init__(self, text: str, at: int):
        self.begin, chars, places, tails, cuts = at, [], [], [], []
        count = 0
        while True:
            if m := CHUNK.match(text, at):
                part, where, at = m[0], np.arange(at, m.end()), m.end()
                tail = where + 1
            elif (m := ESCAPE.match(text, at)) and unescaped(m) != "=":
                part, where, at = unescaped(m), np.array([at]), m.end()
                tail = np.array([at])
            elif count and (m := BREAK.match(text, at)):
                at = m.end()
                cuts.append(count)
                continue
            else:
                break
            chars.append(part)
            places.append(where)
            tails.append(tail)
            count += len(part)
        self.stop = at
        self.places = np.concatenate(places) if places else np.zeros(0, np.int64)
        self.tails = np.concatenate(tails) if tails else self.places
        self.raw = "".join(chars)
        self.chars, self.cuts = self.raw.translate(TO_STANDARD), [*cuts, count]
        self.line_ends = set(self.cuts)
        self._bytes: dict[int, bytes] = {}

    def at(self, place: int) -> tuple[bytes, int, int]:
        """Bytes read in step with a place of the text, the byte there, and the number of its character."""
        k = int(np.searchsorted(self.places, place))
        if k % 4 not in self._bytes:
            whole = self.chars[k % 4 :]
            self._bytes[k % 4] = from_base64(whole[:-1] if len(whole) % 4 == 1 else whole)
        return self._bytes[k % 4], (k - k % 4) // 4 * 3, k

    def end(self, k: int, size: int) -> int:
        """Where in the text so many bytes from character k on end."""
        return int(self.tails[min(k + -(-size * 4 // 3), len(self.chars)) - 1])


def ends(text: str, at: int, url: bool) -> bool:
    """Whether no character of the alphabet follows."""
    m = ESCAPE.match(text, at)
    return not (URL if url else STANDARD).match(unescaped(m) if m else text[at : at + 5])


def openssh_length(data: bytes, start: int = 0) -> int:
    """Bytes of an OpenSSH key: three fields, a count, so many public keys and the private part; 0 if they are not all there."""
    at, left = start + len(OPENSSH), 3
    counted = False
    while left:
        if at + 4 > len(data):
            return 0
        size = int.from_bytes(data[at : at + 4], "big")
        at, left = at + 4 + size, left - 1
        if not left and not counted:
            counted, left = True, int.from_bytes(data[at : at + 4], "big") + 1
            at += 4
    return at - start if at <= len(data) else 0


def ssh_end(run: Run, place: int) -> int:
    """The end of an OpenSSH key in base64; 0 if there is none. A key that breaks off ends with its first line."""
    data, start, k = run.at(place)
    line = run.cuts[bisect_right(run.cuts, k)]
    first = (line - k) * 3 // 4
    if not ssh_key(data[start : start + first]):
        return 0
    if data.startswith(OPENSSH, start):
        if size := openssh_length(data, start):
            return run.end(k, size)
    else:
        at, n = start, 0
        while at + 4 <= len(data) and (size := int.from_bytes(data[at : at + 4], "big")) <= len(data) - at - 4:
            at, n = at + 4 + size, n + 1
            most = k + (at - start) * 4 // 3
            if n >= 2 and any(c in run.line_ends and (c - k) * 3 // 4 == at - start for c in range(most, most + 3)):
                return run.end(k, at - start)
    return int(run.tails[line - 1])


def key_spans(text: str) -> list[tuple[int, int, int]]:
    """Spans of base64 that hold a key. Every place where one could begin is tried; a run of base64 is decoded once."""
    out, at, run = [], 0, None
    while m := START.search(text, at):
        place = m.start()
        at = place + 1
        end, kind = 0, "der" if m[0][0] == "M" else "ssh"
        if run is None or place >= run.stop:
            run = Run(text, place)
        if kind == "ssh":
            end = ssh_end(run, place)
        else:
            data, start, k = run.at(place)
            if stop := der_end(data, start):
                last, chars = run.end(k, stop - start), run.raw[k : k + -(-(stop - start) * 4 // 3)]
                end = last if ends(text, last, "-" in chars or "_" in chars) else 0
        if end:
            end = PADDING.match(text, end).end()
            out.append((place, KINDS.index(kind), end))
            at = end
    return out


def hex_spans(text: str) -> list[tuple[int, int, int]]:
    """Spans of hexadecimal digits, alone or in pairs with colons or blanks between, that hold a key.

    Every byte, at both parities of a run, may begin one, and its own lengths say where it ends.
    """
    out = []
    for m in HEXRUN.finditer(text):
        apart = bool(m[1])
        step = 3 if apart else 2
        for parity in (0,) if apart else (0, 1):
            digits = m[0].replace(m[1], "") if apart else m[0][parity:]
            data = bytes.fromhex(digits[: len(digits) // 2 * 2])
            at = 0
            while (found := HEXSTART.search(data, at)) is not None:
                at, kind, size = found.start(), "der", 0
                if data[at] == 0x30:
                    size = max(0, der_end(data, at) - at)
                    size = size if size == len(data) or (size and named_start(data, at)) else 0
                elif ssh_key(data, at):
                    kind, size = "ssh", openssh_length(data, at) or _fields_length(data, at)
                if size:
                    begin = m.start() + parity + at * step
                    out.append((begin, KINDS.index(kind), begin + size * step - (step - 2)))
                at += max(1, size)
    return out


def _fields_length(data: bytes, start: int) -> int:
    """Bytes of the fields with four-byte lengths from a place on, as far as they are all there."""
    at = start + (len(OPENSSH) if data.startswith(OPENSSH, start) else 0)
    while at + 4 <= len(data) and 0 < (size := int.from_bytes(data[at : at + 4], "big")) <= len(data) - at - 4:
        at += 4 + size
    return at - start


def signed_spans(text: str) -> list[tuple[int, int, int]]:
    """Spans of signed tokens. What follows a run of letters is the same for all its places, so one look is enough."""
    out, at = [], text.find("eyJ")
    while at >= 0:
        m = SIGNED.match(text, at)
        whole = m.end() > m.end(1) and signed_header(m[0])
        if whole:
            out.append((at, 6, m.end()))
        at = text.find("eyJ", m.end() if whole else m.end(1))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, failing matches dropped after they were consumed."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def confirmed_spans(text: str) -> list[tuple[int, int, int]]:
    """Spans whose decoded content has the structure of a key or a signed token."""
    out = []
    if "-----BEGIN " in text:
        out += [(m.start(), 3, m.end()) for m in PEM.finditer(text) if key_bytes(from_base64(re.sub(r"\s|\\+[nrt]", "", ESCAPE.sub(unescaped, m[2]))))]
    if "eyJ" in text:
        out += signed_spans(text)
    out += key_spans(text)
    out += hex_spans(text)
    return sorted(set(out))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = "[secret]") -> str:
    """The text with the union of all spans replaced."""
    out, at, end = [], 0, -1
    for a, _, b in spans:
        if a >= end:
            out += [text[at:a], mark]
        end = max(end, b)
        at = end
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cleaned: bool = False) -> DataFrame:
    """Per row: id, counts of the base kinds, their digest, all spans and, if cleaned, the redacted text."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["_text"].tolist():
                base = base_spans(text)
                spans = sorted({*base, *confirmed_spans(text)})
                count = [sum(k == x for _, k, _ in base) for x in range(3)]
                row = (*count, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans))
                rows.append((*row, redact(text, spans)) if cleaned else row)
            out = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", *["cleaned"] * cleaned])
            out.insert(0, id_col, batch[id_col].to_numpy())
            yield out

    source = docs.select(F.col(id_col), text_of(text_col).alias("_text"))
    return source.mapInPandas(run, f"`{id_col}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string" + ", cleaned string" * cleaned)


def clean(docs: DataFrame) -> DataFrame:
    """Documents with their secrets replaced; documents without any stay as they are, and all columns stay."""
    names = docs.columns
    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = []
            for text in batch["text"].tolist():
                spans = sorted({*base_spans(text), *confirmed_spans(text)}) if text else []
                texts.append(redact(text, spans) if spans else text)
            yield batch.assign(text=texts)

    out = docs.mapInPandas(run, schema)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in names else out
