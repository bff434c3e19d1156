"""Bytes to text: byte order marks, declared encodings, and the two editions' and versions' characters."""

from __future__ import annotations

import re

from xylem.model import XmlError

#: Names of the encodings that are read.
NAMES = {
    "utf-8": "utf-8", "utf8": "utf-8", "us-ascii": "utf-8", "ascii": "utf-8",
    "utf-16": "utf-16", "utf-16le": "utf-16-le", "utf-16be": "utf-16-be",
    "iso-8859-1": "latin-1", "latin1": "latin-1", "iso8859-1": "latin-1",
}
LEGAL_NAME = re.compile(r"[A-Za-z][A-Za-z0-9._-]*\Z")
DECLARATION = re.compile(r"<\?xml\s+version\s*=\s*(['\"])(?P<version>[^'\"]*)\1(?:\s+encoding\s*=\s*(['\"])(?P<encoding>[^'\"]*)\3)?(?:\s+standalone\s*=\s*(['\"])(?P<standalone>yes|no)\5)?\s*\?>")


def from_name(name: str) -> str | None:
    """The codec of an encoding name, whatever its case; None if it isn't read."""
    return NAMES.get(name.lower())


def is_legal_name(name: str) -> bool:
    return bool(LEGAL_NAME.match(name))


def decode(data: bytes) -> tuple[str, str]:
    """The text of a document's bytes and the codec. A byte order mark beats the declaration; a contradiction is an error."""
    bom = next((k for k, mark in (("utf-8", b"\xef\xbb\xbf"), ("utf-16-le", b"\xff\xfe"), ("utf-16-be", b"\xfe\xff")) if data.startswith(mark)), None)
    codec = bom or next((k for k, head in (("utf-16-le", b"<\x00"), ("utf-16-be", b"\x00<")) if data.startswith(head)), None)
    body = data[3 if bom == "utf-8" else 2 if bom else 0 :]
    head = body[:1024].decode(codec if codec and codec != "utf-8" else "latin-1", "replace")
    found = DECLARATION.match(head)
    declared = found["encoding"] if found else None
    if declared is not None:
        known = from_name(declared) if is_legal_name(declared) else None
        if known is None:
            raise XmlError("UnsupportedEncoding", declared)
        if codec and codec.split("-")[1] != known.split("-")[1 if known != "latin-1" else 0]:
            raise XmlError("MalformedEncoding", f"{declared} contradicts the bytes")
        if codec and known in ("utf-16-le", "utf-16-be") and known != codec:
            raise XmlError("MalformedEncoding", f"{declared} contradicts the bytes")
        if not codec:
            if known.startswith("utf-16"):
                raise XmlError("MalformedEncoding", f"{declared} contradicts the bytes")
            codec = known
    codec = codec or "utf-8"
    try:
        return body.decode(codec), codec
    except UnicodeDecodeError as e:
        raise XmlError("MalformedEncoding", str(e.reason), e.start) from None


def version_of(text: str) -> str:
    found = DECLARATION.match(text[:1024])
    return found["version"] if found else "1.0"


#: The fifth edition's name characters (the first list may start a name).
START_5 = ":A-Z_a-z\xc0-\xd6\xd8-\xf6\xf8-\u02ff\u0370-\u037d\u037f-\u1fff\u200c-\u200d\u2070-\u218f\u2c00-\u2fef\u3001-\ud7ff\uf900-\ufdcf\ufdf0-\ufffd\U00010000-\U000effff"
NAME_5 = START_5 + "\\-.0-9\xb7\u0300-\u036f\u203f-\u2040"
NCNAME = re.compile(f"[{START_5.replace(':', '')}][{NAME_5.replace(':', '')}]*\\Z")


def is_ncname(name: str) -> bool:
    return bool(NCNAME.match(name))


_MARK = "zQx{:X}xQz"
_MARKED = re.compile("zQx([0-9A-F]{1,6})xQz")


def mask(text: str, version: str, fifth: bool) -> str:
    """A text that the parser takes in place of one it refuses for its characters; unmask() what comes out.

    It stands in for name characters outside ASCII, which the parser knows by
    the fourth edition, and in version 1.1 for control characters by reference.
    """
    if _MARKED.search(text):
        return text
    if version == "1.1":
        text = text.replace("\r\n", "\n").replace("\r\x85", "\n").replace("\x85", "\n").replace("\u2028", "\n").replace("\r", "\n")

        def control(m):
            code = int(m[1], 16) if m[1] else int(m[2])
            return _MARK.format(code) if 0 < code < 32 and code not in (9, 10, 13) else m[0]

        text = re.sub(r"&#(?:x([0-9A-Fa-f]+)|([0-9]+));", control, text)
    if fifth:
        text = re.sub(f"[{NAME_5}]", lambda m: m[0] if ord(m[0]) < 128 else _MARK.format(ord(m[0])), text)
    return text


def unmask(text: str | None) -> str | None:
    if not text or "zQx" not in text:
        return text
    return _MARKED.sub(lambda m: chr(int(m[1], 16)), text)
