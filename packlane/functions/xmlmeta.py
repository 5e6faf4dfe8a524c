"""Bounded reader of the metadata document: events, grammar, values.

The tokenizer is lenient where a conforming parser is not: text before the
root is skipped and nothing after the root is read. It is strict about what
could hide something: no document type, no processing instruction, no entity
beyond the five predefined ones and character references. Limits count raw
lengths before a value is unescaped and the value afterwards.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import isfinite

from .failure import Violation, within
from .limits import DocumentLimits

NAMESPACE = "http://xsd.orfk.hu/rzs/ker/kuldemeny"

#: The grammar's element names: fixed values.
ROOT = "KULDEMENY"
BLOCKS = ("FEJRESZ", "ERKEZTETES", "BONTASOK", "EXPEDIALASOK", "TERTIVEVENY")
HEADER = {
    "KRX_VERZIOSZAM": "version",
    "FORRASRENDSZER_AZONOSITO": "source_system",
    "KULDEMENY_AZONOSITO": "consignment_id",
    "KULDEMENY_LETREHOZASANAK_IDEJE": "created_at_text",
    "KULDEMENY_TIPUS": "consignment_kind",
    "TESZT": "test",
    "VONALKOD": "barcode",
    "KULDEMENY_HIVATKOZASI_AZONOSITO": "reference_id",
    "HIBAKOD": "error_code",
    "KULDEMENY_MEGJEGYZES": "note",
}
ATTACHMENT = {
    "MELLEKLET_LEIRASA": "description",
    "CSATOLMANY_SZAMA": "number",
    "FAJL_NEV": "file_name",
    "MERET": "size_text",
    "ELHELYEZKEDES": "location",
    "MENNYISEG": "quantity",
    "MENNYISEGI_EGYSEG": "quantity_unit",
}
DISPATCH, COUNT, LIST, ITEM, INSTRUCTIONS = "EXPEDIALAS", "MELLEKLETEK_SZAMA", "MELLEKLETEK", "MELLEKLET", "KEZELESI_UTASITASOK"
KNOWN = frozenset([ROOT, *BLOCKS, *HEADER, *ATTACHMENT, DISPATCH, COUNT, LIST, ITEM, INSTRUCTIONS])
SOURCES = ("NOVA", "KIR3", "KER", "POSTA", "IMAP")
KINDS = ("KULDEMENY", "NYUGTA", "EXPEDIALAS", "TERTIVEVENY", "HIBAJELZES")

#: White space of Unicode (without U+001C to U+001F, which Python also strips).
SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"

TARGET, UNBOUND, FOREIGN = "target", "unbound", "foreign"
PREDEFINED = {"amp": "&", "lt": "<", "gt": ">", "apos": "'", "quot": '"'}
_BLANK = b" \t\r\n"
_ATTRIBUTE = re.compile(rb"[ \t\r\n]*([^ \t\r\n=\"'<>/]+)[ \t\r\n]*=[ \t\r\n]*(?:\"([^\"]*)\"|'([^']*)')")
_BLANKS = re.compile(rb"[ \t\r\n]")
_TAG = re.compile(rb"(?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+>")
_INTEGER = re.compile(r"[+-]?[0-9]+")
_FLOAT = re.compile(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?")


def malformed(kind: str, field: str | None = None) -> Violation:
    return Violation(f"metadata.malformed.{kind}", field=field)


def unsupported(kind: str) -> Violation:
    return Violation(f"metadata.unsupported.{kind}")


def _text(raw: bytes) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        raise malformed("encoding") from None


def _character(reference: str) -> str:
    """What a reference without its & and ; stands for."""
    if reference in PREDEFINED:
        return PREDEFINED[reference]
    digits = reference[1:]
    base = 10
    if digits[:1] == "x":
        digits, base = digits[1:], 16
    if reference[:1] != "#" or not digits or not digits.isascii() or not all(c in "0123456789abcdefABCDEF"[: 10 if base == 10 else 22] for c in digits):
        raise malformed("entity")
    n = int(digits, base) if len(digits) < 12 else 0
    if n == 0 or n > 0x10FFFF or 0xD800 <= n <= 0xDFFF:
        raise malformed("entity")
    return chr(n)


class Events:
    """open, text, close and end events, with every limit on the way."""

    def __init__(self, raw: bytes, limits: DocumentLimits) -> None:
        within(len(raw), limits.document, "metadata.over_limit.document_bytes")
        self.raw, self.limits = raw.removeprefix(b"\xef\xbb\xbf"), limits
        self.elements = self.held = 0
        self.open: list[tuple[bytes, dict[str, str]]] = []

    def _room(self, more: int, charge: bool) -> None:
        within(self.held + more, self.limits.text, "metadata.over_limit.text_bytes")
        if charge:
            self.held += more

    def __iter__(self) -> Iterator[tuple[str, str, str]]:
        raw, at = self.raw, 0
        while at < len(raw):
            if raw[at] != 0x3C:
                end = raw.find(b"<", at)
                end = len(raw) if end < 0 else end
                yield from self._characters(raw[at:end])
                at = end
                continue
            if raw.startswith(b"<!--", at):
                end = raw.find(b"-->", at + 4)
                if end < 0 or b"--" in raw[at + 4 : end] or raw[end - 1 : end] == b"-" and end > at + 4:
                    raise malformed("syntax")
                at = end + 3
            elif raw.startswith(b"<![CDATA[", at):
                end = raw.find(b"]]>", at)
                if end < 0:
                    raise malformed("syntax")
                piece = raw[at + 9 : end]
                self._room(len(piece), False)
                yield from self._emit(_lines(_text(piece)))
                at = end + 3
            elif raw.startswith(b"<!", at):
                raise unsupported("dtd") if raw[at + 2 : at + 9].upper() == b"DOCTYPE" and raw.find(b">", at) >= 0 else malformed("syntax")
            elif raw.startswith(b"<?", at):
                end = raw.find(b"?>", at)
                if end < 0:
                    raise malformed("syntax")
                self._declaration(raw[at + 2 : end])
                at = end + 2
            elif raw.startswith(b"</", at):
                end = raw.find(b">", at)
                name = raw[at + 2 : end].rstrip(_BLANK)
                if end < 0 or not self.open or self.open[-1][0] != name:
                    raise malformed("syntax")
                self.open.pop()
                yield "close", "", ""
                at = end + 1
            else:
                end = _tag_end(raw, at)
                body = raw[at + 1 : end]
                empty = body.endswith(b"/")
                yield self._element(body[: -1 if empty else None])
                if empty:
                    self.open.pop()
                    yield "close", "", ""
                at = end + 1
        yield "end", "", ""

    def _characters(self, raw: bytes) -> Iterator[tuple[str, str, str]]:
        """Text and references, each an event of its own."""
        first, *rest = raw.split(b"&")
        for i, part in enumerate([first, *rest]):
            if i:
                name, semicolon, part = part.partition(b";")
                if not semicolon:
                    raise malformed("syntax")
                yield from self._emit(_character(_text(name)))
            if part:
                self._room(len(part), False)
                yield from self._emit(_lines(_text(part)))

    def _emit(self, text: str) -> Iterator[tuple[str, str, str]]:
        if text:
            self._room(len(text.encode()), True)
            yield "text", text, ""

    def _declaration(self, body: bytes) -> None:
        if not (body == b"xml" or body[:4] in (b"xml ", b"xml\t", b"xml\r", b"xml\n")):
            raise unsupported("processing_instruction")
        for name, value in _attributes(body[3:]):
            if name == b"encoding" and _text(value).lower() not in ("utf-8", "utf8"):
                raise unsupported("encoding")

    def _element(self, body: bytes) -> tuple[str, str, str]:
        stop = m.start() if (m := _BLANKS.search(body)) else len(body)
        name, rest = body[:stop], body[stop:]
        if not name:
            raise malformed("syntax")
        scope = dict(self.open[-1][1]) if self.open else {"xml": "http://www.w3.org/XML/1998/namespace"}
        if b"xmlns" in rest:
            for key, value in _attributes(rest, strict=False):
                if key == b"xmlns" or key.startswith(b"xmlns:"):
                    scope[key[6:].decode(errors="replace")] = value.decode(errors="replace")
        prefix, colon, local = _text(name).partition(":")
        if not colon:
            prefix, local = "", prefix
        bound = scope.get(prefix, "")
        if prefix and not bound:
            raise malformed("unbound_prefix")
        self.elements += 1
        within(self.elements, self.limits.elements, "metadata.over_limit.elements")
        self.open.append((name, scope))
        within(len(self.open), self.limits.depth, "metadata.over_limit.depth")
        found, seen = [], set()
        for key, value in _attributes(rest):
            if key in seen:
                raise malformed("attribute")
            seen.add(key)
            found.append(value)
            within(len(found), self.limits.attributes, "metadata.over_limit.attributes_per_element")
        for value in found:
            self._room(len(value), False)
            self._room(len(_unescape(value).encode()), True)
        return "open", local, TARGET if bound == NAMESPACE else FOREIGN if bound else UNBOUND


def _lines(text: str) -> str:
    return text.replace("\r\n", "\n").replace("\r", "\n")


def _unescape(raw: bytes) -> str:
    first, *rest = _text(raw).split("&")
    out = [first]
    for part in rest:
        name, semicolon, tail = part.partition(";")
        if not semicolon:
            raise malformed("entity")
        out += [_character(name), tail]
    return "".join(out)


def _attributes(raw: bytes, strict: bool = True) -> Iterator[tuple[bytes, bytes]]:
    at, end = 0, len(raw.rstrip(_BLANK))
    while at < end:
        m = _ATTRIBUTE.match(raw, at)
        if not m:
            if strict:
                raise malformed("attribute")
            return
        yield m[1], m[2] if m[2] is not None else m[3]
        at = m.end()


def _tag_end(raw: bytes, at: int) -> int:
    """Where a tag closes, leaving out what is quoted."""
    m = _TAG.match(raw, at + 1)
    if not m:
        raise malformed("syntax")
    return m.end() - 1


class Document:
    """The grammar over events."""

    def __init__(self, raw: bytes, limits: DocumentLimits) -> None:
        self.events, self.unknown = iter(Events(raw, limits)), 0

    def _next(self) -> tuple[str, str, str]:
        return next(self.events)

    def children(self) -> Iterator[tuple[str, str]]:
        """(name, binding) of each child; the caller consumes it. Text between children is dropped."""
        while True:
            kind, name, binding = self._next()
            if kind == "open":
                yield name, binding
            elif kind == "close":
                return
            elif kind == "end":
                raise malformed("syntax")

    def skip(self, unknown: bool = True) -> None:
        self.unknown += unknown
        depth = 1
        while depth:
            kind, *_ = self._next()
            if kind == "end":
                raise malformed("syntax")
            depth += {"open": 1, "close": -1}.get(kind, 0)

    def leaf(self, field: str) -> str:
        parts = []
        while True:
            kind, text, _ = self._next()
            if kind == "text":
                parts.append(text)
            elif kind == "close":
                return "".join(parts).strip(SPACE)
            else:
                raise malformed("unexpected_child", field) if kind == "open" else malformed("syntax")

    def leaves(self) -> dict[str, str]:
        """Text by name of all children that the grammar knows, wherever they belong."""
        out: dict[str, str] = {}
        for name, binding in self.children():
            if binding != TARGET or name not in KNOWN:
                self.skip()
                continue
            text = self.leaf(name)
            if name in out:
                raise malformed("duplicate_element", name)
            out[name] = text
        return out

    def read(self) -> dict:
        for kind, name, binding in self.events:
            if kind == "open":
                break
            if kind != "text":
                raise malformed("missing_element", ROOT)
        if binding != TARGET:
            raise unsupported("namespace")
        if name != ROOT:
            raise malformed("root_element", ROOT)
        seen: list[str] = []
        header, dispatches = None, []
        for name, binding in self.children():
            if binding != TARGET or name not in BLOCKS:
                self.skip()
                continue
            if name in seen:
                raise malformed("duplicate_element", name)
            if seen and BLOCKS.index(name) < BLOCKS.index(seen[-1]):
                raise malformed("element_order", name)
            seen.append(name)
            if name == BLOCKS[0]:
                header = _header(self.leaves())
            elif name == BLOCKS[3]:
                dispatches = self._list(DISPATCH, self._dispatch)
            else:
                self.skip(unknown=False)
        if header is None:
            raise malformed("missing_element", BLOCKS[0])
        return {
            "header": header, "receipt_present": BLOCKS[1] in seen, "openings_present": BLOCKS[2] in seen, "return_receipt_present": BLOCKS[4] in seen,
            "dispatches": dispatches, "unknown_elements": self.unknown,
        }

    def _list(self, item: str, read) -> list[dict]:
        out = []
        for name, binding in self.children():
            if binding == TARGET and name == item:
                out.append(read())
            else:
                self.skip()
        return out

    def _dispatch(self) -> dict:
        out = {"declared_attachment_count": None, "attachments_present": False, "handling_instructions_unqualified": False, "attachments": []}
        for name, binding in self.children():
            if binding == TARGET and name == COUNT:
                text = self.leaf(COUNT)
                if out["declared_attachment_count"] is not None:
                    raise malformed("duplicate_element", COUNT)
                out["declared_attachment_count"] = integer(text, COUNT)
            elif binding == TARGET and name == LIST:
                if out["attachments_present"]:
                    raise malformed("duplicate_element", LIST)
                out["attachments_present"] = True
                out["attachments"] = self._list(ITEM, lambda: _attachment(self.leaves()))
            elif binding == UNBOUND and name == INSTRUCTIONS:
                out["handling_instructions_unqualified"] = True
                self.skip(unknown=False)
            else:
                self.skip()
        return out


def integer(text: str, field: str) -> int:
    n = int(text) if _INTEGER.fullmatch(text) and len(text) < 400 else None
    if n is None or not -(1 << 63) <= n < 1 << 63:
        raise malformed("integer", field)
    return n


def number(text: str) -> float | None:
    value = float(text) if _FLOAT.fullmatch(text) else None
    return value if value is not None and isfinite(value) else None


def _needed(leaves: dict[str, str], name: str) -> str:
    if name not in leaves:
        raise malformed("missing_element", name)
    return leaves[name]


def _header(leaves: dict[str, str]) -> dict:
    out: dict = {}
    for name, key in HEADER.items():
        if key == "test":
            text = leaves.get(name)
            if text not in (None, "true", "1", "false", "0"):
                raise malformed("boolean", name)
            out |= {"test": text in ("true", "1"), "test_present": text is not None}
        elif key in ("barcode", "reference_id", "error_code", "note"):
            out[key] = leaves.get(name)
        else:
            out[key] = _needed(leaves, name)
            if out[key] not in {"source_system": SOURCES, "consignment_kind": KINDS}.get(key, (out[key],)):
                raise malformed("enumeration", name)
    return out


def _attachment(leaves: dict[str, str]) -> dict:
    n = integer(_needed(leaves, "CSATOLMANY_SZAMA"), "CSATOLMANY_SZAMA")
    out = {"number": n, **{k: _needed(leaves, f) for f, k in ATTACHMENT.items() if k in ("file_name", "size_text", "location")}}
    return {
        "description": leaves.get("MELLEKLET_LEIRASA"), "number": n, "file_name": out["file_name"], "size_text": out["size_text"], "size_value": number(out["size_text"]),
        "location": out["location"], "quantity": leaves.get("MENNYISEG"), "quantity_unit": leaves.get("MENNYISEGI_EGYSEG"),
    }


def parse(raw: bytes, limits: DocumentLimits = DocumentLimits()) -> dict:
    """The metadata document as nested values; raises the first Violation."""
    return Document(raw, limits).read()


def declared_path(location: str, file_name: str) -> str:
    base = location.rstrip("/")
    return f"{base}/{file_name}" if base else file_name
