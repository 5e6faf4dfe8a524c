"""Deterministic writer: one fixed layout, so equal input gives equal bytes."""

from __future__ import annotations

import calendar
import re
import struct
import zlib
from copy import deepcopy

from . import names, xmlmeta
from .failure import Violation, within
from .limits import GRACE, ArchiveLimits

#: The layout's names and content: fixed values.
ROOT_PREFIX = "KRX/OCD/"
MARKER_NAME, MARKER = "KRX/OCD/mimetype", b"application/OCD+ZIP"
DOCUMENT_NAME = "KRX/OCD/Metalayer/KULDEMENY_META.xml"
PAYLOAD = "KRX/OCD/Payload/ID-"
MADE_BY, VERSION, FLAGS, ATTRIBUTES, LEVEL = 3 << 8 | 20, 20, 0x0800, 0o100644 << 16, 6
EPOCH = (0x21, 0)

_STAMP = re.compile(r"([0-9]{4})-([0-9]{2})-([0-9]{2})T([0-9]{2}):([0-9]{2}):([0-9]{2})")


def invalid(kind: str, index: int | None = None) -> Violation:
    return Violation(f"create.invalid.{kind}", attachment=index)


def dos_timestamp(year: int, month: int, day: int, hour: int, minute: int, second: int) -> tuple[int, int]:
    """MS-DOS date and time fields; seconds are halved."""
    ok = 1980 <= year <= 2107 and 1 <= month <= 12 and 1 <= day <= calendar.monthrange(year, month)[1] and hour < 24 and minute < 60 and second < 60
    if not ok or min(hour, minute, second) < 0:
        raise invalid("timestamp")
    return (year - 1980) << 9 | month << 5 | day, hour << 11 | minute << 5 | second // 2


def timestamp_of(text: str) -> tuple[int, int] | None:
    """The fields of a text of exactly 19 characters, or None."""
    m = _STAMP.fullmatch(text)
    try:
        return dos_timestamp(*map(int, m.groups())) if m else None
    except Violation:
        return None


def kilobytes(size: int) -> str:
    return str(-(-size // 1024))


def escape(text: str, index: int | None = None) -> str:
    if text != text.strip(xmlmeta.SPACE):
        raise invalid("untrimmed_text", index)
    if any(c < " " and c not in "\t\n" or c in "￾￿" for c in text):
        raise invalid("text", index)
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def unsafe_entry_name(name: str, index: int | None) -> None:
    """Refuse a name that the reader or an extraction would refuse, with the writer's own codes."""
    by_name = {"control_byte": "control_character", "backslash": "separator", "absolute_path": "separator", "drive_prefix": "colon", "directory_with_data": "empty"}
    kind = names.unsafe_name(name.encode(), True)
    kind = by_name.get(kind, kind)
    if not kind:
        kind = next((k for c in name.split("/") if (k := names.unsafe_component(c))), None)
        kind = "empty" if kind == "empty_component" else kind
    if kind:
        raise Violation(f"create.unsafe_name.{kind}", attachment=index)


def derive(spec: dict) -> dict:
    """The document that a spec gives: references and count follow from its attachments."""
    meta = deepcopy(spec["metadata"])
    if meta.get("unknown_elements"):
        raise invalid("unknown_elements")
    references = []
    for i, a in enumerate(spec["attachments"]):
        if not a["file_name"] or set(a["file_name"]) & {"/", "\\"}:
            raise Violation(f"create.unsafe_name.{'separator' if a['file_name'] else 'empty'}", attachment=i)
        unsafe_entry_name(f"{PAYLOAD}{i + 1}/{a['file_name']}", i)
        size = kilobytes(len(a["bytes"]))
        references.append({"description": a.get("description"), "number": i + 1, "file_name": a["file_name"], "size_text": size, "size_value": float(size), "location": f"{PAYLOAD}{i + 1}", "quantity": a.get("quantity"), "quantity_unit": a.get("quantity_unit")})
    dispatches = meta["dispatches"]
    if len(dispatches) > 1 or references and not dispatches:
        raise invalid("dispatch_count")
    for d in dispatches:
        given = d.get("attachments") or []
        if given and len(given) != len(references):
            raise invalid("reference_mismatch")
        for i, (x, y) in enumerate(zip(given, references)):
            if x != y:
                raise invalid("reference_mismatch", i)
        if d.get("declared_attachment_count") not in (None, len(references)):
            raise invalid("reference_mismatch")
        d |= {"attachments": references, "declared_attachment_count": len(references), "attachments_present": bool(d.get("attachments_present") or references)}
    return meta


def serialise(meta: dict) -> bytes:
    out = ['<?xml version="1.0" encoding="UTF-8" standalone="yes"?>', f'<ns2:{xmlmeta.ROOT} xmlns:ns2="{xmlmeta.NAMESPACE}">']

    def leaf(name: str, text: str, index: int | None = None) -> None:
        out.append(f"<ns2:{name}>{escape(text, index)}</ns2:{name}>")

    def wrap(name: str, inside) -> None:
        out.append(f"<ns2:{name}>")
        inside()
        out.append(f"</ns2:{name}>")

    def header() -> None:
        h = meta["header"]
        for name, key in xmlmeta.HEADER.items():
            if key == "test":
                if h["test_present"]:
                    leaf(name, "true" if h["test"] else "false")
            elif h.get(key) is not None:
                leaf(name, h[key])

    def item(a: dict, i: int) -> None:
        for name, key in xmlmeta.ATTACHMENT.items():
            if a.get(key) is not None:
                leaf(name, str(a[key]), i)

    def dispatch(d: dict) -> None:
        if d["declared_attachment_count"] is not None:
            leaf(xmlmeta.COUNT, str(d["declared_attachment_count"]))
        if d["attachments_present"] or d["attachments"]:
            wrap(xmlmeta.LIST, lambda: [wrap(xmlmeta.ITEM, lambda a=a, i=i: item(a, i)) for i, a in enumerate(d["attachments"])])
        if d["handling_instructions_unqualified"]:
            out.append(f"<{xmlmeta.INSTRUCTIONS}></{xmlmeta.INSTRUCTIONS}>")

    first, receipt, openings, dispatches, returned = xmlmeta.BLOCKS
    wrap(first, header)
    for name, flag in ((receipt, "receipt_present"), (openings, "openings_present")):
        if meta[flag]:
            wrap(name, lambda: None)
    if meta["dispatches"]:
        wrap(dispatches, lambda: [wrap(xmlmeta.DISPATCH, lambda d=d: dispatch(d)) for d in meta["dispatches"]])
    if meta["return_receipt_present"]:
        wrap(returned, lambda: None)
    out.append(f"</ns2:{xmlmeta.ROOT}>")
    return "".join(out).encode()


def assemble(entries: list[tuple[str, bytes, int]], stamp: tuple[int, int], limits: ArchiveLimits = ArchiveLimits()) -> bytes:
    """The image of (name, content, method) entries; ratio and image ceilings are checked before it is put together."""
    packed = []
    for i, (name, data, method) in enumerate(entries):
        deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
        body = deflate.compress(data) + deflate.flush() if method else data
        if len(data) > GRACE:
            within(len(data) // max(1, len(body)), limits.ratio, "create.over_limit.compression_ratio", attachment=i - 2 if i >= 2 else None)
        packed.append((name.encode(), data, body, method))
    size = sum(76 + 2 * len(n) + len(b) for n, _, b, _ in packed) + 22
    within(size, min(limits.archive, 0xFFFFFFFF), "create.over_limit.archive_bytes")
    files, directory = bytearray(), bytearray()
    for name, data, body, method in packed:
        shared = struct.pack("<5H3I2H", VERSION, FLAGS, method, stamp[1], stamp[0], zlib.crc32(data), len(body), len(data), len(name), 0)
        directory += b"PK\1\2" + struct.pack("<H", MADE_BY) + shared + struct.pack("<3H2I", 0, 0, 0, ATTRIBUTES, len(files)) + name
        files += b"PK\3\4" + shared + name + body
    end = struct.pack("<4s4H2IH", b"PK\5\6", 0, 0, len(packed), len(packed), len(directory), len(files), 0)
    return bytes(files + directory + end)


def write(spec: dict, limits: ArchiveLimits = ArchiveLimits()) -> bytes:
    """Package bytes of a spec: timestamp, metadata, attachments(file_name, bytes, description, quantity, quantity_unit)."""
    meta = derive(spec)
    entries = [(MARKER_NAME, MARKER, 0), (DOCUMENT_NAME, serialise(meta), 8)]
    entries += [(f"{PAYLOAD}{i + 1}/{a['file_name']}", a["bytes"], 8) for i, a in enumerate(spec["attachments"])]
    within(len(entries), min(limits.entries, 0xFFFF), "create.over_limit.entries")
    total = 0
    for i, (name, data, _) in enumerate(entries):
        about = {"attachment": i - 2 if i >= 2 else None}
        within(len(name.encode()), limits.name, "create.over_limit.name_bytes", **about)
        within(len(data), min(limits.entry, 0xFFFFFFFF), "create.over_limit.entry_bytes", **about)
        total += len(data)
        within(total, limits.total, "create.over_limit.total_bytes", **about)
    return assemble(entries, spec.get("timestamp") or EPOCH, limits)
