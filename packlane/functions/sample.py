"""Synthetic packages for tests and queries: plain ones, and ones that contradict themselves."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

from .xmlmeta import NAMESPACE


@dataclass
class Item:
    """An archive entry whose local and central records can be told to lie."""

    name: bytes
    data: bytes = b""
    method: int = 0
    flags: int = 0
    crc: int | None = None
    size: int | None = None
    packed: int | None = None
    made_by: int = 20
    attributes: int = 0
    local_name: bytes | None = None
    local_flags: int | None = None
    local_crc: int | None = None
    extra: bytes = b""
    central_extra: bytes = b""
    comment: bytes = b""
    disk: int = 0
    offset: int | None = None
    signature: bytes = b"PK\3\4"
    central_signature: bytes = b"PK\1\2"
    descriptor: bytes | None = None
    raw: bytes | None = None


def archive(items: list[Item], prefix: bytes = b"", gap: bytes = b"", comment: bytes = b"", suffix: bytes = b"", **end) -> bytes:
    out, directory = bytearray(prefix), bytearray()
    for e in items:
        body = e.raw if e.raw is not None else e.data
        if e.method == 8 and e.raw is None:
            z = zlib.compressobj(6, zlib.DEFLATED, -15)
            body = z.compress(e.data) + z.flush()
        crc = zlib.crc32(e.data) if e.crc is None else e.crc
        size, packed = len(e.data) if e.size is None else e.size, len(body) if e.packed is None else e.packed
        at, name = len(out) if e.offset is None else e.offset, e.name if e.local_name is None else e.local_name
        flags = e.flags if e.local_flags is None else e.local_flags
        out += e.signature + struct.pack("<5H3I2H", 20, flags, e.method, 0, 0, crc if e.local_crc is None else e.local_crc, packed, size, len(name), len(e.extra)) + name + e.extra + body + (e.descriptor or b"")
        directory += e.central_signature + struct.pack("<6H3I5H2I", e.made_by, 20, e.flags, e.method, 0, 0, crc, packed, size, len(e.name), len(e.central_extra), len(e.comment), e.disk, 0, e.attributes, at) + e.name + e.central_extra + e.comment
    out += gap
    held = {"disk": 0, "directory_disk": 0, "here": len(items), "count": len(items), "size": len(directory), "offset": len(out), "comment": len(comment)} | end
    out += directory + b"PK\5\6" + struct.pack("<4H2IH", *held.values()) + comment + suffix
    return bytes(out)


def attachment_xml(n: int, name: str, location: str) -> str:
    return f"<k:MELLEKLET><k:MELLEKLET_LEIRASA>synthetic attachment {n}</k:MELLEKLET_LEIRASA><k:CSATOLMANY_SZAMA>{n}</k:CSATOLMANY_SZAMA><k:FAJL_NEV>{name}</k:FAJL_NEV><k:MERET>12.5</k:MERET><k:ELHELYEZKEDES>{location}</k:ELHELYEZKEDES></k:MELLEKLET>"


def document_xml(attachments: list[tuple[str, str]], count: int | None = None, header: str = "", inside: str = "<KEZELESI_UTASITASOK/>", after: str = "") -> bytes:
    listed = "".join(attachment_xml(n, name, location) for n, (name, location) in enumerate(attachments, 1))
    return (
        f'<?xml version="1.0" encoding="UTF-8"?><k:KULDEMENY xmlns:k="{NAMESPACE}"><k:FEJRESZ><k:KRX_VERZIOSZAM>v0.9</k:KRX_VERZIOSZAM>'
        "<k:FORRASRENDSZER_AZONOSITO>KER</k:FORRASRENDSZER_AZONOSITO><k:KULDEMENY_AZONOSITO>SYN-0001</k:KULDEMENY_AZONOSITO>"
        "<k:KULDEMENY_LETREHOZASANAK_IDEJE>2026-01-02T03:04:05.000+01:00</k:KULDEMENY_LETREHOZASANAK_IDEJE><k:KULDEMENY_TIPUS>KULDEMENY</k:KULDEMENY_TIPUS>"
        f"<k:TESZT>false</k:TESZT>{header}</k:FEJRESZ><k:EXPEDIALASOK><k:EXPEDIALAS><k:MELLEKLETEK_SZAMA>{len(attachments) if count is None else count}</k:MELLEKLETEK_SZAMA>"
        f"<k:MELLEKLETEK>{listed}</k:MELLEKLETEK>{inside}</k:EXPEDIALAS></k:EXPEDIALASOK>{after}</k:KULDEMENY>"
    ).encode()


def package(prefix: str = "KRX/OCD/", payloads: int = 2, declared: int | None = None, document: bytes | None = None) -> bytes:
    names = [f"synthetic-{'abcdefgh'[i]}.pdf" for i in range(8)]
    refs = [(names[i], f"{prefix}Payload/ID-{i + 1}") for i in range(payloads if declared is None else declared)]
    items = [Item(b"mimetype", b"application/OCD+ZIP"), Item(f"{prefix}Metalayer/KULDEMENY_META.xml".encode(), document or document_xml(refs), 8)]
    items += [Item(f"{prefix}Payload/ID-{i + 1}/{names[i]}".encode(), f"synthetic payload {i}".encode()) for i in range(payloads)]
    return archive(items)


def goldens() -> dict[str, bytes]:
    """Five packages that together reach every class of the corpus report's self-test."""
    good = package()
    return {
        "consistent": good,
        "no-prefix": package(prefix=""),
        "missing-attachment": package(payloads=0, declared=1),
        "malformed": good[: len(good) // 2],
        "over-limit": archive([Item(f"entry-{i:04}.bin".encode(), b"x") for i in range(300)]),
    }


def written_package(files: list[tuple[str, bytes]]) -> bytes:
    """A package as the writer makes it."""
    from .zipwrite import write

    header = {"version": "v0.9", "source_system": "KER", "consignment_id": "SYN-0002", "created_at_text": "t", "consignment_kind": "NYUGTA", "test": False, "test_present": True, "barcode": None, "reference_id": None, "error_code": None, "note": None}
    dispatch = {"declared_attachment_count": None, "attachments_present": False, "handling_instructions_unqualified": False, "attachments": []}
    meta = {"header": header, "receipt_present": False, "openings_present": False, "return_receipt_present": False, "dispatches": [dispatch], "unknown_elements": 0}
    return write({"metadata": meta, "attachments": [{"file_name": n, "bytes": b} for n, b in files]})
