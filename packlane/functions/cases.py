"""Made inputs and what becomes of them, without Spark: for tests, and for queries whose SQL lists the outcomes.

A code stands without the family that all of a list share; None means accepted.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

from .sample import Item, archive, document_xml

NOISE = np.random.default_rng(7).bytes(200_000)
A = Item(b"a", b"hello")
DESCRIBED = struct.pack("<3I", zlib.crc32(b"hello"), 5, 5)

#: Images, limits, and code, entry, limit and observed value.
ARCHIVES = [
    (archive([A]), {}, None),
    (archive([]), {}, None),
    (archive([A], comment=b"x" * 1024), {}, None),
    (archive([A, Item(b"b", NOISE, 8)]), {}, None),
    (archive([Item(b"a", b"hello", flags=8, descriptor=b"PK\7\x08" + DESCRIBED)]), {}, None),
    (archive([Item(b"a", b"hello", flags=8, descriptor=DESCRIBED)]), {}, None),
    (archive([A]), {"archive": 10}, ("over_limit.archive_bytes", None, 10, len(archive([A])))),
    (b"", {}, ("malformed.eocd_missing", None, None, None)),
    (archive([A], suffix=b"z"), {}, ("malformed.trailing_bytes", None, None, None)),
    (archive([A], comment=b"PK\5\6" + bytes(18)), {}, ("ambiguous.eocd", None, None, None)),
    (archive([A], disk=1), {}, ("unsupported.multi_disk", None, None, None)),
    (archive([A], here=0), {}, ("unsupported.multi_disk", None, None, None)),
    (archive([A], here=65535, count=65535), {}, ("unsupported.zip64", None, None, None)),
    (archive([A], comment=b"x" * 1025), {}, ("over_limit.comment_bytes", None, 1024, 1025)),
    (archive([Item(b"%d" % i) for i in range(257)]), {}, ("over_limit.entries", None, 256, 257)),
    (archive([A], offset=3), {}, ("malformed.central_directory_placement", None, None, None)),
    (archive([A], here=2, count=2), {}, ("malformed.central_directory_count", 1, None, None)),
    (archive([A, Item(b"b")], here=1, count=1), {}, ("malformed.central_directory_size", None, None, None)),
    (archive([Item(b"a", central_signature=b"PK\1\3")]), {}, ("malformed.record_signature", None, None, None)),
    (archive([Item(b"a", flags=1)]), {}, ("unsupported.encryption", 0, None, 1)),
    (archive([Item(b"a", flags=0x20)]), {}, ("unsupported.patched_data", 0, None, 0x20)),
    (archive([Item(b"a", method=12)]), {}, ("unsupported.method", 0, None, 12)),
    (archive([Item(b"a", disk=2)]), {}, ("unsupported.multi_disk", 0, None, None)),
    (archive([Item(b"a", size=0xFFFFFFFF)]), {}, ("unsupported.zip64", 0, None, None)),
    (archive([Item(b"a" * 256)]), {}, ("over_limit.name_bytes", 0, 255, 256)),
    (archive([Item(b"a", central_extra=bytes(4097))]), {}, ("over_limit.extra_field_bytes", 0, 4096, 4097)),
    (archive([Item(b"a", comment=bytes(1025))]), {}, ("over_limit.comment_bytes", 0, 1024, 1025)),
    (archive([Item(b"a", central_extra=struct.pack("<HHHH", 9, 0, 1, 0))]), {}, ("unsupported.zip64", 0, None, None)),
    (archive([Item(b"")]), {}, ("unsafe_name.empty", 0, None, None)),
    (archive([Item(b"a/../b")]), {}, ("unsafe_name.parent_component", 0, None, None)),
    (archive([Item(b"d/", b"x")]), {}, ("unsafe_name.directory_with_data", 0, None, None)),
    (archive([Item(b"a", b"x", size=2)]), {}, ("malformed.declared_size_mismatch", 0, None, None)),
    (archive([Item(b"a", b"x", 8, packed=9999)]), {}, ("truncated.entry_data", 0, None, None)),
    (archive([A, A]), {}, ("ambiguous.duplicate_name", 1, None, None)),
    (archive([Item("É".encode()), Item("é".encode())]), {}, ("ambiguous.case_folded_duplicate_name", 1, None, None)),
    (archive([Item(b"a", offset=10_000)]), {}, ("truncated.local_header", 0, None, None)),
    (archive([Item(b"a", signature=b"PK\3\5")]), {}, ("malformed.record_signature", 0, None, None)),
    (archive([Item(b"a", extra=bytes(4097))]), {}, ("over_limit.extra_field_bytes", 0, 4096, 4097)),
    (archive([Item(b"a", local_name=b"b")]), {}, ("malformed.local_header_mismatch", 0, None, None)),
    (archive([Item(b"a", b"x", local_crc=7)]), {}, ("malformed.local_header_mismatch", 0, None, None)),
    (archive([Item(b"a", b"hello", flags=8, descriptor=DESCRIBED[:-1] + b"\1")]), {}, ("malformed.data_descriptor_mismatch", 0, None, None)),
    (archive([A], prefix=b"zz"), {}, ("malformed.prefix_bytes", None, None, None)),
    (archive([A], gap=b"zz"), {}, ("malformed.unclaimed_bytes", None, None, None)),
    (archive([Item(b"a", b"x", 8, raw=b"\xff\xff")]), {}, ("malformed.deflate_stream", 0, None, None)),
    (archive([Item(b"a", b"hello", 8, raw=b"\xcbH\xcd\xc9\xc9\x07\x00zz")]), {}, ("malformed.deflate_stream", 0, None, None)),
    (archive([Item(b"a", b"hello", crc=1)]), {}, ("malformed.crc_mismatch", 0, None, None)),
    (archive([Item(b"a", NOISE)]), {"entry": 199_999}, ("over_limit.entry_decoded_bytes", 0, 199_999, 200_000)),
    (archive([Item(b"n", NOISE), Item(b"o", b"hello")]), {"total": 200_004}, ("over_limit.total_decoded_bytes", 1, 200_004, 200_005)),
    (archive([Item(b"a", bytes(300_000), 8)]), {}, ("over_limit.compression_ratio", 0, 100, 131072 // len(zlib.compress(bytes(300_000), 6)[2:-4]))),
    (archive([Item(b"a", bytes(65_536), 8)]), {}, None),
    (archive([Item(b"a", b"hello", crc=1), Item(b"b", local_name=b"c")]), {}, ("malformed.local_header_mismatch", 1, None, None)),
]

GOOD = document_xml([("a.pdf", "KRX/OCD/Payload/ID-1"), ("b.pdf", "KRX/OCD/Payload/ID-2/")]).decode()


def swap(a, b):
    assert a in GOOD
    return GOOD.replace(a, b, 1)


H = "KRX_VERZIOSZAM"
#: Documents, and code and field.
DOCUMENTS = [
    (GOOD[: GOOD.index("<k:K")] + "text" + GOOD[GOOD.index("<k:K") :] + "<junk", None),
    ("﻿" + GOOD, None),
    (swap("v0.9", "<![CDATA[v0.9]]>"), None),
    (swap("v0.9", " v0.9<!-- c -->\n"), None),
    (swap("<k:TESZT>false</k:TESZT>", "<k:TESZT> 1 </k:TESZT>"), None),
    ("", ("malformed.missing_element", "KULDEMENY")),
    ("<!DOCTYPE x>" + GOOD, ("unsupported.dtd", None)),
    ("<?php x?>" + GOOD, ("unsupported.processing_instruction", None)),
    (swap("UTF-8", "latin1"), ("unsupported.encoding", None)),
    (swap("kuldemeny\"", "other\""), ("unsupported.namespace", None)),
    (GOOD.replace("k:KULDEMENY ", "k:KULD ").replace("/k:KULDEMENY>", "/k:KULD>"), ("malformed.root_element", "KULDEMENY")),
    (swap("v0.9", "&x;"), ("malformed.entity", None)),
    (swap("v0.9", "&#0;"), ("malformed.entity", None)),
    (swap("v0.9", "a & b"), ("malformed.syntax", None)),
    (swap(f"<k:{H}>", f"<q:{H}>"), ("malformed.unbound_prefix", None)),
    (swap(f"<k:{H}>", f'<k:{H} a="1" a="2">'), ("malformed.attribute", None)),
    (swap(f"<k:{H}>", f"<k:{H} a=1>"), ("malformed.attribute", None)),
    (swap(f"<k:{H}>v0.9</k:{H}>", ""), ("malformed.missing_element", H)),
    (swap(f"<k:{H}>v0.9</k:{H}>", f"<k:{H}>v</k:{H}>" * 2), ("malformed.duplicate_element", H)),
    (swap("v0.9", "<k:TESZT/>"), ("malformed.unexpected_child", H)),
    (swap("KER", "ker"), ("malformed.enumeration", "FORRASRENDSZER_AZONOSITO")),
    (swap(">2<", ">2.0<"), ("malformed.integer", "MELLEKLETEK_SZAMA")),
    (swap("false", "no"), ("malformed.boolean", "TESZT")),
    (swap("<k:EXPEDIALASOK>", "<k:TERTIVEVENY/><k:EXPEDIALASOK>"), ("malformed.element_order", "EXPEDIALASOK")),
    (swap("</k:KULDEMENY>", "<k:EXPEDIALASOK/></k:KULDEMENY>"), ("malformed.duplicate_element", "EXPEDIALASOK")),
    (swap("</k:KULDEMENY>", "</k:OTHER>"), ("malformed.syntax", None)),
    (GOOD[:-5], ("malformed.syntax", None)),
    (GOOD.encode().replace(b"v0.9", b"\xff"), ("malformed.encoding", None)),
    (swap("v0.9", "<!-- a -- b -->"), ("malformed.syntax", None)),
]

HEADER = {"version": "v", "source_system": "KER", "consignment_id": "1", "created_at": "t", "consignment_kind": "NYUGTA", "test": False}
MANIFEST = {"schema_version": 1, "timestamp": "2026-01-02T03:04:05", "metadata": HEADER, "attachments": [{"path": "x/a.pdf"}]}
#: Create requests, and code, field and attachment.
MANIFESTS = [
    (b"{", ("syntax", "/", None)),
    (b"[]", ("syntax", "/", None)),
    (b'{"schema_version": NaN}', ("syntax", "/", None)),
    (MANIFEST | {"x": 1}, ("unknown_field", "/", None)),
    ({k: v for k, v in MANIFEST.items() if k != "schema_version"}, ("missing_field", "/schema_version", None)),
    (MANIFEST | {"schema_version": "1"}, ("type", "/schema_version", None)),
    (MANIFEST | {"schema_version": 2}, ("schema_version", "/schema_version", None)),
    (MANIFEST | {"attachments": {}}, ("type", "/attachments", None)),
    (MANIFEST | {"attachments": [{"path": "a"}, {"path": 1}]}, ("type", "/attachments/path", 1)),
    (MANIFEST | {"attachments": [{"file_name": "a"}]}, ("missing_field", "/attachments/path", 0)),
    (MANIFEST | {"attachments": [{"path": "a", "y": 1}]}, ("unknown_field", "/attachments", 0)),
    (MANIFEST | {"metadata": None}, ("missing_field", "/metadata", None)),
    (MANIFEST | {"metadata": []}, ("type", "/metadata", None)),
    (MANIFEST | {"metadata": HEADER | {"source_system": "X"}}, ("enumeration", "/metadata/source_system", None)),
    (MANIFEST | {"metadata": HEADER | {"test": 1}}, ("type", "/metadata/test", None)),
    (MANIFEST | {"metadata": HEADER | {"dispatches": [{"declared_attachment_count": 1.5}]}}, ("type", "/metadata/dispatches/declared_attachment_count", None)),
    (MANIFEST | {"timestamp": "2026-02-30T00:00:00"}, ("timestamp", "/timestamp", None)),
]
EDITS = {"schema_version": 1, "timestamp": "2026-01-02T03:04:05"}
#: What is added to an edits request, and code, field and attachment.
EDIT_REQUESTS = [
    ({"metadata": {"version": None}}, ("type", "/metadata/version", None)),
    ({"metadata": {"dispatches": []}}, ("unknown_field", "/metadata", None)),
    ({"remove": [-1]}, ("type", "/remove", None)),
    ({"remove": [True]}, ("type", "/remove", None)),
    ({"replace": [{"number": "1", "path": "p"}]}, ("type", "/replace/number", None)),
    ({"replace": [{"number": 1}]}, ("missing_field", "/replace/path", 0)),
    ({"add": [{}]}, ("missing_field", "/add/path", 0)),
]
