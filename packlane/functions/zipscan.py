"""Bounded scan of one package image: entries, or the rule that it breaks first.

The order is fixed: size, end record, directory records one by one, all local
headers, coverage, then decoding entry by entry.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field

from . import names
from .failure import Violation, within
from .limits import BUFFER, GRACE, ArchiveLimits

CENTRAL = struct.Struct("<4s6H3I5H2I")
LOCAL = struct.Struct("<4s5H3I2H")
END = struct.Struct("<4s4H2IH")
TOP16, TOP32 = 0xFFFF, 0xFFFFFFFF
STORED, DEFLATED = 0, 8
ENCRYPTED, DESCRIBED, PATCHED, UTF8 = 0x2041, 0x08, 0x20, 0x0800


@dataclass
class Entry:
    index: int
    name: bytes
    made_by: int
    flags: int
    method: int
    crc: int
    packed: int
    size: int
    attributes: int
    offset: int
    data_start: int = 0
    data_end: int = 0
    region_end: int = 0
    decoded: int = 0

    def row(self) -> dict:
        text = names.text_of(self.name)
        return {
            "entry_index": self.index, "name": self.name, "name_text": text, "name_hex": None if text is not None else self.name.hex(), "utf8_flag": bool(self.flags & UTF8),
            "flags": self.flags, "method": self.method, "method_name": "stored" if self.method == STORED else "deflate", "compressed_size": self.packed, "declared_size": self.size,
            "decoded_size": self.decoded, "crc32": self.crc, "local_header_offset": self.offset, "version_made_by": self.made_by, "external_attributes": self.attributes,
            "kind": names.kind(self.made_by, self.attributes, self.name), "path_key": None if text is None else names.collision_key(text), "data_start": self.data_start, "data_end": self.data_end, "region_end": self.region_end,
        }


@dataclass
class Inventory:
    image: bytes
    entries: list[Entry] = field(default_factory=list)

    def named(self, name: bytes) -> Entry | None:
        return next((e for e in self.entries if e.name == name), None)

    def read(self, index: int, limits: ArchiveLimits = ArchiveLimits()) -> bytes:
        """Content of one entry, decoded again within the limits."""
        if not 0 <= index < len(self.entries):
            raise Violation("archive.no_such_entry", entry=index)
        out: list[bytes] = []
        _decode(self.image, self.entries[index], 0, limits, out)
        return b"".join(out)


def scan(image: bytes, limits: ArchiveLimits = ArchiveLimits(), contents: list[bytes] | None = None) -> Inventory:
    """The inventory of an image; raises the first Violation. What is decoded on the way goes to contents where it is given."""
    within(len(image), limits.archive, "archive.over_limit.archive_bytes")
    start, count, directory = _end_record(image, limits)
    found = Inventory(image, _directory(image, directory, start, count, limits))
    for e in found.entries:
        _local(image, e, limits)
    _coverage(found.entries, directory)
    total = 0
    for e in found.entries:
        pieces: list[bytes] | None = None if contents is None else []
        e.decoded = _decode(image, e, total, limits, pieces)
        total += e.decoded
        if contents is not None:
            contents.append(b"".join(pieces or []))
    return found


def _end_record(image: bytes, limits: ArchiveLimits) -> tuple[int, int, int]:
    at, seen, last = image.find(b"PK\5\6"), False, []
    while at >= 0:
        seen = True
        if at + END.size <= len(image) and at + END.size + int.from_bytes(image[at + 20 : at + 22], "little") == len(image):
            last.append(at)
            if len(last) == 2:
                raise Violation("archive.ambiguous.eocd")
        at = image.find(b"PK\5\6", at + 1)
    if not last:
        raise Violation("archive.malformed.trailing_bytes" if seen else "archive.malformed.eocd_missing")
    at = last[0]
    _, disk, directory_disk, here, count, size, offset, comment = END.unpack_from(image, at)
    if at >= 4 and image[at - 4 : at] == b"PK\6\7":
        raise Violation("archive.unsupported.zip64")
    if disk or directory_disk or here != count:
        raise Violation("archive.unsupported.multi_disk")
    if count == TOP16 or TOP32 in (size, offset):
        raise Violation("archive.unsupported.zip64")
    within(comment, limits.comment, "archive.over_limit.comment_bytes")
    within(count, limits.entries, "archive.over_limit.entries")
    if offset + size != at:
        raise Violation("archive.malformed.central_directory_placement")
    return at, count, offset


def _directory(image: bytes, at: int, end: int, count: int, limits: ArchiveLimits) -> list[Entry]:
    out, raw, folded = [], set(), set()
    for i in range(count):
        if at == end:
            raise Violation("archive.malformed.central_directory_count", entry=i)
        e, at = _record(image, at, end, i, limits)
        fold = names.fold_name(e.name)
        if e.name in raw:
            raise Violation("archive.ambiguous.duplicate_name", entry=i)
        if fold in folded:
            raise Violation("archive.ambiguous.case_folded_duplicate_name", entry=i)
        raw.add(e.name)
        folded.add(fold)
        out.append(e)
    if at != end:
        raise Violation("archive.malformed.central_directory_size")
    return out


def _record(image: bytes, at: int, end: int, i: int, limits: ArchiveLimits) -> tuple[Entry, int]:
    if end - at < 4:
        raise Violation("archive.truncated.central_directory")
    if image[at : at + 4] != b"PK\1\2":
        raise Violation("archive.malformed.record_signature")
    if end - at < CENTRAL.size:
        raise Violation("archive.truncated.central_directory")
    _, made_by, _, flags, method, _, _, crc, packed, size, n_name, n_extra, n_comment, disk, _, attributes, offset = CENTRAL.unpack_from(image, at)
    if flags & ENCRYPTED:
        raise Violation("archive.unsupported.encryption", entry=i, observed=flags)
    if flags & PATCHED:
        raise Violation("archive.unsupported.patched_data", entry=i, observed=flags)
    if method not in (STORED, DEFLATED):
        raise Violation("archive.unsupported.method", entry=i, observed=method)
    if disk:
        raise Violation("archive.unsupported.multi_disk", entry=i)
    if TOP32 in (packed, size, offset):
        raise Violation("archive.unsupported.zip64", entry=i)
    within(n_name, limits.name, "archive.over_limit.name_bytes", entry=i)
    within(n_extra, limits.extra, "archive.over_limit.extra_field_bytes", entry=i)
    within(n_comment, limits.comment, "archive.over_limit.comment_bytes", entry=i)
    body = at + CENTRAL.size
    stop = body + n_name + n_extra + n_comment
    if stop > end:
        raise Violation("archive.truncated.central_directory")
    name = image[body : body + n_name]
    if _has_zip64(image[body + n_name : body + n_name + n_extra]):
        raise Violation("archive.unsupported.zip64", entry=i)
    if unsafe := names.unsafe_name(name, bool(size or packed)):
        raise Violation(f"archive.unsafe_name.{unsafe}", entry=i)
    if method == STORED and packed != size:
        raise Violation("archive.malformed.declared_size_mismatch", entry=i)
    if packed > len(image):
        raise Violation("archive.truncated.entry_data", entry=i)
    return Entry(i, name, made_by, flags, method, crc, packed, size, attributes, offset), stop


def _has_zip64(extra: bytes) -> bool:
    at = 0
    while at + 4 <= len(extra):
        tag, size = struct.unpack_from("<HH", extra, at)
        if tag == 1:
            return True
        at += 4 + size
    return False


def _local(image: bytes, e: Entry, limits: ArchiveLimits) -> None:
    short = Violation("archive.truncated.local_header", entry=e.index)
    if e.offset + 4 > len(image):
        raise short
    if image[e.offset : e.offset + 4] != b"PK\3\4":
        raise Violation("archive.malformed.record_signature", entry=e.index)
    if e.offset + LOCAL.size > len(image):
        raise short
    _, _, flags, method, _, _, crc, packed, size, n_name, n_extra = LOCAL.unpack_from(image, e.offset)
    within(n_extra, limits.extra, "archive.over_limit.extra_field_bytes", entry=e.index)
    body = e.offset + LOCAL.size
    e.data_start = body + n_name + n_extra
    if e.data_start > len(image):
        raise short
    own, zero = (e.crc, e.packed, e.size), (0, 0, 0)
    same = (flags, method, image[body : body + n_name]) == (e.flags, e.method, e.name)
    if not same or (crc, packed, size) not in ((own, zero) if flags & DESCRIBED else (own,)):
        raise Violation("archive.malformed.local_header_mismatch", entry=e.index)
    e.data_end = e.region_end = e.data_start + e.packed
    if e.data_end > len(image):
        raise Violation("archive.truncated.entry_data", entry=e.index)
    if flags & DESCRIBED:
        at = e.data_end + 4 * (image[e.data_end : e.data_end + 4] == b"PK\7\x08")
        if at + 12 > len(image):
            raise Violation("archive.truncated.data_descriptor", entry=e.index)
        if struct.unpack_from("<3I", image, at) != own:
            raise Violation("archive.malformed.data_descriptor_mismatch", entry=e.index)
        e.region_end = at + 12


def _coverage(entries: list[Entry], directory: int) -> None:
    """Regions must tile what lies before the directory."""
    reached = 0
    for start, end in [*sorted((e.offset, e.region_end) for e in entries), (directory, directory)]:
        if start < reached:
            raise Violation("archive.malformed.overlapping_ranges")
        if start > reached:
            raise Violation("archive.malformed.unclaimed_bytes" if reached else "archive.malformed.prefix_bytes")
        reached = end


def _chunks(image: bytes, e: Entry):
    if e.method == STORED:
        for at in range(e.data_start, e.data_end, BUFFER):
            yield image[at : min(e.data_end, at + BUFFER)]
        return
    broken = Violation("archive.malformed.deflate_stream", entry=e.index)
    stream, left = zlib.decompressobj(-15), image[e.data_start : e.data_end]
    while not stream.eof:
        try:
            piece = stream.decompress(left, BUFFER)
        except zlib.error:
            raise broken from None
        if piece:
            yield piece
        elif not stream.eof and len(stream.unconsumed_tail) == len(left):
            raise broken
        left = stream.unconsumed_tail
    if stream.unused_data:
        raise broken


def _decode(image: bytes, e: Entry, before: int, limits: ArchiveLimits, out: list[bytes] | None) -> int:
    done = crc = 0
    for piece in _chunks(image, e):
        done += len(piece)
        if done > e.size:
            raise Violation("archive.malformed.declared_size_mismatch", entry=e.index)
        within(done, limits.entry, "archive.over_limit.entry_decoded_bytes", entry=e.index)
        within(before + done, limits.total, "archive.over_limit.total_decoded_bytes", entry=e.index)
        if done > GRACE:
            within(done // max(1, e.packed), limits.ratio, "archive.over_limit.compression_ratio", entry=e.index)
        crc = zlib.crc32(piece, crc)
        if out is not None:
            out.append(piece)
    if done != e.size:
        raise Violation("archive.malformed.declared_size_mismatch", entry=e.index)
    if crc != e.crc:
        raise Violation("archive.malformed.crc_mismatch", entry=e.index)
    return done
