"""Images to nested rows and back: the only operators that run Python on the executors."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructType, _parse_datatype_string

from ..functions import names, xmlmeta, zipscan, zipwrite
from ..functions.failure import Violation
from ..functions.limits import ArchiveLimits, DocumentLimits

ENTRY = (
    "entry_index: int, name: binary, name_text: string, name_hex: string, utf8_flag: boolean, flags: int, method: int, method_name: string, compressed_size: bigint, declared_size: bigint, "
    "decoded_size: bigint, crc32: bigint, local_header_offset: bigint, version_made_by: int, external_attributes: bigint, kind: string, path_key: string, data_start: bigint, data_end: bigint, region_end: bigint"
)
HEADER = "version: string, source_system: string, consignment_id: string, created_at_text: string, consignment_kind: string, test: boolean, test_present: boolean, barcode: string, reference_id: string, error_code: string, note: string"
REFERENCE = "description: string, number: bigint, file_name: string, size_text: string, size_value: double, location: string, quantity: string, quantity_unit: string"
METADATA = (
    f"header: struct<{HEADER}>, receipt_present: boolean, openings_present: boolean, return_receipt_present: boolean, "
    f"dispatches: array<struct<declared_attachment_count: bigint, attachments_present: boolean, handling_instructions_unqualified: boolean, attachments: array<struct<{REFERENCE}>>>>, unknown_elements: int"
)
VIOLATION = "code: string, entry_index: int, field: string, attachment_index: int, attachment_number: bigint, limit_value: bigint, observed: bigint"
LOCATED = "entry_index: int, name: binary, prefix: binary, canonical: boolean"
SCANNED = f"package_id string, entries array<struct<{ENTRY}>>, candidates int, document struct<{LOCATED}>, metadata struct<{METADATA}>, metadata_violation struct<{VIOLATION}>, marker_content boolean, violation struct<{VIOLATION}>"
#: Images that are held at once while they are scanned.
BATCH = 64


def arrow_schema(ddl: str) -> pa.Schema:
    schema = _parse_datatype_string(ddl)
    assert isinstance(schema, StructType)
    return to_arrow_schema(schema)


def is_candidate(name: bytes) -> bool:
    """Whether the last two segments are those of the metadata document, in any ASCII case."""
    parts = name.split(b"/")
    return len(parts) >= 2 and parts[-1].lower() == b"kuldemeny_meta.xml" and parts[-2].lower() == b"metalayer"


def located(e: zipscan.Entry) -> dict:
    """The entry that holds the metadata document: its bytes, what stands before them, and whether they are spelled as they should."""
    last = len(zipwrite.DOCUMENT_NAME) - len(zipwrite.ROOT_PREFIX)
    return {"entry_index": e.index, "name": e.name, "prefix": e.name[:-last], "canonical": e.name.endswith(zipwrite.DOCUMENT_NAME.removeprefix(zipwrite.ROOT_PREFIX).encode())}


def scan_image(package_id: str, image: bytes | None, limits: ArchiveLimits, document: DocumentLimits, contents: bool = False) -> dict:
    """A row as in SCANNED; with contents also the bytes of each entry. An image that is null could not be read."""
    row = {"package_id": package_id, **dict.fromkeys(("entries", "candidates", "document", "metadata", "metadata_violation", "marker_content", "violation", "contents"))}
    try:
        if image is None:
            raise Violation("input.unreadable")
        kept: list[bytes] | None = [] if contents else None
        found = zipscan.scan(image, limits, kept)
        at = [e for e in found.entries if is_candidate(e.name)]
        read = (lambda i: found.read(i, limits)) if kept is None else kept.__getitem__
        row |= {"entries": [e.row() for e in found.entries], "candidates": len(at), "contents": kept}
        if found.entries and found.entries[0].name == b"mimetype":
            row["marker_content"] = read(0) == zipwrite.MARKER
        if len(at) == 1:
            row["document"] = located(at[0])
            try:
                row["metadata"] = xmlmeta.parse(read(at[0].index), document)
            except Violation as v:
                row["metadata_violation"] = v.row()
    except Violation as v:
        row |= {"entries": None, "violation": v.row()}
    return row


def scan(packages: DataFrame, limits: ArchiveLimits = ArchiveLimits(), document: DocumentLimits = DocumentLimits(), contents: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """One nested row for each of packages(package_id, content): SCANNED, the columns in keep, and with contents the bytes of each entry."""
    kinds = SCANNED + "".join(f", {c} {packages.schema[c].dataType.simpleString()}" for c in keep) + (", contents array<binary>" if contents else "")
    schema = arrow_schema(kinds)
    heavy = contents or "content" in keep

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for i in range(0, batch.num_rows, BATCH):
                part = batch.slice(i, BATCH)
                held = [part.column(c).to_pylist() for c in keep]
                out = []
                for j, (k, image) in enumerate(zip(part.column(0).to_pylist(), part.column(1))):
                    row = scan_image(k, image.as_py(), limits, document, contents) | {c: v[j] for c, v in zip(keep, held)}
                    if heavy:  # bytes go on a package at a time
                        yield pa.RecordBatch.from_pylist([row], schema)
                    else:
                        out.append(row)
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema)

    return packages.select("package_id", "content", *[c for c in keep if c not in ("package_id", "content")]).mapInArrow(run, kinds)


def contents(packages: DataFrame, wanted: DataFrame, limits: ArchiveLimits = ArchiveLimits()) -> DataFrame:
    """package_id, entry_index, bytes, code: some entries, wanted(package_id, entry_index), of few packages; those of all packages come from scan."""
    asked = wanted.groupBy("package_id").agg(F.sort_array(F.collect_set("entry_index")).alias("asked"))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for key, image, indices in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    if image is None:
                        raise Violation("input.unreadable")
                    found, broken = zipscan.scan(image, limits), None
                except Violation as v:
                    found, broken = None, v.code
                for i in indices:
                    data, code = None, broken
                    if found is not None:
                        try:
                            data = found.read(i, limits)
                        except Violation as v:
                            code = v.code
                    yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([i], pa.int32()), pa.array([data], pa.binary()), pa.array([code], pa.string())], ["package_id", "entry_index", "bytes", "code"])

    return packages.join(asked, "package_id").select("package_id", "content", "asked").mapInArrow(run, "package_id string, entry_index int, bytes binary, code string")


ATTACHMENTS = "array<struct<file_name: string, bytes: binary, description: string, quantity: string, quantity_unit: string>>"
WRITTEN = f"package_id string, content binary, violation struct<{VIOLATION}>"


def _spec(row: dict) -> dict:
    stamp = row.get("timestamp")
    return {"timestamp": (stamp["date"], stamp["time"]) if stamp else None, "metadata": row["metadata"], "attachments": [a | {"bytes": a["bytes"] or b""} for a in row["attachments"] or []]}


def pack(specs: DataFrame, limits: ArchiveLimits = ArchiveLimits()) -> DataFrame:
    """Package bytes of specs(package_id, metadata, attachments, timestamp?), or the first violation."""
    schema = arrow_schema(WRITTEN)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            out = []
            for row in batch.to_pylist():
                try:
                    out.append({"package_id": row["package_id"], "content": zipwrite.write(_spec(row), limits), "violation": None})
                except Violation as v:
                    out.append({"package_id": row["package_id"], "content": None, "violation": v.row()})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)

    return specs.mapInArrow(run, WRITTEN)


@F.pandas_udf(StringType())
def _normal_key(path: pd.Series) -> pd.Series:
    return path.map(names.collision_key, na_action="ignore")


@F.pandas_udf(StringType())
def _escaped(raw: pd.Series) -> pd.Series:
    return raw.map(lambda x: names.escape(bytes(x)), na_action="ignore")


def collision_key(path: Column) -> Column:
    """NFC of each component, then each character in lower case. Spark has no normalisation: what is not ASCII goes through Python."""
    plain = path.rlike(r"^[\x00-\x7f]*\z")
    return F.when(plain, F.lower(path)).otherwise(_normal_key(F.when(~plain, path)))


def terminal_safe(raw: Column) -> Column:
    """Bytes as text that is safe to show; printable ASCII of at most 200 characters is left alone without Python."""
    text = F.decode(raw, "ISO-8859-1")
    plain = text.rlike(r"^[ -~]{0,200}\z")
    return F.when(plain, text).otherwise(_escaped(F.when(~plain, raw)))


def add_keys(rows: DataFrame) -> DataFrame:
    """rows(path) with their collision key."""
    return rows.withColumn("key", collision_key(F.col("path")))
