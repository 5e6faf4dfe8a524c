"""Constructors of the metadata that a package spec carries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import scan

DISPATCH = f"struct<declared_attachment_count: bigint, attachments_present: boolean, handling_instructions_unqualified: boolean, attachments: array<struct<{scan.REFERENCE}>>>"


def header(version: Column, source_system: Column, consignment_id: Column, created_at: Column, consignment_kind: Column, test: Column | None = None, **more: Column) -> Column:
    """A header; without test the element is left out. more: barcode, reference_id, error_code, note."""
    optional = [more.get(k, F.lit(None)).cast("string").alias(k) for k in ("barcode", "reference_id", "error_code", "note")]
    flag = [(F.lit(False) if test is None else test).alias("test"), F.lit(test is not None).alias("test_present")]
    named = [version.alias("version"), source_system.alias("source_system"), consignment_id.alias("consignment_id"), created_at.alias("created_at_text"), consignment_kind.alias("consignment_kind")]
    return F.struct(*named, *flag, *optional).cast(f"struct<{scan.HEADER}>")


def dispatch(declared: Column | None = None) -> Column:
    """A dispatch without attachments; the writer derives them."""
    return F.struct(
        (F.lit(None) if declared is None else declared).cast("bigint").alias("declared_attachment_count"),
        F.lit(False).alias("attachments_present"),
        F.lit(False).alias("handling_instructions_unqualified"),
        F.array().cast(f"array<struct<{scan.REFERENCE}>>").alias("attachments"),
    ).cast(DISPATCH)


def metadata(header_: Column, *dispatches: Column) -> Column:
    """A document of a header and dispatches, without receipts and unknown elements."""
    no = F.lit(False)
    held = F.array(*dispatches) if dispatches else F.array()
    return F.struct(header_.alias("header"), no.alias("receipt_present"), no.alias("openings_present"), no.alias("return_receipt_present"), held.cast(f"array<{DISPATCH}>").alias("dispatches"), F.lit(0).alias("unknown_elements")).cast(f"struct<{scan.METADATA}>")
