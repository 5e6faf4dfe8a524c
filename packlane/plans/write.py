"""Write-side plans: create packages from specs, edit packages, and check what was written."""

from __future__ import annotations

from collections.abc import Iterator
from copy import deepcopy

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import xmlmeta, zipscan, zipwrite
from ..functions.failure import Violation, within
from ..functions.limits import ArchiveLimits, DocumentLimits
from ..operators import scan
from . import read


def create(specs: DataFrame, limits: ArchiveLimits = ArchiveLimits()) -> DataFrame:
    """package_id, content, code of specs; what the reader would find inconsistent is refused as an internal error.

    A package is checked in the task that packed it.
    """
    made = scan.pack(specs, limits).select("package_id", "content", F.col("violation.code").alias("refused"))
    seen = read.checked(scan.scan(made, limits, keep=("content", "refused")))
    bad = F.col("refused").isNull() & F.coalesce(F.col("verdict.summary") == "inconsistent", F.lit(True))
    return seen.select("package_id", F.when(~bad, F.col("content")).alias("content"), F.when(bad, "create.internal.self_check_failed").otherwise(F.col("refused")).alias("code"))


def _stop(kind: str, entry: int | None = None, number: int | None = None) -> Violation:
    return Violation(f"repack.{kind}", entry=entry, number=number)


def canonical(found: zipscan.Inventory, document: DocumentLimits) -> tuple[dict, list[zipscan.Entry]]:
    """The document and payload entries of a package that the writer could have written, or the first difference."""
    at = [e for e in found.entries if scan.is_candidate(e.name)]
    if len(at) != 1:
        raise _stop("unsupported.metadata_missing")
    name, head = at[0].name, found.entries[0]
    if name[: -len(b"Metalayer/KULDEMENY_META.xml")] != zipwrite.ROOT_PREFIX.encode():
        raise _stop("unsupported.root_prefix", at[0].index)
    if name != zipwrite.DOCUMENT_NAME.encode():
        raise _stop("unsupported.metadata_name", at[0].index)
    if head.name != zipwrite.MARKER_NAME.encode() or found.read(0) != zipwrite.MARKER:
        raise _stop("unsupported.marker", 0)
    if at[0].index != 1:
        raise _stop("unsupported.extra_entry", at[0].index)
    payloads = found.entries[2:]
    for e in payloads:
        file = e.name.removeprefix(f"{zipwrite.PAYLOAD}{e.index - 1}/".encode())
        if file == e.name or not file or b"/" in file or not e.row()["name_text"]:
            raise _stop("unsupported.extra_entry", e.index)
    meta = xmlmeta.parse(found.read(1), document)
    dispatches = meta["dispatches"]
    if meta["unknown_elements"]:
        raise _stop("unsupported.unknown_elements")
    if meta["receipt_present"] or meta["openings_present"] or meta["return_receipt_present"] or any(d["handling_instructions_unqualified"] for d in dispatches):
        raise _stop("unsupported.opaque_block")
    if len(dispatches) > 1:
        raise _stop("unsupported.dispatch_count")
    references = [a for d in dispatches for a in d["attachments"]]
    if len(references) != len(payloads):
        raise _stop("unsupported.attachment_entry")
    if dispatches and dispatches[0]["declared_attachment_count"] != len(references):
        raise _stop("unsupported.attachment_reference")
    for n, (a, e) in enumerate(zip(references, payloads), 1):
        if f"{zipwrite.PAYLOAD}{n}/{a['file_name']}".encode() != e.name:
            raise _stop("unsupported.attachment_entry", e.index, n)
        if (a["number"], a["location"], a["size_text"]) != (n, f"{zipwrite.PAYLOAD}{n}", zipwrite.kilobytes(e.decoded)):
            raise _stop("unsupported.attachment_reference", e.index, n)
    return meta, payloads


def place_dispatches(meta: dict, any_left: bool) -> None:
    """Dispatches as the writer derives them: one at least where attachments are left, a count of 0 where none is; a container that was there stays."""
    if any_left and not meta["dispatches"]:
        meta["dispatches"].append({"attachments_present": False, "handling_instructions_unqualified": False})
    for d in meta["dispatches"]:
        d |= {"attachments": [], "declared_attachment_count": None if any_left else 0}


def early_ceilings(attachments: list[dict], as_they_were: set[int], limits: ArchiveLimits) -> None:
    """The ceilings on entries and on the size of each supplied attachment, before anything is written."""
    within(len(attachments) + 2, min(limits.entries, 0xFFFF), "create.over_limit.entries")
    for i, a in enumerate(attachments):
        if i not in as_they_were:
            within(len(a["bytes"]), min(limits.entry, 0xFFFFFFFF), "create.over_limit.entry_bytes", attachment=i)


HEADER_KEYS = tuple(k for k in xmlmeta.HEADER.values())


def apply_edits(image: bytes, edits: dict, limits: ArchiveLimits = ArchiveLimits(), document: DocumentLimits = DocumentLimits()) -> tuple[bytes, dict]:
    """(new image, plan): edits holds remove, replace, add, header (field -> op and value) and timestamp."""
    found = zipscan.scan(image, limits)
    meta, payloads = canonical(found, document)
    references = [a for d in meta["dispatches"] for a in d["attachments"]]
    removed, replaced = list(edits.get("remove") or []), {r["number"]: r["bytes"] for r in edits.get("replace") or []}
    seen: set[int] = set()
    for n in [*removed, *(r["number"] for r in edits.get("replace") or [])]:
        if not 1 <= n <= len(payloads):
            raise _stop("invalid.no_such_attachment", number=n)
        if n in seen:
            raise _stop("invalid.duplicate_target", number=n)
        seen.add(n)
    plan: dict = {"preserved": [], "changed": [], "added": [], "removed": sorted(removed), "header_fields": []}
    kept = []
    for n, (a, e) in enumerate(zip(references, payloads), 1):
        if n in removed:
            continue
        plan["changed" if n in replaced else "preserved"].append(n)
        kept.append({**{k: a[k] for k in ("file_name", "description", "quantity", "quantity_unit")}, "bytes": replaced[n] if n in replaced else found.read(e.index, limits)})
    for a in edits.get("add") or []:
        kept.append({"description": None, "quantity": None, "quantity_unit": None} | a)
        plan["added"].append(len(kept))
    new = deepcopy(meta)
    for key in HEADER_KEYS:
        change = (edits.get("header") or {}).get(key)
        if change and change["op"] != "keep":
            plan["header_fields"].append(key)
            new["header"][key] = change["value"] if change["op"] == "set" else None
            if key == "test":
                new["header"]["test_present"] = True
    early_ceilings(kept, {i for i, n in enumerate(x for x in range(1, len(payloads) + 1) if x not in removed) if n not in replaced}, limits)
    place_dispatches(new, bool(kept))
    out = zipwrite.write({"timestamp": edits.get("timestamp"), "metadata": new, "attachments": kept}, limits)
    # what is kept must be in the result as it was
    again = zipscan.scan(out, limits).entries[2:]
    if len(again) != len(kept) or any(again[i].crc != payloads[n - 1].crc for i, n in enumerate(x for x in range(1, len(payloads) + 1) if x not in removed) if n not in replaced):
        raise _stop("invalid.inventory_mismatch")
    return out, plan


OP = "struct<op: string, value: string>"
EDIT_COLUMNS = (("remove", "array<int>"), ("replace", "array<struct<number: int, bytes: binary>>"), ("add", "array<struct<file_name: string, bytes: binary, description: string>>"), ("header", f"map<string, {OP}>"))
EDITS = ", ".join(["package_id string", *(f"{name} {kind}" for name, kind in EDIT_COLUMNS)])
REPACKED = "package_id string, content binary, preserved array<int>, changed array<int>, added array<int>, removed array<int>, header_fields array<string>, code string"


def repack(packages: DataFrame, edits: DataFrame, limits: ArchiveLimits = ArchiveLimits()) -> DataFrame:
    """Edited packages, their plans, or codes; edits as in EDITS, at most a row a package."""
    schema = scan.arrow_schema(REPACKED)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            out = []
            for row in batch.to_pylist():
                made = dict.fromkeys(schema.names) | {"package_id": row["package_id"]}
                asked = row | {"header": {k: v | {"value": v["value"] in ("true", "1")} if k == "test" else v for k, v in row["header"] or []}}
                stamp = row.get("timestamp")
                asked["timestamp"] = (stamp["date"], stamp["time"]) if stamp else None
                for part in ("replace", "add"):
                    asked[part] = [a | {"bytes": a["bytes"] or b""} for a in row[part] or []]
                try:
                    if row["content"] is None:
                        raise Violation("input.unreadable")
                    content, plan = apply_edits(row["content"], asked, limits)
                    made |= plan | {"content": content}
                except Violation as v:
                    made["code"] = v.code
                out.append(made)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)

    return packages.join(edits, "package_id").mapInArrow(run, REPACKED)
