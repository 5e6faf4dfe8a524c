"""Requests and the files that they name, joined into specs and edits: what create and repack start from.

requests(package_id, request) holds JSON documents as bytes; files(package_id,
path, content) is a listing of what they may name. Contents meet a request by
package and path in one equi-join; a request that is refused, or that names a
file which is not there, becomes a row with a code.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import requests as parse
from ..functions.failure import Violation
from ..functions.limits import ArchiveLimits
from ..operators import scan
from . import write

KEY = "package_id"
STAMP = "struct<date: int, time: int>"
FILE = "struct<path: string, file_name: string, description: string>"
MANIFEST = f"package_id string, metadata struct<{scan.METADATA}>, attachments array<{FILE}>, timestamp {STAMP}, violation struct<{scan.VIOLATION}>"
EDITS = f"package_id string, header map<string, {write.OP}>, remove array<bigint>, replace array<struct<number: bigint, path: string>>, add array<{FILE}>, timestamp {STAMP}, violation struct<{scan.VIOLATION}>"


def _parsed(requests: DataFrame, kinds: str, read: Callable[[bytes], dict]) -> DataFrame:
    schema = scan.arrow_schema(kinds)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            out = []
            for key, raw in zip(*(c.to_pylist() for c in batch.columns)):
                row = dict.fromkeys(schema.names) | {KEY: key}
                try:
                    if raw is None:
                        raise Violation("input.unreadable")
                    got = read(raw)
                    if "header" in got:
                        got["header"] = [(k, v if k != "test" else v | {"value": str(v["value"]).lower()}) for k, v in got["header"].items()]
                    row |= got | {"timestamp": dict(zip(("date", "time"), got["timestamp"]))}
                except Violation as v:
                    row["violation"] = v.row()
                out.append(row)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)

    return requests.select(KEY, F.col("request").cast("binary")).mapInArrow(run, kinds)


def manifests(requests: DataFrame) -> DataFrame:
    """A row as in MANIFEST for each create request; an invalid one holds its violation alone."""
    return _parsed(requests, MANIFEST, parse.manifest)


def edits(requests: DataFrame) -> DataFrame:
    """A row as in EDITS for each repack request."""
    return _parsed(requests, EDITS, parse.edits)


def _contents(named: DataFrame, files: DataFrame) -> DataFrame:
    """named(package_id, part, place, path, ...) with bytes, null where no file has that path."""
    return named.join(files.select(KEY, "path", F.col("content").alias("bytes"), F.lit(True).alias("there")), [KEY, "path"], "left")


def _held(parts: DataFrame, *columns: str) -> DataFrame:
    """package_id, held (what a request names, in order, with bytes) and unread (whether any of it is missing)."""
    inner = F.struct("part", "place", *columns, "bytes")
    return parts.groupBy(KEY).agg(F.array_sort(F.collect_list(inner)).alias("held"), F.bool_or(F.col("there").isNull()).alias("unread"))


def _default_name() -> Column:
    return F.coalesce("file_name", F.element_at(F.split(F.regexp_replace("path", "/+$", ""), "/", -1), -1))


def create(requests: DataFrame, files: DataFrame, limits: ArchiveLimits = ArchiveLimits()) -> DataFrame:
    """package_id, content, code: packages made from create requests."""
    asked = manifests(requests)
    named = asked.where("violation IS NULL").select(KEY, F.lit(0).alias("part"), F.posexplode("attachments").alias("place", "a")).select(KEY, "part", "place", "a.path", "a.file_name", "a.description")
    held = _held(_contents(named.withColumn("file_name", _default_name()), files), "file_name", "description")
    both = asked.join(held, KEY, "left")
    refused = F.coalesce(F.col("violation.code"), F.when(F.col("unread"), "input.unreadable"))
    bad = both.where(refused.isNotNull()).select(KEY, F.lit(None).cast("binary").alias("content"), refused.alias("code"))
    attachments = F.transform("held", lambda h: F.struct(h["file_name"].alias("file_name"), h["bytes"].alias("bytes"), h["description"].alias("description"), F.lit(None).cast("string").alias("quantity"), F.lit(None).cast("string").alias("quantity_unit")))
    specs = both.where(refused.isNull()).select(KEY, "metadata", F.coalesce(attachments, F.array().cast(scan.ATTACHMENTS)).alias("attachments"), "timestamp")
    return write.create(specs, limits).unionByName(bad)


def repack(packages: DataFrame, requests: DataFrame, files: DataFrame, limits: ArchiveLimits = ArchiveLimits()) -> DataFrame:
    """Edited packages, their plans, or codes (write.REPACKED), from edit requests."""
    asked = edits(requests)
    good = asked.where("violation IS NULL")
    replaced = good.select(KEY, F.lit(0).alias("part"), F.posexplode("replace").alias("place", "r")).select(KEY, "part", "place", "r.path", "r.number", F.lit(None).cast("string").alias("file_name"), F.lit(None).cast("string").alias("description"))
    added = good.select(KEY, F.lit(1).alias("part"), F.posexplode("add").alias("place", "a")).select(KEY, "part", "place", "a.path", F.lit(None).cast("long").alias("number"), "a.file_name", "a.description").withColumn("file_name", _default_name())
    held = _held(_contents(replaced.unionByName(added), files), "number", "file_name", "description")
    both = asked.join(held, KEY, "left").withColumn("held", F.coalesce("held", F.array().cast(held.schema["held"].dataType)))
    refused = F.coalesce(F.col("violation.code"), F.when(F.col("unread"), "input.unreadable"))
    part = lambda n: F.filter("held", lambda h: h["part"] == n)
    ready = both.where(refused.isNull()).select(
        KEY,
        F.col("remove").cast("array<int>").alias("remove"),
        F.transform(part(0), lambda h: F.struct(h["number"].cast("int").alias("number"), h["bytes"].alias("bytes"))).alias("replace"),
        F.transform(part(1), lambda h: F.struct(h["file_name"].alias("file_name"), h["bytes"].alias("bytes"), h["description"].alias("description"))).alias("add"),
        "header",
        "timestamp",
    )
    done = write.repack(packages, ready, limits)
    bad = both.where(refused.isNotNull()).select(KEY, *[F.lit(None).cast(f.dataType).alias(f.name) for f in done.schema if f.name not in (KEY, "code")], refused.alias("code"))
    return done.unionByName(bad)
