"""Queries that drive the package plans: packages written from documents and read back, and made inputs with listed outcomes."""

from __future__ import annotations

import json
import os
import tempfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bridges import query
from .functions import cases, sample
from .functions.failure import Violation
from .functions.sample import Item, archive, document_xml, goldens, package
from .operators import drafts, nested, scan
from .plans import corpus, extract, read, requests, write

KEY = "package_id"
IMAGES = "package_id string, content binary"


def values(columns: str, rows: list[tuple]) -> str:
    """SQL of literal rows."""

    def literal(x) -> str:
        return "NULL" if x is None else str(x).upper() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) v({columns})"


def made(spark: SparkSession, images: dict[str, bytes]) -> DataFrame:
    return spark.createDataFrame([(k, bytes(v)) for k, v in images.items()], IMAGES)


# -- packages of documents ----------------------------------------------------------

_P = "(doc_id // 8)::VARCHAR AS package_id"
_N = "row_number() OVER (PARTITION BY doc_id // 8 ORDER BY doc_id)"
#: A documents row, what the package holds of it, and its place.
_D = f"(SELECT {_P}, doc_id, {_N} AS n, coalesce(text, '') AS text, lang FROM documents)"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.floor(F.col("doc_id") / 8).cast("string").alias(KEY), "doc_id", F.concat(F.lit("doc-"), F.col("doc_id"), F.lit(".txt")).alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content"), "lang")


def specs(docs: DataFrame) -> DataFrame:
    """A package for every 8 documents, each an attachment."""
    none = F.lit(None).cast("string")
    a = F.struct("doc_id", F.col("path").alias("file_name"), F.col("content").alias("bytes"), F.col("lang").alias("description"), none.alias("quantity"), none.alias("quantity_unit"))
    packed = docs.groupBy(KEY).agg(F.transform(F.array_sort(F.collect_list(a)), lambda x: x.dropFields("doc_id")).alias("attachments"))
    header = drafts.header(F.lit("v0.9"), F.lit("KER"), F.concat(F.lit("SYN-"), KEY), F.lit("2026-01-02T03:04:05.000+01:00"), F.lit("KULDEMENY"), test=F.lit(False))
    return packed.select(KEY, drafts.metadata(header, drafts.dispatch()).alias("metadata"), "attachments")


def written(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.pack(specs(_documents(spark, sf_dir))).select(KEY, "content")


@query(
    "roundtrip_write_scan",
    f"SELECT package_id, n + 1 AS entry_index, 'KRX/OCD/Payload/ID-' || n || '/doc-' || doc_id || '.txt' AS name, strlen(text) AS decoded_size FROM {_D}",
)
def roundtrip_write_scan(spark, sf_dir):
    e = read.entries(scan.scan(written(spark, sf_dir)))
    return e.where("entry_index > 1").select(KEY, F.col("entry_index").cast("long").alias("entry_index"), F.col("name_text").alias("name"), "decoded_size")


@query("roundtrip_checks", f"SELECT package_id, 'unresolved' AS summary, 4 AS exit_status, count(*) AS attachments FROM {_D} GROUP BY 1")
def roundtrip_checks(spark, sf_dir):
    seen = read.checked(scan.scan(written(spark, sf_dir)))
    return seen.select(KEY, "verdict.summary", "verdict.exit_status", F.size("attachments").cast("long").alias("attachments"))


@query("roundtrip_repack_identity", "SELECT DISTINCT (doc_id // 8)::VARCHAR AS package_id, TRUE AS same FROM documents")
def roundtrip_repack_identity(spark, sf_dir):
    images = written(spark, sf_dir)
    nothing = images.select(KEY, *[F.lit(None).cast(kind).alias(name) for name, kind in write.EDIT_COLUMNS])
    again = write.repack(images, nothing).select(KEY, F.col("content").alias("again"))
    return images.join(again, KEY).select(KEY, F.col("content").eqNullSafe(F.col("again")).alias("same"))


@query(
    "list_packages",
    f"""SELECT package_id, n + 1 AS "index", 'KRX/OCD/Payload/ID-' || n || '/doc-' || doc_id || '.txt' AS name, 'deflate' AS method, TRUE AS name_utf8_flag, strlen(text) AS declared_size, strlen(text) AS decoded_size FROM {_D}
    UNION ALL SELECT DISTINCT package_id, 0, 'KRX/OCD/mimetype', 'stored', TRUE, 19, 19 FROM {_D}""",
)
def list_packages(spark, sf_dir):
    return read.listed(scan.scan(written(spark, sf_dir))).where("index <> 1").select(KEY, F.col("index").cast("long").alias("index"), "name", "method", "name_utf8_flag", "declared_size", "decoded_size")


@query(
    "inspect_packages",
    f"""SELECT package_id, n AS number, 'KRX/OCD/Payload/ID-' || n || '/doc-' || doc_id || '.txt' AS declared_path, 'resolved' AS resolution, n + 1 AS entry_index, ((strlen(text) + 1023) // 1024)::VARCHAR AS size_text, strlen(text) AS observed_size,
    'SYN-' || package_id AS consignment_id, count(*) OVER (PARTITION BY package_id) AS declared, 'prefixed' AS marker, 'KRX/OCD/' AS root_prefix, 1 AS metadata_entry_index FROM {_D}""",
)
def inspect_packages(spark, sf_dir):
    seen = read.inspect(scan.scan(written(spark, sf_dir)))
    rows = seen.select(KEY, F.explode("attachments").alias("a"), "header.consignment_id", F.col("declared_attachment_count").alias("declared"), "observations.marker", "observations.root_prefix", "observations.metadata_entry_index")
    return rows.select(KEY, "a.number", "a.declared_path", "a.resolution", F.col("a.entry_index").cast("long").alias("entry_index"), "a.size_text", "a.observed_size", "consignment_id", "declared", "marker", "root_prefix", "metadata_entry_index")


@query("extract_tables", f"SELECT package_id, 'KRX/OCD/Payload/ID-' || n || '/doc-' || doc_id || '.txt' AS path, sha256(text) AS sha256 FROM {_D} UNION ALL SELECT DISTINCT package_id, 'KRX/OCD/mimetype', sha256('application/OCD+ZIP') FROM {_D}")
def extract_tables(spark, sf_dir):
    files = extract.tables(written(spark, sf_dir)).where(~F.endswith("path", F.lit(".xml")))
    return files.select(KEY, "path", F.sha2("bytes", 256).alias("sha256"))


@query("envelopes", f"SELECT DISTINCT package_id, '{{\"schema_version\":1,\"command\":\"validate-structure\",\"data\":{{\"summary\":\"unresolved\",\"unresolved_rules\":[' || CASE WHEN bool_or(lang IS NULL) OVER (PARTITION BY package_id) THEN '\"A19\",\"M11\",\"M13\"' ELSE '\"A19\",\"M13\"' END || '],\"exit_status\":4}}}}' AS envelope FROM {_D}")
def envelopes(spark, sf_dir):
    return read.envelopes(read.validate(scan.scan(written(spark, sf_dir))), "validate-structure")


# -- requests -------------------------------------------------------------------------


def _manifests(docs: DataFrame) -> DataFrame:
    """A create request for each package of documents; every seventh names a file that is not there, every ninth another version."""
    p = F.col(KEY).cast("long")
    a = F.array_sort(F.collect_list(F.struct("doc_id", "path", F.concat(F.lit("f-"), F.col("doc_id")).alias("file_name"), F.col("lang").alias("description"))))
    held = docs.groupBy(KEY).agg(F.transform(a, lambda x: x.dropFields("doc_id")).alias("attachments"))
    header = F.struct(F.lit("v0.9").alias("version"), F.lit("KER").alias("source_system"), F.col(KEY).alias("consignment_id"), F.lit("t").alias("created_at"), F.lit("NYUGTA").alias("consignment_kind"), F.lit(True).alias("test"))
    gone = F.struct(F.lit("gone").alias("path"), F.lit("gone").alias("file_name"), F.lit(None).cast("string").alias("description"))
    listed = F.when(p % 7 == 3, F.concat("attachments", F.array(gone))).otherwise(F.col("attachments"))
    body = F.struct(F.when(p % 9 == 4, 2).otherwise(1).alias("schema_version"), F.lit("2026-01-02T03:04:06").alias("timestamp"), header.alias("metadata"), listed.alias("attachments"))
    return held.select(KEY, F.to_json(body).cast("binary").alias("request"))


@query(
    "create_from_requests",
    f"""SELECT package_id, NULL AS entry_index, CASE WHEN package_id::BIGINT % 9 = 4 THEN 'manifest.invalid.schema_version' ELSE 'input.unreadable' END AS code, NULL AS name, NULL AS sha256 FROM (SELECT DISTINCT package_id FROM {_D}) WHERE package_id::BIGINT % 9 = 4 OR package_id::BIGINT % 7 = 3
    UNION ALL SELECT package_id, n + 1, NULL, 'KRX/OCD/Payload/ID-' || n || '/f-' || doc_id, sha256(text) FROM {_D} WHERE package_id::BIGINT % 9 <> 4 AND package_id::BIGINT % 7 <> 3""",
)
def create_from_requests(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    out = requests.create(_manifests(docs), docs.select(KEY, "path", "content"))
    refused = out.where("content IS NULL").select(KEY, F.lit(None).cast("long").alias("entry_index"), "code", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("sha256"))
    e = scan.scan(out.where("content IS NOT NULL"), contents=True).select(KEY, F.inline(F.arrays_zip("entries", "contents"))).where("entries.entry_index > 1")
    return refused.unionByName(e.select(KEY, F.col("entries.entry_index").cast("long").alias("entry_index"), F.lit(None).cast("string").alias("code"), F.col("entries.name_text").alias("name"), F.sha2("contents", 256).alias("sha256")))


@query(
    "repack_from_requests",
    f"""SELECT package_id, NULL AS number, 'repack.invalid.no_such_attachment' AS code, NULL AS sha256 FROM {_D} WHERE package_id::BIGINT % 5 = 1 GROUP BY 1
    UNION ALL SELECT package_id, CASE WHEN n = 1 THEN max(n) OVER (PARTITION BY package_id) ELSE n - 1 END, NULL, CASE WHEN n = 1 THEN sha256('added') WHEN n = 2 THEN sha256('replaced') ELSE sha256(text) END FROM {_D} WHERE package_id::BIGINT % 5 <> 1""",
)
def repack_from_requests(spark, sf_dir):
    images = written(spark, sf_dir)
    n, p = F.size("attachments"), F.col(KEY).cast("long")
    # the first attachment goes, the second is replaced, one is added; or one is removed that is not there
    replace = F.when(n > 1, F.array(F.struct(F.lit(2).alias("number"), F.lit("new").alias("path"))))
    body = F.struct(F.lit(1).alias("schema_version"), F.lit("2026-01-02T03:04:06").alias("timestamp"), F.array(F.when(p % 5 == 1, n + 1).otherwise(1)).alias("remove"), replace.alias("replace"), F.array(F.struct(F.lit("more").alias("path"))).alias("add"))
    asked = specs(_documents(spark, sf_dir)).select(KEY, F.to_json(body).cast("binary").alias("request"))
    files = images.select(KEY, F.explode(F.create_map(F.lit("new"), F.lit(b"replaced"), F.lit("more"), F.lit(b"added"))).alias("path", "content"))
    out = requests.repack(images, asked, files)
    refused = out.where("content IS NULL").select(KEY, F.lit(None).cast("long").alias("number"), "code", F.lit(None).cast("string").alias("sha256"))
    e = scan.scan(out.where("content IS NOT NULL"), contents=True).select(KEY, F.inline(F.arrays_zip("entries", "contents"))).where("entries.entry_index > 1")
    return refused.unionByName(e.select(KEY, (F.col("entries.entry_index") - 1).cast("long").alias("number"), F.lit(None).cast("string").alias("code"), F.sha2("contents", 256).alias("sha256")))


_REQUESTS = [*[(f"create-{i:02}", raw, "create", *want) for i, (raw, want) in enumerate(cases.MANIFESTS)], *[(f"edits-{i:02}", cases.EDITS | more, "repack", *want) for i, (more, want) in enumerate(cases.EDIT_REQUESTS)]]


@query("request_refusals", values("package_id, code, field, attachment_index", [(k, f"manifest.invalid.{code}", field, i) for k, _, _, code, field, i in _REQUESTS]))
def request_refusals(spark, sf_dir):
    raw = lambda x: x if isinstance(x, bytes) else json.dumps(x).encode()
    rows = lambda command: spark.createDataFrame([(k, raw(x)) for k, x, c, *_ in _REQUESTS if c == command], "package_id string, request binary")
    both = requests.manifests(rows("create")).select(KEY, "violation").unionByName(requests.edits(rows("repack")).select(KEY, "violation"))
    return both.select(KEY, "violation.code", "violation.field", "violation.attachment_index")


# -- refusals over made inputs ----------------------------------------------------------

_ARCHIVES = [(f"image-{i:02}", image, want) for i, (image, limits, want) in enumerate(cases.ARCHIVES) if not limits]


def _refused(want: tuple | None) -> tuple:
    """code, entry, limit and observed value; how much a compressor packs is not part of the outcome."""
    code, *rest = want or (None, None, None, None)
    return (code and f"archive.{code}", *rest[:2], None if code and code.endswith("ratio") else rest[2])


@query("archive_refusals", values("package_id, code, entry_index, limit_value, observed", [(k, *_refused(want)) for k, _, want in _ARCHIVES]))
def archive_refusals(spark, sf_dir):
    seen = scan.scan(made(spark, {k: image for k, image, _ in _ARCHIVES}))
    return seen.select(KEY, "violation.code", "violation.entry_index", "violation.limit_value", F.when(~F.endswith("violation.code", F.lit("ratio")), F.col("violation.observed")).alias("observed"))


@query("archive_limits", values("package_id, code, entry_index, limit_value, observed", [("entries", "archive.over_limit.entries", None, 2, 3), ("entry", "archive.over_limit.entry_decoded_bytes", 1, 50, 60), ("fits", None, None, None, None), ("image", "archive.over_limit.archive_bytes", None, 5000, 6111), ("name", "archive.over_limit.name_bytes", 0, 9, 10), ("total", "archive.over_limit.total_decoded_bytes", 1, 90, 96)]))
def archive_limits(spark, sf_dir):
    images = {"fits": [Item(b"a", b"x" * 48), Item(b"b", b"x" * 42)], "entries": [Item(b"a"), Item(b"b"), Item(b"c")], "entry": [Item(b"a"), Item(b"b", b"x" * 60)], "name": [Item(b"n" * 10)], "total": [Item(b"a", b"x" * 48), Item(b"b", b"x" * 48)], "image": [Item(b"a", b"x" * 6011)]}
    limits = scan.ArchiveLimits(archive=5000, entries=2, name=9, entry=50, total=90)
    return scan.scan(made(spark, {k: archive(v) for k, v in images.items()}), limits).select(KEY, "violation.code", "violation.entry_index", "violation.limit_value", "violation.observed")


_DOCUMENTS = [(f"document-{i:02}", raw if isinstance(raw, bytes) else raw.encode(), want) for i, (raw, want) in enumerate(cases.DOCUMENTS)]


@query("metadata_refusals", values("package_id, outcome, code, field", [(k, "fail" if want else "pass", want and f"metadata.{want[0]}", want and want[1]) for k, _, want in _DOCUMENTS]))
def metadata_refusals(spark, sf_dir):
    images = {k: archive([Item(b"mimetype", b"application/OCD+ZIP"), Item(b"KRX/OCD/Metalayer/KULDEMENY_META.xml", raw, 8)]) for k, raw, _ in _DOCUMENTS}
    seen = read.checked(scan.scan(made(spark, images)))
    parsed = F.element_at(F.filter("checks", lambda c: c["check"] == "metadata_parse"), 1)
    return seen.select(KEY, parsed["outcome"].alias("outcome"), parsed["code"].alias("code"), F.col("metadata_violation.field").alias("field"))


@query("metadata_limits", values("package_id, code, limit_value", [("attributes", "metadata.over_limit.attributes_per_element", 4), ("depth", "metadata.over_limit.depth", 6), ("elements", "metadata.over_limit.elements", 40), ("fits", None, None), ("text", "metadata.over_limit.text_bytes", 2000), ("whole", "metadata.over_limit.document_bytes", 6000)]))
def metadata_limits(spark, sf_dir):
    good = cases.GOOD
    deep = good.replace("<k:TESZT>", "<a><b><c><d><e/></d></c></b></a><k:TESZT>", 1)
    images = {"fits": good, "depth": deep, "elements": good.replace("<k:TESZT>", "<x/>" * 30 + "<k:TESZT>", 1), "attributes": good.replace("<k:TESZT>", '<x a="" b="" c="" d="" e=""/><k:TESZT>', 1), "text": good.replace("v0.9", "v" * 3000, 1), "whole": good + " " * 6000}
    limits = scan.DocumentLimits(document=6000, depth=6, elements=40, attributes=4, text=2000)
    rows = made(spark, {k: archive([Item(b"Metalayer/KULDEMENY_META.xml", v.encode(), 8)]) for k, v in images.items()})
    return scan.scan(rows, document=limits).select(KEY, "metadata_violation.code", "metadata_violation.limit_value")


_ODD = {
    # package: (image, checks in order: p(ass), f(ail), u(nresolved), n(ot applicable), with code or rule)
    "bytes": (archive([Item(b"a\xff/mimetype"), Item(b"\xff/Metalayer/KULDEMENY_META.xml", document_xml([]))]), "p p uA19 uA19 p p p n p n n"),
    "bare": (archive([Item(b"a")]), "fmetadata.missing n n fmetadata.malformed.marker_missing n n n n n n n"),
    "empty": (archive([]), "fmetadata.missing n n fmetadata.malformed.marker_missing n n n n n n n"),
    "two": (archive([Item(b"mimetype", b"no"), Item(b"a/Metalayer/KULDEMENY_META.xml"), Item(b"b/Metalayer/KULDEMENY_META.xml")]), "fmetadata.ambiguous.multiple_candidates n n fmetadata.malformed.marker_content n n n n n n n"),
    "later": (archive([Item(b"z"), Item(b"mimetype"), Item(b"Metalayer/KULDEMENY_META.xml", b"<x/>")]), "p p uA19 fmetadata.malformed.marker_not_first fmetadata.unsupported.namespace n n n n n n"),
    "odd": (
        archive([Item(b"x/mimetype"), Item(b"q/metalayer/KULDEMENY_META.xml", document_xml([("a.pdf", "OCD/Payload/ID-1"), ("a.pdf", "OCD/Payload/ID-1")], count=3, inside="")), Item(b"q/Payload/ID-1/a.pdf", b"1")]),
        "p uM12 uA19 uA19 p p n uM14 fmetadata.count_mismatch fmetadata.reference.duplicate uM13",
    ),
    "good": (package(), "p p p p p p p p p p uM13"),
    "absent": (package(payloads=0, declared=1), "p p p p p p p fmetadata.reference.missing_entry p p uM13"),
}
_WORDS = {"p": "pass", "f": "fail", "u": "unresolved", "n": "not_applicable"}


@query("structure_checks", values('package_id, ord, "check", outcome, code, rule', [(k, i, nested.CHECKS[i], _WORDS[c[0]], c[1:] or None if c[0] == "f" else None, c[1:] or None if c[0] == "u" else None) for k, (_, line) in _ODD.items() for i, c in enumerate(line.split())]))
def structure_checks(spark, sf_dir):
    return read.checks(scan.scan(made(spark, {k: image for k, (image, _) in _ODD.items()})))


_UNIX = 3 << 8 | 20
_PLANS = {
    "link": (archive([Item(b"a", b"x", made_by=_UNIX, attributes=0xA000 << 16)]), 0, "unsupported.link"),
    "special": (archive([Item(b"a"), Item(b"b", made_by=_UNIX, attributes=0x1000 << 16)]), 1, "unsupported.special_file"),
    "raw": (archive([Item(b"\xff")]), 0, "unsupported.non_utf8_name"),
    "dot": (archive([Item(b"a/b./c")]), 0, "unsafe_path.trailing_dot"),
    "device": (archive([Item(b"ok"), Item(b"a/LPT1.txt")]), 1, "unsafe_path.reserved_device_name"),
    "nfc": (archive([Item("é".encode()), Item(b"k"), Item("é".encode())]), 2, "ambiguous.collision"),
    "conflict": (archive([Item(b"a/b"), Item(b"A")]), 1, "ambiguous.file_directory_conflict"),
    "deep": (archive([Item(b"/".join([b"d"] * 17))]), 0, "over_limit.depth"),
    "many": (archive([Item(b"%d" % i) for i in range(5)]), 4, "over_limit.files"),
    "heavy": (archive([Item(b"a", b"x" * 60), Item(b"b", b"x" * 60)]), 1, "over_limit.total_bytes"),
    "fits": (archive([Item(b"d/"), Item(b"d/x", b"1"), Item(b"d/e/y", b"2")]), None, None),
}


@query("extract_refusals", values("package_id, entry_index, code", [(k, i, f"extract.{c}") for k, (_, i, c) in _PLANS.items() if c] + [("fits", 1, "d/x"), ("fits", 2, "d/e/y"), ("fits", None, "d"), ("fits", None, "d/e")]))
def extract_refusals(spark, sf_dir):
    items, above, failures = extract.plan(scan.scan(made(spark, {k: v[0] for k, v in _PLANS.items()})), extract.PlanLimits(files=4, total=100))
    shown = items.select(KEY, F.col("entry_index").cast("int").alias("entry_index"), F.col("path").alias("code"))
    return failures.unionByName(shown).unionByName(above.select(KEY, F.lit(None).cast("int").alias("entry_index"), F.col("directory").alias("code")))


#: What stands below the destination, the files to write, the code, and what stands there afterwards.
_SINKS = {
    "good": (["d/"], {"a/b": "1", "c": "22"}, None, "a a/b c d"),
    "exists": (["a=x"], {"a": "1"}, "output.exists", "a"),
    "not_a_directory": (["a=x"], {"a/b": "1"}, "output.not_a_directory", "a"),
    "link": (["l>."], {"l/x": "1"}, "output.symlink_in_path", "l"),
    "marker": ([".packlane-incomplete=x"], {"a": "1"}, "output.partial_marker_present", ".packlane-incomplete"),
    "own_marker": ([], {".packlane-incomplete/x": "1"}, "output.exists", ""),
    "taken_back": ([], {"n/one": "1", "n/one/two": "2"}, "output.not_a_directory", ""),
}


@query("file_sink", values("package_id, code, files_written, directories_created, bytes_written, left_there", [(k, code, *((len(files), 1, 3) if code is None else (None, None, None)), left) for k, (_, files, code, left) in _SINKS.items()]))
def file_sink(spark, sf_dir):
    kinds = "package_id string, code string, files_written int, directories_created int, bytes_written int, left_there string"
    schema = scan.arrow_schema(kinds)

    def run(rows):
        for batch in rows:
            for key in batch.column(0).to_pylist():
                there, files, _, _ = _SINKS[key]
                with tempfile.TemporaryDirectory() as root:  # gone before the row is
                    for x in there:
                        if x.endswith("/"):
                            os.mkdir(os.path.join(root, x))
                        elif ">" in x:
                            os.symlink(x.split(">")[1], os.path.join(root, x.split(">")[0]))
                        else:
                            with open(os.path.join(root, x.split("=")[0]), "w") as f:
                                f.write(x.split("=")[1])
                    row = dict.fromkeys(schema.names) | {"package_id": key}
                    try:
                        row |= extract.write_files(root, [(p, d.encode()) for p, d in files.items()])
                    except Violation as v:
                        row["code"] = v.code
                    row["left_there"] = " ".join(sorted(os.path.relpath(os.path.join(at, n), root) for at, ds, fs in os.walk(root) for n in ds + fs))
                yield pa.RecordBatch.from_pylist([row], schema)

    return spark.createDataFrame([(k,) for k in _SINKS], "package_id string").mapInArrow(run, kinds)


_SPECS = [
    ("good", [("a.txt", b"one"), ("b.txt", b"two" * 600)], {}, None, None),
    ("empty_name", [("", b"")], {}, "unsafe_name.empty", 0),
    ("separator", [("ok", b""), ("a/b", b"")], {}, "unsafe_name.separator", 1),
    ("device", [("nul.txt", b"")], {}, "unsafe_name.reserved_device_name", 0),
    ("colon", [("a:b", b"")], {}, "unsafe_name.colon", 0),
    ("long_name", [("x" * 250, b"")], {}, "over_limit.name_bytes", 0),
    ("many", [(f"n{i}", b"") for i in range(255)], {}, "over_limit.entries", None),
    ("zeros", [("z", bytes(300_000))], {}, "over_limit.compression_ratio", 0),
    ("untrimmed", [], {"note": " x"}, "invalid.untrimmed_text", None),
    ("return", [], {"note": "a\rb"}, "invalid.text", None),
    ("unknown", [], {"unknown_elements": 1}, "invalid.unknown_elements", None),
    ("no_dispatch", [("a", b"")], {"dispatches": 0}, "invalid.dispatch_count", None),
    ("declared", [("a", b"")], {"declared": 2}, "invalid.reference_mismatch", None),
]


def _spec_rows(spark: SparkSession) -> DataFrame:
    def meta(about: dict) -> tuple:
        header = ("v", "KER", "id", "t", "NYUGTA", False, True, None, None, None, about.get("note"))
        return (header, False, False, False, [(about.get("declared"), False, False, [])] * about.get("dispatches", 1), about.get("unknown_elements", 0))

    rows = [(k, meta(about), [(n, b, None, None, None) for n, b in files]) for k, files, about, _, _ in _SPECS]
    return spark.createDataFrame(rows, f"package_id string, metadata struct<{scan.METADATA}>, attachments {scan.ATTACHMENTS}")


@query("writer_refusals", values("package_id, code, attachment_index, has_content", [(k, c and f"create.{c}", i, c is None) for k, _, _, c, i in _SPECS]))
def writer_refusals(spark, sf_dir):
    made_ = scan.pack(_spec_rows(spark))
    return made_.select(KEY, "violation.code", "violation.attachment_index", F.col("content").isNotNull().alias("has_content"))


@query("create_outcomes", values("package_id, code, has_content", [(k, c and f"create.{c}", c is None) for k, _, _, c, _ in _SPECS]))
def create_outcomes(spark, sf_dir):
    return write.create(_spec_rows(spark)).select(KEY, "code", F.col("content").isNotNull().alias("has_content"))


_TWO = sample.written_package([("a", b"1"), ("b", b"2")])
_EDITS = [
    ("same", _TWO, {}, None, "1 2||||"),
    ("removed", _TWO, {"remove": [1]}, None, "2|||1|"),
    ("replaced", _TWO, {"replace": [(2, b"new")]}, None, "1|2|||"),
    ("null_bytes", _TWO, {"replace": [(2, None)]}, None, "1|2|||"),
    ("added", _TWO, {"add": [("c", b"3", "d")]}, None, "1 2||3||"),
    ("header", _TWO, {"header": {"note": ("set", "n"), "barcode": ("clear", None), "version": ("keep", None)}}, None, "1 2||||barcode note"),
    ("beyond", _TWO, {"remove": [3]}, "repack.invalid.no_such_attachment", None),
    ("twice", _TWO, {"remove": [1, 1]}, "repack.invalid.duplicate_target", None),
    ("both", _TWO, {"remove": [2], "replace": [(2, b"")]}, "repack.invalid.duplicate_target", None),
    ("too_many", _TWO, {"add": [(f"n{i}", b"", None) for i in range(253)]}, "create.over_limit.entries", None),
    ("foreign", package(), {}, "repack.unsupported.marker", None),
    ("bare", archive([Item(b"a")]), {}, "repack.unsupported.metadata_missing", None),
    ("other_prefix", package(prefix="OCD/"), {}, "repack.unsupported.root_prefix", None),
    ("broken", _TWO[:100], {}, "archive.malformed.eocd_missing", None),
    ("null", None, {}, "input.unreadable", None),
]


@query("repack_outcomes", values("package_id, code, plan", [(k, c, p) for k, _, _, c, p in _EDITS]))
def repack_outcomes(spark, sf_dir):
    images = spark.createDataFrame([(k, i) for k, i, *_ in _EDITS], IMAGES)
    edits = spark.createDataFrame([(k, e.get("remove"), e.get("replace"), e.get("add"), e.get("header")) for k, _, e, _, _ in _EDITS], write.EDITS)
    out = write.repack(images, edits)
    plan = F.concat_ws("|", *[F.array_join(F.col(c).cast("array<string>"), " ") for c in ("preserved", "changed", "added", "removed", "header_fields")])
    return out.select(KEY, "code", F.when(F.col("code").isNull(), plan).alias("plan"))


@query("diagnostic_lines", values("package_id, line", [("empty", "error: archive.malformed.eocd_missing"), ("flag", "error: archive.unsupported.encryption entry 0 observed 1"), ("gone", "error: input.unreadable"), ("many", "error: archive.over_limit.entries limit 256 observed 300")]))
def diagnostic_lines(spark, sf_dir):
    images = spark.createDataFrame([("gone", None), ("empty", b""), ("many", goldens()["over-limit"]), ("flag", archive([Item(b"a", flags=1)])), ("good", package())], IMAGES)
    return read.lines(read.diagnostics(scan.scan(images), "list"))


@query("entry_contents", values("package_id, entry_index, text, code", [("good", 0, "application/OCD+ZIP", None), ("good", 3, "synthetic payload 1", None), ("good", 9, None, "archive.no_such_entry"), ("broken", 0, None, "archive.malformed.eocd_missing"), ("gone", 0, None, "input.unreadable")]))
def entry_contents(spark, sf_dir):
    images = spark.createDataFrame([("good", package()), ("broken", package()[:50]), ("gone", None)], IMAGES)
    wanted = spark.createDataFrame([("good", 0), ("good", 3), ("good", 9), ("broken", 0), ("gone", 0)], "package_id string, entry_index int")
    return scan.contents(images, wanted).select(KEY, "entry_index", F.col("bytes").cast("string").alias("text"), "code")


@query("capabilities", values("stage, place, operation", [("reader-writer", i, o) for i, o in enumerate(["inspect", "list", "validate-structure", "extract", "create", "repack"])]))
def capabilities(spark, sf_dir):
    return read.capabilities(spark)


# -- the corpus report -------------------------------------------------------------------

_SEEN, _CASE, _ONE = "not observed", "upper-case stem, lower-case extension", "no payload subdirectory"
#: By kind of package: exit of list and inspect, of validate, code, category, checks, prefix, casing, marker, payload, entries.
_KINDS = [
    (0, 4, None, None, "p p p uA19 p p n p p p uM13", "KRX/OCD/", _CASE, "present under a directory prefix", "ID-<n>", None),
    (6, 6, "archive.malformed.eocd_missing", "package", "", _SEEN, _SEEN, _SEEN, _SEEN, _SEEN),
    (0, 3, None, None, _ODD["empty"][1], _SEEN, _SEEN, "no marker entry", _ONE, "1-4"),
    (5, 5, "input.unreadable", "input", "", _SEEN, _SEEN, _SEEN, _SEEN, _SEEN),
    (0, 4, None, None, _ODD["good"][1], "KRX/OCD/", _CASE, "first entry, at the archive root", "ID-<n>", "1-4"),
    (0, 4, None, None, "p p uA19 p p p p p p p uM13", nested.NO_PREFIX, _CASE, "first entry, at the archive root", "ID-<n>", "1-4"),
    (0, 3, None, None, _ODD["absent"][1], "KRX/OCD/", _CASE, "first entry, at the archive root", _ONE, "1-4"),
    (0, 4, None, None, _ODD["bytes"][1], _SEEN, _SEEN, "no marker entry", _ONE, "1-4"),
]


def _expected() -> list[tuple]:
    """kind, section, label of each label that a package of a kind gives, but for the entries and optional fields of kind 0."""
    out = []
    for k, (exit_, checked, code, category, checks, prefix, casing, marker, payload, entries) in enumerate(_KINDS):
        out += [(k, "packages", "packages read"), (k, "exit_status", f"inspect exit {exit_}"), (k, "exit_status", f"list exit {exit_}"), (k, "exit_status", f"validate-structure exit {checked}")]
        out += [(k, "codes", f"{c} {code}") for c in corpus.COMMANDS if code] + [(k, "categories", category) for _ in corpus.COMMANDS if code]
        out += [(k, "checks", " ".join(filter(None, (nested.CHECKS[i], _WORDS[c[0]], c[1:])))) for i, c in enumerate(checks.split()) if (k, i) != (0, 5)]
        out += [(k, "root_prefix", prefix), (k, "file_name_casing", casing), (k, "marker", marker), (k, "payload", payload)] + [(k, "entry_count", entries)] * (entries is not None)
    return out


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written packages, of which seven in eight are spoiled or replaced."""
    k, gold = F.col(KEY).cast("long") % 8, goldens()
    image = F.col("content")
    cut = F.substring(image, F.lit(1), F.floor(F.length(image) / 2).cast("int"))
    other = F.when(k == 0, image).when(k == 1, cut).when(k == 2, F.lit(archive([]))).when(k == 4, F.lit(gold["consistent"])).when(k == 5, F.lit(gold["no-prefix"])).when(k == 6, F.lit(gold["missing-attachment"])).when(k == 7, F.lit(_ODD["bytes"][0]))
    return written(spark, sf_dir).select(KEY, other.alias("content"))


@query(
    "corpus_report",
    f"""WITH p AS (SELECT package_id::BIGINT % 8 AS k, count(*) AS n, bool_or(lang IS NULL) AS bare FROM {_D} GROUP BY package_id), e AS ({values("k, section, label", _expected())}),
    l AS (SELECT section, label FROM p JOIN e USING (k) UNION ALL SELECT 'entry_count', CASE WHEN n + 2 < 5 THEN '1-4' WHEN n + 2 < 10 THEN '5-9' ELSE '10-49' END FROM p WHERE k = 0
      UNION ALL SELECT 'checks', CASE WHEN bare THEN 'schema_optional_fields unresolved M11' ELSE 'schema_optional_fields pass' END FROM p WHERE k = 0)
    SELECT section, label, count(*) AS n FROM l GROUP BY ALL UNION ALL SELECT 'anomalies', '(none)', 0""",
)
def corpus_report(spark, sf_dir):
    return corpus.report(scan.scan(_corpus(spark, sf_dir)))


@query(
    "validate_corpus",
    f"""SELECT package_id, CASE WHEN k IN (1, 3) THEN NULL WHEN k IN (2, 6) THEN 'inconsistent' ELSE 'unresolved' END AS summary, CASE k WHEN 1 THEN 6 WHEN 3 THEN 5 WHEN 2 THEN 3 WHEN 6 THEN 3 ELSE 4 END AS exit_status FROM (SELECT DISTINCT package_id, package_id::BIGINT % 8 AS k FROM {_D})""",
)
def validate_corpus(spark, sf_dir):
    return read.validate(scan.scan(_corpus(spark, sf_dir))).select(KEY, "summary", "exit_status")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roundtrip_checks(spark, sf_dir)
