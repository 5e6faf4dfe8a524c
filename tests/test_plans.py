import os

import pytest
from packlane.functions import zipwrite
from packlane.functions.limits import ArchiveLimits
from packlane.functions.sample import Item, archive, document_xml, goldens, package
from packlane.operators import scan
from packlane.plans import corpus, extract, read, write
from packlane.sources import packages
from packlane.streaming import ingest

PACKAGES = "package_id string, content binary"


@pytest.fixture(scope="module")
def corpus_dir(tmp_path_factory):
    top = tmp_path_factory.mktemp("corpus")
    (top / "deep").mkdir()
    for i, (name, image) in enumerate(goldens().items()):
        (top / ("deep" if i % 2 else ".") / f"CANARY-NAME-{name}.{'krx' if i % 2 else 'KRX'}").write_bytes(image)
    (top / "other.txt").write_bytes(b"x")
    return str(top)


@pytest.fixture(scope="module")
def scanned(spark, corpus_dir):
    found, refused = packages.read(spark, corpus_dir)
    assert refused.count() == 0 and found.count() == 5
    return scan.scan(found).cache()


def test_size_filter_reaches_the_scan(spark, corpus_dir):
    found, refused = packages.read(spark, corpus_dir, limits=ArchiveLimits(archive=2000))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "LessThanOrEqual(length,2000)" in plan
    assert refused.count() >= 1 and "content" not in refused._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]


def test_report_of_the_goldens(scanned):
    got = {(r.section, r.label): r.n for r in corpus.report(scanned).collect()}
    want = {
        ("packages", "packages read"): 5,
        **{("exit_status", f"{c} exit {s}"): n for c in ("inspect", "list") for s, n in ((0, 3), (6, 1), (8, 1))},
        **{("exit_status", f"validate-structure exit {s}"): n for s, n in ((3, 1), (4, 2), (6, 1), (8, 1))},
        ("root_prefix", "KRX/OCD/"): 2,
        ("root_prefix", "none (entries start at the profile directories)"): 1,
        ("root_prefix", "not observed"): 2,
        ("file_name_casing", "upper-case stem, lower-case extension"): 3,
        ("marker", "first entry, at the archive root"): 3,
        ("payload", "ID-<n>"): 2,
        ("payload", "no payload subdirectory"): 1,
        ("entry_count", "1-4"): 3,
        ("checks", "root_prefix unresolved A19"): 1,
        ("checks", "attachment_references fail metadata.reference.missing_entry"): 1,
        ("checks", "declared_size unresolved M13"): 3,
        ("codes", "inspect archive.malformed.eocd_missing"): 1,
        ("codes", "inspect archive.over_limit.entries"): 1,
        ("categories", "limit"): 3,
        ("categories", "package"): 3,
    }
    assert {k: got.get(k) for k in want} == want
    text = " ".join(k[1] for k in got)
    for canary in ("CANARY", "SYN-0001", "synthetic", "KULDEMENY_META", "mimetype"):
        assert canary not in text


def test_checks_of_one_package(spark):
    xml = document_xml([("a.pdf", "OCD/Payload/ID-1"), ("a.pdf", "OCD/Payload/ID-1")], count=3, inside="")
    images = {
        "odd": archive([Item(b"x/mimetype"), Item(b"q/metalayer/KULDEMENY_META.xml", xml), Item(b"q/Payload/ID-1/a.pdf", b"1")]),
        "bare": archive([Item(b"a")]),
        "two": archive([Item(b"mimetype", b"no"), Item(b"a/Metalayer/KULDEMENY_META.xml"), Item(b"b/Metalayer/KULDEMENY_META.xml")]),
        "later": archive([Item(b"z"), Item(b"mimetype"), Item(b"Metalayer/KULDEMENY_META.xml", b"<x>")]),
    }
    rows = read.checks(scan.scan(spark.createDataFrame(list(images.items()), PACKAGES))).collect()
    got = {k: [(r.outcome[0], r.code or r.rule) for r in sorted(rows, key=lambda r: r.ord) if r.package_id == k] for k in images}
    n = ("n", None)
    assert got["odd"] == [("p", None), ("u", "M12"), ("u", "A19"), ("u", "A19"), ("p", None), ("p", None), n, ("u", "M14"), ("f", "metadata.count_mismatch"), ("f", "metadata.reference.duplicate"), ("u", "M13")]
    assert got["bare"] == [("f", "metadata.missing"), n, n, ("f", "metadata.malformed.marker_missing"), *[n] * 7]
    assert got["two"] == [("f", "metadata.ambiguous.multiple_candidates"), n, n, ("f", "metadata.malformed.marker_content"), *[n] * 7]
    assert got["later"][:5] == [("p", None), ("p", None), ("u", "A19"), ("f", "metadata.malformed.marker_not_first"), ("f", "metadata.malformed.namespace")] or got["later"][4][1].startswith("metadata.")


def test_inspect_list_and_envelopes(scanned):
    rows = [r for r in read.inspect(scanned).collect()]
    assert len(rows) == 3 and all(len(r.checks) == 11 for r in rows)
    assert sorted(r.declared_attachment_count for r in rows) == [1, 2, 2]
    assert {r.observations.marker for r in rows} == {"matching"}
    listed = read.listed(scanned).where("index = 0").collect()
    assert {(r.name, r.crc32, r.method) for r in listed} == {("mimetype", "10b6eee7", "stored")}
    text = [r.envelope for r in read.envelopes(read.validate(scanned), "validate-structure").collect()]
    assert len(text) == 5 and all('"command":"validate-structure"' in t for t in text)
    assert {r.line for r in read.lines(read.diagnostics(scanned, "list")).collect()} == {"error: archive.malformed.eocd_missing", "error: archive.over_limit.entries limit 256 observed 300"}


def test_extraction(spark, tmp_path):
    unix = 3 << 8 | 20
    images = {
        "good": package(),
        "link": archive([Item(b"a", b"x", made_by=unix, attributes=0xA000 << 16)]),
        "raw": archive([Item(b"\xff")]),
        "dot": archive([Item(b"a/b./c")]),
        "nfc": archive([Item("é".encode()), Item(b"k"), Item("é".encode())]),
        "conflict": archive([Item(b"a/b"), Item(b"A")]),
        "deep": archive([Item(b"/".join([b"d"] * 17))]),
        "dirs": archive([Item(b"d/"), Item(b"d/x", b"1"), Item(b"d/e/y", b"2")]),
    }
    df = spark.createDataFrame(list(images.items()), PACKAGES)
    scanned = scan.scan(df)
    items, dirs, failures = extract.plan(scanned)
    assert {(r.package_id, r.entry_index, r.code.removeprefix("extract.")) for r in failures.collect()} == {("link", 0, "unsupported.link"), ("raw", 0, "unsupported.non_utf8_name"), ("dot", 0, "unsafe_path.trailing_dot"), ("nfc", 2, "ambiguous.collision"), ("conflict", 1, "ambiguous.file_directory_conflict"), ("deep", 0, "over_limit.depth")}
    assert {r.package_id for r in items.collect()} == {"good", "dirs"}
    assert sorted(r.directory for r in dirs.where("package_id = 'dirs'").collect()) == ["d", "d/e"]
    got = {(r.package_id, r.files_written, r.directories_created, r.bytes_written, r.code) for r in extract.files(df, str(tmp_path)).collect()}
    assert got == {("good", 4, 6, 57 + len(document_xml([("synthetic-a.pdf", "KRX/OCD/Payload/ID-1"), ("synthetic-b.pdf", "KRX/OCD/Payload/ID-2")])), None), ("dirs", 2, 2, 2, None)}
    assert (tmp_path / "dirs/d/e/y").read_bytes() == b"2"
    again = {(r.package_id, r.files_written, r.code) for r in extract.files(df, str(tmp_path)).collect()}
    assert again == {("good", 0, "output.exists"), ("dirs", 0, "output.exists")}


def test_file_sink_takes_back(tmp_path):
    (tmp_path / "a").mkdir()
    os.symlink(tmp_path / "a", tmp_path / "l")
    for files, code in (([("l/x", b"")], "symlink_in_path"), ([(".packlane-incomplete/x", b"")], "exists")):
        with pytest.raises(extract.Violation) as e:
            extract.write_files(str(tmp_path), files)
        assert e.value.code == f"output.{code}"
    with pytest.raises(extract.Violation) as e:
        extract.write_files(str(tmp_path), [("n/one", b"1"), ("n/one/two", b"2")])
    assert e.value.code.startswith("output.") and sorted(os.listdir(tmp_path)) == ["a", "l"]
    with pytest.raises(extract.Violation) as e:
        extract.write_files(str(tmp_path / "none"), [])
    assert e.value.code == "output.destination_missing"


def test_create_and_repack(spark):
    header = ("v", "KER", "id", "t", "NYUGTA", False, True, None, None, None, None)
    meta = (header, False, False, False, [(None, False, False, [])], 0)
    kinds = f"package_id string, metadata struct<{scan.METADATA}>, attachments {scan.ATTACHMENTS}"
    specs = spark.createDataFrame([("p", meta, [("a.txt", b"one", "d", None, None), ("b.txt", b"two" * 600, None, "1", "db")]), ("bad", meta, [("a/b", b"", None, None, None)])], kinds)
    made = {r.package_id: r for r in write.create(specs).collect()}
    assert made["bad"].code == "create.unsafe_name.separator" and made["bad"].content is None and made["p"].code is None
    images = spark.createDataFrame([("p", bytes(made["p"].content)), ("g", package())], PACKAGES)
    assert {(r.package_id, r.summary) for r in read.validate(scan.scan(images.where("package_id = 'p'"))).collect()} == {("p", "unresolved")}
    edits = spark.createDataFrame([("p", [1], None, [("n.txt", b"new", None)], {"note": ("set", "hi")}), ("g", None, None, None, None)], write.EDITS)
    got = {r.package_id: r for r in write.repack(images, edits).collect()}
    assert got["g"].code == "repack.unsupported.marker"
    p = got["p"]
    assert (p.preserved, p.changed, p.added, p.removed, p.header_fields) == ([2], [], [2], [1], ["note"])
    back = scan.contents(spark.createDataFrame([("p", bytes(p.content))], PACKAGES), spark.createDataFrame([("p", 2), ("p", 3), ("p", 9)], "package_id string, entry_index int")).collect()
    assert {(r.entry_index, r.bytes and bytes(r.bytes), r.code) for r in back} == {(2, b"two" * 600, None), (3, b"new", None), (9, None, "archive.no_such_entry")}
    same = {r.package_id: bytes(r.content) for r in write.repack(images.where("package_id = 'p'"), spark.createDataFrame([("p", None, None, None, None)], write.EDITS)).collect()}
    assert same["p"] == bytes(made["p"].content) and zipwrite.EPOCH == (33, 0)


def test_stream(spark, corpus_dir, tmp_path):
    q = ingest.scanned(spark, corpus_dir).writeStream.format("memory").queryName("scanned_stream").outputMode("append").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("SELECT count(*) FROM scanned_stream").first()[0] == 5
    assert spark.sql("SELECT count(*) FROM scanned_stream WHERE violation IS NULL").first()[0] == 3


def nodes(df, name):
    return df._jdf.queryExecution().executedPlan().toString().count(f"{name} ") if name != "Exchange" else sum(" Exchange " in f" {x.strip(' :+-*()0123456789')} " for x in df._jdf.queryExecution().executedPlan().toString().split("\n"))


def test_each_plan_scans_once_and_shuffles_little(spark, corpus_dir):
    found, _ = packages.read(spark, corpus_dir)
    for df, shuffles in ((read.validate(scan.scan(found)), 0), (read.inspect(scan.scan(found)), 0), (read.checks(scan.scan(found)), 0), (extract.tables(found), 0), (corpus.report(scan.scan(found)), 2)):
        assert nodes(df, "MapInArrow") == 1 and nodes(df, "Exchange") <= shuffles


def test_names_are_compared_as_bytes(spark):
    images = {
        "marker": archive([Item(b"a\xff/mimetype"), Item(b"KRX/OCD/Metalayer/KULDEMENY_META.xml", document_xml([]))]),
        "document": archive([Item(b"mimetype", b"application/OCD+ZIP"), Item(b"\xff/Metalayer/KULDEMENY_META.xml", document_xml([]))]),
    }
    rows = {r.package_id: r for r in read.inspect(scan.scan(spark.createDataFrame(list(images.items()), PACKAGES))).collect()}
    assert rows["marker"].observations.marker == "prefixed" and rows["marker"].checks[3].rule == "A19"
    seen = rows["document"]
    assert [c.outcome for c in seen.checks[:3]] == ["pass", "pass", "unresolved"]
    assert (seen.observations.root_prefix, seen.observations.root_prefix_hex) == (None, "ff2f") and seen.observations.metadata_entry_name is None


def test_empty_and_null_images_are_rows(spark):
    scanned = scan.scan(spark.createDataFrame([("none", archive([])), ("null", None)], PACKAGES))
    got = {(r.section, r.label): r.n for r in corpus.report(scanned).collect()}
    assert got["marker", "no marker entry"] == got["payload", "no payload subdirectory"] == got["entry_count", "1-4"] == 1
    assert got["categories", "input"] == 3 and got["anomalies", "(none)"] == 0
    for section in ("root_prefix", "file_name_casing", "marker", "payload", "entry_count"):
        assert sum(n for (s, _), n in got.items() if s == section) == 2
