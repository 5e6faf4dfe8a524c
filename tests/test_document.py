import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from packlane.functions import cases, xmlmeta, zipscan, zipwrite
from packlane.functions.failure import Violation
from packlane.functions.limits import ArchiveLimits, DocumentLimits
from packlane.functions.sample import attachment_xml
from packlane.plans.write import apply_edits

GOOD = cases.GOOD


def code(raw, **limits):
    try:
        return xmlmeta.parse(raw if isinstance(raw, bytes) else raw.encode(), DocumentLimits(**limits))
    except Violation as v:
        return v.code.removeprefix("metadata."), v.field


def test_values():
    m = code(GOOD)
    assert m["header"]["consignment_id"] == "SYN-0001" and m["header"]["test_present"] and not m["header"]["test"]
    d = m["dispatches"][0]
    assert (d["declared_attachment_count"], d["handling_instructions_unqualified"], m["unknown_elements"]) == (2, True, 0)
    assert d["attachments"][0] == {"description": "synthetic attachment 1", "number": 1, "file_name": "a.pdf", "size_text": "12.5", "size_value": 12.5, "location": "KRX/OCD/Payload/ID-1", "quantity": None, "quantity_unit": None}
    assert xmlmeta.declared_path("x/", "f") == "x/f" and xmlmeta.declared_path("/", "f") == "f"


swap, H = cases.swap, cases.H


@pytest.mark.parametrize(("raw", "want"), cases.DOCUMENTS)
def test_codes(raw, want):
    got = code(raw)
    assert got == want if want else isinstance(got, dict), got


def test_limits():
    n = len(GOOD.encode())
    assert isinstance(code(GOOD, document=n), dict) and code(GOOD, document=n - 1)[0] == "over_limit.document_bytes"
    assert isinstance(code(GOOD, depth=6), dict) and code(GOOD, depth=5)[0] == "over_limit.depth"
    many = GOOD.count("<k:") + 1
    assert isinstance(code(GOOD, elements=many), dict) and code(GOOD, elements=many - 1)[0] == "over_limit.elements"
    wide = swap(f"<k:{H}>", f"<k:{H} {' '.join(f'a{i}=\"\"' for i in range(33))}>")
    assert code(wide)[0] == "over_limit.attributes_per_element" and isinstance(code(wide, attributes=33), dict)
    assert code(swap("v0.9", "x" * (1 << 20)))[0] == "over_limit.text_bytes"


def test_unknown_elements_are_counted():
    m = code(swap("<k:FEJRESZ>", "<x><k:y/></x><k:FEJRESZ><k:NEW/><KRX_VERZIOSZAM>q</KRX_VERZIOSZAM><k:MELLEKLET>t</k:MELLEKLET>"))
    assert m["unknown_elements"] == 3


def meta(**header):
    base = {"version": "v0.9", "source_system": "KER", "consignment_id": "1", "created_at_text": "t", "consignment_kind": "NYUGTA", "test": False, "test_present": True, "barcode": None, "reference_id": None, "error_code": None, "note": None}
    return {"header": base | header, "receipt_present": False, "openings_present": False, "return_receipt_present": False, "dispatches": [{"declared_attachment_count": None, "attachments_present": False, "handling_instructions_unqualified": False, "attachments": []}], "unknown_elements": 0}


TEXT = st.text(st.characters(codec="utf-8", exclude_characters="\r￾￿", exclude_categories=["Cs", "Cc"]), max_size=12).map(lambda s: s.strip(xmlmeta.SPACE))
NAME = st.text("abcXYZ0é -_", min_size=1, max_size=10).map(lambda s: f"f{s}z")
FILES = st.lists(st.fixed_dictionaries({"file_name": NAME, "bytes": st.binary(max_size=3000), "description": st.none() | TEXT}), max_size=5)


@settings(max_examples=64, deadline=None)
@given(TEXT, st.none() | TEXT, FILES)
def test_round_trip(note, barcode, files):
    spec = {"timestamp": (0x5A21, 7), "metadata": meta(note=note, barcode=barcode), "attachments": files}
    image = zipwrite.write(spec)
    assert image == zipwrite.write(spec)
    found = zipscan.scan(image)
    assert [found.read(i + 2) for i in range(len(files))] == [f["bytes"] for f in files]
    back = xmlmeta.parse(found.read(1))
    assert back == zipwrite.derive(spec)
    again, plan = apply_edits(image, {"timestamp": (0x5A21, 7)})
    assert again == image and plan["preserved"] == list(range(1, len(files) + 1))


@settings(max_examples=64, deadline=None)
@given(FILES, st.data())
def test_edits(files, data):
    image = zipwrite.write({"metadata": meta(), "attachments": files})
    numbers = list(range(1, len(files) + 1))
    removed = data.draw(st.lists(st.sampled_from(numbers), unique=True) if numbers else st.just([]))
    replaced = data.draw(st.lists(st.sampled_from(rest), unique=True) if (rest := [n for n in numbers if n not in removed]) else st.just([]))
    out, plan = apply_edits(image, {"remove": removed, "replace": [{"number": n, "bytes": b"new"} for n in replaced], "add": [{"file_name": "x.y", "bytes": b"added"}], "header": {"note": {"op": "set", "value": "n"}, "barcode": {"op": "clear", "value": None}}})
    found = zipscan.scan(out)
    want = [b"new" if n in replaced else files[n - 1]["bytes"] for n in numbers if n not in removed] + [b"added"]
    assert [found.read(i) for i in range(2, len(found.entries))] == want
    assert plan["header_fields"] == ["barcode", "note"] and plan["removed"] == sorted(removed) and plan["added"] == [len(want)]
    assert xmlmeta.parse(found.read(1))["header"]["note"] == "n"


@pytest.mark.parametrize(
    ("spec", "want"),
    [
        ({"metadata": meta() | {"unknown_elements": 1}}, ("invalid.unknown_elements", None)),
        ({"metadata": meta() | {"dispatches": []}, "attachments": [("a", b"")]}, ("invalid.dispatch_count", None)),
        ({"metadata": meta(note=" x")}, ("invalid.untrimmed_text", None)),
        ({"metadata": meta(note="a\rb")}, ("invalid.text", None)),
        ({"attachments": [("", b"")]}, ("unsafe_name.empty", 0)),
        ({"attachments": [("ok", b""), ("a/b", b"")]}, ("unsafe_name.separator", 1)),
        ({"attachments": [("nul.txt", b"")]}, ("unsafe_name.reserved_device_name", 0)),
        ({"attachments": [("x" * 250, b"")]}, ("over_limit.name_bytes", 0)),
        ({"attachments": [(f"n{i}", b"") for i in range(255)]}, ("over_limit.entries", None)),
        ({"attachments": [("z", bytes(300_000))]}, ("over_limit.compression_ratio", 0)),
    ],
)
def test_writer_refusals(spec, want):
    spec = {"metadata": meta(), "attachments": []} | spec
    spec["attachments"] = [{"file_name": n, "bytes": b} for n, b in spec["attachments"]]
    with pytest.raises(Violation) as e:
        zipwrite.write(spec, ArchiveLimits())
    assert (e.value.code.removeprefix("create."), e.value.attachment) == want


@pytest.mark.parametrize(
    ("edits", "want"),
    [({"remove": [3]}, ("invalid.no_such_attachment", 3)), ({"remove": [0]}, ("invalid.no_such_attachment", 0)), ({"remove": [1, 1]}, ("invalid.duplicate_target", 1)), ({"remove": [2], "replace": [{"number": 2, "bytes": b""}]}, ("invalid.duplicate_target", 2))],
)
def test_bad_targets(edits, want):
    image = zipwrite.write({"metadata": meta(), "attachments": [{"file_name": "a", "bytes": b"1"}, {"file_name": "b", "bytes": b"2"}]})
    with pytest.raises(Violation) as e:
        apply_edits(image, edits)
    assert (e.value.code.removeprefix("repack."), e.value.number) == want


def test_dates():
    assert zipwrite.timestamp_of("2026-01-02T03:04:05") == ((46 << 9) | (1 << 5) | 2, (3 << 11) | (4 << 5) | 2)
    assert [zipwrite.timestamp_of(t) for t in ("1979-12-31T00:00:00", "2025-02-29T00:00:00", "2024-02-29T23:59:60", "2024-02-29 00:00:00", "2024-02-29T00:00:00Z")] == [None] * 5
    assert attachment_xml(1, "a", "b").count("MELLEKLET_LEIRASA") == 2


def test_a_wide_tag_is_refused_in_linear_time():
    import time

    wide = swap(f"<k:{H}>", f"<k:{H} {' '.join(f'a{i}=\"\"' for i in range(100_000))} xmlns:q=\"q\">")
    assert len(wide) > 900_000
    began = time.time()
    assert code(wide)[0] == "over_limit.attributes_per_element" and time.time() - began < 2
