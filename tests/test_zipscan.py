import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from packlane.functions import cases, codes, names, zipscan
from packlane.functions.failure import Violation
from packlane.functions.limits import ArchiveLimits
from packlane.functions.sample import Item, archive, package

A = Item(b"a", b"hello")


def code(image, **limits):
    try:
        zipscan.scan(image, ArchiveLimits(**limits))
    except Violation as v:
        assert v.code in codes.CODES
        return v.code.removeprefix("archive."), v.entry, v.limit, v.observed
    return None


@pytest.mark.parametrize(("image", "limits", "want"), cases.ARCHIVES)
def test_first_violation(image, limits, want):
    got = code(image, **limits)
    assert got == want or want and want[0].endswith("ratio") and got[:3] == want[:3]


def test_overlap():
    one = archive([A])
    body = one[: one.index(b"PK\1\2")]
    nested = Item(b"outer", body, offset=0)
    image = archive([nested, Item(b"a", b"hello", offset=30 + 5, raw=b"", packed=5)])
    assert code(image)[0] in ("malformed.overlapping_ranges", "malformed.local_header_mismatch")


def test_no_prefix_of_an_image_is_accepted():
    image = package()
    for cut in range(len(image)):
        assert code(image[:cut]), cut


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_mutations_end_in_a_code_or_an_inventory(data):
    image = bytearray(package())
    for _ in range(data.draw(st.integers(1, 3))):
        image[data.draw(st.integers(0, len(image) - 1))] = data.draw(st.integers(0, 255))
    code(bytes(image))


def test_goldens_sizes_and_sums():
    rows = [e.row() for e in zipscan.scan(package()).entries]
    assert [(r["name_text"], r["decoded_size"], f"{r['crc32']:08x}") for r in rows if r["method"] == 0] == [
        ("mimetype", 19, "10b6eee7"),
        ("KRX/OCD/Payload/ID-1/synthetic-a.pdf", 19, "4b26d730"),
        ("KRX/OCD/Payload/ID-2/synthetic-b.pdf", 19, "3c21e7a6"),
    ]


@pytest.mark.parametrize(
    ("raw", "want"),
    [(b"", "empty"), (b"a\x00", "control_byte"), (b"a\x7f", "control_byte"), (b"a\\b", "backslash"), (b"/a", "absolute_path"), (b"C:a", "drive_prefix"), (b"..", "parent_component"), (b"a/..", "parent_component"), (b"a/", None), (b"..a/b", None), (b"\xff", None)],
)
def test_names(raw, want):
    assert names.unsafe_name(raw, False) == want


@pytest.mark.parametrize(
    ("part", "want"),
    [("", "empty_component"), (".", "current_component"), ("..", "parent_component"), ("a\x85", "control_character"), ("a.", "trailing_dot"), ("a ", "trailing_space"), (" a", "leading_space"), ("con.txt", "reserved_device_name"), ("LPT9", "reserved_device_name"), ("a:b", "colon"), ("a?", "reserved_character"), ("console", None), ("...", "trailing_dot")],
)
def test_components(part, want):
    assert names.unsafe_component(part) == want


def test_folds_and_kinds():
    assert names.fold_name("ΟΔΟΣ".encode()).decode() == "οδος" and names.collision_key("ΟΔΟΣ") == "οδοσ"
    assert names.collision_key("É/A") == "é/a" and names.fold_name(b"\xffA") == b"\xffa"
    assert [names.kind(m, a, n) for m, a, n in [(20, 0, b"a/"), (3 << 8, 0x81A40000, b"a"), (3 << 8, 0xA0000000, b"a"), (19 << 8, 0x40000000, b"a"), (3 << 8, 0, b"a"), (20, 0, b"a"), (20, 16, b"a"), (5 << 8, 0, b"a")]] == ["directory", "regular", "symlink", "directory", "special", "regular", "directory", "unknown"]
    assert names.escape("a\x1b‮é".encode() + b"\xff") == "a\\u{001b}\\u{202e}é\\x{ff}" and names.escape(b"a" * 203) == "a" * 200 + "…[+3]"
    assert len(codes.CODES) == 147
