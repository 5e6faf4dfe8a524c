"""Rules about names: raw entry names, path components, folds, kinds."""

from __future__ import annotations

import re
import unicodedata

DEVICES = frozenset(["CON", "PRN", "AUX", "NUL", *(f"{d}{n}" for d in ("COM", "LPT") for n in range(1, 10))])
RESERVED = frozenset('*?<>|"')
_DRIVE = re.compile(rb"[A-Za-z]:")


def unsafe_name(name: bytes, has_data: bool) -> str | None:
    """The first class that a raw name falls in, in fixed order."""
    checks = (
        ("empty", not name),
        ("control_byte", any(b < 0x20 or b == 0x7F for b in name)),
        ("backslash", b"\\" in name),
        ("absolute_path", name[:1] == b"/"),
        ("drive_prefix", bool(_DRIVE.match(name))),
        ("parent_component", b".." in name.split(b"/")),
        ("directory_with_data", name[-1:] == b"/" and has_data),
    )
    return next((c for c, hit in checks if hit), None)


def unsafe_component(c: str) -> str | None:
    """The first class that a path component falls in, in fixed order."""
    checks = (
        ("empty_component", c == ""),
        ("current_component", c == "."),
        ("parent_component", c == ".."),
        ("control_character", any(unicodedata.category(x) == "Cc" for x in c)),
        ("trailing_dot", c.endswith(".")),
        ("trailing_space", c.endswith(" ")),
        ("leading_space", c.startswith(" ")),
        ("reserved_device_name", (stem := c.split(".", 1)[0]).isascii() and stem.upper() in DEVICES),
        ("colon", ":" in c),
        ("reserved_character", not RESERVED.isdisjoint(c)),
    )
    return next((k for k, hit in checks if hit), None)


def text_of(name: bytes) -> str | None:
    try:
        return name.decode()
    except UnicodeDecodeError:
        return None


def fold_name(name: bytes) -> bytes:
    """Case fold of a whole name: Unicode where it is UTF-8, ASCII otherwise."""
    text = text_of(name)
    return name.lower() if text is None else text.lower().encode()


def collision_key(path: str) -> str:
    """NFC of each component, then the lower case of each character on its own."""
    if path.isascii():
        return path.lower()
    return "/".join("".join(x.lower() for x in unicodedata.normalize("NFC", c)) for c in path.split("/"))


def kind(version_made_by: int, external_attributes: int, name: bytes) -> str:
    """regular, directory, symlink, special or unknown, by name, host and mode."""
    if name.endswith(b"/"):
        return "directory"
    host = version_made_by >> 8
    if host in (3, 19):
        return {0x8000: "regular", 0x4000: "directory", 0xA000: "symlink"}.get(external_attributes >> 16 & 0xF000, "special")
    if host in (0, 10, 11, 14):
        return "directory" if external_attributes & 0x10 else "regular"
    return "unknown"


def _hidden(c: str) -> bool:
    """Controls, and the invisible ranges that could steer what is shown (fixed values)."""
    n = ord(c)
    ranges = ((0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x2064), (0x2066, 0x2069), (0xFEFF, 0xFEFF), (0xFFF9, 0xFFFB))
    return unicodedata.category(c) == "Cc" or any(a <= n <= b for a, b in ranges)


def escape(raw: bytes, most: int = 200) -> str:
    """Text that is safe to show: hidden characters and undecodable bytes are spelled out, and units beyond most are counted."""
    # undecodable bytes become lone surrogates, one unit each
    units = raw.decode("utf-8", "surrogateescape")
    shown = "".join(f"\\x{{{ord(c) - 0xDC00:02x}}}" if 0xDC80 <= ord(c) <= 0xDCFF else f"\\u{{{ord(c):04x}}}" if _hidden(c) else c for c in units[:most])
    return shown + (f"\u2026[+{len(units) - most}]" if len(units) > most else "")
