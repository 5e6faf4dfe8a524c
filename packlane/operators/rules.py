"""Rules as native column expressions; in an ordered list the first that is violated gives the code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import codes
from ..functions.names import DEVICES
from ..functions.zipscan import ENCRYPTED, PATCHED

Rule = tuple[str, Column]


def first(rules: Sequence[Rule]) -> Column:
    """The code of the first rule that holds, else null."""
    return F.coalesce(*[F.when(hit, F.lit(code)) for code, hit in rules])


def over_limit(checks: Sequence[tuple[str, Column, int]]) -> Column:
    """struct(code, limit_value, observed) of the first value above its limit, else null."""
    return F.coalesce(*[F.when(seen > most, F.struct(F.lit(code).alias("code"), F.lit(most).cast("long").alias("limit_value"), seen.cast("long").alias("observed"))) for code, seen, most in checks])


def flags(flag: Column) -> Column:
    return first([("archive.unsupported.encryption", flag.bitwiseAND(F.lit(ENCRYPTED)) != 0), ("archive.unsupported.patched_data", flag.bitwiseAND(F.lit(PATCHED)) != 0)])


def method(code: Column) -> Column:
    return first([("archive.unsupported.method", ~code.isin(0, 8))])


def kind(made_by: Column, attributes: Column, name: Column) -> Column:
    """regular, directory, symlink, special or unknown."""
    host, mode = F.shiftrightunsigned(made_by.cast("int"), 8), F.shiftright(attributes, 16).bitwiseAND(F.lit(0xF000))
    unix = F.when(mode == 0x8000, "regular").when(mode == 0x4000, "directory").when(mode == 0xA000, "symlink").otherwise("special")
    fat = F.when(attributes.bitwiseAND(F.lit(0x10)) == 0, "regular").otherwise("directory")
    return F.when(F.endswith(name, F.lit("/")), "directory").when(host.isin(3, 19), unix).when(host.isin(0, 10, 11, 14), fat).otherwise("unknown")


def unsafe_name(name: Column, has_data: Column) -> Column:
    """The class of a raw name that is text."""
    return first(
        [
            ("empty", name == ""),
            ("control_byte", name.rlike(r"[\x00-\x1f\x7f]")),
            ("backslash", F.contains(name, F.lit("\\"))),
            ("absolute_path", F.startswith(name, F.lit("/"))),
            ("drive_prefix", name.rlike(r"^[A-Za-z]:")),
            ("parent_component", F.array_contains(F.split(name, "/", -1), "..")),
            ("directory_with_data", F.endswith(name, F.lit("/")) & has_data),
        ]
    )


def unsafe_component(c: Column) -> Column:
    """The class of one path component."""
    stem = F.split_part(c, F.lit("."), F.lit(1))
    return first(
        [
            ("empty_component", c == ""),
            ("current_component", c == "."),
            ("parent_component", c == ".."),
            ("control_character", c.rlike(r"[\x00-\x1f\x7f\x{80}-\x{9f}]")),
            ("trailing_dot", F.endswith(c, F.lit("."))),
            ("trailing_space", F.endswith(c, F.lit(" "))),
            ("leading_space", F.startswith(c, F.lit(" "))),
            ("reserved_device_name", stem.rlike(r"^[ -~]*$") & F.upper(stem).isin(sorted(DEVICES))),
            ("colon", F.contains(c, F.lit(":"))),
            ("reserved_character", c.rlike(r'[*?<>|"]')),
        ]
    )


def unsafe_path(path: Column, path_bytes: int = 1024, depth: int = 16, component: int = 255) -> Column:
    """The code of a path: its length and depth, then each component's shape before its length."""
    parts = F.split(path, "/", -1)
    each = F.transform(parts, lambda c: F.coalesce(F.concat(F.lit("extract.unsafe_path."), unsafe_component(c)), F.when(F.octet_length(c) > component, F.lit("extract.over_limit.component_bytes"))))
    bad = F.filter(each, lambda x: x.isNotNull())
    return F.coalesce(
        F.when(F.octet_length(path) > path_bytes, F.lit("extract.over_limit.path_bytes")),
        F.when(F.size(parts) > depth, F.lit("extract.over_limit.depth")),
        F.try_element_at(bad, F.lit(1)),
    )


def declared_path(location: Column, file_name: Column) -> Column:
    base = F.regexp_replace(location, "/+$", "")
    return F.when(base == "", file_name).otherwise(F.concat(base, F.lit("/"), file_name))


def xml_escape(text: Column) -> Column:
    """struct(escaped, code): what the writer puts, or why it refuses."""
    blank = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
    code = first([("create.invalid.untrimmed_text", text.rlike(f"^{blank}") | text.rlike(rf"{blank}\z")), ("create.invalid.text", text.rlike(r"[\x00-\x08\x0b-\x1f\x{fffe}\x{ffff}]"))])
    escaped = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.struct(F.when(code.isNull(), escaped).alias("escaped"), code.alias("code"))


def dos_date(year: Column, month: Column, day: Column) -> Column:
    """The date field, null outside 1980 to 2107 or for a day that its month does not have."""
    real = F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd")
    return F.when(real.isNotNull() & year.between(1980, 2107), F.shiftleft(year - 1980, 9).bitwiseOR(F.shiftleft(month, 5)).bitwiseOR(day))


def dos_time(hour: Column, minute: Column, second: Column) -> Column:
    ok = hour.between(0, 23) & minute.between(0, 59) & second.between(0, 59)
    return F.when(ok, F.shiftleft(hour, 11).bitwiseOR(F.shiftleft(minute, 5)).bitwiseOR(F.shiftrightunsigned(second, 1)))


def timestamp_fields(text: Column) -> Column:
    """struct(date, time) of a text of the exact shape, both null otherwise."""
    shaped = text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}\z")
    part = lambda at, n: F.when(shaped, F.substring(text, at, n).cast("int"))
    date, time = dos_date(part(1, 4), part(6, 2), part(9, 2)), dos_time(part(12, 2), part(15, 2), part(18, 2))
    both = date.isNotNull() & time.isNotNull()
    return F.struct(F.when(both, date).alias("date"), F.when(both, time).alias("time"))


def kilobytes(size: Column) -> Column:
    return F.floor((size + 1023) / 1024).cast("long").cast("string")


def crc_hex(crc: Column) -> Column:
    return F.lpad(F.lower(F.hex(crc)), 8, "0")


def hex_unless_text(name: Column) -> Column:
    return F.when(~F.is_valid_utf8(name), F.lower(F.hex(name)))


def category(code: Column) -> Column:
    """The category of a code by its first two segments."""
    head, second = F.split_part(code, F.lit("."), F.lit(1)), F.split_part(code, F.lit("."), F.lit(2))
    by_second = F.create_map(*[F.lit(x) for pair in sorted(codes.SECOND.items()) for x in pair])
    return F.when(head.isin("input", "output"), head).otherwise(F.try_element_at(by_second, second))


def exit_status(category_: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in sorted(codes.STATUS.items()) for x in pair]), category_)


def saturating_sum(values: Column) -> Column:
    """Sum of an array of longs that stops at the largest long; null for no declared value."""
    most = F.lit((1 << 63) - 1)
    known = F.filter(values, lambda x: x.isNotNull())
    total = F.aggregate(known, F.lit(0).cast("long"), lambda a, x: F.when((x > 0) & (a > most - F.greatest(x, F.lit(0).cast("long"))), most).otherwise(F.coalesce(F.try_add(a, x), F.lit(-(1 << 63)))))
    return F.when(F.size(known) > 0, total)


def edit(op: Column, value: Column, current: Column) -> Column:
    """A tri-state edit: keep, set or clear."""
    return F.when(op == "set", value).when(op == "clear", F.lit(None)).otherwise(current)
