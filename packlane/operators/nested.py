"""Rules over one package held in one row, as column expressions.

Entries and declared attachments are arrays that the reader's limits bound, so
what concerns a package alone needs no join and no shuffle. Entries stand in
the order of their index. Names are bytes: comparisons never go through text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules

#: Root prefixes that are known: fixed values.
PREFIXES = ("KRX/OCD/", "OCD/", "KRX/", "")
MARKER, DOCUMENT = b"mimetype", b"Metalayer/KULDEMENY_META.xml"
#: The checks in their order: fixed values.
CHECKS = ("metadata_location", "metadata_file_name", "root_prefix", "marker_entry", "metadata_parse", "schema_optional_fields", "handling_instructions_form", "attachment_references", "attachment_count", "attachment_uniqueness", "declared_size")
CHECK = "struct<ord: int, check: string, outcome: string, code: string, rule: string>"


def at(array: Column, n: int = 1) -> Column:
    return F.try_element_at(array, F.lit(n))


def field(array: Column, name: str) -> Column:
    return F.transform(array, lambda e: e[name])


def marker(entries: Column) -> Column:
    """struct(entry_index, marker): a first entry of the marker's exact name, else the first whose last segment is it; null without one."""
    shaped = F.filter(entries, lambda e: (e["name"] == F.lit(MARKER)) | F.endswith(e["name"], F.lit(b"/" + MARKER)))
    head = F.filter(entries, lambda e: (e["entry_index"] == 0) & (e["name"] == F.lit(MARKER)))
    m = F.coalesce(at(head), at(shaped))
    seen = F.when(m["name"] != F.lit(MARKER), "prefixed").when(m["entry_index"] != 0, "not_first").otherwise("first")
    return F.when(m.isNotNull(), F.struct(m["entry_index"].alias("entry_index"), seen.alias("marker")))


def lookup(entries: Column, name: bytes) -> Column:
    """The index of the entry with this exact name."""
    return at(F.filter(entries, lambda e: e["name"] == F.lit(name)))["entry_index"]


def strip_prefix(path: Column) -> Column:
    """The path without the longest known prefix."""
    out = path
    for prefix in sorted(PREFIXES[:-1], key=len):
        out = F.when(F.startswith(path, F.lit(prefix)), F.substring(path, len(prefix) + 1, 1 << 30)).otherwise(out)
    return out


def resolve(path: Column, prefix: Column, entries: Column) -> Column:
    """struct(resolution, entry_index) of a declared path.

    Tried in order: the path as declared, then its tail under the observed
    prefix and the known ones; the first that names an entry wins.
    """
    seen, raw, tail = F.coalesce(prefix, F.lit(b"")), path.cast("binary"), strip_prefix(path).cast("binary")
    known = F.array_except(F.array(*[F.lit(p.encode()) for p in PREFIXES]), F.array(seen))
    variants = F.transform(F.concat(F.array(seen), known), lambda p: F.concat(p, tail))
    tried = F.concat(F.array(raw), F.filter(variants, lambda v: v != raw))
    names = field(entries, "name")
    hits = F.filter(F.transform(tried, lambda t, i: F.struct(i.alias("rank"), F.array_position(names, t).alias("place"))), lambda h: h["place"] > 0)
    best = at(hits)
    resolution = F.when(best.isNull(), "missing").when(best["rank"] == 0, "resolved").otherwise("prefix_variant")
    return F.struct(resolution.alias("resolution"), F.try_element_at(entries, best["place"].cast("int"))["entry_index"].alias("entry_index"))


def reference_outcome(resolutions: Column) -> Column:
    """struct(outcome, code, rule): missing fails, a prefix variant is unresolved; null without references."""
    missing, variant = F.array_contains(resolutions, "missing"), F.array_contains(resolutions, "prefix_variant")
    return F.when(
        F.size(resolutions) > 0,
        F.struct(
            F.when(missing, "fail").when(variant, "unresolved").otherwise("pass").alias("outcome"),
            F.when(missing, "metadata.reference.missing_entry").alias("code"),
            F.when(~missing & variant, "M14").alias("rule"),
        ),
    )


def count_outcome(dispatches: Column) -> Column:
    """pass or fail over dispatches (declared, actual); null where none declares."""
    declared = F.filter(dispatches, lambda d: d["declared"].isNotNull())
    return F.when(F.size(declared) > 0, F.when(F.forall(declared, lambda d: d["declared"] == d["actual"]), "pass").otherwise("fail"))


def unique_outcome(references: Column) -> Column:
    """fail if a number or a declared path stands twice; null without references."""
    twice = lambda name: F.size(F.array_distinct(field(references, name))) < F.size(references)
    return F.when(F.size(references) > 0, F.when(twice("number") | twice("declared_path"), "fail").otherwise("pass"))


def matrix(outcomes: list[tuple[str, Column]]) -> Column:
    """The eleven checks in order; outcomes gives struct(outcome, code, rule) by check, null for one that does not apply."""
    held = dict(outcomes)
    rows = []
    for i, check in enumerate(CHECKS):
        o = held.get(check)
        got = [F.lit(None).cast("string")] * 3 if o is None else [o["outcome"], o["code"], o["rule"]]
        rows.append(F.struct(F.lit(i).alias("ord"), F.lit(check).alias("check"), F.coalesce(got[0], F.lit("not_applicable")).alias("outcome"), got[1].alias("code"), got[2].alias("rule")).cast(CHECK))
    return F.array(*rows)


def summary(checks: Column) -> Column:
    """struct(summary, unresolved_rules, exit_status) of checks in order."""
    has = lambda outcome: F.exists(checks, lambda c: c["outcome"] == outcome)
    cited = F.filter(checks, lambda c: (c["outcome"] == "unresolved") & c["rule"].isNotNull())
    label = F.when(has("fail"), "inconsistent").when(has("unresolved"), "unresolved").otherwise("consistent")
    return F.struct(label.alias("summary"), F.array_distinct(field(cited, "rule")).alias("unresolved_rules"), F.when(has("fail"), 3).when(has("unresolved"), 4).otherwise(0).alias("exit_status"))


# -- extraction ----------------------------------------------------------------


def _above(key: Column) -> Column:
    """The proper prefixes of a path."""
    parts = F.split(key, "/", -1)
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda d: F.array_join(F.slice(parts, 1, d), "/"))).otherwise(F.array().cast("array<string>"))


def _code(entry: Column, code: str) -> Column:
    return F.struct(entry.cast("int").alias("entry_index"), F.lit(code).alias("code"))


def plan_failure(entries: Column, files: int, total: int) -> Column:
    """struct(entry_index, code): why a package is not extracted, or null.

    entries(entry_index, path, key, kind, decoded_size) without directories;
    path is null where a name is no text. The first bad entry, then the first
    collision of keys, then the first file that is another's directory.
    """
    sums = F.aggregate(
        entries,
        F.array().cast("array<bigint>"),
        lambda a, e: F.concat(a, F.array(F.coalesce(at(a, -1), F.lit(0).cast("bigint")) + e["decoded_size"])),
    )
    numbered = F.zip_with(F.transform(entries, lambda e, i: F.struct(e.alias("e"), (i + 1).alias("n"))), sums, lambda x, s: F.struct(x["e"].alias("e"), x["n"].alias("n"), s.alias("upto")))
    coded = F.transform(
        numbered,
        lambda x: F.struct(
            x["e"]["entry_index"].cast("int").alias("entry_index"),
            F.coalesce(
                F.when(x["e"]["kind"] == "symlink", F.lit("extract.unsupported.link")),
                F.when(x["e"]["kind"] == "special", F.lit("extract.unsupported.special_file")),
                F.when(x["e"]["path"].isNull(), F.lit("extract.unsupported.non_utf8_name")),
                rules.unsafe_path(x["e"]["path"]),
                F.when(x["n"] > files, F.lit("extract.over_limit.files")),
                F.when(x["upto"] > total, F.lit("extract.over_limit.total_bytes")),
            ).alias("code"),
        ),
    )
    bad = at(F.filter(coded, lambda c: c["code"].isNotNull()))
    return F.coalesce(bad, clash(entries))


def clash(entries: Column) -> Column:
    """struct(entry_index, code) of the first entry whose key stood before, else of the first that is another's directory."""
    keys = field(entries, "key")
    # most packages pass both tests on hashed sets; a pass over pairs is for the others
    again = F.filter(F.transform(entries, lambda e, i: F.struct(e["entry_index"].alias("entry_index"), (F.array_position(keys, e["key"]) <= i).alias("hit"))), lambda x: x["hit"])
    collided = F.when(F.size(F.array_distinct(keys)) < F.size(keys), _code(at(again)["entry_index"], "extract.ambiguous.collision"))
    inner = F.filter(F.transform(entries, lambda e: F.struct(e["entry_index"].alias("entry_index"), F.array_intersect(keys, _above(e["key"])).alias("held"))), lambda x: F.size(x["held"]) > 0)
    place = lambda key: F.element_at(entries, F.array_position(keys, key).cast("int"))["entry_index"]
    hit = F.array_min(F.flatten(F.transform(inner, lambda x: F.transform(x["held"], lambda h: F.greatest(x["entry_index"], place(h))))))
    conflict = F.when(F.size(F.array_intersect(keys, F.flatten(F.transform(entries, lambda e: _above(e["key"]))))) > 0, _code(hit, "extract.ambiguous.file_directory_conflict"))
    return F.coalesce(collided, conflict)


def directories(paths: Column) -> Column:
    """Every implied parent directory once."""
    return F.array_distinct(F.flatten(F.transform(paths, _above)))


# -- corpus ---------------------------------------------------------------------

#: Labels of the report: fixed values.
UNSEEN = "not observed"
NO_PREFIX = "none (entries start at the profile directories)"


def prefix_class(prefix: Column) -> Column:
    return F.when(prefix.isNull(), UNSEEN).when(prefix == "", NO_PREFIX).when(prefix.isin("KRX/OCD/", "OCD/"), prefix).otherwise("other prefix")


def casing_class(name: Column) -> Column:
    leaf = F.element_at(F.split(name, "/", -1), -1)
    stem, ext = F.regexp_extract(leaf, r"^(.*)\.([^.]*)$", 1), F.regexp_extract(leaf, r"^(.*)\.([^.]*)$", 2)
    upper = lambda c: (c == F.upper(c)) & (c != F.lower(c))
    lower = lambda c: (c == F.lower(c)) & (c != F.upper(c))
    return (
        F.when(name.isNull() | (name == ""), UNSEEN)
        .when(upper(stem) & lower(ext), "upper-case stem, lower-case extension")
        .when(lower(stem) & lower(ext), "lower-case stem, lower-case extension")
        .when(upper(stem) & upper(ext), "upper-case stem, upper-case extension")
        .otherwise("other casing")
    )


def marker_class(entries: Column) -> Column:
    """By the first entry that is a marker or ends like one; names that are no text do not count."""
    shaped = at(F.filter(entries, lambda e: (e["name_text"] == "mimetype") | F.endswith(e["name_text"], F.lit("/mimetype"))))
    return (
        F.when(shaped.isNull(), "no marker entry")
        .when(shaped["name_text"] != "mimetype", "present under a directory prefix")
        .when(shaped["entry_index"] == 0, "first entry, at the archive root")
        .otherwise("present, not the first entry")
    )


def payload_classes(entries: Column) -> Column:
    """Each spelling of payload directories once."""
    spelled = lambda s: F.when(s.rlike(r"^ID-\d+$"), "ID-<n>").when(s.rlike(r"^ID_\d+$"), "ID_<n>").when(s.rlike(r"^ID\d+$"), "ID<n>").otherwise("other spelling")

    def below(text: Column) -> Column:
        parts = F.split(text, "/", -1)
        inner = F.filter(F.transform(parts, lambda p, i: F.struct(p.alias("above"), F.get(parts, i + 1).alias("segment"), i.alias("i"))), lambda p: (p["above"] == "Payload") & (p["i"] + 1 < F.size(parts) - 1))
        return F.transform(inner, lambda p: spelled(p["segment"]))

    named = F.filter(field(entries, "name_text"), lambda t: t.isNotNull())
    found = F.array_distinct(F.flatten(F.transform(named, below)))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("no payload subdirectory")))


def entry_bucket(n: Column) -> Column:
    return F.when(n < 5, "1-4").when(n < 10, "5-9").when(n < 50, "10-49").otherwise("50+")
