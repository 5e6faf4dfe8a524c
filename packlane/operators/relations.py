"""Operators on whole relations, keyed by package_id. All joins are equi-joins; nothing is collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import nested, rules

KEY = "package_id"


# -- archive ------------------------------------------------------------------


def coverage(regions: DataFrame, directories: DataFrame) -> DataFrame:
    """package_id, code: whether regions(package_id, start, end) tile what lies before directories(package_id, directory_start)."""
    ends = directories.select(KEY, F.col("directory_start").alias("start"), F.col("directory_start").alias("end"), F.lit(1).alias("last"))
    rows = regions.select(KEY, "start", "end", F.lit(0).alias("last")).unionByName(ends)
    order = Window.partitionBy(KEY).orderBy("last", "start", "end")
    rows = rows.withColumn("reached", F.coalesce(F.lag("end").over(order), F.lit(0))).withColumn("place", F.row_number().over(order))
    gap = F.when(F.col("reached") == 0, "archive.malformed.prefix_bytes").otherwise("archive.malformed.unclaimed_bytes")
    code = F.when(F.col("start") < F.col("reached"), "archive.malformed.overlapping_ranges").when(F.col("start") > F.col("reached"), gap)
    return rows.withColumn("code", code).groupBy(KEY).agg(F.min_by("code", F.when(F.col("code").isNotNull(), F.col("place"))).alias("code"))


def running_total(entries: DataFrame, limit: int) -> DataFrame:
    """Each entry's running decoded total and, from the first entry that passes the limit on, the code."""
    order = Window.partitionBy(KEY).orderBy("entry_index").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("decoded_size").over(order)
    return entries.withColumn("total", total).withColumn("code", F.when(F.col("total") > limit, F.lit("archive.over_limit.total_decoded_bytes")))


def together(rows: DataFrame, name: str, *columns: str, order: str | None = None) -> DataFrame:
    """package_id and an array of the columns of its rows, ordered: the form that operators.nested works on."""
    held = F.collect_list(F.struct(*([order] if order and order not in columns else []), *columns))
    return rows.groupBy(KEY).agg((F.array_sort(held) if order else held).alias(name))


def marker(entries: DataFrame) -> DataFrame:
    """The marker of each package that has one, and the index of the first entry of that exact name; entries(package_id, entry_index, name)."""
    rows = together(entries.withColumn("name", F.col("name").cast("binary")), "e", "entry_index", "name", order="entry_index")
    seen = rows.select(KEY, nested.marker(F.col("e")).alias("m"), nested.lookup(F.col("e"), nested.MARKER).alias("exact")).where("m IS NOT NULL")
    return seen.select(KEY, "m.entry_index", "m.marker", "exact")


# -- names --------------------------------------------------------------------


def fold_collisions(entries: DataFrame) -> DataFrame:
    """package_id, entry_index, code of the first entry of a package whose name or fold stood before."""
    same_fold = Window.partitionBy(KEY, "fold").orderBy("entry_index")
    same_name = Window.partitionBy(KEY, "fold", "name").orderBy("entry_index")
    rows = entries.withColumn("fold", F.lower("name")).select(KEY, "entry_index", (F.row_number().over(same_fold) > 1).alias("folded"), (F.row_number().over(same_name) > 1).alias("exact"))
    code = F.when(F.col("exact"), "archive.ambiguous.duplicate_name").otherwise("archive.ambiguous.case_folded_duplicate_name")
    return _first(rows.where("folded").withColumn("code", code))


def _first(rows: DataFrame) -> DataFrame:
    return rows.groupBy(KEY).agg(F.min(F.struct("entry_index", "code")).alias("v")).select(KEY, "v.entry_index", "v.code")


def collisions(files: DataFrame) -> DataFrame:
    """package_id, entry_index, code: the first file whose key stood before or is another's directory; files(package_id, entry_index, key)."""
    rows = files.select(KEY, "entry_index", F.col("key").alias("path"), "key", F.lit("regular").alias("kind"), F.lit(0).cast("long").alias("decoded_size"))
    held = together(rows, "items", "entry_index", "path", "key", "kind", "decoded_size", order="entry_index")
    return held.select(KEY, nested.clash(F.col("items")).alias("v")).where("v IS NOT NULL").select(KEY, "v.*")


def directories(files: DataFrame) -> DataFrame:
    """package_id, directory: every implied parent directory once; files(package_id, path)."""
    return files.select(KEY, F.explode(nested.directories(F.array("path"))).alias("directory")).distinct()


# -- references ----------------------------------------------------------------


def resolve(references: DataFrame, entries: DataFrame) -> DataFrame:
    """Each of references(package_id, ref, declared_path, root_prefix) with resolution and entry (see nested.resolve)."""
    names = together(entries.withColumn("name", F.col("name").cast("binary")), "entries", "entry_index", "name", order="entry_index")
    found = references.join(names, KEY, "left").withColumn("entries", F.coalesce("entries", F.array().cast(names.schema["entries"].dataType)))
    return found.withColumn("r", nested.resolve(F.col("declared_path"), F.col("root_prefix").cast("binary"), F.col("entries"))).select(*references.columns, "r.resolution", "r.entry_index")


def reference_outcomes(resolutions: DataFrame) -> DataFrame:
    """package_id, outcome, code, rule: missing fails, a prefix variant is unresolved."""
    g = resolutions.groupBy(KEY).agg(F.collect_set("resolution").alias("r"))
    return g.select(KEY, nested.reference_outcome(F.col("r")).alias("o")).select(KEY, "o.*")


def count_agrees(dispatches: DataFrame) -> DataFrame:
    """package_id, outcome over dispatches(package_id, declared, actual); not_applicable where none declares."""
    return together(dispatches, "d", "declared", "actual").select(KEY, F.coalesce(nested.count_outcome(F.col("d")), F.lit("not_applicable")).alias("outcome"))


def uniqueness(references: DataFrame) -> DataFrame:
    """package_id, outcome: no number and no declared path twice."""
    return together(references, "r", "number", "declared_path").select(KEY, nested.unique_outcome(F.col("r")).alias("outcome"))


# -- checks --------------------------------------------------------------------


def check_matrix(packages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """package_id, checks: the eleven checks in order; a check without an outcome is not_applicable. outcomes(package_id, check, outcome, code, rule)."""
    held = together(outcomes, "o", "check", "outcome", "code", "rule")
    own = lambda check: F.try_element_at(F.filter("o", lambda x: x["check"] == check), F.lit(1))
    return packages.select(KEY).join(held, KEY, "left").select(KEY, nested.matrix([(c, own(c)) for c in nested.CHECKS]).alias("checks"))


def summaries(matrix: DataFrame) -> DataFrame:
    """package_id, checks, summary, unresolved_rules (in the order of first citation), exit_status."""
    return matrix.select(KEY, "checks", nested.summary(F.col("checks")).alias("s")).select(KEY, "checks", "s.*")


# -- extraction ----------------------------------------------------------------


def plan(entries: DataFrame, files: int = 256, total: int = 128 << 20) -> DataFrame:
    """package_id, items, failure: all files of a package to write, or its first violation (see nested.plan_failure).

    entries(package_id, entry_index, path, key, kind, decoded_size); path is
    null where a name is no text, and key is its collision key.
    """
    rows = together(entries.where("kind <> 'directory'"), "items", "entry_index", "path", "key", "kind", "decoded_size", order="entry_index")
    return rows.withColumn("failure", nested.plan_failure(F.col("items"), files, total))


# -- writer and editor -----------------------------------------------------------


def derive_references(attachments: DataFrame) -> DataFrame:
    """number, location, size_text of attachments(package_id, ordinal, file_name, size) as the writer derives them."""
    n = F.row_number().over(Window.partitionBy(KEY).orderBy("ordinal"))
    return attachments.withColumn("number", n.cast("long")).withColumn("location", F.concat(F.lit("KRX/OCD/Payload/ID-"), F.col("number"))).withColumn("size_text", rules.kilobytes(F.col("size")))


def edit_targets(edits: DataFrame, counts: DataFrame) -> DataFrame:
    """package_id, number, code of the first bad target; edits(package_id, op, ord, number), removals before replacements."""
    rank = F.struct(F.when(F.col("op") == "remove", 0).otherwise(1).alias("o"), "ord")
    rows = edits.where(F.col("op").isin("remove", "replace")).join(counts, KEY, "left").withColumn("place", rank)
    again = F.row_number().over(Window.partitionBy(KEY, "number").orderBy("place")) > 1
    code = F.when((F.col("number") < 1) | (F.col("number") > F.coalesce("n", F.lit(0))), "repack.invalid.no_such_attachment").when(again, "repack.invalid.duplicate_target")
    return rows.withColumn("code", code).where(F.col("code").isNotNull()).groupBy(KEY).agg(F.min_by(F.struct("number", "code"), "place").alias("v")).select(KEY, "v.number", "v.code")


def edit_plan(attachments: DataFrame, edits: DataFrame) -> DataFrame:
    """package_id, number (new), old_number, action, content: removed ones go, replaced ones change in place, added ones follow.

    attachments(package_id, number, content), edits(package_id, op, ord, number, content).
    """
    gone = edits.where("op = 'remove'").select(KEY, "number").distinct()
    changed = edits.where("op = 'replace'").select(KEY, "number", F.col("content").alias("new"), F.lit(True).alias("changed"))
    kept = attachments.join(gone, [KEY, "number"], "left_anti").join(changed, [KEY, "number"], "left")
    kept = kept.select(KEY, F.lit(0).alias("part"), F.col("number").alias("place"), F.col("number").alias("old_number"), F.when(F.col("changed"), "changed").otherwise("preserved").alias("action"), F.when(F.col("changed"), F.col("new")).otherwise(F.col("content")).alias("content"))
    added = edits.where("op = 'add'").select(KEY, F.lit(1).alias("part"), F.col("ord").cast("long").alias("place"), F.lit(None).cast("long").alias("old_number"), F.lit("added").alias("action"), "content")
    number = F.row_number().over(Window.partitionBy(KEY).orderBy("part", "place")).cast("long")
    return kept.unionByName(added).select(KEY, number.alias("number"), "old_number", "action", "content")


def layout(entries: DataFrame) -> DataFrame:
    """package_id, code: null where names stand as the writer writes them; entries(package_id, entry_index, name)."""
    parts = F.split("name", "/", -1)
    shaped = (F.size(parts) >= 2) & (F.lower(F.element_at(parts, -1)) == "kuldemeny_meta.xml") & (F.lower(F.try_element_at(parts, F.lit(-2))) == "metalayer")
    number = (F.col("entry_index") - 1).cast("string")
    payload = F.startswith("name", F.concat(F.lit("KRX/OCD/Payload/ID-"), number, F.lit("/")))
    file = F.expr("substring(name, length('KRX/OCD/Payload/ID-') + length(cast(entry_index - 1 as string)) + 2)")
    good = payload & (file != "") & ~F.contains(file, F.lit("/"))
    g = entries.withColumn("shaped", shaped).groupBy(KEY).agg(
        F.count_if("shaped").alias("found"),
        F.max(F.when(F.col("shaped"), F.struct("name", "entry_index"))).alias("d"),
        F.max(F.when(F.col("entry_index") == 0, F.col("name"))).alias("head"),
        F.bool_or((F.col("entry_index") >= 2) & ~good).alias("stray"),
    )
    code = rules.first(
        [
            ("repack.unsupported.metadata_missing", F.col("found") != 1),
            ("repack.unsupported.root_prefix", F.expr("left(d.name, length(d.name) - 28)") != "KRX/OCD/"),
            ("repack.unsupported.metadata_name", F.col("d.name") != "KRX/OCD/Metalayer/KULDEMENY_META.xml"),
            ("repack.unsupported.marker", F.coalesce(F.col("head") != "KRX/OCD/mimetype", F.lit(True))),
            ("repack.unsupported.extra_entry", (F.col("d.entry_index") != 1) | F.coalesce("stray", F.lit(False))),
        ]
    )
    return g.select(KEY, code.alias("code"))


# -- requests -------------------------------------------------------------------


def strict_keys(requests: DataFrame, text: str, allowed: tuple[str, ...], required: tuple[str, ...]) -> DataFrame:
    """requests with code: not an object, then an unknown key, then a missing one."""
    keys = F.json_object_keys(text)
    code = rules.first(
        [
            ("manifest.invalid.syntax", keys.isNull()),
            ("manifest.invalid.unknown_field", F.size(F.array_except(keys, F.array(*map(F.lit, allowed)))) > 0),
            ("manifest.invalid.missing_field", F.size(F.array_except(F.array(*map(F.lit, required)), keys)) > 0),
        ]
    )
    return requests.withColumn("code", code)
