"""Read-side plans over scanned packages: entries, checks, observations, diagnostics, listings.

Everything about a package is an expression on its one row (operators.nested):
a plan scans each image once and shuffles nothing. Plans that share a scan take
the frame that scan.scan gave, written or persisted where it is used twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import nested, rules

KEY = "package_id"


def entries(scanned: DataFrame) -> DataFrame:
    """A row for each entry; name stays binary, name_text is null where it is no text."""
    return scanned.where("violation IS NULL").select(KEY, F.inline("entries"))


def listed(scanned: DataFrame) -> DataFrame:
    """What a listing shows of each entry, in order within a package."""
    return entries(scanned).select(KEY, F.col("entry_index").alias("index"), F.col("name_text").alias("name"), F.col("utf8_flag").alias("name_utf8_flag"), "name_hex", F.col("method_name").alias("method"), "compressed_size", "declared_size", "decoded_size", rules.crc_hex(F.col("crc32")).alias("crc32"))


def text_of(raw: Column) -> Column:
    """The text of bytes, null where they are none."""
    return F.when(F.is_valid_utf8(raw), raw.cast("string"))


def _attachments() -> Column:
    """Every declared attachment with its place, its declared path, and the entry that it names."""

    def one(d: Column, i: Column) -> Column:
        def two(a: Column, j: Column) -> Column:
            path = rules.declared_path(a["location"], a["file_name"])
            found = nested.resolve(path, F.col("document.prefix"), F.col("entries"))
            return F.struct(i.alias("dispatch_index"), j.alias("ordinal"), *[a[k].alias(k) for k in ("description", "number", "file_name", "size_text", "size_value", "location", "quantity", "quantity_unit")], path.alias("declared_path"), found["resolution"].alias("resolution"), found["entry_index"].alias("entry_index"))

        return F.transform(d["attachments"], two)

    return F.flatten(F.transform("metadata.dispatches", one))


def observed(scanned: DataFrame) -> DataFrame:
    """scanned with the marker and the declared attachments of each package."""
    return scanned.withColumns({"marker": nested.marker(F.col("entries")), "attachments": _attachments()})


def _checks() -> Column:
    """The eleven checks of a row of observed."""
    one, parsed = F.col("candidates") == 1, F.col("metadata").isNotNull()
    seen, every = F.col("marker.marker"), F.col("attachments")

    def case(*cases: tuple[Column, str, str | Column | None, str | None], applies: Column = F.lit(True)) -> Column:
        out = F.lit(None)
        for hit, outcome, code, rule in reversed(cases):
            code = code if isinstance(code, Column) else F.lit(code).cast("string")
            out = F.when(hit, F.struct(F.lit(outcome).alias("outcome"), code.alias("code"), F.lit(rule).cast("string").alias("rule"))).otherwise(out)
        return F.when(applies, out)

    otherwise = F.lit(True)
    complete = F.col("metadata.header.test_present") & F.forall(every, lambda a: a["description"].isNotNull() & a["size_value"].isNotNull())
    references = nested.reference_outcome(nested.field(every, "resolution"))
    count = nested.count_outcome(F.transform("metadata.dispatches", lambda d: F.struct(d["declared_attachment_count"].alias("declared"), F.size(d["attachments"]).cast("bigint").alias("actual"))))
    unique = nested.unique_outcome(every)
    return nested.matrix(
        [
            ("metadata_location", case((one, "pass", None, None), (F.col("candidates") == 0, "fail", "metadata.missing", None), (otherwise, "fail", "metadata.ambiguous.multiple_candidates", None))),
            ("metadata_file_name", case((F.col("document.canonical"), "pass", None, None), (otherwise, "unresolved", None, "M12"), applies=one)),
            ("root_prefix", case((F.col("document.prefix") == F.lit(b"KRX/OCD/"), "pass", None, None), (otherwise, "unresolved", None, "A19"), applies=one)),
            (
                "marker_entry",
                case(
                    (seen.isNull(), "fail", "metadata.malformed.marker_missing", None),
                    (seen == "prefixed", "unresolved", None, "A19"),
                    (seen == "not_first", "fail", "metadata.malformed.marker_not_first", None),
                    (F.col("marker_content"), "pass", None, None),
                    (otherwise, "fail", "metadata.malformed.marker_content", None),
                ),
            ),
            ("metadata_parse", case((parsed, "pass", None, None), (otherwise, "fail", F.col("metadata_violation.code"), None), applies=one)),
            ("schema_optional_fields", case((complete, "pass", None, None), (otherwise, "unresolved", None, "M11"), applies=parsed)),
            ("handling_instructions_form", case((otherwise, "pass", None, None), applies=parsed & F.exists("metadata.dispatches", lambda d: d["handling_instructions_unqualified"]))),
            ("attachment_references", F.when(parsed, references)),
            ("attachment_count", case((count == "fail", "fail", "metadata.count_mismatch", None), (otherwise, "pass", None, None), applies=parsed & count.isNotNull())),
            ("attachment_uniqueness", case((unique == "fail", "fail", "metadata.reference.duplicate", None), (otherwise, "pass", None, None), applies=parsed & unique.isNotNull())),
            ("declared_size", case((otherwise, "unresolved", None, "M13"), applies=parsed & (F.size(every) > 0))),
        ]
    )


def checked(scanned: DataFrame) -> DataFrame:
    """observed with checks and their verdict (summary, unresolved_rules, exit_status); all three are null where the package could not be read."""
    seen = observed(scanned).withColumn("checks", F.when(F.col("violation").isNull(), _checks()))
    return seen.withColumn("verdict", F.when(F.col("checks").isNotNull(), nested.summary(F.col("checks"))))


def checks(scanned: DataFrame) -> DataFrame:
    """Eleven rows in order for each readable package."""
    return checked(scanned).where("violation IS NULL").select(KEY, F.inline("checks"))


def attachments(scanned: DataFrame) -> DataFrame:
    """A row for each declared attachment, with its place, declared path and resolution."""
    return observed(scanned).where("metadata IS NOT NULL").select(KEY, F.inline("attachments"))


def _status() -> Column:
    return rules.exit_status(rules.category(F.col("violation.code")))


def validate(scanned: DataFrame) -> DataFrame:
    """package_id, summary, unresolved_rules, exit_status of every package, unreadable ones by the status of their code."""
    return checked(scanned).select(KEY, "verdict.summary", "verdict.unresolved_rules", F.coalesce("verdict.exit_status", _status()).alias("exit_status"))


def diagnostics(scanned: DataFrame, command: str) -> DataFrame:
    """A row for each package that could not be read: codes, indices and numbers only."""
    v = scanned.where("violation IS NOT NULL").select(KEY, "violation.*")
    return v.select(KEY, F.lit(command).alias("command"), "code", rules.category(F.col("code")).alias("category"), rules.exit_status(rules.category(F.col("code"))).alias("exit_status"), "entry_index", "field", "attachment_index", "attachment_number", "limit_value", "observed")


def inspect(scanned: DataFrame) -> DataFrame:
    """One nested row for each readable package: observations, metadata, attachments, checks."""
    seen = checked(scanned).where("violation IS NULL")
    place, first = F.col("marker.marker"), F.when(F.col("marker_content"), "matching").otherwise("content_mismatch")
    name, prefix = F.col("document.name"), F.col("document.prefix")
    size = lambda a: F.try_element_at(F.col("entries"), a["entry_index"] + 1)["decoded_size"]
    shown = F.transform("attachments", lambda a: F.struct(*[a[k].alias(k) for k in ("dispatch_index", "ordinal", "number", "declared_path", "resolution", "entry_index", "size_text", "size_value")], size(a).alias("observed_size")))
    return seen.select(
        KEY,
        F.struct(
            F.size("entries").alias("entry_count"),
            text_of(prefix).alias("root_prefix"),
            rules.hex_unless_text(prefix).alias("root_prefix_hex"),
            text_of(name).alias("metadata_entry_name"),
            rules.hex_unless_text(name).alias("metadata_entry_name_hex"),
            F.col("document.entry_index").alias("metadata_entry_index"),
            F.when(place == "first", first).otherwise(F.coalesce(place, F.lit("missing"))).alias("marker"),
        ).alias("observations"),
        "metadata.header",
        rules.saturating_sum(F.transform("metadata.dispatches", lambda d: d["declared_attachment_count"])).alias("declared_attachment_count"),
        shown.alias("attachments"),
        F.transform("checks", lambda c: c.dropFields("ord")).alias("checks"),
    )


def envelopes(rows: DataFrame, command: str) -> DataFrame:
    """package_id, envelope: a JSON document for each row; null fields are left out."""
    return rows.select(KEY, F.to_json(F.struct(F.lit(1).alias("schema_version"), F.lit(command).alias("command"), F.struct(*[c for c in rows.columns if c != KEY]).alias("data"))).alias("envelope"))


def lines(diagnosed: DataFrame) -> DataFrame:
    """One line for each diagnostic, without content."""
    part = lambda label, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(label), F.col(c).cast("string")))
    return diagnosed.select(KEY, F.concat_ws(" ", F.concat(F.lit("error: "), F.col("code")), part("entry ", "entry_index"), part("field ", "field"), part("attachment ", "attachment_index"), part("limit ", "limit_value"), part("observed ", "observed")).alias("line"))


#: What the engine can do: fixed values.
OPERATIONS = ("inspect", "list", "validate-structure", "extract", "create", "repack")


def capabilities(spark) -> DataFrame:
    """stage and operations of the engine."""
    return spark.range(1).select(F.lit("reader-writer").alias("stage"), F.posexplode(F.array(*map(F.lit, OPERATIONS))).alias("place", "operation"))
