"""The corpus report: counts of fixed labels. Names are classified and dropped; package_id stays out.

Each package gives its labels as one array, so the report is one scan, one
explode and one aggregate of at most a few hundred labels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import nested, rules
from . import read

#: The sections in their order: fixed values. No process is run for a package, so anomalies stays empty.
SECTIONS = ("packages", "exit_status", "codes", "categories", "checks", "root_prefix", "file_name_casing", "marker", "payload", "entry_count", "anomalies")
COMMANDS = ("inspect", "list", "validate-structure")
NONE = "(none)"


def labels() -> Column:
    """array of struct(section, label) of a row of read.checked."""
    code, bad = F.col("violation.code"), F.col("violation").isNotNull()
    category = rules.category(code)
    status = rules.exit_status(category)

    def some(section: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(section).alias("section"), v.cast("string").alias("label")))

    def one(section: str, good: Column) -> Column:
        return some(section, F.array(F.when(bad, nested.UNSEEN).otherwise(good)))

    def failed(section: str, values: list[Column]) -> Column:
        return some(section, F.when(bad, F.array(*values)).otherwise(F.array().cast("array<string>")))

    ended = [F.concat(F.lit(f"{c} exit "), F.coalesce(status, F.col("verdict.exit_status") if c == COMMANDS[2] else F.lit(0)).cast("string")) for c in COMMANDS]
    outcome = F.transform(F.coalesce("checks", F.array().cast(f"array<{nested.CHECK}>")), lambda c: F.concat_ws(" ", c["check"], c["outcome"], F.coalesce(c["code"], c["rule"])))
    entries = F.col("entries")
    return F.concat(
        some("packages", F.array(F.lit("packages read"))),
        some("exit_status", F.array(*ended)),
        failed("codes", [F.concat(F.lit(f"{c} "), code) for c in COMMANDS]),
        failed("categories", [category] * len(COMMANDS)),
        some("checks", outcome),
        one("root_prefix", nested.prefix_class(read.text_of(F.col("document.prefix")))),
        one("file_name_casing", nested.casing_class(read.text_of(F.col("document.name")))),
        one("marker", nested.marker_class(entries)),
        some("payload", F.when(bad, F.array(F.lit(nested.UNSEEN))).otherwise(nested.payload_classes(entries))),
        one("entry_count", nested.entry_bucket(F.size(entries))),
    )


def report(scanned: DataFrame) -> DataFrame:
    """section, label, n over a whole corpus; a section without labels has one row (none) with 0."""
    counted = read.checked(scanned).select(F.inline(labels())).groupBy("section", "label").agg(F.count("*").alias("n"))
    every = scanned.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, SECTIONS))).alias("section"))
    return every.join(counted, "section", "left").select("section", F.coalesce("label", F.lit(NONE)).alias("label"), F.coalesce("n", F.lit(0)).alias("n"))
