"""Extraction: a plan for each package, all of it or nothing; bytes as a table, or files below a directory."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.failure import Violation
from ..functions.limits import ArchiveLimits, PlanLimits
from ..operators import nested, scan

KEY = "package_id"
MARK = ".packlane-incomplete"


def planned(scanned: DataFrame, limits: PlanLimits = PlanLimits()) -> DataFrame:
    """scanned with items (the files to write, in order) and failure, for packages that could be read."""
    files = F.transform(F.filter("entries", lambda e: e["kind"] != "directory"), lambda e: F.struct(e["entry_index"].alias("entry_index"), e["name_text"].alias("path"), e["path_key"].alias("key"), e["kind"].alias("kind"), e["decoded_size"].alias("decoded_size")))
    rows = scanned.where("violation IS NULL").withColumn("items", files)
    return rows.withColumn("failure", nested.plan_failure(F.col("items"), limits.files, limits.total))


def plan(scanned: DataFrame, limits: PlanLimits = PlanLimits()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, directories, failures) of readable packages."""
    rows = planned(scanned, limits)
    good = rows.where("failure IS NULL")
    items = good.select(KEY, F.inline("items")).select(KEY, "entry_index", "path", "decoded_size")
    above = good.select(KEY, F.explode(nested.directories(nested.field(F.col("items"), "path"))).alias("directory"))
    return items, above, rows.where("failure IS NOT NULL").select(KEY, "failure.*")


def _with_bytes(packages: DataFrame, limits: PlanLimits, archive: ArchiveLimits) -> DataFrame:
    """Planned packages with files: path and bytes. Each image is scanned once, and its bytes stay in the task that read it."""
    rows = planned(scan.scan(packages, archive, contents=True), limits).where("failure IS NULL")
    files = F.transform("items", lambda i: F.struct(i["path"].alias("path"), F.element_at(F.col("contents"), i["entry_index"] + 1).alias("bytes")))
    return rows.select(KEY, files.alias("files"))


def tables(packages: DataFrame, limits: PlanLimits = PlanLimits(), archive: ArchiveLimits = ArchiveLimits()) -> DataFrame:
    """package_id, path, bytes of every planned file: what a corpus extraction writes as Parquet."""
    return _with_bytes(packages, limits, archive).select(KEY, F.inline("files"))


def _refuse(code: str) -> Violation:
    return Violation(f"output.{code}")


def _open_below(root: int, parts: list[str], made: list[tuple[int, str]] | None) -> int:
    """A descriptor of a directory below root, never through a link; missing ones are made where made is given."""
    here = os.dup(root)
    for name in parts:
        try:
            if made is not None:
                try:
                    os.mkdir(name, dir_fd=here)
                    made.append((os.dup(here), name))
                except FileExistsError:
                    pass
            down = os.open(name, os.O_RDONLY | os.O_DIRECTORY | os.O_NOFOLLOW, dir_fd=here)
        except FileNotFoundError:
            os.close(here)
            raise
        except OSError:
            link = stat.S_ISLNK(os.lstat(name, dir_fd=here).st_mode)
            os.close(here)
            raise _refuse("symlink_in_path" if link else "not_a_directory") from None
        os.close(here)
        here = down
    return here


def write_files(root: str, files: list[tuple[str, bytes]]) -> dict:
    """Write a package's files below an existing directory: nothing is overwritten, and a failure takes back what was written."""
    try:
        kind = os.lstat(root).st_mode
    except FileNotFoundError:
        raise _refuse("destination_missing") from None
    if stat.S_ISLNK(kind) or not stat.S_ISDIR(kind):
        raise _refuse("destination_symlink" if stat.S_ISLNK(kind) else "destination_not_a_directory")
    top = os.open(root, os.O_RDONLY | os.O_DIRECTORY | os.O_NOFOLLOW)
    made: list[tuple[int, str]] = []
    written: list[tuple[int, str]] = []
    try:
        if os.path.lexists(os.path.join(root, MARK)):
            raise _refuse("partial_marker_present")
        for path, _ in files:
            _absent(top, path.split("/"))
        os.close(os.open(MARK, os.O_WRONLY | os.O_CREAT | os.O_EXCL | os.O_NOFOLLOW, 0o600, dir_fd=top))
        try:
            for path, data in files:
                *above, name = path.split("/")
                at = _open_below(top, above, made)
                f = os.open(name, os.O_WRONLY | os.O_CREAT | os.O_EXCL | os.O_NOFOLLOW, 0o644, dir_fd=at)
                written.append((at, name))
                with os.fdopen(f, "wb") as out:
                    out.write(data)
        except (OSError, Violation) as e:
            for at, name in reversed(written):
                os.unlink(name, dir_fd=at)
            for at, name in reversed(made):
                try:
                    os.rmdir(name, dir_fd=at)
                except OSError:
                    pass
            os.unlink(MARK, dir_fd=top)
            raise (e if isinstance(e, Violation) else _refuse("exists" if isinstance(e, FileExistsError) else "io")) from None
        os.unlink(MARK, dir_fd=top)
        return {"files_written": len(files), "directories_created": len(made), "bytes_written": sum(len(d) for _, d in files)}
    finally:
        for fd in {fd for fd, _ in [*made, *written]} | {top}:
            os.close(fd)


def _absent(top: int, parts: list[str]) -> None:
    if parts[0] == MARK:
        raise _refuse("exists")
    try:
        at = _open_below(top, parts[:-1], None)
    except FileNotFoundError:
        return
    try:
        os.lstat(parts[-1], dir_fd=at)
    except FileNotFoundError:
        return
    finally:
        os.close(at)
    raise _refuse("exists")


def files(packages: DataFrame, root: str, limits: PlanLimits = PlanLimits(), archive: ArchiveLimits = ArchiveLimits()) -> DataFrame:
    """Write each package below root/package_id on a folder that all executors share; a row for each: counts or a code.

    A package's plan ceilings bound what a task holds. Speculation must be
    off; a task that is run again finds its files and reports them as existing.
    """
    kinds = "package_id string, files_written int, directories_created int, bytes_written long, code string"
    schema = scan.arrow_schema(kinds)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for i in range(batch.num_rows):
                key, held = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                base, out = os.path.join(root, key), {"package_id": key, "files_written": 0, "directories_created": 0, "bytes_written": 0, "code": None}
                try:
                    os.makedirs(base, exist_ok=True)
                    out |= write_files(base, sorted((f["path"], f["bytes"]) for f in held))
                except Violation as v:
                    out["code"] = v.code
                yield pa.RecordBatch.from_pylist([out], schema)

    return _with_bytes(packages, limits, archive).mapInArrow(run, kinds)
