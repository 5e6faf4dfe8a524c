r"""Exact dedup with an extendible-hash index on shared files.

Scan tasks normalise each text (every ``[\x20\x09-\x0D]+`` becomes one space),
fold equal texts within a bounded window into one entry, and hand entries to
owner tasks by key range (the top bits of the key). An owner inserts its
entries into an extendible-hash index: a directory that doubles and buckets
that split when overfull; entries of one key are chained and told apart by
their bytes. It writes the index in the shared folder and answers from the
file that it wrote. A text of more than WINDOWS windows, found by key and
SHA-256 with partial aggregation, sends the bytes of one entry for all of them,
so that a group that holds a third of all rows reaches its owner as a few
entries; members find the answer by entry, not by key.

Cases: a null text counts as empty, and empty texts are equal to each other; a
null doc_id sorts last, so it is kept only in a group that has no other; rows
repeated with the same doc_id stay once; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: A scan task folds equal texts within so many bytes and rows.
WINDOW_BYTES, WINDOW_ROWS = 32 << 20, 200_000
#: Entries in a bucket before it splits.
BUCKET = 64
#: Normalised bytes that one owner should hold.
OWNER_BYTES = 8 << 20
#: Normalised bytes of the owners that share a partition.
PART_BYTES = 16 << 20
#: Windows of which each may send its entry of a text to the owner.
WINDOWS = 16
#: A directory doubles so often at most; a bucket that is still overfull then stays so (keys are hashes: it takes very many equal heads).
DEEPEST = 20
SLOT = struct.Struct("<Qqqqq")  # key, record, chain, keep, rows
NO_ID = (1 << 63) - 1

ROWS = "entry long, doc_id long, lead boolean, key long, rows long, sha binary, text binary"
FOUND = "entry long, keep_entry long, keep_id long, group_size long, text_sha256 string"


def normalise(text: bytes) -> bytes:
    """Each run of white space becomes one space, at the ends too."""
    parts = text.split()
    if not parts:
        return b" " if text else b""
    edge = common.WORD_BREAKS
    return (b" " if text[0] in edge else b"") + b" ".join(parts) + (b" " if text[-1] in edge else b"")


class ExtendibleHash:
    """Directory doubling over buckets of slots; slots of equal keys are chained by record number."""

    def __init__(self, capacity: int = BUCKET, shift: int = 0) -> None:
        self.capacity, self.shift, self.depth = capacity, shift, 0
        self.directory = [0]
        self.local, self.buckets = [0], [{}]
        self.next: list[int] = []

    def _home(self, key: int) -> int:
        """Bits below the owner's own range choose the bucket."""
        return ((key << self.shift) & 0xFFFFFFFFFFFFFFFF) >> (64 - self.depth) if self.depth else 0

    def find(self, key: int) -> Iterator[int]:
        at = self.buckets[self.directory[self._home(key)]].get(key, -1)
        while at >= 0:
            yield at
            at = self.next[at]

    def insert(self, key: int) -> int:
        """A new record at the head of its key's chain."""
        record = len(self.next)
        while True:
            b = self.directory[self._home(key)]
            bucket = self.buckets[b]
            if key in bucket or len(bucket) < self.capacity or self.local[b] >= min(DEEPEST, 64 - self.shift):
                self.next.append(bucket.get(key, -1))
                bucket[key] = record
                return record
            self._split(b)

    def _split(self, b: int) -> None:
        if self.local[b] == self.depth:
            self.directory = [x for x in self.directory for _ in (0, 1)]
            self.depth += 1
        self.local[b] += 1
        new = len(self.buckets)
        self.local.append(self.local[b])
        old, bit = self.buckets[b], 64 - self.shift - self.local[b]
        self.buckets.append({k: v for k, v in old.items() if k >> bit & 1})
        self.buckets[b] = {k: v for k, v in old.items() if not k >> bit & 1}
        span = self.depth - self.local[b]
        for i, x in enumerate(self.directory):
            if x == b and i >> span & 1:
                self.directory[i] = new

    def save(self, out, keep: list[int], rows: list[int]) -> None:
        """Depth, directory, then each bucket as a count and its slots, chains in place."""
        out.write(struct.pack("<4sIII", b"EXH1", self.depth, self.shift, len(self.buckets)))
        out.write(np.array(self.directory, "<u4").tobytes())
        for bucket in self.buckets:
            slots = []
            for key, record in bucket.items():
                while record >= 0:
                    slots.append(SLOT.pack(key, record, self.next[record], keep[record], rows[record]))
                    record = self.next[record]
            out.write(struct.pack("<I", len(slots)))
            out.write(b"".join(slots))


class IndexFile:
    """An index read back: record -> (key, kept id, rows)."""

    def __init__(self, data: bytes) -> None:
        magic, depth, self.shift, count = struct.unpack_from("<4sIII", data)
        if magic != b"EXH1":
            raise ValueError("not an index file")
        self.depth, at = depth, 16
        self.directory = np.frombuffer(data, "<u4", 1 << depth, at)
        at += 4 << depth
        self.buckets = []
        for _ in range(count):
            (n,) = struct.unpack_from("<I", data, at)
            self.buckets.append([SLOT.unpack_from(data, at + 4 + i * SLOT.size) for i in range(n)])
            at += 4 + n * SLOT.size

    def find(self, key: int) -> list[tuple]:
        home = ((key << self.shift) & 0xFFFFFFFFFFFFFFFF) >> (64 - self.depth) if self.depth else 0
        return [s for s in self.buckets[self.directory[home]] if s[0] == key]


def key_of(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "big")


def _fold(hash_key: Callable[[bytes], int]) -> Callable:
    """Rows to a row for each document and one for each distinct text of a window."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, n = TaskContext.get().partitionId() << 36, 0
        names = [x.split()[0] for x in ROWS.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]

        def flush():
            leads = set(x for x in lead.values())
            for i in range(0, len(ids), 20_000):
                part = range(i, min(len(ids), i + 20_000))
                cols = [[base + entry[j] for j in part], [ids[j] for j in part], [j in leads for j in part], *[[None] * len(part)] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)
            made = list(found.values())
            for i in range(0, len(made), 200):
                part = made[i : i + 200]
                cols = [[base + e for e, _, _ in part], [ids[lead[e]] for e, _, _ in part], [None] * len(part), [((k + (1 << 63)) % (1 << 64)) - (1 << 63) for _, k, _ in part], [count[e] for e, _, _ in part], [hashlib.sha256(t).digest() for _, _, t in part], [t for _, _, t in part]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

        found, lead, count, ids, entry, held = {}, {}, {}, [], [], 0
        for batch in common.batches(rows):
            for doc_id, text in zip(batch.column(0).to_pylist(), common.texts(batch.column(1))):
                t = normalise(text)
                e = found.get(t)
                if e is None:
                    found[t] = e = (n, hash_key(t), t)
                    n += 1
                    held += len(t) + 200
                    lead[e[0]], count[e[0]] = len(ids), 0
                elif (NO_ID if doc_id is None else doc_id) < (NO_ID if (x := ids[lead[e[0]]]) is None else x):
                    lead[e[0]] = len(ids)
                count[e[0]] += 1
                ids.append(doc_id)
                entry.append(e[0])
            if held > WINDOW_BYTES or len(ids) > WINDOW_ROWS:
                yield from flush()
                found, lead, count, ids, entry, held = {}, {}, {}, [], [], 0
        yield from flush()

    return run


def _own(uri: str, bits: int) -> Callable[[pa.Table], pa.Table]:
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("key", "ascending"), ("entry", "ascending")])
        index = ExtendibleHash(shift=bits)
        entries, keys = group["entry"].to_pylist(), [k & 0xFFFFFFFFFFFFFFFF for k in group["key"].to_pylist()]
        leads, rows, leaders = group["doc_id"].to_pylist(), group["rows"].to_pylist(), group["leader"].to_pylist()
        text = group["text"]
        first: list[int] = []  # of each record, the entry whose bytes it stands for
        keep, total, at = [], [], []
        for i, key in enumerate(keys):
            mine = (NO_ID if leads[i] is None else leads[i], leaders[i])
            for r in index.find(key):
                if text[first[r]].equals(text[i]):
                    keep[r], total[r] = min(keep[r], mine), total[r] + rows[i]
                    break
            else:
                r = index.insert(key)
                first.append(i)
                keep.append(mine)
                total.append(rows[i])
            at.append(r)
        name = f"owner-{group['owner'][0].as_py():08d}.exh"
        common.put_file(uri, name, str(TaskContext.get().taskAttemptId()), lambda out: index.save(out, [k for k, _ in keep], total))
        where, path = common.open_fs(uri)
        with where.open_input_stream(f"{path}/{name}", compression=None) as f:
            saved = IndexFile(f.read())
        answer = {s[1]: s for key in set(keys) for s in saved.find(key)}
        sha = [group["sha"][i].as_py().hex() for i in first]
        return pa.table(
            {
                "entry": pa.array(entries, pa.int64()),
                "keep_entry": pa.array([keep[r][1] for r in at], pa.int64()),
                "keep_id": pa.array([None if answer[r][3] == NO_ID else answer[r][3] for r in at], pa.int64()),
                "group_size": pa.array([answer[r][4] for r in at], pa.int64()),
                "text_sha256": [sha[r] for r in at],
            }
        )

    return run


def exact_dedup(docs: DataFrame, hash_key: Callable[[bytes], int] | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of docs(doc_id, text).

    hash_key: the 64-bit key of a normalised text; the default is the head of its SHA-256.
    """
    spark = common.prepare(docs.sparkSession)
    hash_key = hash_key or (lambda t: key_of(hashlib.sha256(t).digest()))
    rows = common.table(common.pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_fold(hash_key), ROWS), "dedup-entries")
    entries = rows.where(F.col("key").isNotNull())
    # of a text of many windows: the first document of all, the entry that has it, and the entry that carries the bytes
    first = F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "entry")
    hot = entries.groupBy("key", "sha").agg(F.count("*").alias("n"), F.min(first).alias("first"), F.sum("rows").alias("all_rows"), F.min("entry").alias("carrier")).where(F.col("n") > WINDOWS)
    hot = common.table(hot.select("sha", F.nullif("first.id", F.lit(NO_ID)).alias("first_id"), F.col("first.entry").alias("leader"), "all_rows", "carrier"), "dedup-hot")
    marked = common.join_small(entries, hot, "sha")
    alone = F.col("carrier").isNull()
    size = entries.agg(F.sum(F.octet_length("text") + 100)).first()[0] or 0
    bits = max(2, min(30, (size // OWNER_BYTES).bit_length() + 1))
    owned = marked.where(alone | (F.col("entry") == F.col("carrier"))).select(
        "entry",
        F.coalesce("leader", "entry").alias("leader"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("first_id")).alias("doc_id"),
        "key",
        F.coalesce("all_rows", "rows").alias("rows"),
        "sha",
        "text",
        F.shiftrightunsigned("key", 64 - bits).alias("owner"),
    )
    owned = owned.repartition(max(1, min(1 << bits, size // PART_BYTES + 4)), "owner")
    found = common.table(owned.groupBy("owner").applyInArrow(_own(common.shared_dir(spark, "dedup-index"), bits), FOUND), "dedup-found")
    # what was found for a carrier holds for the entries of the other windows
    others = marked.where(F.col("entry") != F.col("carrier")).select(F.col("entry").alias("other"), "carrier")
    answers = others.join(found, others["carrier"] == found["entry"]).select(F.col("other").alias("entry"), *[c for c in found.columns if c != "entry"])
    found = found.unionByName(answers)
    members = rows.where(F.col("key").isNull()).select("entry", "doc_id", "lead")
    return members.join(found, "entry").select("doc_id", "keep_id", "group_size", (F.col("lead") & (F.col("entry") == F.col("keep_entry"))).alias("kept"), "text_sha256")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(common.documents(spark, sf_dir))


#: DuckDB's views give no regular expression over bytes, but these texts are UTF-8.
SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT doc_id, t, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g
"""
