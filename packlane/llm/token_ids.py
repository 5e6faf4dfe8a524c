"""Token-id output: frequency-ranked ids in a byte-aligned variable-length code.

Texts are encoded once with a public tokenizer; ids are counted over the whole
corpus, and a token is written as its rank by frequency. A rank takes one to
four bytes; its length is a 2-bit code in a separate stream of control bytes
(four ranks each), so that numpy decodes a block by table lookup: control
bytes index a table of lengths, prefix sums give offsets, and bytes are
gathered and shifted.

File format of a shard (little-endian): ``TIDS`` and the version as u32; then
the rank table as u32 count and u32 ids; then blocks, each ``BLCK``, u32
documents, u32 tokens, u32 bytes of data, i64 doc_ids, a byte each that is 1
for a null doc_id, u32 lengths, control bytes, data. Shards hold ascending
ranges of doc_id; null doc_ids come first.

The tokenizer is called for each distinct piece of text between white space in
a task, and its answers are kept in a bounded cache. That equals encoding the
whole text where the normaliser and the pre-tokenizer are those that the short
way was written for (RULES), which is compared when a tokenizer is loaded; with
any other one, and with ``whole_texts=True``, texts are encoded as they are.

Shards are cut by doc_id, then length, a hash of the ids and a number of the
row, so that many rows without a doc_id, or with one, are cut too.

Cases: null and empty texts have the end id alone; rows with equal doc_ids stay
side by side in the order of their lengths, then of a hash of their ids; an empty table writes no shard. Other
columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

VOCABULARY = "word_bpe_49k.json"
END = 2
#: Pieces whose ids a worker keeps; the cache is emptied beyond it.
CACHE = 1_000_000
#: Tokens that are counted at once, but for a longer text.
COUNTED = 1 << 19
#: Tokens in a block, about.
BLOCK = 1 << 18
#: Tokens in a shard, about.
SHARD = 8_000_000

_ASCII = re.compile(r"[a-z]+|[0-9]|[^a-z0-9]+")
_PLAIN = re.compile(r"[!-~]*")
#: ASCII signs that may trail a word and form one pre-token with each other.
SIGNS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in "'<|>")


#: The normaliser and the pre-tokenizer that the short way knows: fixed values.
RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


class Cache(dict):
    """Values by key, made when they are first asked for; emptied when it is full."""

    def __init__(self, make: Callable) -> None:
        self.make = make

    def __missing__(self, key):
        if len(self) > CACHE:
            self.clear()
        value = self[key] = self.make(key)
        return value


class Encoder:
    """Bytes of u32 ids of a text, by a cache over its pieces."""

    def __init__(self, path: str, whole_texts: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        about = json.loads(self.tokenizer.to_str())
        known = all(about[k] == v for k, v in RULES.items()) and all(t["content"].startswith("<|") for t in about["added_tokens"])
        self.whole = whole_texts or not known
        self.model, self.pieces = self.tokenizer.model, Cache(self._piece)
        self.letters = _byte_letters()

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _core(self, core: str) -> bytes:
        """A pre-token in the byte-level alphabet."""
        return _packed([t.id for t in self.model.tokenize(core)])

    def _piece(self, raw: bytes) -> bytes:
        """Plain words go straight to the model; what the normaliser or the splitter could treat otherwise goes through all of the tokenizer.

        A piece of more than one pre-token, or in capitals, is made of plain pieces in the same cache.
        """
        text = raw.decode()
        if text.isascii():
            if "'" not in text and "<|" not in text and _PLAIN.fullmatch(text):
                parts = _ASCII.findall(text.lower())
                return self._core(text) if parts == [text] else b"".join([self.pieces[x.encode()] for x in parts])
        else:
            word = text.rstrip(SIGNS)
            if word.isalpha() and max(word) < "ɐ" and "İ" not in word and unicodedata.is_normalized("NFC", word):
                lower = word.lower()
                if lower == text:
                    return self._core("".join(map(self.letters.__getitem__, raw)))
                ids = self.pieces[lower.encode()]
                return ids + self.pieces[text[len(word) :].encode()] if len(word) < len(text) else ids
        return _packed(self._ids(text))

    def __call__(self, text: bytes) -> bytes:
        if self.whole:
            return _packed(self._ids(text.decode()))
        return b"".join(map(self.pieces.__getitem__, text.split()))


_encoders: dict[tuple, Encoder] = {}


def _encoder(path: str, whole: bool) -> Encoder:
    """One for each worker process: a module's function is sent by name, and finds the dict of the worker's own module."""
    return _encoders.get((path, whole)) or _encoders.setdefault((path, whole), Encoder(path, whole))


TOKENS = "doc_id long, n_tokens long, narrow binary, wide binary, counts binary"


def _tokenise(path: str, end: int, whole: bool) -> Callable:
    """A row for each document, then one with how often this task's documents have each id."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path, whole)
        tail, names = struct.pack("<I", end), [x.split()[0] for x in TOKENS.split(", ")]
        total = np.zeros(0, np.int64)
        for batch in common.batches(rows):
            docs, ids = batch.column(0), [np.frombuffer(encode(t) + tail, "<u4") for t in common.texts(batch.column(1))]
            ends = np.cumsum([len(x) for x in ids]) // COUNTED
            for _, same in groupby(zip(ends.tolist(), ids), itemgetter(0)):
                n = np.bincount(np.concatenate([x for _, x in same]), minlength=len(total))
                n[: len(total)] += total
                total = n
            for i in range(0, len(ids), 100):
                part = ids[i : i + 100]
                narrow = [x.astype("<u2").tobytes() if x.max() < 1 << 16 else b"" for x in part]
                wide = [b"" if n else x.tobytes() for n, x in zip(narrow, part)]
                yield pa.RecordBatch.from_arrays([docs.slice(i, len(part)), pa.array([len(x) for x in part], pa.int64()), pa.array(narrow, pa.binary()), pa.array(wide, pa.binary()), pa.nulls(len(part), pa.binary())], names)
        if len(total):
            none = [pa.nulls(1, k) for k in (pa.int64(), pa.int64(), pa.binary(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*none, pa.array([total.astype("<i8").tobytes()], pa.binary())], names)

    return run


def _row_ids(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(n, "<u2").astype(np.uint32) if n else np.frombuffer(w, "<u4") for n, w in zip(batch.column("narrow").to_pylist(), batch.column("wide").to_pylist())]


def _counts(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, n of tasks' packed counts."""
    for batch in common.batches(rows):
        for packed in batch.column(0).to_pylist():
            total = np.frombuffer(packed, "<i8")
            ids = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids], pa.int64())], ["id", "n"])


# -- the code ---------------------------------------------------------------

#: Bytes of the four ranks that a control byte speaks for.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data of ranks below 2**32."""
    n = len(ranks)
    padded = np.zeros(-(-n // 4) * 4, np.uint32)
    padded[:n] = ranks
    code = (padded > 0xFF).astype(np.uint8) + (padded > 0xFFFF) + (padded > 0xFFFFFF)
    control = code.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)
    four = padded.astype("<u4").view(np.uint8).reshape(-1, 4)[:n]
    data = four[np.arange(4) <= code[:n, None]]
    return control.sum(axis=1, dtype=np.uint8).tobytes(), data.tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    sizes = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    ends = np.cumsum(sizes)
    starts = ends - sizes
    raw = np.frombuffer(data, np.uint8)
    out = raw[starts].astype(np.uint32) if n else np.zeros(0, np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(sizes > k)
        out[more] |= raw[starts[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


class ShardWriter:
    def __init__(self, out, ids_by_rank: np.ndarray) -> None:
        self.out = out
        self.rank = np.zeros(int(ids_by_rank.max(initial=0)) + 1, np.uint32)
        self.rank[ids_by_rank] = np.arange(len(ids_by_rank), dtype=np.uint32)
        self.docs: list = []
        self.ids: list[np.ndarray] = []
        self.held = 0
        out.write(struct.pack("<4sII", b"TIDS", 1, len(ids_by_rank)) + ids_by_rank.astype("<u4").tobytes())

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.ids.append(ids)
        self.held += len(ids)
        if self.held >= BLOCK:
            self.flush()

    def flush(self) -> None:
        if self.docs:
            control, data = encode_ranks(self.rank[np.concatenate(self.ids)])
            self.out.write(struct.pack("<4sIII", b"BLCK", len(self.docs), self.held, len(data)))
            self.out.write(np.array([d or 0 for d in self.docs], "<i8").tobytes() + bytes(d is None for d in self.docs))
            self.out.write(np.array([len(x) for x in self.ids], "<u4").tobytes() + control + data)
        self.docs, self.ids, self.held = [], [], 0


def read_shard(stream) -> Iterator[tuple[object, np.ndarray]]:
    """(doc_id, ids) of each document, a block in memory at a time."""
    magic, version, n = struct.unpack("<4sII", stream.read(12))
    if (magic, version) != (b"TIDS", 1):
        raise ValueError("not a token-id shard")
    ids_by_rank = np.frombuffer(stream.read(4 * n), "<u4")
    while head := stream.read(16):
        magic, docs, tokens, size = struct.unpack("<4sIII", head)
        if magic != b"BLCK":
            raise ValueError("damaged token-id shard")
        names, nulls = np.frombuffer(stream.read(8 * docs), "<i8").tolist(), stream.read(docs)
        ends = np.cumsum(np.frombuffer(stream.read(4 * docs), "<u4"), dtype=np.int64)
        ids = ids_by_rank[decode_ranks(stream.read(-(-tokens // 4)), stream.read(size), tokens)]
        for name, null, part in zip(names, nulls, np.split(ids, ends[:-1])):
            yield (None if null else name), part


# -- the operator -----------------------------------------------------------


def _write(uri: str, ids_by_rank: np.ndarray) -> Callable:
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = common.batches(rows)
        first = next(rows, None)
        if first is None:
            return
        task = TaskContext.get()
        name, docs, tokens = f"shard-{task.partitionId():06d}.tids", 0, 0

        def fill(out):
            nonlocal docs, tokens
            writer, batch = ShardWriter(out, ids_by_rank), first
            while batch is not None:
                for doc_id, ids in zip(batch.column("doc_id").to_pylist(), _row_ids(batch)):
                    writer.add(doc_id, ids)
                    docs, tokens = docs + 1, tokens + len(ids)
                batch = next(rows, None)
            writer.flush()

        common.put_file(uri, name, f"{task.taskAttemptId()}-{uuid.uuid4().hex[:6]}", fill)
        yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()], pa.int64()), pa.array([name]), pa.array([docs], pa.int64()), pa.array([tokens], pa.int64())], ["shard", "name", "docs", "tokens"])

    return run


def write(docs: DataFrame, tokenizer: str | None = None, end: int = END, whole_texts: bool = False) -> tuple[str, DataFrame]:
    """The folder of the shards of docs(doc_id, text), and a row for each shard: shard, name, docs, tokens, base."""
    spark = common.prepare(docs.sparkSession)
    given = common.pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    encoded = given.mapInArrow(_tokenise(tokenizer or default_tokenizer(), end, whole_texts), TOKENS)
    # numbered when it is written: rows that are alike in all else are told apart
    rows = common.table(encoded.withColumn("row", F.monotonically_increasing_id()), "token-rows")
    # a row for each id of the vocabulary at most
    ranked = rows.where("counts IS NOT NULL").select("counts").mapInArrow(_counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "id").toPandas()
    shards = max(1, int(ranked["n"].sum()) // SHARD)
    uri = common.shared_dir(spark, "token-ids")
    tied = rows.where("counts IS NULL").drop("counts").withColumn("h", F.xxhash64("narrow", "wide"))
    order = ("doc_id", "n_tokens", "h", "row")
    ordered = tied.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    made = common.table(ordered.mapInArrow(_write(uri, ranked["id"].to_numpy(np.uint32)), "shard long, name string, docs long, tokens long"), "token-shards")
    base, listed = 0, []
    for r in made.orderBy("shard").toLocalIterator():
        listed.append((r.shard, r.name, r.docs, r.tokens, base))
        base += r.tokens
    return uri, spark.createDataFrame(listed, "shard long, name string, docs long, tokens long, base long")


def _read(uri: str) -> Callable:
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = common.open_fs(uri)
        for batch in rows:
            for shard in batch.to_pylist():
                at, out = shard["base"], []
                with where.open_input_stream(f"{path}/{shard['name']}", compression=None) as f:
                    for doc_id, ids in read_shard(f):
                        out.append((doc_id, at, len(ids), ids.astype("<u4").tobytes()))
                        at += len(ids)
                        if len(out) == 500:
                            yield _rows(out)
                            out = []
                yield _rows(out)

    return run


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["doc_id", "start", "n_tokens", "ids"])


def read(uri: str, shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian u32) of every document in the shards."""
    n = shards.count()
    return (shards.repartition(n, "shard") if n > 1 else shards).mapInArrow(_read(uri), "doc_id long, start long, n_tokens long, ids binary")


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri, shards = write(common.documents(spark, sf_dir))
    return read(uri, shards).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
