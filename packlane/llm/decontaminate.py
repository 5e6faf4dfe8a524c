r"""Benchmark decontamination by spaced-seed hashing.

A seed is a mask over consecutive words in which some places are ignored, so
that a copy with substituted words still meets a benchmark item wherever the
places that count are whole. Documents and items are hashed at every position
under every mask; equal hashes are hits on a diagonal (place in the document
less place in the item). A diagonal with a hit is a leak if any segment of it
has SIMILAR of its words equal and covers SIMILAR of the item, or at least LONG
equal words; of such segments the one with most equal words is taken.

The masks alone miss segments with dense substitutions. So each item is also
hashed by whole runs of words, as long as every segment that can be a leak of
an item of its length must hold (see run_length): no leak is without a hit.

Words: letters, digits and bytes from 0x80 on, A-Z lower-cased.

Items are a stated set. They are dealt by hash into blocks of at most about
BLOCK_WORDS words, and each block's index is broadcast and meets all documents
in a pass of its own; benchmarks of less have one block. There is one path
whatever the size, and no seed, however common, makes rows of its own.

Cases: null and empty texts and items have no words and no leaks; repeated
items are each reported; an item of one or two words matches as a whole; a
null doc_id is reported as null. Other columns are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .license_scan import tokens

#: 1 counts, 0 is ignored; each of weight 5, so that a copy with a word in five substituted is still met.
MASKS = ("1101011", "11000111", "1010010011")
SIMILAR, LONG = 0.8, 13
#: The offsets that count under each mask, and an odd factor for each offset.
SHAPES = [tuple(i for i, c in enumerate(m) if c == "1") for m in MASKS]
FACTORS = common.mix64(np.arange(1, 4 * LONG + 1)) | np.uint64(1)
#: Places that are hashed at once, and words of documents that share a pass of hashing.
CHUNK, GROUP = 1 << 14, 1 << 16
#: Words of the items that are broadcast at once.
BLOCK_WORDS = 500_000

HITS = "doc_id long, item_id long, start long, item_start long, length long, matched long, item_words long"


def hash_words(text: bytes, word_hash: common.WordHash) -> np.ndarray:
    return word_hash(tokens(text))


def hashes(h: np.ndarray, shapes: list[tuple[int, ...]]) -> list[np.ndarray]:
    """For each shape, the hash at each place where it fits of the words at its offsets.

    A sum of word hashes, each times a factor of its offset: the products are shared by all shapes.
    """
    held: dict[int, np.ndarray] = {}
    out = []
    for shape in shapes:
        n = max(0, len(h) - shape[-1])
        acc = np.full(n, common.mix64(np.array([sum(1 << i for i in shape)], np.uint64))[0], np.uint64)
        for i in shape:
            if i not in held:
                held[i] = h * FACTORS[i]
            acc += held[i][i : i + n]
        out.append(acc)
    return out


def seeds(h: np.ndarray) -> list[np.ndarray]:
    """Hashes under each mask at each place."""
    return hashes(h, SHAPES)


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words."""
    return hashes(h, [tuple(range(k))])[0]


#: The score of a substituted word, at which a segment is not below 0 if SIMILAR of its words are equal.
SUBSTITUTED = -round(SIMILAR / (1 - SIMILAR))


def needed(n: int) -> int:
    """Equal words that a leak of an item of n words has at least."""
    return min(LONG, -(SUBSTITUTED * n // (1 - SUBSTITUTED)))


def run_length(n: int) -> int:
    """Words of the longest run without a substitution that each leak of an item of n words holds.

    Of m equal words, cut by no more substitutions than SIMILAR allows and the
    item has room for, one run has an equal share at least. 4 from 16 words on.
    """
    return min(-(-m // (1 + min(m // -SUBSTITUTED, n - m))) for m in range(needed(n), min(n, 4 * LONG) + 1))


def item_seeds(h: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(0, hashes by place) for each mask that fits, and (k, hashes by place) of the runs of k words."""
    if not len(h):
        return []
    k = run_length(len(h))
    return [*((0, s) for s in seeds(h) if len(s)), (k, runs(h, k))]


def verify(doc: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int, int, int] | None:
    """(start in the document, start in the item, length, matched) of a leak on a diagonal, or None."""
    lo, hi = max(0, -diagonal), min(len(item), len(doc) - diagonal)
    same = doc[lo + diagonal : hi + diagonal] == item[lo:hi]
    score = np.concatenate([[0], np.cumsum(np.where(same, 1, SUBSTITUTED))])
    equal = np.concatenate([[0], np.cumsum(same)])
    # for each end the first start from which SIMILAR is kept: no other one has more equal words
    first = np.searchsorted(-np.minimum.accumulate(score), -score, "left")
    matched = equal - equal[first]
    end = int(matched.argmax())
    if not matched[end] or matched[end] < needed(len(item)):
        return None
    at = np.flatnonzero(same[first[end] : end]) + int(first[end])
    start, n = int(at[0]), int(at[-1] - at[0]) + 1
    return start + lo + diagonal, start + lo, n, int(matched[end])


class Items:
    """Benchmark items and a sorted table of their seeds."""

    def __init__(self, ids: list, words: list[np.ndarray]) -> None:
        self.ids, self.words = ids, words
        keys, item, place, self.runs = [], [], [], set()
        for i, h in enumerate(words):
            for k, s in item_seeds(h):
                if k:
                    self.runs.add(k)
                keys.append(s)
                item.append(np.full(len(s), i))
                place.append(np.arange(len(s)))
        self.keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        order = np.argsort(self.keys, kind="stable")
        self.keys = self.keys[order]
        self.item = (np.concatenate(item) if item else np.zeros(0, np.int64))[order]
        self.place = (np.concatenate(place) if place else np.zeros(0, np.int64))[order]
        # a filter of 16 to 32 entries a key before the search
        bits = max(16, (16 * len(self.keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.filter = np.zeros(1 << bits, bool)
        self.filter[(self.keys >> self.shift).astype(np.int64)] = True
        self.shapes = [*SHAPES, *(tuple(range(k)) for k in sorted(self.runs))]

    def _met(self, h: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(place, words that the shape spans, first and last of the keys) of every place whose hash is a key."""
        longest = max(s[-1] for s in self.shapes)
        for start in range(0, len(h), CHUNK):
            for shape, s in zip(self.shapes, hashes(h[start : start + CHUNK + longest], self.shapes)):
                s = s[:CHUNK]
                at = np.flatnonzero(self.filter[(s >> self.shift).astype(np.int64)])
                if not len(at):
                    continue
                lo, hi = np.searchsorted(self.keys, s[at], "left"), np.searchsorted(self.keys, s[at], "right")
                for p, a, b in zip(at[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist()):
                    yield start + p, shape[-1] + 1, a, b

    def hits(self, docs: list[np.ndarray]) -> list[set[tuple[int, int]]]:
        """(item, diagonal) of every hit of each document; a hit across two documents is none."""
        found: list[set[tuple[int, int]]] = [set() for _ in docs]
        starts = [0, *np.cumsum([len(h) for h in docs]).tolist()]
        for p, n, a, b in self._met(np.concatenate(docs) if len(docs) != 1 else docs[0]) if docs else ():
            d = bisect_right(starts, p) - 1
            if p + n <= starts[d + 1]:
                found[d].update((i, p - starts[d] - q) for i, q in zip(self.item[a:b].tolist(), self.place[a:b].tolist()))
        return found

    def leaks(self, h: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """The best leak of each item: (item, start, start in the item, length, matched)."""
        return self._best(h, self.hits([h])[0])

    def _best(self, h: np.ndarray, hits: set[tuple[int, int]]) -> list[tuple[int, int, int, int, int]]:
        best: dict[int, tuple] = {}
        for i, diagonal in sorted(hits):
            if (v := verify(h, self.words[i], diagonal)) and (i not in best or v[3] > best[i][3]):
                best[i] = v
        return [(i, *v) for i, v in sorted(best.items())]

    def leaks_of(self, texts: list[bytes], word_hash: common.WordHash) -> Iterator[list[tuple[int, int, int, int, int]]]:
        """leaks of each text; texts of GROUP words or less are hashed together, whatever their borders."""
        group, held = [], 0
        for i, text in enumerate(texts):
            group.append(hash_words(text, word_hash))
            held += len(group[-1])
            if held >= GROUP or i + 1 == len(texts):
                yield from (self._best(h, hits) for h, hits in zip(group, self.hits(group)))
                group, held = [], 0


def load(items: DataFrame) -> Items:
    word_hash = common.WordHash()
    rows = sorted(((r.item_id, bytes(r.text)) for r in items.toLocalIterator()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    return Items([i for i, _ in rows], [hash_words(t, word_hash) for _, t in rows])


def _given(docs: DataFrame, name: str) -> DataFrame:
    return common.pick(docs, name, "text").select(F.col(name).cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))


def blocks(items: DataFrame) -> list[DataFrame]:
    """The items in parts whose counted bytes bound what is broadcast."""
    given = _given(items, "item_id")
    n = given.agg(F.sum(F.octet_length("text") / 2 + 1)).first()[0] or 0
    parts = max(1, math.ceil(n / BLOCK_WORDS))
    return [given.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == i) if parts > 1 else given for i in range(parts)]


def _rows(out: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in HITS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(len(names))], names)


def _leaks_of(docs: DataFrame, block: DataFrame) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(load(block))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, word_hash = held.value, common.WordHash()
        for batch in common.batches(rows):
            out = []
            for doc_id, found in zip(batch.column(0).to_pylist(), index.leaks_of(common.texts(batch.column(1)), word_hash)):
                out += [(doc_id, index.ids[i], a, q, n, m, len(index.words[i])) for i, a, q, n, m in found]
            yield _rows(out)

    return docs.mapInArrow(run, HITS)


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """A row for each document and item that it holds (see HITS)."""
    common.prepare(docs.sparkSession)
    found = [_leaks_of(_given(docs, "doc_id"), block) for block in blocks(items)]
    if len(found) > 1:  # one index in a worker at a time
        found = [common.table(x, "leak-rows") for x in found]
    return reduce(DataFrame.unionByName, found)


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that hold no item."""
    spark = common.prepare(docs.sparkSession)
    at = docs.columns.index("text")
    for i, block in enumerate(blocks(items)):
        held = spark.sparkContext.broadcast(load(block))
        docs = common.table(docs, "leak-clean") if i else docs

        def run(rows: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index, word_hash = held.value, common.WordHash()
            for batch in common.batches(rows):
                yield batch.filter(pa.array([not x for x in index.leaks_of(common.texts(batch.column(at)), word_hash)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
