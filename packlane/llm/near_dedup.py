r"""MinHash near-dedup: SuperMinHash signatures, banding, verification, union-find.

A document's set holds its distinct shingles of SHINGLE words. SuperMinHash
gives each shingle a random permutation of ranks over the registers, made step
by step, so that its ranks differ from register to register (which lowers the
variance), and a set stops as soon as no further step can lower a register.
Equal bands of registers make candidates, which are confirmed on full sets.

Scale and skew. Equal sets collapse into one representative before anything
else. In a bucket, every member is compared with PIVOTS members (stars, not all
pairs), and the confirmed links are grouped. Of each bucket that still holds
several groups, the pivot with most links is the centre, and what is left is a
join of differences: for a centre c, the difference of a set x is x xor c.
Sets x and y are similar enough only if their differences share at least
(|x xor c| + |y xor c| - most) / 2 elements, most being what x and y may differ
in; pairs that need share nothing hang on the centre already. So the members
meet by the rarest elements of their differences (a prefix in order of how many
members hold them, as long as the overlap demands), not by their bucket, and
only members of different groups. Near copies of one text differ from its
centre in elements of their own, so a bucket of m near copies gives about m
candidates, whatever their similarity; only sets that do share most of a
difference are compared with each other. All pairs that share a band and
are similar enough are found. Two sets similar to 0.85 share none with a
probability of 8e-7, two similar to 0.8 with 7e-5 (measured recall in the
tests: 1). Pairs with a pivot are left out if their sizes do not allow the
similarity, or if their signatures (4 bits of each register) differ in more
registers than a link would by 5.5 standard deviations. Sets are fetched for
candidates alone.

Groups are joined by union-find: a task merges the links that it holds into
trees, then rounds of smallest-neighbour steps shorten the trees over all
tasks, each round a table in the shared folder, until nothing changes.

Cases: null texts and texts without words have an empty set and are linked
with nothing; fewer words than a shingle are one shingle; a null doc_id is a
group of its own; rows repeated with one doc_id share their group, and the
group of each text is joined to it. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SHINGLE = 5
BANDS, ROWS = 24, 5
REGISTERS = BANDS * ROWS
#: Members of a bucket that all others are compared with first.
PIVOTS = 4
#: A link: 100 * intersection >= PERCENT * union.
PERCENT = 85

STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(batch: list[bytes], word_hash: common.WordHash, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted within each, and where each text starts (one more entry)."""
    w, ends = common.flat_words(batch, word_hash)
    sizes = np.diff(ends)
    n = np.where(sizes >= k, sizes - k + 1, np.minimum(sizes, 1))
    doc = np.repeat(np.arange(len(batch)), n)
    first = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(ends[:-1], n)
    h = np.repeat(np.minimum(sizes, k).astype(np.uint64), n)
    last = np.repeat(ends[1:], n)
    for i in range(k):
        at = first + i
        inside = at < last
        h[inside] = common.mix64((h[inside] + STEP) * np.uint64(0xD6E8FEB86659FD93) ^ w[at[inside]])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[keep], doc[keep]
    return h, np.searchsorted(doc, np.arange(len(batch) + 1))


def super_minhash(elements: np.ndarray, starts: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """Signatures (sets x m) of sets given as elements and starts; empty sets keep infinity."""
    sets = len(starts) - 1
    out = np.full((sets, m), np.inf)
    of = np.repeat(np.arange(sets), np.diff(starts))
    active = np.arange(len(elements))
    places = None  # of the active elements, the permutation so far
    for j in range(m):
        e = elements[active]
        draw = common.mix64(e + np.uint64(int(STEP) * (j + 1) & 0xFFFFFFFFFFFFFFFF))
        rank = (draw >> np.uint64(12)).astype(np.float64) / float(1 << 52) + j
        k = j + (common.mix64(draw ^ STEP) >> np.uint64(33)).astype(np.int64) % (m - j)
        if places is None:
            register = k
        else:
            row = np.arange(len(active))
            register = places[row, k].astype(np.int64)
            places[row, k] = places[row, j]
            places[row, j] = register
        np.minimum.at(out.reshape(-1), of[active] * m + register, rank)
        # a set is done when every register is below what the next step can give
        left = (out >= j + 1).any(axis=1)[of[active]]
        if not left.any():
            break
        if places is None:
            places = np.tile(np.arange(m, dtype=np.uint16), (int(left.sum()), 1))
            row, k = np.arange(len(places)), k[left]
            places[row, k], places[row, 0] = 0, k
        else:
            places = places[left]
        active = active[left]
    return out


def band_keys(signatures: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    bits = np.ascontiguousarray(signatures).view(np.uint64).reshape(len(signatures), bands, rows)
    key = np.zeros(bits.shape[:2], np.uint64) + np.arange(bands, dtype=np.uint64)
    for i in range(rows):
        key = common.mix64((key + STEP) * np.uint64(0xD6E8FEB86659FD93) ^ bits[:, :, i])
    return key.view(np.int64)


def _fingerprints(h: np.ndarray, starts: np.ndarray) -> list[bytes]:
    import xxhash

    return [xxhash.xxh3_128_digest(h[a:b].tobytes()) for a, b in zip(starts[:-1], starts[1:])]


def nibbles(signatures: np.ndarray) -> np.ndarray:
    """4 bits of each register, 16 in a 64-bit number."""
    bits = (common.mix64(np.ascontiguousarray(signatures).view(np.uint64)) & np.uint64(15)).reshape(len(signatures), -1)
    room = np.zeros((len(bits), -(-bits.shape[1] // 16) * 16), np.uint64)
    room[:, : bits.shape[1]] = bits
    return np.bitwise_or.reduce(room.reshape(len(bits), -1, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4)), axis=2).view(np.int64)


def differing(a: str, b: str) -> Column:
    """Registers in which two columns of nibbles differ."""
    total = None
    for i in range(-(-REGISTERS // 16)):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        n = F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(F.lit(0x1111111111111111)))
        total = n if total is None else total + n
    return total


def allowed(percent: int) -> int:
    q = 15 / 16 * (1 - percent / 100)
    return math.ceil(REGISTERS * q + 5.5 * math.sqrt(REGISTERS * q * (1 - q)))


SIGNED = "doc_id long, tx long, n_shingles long, fp binary, bands array<long>, sig array<long>"


def _sign(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    word_hash, seen = common.WordHash(300_000), {}
    for whole in common.batches(rows):
        for i in range(0, whole.num_rows, 100):
            batch = whole.slice(i, 100)
            h, starts = shingle_sets(common.texts(batch.column("text")), word_hash)
            n, fps = np.diff(starts), _fingerprints(h, starts)
            # one signature for each set that this task has not signed lately
            ids = batch.column(0).to_pylist()
            new = [j for j in range(len(n)) if n[j] and ids[j] is not None and fps[j] not in seen]
            keys: dict[bytes, object] = {}
            if new:
                part = np.concatenate([h[starts[j] : starts[j + 1]] for j in new])
                signatures = super_minhash(part, np.concatenate([[0], np.cumsum(n[new])]))
                for j, *k in zip(new, band_keys(signatures), nibbles(signatures)):
                    keys[fps[j]] = k
            if len(seen) > 200_000:
                seen.clear()
            # later rows of a set carry no bands: its first row in the task speaks for them
            made = [keys.pop(fps[j], None) if n[j] and ids[j] is not None else None for j in range(len(n))]
            both = [pa.array([m and m[i] for m in made], pa.list_(pa.int64())) for i in (0, 1)]
            seen.update((fps[j], True) for j in new)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column("tx"), pa.array(n, pa.int64()), pa.array([f if c else None for f, c in zip(fps, n)], pa.binary()), *both], [x.split()[0] for x in SIGNED.split(", ")])


def _sets(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    word_hash = common.WordHash(300_000)
    for whole in common.batches(rows):
        for i in range(0, whole.num_rows, 100):
            batch = whole.slice(i, 100)
            h, starts = shingle_sets(common.texts(batch.column(1)), word_hash)
            lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(_fingerprints(h, starts), pa.binary()), lists], ["fp", "shingles"])


# -- union-find ---------------------------------------------------------------


def _forest(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links that a task holds, as links of each node to the smallest node of its tree."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while (up := parent.get(x, x)) != top:
            parent[x], x = top, up
        return top

    def flush() -> pa.RecordBatch:
        nodes = list(parent)
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["a", "b"])

    for batch in common.batches(rows):
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
        if len(parent) > 1_000_000:
            yield flush()
            parent.clear()
    yield flush()


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node that it reaches) for the nodes of links(a, b) that are not their own component."""
    pairs = common.table(links.select("a", "b").where("a <> b").mapInArrow(_forest, "a long, b long").where("a > b").distinct(), "dedup-forest")
    while True:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        # every node hangs all its neighbours, and itself, on its smallest one
        hung = pairs.select(F.col("a").alias("x"), F.col("b").alias("a")).join(least, "a").select(F.col("x").alias("a"), F.col("low").alias("b"))
        under = pairs.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        own = least.select("a", F.col("low").alias("b"))
        made = hung.unionByName(under).unionByName(own).where("a > b").distinct().mapInArrow(_forest, "a long, b long").where("a > b").distinct()
        nxt = common.table(made, "dedup-forest")
        # done when each node hangs on one root, and no root hangs on another
        roles = nxt.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.lit(1).alias("up")), F.struct(F.col("b").alias("x"), F.lit(0).alias("up")))).alias("r")).select("r.*")
        odd = roles.groupBy("x").agg(F.sum("up").alias("ups"), F.min("up").alias("least")).where("ups > 1 OR (ups = 1 AND least = 0)").limit(1).count()
        pairs = nxt
        if not odd:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("component"))


# -- the operator -------------------------------------------------------------


def _beside(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs(x, c, ...) with the full sets left (of x) and right (of c); a set that many pairs share should be c."""
    left = sets.select(F.col("set").alias("x"), F.col("shingles").alias("left"))
    right = sets.select(F.col("set").alias("c"), F.col("shingles").alias("right"))
    return pairs.join(left, "x").join(right, "c")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of pairs(x, c) whose full sets are similar enough, as links a, b."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.batches(rows):
            x, y = batch.column("left"), batch.column("right")
            keep = []
            for i in range(batch.num_rows):
                u, v = x[i].values.to_numpy(), y[i].values.to_numpy()
                shared = len(np.intersect1d(u, v, assume_unique=True))
                keep.append(100 * shared >= percent * (len(u) + len(v) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("c")], ["a", "b"]).filter(pa.array(keep))

    return _beside(pairs, sets).select("x", "c", "left", "right").mapInArrow(run, "a long, b long")


DIFFERENCES = "c long, x long, n long, family long, d long, elements array<long>"


def _differ(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The elements that a set and its centre do not share."""
    for batch in common.batches(rows):
        left, right = batch.column("left"), batch.column("right")
        parts = [np.setxor1d(left[i].values.to_numpy(), right[i].values.to_numpy(), assume_unique=True) for i in range(batch.num_rows)]
        sizes = np.array([len(p) for p in parts], np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.concatenate(parts), pa.int64()))
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("c", "x", "n", "family")), pa.array(sizes), lists], [k.split()[0] for k in DIFFERENCES.split(", ")])


def _apart(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Candidates (x, c) among members(c, x, n, family): sets of one centre and different families.

    Each pair that is similar enough is among them (see the head of the module).
    """
    differ = common.table(_beside(members, sets).select("c", "x", "n", "family", "left", "right").mapInArrow(_differ, DIFFERENCES), "dedup-differences")
    each = differ.select("c", "x", F.explode("elements").alias("e"))
    shared = each.groupBy("c", "e").agg(F.count("*").alias("often")).where("often > 1")
    # elements that one member alone holds come first in the order and meet nobody
    ranked = each.join(shared, ["c", "e"]).groupBy("c", "x").agg(F.sort_array(F.collect_list(F.struct("often", "e"))).alias("shared"))
    # a set of n elements differs from a similar one in no more than most; the prefix is one longer
    most, alone = F.floor(F.col("n") * F.lit(100 - percent) / F.lit(percent)), F.col("d") - F.size("shared")
    rows = differ.select("c", "x", "n", "family", "d").join(ranked, ["c", "x"])
    rows = rows.select("c", "x", "n", "family", "d", alone.alias("alone"), F.slice("shared", F.lit(1), F.greatest(F.lit(0), most + 1 - alone).cast("int")).alias("prefix"))
    rows = rows.select("c", "x", "n", "family", "d", "alone", F.posexplode("prefix").alias("i", "p")).select("c", "x", "n", "family", "d", (F.col("alone") + F.col("i") + 1).alias("rank"), F.col("p.e").alias("e"))
    rows = common.table(rows, "dedup-prefixes")
    # the largest family of a centre need not meet itself
    large = rows.select("c", "x", "family").distinct().groupBy("c", "family").agg(F.count("*").alias("members")).groupBy("c").agg(F.max_by("family", F.struct("members", "family")).alias("large"))
    mixed = rows.groupBy("c", "e").agg(F.min("family").alias("lo"), F.max("family").alias("hi")).where("lo <> hi").select("c", "e")
    rows = common.join_small(rows.join(mixed, ["c", "e"]), large, "c", "inner")
    few = rows.where("family <> large").drop("large")
    other = rows.select("c", "e", F.col("x").alias("y"), F.col("n").alias("m"), F.col("family").alias("kin"), F.col("d").alias("f"), F.col("rank").alias("place"), F.col("large"))
    overlap = F.ceil((F.col("d") + F.col("f") - F.floor((F.col("n") + F.col("m")) * F.lit(100 - percent) / F.lit(100 + percent))) / 2)
    fits = (F.lit(100) * F.least("n", "m") >= F.lit(percent) * F.greatest("n", "m")) & (F.col("rank") <= F.col("d") - overlap + 1) & (F.col("place") <= F.col("f") - overlap + 1)
    once = (F.col("kin") == F.col("large")) | (F.col("x") < F.col("y"))
    met = few.join(other, ["c", "e"]).where((F.col("family") != F.col("kin")) & once & fits)
    return met.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("c")).distinct()


def _sets_linked(signed: DataFrame, given: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The distinct sets (fp, set, rep, n) of signed rows, and the links a, b of those that are similar enough."""
    named = signed.where(F.col("fp").isNotNull() & F.col("doc_id").isNotNull())
    # equal sets have one representative, the smallest doc_id; a set is numbered when the table is written
    reps = named.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first(F.when(F.col("bands").isNotNull(), F.struct("bands", "sig")), ignorenulls=True).alias("s"))
    marked = common.table(reps.select("fp", "rep", "n", "s.bands", "s.sig", F.monotonically_increasing_id().alias("set")), "dedup-reps")
    buckets = marked.select("set", "n", F.explode("bands").alias("key"))
    full = buckets.groupBy("key").agg(F.count("*").alias("members")).where("members > 1").select("key")
    crowded = common.table(buckets.join(full, "key").join(marked.select("set", "sig"), "set"), "dedup-buckets")
    fits = (F.lit(100) * F.least("n", "m") >= F.lit(percent) * F.greatest("n", "m")) & (differing("sig", "sog") <= allowed(percent))
    # one pivot from each slot of a bucket, found with partial aggregation
    slot = F.pmod(F.xxhash64("key", "set"), F.lit(PIVOTS))
    stars = crowded.groupBy("key", slot.alias("slot")).agg(F.min_by(F.struct("set", "n", "sig"), F.xxhash64("set")).alias("p")).select(F.col("key").alias("k"), F.col("p.set").alias("b"), F.col("p.n").alias("m"), F.col("p.sig").alias("sog"))
    first = crowded.join(stars, (F.col("key") == F.col("k")) & (F.col("set") != F.col("b")) & fits)
    first = common.table(first.select(F.col("set").alias("x"), F.col("b").alias("c")).distinct(), "dedup-pairs")

    # texts of representatives of candidates alone
    wanted = marked.join(crowded.select("set").distinct(), "set").select("fp", "set", "rep")
    texts = given.join(wanted.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").select("doc_id", "text")
    sets = common.table(texts.mapInArrow(_sets, "fp binary, shingles array<long>").join(wanted.select("fp", "set"), "fp").select("set", "shingles").dropDuplicates(["set"]), "dedup-sets")
    links = common.table(_confirm(first, sets, percent), "dedup-links")

    group = components(links)
    placed = crowded.select("key", "set", "n").join(group, crowded["set"] == group["node"], "left").select("key", "set", "n", F.coalesce("component", "set").alias("family"))
    split = placed.groupBy("key").agg(F.min("family").alias("lo"), F.max("family").alias("hi")).where("lo <> hi").select("key")
    # the centre of a bucket is the pivot with most links
    degree = links.select(F.explode(F.array("a", "b")).alias("b")).groupBy("b").agg(F.count("*").alias("degree"))
    centre = stars.select(F.col("k").alias("key"), "b").join(degree, "b", "left").groupBy("key").agg(F.max_by("b", F.struct(F.coalesce("degree", F.lit(0)), "b")).alias("c"))
    members = placed.join(split, "key").join(centre, "key").where("set <> c").select("c", F.col("set").alias("x"), "n", "family").distinct()
    # a centre whose members are one family has nothing to do
    torn = members.groupBy("c").agg(F.min("family").alias("lo"), F.max("family").alias("hi")).where("lo <> hi").select("c")
    members = common.table(members.join(torn, "c"), "dedup-members")
    second = _apart(members, sets, percent)
    done = first.select(F.least("x", "c").alias("x"), F.greatest("x", "c").alias("c"))
    second = common.table(second.join(done, ["x", "c"], "left_anti"), "dedup-pairs")
    return marked.select("fp", "set", "rep", "n"), common.table(links.unionByName(_confirm(second, sets, percent)), "dedup-links")


def _signed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of docs as doc_id, text and tx (a hash of the text), and what _sign makes of them."""
    given = common.pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("tx", F.xxhash64("text"))
    return given, common.table(given.mapInArrow(_sign, SIGNED), "dedup-signed")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs(doc_id, text)."""
    common.prepare(docs.sparkSession)
    given, signed = _signed(docs)
    of_set, ends = _sets_linked(signed, given, percent)
    # links between sets become links between documents
    between = ends.join(of_set.select(F.col("set").alias("a"), F.col("rep").alias("x")), "a").join(of_set.select(F.col("set").alias("b"), F.col("rep").alias("y")), "b")
    between = between.select(F.col("x").alias("a"), F.col("y").alias("b"))
    # a doc_id with several texts joins their sets
    named = signed.where(F.col("fp").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "fp")
    several = named.groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi").select("doc_id")
    tied = named.join(several, "doc_id").distinct().join(of_set.select("fp", "rep"), "fp").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    group = components(between.unionByName(tied))
    home = of_set.join(group, of_set["rep"] == group["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    joined = signed.select("doc_id", "n_shingles", "fp").join(home, "fp", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row of each group of similar texts, all columns: the one with the smallest doc_id.

    Groups are of texts alone: rows that share a doc_id but not a group stay
    both. Texts without words, and rows without a doc_id, are in no group and
    all stay.
    """
    common.prepare(docs.sparkSession)
    given, signed = _signed(docs)
    of_set, ends = _sets_linked(signed, given, percent)
    group = components(ends)
    home = of_set.join(group, of_set["set"] == group["node"], "left").select("fp", F.coalesce("component", "set").alias("family"))
    placed = signed.where(F.col("fp").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "tx", "fp").join(home, "fp")
    best = placed.groupBy("family").agg(F.min(F.struct("doc_id", "tx")).alias("best")).select("best.*")
    # a row that is repeated stays once; its hash tells which of several
    stay = common.table(best.select(F.col("doc_id").alias("__doc_id"), F.col("tx").alias("__tx")), "dedup-kept")
    again = signed.groupBy("doc_id", "tx").agg(F.count("*").alias("rows"), F.max("n_shingles").alias("n")).where("rows > 1 AND n > 0").select("doc_id", "tx")
    again = common.table(again.join(stay, (F.col("doc_id") == F.col("__doc_id")) & (F.col("tx") == F.col("__tx")), "left_semi").select(F.col("doc_id").alias("__again"), F.col("tx").alias("__again_tx")), "dedup-again")
    free = docs.join(signed.where("n_shingles = 0").select(F.col("doc_id").alias("__doc_id"), F.col("tx").alias("__tx")).where("__doc_id IS NOT NULL").distinct().unionByName(stay), _row_is(docs, "__doc_id", "__tx"), "left_semi")
    once = free.join(again, _row_is(docs, "__again", "__again_tx"), "left_anti")
    repeated = free.join(again, _row_is(docs, "__again", "__again_tx"), "left_semi")
    row = F.struct(*[repeated[c] for c in docs.columns])
    single = repeated.groupBy(repeated["doc_id"].cast("long"), F.xxhash64(repeated["text"].cast("string"))).agg(F.min_by(row, F.xxhash64(*[repeated[c] for c in docs.columns])).alias("row")).select("row.*")
    return once.unionByName(single).unionByName(docs.where(docs["doc_id"].cast("long").isNull()))


def _row_is(docs: DataFrame, doc_id: str, tx: str) -> Column:
    return (docs["doc_id"].cast("long") == F.col(doc_id)) & (F.xxhash64(docs["text"].cast("string")) == F.col(tx))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.documents(spark, sf_dir))
