r"""LM scoring: prediction by partial matching over bytes, pretrained on the corpus.

The model is a trie of byte contexts up to ORDER long, with escape estimation
by method C and symbol exclusion. Its symbols are the 256 bytes and an end;
contexts before a text's start hold a start mark. The trie is a table of
integer codes (9 bits a symbol), counted over all training texts and never
held by one process:

1. Rows are numbered in a written table and dealt into blocks by a hash of
   their number, each of a bounded number of bytes, so that repeated rows are
   dealt as well as others. A block has a partition of its own, and there are
   as many as the data need, whatever the session's setting. It lists its
   distinct grams and words, with counts of training texts.
2. Grams are summed over blocks; suffixes give the counts of shorter contexts.
   A gram seen in training has its probability at once. For the others, joins
   walk down the trie: a context escapes with the weight of its distinct
   symbols, and what its symbols weigh in the next shorter context is taken
   out there. As the symbols of a context are always among those of a shorter
   one, that weight is one number for each context, found by a join of the
   trie with itself.
3. Each block gets the values of its own grams and words back, by number, and
   scores its documents; a text is scored whole.

Base score: sum over tokens (words, then one end) of
log10((c + 0.5) / (N + 0.5 (V + 1))).

Cases: a null text counts as empty and scores its end alone; a null doc_id
hashes as the empty text; repeated rows are each learned and scored; with no
training text every symbol has probability 1/257 and N is 0. Other columns are
ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Symbols of context, bytes of text in a block, and symbols that are coded at once.
ORDER, BLOCK, SLICE = 4, 24 << 20, 1 << 20
END, START, BITS = 256, 257, 9
SYMBOLS = 257

GRAM, WORD, TEXTS = 0, 1, 2
NEEDS = "block int, kind int, idx int, gram long, word binary, n long"
OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def mask(k: int) -> int:
    return (1 << BITS * k) - 1


def codes(batch: list[bytes], order: int = ORDER) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Gram codes of texts, many at a time: (codes, where each text starts in them, number of the first text).

    A text that is longer than a slice comes in pieces, with the same number.
    """
    i = 0
    while i < len(batch):
        j, held = i, 0
        while j < len(batch) and held + len(batch[j]) <= SLICE:
            held += len(batch[j]) + order + 1
            j += 1
        if j > i:
            sizes = np.array([len(t) + order + 1 for t in batch[i:j]])
            starts = np.cumsum(sizes) - sizes
            sym = np.empty(sizes.sum(), np.uint16)
            sym[:] = np.frombuffer(b"".join(bytes(order) + t + b"\0" for t in batch[i:j]), np.uint8)
            for k in range(order):
                sym[starts + k] = START
            sym[starts + sizes - 1] = END
            out = _roll(sym, order)[sym[order:] != START]
            yield out, starts - order * np.arange(j - i), i
            i = j
        else:
            text = batch[i]
            for at in range(0, len(text) + 1, SLICE):
                piece = np.frombuffer(text[max(0, at - order) : at + SLICE], np.uint8).astype(np.uint16)
                before = np.full(max(0, order - at), START, np.uint16)
                after = np.full(at + SLICE > len(text), END, np.uint16)
                yield _roll(np.concatenate([before, piece, after]), order), np.zeros(1, np.int64), i
            i += 1


def _roll(sym: np.ndarray, order: int) -> np.ndarray:
    n = len(sym) - order
    out = sym[:n].astype(np.int64)
    for k in range(1, order + 1):
        out <<= BITS
        out |= sym[k : k + n]
    return out


def distinct(batch: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct grams of texts and their counts."""
    parts = [np.unique(c, return_counts=True) for c, _, _ in codes(batch, order)]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    every, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    return every, np.bincount(at, np.concatenate([n for _, n in parts]), len(every)).astype(np.int64)


class Finder:
    """Values of grams by open addressing in a table at most half full; grams are distinct."""

    def __init__(self, grams: np.ndarray, values: np.ndarray) -> None:
        self.bits = len(grams).bit_length() + 1
        place = np.full(1 << self.bits, -1, np.int64)
        left, at = np.arange(len(grams)), self._home(grams)
        while len(left):
            free = place[at] < 0
            place[at[free]] = left[free]
            lost = place[at] != left
            left, at = left[lost], at[lost] + 1 & len(place) - 1
        held = place >= 0
        self.keys, self.values = np.full(len(place), -1, np.int64), np.zeros(len(place))
        self.keys[held], self.values[held] = grams[place[held]], values[place[held]]

    def _home(self, grams: np.ndarray) -> np.ndarray:
        return (grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        at = self._home(grams)
        left = np.flatnonzero(self.keys[at] != grams)
        while len(left):
            at[left] = at[left] + 1 & len(self.keys) - 1
            keys = self.keys[at[left]]
            if (keys < 0).any():
                raise KeyError("a gram of the block has no value")
            left = left[keys != grams[left]]
        return self.values[at]


def _keys(batch: list[bytes], order: int) -> tuple[np.ndarray, list[bytes]]:
    """Sorted grams and words of a block, the same as _list's."""
    known: set[bytes] = set()
    for t in batch:
        known.update(common.words(t))
    return distinct(batch, order)[0], sorted(known)


def _list(batch: list[bytes], held: list[bool], order: int) -> tuple[np.ndarray, np.ndarray, list[bytes], Counter]:
    """Sorted grams and words of a block, with their training counts."""
    train, aside = [t for t, h in zip(batch, held) if not h], [t for t, h in zip(batch, held) if h]
    grams, n = distinct(train, order)
    other, _ = distinct(aside, order)
    every = np.union1d(grams, other)
    count = np.zeros(len(every), np.int64)
    count[np.searchsorted(every, grams)] = n
    words: Counter = Counter()
    for t in train:
        words.update(common.words(t))
    known = set(words)
    for t in aside:
        known.update(common.words(t))
    return every, count, sorted(known), words


def _needs(order: int) -> Callable[[pa.Table], pa.Table]:
    def run(group: pa.Table) -> pa.Table:
        batch, held = _columns(group)
        grams, n, words, seen = _list(batch, held, order)
        g, w = len(grams), len(words)
        size = g + w + 1
        return pa.table(
            {
                "block": pa.array(np.full(size, group["block"][0].as_py(), np.int32)),
                "kind": pa.array(np.repeat(np.array([GRAM, WORD, TEXTS], np.int32), [g, w, 1])),
                "idx": pa.array(np.concatenate([np.arange(g), np.arange(w), [0]]).astype(np.int32)),
                "gram": pa.chunked_array([pa.array(grams, pa.int64()), pa.nulls(w + 1, pa.int64())]),
                "word": pa.chunked_array([pa.nulls(g, pa.binary()), pa.array(words, pa.binary()), pa.nulls(1, pa.binary())]),
                "n": pa.array(np.concatenate([n, np.array([seen[x] for x in words], np.int64), [held.count(False)]]).astype(np.int64)),
            }
        )

    return run


def _columns(group: pa.Table) -> tuple[list[bytes], list[bool]]:
    return [x or b"" for c in group["text"].chunks for x in c.cast(pa.binary()).to_pylist()], group["held_out"].to_pylist()


def _score(order: int, total: int, vocabulary: int, texts: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    below = total + 0.5 * (vocabulary + 1)

    def run(group: pa.Table, values: pa.Table) -> pa.Table:
        batch, held = _columns(group)
        grams, words = _keys(batch, order)
        kind, idx, value = (values[c].to_numpy() for c in ("kind", "idx", "value"))
        logs, counts = np.empty(len(grams)), np.empty(len(words))
        logs[idx[kind == GRAM]] = value[kind == GRAM]
        counts[idx[kind == WORD]] = value[kind == WORD]
        scores, find = np.zeros(len(batch)), Finder(grams, logs)
        for c, starts, first in codes(batch, order):
            scores[first : first + len(starts)] += np.add.reduceat(find(c), starts)
        # a word that training has weighs more than one that it has not, so one lookup serves both columns
        rare, end = (float(np.log10((c + 0.5) / below)) if below else 0.0 for c in (0, texts))
        base_of = dict(zip(words, np.log10((counts + 0.5) / below).tolist())) if below else dict.fromkeys(words, 0.0)
        n_tokens, n_known, base = [], [], []
        for t in batch:
            w = common.words(t)
            logs = np.fromiter(map(base_of.__getitem__, w), np.float64, len(w))
            n_tokens.append(len(w) + 1)
            n_known.append(int(np.count_nonzero(logs > rare)) + (texts > 0))
            base.append(float(logs.sum()) + end)
        return pa.table({"doc_id": group["doc_id"], "held_out": group["held_out"], "n_tokens": pa.array(n_tokens, pa.int64()), "n_known": pa.array(n_known, pa.int64()), "base_score": pa.array(base, pa.float64()), "score": pa.array(scores)})

    return run


def gram_logs(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """gram, value: log10 of the model's probability of each gram of counts(gram, n), n being its training count."""
    # trie[k]: grams of a context of k symbols and the symbol after it
    trie = {order: counts.where("n > 0").select("gram", "n")}
    for k in range(order - 1, -1, -1):
        trie[k] = trie[k + 1].groupBy((F.col("gram").bitwiseAND(F.lit(mask(k + 1)))).alias("gram")).agg(F.sum("n").alias("n"))
    for k in range(order):
        trie[k] = common.table(trie[k], f"lm-trie-{k}")

    def contexts(k: int) -> DataFrame:
        """context, total, kinds, and what its symbols weigh in the context that is one shorter."""
        t = trie[k].select("gram", "n", F.shiftright("gram", BITS).alias("context"))
        if k:
            lower = trie[k - 1].select(F.col("gram").alias("tail"), F.col("n").alias("low"))
            lower = F.broadcast(lower) if k <= 2 else lower  # at most 258 ** k rows
            t = t.join(lower, F.col("gram").bitwiseAND(F.lit(mask(k))) == F.col("tail"))
        else:
            t = t.withColumn("low", F.lit(0))
        return t.groupBy("context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"), F.sum("low").alias("low"))

    top = contexts(order)
    hits = trie[order].select("gram", "n", F.shiftright("gram", BITS).alias("context")).join(top.select("context", "total", "kinds"), "context")
    hits = hits.select("gram", F.log10(F.col("n") / (F.col("total") + F.col("kinds"))).alias("value"))

    miss = counts.where("n = 0").select("gram", F.lit(0.0).alias("escape"), F.lit(None).cast("double").alias("value"), F.lit(0).cast("long").alias("out"), F.lit(0).cast("long").alias("outs"))
    for k in range(order, -1, -1):
        c = contexts(k).withColumnRenamed("context", "c")
        g = trie[k].select(F.col("gram").alias("g"), F.col("n").alias("hit"))
        c, g = (F.broadcast(c) if k <= 2 else c), (F.broadcast(g) if k <= 1 else g)  # at most 258 ** k and 258 ** (k + 1) rows
        miss = miss.join(c, F.shiftright("gram", BITS).bitwiseAND(F.lit(mask(k))) == F.col("c"), "left")
        if k < order:
            miss = miss.join(g, F.col("gram").bitwiseAND(F.lit(mask(k + 1))) == F.col("g"), "left")
        else:
            miss = miss.withColumn("hit", F.lit(None).cast("long"))
        total, kinds = F.col("total") - F.col("out"), F.col("kinds") - F.col("outs")
        open_ = F.col("value").isNull()
        miss = miss.select(
            "gram",
            F.when(open_ & F.col("hit").isNull() & (kinds > 0), F.col("escape") + F.log10(kinds / (total + kinds))).otherwise(F.col("escape")).alias("escape"),
            F.when(open_ & F.col("hit").isNotNull(), F.col("escape") + F.log10(F.col("hit") / (total + kinds))).otherwise(F.col("value")).alias("value"),
            F.coalesce("low", F.lit(0)).alias("out"),
            F.coalesce("kinds", F.lit(0)).alias("outs"),
        )
    # the symbols that no text has share what is left evenly
    miss = miss.select("gram", F.coalesce("value", F.col("escape") - F.log10(F.lit(SYMBOLS) - F.col("outs"))).alias("value"))
    return hits.unionByName(miss)


def score(docs: DataFrame, aside: tuple[int, int] = (5, 1), order: int = ORDER, block: int = BLOCK) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs(doc_id, text)."""
    spark = common.prepare(docs.sparkSession)
    given = common.pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size, rows = given.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    n = max(1, -(-((size or 0) + 8 * rows) // block))
    held = common.made()
    numbered = common.table(given.withColumn("row", F.monotonically_increasing_id()), "lm-rows")
    dealt = numbered.select("doc_id", "text", (common.id_crc("doc_id") % aside[0] == aside[1]).alias("held_out"), F.pmod(F.xxhash64("row"), F.lit(n)).cast("int").alias("block"))
    dealt = dealt.repartitionById(n, F.col("block"))  # by hash, blocks would meet in some partitions
    needs = common.table(dealt.groupBy("block").applyInArrow(_needs(order), NEEDS), "lm-needs")

    counts = common.table(needs.where(F.col("kind") == GRAM).groupBy("gram").agg(F.sum("n").alias("n")), "lm-grams")
    logs = gram_logs(counts, order)
    of_gram = needs.where(F.col("kind") == GRAM).select("block", "kind", "idx", "gram").repartition(n, "gram").join(logs, "gram").select("block", "kind", "idx", "value")
    # a word is summed with partial aggregation; every block that has it gets the sum by a join
    listed = needs.where(F.col("kind") == WORD)
    known = common.table(listed.groupBy("word").agg(F.sum("n").alias("total")), "lm-words")
    of_word = listed.select("block", "kind", "idx", "word").join(known, "word").select("block", "kind", "idx", F.col("total").cast("double").alias("value"))
    values = common.table(of_gram.unionByName(of_word), "lm-values")

    words, vocabulary = known.where("total > 0").agg(F.coalesce(F.sum("total"), F.lit(0)), F.count("*")).first()
    texts = needs.where(F.col("kind") == TEXTS).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    total = words + texts
    # only the rows and the values are read from here on
    common.release([x for x in common.made() if x not in held and not re.search("/lm-(rows|values)-[0-9a-f]+$", x[1])])
    run = _score(order, total, vocabulary + (texts > 0), texts)
    scored = dealt.groupBy("block").cogroup(values.repartitionById(n, F.col("block")).groupBy("block")).applyInArrow(run, OUT)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(common.documents(spark, sf_dir))
