"""Quality classifier: random-indexing word vectors, pooled, then a two-layer network.

Every row of a word table owns a sparse ternary index vector, and every word a
row by its hash (so rare words may share one). The
context vector of a word sums the index vectors of the words around it in the
labelled sample; words share rows of a table of fixed size by their hash, so
that the model has one size whatever the vocabulary. A text is the mean of its
word vectors beside a few ratios of the text (repetition, letter case, signs),
and a two-layer network, fitted by numpy with Adam on a bounded sample of
labelled rows, scores it. A temperature fitted on rows set aside calibrates
its probabilities.

The sample bound is SAMPLE. Everything else covers whole texts and all rows.

Cases: null and empty texts pool to a zero vector and are scored as such; rows
without a label are scored but not learned; labels that are null, or repeated
for a document, count once with the larger value; without any labels (or with
only one class) the score is the share of label 1, 0.5 for no labels. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Labelled rows that a fit may use.
SAMPLE = 8_000
#: Rows of the word table, width of a vector, entries that are not zero in an index vector, words to each side.
TABLE, WIDTH, ONES, AROUND = 1 << 15, 32, 4, 2
HIDDEN, EPOCHS, SEED = 32, 60, 7
#: Tasks that sum context vectors.
FITTERS = 8
THRESHOLD = 0.7
SIGNS = 12


@dataclass
class Model:
    vectors: np.ndarray = field(default_factory=lambda: np.zeros((TABLE, WIDTH), np.float32))
    mean: np.ndarray = field(default_factory=lambda: np.zeros(WIDTH + SIGNS, np.float32))
    scale: np.ndarray = field(default_factory=lambda: np.ones(WIDTH + SIGNS, np.float32))
    w1: np.ndarray | None = None
    b1: np.ndarray | None = None
    w2: np.ndarray | None = None
    b2: float = 0.0
    temperature: float = 1.0
    prior: float = 0.5

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0)
        return h @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.w1 is None:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def index_vectors() -> np.ndarray:
    """Sparse ternary vectors of the table's rows."""
    out = np.zeros((TABLE, WIDTH), np.float32)
    for k in range(ONES):
        h = common.mix64(np.arange(TABLE, dtype=np.uint64) * np.uint64(ONES) + np.uint64(k + 1))
        out[np.arange(TABLE), (h % np.uint64(WIDTH)).astype(np.int64)] += np.where(h >> np.uint64(63), 1, -1)
    return out


def row_ids(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(49)).astype(np.int32)


def signs(text: bytes, tokens: list[bytes]) -> list[float]:
    """Ratios of a whole text: how it repeats, and what it is written in."""
    if not tokens:
        return [0.0] * SIGNS
    n, size = len(tokens), len(text)
    raw = np.frombuffer(text, np.uint8)
    kinds = np.bincount(raw, minlength=256)
    lines = [x for x in text.split(b"\n") if x.strip()]
    pairs = len(set(zip(tokens, tokens[1:])))
    upper, lower = kinds[65:91].sum(), kinds[97:123].sum()
    marks = size - upper - lower - kinds[48:58].sum() - kinds[128:].sum() - kinds[9:14].sum() - kinds[32]
    return [
        float(np.log1p(n)), len(set(tokens)) / n, pairs / max(1, n - 1), len(set(lines)) / max(1, len(lines)),
        upper / max(1, upper + lower), marks / size, kinds[48:58].sum() / size, (kinds[44] + kinds[46]) / size,
        (kinds[35:39].sum() + kinds[42] + kinds[124] + kinds[33]) / size, float(np.log1p(size / n)), kinds[128:].sum() / size, float(np.log1p(n / max(1, len(lines)))),
    ]


class Reader:
    """Hashes, signs and pooled vectors of texts."""

    def __init__(self) -> None:
        self.hash = common.WordHash(250_000)

    def tokens(self, batch: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, ends, extra = [], [0], []
        for t in batch:
            w = t.lower().split()
            ids.append(row_ids(self.hash(w)))
            ends.append(ends[-1] + len(w))
            extra.append(signs(t, w))
        return (np.concatenate(ids) if ids else np.zeros(0, np.int32)), np.array(ends), np.array(extra, np.float32).reshape(-1, SIGNS)

    def features(self, batch: list[bytes], vectors: np.ndarray) -> np.ndarray:
        out = np.zeros((len(batch), WIDTH + SIGNS), np.float32)
        for i, t in enumerate(batch):
            w = t.lower().split()
            out[i, WIDTH:] = signs(t, w)
            if w:
                # rows of the table by count, so that a text costs its distinct words
                rows, n = np.unique(row_ids(self.hash(w)), return_counts=True)
                out[i, :WIDTH] = n.astype(np.float32) @ vectors[rows] / len(w)
        return out


def context_sums(batch: list[bytes], reader: Reader) -> np.ndarray:
    """For each row of the table, the sum of the index vectors within AROUND words: whole numbers, so that sums of parts are exact."""
    index, out = index_vectors().astype(np.int64), np.zeros((TABLE, WIDTH), np.int64)
    for i in range(0, len(batch), 200):
        ids, ends, _ = reader.tokens(batch[i : i + 200])
        doc = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        for k in range(1, AROUND + 1):
            same = np.flatnonzero(doc[k:] == doc[:-k])
            for a, b in ((same, same + k), (same + k, same)):
                pair, n = np.unique(ids[a].astype(np.int64) * TABLE + ids[b], return_counts=True)
                if len(pair):  # pairs are sorted, so those of a row stand together
                    row, first = np.unique(pair // TABLE, return_index=True)
                    out[row] += np.add.reduceat(index[pair % TABLE] * n[:, None], first, axis=0)
    return out


def unit_vectors(sums: np.ndarray) -> np.ndarray:
    """Context vectors of length 1."""
    index, out = index_vectors(), sums.astype(np.float64)
    norm = np.sqrt((out**2).sum(axis=1, keepdims=True))
    # a word that stands alone in the sample keeps its index vector
    return np.where(norm > 0, out / np.maximum(norm, 1e-9), index / np.sqrt(ONES)).astype(np.float32)


def _train(x: np.ndarray, y: np.ndarray, model: Model) -> None:
    rng = np.random.default_rng(SEED)
    model.mean, model.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-4)
    z = (x - model.mean) / model.scale
    p = {"w1": rng.normal(0, np.sqrt(2 / z.shape[1]), (z.shape[1], HIDDEN)), "b1": np.zeros(HIDDEN), "w2": rng.normal(0, np.sqrt(2 / HIDDEN), HIDDEN), "b2": np.zeros(1)}
    m, v, step = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(z))
        for i in range(0, len(z), 128):
            a, t = z[order[i : i + 128]], y[order[i : i + 128]]
            pre = a @ p["w1"] + p["b1"]
            h = np.maximum(pre, 0)
            err = (1 / (1 + np.exp(-np.clip(h @ p["w2"] + p["b2"], -40, 40))) - t) / len(t)
            back = np.outer(err, p["w2"]) * (pre > 0)
            grads = {"w1": a.T @ back + 1e-4 * p["w1"], "b1": back.sum(axis=0), "w2": h.T @ err + 1e-4 * p["w2"], "b2": np.array([err.sum()])}
            step += 1
            for k, g in grads.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] -= 0.005 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    model.w1, model.b1, model.w2, model.b2 = p["w1"].astype(np.float32), p["b1"].astype(np.float32), p["w2"].astype(np.float32), float(p["b2"][0])


def word_vectors(batch: list[bytes], reader: Reader) -> np.ndarray:
    return unit_vectors(context_sums(batch, reader))


def fit(batch: list[bytes], labels: np.ndarray) -> Model:
    """A model of labelled texts."""
    reader = Reader()
    vectors = word_vectors(batch, reader)
    x = [reader.features(batch[i : i + 200], vectors) for i in range(0, len(batch), 200)]
    return fit_features(np.concatenate(x) if x else np.zeros((0, WIDTH + SIGNS), np.float32), labels, vectors)


def fit_features(x: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> Model:
    """A model of the features of labelled texts; a sixth of them only set the temperature."""
    model = Model(vectors)
    if not len(x) or labels.min() == labels.max():
        model.prior = float(labels.mean()) if len(x) else 0.5
        return model
    aside = np.arange(len(x)) % 6 == 5
    _train(x[~aside], labels[~aside].astype(float), model)
    if aside.any():
        z, y = model.logits(x[aside]), labels[aside]
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
        model.temperature = float(min(grid, key=lambda t: np.logaddexp(0, -np.where(y == 1, z, -z) / t).mean()))
    return model


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, aside: tuple[int, int] = (4, 2)) -> Model:
    """Fit on a bounded sample of labelled documents whose crc32(doc_id) mod aside[0] is not aside[1]."""
    labels = common.pick(labels, "doc_id", "quality").where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    labels = labels.where(common.id_crc("doc_id") % aside[0] != aside[1])
    chosen = common.bounded_sample(labels, sample, "quality-1:")
    # the sample bounds this side
    rows = common.pick(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"), F.col("quality").cast("int"))
    rows = common.table(rows.repartition(FITTERS), "quality-sample")
    # a table of fixed size from each of a fixed number of tasks, by files: rows of it would take the driver's heap several times over
    uri = common.shared_dir(docs.sparkSession, "quality-sums")
    sums, (where, path) = np.zeros((TABLE, WIDTH), np.int64), common.open_fs(uri)
    for r in rows.select("text").repartition(FITTERS).mapInArrow(_sums(uri), "name string").collect():
        with where.open_input_stream(f"{path}/{r.name}", compression=None) as f:
            sums += np.frombuffer(f.read(), "<i4").reshape(TABLE, WIDTH)
    vectors = unit_vectors(sums)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def features(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in common.batches(rows):
            x = reader.features(common.texts(batch.column(1)), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "quality", "x"])

    # numbers of fixed width for each row of the sample, no texts
    found = [(r.doc_id, int(r.quality), bytes(r.x)) for r in rows.mapInArrow(features, "doc_id long, quality int, x binary").collect()]
    found.sort(key=lambda r: (common.id_crc_py(r[0]), r))
    x = np.frombuffer(b"".join(r[2] for r in found), np.float32).reshape(-1, WIDTH + SIGNS)
    return fit_features(x, np.array([r[1] for r in found]), vectors)


def _sums(uri: str) -> Callable:
    """Writes a file of the sums of each task's texts, and gives its name."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, total = Reader(), np.zeros((TABLE, WIDTH), np.int64)
        for batch in common.batches(rows):
            for i in range(0, batch.num_rows, 200):
                total += context_sums(common.texts(batch.column(0).slice(i, 200)), reader)
        task = TaskContext.get()
        name = f"sums-{task.partitionId():06d}"
        common.put_file(uri, name, str(task.taskAttemptId()), lambda out: out.write(total.astype("<i4").tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([name])], ["name"])

    return run


def scorer(model: Model) -> Callable[[pa.Array], np.ndarray]:
    reader = Reader()

    def score(column: pa.Array) -> np.ndarray:
        batch = common.texts(column)
        return np.concatenate([model.scores(reader.features(batch[i : i + 200], model.vectors)) for i in range(0, len(batch), 200)]) if batch else np.zeros(0)

    return score


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row of docs(doc_id, text)."""
    spark = common.prepare(docs.sparkSession)
    held = spark.sparkContext.broadcast(model)  # a table of fixed size

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = scorer(held.value)
        for batch in common.batches(rows):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(of(batch.column(1)), pa.float64())], ["doc_id", "score"])

    return common.pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def accept(docs: DataFrame, model: Model, threshold: float) -> DataFrame:
    """The rows of docs, all columns, whose score is not below the threshold."""
    spark = common.prepare(docs.sparkSession)
    held = spark.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = scorer(held.value)
        for batch in common.batches(rows):
            yield batch.filter(pa.array(of(batch.column(at)) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    scored = score(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", (common.id_crc("doc_id") % 4 == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
