"""Language of a text by multilingual mixture inference.

Languages are models of byte trigrams inside words (letters of any script, case
folded for A-Z), over hashed bins of fixed number. A text is cut into short
spans of grams, and expectation-maximisation estimates which share of its
spans each language wrote. The set of languages grows from the strongest one
along the estimated shares, and the size with the best penalised likelihood
(half the log of the number of spans for each further language) is chosen; the
proportions are estimated anew within that set, and the largest one gives the
answer and the score. The set grows until a further language no longer pays its
penalty, up to all of them.

The models are counted over a bounded sample of labelled rows (SAMPLE); they
and the predictions use whole texts.

Cases: null texts and texts without letters are ``und`` with score 0; null
languages teach nothing; with no labelled row everything is ``und``; ties go
to the language that sorts first. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Labelled rows that a fit may use.
SAMPLE = 20_000
BINS, SPAN = 1 << 16, 24
ROUNDS = 12
#: Numbers in the model: with so many languages that it would pass this, bins are joined.
NUMBERS = 1 << 26
#: Bytes of a text that are read at once.
PIECE = 1 << 20
SMOOTH = 0.3
UNKNOWN = "und"

#: A-Z fold to a-z; other ASCII bytes than letters become blanks.
FOLD = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], np.uint8)


def grams(text: bytes) -> np.ndarray:
    """Bins of the trigrams of a text, which has no more bytes than are held at once; those across two words are left out."""
    return _grams(b" " + text + b" ")


def _grams(text: bytes) -> np.ndarray:
    """Bins of the trigrams around all bytes but the first and the last."""
    raw = FOLD[np.frombuffer(text, np.uint8)]
    mid = raw[1:-1]
    code = (raw[:-2].astype(np.uint32) << np.uint32(16)) | (mid.astype(np.uint32) << np.uint32(8)) | raw[2:]
    return ((code[mid != 32] * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int32)


def pieces(text: bytes) -> Iterator[np.ndarray]:
    """grams of a text of any length, a piece at a time."""
    for at in range(0, len(text), PIECE):
        before = text[at - 1 : at] or b" "
        yield _grams(before + text[at : at + PIECE] + (text[at + PIECE : at + PIECE + 1] or b" "))


def has_letters(text: bytes) -> bool:
    raw = np.frombuffer(text, np.uint8)
    if ((raw | 32) - 97 < 26).any():
        return True
    return bool((raw >= 128).any()) and any(c.isalpha() for c in text.decode())


@dataclass
class Model:
    languages: list[str]
    #: log-probability of each bin in each language, as BINS x languages.
    logs: np.ndarray
    #: Low bits of a bin that the model leaves out.
    joined: int = 0

    def spans(self, text: bytes) -> np.ndarray:
        """Log-likelihoods of a text's spans in each language."""
        out, rest = [np.zeros((0, len(self.languages)), np.float32)], np.zeros(0, np.int32)
        for g in pieces(text):
            g = np.concatenate([rest, g])
            whole = len(g) // SPAN * SPAN
            rest = g[whole:]
            out.append(self.logs[g[:whole] >> self.joined].reshape(-1, SPAN, len(self.languages)).sum(axis=1))
        if len(rest):
            out.append(self.logs[rest >> self.joined].sum(axis=0, keepdims=True))
        return np.concatenate(out)


def mixture(spans: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihood of each text by EM, all texts of a batch at once.

    spans: for each text an array of spans x languages; languages with -inf are not in its set.
    """
    sizes = np.array([len(s) for s in spans])
    of = np.repeat(np.arange(len(spans)), sizes)
    ll = np.concatenate(spans).astype(np.float64)
    top = ll.max(axis=1, keepdims=True)
    like = np.exp(ll - top)
    starts = np.cumsum(sizes) - sizes
    full = sizes > 0
    open_ = np.stack([(s > -np.inf).any(axis=0) if len(s) else np.ones(s.shape[1], bool) for s in spans])
    theta = open_ / open_.sum(axis=1, keepdims=True)
    for _ in range(ROUNDS):
        r = like * theta[of]
        r /= np.maximum(r.sum(axis=1, keepdims=True), 1e-300)
        theta[full] = np.add.reduceat(r, starts[full], axis=0) / sizes[full, None]
    total = np.zeros(len(spans))
    total[full] = np.add.reduceat(np.log(np.maximum((like * theta[of]).sum(axis=1), 1e-300)) + top[:, 0], starts[full])
    return theta, total


def infer(spans: list[np.ndarray]) -> np.ndarray:
    """Proportions of each text within the language set of best penalised likelihood."""
    theta, _ = mixture(spans)
    n, k = theta.shape
    order = np.argsort(-theta, axis=1, kind="stable")
    best, chosen = np.full(n, -np.inf), np.zeros((n, k))
    todo = np.arange(n)
    for size in range(1, k + 1):
        sets = []
        for i in todo:
            s = np.full_like(spans[i], -np.inf)
            s[:, order[i, :size]] = spans[i][:, order[i, :size]]
            sets.append(s)
        if size == 1:
            share = np.zeros((n, k))
            share[np.arange(n), order[:, 0]] = 1
            total = np.array([s[:, o].sum() for s, o in zip(spans, order[:, 0])])
        else:
            share, total = mixture(sets)
        cost = total - 0.5 * (size - 1) * np.log(np.maximum([len(spans[i]) for i in todo], 2)) - 3.0 * (size - 1)
        better = cost > best[todo]
        best[todo[better]], chosen[todo[better]] = cost[better], share[better]
        todo = todo[better]
        if not len(todo):
            break
    return chosen


def _counts(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in common.batches(rows):
        for lang, text in zip(batch.column(0).to_pylist(), common.texts(batch.column(1))):
            n = total.setdefault(lang, np.zeros(BINS, np.int64))
            for g in pieces(text):
                n += np.bincount(g, minlength=BINS)
    for lang, n in total.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], ["lang", "bin", "n"])


def learn(docs: DataFrame, sample: int = SAMPLE, aside: tuple[int, int] = (4, 2)) -> Model:
    """Fit on a bounded sample of the rows with a language whose crc32(doc_id) mod aside[0] is not aside[1]."""
    rows = common.pick(docs, "doc_id", "lang", "text").where(F.col("lang").isNotNull() & (common.id_crc("doc_id") % aside[0] != aside[1]))
    n = rows.select("doc_id").count()
    if n > sample:
        rows = rows.where(common.hash01("doc_id", "language-1:") < F.lit(sample / n))
    counted = rows.select(F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(_counts, "lang string, bin int, n long")
    # a row for each language of the sample and each of its bins
    found = counted.groupBy("lang", "bin").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(found["lang"].unique())
    joined = 0
    while (BINS >> joined) * len(languages) > NUMBERS:
        joined += 1
    table = np.full((BINS >> joined, len(languages)), SMOOTH)
    place = {lang: j for j, lang in enumerate(languages)}
    np.add.at(table, (found["bin"].to_numpy() >> joined, found["lang"].map(place).to_numpy(np.int64)), found["n"].to_numpy())
    return Model(languages, np.log(table / table.sum(axis=0)).astype(np.float32), joined)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and shares (language -> proportion) of every row of docs(doc_id, text)."""
    spark = common.prepare(docs.sparkSession)
    held = spark.sparkContext.broadcast(model)  # BINS numbers for each language

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = held.value
        for whole in common.batches(rows):
            for i in range(0, whole.num_rows, 250):
                batch = whole.slice(i, 250)
                texts = common.texts(batch.column(1))
                pred, score, shares = [UNKNOWN] * len(texts), [0.0] * len(texts), [[] for _ in texts]
                at = [j for j, t in enumerate(texts) if m.languages and has_letters(t)]
                if at:
                    for j, theta in zip(at, infer([m.spans(texts[j]) for j in at])):
                        k = int(theta.argmax())
                        pred[j], score[j] = m.languages[k], float(min(1.0, theta[k]))
                        shares[j] = [(m.languages[x], float(theta[x])) for x in np.flatnonzero(theta > 0)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(shares, pa.map_(pa.string(), pa.float64()))], ["doc_id", "lang_pred", "score", "shares"])

    given = common.pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return given.mapInArrow(run, "doc_id long, lang_pred string, score double, shares map<string,double>")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    return predict(docs, learn(docs)).select("doc_id", (common.id_crc("doc_id") % 4 == 2).alias("held_out"), "lang_pred", "score")
