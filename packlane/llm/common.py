"""What the operators share: the shared folder, tables that cut lineage, checked joins.

Spark settings are read from the session. ``spark.checkpoint.dir`` names the
folder that the driver and all executors see; everything an operator writes
goes below it.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a side that may be broadcast; beyond it joins are salted instead.
BROADCAST_ROWS = 20_000
#: Arrow batches hold this many rows, since one row may be a very long text.
BATCH_ROWS = 1_000
WORD_BREAKS = b" \t\n\x0b\x0c\r"

_made: list[tuple[SparkSession, str]] = []


def prepare(spark: SparkSession) -> SparkSession:
    """Small Arrow batches for this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, as a URI; release() removes it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext.getCheckpointDir()
        base = os.path.dirname(held) if held else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="packlane-")  # one machine, as in tests
        spark.sparkContext.setCheckpointDir(base)
    if "://" not in base:
        base = base if base.startswith("file:") else "file://" + os.path.abspath(base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    _made.append((spark, path))
    return path


def made() -> list[tuple[SparkSession, str]]:
    """What operators have made in the shared folder so far."""
    return list(_made)


def release(only: list[tuple[SparkSession, str]] | None = None) -> None:
    """Remove what operators left in the shared folder, all of it or only some."""
    gone = made() if only is None else [x for x in only if x in _made]
    for x in gone:
        _made.remove(x)
    while gone:
        spark, path = gone.pop()
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session may be gone at exit
            return


atexit.register(release)


def trim(spark: SparkSession) -> bool:
    """Have the driver's JVM give freed native memory back to the system, which threads' malloc arenas keep otherwise; False where it can't."""
    try:
        sc = spark.sparkContext
        java, gateway = sc._jvm.java.lang, sc._gateway
        named = [java.Class.forName(k) for k in ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")]
        kinds, values = gateway.new_array(java.Class, 4), gateway.new_array(java.Object, 4)
        for i, k in enumerate(named):
            kinds[i] = k
        values[0], values[1] = sc._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        # by the interface's method: the server's own class is not open
        java.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(java.management.ManagementFactory.getPlatformMBeanServer(), values)
    except Exception:  # other JVMs, or JDK 17 before 17.0.9
        return False
    return True


def table(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet in the shared folder and reread: cuts lineage and outlives executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder in the shared one, from any process."""
    for scheme in ("s3a://", "s3n://"):  # Hadoop's names for s3
        uri = "s3://" + uri.removeprefix(scheme) if uri.startswith(scheme) else uri
    return pafs.FileSystem.from_uri(uri)


def put_file(uri: str, name: str, tag: str, write) -> None:
    """Write through a name that only this task attempt has, then rename: reruns replace whole files."""
    where, path = open_fs(uri)
    where.create_dir(path, recursive=True)
    tmp = f"{path}/.{name}.{tag}.{uuid.uuid4().hex[:8]}"
    with where.open_output_stream(tmp, compression=None) as out:
        write(out)
    where.move(tmp, f"{path}/{name}")


def join_small(big: DataFrame, small: DataFrame, on: str, how: str = "left", limit: int = BROADCAST_ROWS, salts: int = 32) -> DataFrame:
    """Join on a key that may be hot in big and is unique in small.

    small is broadcast if a count shows that it has no more than limit rows,
    else the key is salted: big's rows are dealt over salts copies of each key.
    Null keys match.
    """
    key = small[on]
    if small.limit(limit + 1).count() <= limit:
        right = F.broadcast(small.withColumnRenamed(on, "__on"))
        return big.join(right, big[on].eqNullSafe(right["__on"]), how).drop("__on")
    dealt = big.withColumn("__salt", F.pmod(F.xxhash64(*big.columns), F.lit(salts)))
    right = small.select(key.alias("__on"), *[c for c in small.columns if c != on]).withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(right, dealt[on].eqNullSafe(right["__on"]) & (dealt["__salt"] == right["__s"]), how).drop("__on", "__s", "__salt")


def id_crc(column: Column | str) -> Column:
    """crc32 of an id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string") if isinstance(column, str) else column.cast("string"), F.lit("")).cast("binary"))


def id_crc_py(value) -> int:
    return zlib.crc32(b"" if value is None else str(value).encode())


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def words(text: bytes) -> list[bytes]:
    r"""A-Z lower-cased, cut at [\x20\x09-\x0D]+; both leave other bytes alone."""
    return text.lower().split()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit numbers (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordHash:
    """64-bit hashes of words with a cache that is emptied when it is full."""

    def __init__(self, most: int = 400_000) -> None:
        import xxhash

        self.most, self.of, self.seen = most, xxhash.xxh3_64_intdigest, {}

    def __call__(self, tokens: list[bytes]) -> np.ndarray:
        seen, of = self.seen, self.of
        if len(seen) > self.most:
            seen.clear()
        try:
            return np.fromiter(map(seen.__getitem__, tokens), np.uint64, len(tokens))
        except KeyError:
            for w in set(tokens).difference(seen):
                seen[w] = of(w)
            return np.fromiter(map(seen.__getitem__, tokens), np.uint64, len(tokens))


def flat_words(texts_: Iterable[bytes], word_hash: WordHash) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of many texts in one array, and where each text starts (one more entry than texts)."""
    parts, sizes = [], [0]
    for t in texts_:
        w = words(t)
        sizes.append(len(w))
        parts.append(word_hash(w))
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), np.cumsum(np.array(sizes, np.int64))


def hash01(column: Column | str, salt: str) -> Column:
    """A number in (0, 1) that depends on the value and the salt alone: 48 bits of md5, DuckDB agrees."""
    text = F.concat(F.lit(salt), F.coalesce((F.col(column) if isinstance(column, str) else column).cast("string"), F.lit("")))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 48))


def bounded_sample(df: DataFrame, most: int, salt: str) -> DataFrame:
    """About most rows, no more, those with the smallest hashes of doc_id: all of them if there are no more."""
    n = df.count()
    if n <= most:
        return df
    key = hash01("doc_id", salt)
    few = df.where(key < F.lit(0.97 * most / n))
    return few.orderBy(key, F.xxhash64(*df.columns)).limit(most)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only these columns, so that others can't clash with an operator's own names; missing ones are null."""
    have = set(df.columns)
    return df.select(*[df[n].alias(n) if n in have else F.lit(None).alias(n) for n in names])


def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b for b in rows if b.num_rows)
