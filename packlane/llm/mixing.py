r"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document gets the key -ln(u) / w: u is a number in (0, 1) that depends on
its doc_id and the seed alone, w its quality weight. Within a source, keys in
ascending order are a weighted sample without replacement. A source's token
budget is first met by complete epochs of all its documents; the rest is taken
by keys until the prefix sum would overrun it.

What is then left is less than one document, the first that overruns. That gap
is filled by size, which departs from the sampling: of the sizes that remain,
from the largest that fits downwards, as many documents as fit, by key within a
size; then one further document if it comes nearer. So a source differs from
its budget by less than its smallest document that is left out.

Sums over a source never meet in one task. The end of a budget is found by
slices of keys: their sums need partial aggregation alone, and the slice in
which the budget ends is cut again until it has few rows (or one key). Rows of
one key are counted, not ordered; which of them are taken goes by the number
that a row gets when the table of keys is written, with a quota for each task
that wrote some.

Cases: a null text has size 0; a null source is a source of its own, last in
order; a null doc_id draws as the empty text; rows with equal keys are ordered
by doc_id, then size, and of fully equal rows as many as fit are taken. A table
whose sizes are all 0 has targets of 0. Other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WORD = r"[^\x20\x09-\x0D]+"
#: Slices that keys are cut into at once, and rows of a slice that may be ordered in one task.
SLICES, SLICE_ROWS = 1024, 20_000


@dataclass(frozen=True)
class Mix:
    #: Weights of the sources in their order, repeating.
    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    #: Share of all sizes that the mix takes.
    share: float = 1.0
    #: No document is taken more often than this.
    epochs: int = 3
    seed: str = "mix-1:"


def sizes(docs: DataFrame, *others: str) -> DataFrame:
    """doc_id, source, size, and the quality weight in [0.1, 1]: the share of letters in the text."""
    d = common.pick(docs, "doc_id", "source", "text", *others)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    return d.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.greatest(F.lit(0.1), letters / F.greatest(F.length(text), F.lit(1))).alias("weight"),
        *others,
    )


def numbered(per_source: DataFrame) -> DataFrame:
    """per_source with place, from 0 in the order of the sources by code point, null last: ranges are sorted apart and counted."""
    ranges = per_source.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    ranges = common.table(ranges, "mix-sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = ranges.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    return ranges.join(F.broadcast(starts), "part").withColumn("place", F.col("first") + within - 1).drop("part", "first")


def targets(per_source: DataFrame, mix: Mix) -> DataFrame:
    """source, source_size, target: shares by weight, held at epochs times the size, the excess dealt out again.

    Each round sums what is held at the level so far and deals the rest anew;
    the level only rises, and stays when no further source is held.
    """
    w = F.element_at(F.array(*map(F.lit, mix.weights)), (F.pmod("place", F.lit(len(mix.weights))) + 1).cast("int"))
    s = numbered(per_source).select("source", "source_size", w.alias("w"), (F.col("source_size") * F.lit(mix.epochs)).cast("double").alias("most"))
    s = common.table(s, "mix-weights")
    level, count = 0.0, -1
    total = (s.agg(F.sum("source_size")).first()[0] or 0) * mix.share
    while True:
        held = F.col("most") < F.col("w") * F.lit(level)
        n, gone, free = s.agg(F.count_if(held), F.coalesce(F.sum(F.when(held, F.col("most"))), F.lit(0.0)), F.sum(F.when(~held, F.col("w")))).first()
        if n == count or not free:
            break
        count, level = n, max(0.0, total - gone) / free
    top = level if free else float("inf")
    return s.select("source", "source_size", F.least("most", F.col("w") * F.lit(top)).alias("target"))


def _key() -> Column:
    return F.struct("draw", "doc_id", "size")


def keyed(docs: DataFrame, mix: Mix, *others: str) -> DataFrame:
    """doc_id, source, size, the sampling key and a number of every row, and other columns as they are: a written table."""
    rows = sizes(docs, *others).withColumn("draw", -F.log(common.hash01("doc_id", mix.seed)) / F.col("weight")).drop("weight")
    return common.table(rows.withColumn("rid", F.monotonically_increasing_id()), "mix-keys")


def _slices(rows: DataFrame, place: Column) -> DataFrame:
    """Of rows(g, a, draw, left, base), the slice of each g in which left ends: g, left, base (what lies before it), n, lo, hi."""
    cut = rows.withColumn("slice", F.least(F.lit(SLICES - 1), F.floor(place * SLICES)).cast("int"))
    per = cut.groupBy("g", "slice").agg(F.sum("a").alias("amount"), F.count("*").alias("n"), F.min("draw").alias("lo"), F.max("draw").alias("hi"), F.first("left").alias("left"), F.first("base").alias("base"))
    up = Window.partitionBy("g").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("base", F.col("base") + F.coalesce(F.sum("amount").over(up), F.lit(0)))
    return per.where((F.col("base") <= F.col("left")) & (F.col("left") < F.col("base") + F.col("amount"))).select("g", "left", "base", "n", "lo", "hi")


def cut(rows: DataFrame, budget: DataFrame) -> DataFrame:
    """Where the amounts a of rows(g, a, draw, doc_id, size), by key, would overrun budget(g, left).

    g, stop (the first key that does not fit whole, null if all fit), m (rows
    of that key that fit), gone (the amounts that fit).
    """
    held = common.join_small(rows, budget.select("g", "left"), "g", "inner")
    stats = common.table(held.groupBy("g").agg(F.first("left").alias("left"), F.avg("draw").alias("mean"), F.sum("a").alias("total")), "mix-sums")
    over = stats.where("total > left").select("g", "left", "mean", F.lit(0).cast("long").alias("base"))
    # keys are much like exponential ones: this spreads them over [0, 1)
    ends = common.table(_slices(common.join_small(rows, over, "g", "inner"), F.col("draw") / (F.col("draw") + F.col("mean"))), "mix-ends")
    wide = (F.col("n") > SLICE_ROWS) & (F.col("hi") > F.col("lo"))
    while not ends.where(wide).isEmpty():
        again = common.join_small(rows, ends.where(wide).drop("n"), "g", "inner").where(F.col("draw").between(F.col("lo"), F.col("hi")))
        ends = common.table(ends.where(~wide).unionByName(_slices(again, (F.col("draw") - F.col("lo")) / (F.col("hi") - F.col("lo")))), "mix-ends")
    last = common.join_small(rows, ends.drop("n"), "g", "inner").where(F.col("draw").between(F.col("lo"), F.col("hi")))
    # rows of one key are one row with a count
    keys = last.groupBy("g", "draw", "doc_id", "size").agg(F.count("*").alias("n"), F.first("a").alias("a"), F.first("left").alias("left"), F.first("base").alias("base"))
    order = Window.partitionBy("g").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    keys = keys.withColumn("upto", F.col("base") + F.sum(F.col("n") * F.col("a")).over(order))
    stop = F.min(F.struct("draw", "doc_id", "size", "n", "a", "upto", "left"))
    first = keys.where(F.col("upto") > F.col("left")).groupBy("g").agg(stop.alias("s"))
    before = F.col("s.upto") - F.col("s.n") * F.col("s.a")
    m = F.floor((F.col("s.left") - before) / F.col("s.a")).cast("long")
    found = first.select("g", F.struct("s.draw", "s.doc_id", "s.size").alias("stop"), m.alias("m"), (before + m * F.col("s.a")).alias("gone"))
    whole = stats.where("total <= left").select("g", F.lit(None).cast(found.schema["stop"].dataType).alias("stop"), F.lit(0).cast("long").alias("m"), F.col("total").alias("gone"))
    return common.table(found.unionByName(whole), "mix-cut")


def fill(gap: float, sizes_: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(size, how many) that fill a gap from (size, count) in descending order: those that fit, then one more if it comes nearer."""
    out: dict[int, int] = {}
    for size, n in sizes_:
        if size <= gap and (k := min(n, math.floor(gap / size))):
            out[size] = k
            gap -= k * size
    over = [size for size, n in sizes_ if size > gap and n > out.get(size, 0)]
    if over and min(over) - gap < gap:
        out[min(over)] = out.get(min(over), 0) + 1
    return list(out.items())


def _name(*columns: str) -> Column:
    """A text that tells values apart, null too."""
    return F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns])


def budgets(rows: DataFrame, mix: Mix) -> tuple[DataFrame, DataFrame]:
    """What decides how often a row of a table of keys is taken.

    A row for each source: source, source_size, target, full (complete epochs),
    some (whether a part is taken), miss (rows before this key are taken once
    more; null: all of them). And a row for each source and size of which rows
    from miss on are taken: g, stop and m (as cut gives them).
    """
    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    full = F.when(F.col("source_size") > 0, F.least(F.lit(mix.epochs), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("long")
    plan = targets(per_source, mix).select("source", "source_size", "target", full.alias("full"), _name("source").alias("g"))
    plan = common.table(plan.withColumn("left", F.col("target") - F.col("full") * F.col("source_size")), "mix-plan")
    own = rows.select(_name("source").alias("g"), F.col("size").alias("a"), "draw", "doc_id", "size", "source")
    ends = cut(own, plan.where("left > 0"))
    plan = common.table(plan.join(ends, "g", "left").select("g", "source", "source_size", "target", "full", "left", (F.col("left") > 0).alias("some"), F.col("stop").alias("miss"), "m", (F.col("left") - F.col("gone")).alias("gap")), "mix-budgets")

    # what is left, by size: at most as many rows for a source as its gap has words
    open_ = plan.where("some AND miss IS NOT NULL").select("g", "miss", "m", "gap")
    rest = common.join_small(own, open_, "g", "inner").where((_key() >= F.col("miss")) & (F.col("size") > 0))
    near = (F.col("size") < 2 * F.col("gap")) | (F.col("size") == F.col("miss.size"))
    hist = rest.where(near).groupBy("g", "size").agg(F.count("*").alias("n"), F.first("gap").alias("gap"), F.first("m").alias("m"), F.first("miss.size").alias("last"))

    def filled(part: pa.Table) -> pa.Table:
        gap, m, last = (part[c][0].as_py() for c in ("gap", "m", "last"))
        free = sorted(((size, n - (m if size == last else 0)) for size, n in zip(part["size"].to_pylist(), part["n"].to_pylist())), reverse=True)
        taken = dict(fill(gap, [(size, n) for size, n in free if size < 2 * gap]))
        if m:
            taken[last] = taken.get(last, 0) + m
        return pa.table({"g": pa.array([part["g"][0].as_py()] * len(taken), pa.string()), "size": pa.array(taken, pa.int64()), "left": pa.array(taken.values(), pa.int64())})

    fills = common.table(hist.groupBy("g").applyInArrow(filled, "g string, size long, left long").select(F.concat_ws("|", "g", F.col("size").cast("string")).alias("g"), "left"), "mix-fills")
    of_size = rest.select(F.concat_ws("|", "g", F.col("size").cast("string")).alias("g"), F.lit(1).cast("long").alias("a"), "draw", "doc_id", "size")
    return plan.drop("g", "left", "m", "gap"), cut(of_size, fills).select("g", "stop", "m")


def dealt(rows: DataFrame, mix: Mix) -> DataFrame:
    """A table of keys with source_size, target and copies: how often the mix takes each row."""
    plan, fills = budgets(rows, mix)
    key = _key()
    out = common.join_small(rows, plan, "source")
    slot = F.concat_ws("|", _name("source"), F.col("size").cast("string"))
    out = out.withColumn("slot", F.when(F.col("some") & F.coalesce(key >= F.col("miss"), F.lit(False)), slot))
    out = common.join_small(out, fills.withColumnRenamed("g", "slot"), "slot")
    inside = F.col("some") & (F.col("miss").isNull() | (key < F.col("miss")))
    chosen = F.col("m").isNotNull() & (F.col("stop").isNull() | (key < F.col("stop")))
    tied = F.coalesce((key == F.col("stop")) & (F.col("m") > 0), F.lit(False))
    out = out.withColumns({"tied": tied, "part": F.coalesce(inside | chosen, F.lit(False))})
    # of rows of one key, the first ones by their number: each task that wrote some has a quota
    task = F.shiftright("rid", 33)
    ties = out.where("tied").withColumn("task", task)
    up = Window.partitionBy("slot").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    quotas = ties.groupBy("slot", "task").agg(F.count("*").alias("n"), F.first("m").alias("m")).withColumn("quota", F.col("m") - F.coalesce(F.sum("n").over(up), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("slot", "task").orderBy("rid"))
    settled = ties.withColumn("n", within).join(quotas.select("slot", "task", "quota"), ["slot", "task"]).withColumn("part", F.col("n") <= F.col("quota"))
    both = out.where("NOT tied").select(*rows.columns, "source_size", "target", "full", "part").unionByName(settled.select(*rows.columns, "source_size", "target", "full", "part"))
    return both.select(*rows.columns, "source_size", "target", (F.col("full") + F.col("part").cast("long")).alias("copies"))


def take(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every row."""
    common.prepare(docs.sparkSession)
    return dealt(keyed(docs, mix), mix).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The rows of docs, all columns, each as often as the mix takes it."""
    common.prepare(docs.sparkSession)
    own = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    out = dealt(keyed(docs.select("doc_id", "source", "text", own), mix, "row"), mix).where("copies > 0")
    return out.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("row.*")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return take(common.documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    greatest(0.1::DOUBLE, length(regexp_replace(coalesce(text, ''), '[^\p{L}]+', '', 'g'))::DOUBLE / greatest(length(coalesce(text, '')), 1)) AS weight,
    (('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656::DOUBLE AS u
  FROM documents),
k AS (SELECT *, -ln(u) / weight AS draw FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
sw AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w, (3 * source_size)::DOUBLE AS most FROM s),
sl AS (SELECT *, greatest(0.0::DOUBLE, (sum(source_size) OVER ())::DOUBLE - coalesce(sum(most) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
   / sum(w) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM sw),
t AS (SELECT source, source_size, least(most, w * coalesce(max(CASE WHEN most >= level * w THEN level END) OVER (), 'inf'::DOUBLE)) AS target FROM sl),
p AS (SELECT *, CASE WHEN source_size > 0 THEN least(3, floor(target / source_size)) ELSE 0 END::BIGINT AS epochs FROM t),
r AS (SELECT k.*, p.source_size, p.target, p.epochs, p.target - p.epochs * p.source_size AS rest, row_number() OVER o AS rn, sum(k.size) OVER o AS upto
  FROM k JOIN p ON k.source IS NOT DISTINCT FROM p.source WINDOW o AS (PARTITION BY k.source ORDER BY draw, doc_id, k.size ROWS UNBOUNDED PRECEDING)),
i AS (SELECT *, rest > 0 AND upto <= rest AS inside FROM r),
h AS (SELECT source, size, count(*) AS n FROM i WHERE NOT inside AND rest > 0 AND size > 0 GROUP BY source, size),
g AS (SELECT source, any_value(rest) - coalesce(max(upto) FILTER (WHERE inside), 0) AS gap FROM i WHERE rest > 0 GROUP BY source),
-- from the largest size that fits downwards, as many as fit
f AS (SELECT source, 9223372036854775807::BIGINT AS size, 0::BIGINT AS k, gap::DOUBLE AS gap FROM g
  UNION ALL SELECT x.source, x.size, least(x.n, floor(x.gap / x.size))::BIGINT, x.gap - least(x.n, floor(x.gap / x.size)) * x.size
  FROM (SELECT f.source, f.gap, h.size, h.n, row_number() OVER (PARTITION BY f.source ORDER BY h.size DESC) AS nth FROM f JOIN h ON f.source IS NOT DISTINCT FROM h.source AND h.size <= f.gap AND h.size < f.size) x WHERE nth = 1),
e AS (SELECT source, min(gap) AS gap FROM f GROUP BY source),
-- and one more if it comes nearer
m AS (SELECT h.source, min(h.size) AS size FROM h JOIN e ON h.source IS NOT DISTINCT FROM e.source LEFT JOIN f ON f.source IS NOT DISTINCT FROM h.source AND f.size = h.size
  WHERE h.size > e.gap AND h.n > coalesce(f.k, 0) GROUP BY h.source, e.gap HAVING min(h.size) - e.gap < e.gap),
c AS (SELECT h.source, h.size, coalesce(f.k, 0) + (m.size IS NOT NULL)::INT AS k FROM h LEFT JOIN f ON f.source IS NOT DISTINCT FROM h.source AND f.size = h.size LEFT JOIN m ON m.source IS NOT DISTINCT FROM h.source AND m.size = h.size),
z AS (SELECT i.*, CASE WHEN NOT inside THEN row_number() OVER (PARTITION BY source, size, inside ORDER BY rn) END AS nth FROM i)
SELECT z.doc_id, z.size, source_size, target, ((epochs + (inside OR coalesce(nth <= c.k, FALSE))::INT) * z.size)::BIGINT AS taken
FROM z LEFT JOIN c ON z.source IS NOT DISTINCT FROM c.source AND z.size = c.size
"""
