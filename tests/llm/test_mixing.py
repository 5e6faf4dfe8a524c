import math
from collections import defaultdict

import pytest
from packlane.llm import mixing

HOT = [(i, "b" if i % 3 else ("a", "c", None)[i // 3 % 3], "word " * (i % 17) + "x") for i in range(300)]


def filled(size, weights=(5.0, 2.0, 1.0), epochs=3):
    """Water filling by repetition."""
    order = sorted(size, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, held = sum(size.values()), set()
    while True:
        rest = total - sum(epochs * size[s] for s in held)
        free = [s for s in order if s not in held]
        out = {s: epochs * size[s] if s in held else rest * w[s] / sum(w[x] for x in free) for s in order}
        over = {s for s in free if out[s] > epochs * size[s]}
        if not over:
            return out
        held |= over


@pytest.mark.parametrize(
    "rows",
    [
        HOT,
        [(1, "a", "x " * 5), (2, "b", "y " * 500), (3, "c", "z " * 400)],
        [(None, None, None), (None, None, None), (1, "a", ""), (1, "a", "one two"), (1, "a", "one two")],
        [(i, "s", "one two") for i in range(40)],
    ],
)
def test_targets_and_taken(spark, rows):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, source string, text string, target string, taken int")
    got = mixing.take(df).collect()
    assert len(got) == len(rows)
    size, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in got:
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
        size[r.source] += r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    want = filled(size)
    for r in got:
        assert math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-9) and r.source_size == size[r.source]
    for s in size:
        assert abs(taken[s] - want[s]) <= largest[s]
    again = mixing.take(df).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_keys_decide_within_a_source(spark):
    df = spark.createDataFrame(HOT, "doc_id long, source string, text string")
    got = {r.doc_id: r for r in mixing.take(df).collect()}
    rows = {r.doc_id: r for r in mixing.sizes(df).withColumn("u", mixing.common.hash01("doc_id", mixing.Mix().seed)).collect()}
    for source in ("a", "b", "c", None):
        mine = sorted((-math.log(r.u) / r.weight, d) for d, r in rows.items() if r.source == source)
        full, rest = divmod(got[mine[0][1]].target, got[mine[0][1]].source_size)
        total, inside = 0, []
        for _, d in mine:
            total += rows[d].size
            if total > rest:
                break
            inside.append(d)
        more = [d for _, d in mine if got[d].copies > full]
        assert more[: len(inside)] == inside


def test_empty(spark):
    assert mixing.take(spark.createDataFrame([], "doc_id long, source string, text string")).count() == 0


def test_mixed_repeats_rows(spark):
    df = spark.createDataFrame([(*r, "clash", 1.5) for r in HOT], "doc_id long, source string, text string, target string, draw double")
    copies = {r.doc_id: r.copies for r in mixing.take(df).collect()}
    out = mixing.mixed(df)
    assert out.columns == df.columns
    seen = defaultdict(int)
    for r in out.collect():
        seen[r.doc_id] += 1
    assert seen == {d: n for d, n in copies.items() if n}


def left_out(rows):
    """Per source: |taken - target|, and the smallest document with words that is left out (the largest one if none is)."""
    size, taken, target, small = defaultdict(int), defaultdict(int), {}, {}
    for r in rows:
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    for r in rows:
        if r.size and r.copies <= r.target // size[r.source]:
            small[r.source] = min(small.get(r.source, r.size), r.size)
    return {s: (abs(taken[s] - target[s]), small.get(s, max(r.size for r in rows if r.source == s))) for s in size}


@pytest.mark.parametrize("seed", ["mix-1:", "a"])
def test_long_documents_leave_no_budget_unfilled(spark, seed):
    rows = [(i, "even", "w " * 10) for i in range(300)] + [(300, "even", "w " * 3000)]
    rows += [(1000 + i, None, "w " * (100 + 7 * i % 600)) for i in range(80)] + [(1100, None, "w " * 40_000), (1101, None, "w " * 9000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    mix = mixing.Mix(weights=(1.0, 5.0), share=0.4, seed=seed)
    got = mixing.take(df, mix).collect()
    for off, small in left_out(got).values():
        assert off <= small
    copies = {r.doc_id: r.copies for r in got}
    seen = defaultdict(int)
    for r in mixing.mixed(df, mix).collect():
        seen[r.doc_id] += 1
    assert seen == {d: n for d, n in copies.items() if n}


@pytest.mark.parametrize("same", [(None, "hot", "a b c d e"), (7, "hot", "a b c d e")])
def test_equal_rows_are_taken_one_by_one(spark, same):
    """Many rows with one key: as many as fit, whichever task holds them."""
    rows = [same] * 40 + [(100 + i, "other", "x " * 90) for i in range(2)] + [(200, "third", "y " * 700)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    for mix in (mixing.Mix(), mixing.Mix(weights=(1.0, 1.0, 7.0), share=0.3)):
        got = mixing.take(df, mix).collect()
        hot = [r for r in got if r.source == "hot"]
        assert len(hot) == 40 and abs(sum(r.taken for r in hot) - hot[0].target) <= 2.5
        assert {r.copies for r in hot} <= {hot[0].target // 200, hot[0].target // 200 + 1}
        out = mixing.mixed(df, mix)
        assert out.where("source = 'hot'").count() * 5 == sum(r.taken for r in hot)


def test_slices_are_cut_until_they_are_small(spark, monkeypatch):
    """Rows at the weight floor don't pile up in one slice."""
    monkeypatch.setattr(mixing, "SLICE_ROWS", 3)
    monkeypatch.setattr(mixing, "SLICES", 16)
    rows = [(i, "s" if i % 2 else "t", "1 2 3 " + "4 " * (i % 5)) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.take(df, mixing.Mix(share=0.4)).collect()
    assert all(off < 1 for off, _ in left_out(got).values())
    draws = mixing.keyed(df, mixing.Mix())
    mean = draws.agg({"draw": "avg"}).first()[0]
    held = draws.selectExpr(f"least(15, floor(draw / (draw + {mean}) * 16)) AS s").groupBy("s").count().collect()
    assert max(r["count"] for r in held) <= 2 * 600 / 16


def test_fill():
    assert mixing.fill(25.5, [(20, 3), (10, 9), (5, 1), (1, 0)]) == [(20, 1), (5, 1)]
    assert mixing.fill(6.0, [(10, 2), (4, 1)]) == [(4, 1)] and mixing.fill(6.0, [(10, 2)]) == [(10, 1)] and mixing.fill(4.0, [(10, 2)]) == []
    assert mixing.fill(0.0, [(10, 2)]) == [] and mixing.fill(8.0, [(9, 1), (3, 2)]) == [(3, 2), (9, 1)][:1] + ([(9, 1)] if 9 - 2 < 2 else [])


def test_equals_sql(spark, tmp_path):
    import duckdb

    rows = HOT + [(None, None, None), (None, "b", "five words are in here")] + [(7, "c", "the same row again")] * 30
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = c.execute(mixing.SQL).fetchall()
    got = mixing.op2_mixing(spark, str(tmp_path))
    plain = lambda rows: sorted(repr((d, int(s), int(ss), round(float(t), 6), int(k))) for d, s, ss, t, k in rows)
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken"]
    assert plain(map(tuple, got.collect())) == plain(want)
