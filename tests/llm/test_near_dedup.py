import re

import numpy as np
import pytest
from packlane.llm import common, near_dedup


def shingles(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def by_hand(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            linked = a and b and 100 * len(a & b) >= 85 * len(a | b) and None not in (rows[i][0], rows[j][0])
            if linked or rows[i][0] is not None and rows[i][0] == rows[j][0] and a and b:
                parent[root(i)] = root(j)
    out = []
    for i, (d, _) in enumerate(rows):
        low = d if d is None or not sets[i] else min(rows[j][0] for j in range(len(rows)) if root(j) == root(i))
        out.append((d, len(sets[i]), low, d is None or d == low))
    return sorted(out, key=repr)


def made(seed):
    rng = np.random.default_rng(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    common_passage = " ".join(rng.choice(vocab, 25))
    for _ in range(25):
        base = list(rng.choice(vocab, int(rng.integers(60, 200))))
        for _ in range(int(rng.integers(1, 9))):
            w = list(base)
            for _ in range(int(rng.integers(0, 4))):
                w[int(rng.integers(len(w)))] = str(rng.choice(vocab))
            rows.append((n * 7 % 1009, " ".join(w) + (" " + common_passage if rng.random() < 0.3 else "")))
            n += 1
    return rows


ODD = [(2001, None), (2002, ""), (2003, " \t\n"), (2004, "few Words"), (2005, "FEW words"), (None, "few words"), (None, None), (2006, "a b c d e"), (2007, "a b c d e\x0b"), (2007, "a b c d e"), (2008, "a b c d e f"), (2009, "é " * 40_000)]


@pytest.mark.parametrize("rows", [made(1) + ODD, made(2), ODD])
def test_equals_brute_force(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fp string").repartition(3)
    assert sorted(map(tuple, near_dedup.near_duplicates(df).collect()), key=repr) == by_hand(rows)


def test_hot_group_of_near_copies(spark):
    rng = np.random.default_rng(4)
    base = [f"v{i}" for i in rng.integers(0, 900, 150)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(2):
            w[int(rng.integers(len(w)))] = f"n{i}"
        rows.append((i + 1, " ".join(w)))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=repr) == by_hand(rows)


def test_empty_table(spark):
    assert near_dedup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    rng = np.random.default_rng(8)
    links = [(int(i), int(i) + 1) for i in range(60)] + [(int(a), int(b)) for a, b in rng.integers(100, 200, (60, 2))]
    got = {r.node: r.component for r in near_dedup.components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()}
    parent = {x: x for p in links for x in p}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    assert got == {x: root(x) for x in parent if root(x) != x}


def test_components_of_links_that_lie_apart(spark, monkeypatch):
    """Few rounds suffice though no task sees two links of a node."""
    rounds = []
    whole = near_dedup.common.table
    monkeypatch.setattr(near_dedup.common, "table", lambda df, name: rounds.append(name) or whole(df, name))
    monkeypatch.setattr(near_dedup, "_forest", lambda rows: rows)
    rng = np.random.default_rng(5)
    order = rng.permutation(300).tolist()
    links = [(order[i], order[i + 1]) for i in range(299)]
    df = spark.createDataFrame([(max(x), min(x)) for x in links], "a long, b long").repartition(4)
    got = {r.node: r.component for r in near_dedup.components(df).collect()}
    assert got == {i: 0 for i in range(1, 300)} and len(rounds) <= 16


def test_signature_estimates_similarity_with_less_variance():
    rng = np.random.default_rng(6)
    errors = []
    for _ in range(60):
        pool = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
        a, b = pool[:30], pool[10:]
        starts = np.array([0, len(a), len(a) + len(b)])
        s = near_dedup.super_minhash(np.concatenate([a, b]), starts)
        assert np.isfinite(s).all()
        # the ranks of one element are all different
        one = near_dedup.super_minhash(a[:1], np.array([0, 1]))[0]
        assert sorted(np.floor(one).astype(int)) == list(range(near_dedup.REGISTERS))
        errors.append((s[0] == s[1]).mean() - 20 / 40)
    plain = 0.5 * 0.5 / near_dedup.REGISTERS
    assert abs(np.mean(errors)) < 0.02 and np.var(errors) < plain * 0.95


def test_early_stop_is_exact():
    rng = np.random.default_rng(9)
    e = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    whole = near_dedup.super_minhash(e, np.array([0, 900]), 32)
    parts = [near_dedup.super_minhash(e[i : i + 1], np.array([0, 1]), 32) for i in range(900)]
    assert np.array_equal(whole[0], np.min(np.concatenate(parts), axis=0))
    assert common.mix64(np.arange(3, dtype=np.uint64)).dtype == np.uint64


def test_keep_one(spark):
    df = spark.createDataFrame([(*r, "x") for r in made(3) + ODD], "doc_id long, text string, fp string")
    want = sorted({d for d, _, _, kept in by_hand(made(3) + ODD) if kept and d is not None})
    got = near_dedup.keep_one(df)
    assert got.columns == df.columns
    ids = [r.doc_id for r in got.collect()]
    assert sorted(d for d in ids if d is not None) == want and ids.count(None) == 2
