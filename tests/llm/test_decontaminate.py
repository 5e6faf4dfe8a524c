import numpy as np
import pytest
from packlane.llm import decontaminate as dc

RNG = np.random.default_rng(11)
VOCAB = [f"w{i}" for i in range(3000)]
ITEMS = [(i, " ".join(RNG.choice(VOCAB, n))) for i, n in enumerate([40, 25, 16, 60, 9, 3, 1])] + [(100, None), (101, ""), (102, "The AND, of!")]


def noise(n):
    return " ".join(f"z{i}" for i in RNG.integers(0, 5000, n))


def substituted(text, share):
    w = text.split()
    for i in RNG.choice(len(w), int(len(w) * share), replace=False):
        w[i] = "changed"
    return " ".join(w)


DOCS = (
    [(10 + i, f"{noise(80)} {t.upper()}; {noise(30)}") for i, t in ITEMS[:7]]
    + [(20 + i, f"{noise(50)}\n{substituted(t, 0.15)} {noise(10)}") for i, t in ITEMS[:4]]
    + [(30, noise(400)), (31, None), (32, ""), (33, " ".join(ITEMS[0][1].split()[:8]) + " " + noise(50)), (34, " ".join(ITEMS[3][1].split()[20:40])), (35, "x the and of y"), (36, noise(40_000) + " " + ITEMS[1][1])]
    + [(37, ITEMS[2][1]), (37, ITEMS[2][1]), (None, ITEMS[2][1]), (38, " ".join(ITEMS[0][1].split()[::-1]))]
)
WANT = {(10 + i, i) for i in range(7)} | {(20 + i, i) for i in range(4)} | {(34, 3), (35, 102), (36, 1), (37, 2), (None, 2)}


@pytest.mark.parametrize("limit", [100, dc.BLOCK_WORDS])
def test_planted(spark, monkeypatch, limit):
    monkeypatch.setattr(dc, "BLOCK_WORDS", limit)
    docs = spark.createDataFrame([(*r, 1) for r in DOCS], "doc_id long, text string, matched int")
    items = spark.createDataFrame([(*r, "x") for r in ITEMS], "item_id long, text string, start string")
    got = dc.leaks(docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in got} == WANT
    assert sum(r.doc_id == 37 for r in got) == 2
    for r in got:
        assert r.matched >= 0.8 * r.length
    kept = dc.clean(docs, items)
    assert kept.columns == docs.columns
    assert sorted(map(repr, kept.collect())) == sorted(repr(r) for r in docs.collect() if r.doc_id not in {d for d, _ in WANT})


def test_empty(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert dc.leaks(docs, items).count() == 0
    assert dc.leaks(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), items).count() == 0


def test_seeds_meet_substituted_copies():
    """Brute force over diagonals finds nothing that the seeds miss at a tenth of substitutions."""
    hash_ = dc.common.WordHash()
    found = 0
    for _ in range(200):
        item = " ".join(RNG.choice(VOCAB, 30))
        doc = dc.hash_words((noise(20) + " " + substituted(item, 0.1) + " " + noise(20)).encode(), hash_)
        index = dc.Items([0], [dc.hash_words(item.encode(), hash_)])
        brute = max((m for g in range(-30, len(doc)) if (v := dc.verify(doc, index.words[0], g)) for m in [v[3]]), default=0)
        got = index.leaks(doc)
        found += bool(got) and got[0][4] == brute
    assert found == 200


def brute(doc, item):
    """Whether any segment of any diagonal keeps the rule, tried one by one."""
    for diagonal in range(-len(item) + 1, len(doc)):
        same = [doc[j + diagonal] == w for j, w in enumerate(item) if 0 <= j + diagonal < len(doc)]
        for a in range(len(same)):
            m = 0
            for b in range(a, len(same)):
                m += same[b]
                if 5 * m >= 4 * (b - a + 1) and (m >= 13 or 5 * m >= 4 * len(item)):
                    return True
    return False


def leak_of(doc, item):
    hash_ = dc.common.WordHash()
    return dc.Items([0], [dc.hash_words(item.encode(), hash_)]).leaks(dc.hash_words(doc.encode(), hash_))


def clumped(copied, changed, times):
    """An item of runs, and a document that copies only the runs."""
    item = [f"i{n}" for n in range(times * (copied + changed))]
    return " ".join(item), " ".join(w if n % (copied + changed) < copied else f"c{n}" for n, w in enumerate(item))


@pytest.mark.parametrize("copied, changed, times", [(14, 6, 3), (20, 9, 4), (14, 14, 2), (13, 1, 9)])
def test_more_of_the_item_loses_no_run(copied, changed, times):
    item, doc = clumped(copied, changed, times)
    got = leak_of(doc, item)
    assert got and got[0][4] >= copied and 5 * got[0][4] >= 4 * got[0][3]


@pytest.mark.parametrize("share", [0.2, 0.25, 0.3])
def test_leaks_are_those_of_brute_force(share):
    rng = np.random.default_rng(int(share * 100))
    seen = set()
    for n in [*range(1, 20), *range(20, 80, 3)] * 4:
        item = [f"i{x}" for x in rng.integers(0, 400, n)]
        doc = list(item)
        at = 0
        while at < n:  # clumps of 1 to 6 words, or single ones
            if rng.random() < share / (2 if n % 2 else 1):
                for j in range(at, min(n, at + (rng.integers(1, 7) if n % 2 else 1))):
                    doc[j] = "changed"
            at += 1
        doc = ["z"] * 5 + doc + ["z"] * 5
        want = brute(doc, item)
        got = leak_of(" ".join(doc), " ".join(item))
        assert bool(got) == want
        for _, a, q, length, matched in got:
            assert sum(doc[a + j] == item[q + j] for j in range(length)) == matched
            assert 5 * matched >= 4 * length and (matched >= 13 or 5 * matched >= 4 * n)
        seen.add(want)
    assert seen == {True, False}


@pytest.mark.parametrize("n", range(1, 24))
def test_one_or_more_changed_words_of_short_items(n):
    """Every choice of changed words of which the rule allows as many is met."""
    from itertools import combinations

    item = [f"i{x}" for x in range(n)]
    for changed in combinations(range(n), min(n // 5, 3)):
        assert leak_of("z z " + " ".join("c" if j in changed else w for j, w in enumerate(item)) + " z", " ".join(item))


def test_texts_hashed_together(monkeypatch):
    """Borders of groups and chunks change nothing, and what two documents hold half each is no leak."""
    rng = np.random.default_rng(5)
    items = [" ".join(f"w{x}" for x in rng.integers(0, 60, n)) for n in (1, 2, 5, 13, 16, 40)]
    docs = []
    for _ in range(60):
        words = [f"w{x}" for x in rng.integers(0, 400, rng.integers(0, 90))]
        at = int(rng.integers(0, len(words) + 1))
        docs.append(" ".join([*words[:at], *items[int(rng.integers(len(items)))].split(), *words[at:]]).encode())
    docs += [b"", items[4][: len(items[4]) // 2].encode(), items[4][len(items[4]) // 2 :].encode(), b""]
    hash_ = dc.common.WordHash()
    index = dc.Items(list(range(len(items))), [dc.hash_words(x.encode(), hash_) for x in items])
    alone = [index.leaks(dc.hash_words(d, hash_)) for d in docs]
    assert any(alone) and not alone[-2] + alone[-3]
    for chunk, group in ((1, 1), (7, 50), (1 << 14, 1 << 16)):
        monkeypatch.setattr(dc, "CHUNK", chunk)
        monkeypatch.setattr(dc, "GROUP", group)
        assert list(index.leaks_of(docs, hash_)) == alone
    assert list(index.leaks_of([], hash_)) == []
