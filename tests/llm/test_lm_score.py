import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from packlane.llm import common, lm_score


def ppm(train, text, order):
    """Method C with symbol exclusion, a symbol at a time."""
    counts = defaultdict(Counter)
    for t in train:
        s = [257] * order + list(t) + [256]
        for i in range(order, len(s)):
            for k in range(order + 1):
                counts[tuple(s[i - k : i])][s[i]] += 1
    total, s = 0.0, [257] * order + list(text) + [256]
    for i in range(order, len(s)):
        out: set = set()
        for k in range(order, -1, -1):
            c = {x: n for x, n in counts.get(tuple(s[i - k : i]), {}).items() if x not in out}
            if s[i] in c:
                total += math.log10(c[s[i]] / (sum(c.values()) + len(c)))
                break
            if c:
                total += math.log10(len(c) / (sum(c.values()) + len(c)))
                out |= set(c)
        else:
            total -= math.log10(257 - len(out))
    return total


ROWS = [(i, "abra cadabra " * (i % 4) + "Simsala BIM bim"[: i % 16]) for i in range(40)] + [(50, None), (51, ""), (None, "no id"), (52, "\x00é\t\n日 zz"), (6, "twice"), (6, "twice"), (57, "q" * 3000)]


@pytest.mark.parametrize(("order", "block", "piece"), [(4, 200, 1 << 20), (2, 1 << 20, 64)])
def test_equals_brute_force(spark, monkeypatch, order, block, piece):
    monkeypatch.setattr(lm_score, "SLICE", piece)
    df = spark.createDataFrame([(*r, 1.5) for r in ROWS], "doc_id long, text string, score double")
    got = lm_score.score(df, order=order, block=block).collect()
    assert len(got) == len(ROWS)
    held = [common.id_crc_py(d) % 5 == 1 for d, _ in ROWS]
    train = [(t or "").encode() for (_, t), h in zip(ROWS, held) if not h]
    split = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", t.lower())
    c = Counter(w for t in train for w in split(t))
    n, v = sum(c.values()) + len(train), len(c) + 1
    want = []
    for (d, t), h in zip(ROWS, held):
        text = (t or "").encode()
        tokens = [c[w] for w in split(text)] + [len(train)]
        want.append((d, h, len(tokens), sum(x > 0 for x in tokens), n, sum(math.log10((x + 0.5) / (n + 0.5 * (v + 1))) for x in tokens), ppm(train, text, order)))
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[6])
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key)):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9) and math.isclose(a[6], b[6], rel_tol=1e-9)


@pytest.mark.parametrize("n", [0, 1, 2, 5000])
def test_finder_equals_binary_search(n):
    draw = np.random.default_rng(n)
    grams = np.unique(np.concatenate([draw.integers(0, 1 << 45, n), np.arange(n) << 36]))[:n]
    values, asked = draw.random(n), draw.integers(0, max(n, 1), 3 * n)
    find = lm_score.Finder(grams, values)
    assert np.array_equal(find(grams[asked]), values[asked])
    with pytest.raises(KeyError):
        find(np.array([1 << 44 | 1]))


def test_without_training_rows(spark):
    held = [i for i in range(60) if common.id_crc_py(i) % 5 == 1][:2]
    got = lm_score.score(spark.createDataFrame([(held[0], "ab"), (held[1], None)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.train_tokens, r.n_known, r.base_score) for r in got] == [(0, 0, 0.0), (0, 0, 0.0)]
    assert math.isclose(got[0].score, -3 * math.log10(257)) and math.isclose(got[1].score, -math.log10(257))


def test_empty_table(spark):
    assert lm_score.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_repeated_rows_are_dealt_over_blocks(spark, monkeypatch):
    """A third of all rows alike: no block gets much more than its share, and all rows have the same score."""
    words, whole = [], common.table

    def table(df, name):
        out = whole(df, name)
        if name == "lm-needs":
            assert "shufflepartitionidpassthrough" in df._jdf.queryExecution().executedPlan().toString()
            words.extend(r["count"] for r in out.where(f"kind = {lm_score.WORD}").groupBy("block").count().collect())
        return out

    monkeypatch.setattr(common, "table", table)
    df = spark.createDataFrame([(1000, "the same text") if i % 3 == 0 else (i, f"another text {i}") for i in range(600)], "doc_id long, text string").repartition(3)
    got = lm_score.score(df, block=600).where("doc_id = 1000").collect()
    assert len(got) == 200 and len({r.score for r in got}) == 1
    assert len(words) > 15 and max(words) < 60
