import hashlib
import io
import re
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from packlane.llm import exact_dedup as ed


def plain(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


ROWS = [(5, "a  b"), (3, "a\tb"), (9, "a b"), (4, " a b"), (None, "a b"), (None, "alone"), (None, "alone"), (7, None), (8, ""), (6, " "), (2, "\n\r"), (11, "x " * 50_000), (10, "x\x0b" * 50_000), (3, "a b"), (12, "é\xa0é"), (13, "é é"), (14, "\x1c"), (15, "\x00")]
ROWS += [(100 + i, "hot  text" if i % 3 else f"cold {i}") for i in range(400)]


def by_hand(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[plain(t)].append(d)
    out = []
    for text, ids in groups.items():
        known = [d for d in ids if d is not None]
        keep = min(known) if known else None
        first = True
        for d in sorted(ids, key=lambda d: (d is None, d or 0)):
            out.append((d, keep, len(ids), first, hashlib.sha256(text.encode()).hexdigest()))
            first = False
    return sorted(out, key=repr)


@pytest.mark.parametrize("windows", [1, 16])
@pytest.mark.parametrize("key", [None, lambda t: 7, lambda t: len(t) << 60 & 0xFFFFFFFFFFFFFFFF | len(t)])
def test_equals_brute_force(spark, monkeypatch, key, windows):
    monkeypatch.setattr(ed, "WINDOW_ROWS", 50)
    monkeypatch.setattr(ed, "WINDOWS", windows)
    monkeypatch.setattr(ed, "OWNER_BYTES", 2000)
    df = spark.createDataFrame([(*r, 1) for r in ROWS], "doc_id long, text string, rows int").repartition(3)
    assert sorted(map(tuple, ed.exact_dedup(df, key).collect()), key=repr) == by_hand(ROWS)


def test_empty(spark):
    assert ed.exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 40) | st.integers(0, (1 << 64) - 1), max_size=300), st.integers(0, 8), st.integers(1, 5))
def test_index(keys, shift, capacity):
    low = (1 << 64 - shift) - 1
    keys = [k & low for k in keys]
    monkeypatched, ed.DEEPEST = ed.DEEPEST, 8
    index = ed.ExtendibleHash(capacity, shift)
    for i, k in enumerate(keys):
        assert index.insert(k) == i
    want = defaultdict(set)
    for i, k in enumerate(keys):
        want[k].add(i)
    out = io.BytesIO()
    index.save(out, [i * 3 for i in range(len(keys))], [1] * len(keys))
    saved = ed.IndexFile(out.getvalue())
    for k in [*want, 12345 & low]:
        assert set(index.find(k)) == want.get(k, set()) == {s[1] for s in saved.find(k)}
    ed.DEEPEST = monkeypatched
    assert len(index.directory) == 1 << index.depth
    assert all(len(b) <= capacity or d == min(8, 64 - shift) for b, d in zip(index.buckets, index.local))


@given(st.text(alphabet=" \t\n\x0b\x0c\r\x1c\x85\xa0ab", max_size=12))
def test_normalise(text):
    assert ed.normalise(text.encode()).decode() == plain(text)
