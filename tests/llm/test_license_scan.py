import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from packlane.llm import license_scan as ls

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def base_by_hand(text):
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in text)
    w = WORD.findall(low)
    hits = [(i, p) for i in range(len(w)) for p, (phrase, _) in enumerate(ls.PHRASES) if w[i : i + len(phrase.split())] == phrase.encode().split()]
    return len(w), sorted(hits)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("under the mit license apache version 2 cc by nc Apache, MIT x é_ - CC-BY-NC software permission is".split()), max_size=40))
def test_base_places(parts):
    text = " ".join(parts).encode()
    found = ls.Scanner().scan(text)
    assert (found.n_words, found.base) == base_by_hand(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), min_size=1, max_size=9), min_size=1, max_size=4), st.lists(st.sampled_from("abcd"), max_size=30))
def test_matching_statistics(sequences, text):
    seqs = [[c.encode() for c in s] for s in sequences]
    auto = ls.SuffixAutomaton(seqs, [])
    runs = {tuple(s[i:j]) for s in seqs for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    words = [c.encode() for c in text]
    got = {i: (n, s) for i, s, n in auto.statistics(words)}
    for i in range(len(words)):
        want = max((n for n in range(1, i + 2) if tuple(words[i - n + 1 : i + 1]) in runs), default=0)
        assert got.get(i, (0, 0))[0] == want
        if want:
            for t, end in auto.states[got[i][1]].at.items():
                assert seqs[t][end - want + 1 : end + 1] == words[i - want + 1 : i + 1]
            assert set(auto.states[got[i][1]].at) == {t for t, s in enumerate(seqs) if any(s[k : k + want] == words[i - want + 1 : i + 1] for k in range(len(s)))}


def test_templates_with_edits():
    rng = np.random.default_rng(2)
    scanner = ls.Scanner()
    for t, (label, text) in enumerate(ls.TEMPLATES):
        words = [w.decode() for w in ls.tokens(text.encode())]
        if len(words) > 30:
            for i in rng.choice(len(words), 2, replace=False):
                words[i] = "zzz"
        found = scanner.scan(("intro text here " + " ".join(words).title() + ". More words.").encode())
        hit = [s for s in found.spans if s.template == t and s.covered >= ls.ENOUGH]
        assert len(hit) == 1 and hit[0].label == label and hit[0].start >= 3 and hit[0].end <= 3 + len(words)
    assert not scanner.scan(b"the license of the software is a copy of the work to the rights").spans


def test_repeated_and_interleaved_texts():
    scanner = ls.Scanner()
    isc = [w.decode() for w in ls.tokens(ls.ISC.encode())]
    t = [label for label, _ in ls.TEMPLATES].index("isc")
    whole = lambda words: [s for s in scanner.scan(" ".join(words).encode()).spans if s.template == t and s.covered >= 0.9]
    assert [(s.start, s.end) for s in whole(isc * 2)] == [(0, len(isc)), (len(isc), 2 * len(isc))]
    assert len(whole(isc[:60] + ["x"] * 3 + isc[60:])) == 1
    # a copy that begins within another one's gap
    assert [s.covered >= 0.9 for s in whole(isc[:40] + ["x"] * 5 + isc[40:])] == [True]


def covered_by_hand(words, template):
    """Words of a template that a text holds in its order in runs of MIN, by the longest chain: a plain table over places."""
    best = 0
    n, m = len(words), len(template)
    run = np.zeros((n + 1, m + 1), int)
    for i in range(n):
        for j in range(m):
            run[i + 1, j + 1] = run[i, j] + 1 if words[i] == template[j] else 0
    chain = np.zeros((n + 1, m + 1), int)
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            chain[i, j] = max(chain[i - 1, j], chain[i, j - 1], max((chain[i - k, j - k] + k for k in range(ls.MIN, run[i, j] + 1)), default=0))
            best = max(best, chain[i, j])
    return best


def test_cover_equals_the_longest_chain():
    rng = np.random.default_rng(12)
    template = [f"t{i}" for i in range(60)]
    scanner = ls.Scanner(templates=(("t", " ".join(template)),), phrases=())
    for _ in range(60):
        words = list(template)
        for i in rng.choice(60, int(rng.integers(0, 8)), replace=False):
            words[i] = "x"
        words = ["n"] * 5 + [w for w in words if rng.random() > 0.02] + ["n"] * 5
        got = sum(round(s.covered * 60) for s in scanner.scan(" ".join(words).encode()).spans)
        assert got == covered_by_hand(words, template)


def test_words_across_pieces(monkeypatch):
    text = "Ab-c é日本x yz\x00w".encode() * 50 + b"end"
    want = ls.tokens(text)
    for piece in (1, 2, 7, 1 << 16):
        monkeypatch.setattr(ls, "PIECE", piece)
        assert list(ls.stream(text)) == want and list(ls.stream(b"")) == []


def test_whole_texts_from_a_folder(tmp_path):
    (tmp_path / "Some-1.0.txt").write_text("one two three four five six seven eight")
    assert ls.load(str(tmp_path)) == (("some-1.0", "one two three four five six seven eight"),)


def test_rows(spark):
    rows = [(1, None), (2, ""), (3, "Under the MIT License. under the mit license"), (3, "x"), (None, "cc by nc"), (4, "word " * 200_000 + "Apache License, Version 2.0")]
    got = {(r.doc_id, r.n_words): r for r in ls.scan(spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, labels string")).collect()}
    assert len(got) == 6
    assert (got[3, 8].n_base, got[3, 8].first_word, got[3, 8].last_word, got[3, 8].base_labels) == (2, 0, 4, "mit")
    assert got[1, 0].first_word is None and got[1, 0].labels == "" and got[1, 0].score == 0
    assert got[4, 200_005].first_word == 200_000 and got[4, 200_005].labels == "apache-2"
    assert ls.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
