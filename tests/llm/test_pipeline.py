"""Each stage of the pipeline against a plain version of what it must keep."""

import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from packlane.llm import common, mixing, quality, token_ids
from tokenizers import Tokenizer

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return re.findall(r"[^ \t-\r]+", (text or "").lower())


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = np.random.default_rng(21)
    vocab = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(900)]
    bench = [(i, " ".join(rng.choice(vocab, 25))) for i in range(5)]
    docs, labels = [], []
    for i in range(240):
        good = i % 4 != 0
        w = list(rng.choice(vocab, int(rng.integers(40, 120))))
        if not good:
            w = [x.upper() + "!!" for x in rng.choice(w[:6], len(w))]
        elif i % 23 == 1:
            w[10:10] = bench[i % 5][1].split()
        docs.append((i, " ".join(w), "en", f"src{i % 5}" if i % 3 else "hot", len(w)))
        labels.append((i, int(good), 0))
    docs += [(300 + i, docs[i][1], "en", "hot", 1) for i in (1, 1, 2, 5, 6)]
    docs += [(400 + i, docs[i][1] + " tail", None, None, None) for i in (9, 10, 13)]
    docs += [(500, None, None, None, None), (None, docs[7][1] + " other ending here now", "en", "hot", 3)]
    path = str(tmp_path_factory.mktemp("tables"))
    for name, rows, schema in (("documents", docs, COLUMNS), ("benchmark", bench, "item_id long, text string"), ("labels", labels, "doc_id long, quality int, toxic int")):
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return path, bench


def test_stages(spark, tables):
    path, bench = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    before = [tuple(r) for r in docs.collect()]
    made = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, path)
        out.write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
        made.append([tuple(r) for r in docs.collect()])
        if name != "token_ids":
            assert docs.columns == [x.split()[0] for x in COLUMNS.split(", ")]
    good, unique, clean, mix, ids = made

    model = quality.learn(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet"))
    reader = quality.Reader()
    score = lambda t: model.scores(reader.features([(t or "").encode()], model.vectors))[0]
    assert sorted(map(repr, good)) == sorted(repr(r) for r in before if score(r[1]) >= quality.THRESHOLD)
    assert {r[0] for r in good if r[0] is not None and r[0] < 240} >= {i for i in range(240) if i % 4}

    sets, group = [shingles(r[1]) for r in good], list(range(len(good)))
    for i in range(len(good)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and None not in (good[i][0], good[j][0]) and 100 * len(a & b) >= corpus_pipeline.PERCENT * len(a | b):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    best = {}
    for g, r in zip(group, good):
        best[g] = min(best.get(g, r), r, key=lambda x: (x[0] is None, x[0] or 0))
    assert sorted(map(repr, unique)) == sorted(map(repr, best.values()))
    assert len(unique) < len(good)

    holds = lambda t: any(f" {b.lower()} " in f" {' '.join(words(t))} " for _, b in bench)
    assert sorted(map(repr, clean)) == sorted(repr(r) for r in unique if not holds(r[1])) and len(clean) < len(unique)

    copies = Counter(map(repr, mix))
    want = {(r.doc_id, r.source): r.copies for r in mixing.take(spark.createDataFrame(clean, COLUMNS)).collect()}
    assert copies == Counter({repr(r): want[r[0], r[3]] for r in clean if want[r[0], r[3]]})

    t, at = Tokenizer.from_file(token_ids.default_tokenizer()), 0
    order = sorted(((r[0] is not None, r[0] or 0, r[1] or "") for r in mix))
    for (has, d, text), got in zip(order, sorted(ids, key=lambda r: r[1]), strict=True):
        x = [*t.encode(text, add_special_tokens=False).ids, 2]
        assert got == (d if has else None, at, len(x), zlib.crc32(np.array(x, "<u4").tobytes()))
        at += len(x)

    whole = sorted(map(repr, (tuple(r) for r in corpus_pipeline.run(spark, path).collect())))
    assert whole == sorted(map(repr, ids))


def test_driver_memory_is_trimmed(spark, tables, monkeypatch):
    assert common.trim(spark)
    seen = []
    monkeypatch.setattr(common, "trim", lambda s: seen.append(s))
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet")
    dict(corpus_pipeline.STAGES)["decontaminate"](spark, docs, tables[0])
    assert seen == [spark]


def test_trim_is_optional():
    assert common.trim(None) is False
