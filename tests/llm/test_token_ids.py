import io

import numpy as np
import pytest
from packlane.llm import token_ids
from tokenizers import Tokenizer

TEXTS = [
    "Plain words, and more words.", "", None, "  \t\n ", "it's DON'T we'll x'y 'tis '", "É è Ünïcode straße ΣΑΣ İstanbul école", "a<|endoftext|>b <|startoftext|>",
    "12 3.5 a1b2 $$$ !!!??? a_b-c", "école, été... ñandú!? é's é<| ça|> Éa' naïve-té über(ö) ß. é_ e\u0301a, ŉ", "tab\x0bvt\x0cff\x1cfs\x85nel\xa0nbsp em", "日本語 テキスト 한국어", "😀 emoji👍🏽 mix😀ed", "\x00nul\x01 \x7f", "ǅ Ǆ ªº ʰ", "ﬁ ligature ½ ² Ⅷ", "long " * 5000,
]


def test_pieces_equal_whole_texts():
    e, t = token_ids.Encoder(token_ids.default_tokenizer()), Tokenizer.from_file(token_ids.default_tokenizer())
    for x in TEXTS:
        assert np.frombuffer(e((x or "").encode()), "<u4").tolist() == t.encode(x or "", add_special_tokens=False).ids, x


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_any_tokenizer_equals_the_library(name):
    import public_tokenizers

    path = public_tokenizers.path(name)
    e, t = token_ids.Encoder(path), Tokenizer.from_file(path)
    assert e.whole == (name != token_ids.VOCABULARY)
    for x in TEXTS:
        assert np.frombuffer(e((x or "").encode()), "<u4").tolist() == t.encode(x or "", add_special_tokens=False).ids, x


def test_rows_without_ids_are_cut_into_shards(spark, monkeypatch):
    monkeypatch.setattr(token_ids, "SHARD", 300)
    df = spark.createDataFrame([(None, f"word {i % 3}") for i in range(600)], "doc_id long, text string").repartition(4)
    uri, shards = token_ids.write(df)
    held = [r.docs for r in shards.collect()]
    assert len(held) >= 5 and max(held) < 300 and sum(held) == 600
    got = sorted(token_ids.read(uri, shards).collect(), key=lambda r: r.start)
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got[:-1])]).tolist()


def test_code_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        ranks = (rng.integers(0, 1 << 32, n, dtype=np.uint64) >> rng.integers(0, 32, n).astype(np.uint64)).astype(np.uint32)
        assert token_ids.decode_ranks(*token_ids.encode_ranks(ranks), n).tolist() == ranks.tolist()


def test_shard_round_trip(monkeypatch):
    monkeypatch.setattr(token_ids, "BLOCK", 5)
    out = io.BytesIO()
    w = token_ids.ShardWriter(out, np.array([70000, 2, 9]))
    docs = [(-5, [2]), (None, [70000, 9, 9, 9, 2]), (1 << 40, [9, 2]), (7, [2])]
    for d, ids in docs:
        w.add(d, np.array(ids, np.uint32))
    w.flush()
    assert [(d, i.tolist()) for d, i in token_ids.read_shard(io.BytesIO(out.getvalue()))] == docs


def test_operator_equals_plain_encoding(spark, monkeypatch):
    rows = [(i * 7 % 40, x) for i, x in enumerate(TEXTS)] + [(3, "again"), (3, "again"), (None, "no id")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, start long").repartition(3)
    monkeypatch.setattr(token_ids, "SHARD", 2000)
    got = token_ids.read(*token_ids.write(df)).collect()
    t = Tokenizer.from_file(token_ids.default_tokenizer())
    want = sorted(((-1 if d is None else d), [*t.encode(x or "", add_special_tokens=False).ids, 2]) for d, x in rows)
    mine = sorted(got, key=lambda r: r.start)
    assert sorted((-1 if r.doc_id is None else r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in got) == want
    at = 0
    for r, (d, _) in zip(mine, want):
        assert r.start == at and (-1 if r.doc_id is None else r.doc_id) == d
        at += r.n_tokens


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert token_ids.read(*token_ids.write(df)).count() == 0


def test_ranks_follow_all_counts(spark, monkeypatch):
    """Every task's counts reach the ranks: the ids of a shard's head are by frequency over all documents."""
    texts = ["the cat the cat the", None, "", "the dog", "zebra " * 50, "dog dog"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    uri, shards = token_ids.write(docs)
    where, path = token_ids.common.open_fs(uri)
    name = shards.first()["name"]
    with where.open_input_stream(f"{path}/{name}") as f:
        _, _, n = token_ids.struct.unpack("<4sII", f.read(12))
        ranks = np.frombuffer(f.read(4 * n), "<u4").tolist()
    seen = {}
    for t in texts:
        for x in [*Tokenizer.from_file(token_ids.default_tokenizer()).encode(t or "", add_special_tokens=False).ids, token_ids.END]:
            seen[x] = seen.get(x, 0) + 1
    assert ranks == sorted(seen, key=lambda x: (-seen[x], x))
