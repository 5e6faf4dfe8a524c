import numpy as np
import pytest
from packlane.llm import common, language

WORDS = {"aa": "wind stone harbour quickly thought right should knight", "bb": "être maison déjà aujourd vouloir français garçon", "cc": "schön straße wirklich zwischen können müssen gehört"}


def text(lang, n, seed):
    return " ".join(np.random.default_rng(seed).choice(WORDS[lang].split(), n))


@pytest.fixture(scope="module")
def rows():
    return [(i, text(lang, 5 + i % 60, i), lang) for i, lang in enumerate(list(WORDS) * 60)]


def test_held_out_accuracy_and_edges(spark, rows):
    odd = [(900, None, "aa"), (901, "", None), (902, "123 -- !!", "bb"), (903, "a", None), (None, "wind stone", "aa"), (904, "日本", None), (3, rows[3][1], "aa"), (905, "schön " * 50_000, None)]
    df = spark.createDataFrame([(*r, 1.0) for r in rows + odd], "doc_id long, text string, lang string, score double")
    got = language.predict(df, language.learn(df)).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r.doc_id: r for r in got}
    held = [r for r in rows if common.id_crc_py(r[0]) % 4 == 2]
    assert np.mean([by[i].lang_pred == lang for i, _, lang in held]) > 0.98
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (900, 901, 902))
    assert by[903].lang_pred in WORDS and by[904].lang_pred in WORDS and by[905].lang_pred == "cc"
    assert all(0 <= r.score <= 1 for r in got)


def test_mixed_text_gets_both_languages(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learn(df)
    mixed = spark.createDataFrame([(1, text("aa", 150, 1) + " " + text("cc", 50, 2)), (2, text("bb", 200, 3))], "doc_id long, text string")
    both, one = sorted(language.predict(mixed, model).collect(), key=lambda r: r.doc_id)
    assert set(both.shares) == {"aa", "cc"} and 0.6 < both.shares["aa"] < 0.9 and both.lang_pred == "aa"
    assert one.shares == {"bb": 1.0}


def test_em_raises_the_likelihood():
    rng = np.random.default_rng(5)
    spans = [rng.normal(-30, 3, (40, 3)).astype(np.float32)]
    theta, total = language.mixture(spans)
    assert np.isclose(theta.sum(), 1)
    flat = np.log(np.exp(spans[0].astype(float)).mean(axis=1)).sum()
    single = spans[0].sum(axis=0).max()
    assert total[0] >= max(flat, single) - 1e-6


def test_sets_of_many_languages():
    """Every set size can be chosen, and the choice is that of plain EM over all sets along the order."""
    rng = np.random.default_rng(8)
    k, spans = 9, []
    for n in (1, 2, 5, 8, 9):
        s = np.full((40 * n, k), -60.0) + rng.normal(0, 1, (40 * n, k))
        for i in range(40 * n):
            s[i, i % n] = -20
        spans.append(s)
    chosen = language.infer(spans)
    assert [(c > 0.01).sum() for c in chosen] == [1, 2, 5, 8, 9]
    for s, c in zip(spans, chosen):
        order = np.argsort(-language.mixture([s])[0][0], kind="stable")
        costs = []
        for size in range(1, k + 1):
            like, theta = np.exp(s[:, order[:size]] + 20), np.full(size, 1 / size)
            for _ in range(language.ROUNDS):
                r = like * theta
                theta = (r / r.sum(axis=1, keepdims=True)).mean(axis=0)
            total = np.log((like * theta).sum(axis=1)).sum() - 20 * len(s)
            costs.append(total - 0.5 * (size - 1) * np.log(len(s)) - 3 * (size - 1))
        assert set(np.flatnonzero(c > 0)) == set(order[: int(np.argmax(costs)) + 1])


def test_long_texts_in_pieces(monkeypatch):
    text = "schön être wind 12 ".encode() * 400
    model = language.Model(["a", "b"], np.random.default_rng(1).normal(-5, 1, (language.BINS, 2)).astype(np.float32))
    whole = model.spans(text)
    monkeypatch.setattr(language, "PIECE", 101)
    assert np.allclose(model.spans(text), whole, atol=1e-3) and len(whole) == -(-len(language.grams(text)) // language.SPAN)


def test_ties_go_to_the_first_language():
    spans = [np.full((10, 3), -7.0)]
    assert language.infer(spans).argmax() == 0


def test_no_labels_and_no_rows(spark):
    df = spark.createDataFrame([(1, "words", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in language.predict(df, language.learn(df)).collect()] == ["und"]
    assert language.predict(df.limit(0), language.learn(df)).count() == 0
