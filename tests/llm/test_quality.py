import numpy as np
from packlane.llm import common, quality

GOOD = ["the quiet river ran along a green valley and people walked there slowly", "we made plain notes on the work and kept each page in order"]
BAD = ["BUY!! NOW!! BUY!! NOW!! BUY!! NOW!!", "spam spam spam spam $$$ %%% spam spam ###"]


def rows(n):
    rng = np.random.default_rng(3)
    out = []
    for i in range(n):
        good = i % 2
        base = (GOOD if good else BAD)[int(rng.integers(2))].split()
        out.append((i, " ".join(rng.choice(base, 30)), int(good)))
    return out


def test_held_out_accuracy_and_edge_rows(spark):
    data = rows(240)
    extra = [(1000, None), (1001, ""), (None, "the river"), (1002, "word " * 60_000), (5, data[5][1])]
    docs = spark.createDataFrame([(i, t, "x", 0.5) for i, t, _ in data] + [(i, t, "x", 0.5) for i, t in extra], "doc_id long, text string, source string, score double")
    labels = spark.createDataFrame([(i, q) for i, _, q in data] + [(1000, None), (None, 1), (7, 1)], "doc_id long, quality int")
    model = quality.learn(docs, labels)
    got = quality.score(docs, model).collect()
    assert len(got) == 245 and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got}
    held = [(i, q) for i, _, q in data if common.id_crc_py(i) % 4 == 2]
    assert len(held) > 30 and np.mean([(by[i] >= quality.THRESHOLD) == q for i, q in held]) > 0.95
    assert by[1000] == by[1001]
    kept = quality.accept(docs, model, 0.7)
    assert kept.columns == docs.columns and kept.count() == sum(r.score >= 0.7 for r in got)


def test_the_boundary_is_accepted(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    model = quality.Model(prior=quality.THRESHOLD)
    assert quality.accept(docs, model, quality.THRESHOLD).count() == 1 and quality.accept(docs, model, quality.THRESHOLD + 1e-9).count() == 0


def test_a_sample_is_the_same_each_time(spark):
    df = spark.range(5000).select(common.F.col("id").alias("doc_id"), (common.F.col("id") % 7).alias("x")).repartition(5).unionByName(spark.range(3000).selectExpr("1 AS doc_id", "id AS x"))
    once, again = ({tuple(r) for r in common.bounded_sample(x, 100, "s").collect()} for x in (df, df.repartition(3)))
    assert once == again and 0 < len(once) <= 100


def test_plain_network():
    """Scores equal a network written out by hand."""
    model = quality.fit([t.encode() for _, t, _ in rows(120)], np.array([q for *_, q in rows(120)]))
    x = quality.Reader().features([b"the quiet river", b"", b"BUY!! NOW!!"], model.vectors)
    for row, got in zip(x, model.scores(x)):
        z = [(v - m) / s for v, m, s in zip(row, model.mean, model.scale)]
        h = [max(0.0, sum(a * w for a, w in zip(z, column)) + b) for column, b in zip(model.w1.T, model.b1)]
        assert abs(1 / (1 + np.exp(-(sum(a * w for a, w in zip(h, model.w2)) + model.b2) / model.temperature)) - got) < 1e-4


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in quality.score(docs, quality.learn(docs, none)).collect()] == [0.5]
    assert quality.score(docs.limit(0), quality.learn(docs.limit(0), none)).count() == 0


def test_word_vectors_by_hand():
    reader = quality.Reader()
    batch = [b"a b c a", b"b"]
    got, index = quality.word_vectors(batch, reader), quality.index_vectors()
    row = {w: int(quality.row_ids(reader.hash([w]))[0]) for w in (b"a", b"b", b"c")}
    sums = {w: np.zeros(quality.WIDTH) for w in row}
    tokens = batch[0].split()
    for i, w in enumerate(tokens):
        for j, x in enumerate(tokens):
            if i != j and abs(i - j) <= quality.AROUND:
                sums[w] += index[row[x]]
    for w, v in sums.items():
        assert np.allclose(got[row[w]], v / np.linalg.norm(v), atol=1e-5)


def test_calibration_lowers_log_loss():
    rng = np.random.default_rng(0)
    batch = [t.encode() for _, t, _ in rows(300)]
    labels = np.array([q if rng.random() > 0.2 else 1 - q for *_, q in rows(300)])
    model = quality.fit(batch, labels)
    reader, aside = quality.Reader(), np.arange(300) % 6 == 5
    x, y = reader.features(batch, model.vectors)[aside], labels[aside]

    def loss(t):
        z = model.logits(x) / t
        return np.logaddexp(0, -np.where(y == 1, z, -z)).mean()

    assert loss(model.temperature) <= loss(1.0) + 1e-3


def test_tables_do_not_pass_the_drivers_heap(spark, monkeypatch):
    given = rows(60)
    docs = spark.createDataFrame([(i, t) for i, (_, t, _) in enumerate(given)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, (*_, q) in enumerate(given)], "doc_id long, quality int")
    sizes, collect = [], type(docs).collect

    def counted(self):
        out = collect(self)
        sizes.append(sum(len(x) for r in out for x in r if isinstance(x, (bytes, bytearray, str))))
        return out

    monkeypatch.setattr(type(docs), "collect", counted)
    model = quality.learn(docs, labels, aside=(1, 1))
    assert sizes and max(sizes) < 1_000_000
    want = quality.word_vectors([t.encode() for _, t, _ in given], quality.Reader())
    assert np.array_equal(model.vectors, want)
