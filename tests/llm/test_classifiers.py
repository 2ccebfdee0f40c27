import random
import zlib

import numpy as np
import pytest

from driftwell.llm import quality_model, toxicity


def auc(y, s):
    r = np.argsort(np.argsort(s)) + 1
    n = y.sum()
    return (r[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(9)
    w = lambda: "".join(rng.choice("abcdefghijk") for _ in range(rng.randint(2, 7)))
    docs, labels = [], []
    for i in range(1500):
        t = [w() for _ in range(rng.randint(5, 60))]
        toxic, good = i % 4 == 0, i % 3 != 0
        if not good:
            t = [t[0]] * 6 + t[:4] + ["###", "$$$"]
        if toxic:
            for _ in range(2):
                t.insert(rng.randrange(len(t)), "zlim" + w())
        docs.append((i, " ".join(t), ["en", "de", None][i % 3], 0.5))
        labels.append((i, int(good), int(toxic)))
    docs += [(5000, None, "en", 1.0), (5001, "", None, 1.0), (None, "some words", "en", 1.0), (3, docs[3][1], "en", 1.0)]
    labels += [(None, 1, 1), (5, None, None), (3, labels[3][1], labels[3][2])]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), len(docs)


@pytest.mark.parametrize("module,label,least", [(quality_model, "quality", 0.97), (toxicity, "toxic", 0.97)])
def test_held_out(corpus, module, label, least):
    docs, labels, n = corpus
    got = module.scores(docs, labels, label).collect()
    assert len(got) == n and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    known = {r.doc_id: r[label] for r in labels.where(f"{label} IS NOT NULL AND doc_id IS NOT NULL").collect()}
    pairs = [(known[r.doc_id], r.score) for r in got if r.held_out and r.doc_id in known]
    assert auc(np.array([y for y, _ in pairs]), np.array([s for _, s in pairs])) > least


@pytest.mark.parametrize("module,label", [(quality_model, "quality"), (toxicity, "toxic")])
def test_without_labels_or_rows(spark, corpus, module, label):
    docs, labels, n = corpus
    assert module.scores(docs, labels.limit(0), label).count() == n
    assert module.scores(docs.limit(0), labels, label).count() == 0


def test_blocks_of_long_texts_equal_the_whole(monkeypatch):
    rng = random.Random(3)
    texts = [[rng.choice([b"ab", b"cd", b"zz1", b"efg"]) for _ in range(n)] for n in (0, 1, 2, 50, 7, 333)]
    net = toxicity.train([t for t in texts if t] * 8, np.array([0, 1, 0, 1, 0] * 8))
    whole = net.pooled(texts)
    monkeypatch.setattr(toxicity, "BLOCK", 10)
    assert np.allclose(net.pooled(texts), whole, atol=1e-5)


def test_isotonic():
    assert quality_model.isotonic(np.array([1.0, 1, 2, 1]), np.array([0.0, 1, 0, 1])).tolist() == pytest.approx([0, 1 / 3, 1 / 3, 1])


def test_pooled_values_by_hand():
    """Each filter at each position, with loops over slots and dimensions; positions beyond the end are zero."""
    rng = random.Random(5)
    texts = [[rng.choice([b"ab", b"cd", b"zz1", b"efg", b"q"]) for _ in range(n)] for n in (1, 2, 9, 30)]
    net = toxicity.train(texts * 10, np.array([0, 1, 1, 0] * 10))
    got = net.pooled([[], *texts])
    assert not got[0].any()
    for text, row in zip(texts, got[1:], strict=True):
        vectors = [net.vectors(toxicity.hashed([w]))[0].astype(float) for w in text]
        best, slot = [], 0
        for width in toxicity.WIDTHS:
            filters = [net.filters[slot + k].astype(float) for k in range(width)]
            slot += width
            values = [sum(vectors[p + k] @ filters[k] for k in range(width) if p + k < len(text)) for p in range(len(text))]
            best.append(np.max(values, axis=0))
        want = np.maximum(np.concatenate(best) + net.bias, 0)
        assert np.allclose(row, want, atol=1e-4)
        assert net.logit(row[None])[0] == pytest.approx(sum(a * b for a, b in zip(want, net.out[:-1], strict=True)) + net.out[-1], abs=1e-3)


def test_platt_is_at_the_minimum():
    logits, n, ones = np.linspace(-3, 3, 13), np.full(13, 20.0), np.array([0, 1, 0, 2, 4, 5, 9, 12, 15, 17, 18, 20, 20.0])
    a, b = toxicity.platt(logits, ones, n)

    def loss(a, b):
        p = 1 / (1 + np.exp(-(a * logits + b)))
        return -(ones * np.log(p) + (n - ones) * np.log(1 - p)).sum() + 5e-4 * ((a - 1) ** 2 + b**2)

    for da, db in ((1e-3, 0), (-1e-3, 0), (0, 1e-3), (0, -1e-3)):
        assert loss(a + da, b + db) > loss(a, b)


def test_thresholds_by_trying_all(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["en", "de", None]), rng.random(), rng.randint(0, 1)) for _ in range(400)]
    rows = [(lang, score, int(y and score > 0.3)) for lang, score, y in rows] + [("fr", 0.5, 0)]
    got = {r.lang: r.threshold for r in toxicity.thresholds(spark.createDataFrame(rows, "lang string, score double, y int")).collect()}
    assert set(got) == {"en", "de", None}  # none is toxic in fr
    for lang, threshold in got.items():
        mine = [(s, y) for x, s, y in rows if x == lang]

        def f1(t):
            called = [y for s, y in mine if s >= t]
            return 2 * sum(called) / (len(called) + sum(y for _, y in mine))

        assert f1(threshold) == pytest.approx(max(f1(k / toxicity.BINS) for k in range(toxicity.BINS)))


def test_normal_equations_by_numpy(spark, corpus):
    docs, labels, _ = corpus
    known = quality_model.measured(docs)
    model = quality_model.fit(known, labels)
    marks = {r.doc_id: r.quality for r in labels.collect() if r.doc_id is not None and r.quality is not None}
    rows = [(r.x, marks[r.doc_id], zlib.crc32(str(r.doc_id).encode()) % 3) for r in known.collect() if r.doc_id in marks]
    twice = [(r.x, marks[3], zlib.crc32(b"3") % 3) for r in known.where("doc_id = 3").collect()]  # its label stands there twice
    train = [(x, y) for x, y, fold in rows + twice if fold == 0]
    x, y = np.array([t[0] for t in train]), np.array([t[1] for t in train], float)
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.std, np.where(x.std(0) > 1e-9, x.std(0), 1))
    z = model.features(x)
    beta = np.linalg.solve(z.T @ z + quality_model.RIDGE * len(x) / quality_model.FEATURES * np.eye(z.shape[1]), z.T @ y)
    assert np.allclose(model.features(x) @ beta, model.features(x) @ model.beta, atol=1e-6)
    calibrating = [(t, v) for t, v, fold in rows + twice if fold == 2]
    raw = model.ridge(np.array([t for t, _ in calibrating]))
    bins = np.minimum((raw + 0.5) / 2 * quality_model.BINS, quality_model.BINS - 1).astype(int)
    kinds = np.unique(bins)
    counts, ones = np.array([(bins == k).sum() for k in kinds], float), np.array([sum(v for b, (_, v) in zip(bins, calibrating, strict=True) if b == k) for k in kinds], float)
    assert np.allclose(model.knots, (kinds + 0.5) / quality_model.BINS * 2 - 0.5) and np.allclose(model.values, quality_model.isotonic(counts, ones))


@pytest.mark.parametrize("module,label", [(quality_model, "quality"), (toxicity, "toxic")])
def test_a_very_long_text(spark, corpus, module, label):
    docs, labels, n = corpus
    long = spark.range(1).selectExpr("9000L AS doc_id", "repeat('word and zlimabc then more ', 60000) AS text", "'en' AS lang", "0.5d AS score")
    got = module.scores(docs.unionByName(long), labels, label)
    assert got.count() == n + 1 and 0 <= got.where("doc_id = 9000").first().score <= 1
