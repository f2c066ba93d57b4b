import zlib

import numpy as np
from pyspark.sql import functions as F

from veilspark.llm import toxicity as X


def corpus(rng, n):
    clean = [f"{a}{b}" for a in ("ba", "lo", "mi", "ter", "un") for b in ("rel", "da", "xo", "nim")]
    bad = ["vrax", "Vraxen", "vraxol", "grump"]
    texts, labels = [], []
    for i in range(n):
        words = list(rng.choice(clean, int(rng.integers(5, 200))))
        if i % 3 == 0:
            for _ in range(2):
                words[int(rng.integers(len(words)))] = str(rng.choice(bad))
        texts.append(" ".join(words) + ".")
        labels.append(int(i % 3 == 0))
    return texts, labels


def test_gradients():
    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in X._first_weights(3, 4, 3, 2).items()}
    x = rng.standard_normal((6, 4))
    ids = rng.integers(0, 6, (5, 3))
    mask = np.array([[1, 1, 1], [1, 1, 1], [1, 1, 0], [1, 1, 0], [1, 0, 0]], float)
    goal = rng.standard_normal(3)

    def loss(at=x):
        return float((X._forward(w, at @ w["inner"] + w["shift"], ids, mask) * goal).sum())

    keep = {}
    X._forward(w, x @ w["inner"] + w["shift"], ids, mask, keep)
    grads, d_x = X._gradients(w, keep, ids, mask, x, goal)
    for name, g in grads.items():
        for _ in range(4):
            at = tuple(int(rng.integers(s)) for s in w[name].shape)
            w[name][at] += 1e-3
            up = loss()
            w[name][at] -= 2e-3
            down = loss()
            w[name][at] += 1e-3
            assert abs((up - down) / 2e-3 - g[at]) < 2e-3, name
    other = x.copy()
    other[2, 1] += 1e-3
    low = x.copy()
    low[2, 1] -= 1e-3
    assert abs((loss(other) - loss(low)) / 2e-3 - d_x[2, 1]) < 2e-3


def test_windows_cover_every_word():
    sizes = np.array([0, 1, 8, 9, 12, 13, 100, 5])
    laid, mask, of = X._laid(sizes, 8, 4)
    begin = np.cumsum(sizes) - sizes
    for i, n in enumerate(sizes):
        seen = laid[:, of == i]
        assert set(seen[seen >= 0] - begin[i]) == set(range(n)) and (of == i).sum() == max(1, 1 + max(0, -(-(n - 8) // 4)))
    assert ((laid >= 0) == (mask > 0)).all()


def test_learns_words_and_their_parts():
    rng = np.random.default_rng(1)
    model = X.fit(*corpus(rng, 300))
    texts, labels = corpus(rng, 200)
    found = X.Scorer(model).scores([*texts, "bada loda vraxis", "VRAX!", "", None, "...", "bada loda unnim"])
    y = np.array(labels)
    assert ((found[:200] >= 0.7) == (y == 1)).mean() > 0.97
    assert found[200] > found[205] + 0.3 and found[201] > 0.7
    assert len(set(found[202:205])) == 1 and found[202] < 0.5
    assert ((0 <= found) & (found <= 1)).all()


def test_very_long_text_counts_whole(monkeypatch):
    rng = np.random.default_rng(1)
    model = X.fit(*corpus(rng, 300))
    clean = "bada loxo unnim tereda " * 60_000
    low, high = X.Scorer(model).scores([clean, clean + " vrax grump"])
    assert low < 0.5 < 0.7 < high


def test_long_runs_are_read_whole():
    rng = np.random.default_rng(1)
    model = X.fit(*corpus(rng, 300))
    run = "badaloxounnimtereda" * 12
    low, high = X.Scorer(model).scores([run, run + "vraxol" * 12 + run])
    assert low < 0.5 < 0.7 < high
    text = "".join(chr(0x4E00 + i) for i in range(1000))
    for size in (1 << 20, 100, 7):
        pieces = [w for part in X.words_of(text, size) for w in part]
        assert max(map(len, pieces)) <= 64
        assert all(any(text[k : k + 20] in w for w in pieces) for k in range(981))
    assert list(X.words_of("a" * 64 + " " + "b" * 65)) == [["a" * 64, "b" * 64, "b" * 33]]


def test_table(spark):
    rng = np.random.default_rng(2)
    texts, labels = corpus(rng, 240)
    rows = list(zip(range(240), texts, ["x"] * 240)) + [(None, texts[0], "y"), (500, None, None), (501, "", "z"), (3, texts[3], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    marks = [(i, y) for i, y in enumerate(labels)] + [(0, 0), (0, None), (None, 1), (9999, 1)]
    model = X.train(docs, spark.createDataFrame(marks, "doc_id long, toxic int"))
    out = X.score(docs, model)
    assert out.columns == ["doc_id", "text", "score"] and out.count() == 244
    got = {r.doc_id: r.score for r in out.collect()}
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(got[i] >= 0.7) == (labels[i] == 1) for i in held]) > 0.95
    assert got[500] == got[501]
    flags = {r.doc_id: r.k for r in docs.select("doc_id", X.learned_on(F.col("doc_id")).alias("k")).collect()}
    assert all(flags[i] == (zlib.crc32(str(i).encode()) % 3 != 1) for i in range(240))


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in X.score(docs, X.train(docs, none)).collect()] == [0.0, 0.0]
    one = spark.createDataFrame([(i, 1) for i in range(9)], "doc_id long, toxic int")
    assert {r.score for r in X.score(docs, X.train(docs, one)).collect()} <= {0.0, 1.0}
    assert X.score(docs.limit(0), X.train(docs.limit(0), none)).collect() == []
