import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspark.llm import lm as M
from veilspark.llm import queries


def tokens_of(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", lower)]


def some_weights(seed=0):
    rng = np.random.default_rng(seed)
    w = M.first_weights(rng.integers(0, 50, M.CLASSES * M.MEMBERS).astype(float), seed)
    for k in ("class", "member", "input"):
        w[k] = w[k] * 8
    return w


def plain_logs(w, ids):
    """Log-probability of each token, one step after the other."""
    h, before, out = np.zeros(M.UNITS), 0, []
    u = M.UNITS
    for token in ids:
        x = w["input"][before].astype(float)
        zr = np.clip(0.25 * (h @ w["state"][:, : 2 * u] + x[: 2 * u]) + 0.5, 0, 1)
        new = (zr[u:] * h) @ w["state"][:, 2 * u :] + x[2 * u :]
        new = new / (1 + np.abs(new))
        h = h + zr[:u] * (new - h)
        c = h @ w["class"] + w["class_bias"]
        m = h @ w["member"][token >> 6] + w["member_bias"][token >> 6]
        out.append(c[token >> 6] - np.logaddexp.reduce(c) + m[token & 63] - np.logaddexp.reduce(m))
        before = token
    return out


def test_state_is_carried_through_whole_documents():
    w, rng = some_weights(), np.random.default_rng(1)
    docs = [np.append(rng.integers(1, 4096, n), 0) for n in (0, 1, 5, 40, 333, 64, 63, 2)]
    want = [sum(plain_logs(w, d)) for d in docs]
    for steps in (7, 64, 1000):
        assert np.allclose(M.score_docs(w, docs, steps), want, rtol=1e-4)


def test_probabilities_of_all_next_tokens_add_up():
    w = some_weights()
    heads = [np.array([*([5, 900, 77]), t]) for t in range(4096)]
    last = np.array([plain_logs(w, d)[-1] for d in heads[::1]][:4096])
    assert abs(np.exp(last).sum() - 1) < 1e-3


def test_gradients():
    w = {k: v.astype(np.float64) for k, v in some_weights(3).items()}
    rng = np.random.default_rng(2)
    docs = [np.append(rng.integers(1, 4096, n), 0) for n in (3, 5, 2)]
    (ids, fresh, goals, real, _) = next(iter(M.Lanes(docs, 2).windows(50)))

    def loss(w):
        states, _ = M._run(w, ids, fresh, np.zeros((ids.shape[1], M.UNITS)))
        at = np.flatnonzero(real.ravel())
        return -M.token_logs(w, states.reshape(-1, M.UNITS)[at], goals.ravel()[at]).sum() / len(at)

    after = {k: v.copy() for k, v in w.items()}
    sums = {"input": np.zeros_like(w["input"]), "dense": np.zeros_like(M._like(w)[0])}
    with np.errstate(all="ignore"):
        M._descend(after, sums, ids, fresh, goals, real, np.zeros((ids.shape[1], M.UNITS), np.float32), 0.0)
    squares, at = {"input": sums["input"]}, 0
    for name in M._DENSE:
        squares[name] = sums["dense"][at : at + w[name].size]
        at += w[name].size
    for name in w:
        flat = squares[name].ravel()
        for at in np.argsort(-flat)[[0, 1, 5, 9]]:
            other = {k: v.copy() for k, v in w.items()}
            other[name].ravel()[at] += 1e-3
            up = loss(other)
            other[name].ravel()[at] -= 2e-3
            assert abs(abs(up - loss(other)) / 2e-3 - flat[at] ** 0.5) < 0.02 * flat[at] ** 0.5 + 1e-4, name


def rows_for(rng, n):
    zipf = [f"{a}{b}" for a in ("the", "of", "Ver", "é", "x-", "q") for b in ("", "a", "bo", "cid", ",")]
    rows = []
    for i in range(n):
        words = list(rng.choice(zipf, int(rng.integers(0, 60)))) + [f"own{i}"] * (i % 3) + ["z" * 70] * (i % 2)
        rows.append((i, "\n".join(words) if i % 2 else " ".join(words)))
    return rows + [rows[3], rows[3], (None, "the of q"), (900, None), (901, ""), (902, "\t \x0b"), (903, "NEVER-seen never-seen")]


@pytest.mark.parametrize("head", [300_000, 9, 0])
def test_counts_and_base(spark, head, monkeypatch):
    monkeypatch.setattr(M, "_DISTINCT", 20)
    rows = rows_for(np.random.default_rng(3), 150)
    docs = spark.createDataFrame([(*r, b"w", 1) for r in rows], "doc_id long, text string, word binary, c int").repartition(4)
    teach = [t for d, t in rows if d is not None and zlib.crc32(str(d).encode()) % 5 != 1]
    c = Counter(w for t in teach for w in tokens_of(t))
    total, distinct = sum(c.values()) + len(teach), len(c) + 1
    got = {}
    for r in M.score(docs, head=head, first_docs=5).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(rows) and len(got[3]) == 3
    for doc, text in rows:
        r, words = got[doc][0], tokens_of(text)
        base = sum(np.log10((c[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in words) + np.log10((len(teach) + 0.5) / (total + 0.5 * (distinct + 1)))
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words) + 1, sum(c[w] > 0 for w in words) + 1, total)
        assert abs(r.base_score - base) < 1e-6 and r.score < 0 and np.isfinite(r.score)
    assert len({round(r.score, 6) for r in got[900] + got[901] + got[902]}) == 1


def test_words_of_a_group_share_its_probability(spark):
    rows = rows_for(np.random.default_rng(3), 60)
    docs = spark.createDataFrame(rows, "doc_id long, text string").select(F.col("text").cast("binary").alias("text"))
    counts = M.count_words(docs, 10)
    c = Counter(w for _, t in rows for w in tokens_of(t))
    vocabulary = set(counts.words[: M._WORDS])
    for g in {M.group_of(w) for w in c}:
        own = [n for w, n in c.items() if M.group_of(w) == g and w not in vocabulary]
        assert abs(sum((n + 0.5) / 10 ** counts.groups[g] for n in own) + 0.5 / 10 ** counts.groups[g] - 1) < 1e-9


def test_training_descends_over_every_document(spark, monkeypatch):
    docs = spark.createDataFrame(rows_for(np.random.default_rng(4), 200), "doc_id long, text string").repartition(4)
    docs = docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.lit(True).alias("teaches"))
    counts, averaged, seen = M.count_words(docs, 100), M._averaged, []

    def spy(parts, tasks):
        seen.append(parts.where("chunk = 0").agg({"tokens": "sum"}).first()[0])
        return averaged(parts, tasks)

    monkeypatch.setattr(M, "_averaged", spy)
    M.train(M.read_documents(docs, counts), counts, first_docs=5)
    assert seen == [counts.tokens]


def test_long_documents_go_on_beside_the_next_batch(monkeypatch):
    rng = np.random.default_rng(6)
    docs = [np.append(rng.integers(1, 4096, n), 0).astype(np.int16) for n in (500, 3, 40, 7, 300, 2, 5, 9, 1, 30)]
    inputs, descend = [], M._descend

    def spy(w, sums, ids, fresh, goals, real, h, *rest):
        out = descend(w, sums, ids, fresh, goals, real, h, *rest)
        inputs.extend((int(a), int(b)) for a, b, ok in zip(ids.ravel(), goals.ravel(), real.ravel()) if ok)
        return out

    monkeypatch.setattr(M, "_descend", spy)
    w = some_weights()
    sums = M.fresh_sums(w)
    held, begun = M.train_on(w, docs[:6], 8, 0.1, sums, 6, [], False)
    assert begun and all(b[2].any() for b in begun)
    M.train_on(w, held + docs[6:], 8, 0.1, sums, 6, begun)
    assert Counter(inputs) == Counter((int(a), int(b)) for d in docs for a, b in zip([0, *d[:-1]], d))


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    out = M.score(docs, learned=F.lit(False)).collect()
    assert [(r.n_known, r.train_tokens) for r in out] == [(0, 0), (0, 0)] and all(np.isfinite(r.score) for r in out)
    assert M.score(docs.limit(0)).collect() == []


def test_held_out_documents_are_likelier_than_by_unigrams(spark):
    rows = [r for r in queries.op5_lm_scoring(spark, "/root/testdata/sf0.1").collect() if r.held_out]
    gain = sum(r.score - r.base_score for r in rows) / sum(r.n_tokens for r in rows)
    assert len(rows) > 1500 and gain > 0.15
    print("gain", gain)
