from collections import Counter

import duckdb
import pytest

from veilspark.llm import language_id as L
from veilspark.llm import queries

SF = "/root/testdata/sf0.01"


def plain_counts(text):
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    out = Counter()
    if words:
        line = "\x01" + "\x01".join(words) + "\x01"
        for n in (1, 2, 3):
            for i in range(len(line) - n + 1):
                g = line[i : i + n]
                if g != "\x01" and (n < 3 or g[1] != "\x01"):
                    out[g] += 1
    return out


def plain_ranking(counts, k):
    code = {g: sum(ord(c) << 21 * i for i, c in enumerate(reversed(g))) for g in counts}
    return sorted(counts, key=lambda g: (-counts[g], code[g]))[:k]


def plain_nearest(text, rankings, k):
    own = plain_ranking(plain_counts(text), k)
    if not own or not rankings:
        return "und", 0.0
    found = []
    for lang in sorted(rankings):
        at = {g: i for i, g in enumerate(rankings[lang])}
        found.append((sum(abs(at[g] - i) if g in at else k for i, g in enumerate(own)), lang))
    best = min(found)
    return best[1], 1 - best[0] / (k * len(own))


TEXTS = [
    ("en", "The cat sat, the Hat ran; that is 3 the THING"),
    ("en", "there and then the other"),
    ("de", "Der Hund und die Straße über Öl"),
    ("de", "und das ist nicht der ÄRGER"),
    ("zh", "中文 \U00020000字 中"),
    ("", "x y z"),
    (None, "the the the"),
    ("en", None),
    ("fr", "12 34 !!"),
]


@pytest.mark.parametrize("k", [3, 400])
def test_equals_the_plain_version(spark, k):
    rows = [(i, t, lang, 1) for i, (lang, t) in enumerate(TEXTS + TEXTS[:2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int").repartition(3)
    sums = {}
    for _, t, lang, _ in rows:
        if lang is not None:
            sums.setdefault(lang, Counter()).update(plain_counts(t))
    rankings = {x: plain_ranking(c, k) for x, c in sums.items() if c}
    got = L.identify(docs, L.train(docs, profile=k))
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    for r in got.collect():
        lang, score = plain_nearest(r.text, rankings, k)
        assert (r.lang_pred, round(r.score, 9)) == (lang, round(score, 9))


def test_pieces_of_long_texts(monkeypatch):
    text = "".join(f"wörd{i % 37} Ünd,{'a' * (i % 5)}" for i in range(2000))
    whole = L.count_grams(text)
    monkeypatch.setattr(L, "_PIECE", 100)
    parts = L.count_grams(text)
    want = plain_counts(text)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all() and whole[1].sum() == sum(want.values()) and len(whole[0]) == len(want)


def test_tasks_that_hold_little_hand_on_often(spark, monkeypatch):
    docs = spark.createDataFrame([(t, lang) for lang, t in TEXTS], "text string, lang string")
    want = L.train(docs)
    monkeypatch.setattr(L, "_HELD", 3)
    got = L.train(docs)
    assert got.names == want.names and (got.grams == want.grams).all() and (got.ranks == want.ranks).all()


def test_nothing_to_learn_and_limits(spark):
    docs = spark.createDataFrame([("the cat", None), (None, None), ("", None)], "text string, lang string")
    none = L.train(docs)
    assert [(r.lang_pred, r.score) for r in L.identify(docs, none).collect()] == [("und", 0.0)] * 3
    assert L.identify(docs.limit(0), none).collect() == []
    with pytest.raises(ValueError):
        L.train(spark.createDataFrame([("a", "x"), ("b", "y")], "text string, lang string"), languages=1)


def test_held_out_accuracy(spark):
    truth = dict(duckdb.sql(f"select doc_id, lang from '{SF}/documents.parquet'").fetchall())
    rows = [r for r in queries.op9_language_id(spark, SF).collect() if r.held_out]
    assert len(rows) > 150 and sum(r.lang_pred == truth[r.doc_id] for r in rows) / len(rows) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
