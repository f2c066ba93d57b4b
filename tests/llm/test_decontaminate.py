import re

import numpy as np
import pytest

from veilspark.llm import decontaminate as D

DOCS = "doc_id long, text string, row string, item int"
ITEMS = "item_id long, text string, words string, at int"


def split(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def plain(docs, items, window=13):
    out = []
    for doc_id, text in docs:
        w, hit, found = split(text), set(), set()
        for item_id, item in items:
            own = split(item)
            n = min(window, len(own))
            spans = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
            for i in range(len(w) - n + 1):
                if n and tuple(w[i : i + n]) in spans:
                    hit.update(range(i, i + n))
                    found.add(item_id)
        ids = sorted(str(x) for x in found if x is not None)
        out.append((doc_id, len(w), len(hit), ids, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def case(rng):
    items = [(i, " ".join(f"W{x}" for x in rng.integers(0, 30, n))) for i, n in enumerate((13, 14, 20, 40, 60, 12, 5, 3, 1, 0, 13))]
    items += [(99, None), (98, "...?!"), items[3], (None, "Rare éX 七 words-here, only"), (97, items[2][1]), (96, "w7 w7 " * 9)]
    docs = []
    for i in range(90):
        words = [f"w{x}" for x in rng.integers(0, 30, rng.integers(0, 120))]
        if i % 2:
            own = split(items[int(rng.integers(0, 9))][1])
            a = int(rng.integers(0, 3))
            words[5:5] = own[a:]
        if i % 5 == 0:
            words[2:2] = split(items[3][1])[4:30] + ["w7"] * 30
        docs.append((i, "".join(w + str(rng.choice([" ", "-", "\n", "_", ". "])) for w in words)))
    docs += [docs[5], docs[5], (None, docs[10][1]), (None, None), (200, None), (201, ""), (202, "?!"), (203, "a RARE éX 七 words here only")]
    return docs, items


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in df.collect()), key=str)


@pytest.mark.parametrize("literals", [20_000, 0])
def test_equals_comparison_of_all_windows(spark, literals):
    docs, items = case(np.random.default_rng(3))
    d = spark.createDataFrame([(*x, "r", 1) for x in docs], DOCS).repartition(3)
    i = spark.createDataFrame([(*x, "w", 1) for x in items], ITEMS)
    assert got(D.decontaminate(d, i, literals=literals)) == plain(docs, items)
    small = {"window": 6, "k": 3, "literals": literals}
    assert got(D.decontaminate(d, i, **small)) == plain(docs, items, 6)


def test_every_shared_window_leaves_a_kept_hash(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(100):
        span = [f"s{x}" for x in rng.integers(0, 9, 13)]
        rows.append(([f"a{x}" for x in rng.integers(0, 9, i % 7)] + span, span + [f"b{x}" for x in rng.integers(0, 9, i % 5)]))
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    from pyspark.sql import functions as F

    both = df.select(F.arrays_overlap(D.kept_hashes(F.col("a"), 5, 13), D.kept_hashes(F.col("b"), 5, 13)).alias("meet"))
    assert both.where("meet").count() == 100


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert got(D.decontaminate(docs, items)) == [(1, 3, 0, [], False)]
    assert got(D.decontaminate(docs.limit(0), items)) == []
    full = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert got(D.decontaminate(docs.limit(0), full)) == []


def test_no_python_in_the_plan(spark):
    docs, items = case(np.random.default_rng(3))
    df = D.decontaminate(spark.createDataFrame(docs[:9], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
