import hashlib
import re
from collections import defaultdict

import numpy as np
from pyspark.sql import types as T

from veilspark.llm import substring_dedup as S

LAST = 1 << 63


def plain(rows, window):
    """n_words, n_removed and kept text of each row (doc_id, text), by comparing all windows."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = defaultdict(lambda: (LAST, 0))
    for (doc, _), w in zip(rows, words):
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            first[key] = min(first[key], (LAST - 1 if doc is None else doc, i))
    out = []
    for (doc, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < (LAST - 1 if doc is None else doc, i):
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def rows_for(rng, n, window):
    passage = [f"p{i}" for i in range(3 * window)]
    rows = []
    for i in range(n):
        words = [f"w{x}" for x in rng.integers(0, 400, rng.integers(0, 6 * window))]
        if i % 3 == 0:
            a = rng.integers(0, window)
            words[3:3] = passage[a : a + int(rng.integers(window - 2, 2 * window))]
        if i % 7 == 0:
            words = words + words
        if i % 11 == 0:
            words = ["same"] * int(rng.integers(0, 4 * window))
        rows.append((int(rng.integers(0, n)) if i % 13 == 0 else 10 * i, "\n".join(words) if i % 2 else "  ".join(words)))
    return rows + [rows[0], rows[0], rows[3], (None, rows[3][1]), (None, None), (5, None), (6, ""), (7, " \t\n\x0b"), (-1, rows[6][1])]


def got(df):
    out = []
    for r in df.collect():
        n = sum(x.end - x.start for x in r.removed)
        assert all(a.end < b.start for a, b in zip(r.removed, r.removed[1:]))
        out.append((r.doc_id, r.n_words, n, hashlib.sha256(r.kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_equals_comparison_of_all_windows(spark):
    rng = np.random.default_rng(0)
    rows = rows_for(rng, 120, 6)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
    docs = spark.createDataFrame(rows, schema).repartition(5)
    for run, bucket in ((2_000_000, 2_000_000), (300, 100)):
        assert got(S.remove_repeats(docs, window=6, run_words=run, bucket_words=bucket)) == sorted(plain(rows, 6), key=str)


def test_long_text_in_pieces_and_clashing_columns(spark, monkeypatch):
    pieces = S.word_pieces
    words = [f"w{i % 97}" for i in range(1000)] + [f"v{i}" for i in range(50)]
    long, body = " ".join(words), [S.word_hashes(words[i : i + 1]) for i in ()]
    assert body == [] and [w for p in pieces(long.encode(), 40) for w in p] == long.encode().split()
    rows = [(1, long, "a", 1, "b"), (2, long, None, 2, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, doc int, starts string")
    df = S.remove_repeats(docs, window=5)
    assert df.columns == ["doc_id", "text", "doc", "starts", "n_words", "removed", "kept"]
    assert got(df) == sorted(plain([r[:2] for r in rows], 5), key=str)
    assert [r.starts for r in df.orderBy("doc_id").collect()] == ["b", "c"]


def test_windows_across_pieces():
    rng = np.random.default_rng(4)
    words = S.word_hashes([b"%d" % x for x in rng.integers(0, 50, 500)])
    whole = S.window_hashes(words, 7)
    for a in (0, 13, 400):
        assert (S.window_hashes(words[a : a + 80], 7) == whole[a : a + 74]).all()
    assert len(S.window_hashes(words[:6], 7)) == 0


def test_empty_table(spark):
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
