import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspark.llm import resample as R

SCHEMA = "doc_id long, text string, rank string, score map<string,int>, _row double"


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return len(words), [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def plain(rows, target, least=20, share=5, buckets=10_000):
    """doc_id, n_features, weight, score and rank of each row, by joined strings, counters and a sort."""
    of = [(d, *features(t)) for d, t in rows]
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(bucket(f) for _, _, fs in of for f in fs), Counter(bucket(f) for x in target for f in features(x)[1])
    ss, tt = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (ss + buckets) / ((s[b] + 1) * (tt + buckets)))) for b in range(buckets)]
    scored = []
    for d, n, fs in of:
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        w = sum(gain[bucket(f)] for f in fs)
        scored.append((d, n, len(fs), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((x for x in scored if x[1] >= least), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    drawn = able[: share * len(able) // 100]
    ranks = [(*x[:1], *x[2:], k + 1) for k, x in enumerate(drawn)]
    rest = Counter((*x[:1], *x[2:], None) for x in scored) - Counter((*x[:-1], None) for x in ranks)
    return Counter(ranks) + rest


def cases(n, seed=0):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "ÀB", "漢字", "x" * 70, "Mixed", "\x7f", "_", "9"]
    rows = [(i * 3, rng.choice([" ", "-", "\n "]).join(rng.choices(vocabulary, k=rng.randrange(60)))) for i in range(n)]
    rows += [(i, "the same text of many rows " * 5) for i in (7, 7, 7, -5, 1, 1)] + [(None, "the same text of many rows " * 5)] * 5
    return rows + [(5000, None), (5001, ""), (5002, "..."), (5003, "y" * 100_000 + " and " + "z " * 300_000), rows[3], rows[3]]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "r", {"a": 1}, 1.5) for r in rows], SCHEMA)


def got(df):
    return Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect())


def test_crcs_of_joined_words():
    rng = random.Random(1)
    words = [bytes(rng.choices(b"abc\xc3\xa9", k=rng.choice([1, 2, 30, 63, 64, 65, 300, 5000]))) for _ in range(200)]
    ends = np.array([80] * 80 + [81] + [200] * 119)
    for k, (at, crc) in enumerate(R.feature_crcs(words, ends), 1):
        assert list(crc) == [zlib.crc32(b" ".join(words[i - k + 1 : i + 1])) for i in range(k - 1, 200) if ends[i - k + 1] == ends[i]]
        assert all(ends[i - k + 1] == ends[i] for i in at)


@pytest.mark.parametrize("share", [5, 60])
def test_equals_plain_version(spark, share):
    rows, target = cases(200), ["W1 w2 w3 w4 w5", None, "w9 w9 É"]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    assert got(R.resample(frame(spark, rows).repartition(5), bench, share=share)) == plain(rows, target, share=share)


def test_long_texts_in_pieces(spark, monkeypatch):
    texts = R._texts
    monkeypatch.setattr(R, "_texts", lambda batches, column: texts(batches, column, 50))
    rows = cases(40)[:-3]
    batch = frame(spark, rows).select(F.col("text").cast("binary")).toArrow().to_batches()
    count = Counter()
    for _, words, ends, skip, _ in R._texts(iter(batch), 0):
        if words:
            for _, crc in R.feature_crcs(words, ends, 3, skip):
                count.update(map(int, crc))
    assert count == Counter(zlib.crc32(f.encode()) for _, t in rows for f in features(t)[1])


def test_cutoff_by_bisection(spark):
    rng = random.Random(5)
    values = [rng.choice([rng.randrange(-(10**15), 10**15), 7, 7, -3]) for _ in range(500)]
    rows = spark.createDataFrame([(v,) for v in values], "v long")
    for n in (1, 2, 250, 499, 500):
        at, below = R.nth_smallest(rows, F.col("v"), n)
        assert at == sorted(values)[n - 1] and below == sum(v < at for v in values)


def test_ties_at_the_cutoff(spark):
    rows = [(d, 30, 5) for d in (4, 4, 4, 9, 2, None, None)] + [(1, 30, 8), (3, 10, 99)]
    scored = spark.createDataFrame(rows, "doc_id long, n_words long, score long")
    for share in (13, 60, 80, 100):
        n = 8 * share // 100
        want = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[2], r[0] is None, r[0] or 0))[:n]
        drawn = R.draw(scored, F.col("n_words") >= 20, share).where("rank is not null").orderBy("rank").collect()
        assert [tuple(r)[:3] for r in drawn] == want and [r["rank"] for r in drawn] == list(range(1, n + 1))


def test_empty_tables(spark):
    empty, bench = frame(spark, []), spark.createDataFrame([], "text string")
    assert R.resample(empty, bench).count() == 0
    rows = cases(30)
    assert got(R.resample(frame(spark, rows), bench)) == plain(rows, [])
