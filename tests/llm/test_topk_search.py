import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspark.llm import topk_search as K


def plain(rows, every, k, scale=256):
    vectors = []
    for at, (i, v) in enumerate(rows):
        if v and all(x is not None and math.isfinite(x) for x in v):
            vectors.append((at, i, [math.floor(scale * float(x)) for x in v]))
    out = []
    for at, i, q in vectors:
        if i is not None and i % every == 0:
            found = sorted((-sum(a * b for a, b in zip(q, c)), j is None, j or 0) for n, j, c in vectors if n != at)
            out += [(i, r + 1, None if none else j, -s) for r, (s, none, j) in enumerate(found[:k])]
    return sorted(out, key=str)


def got(df):
    return sorted(((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect()), key=str)


def rows_for(rng, n, width, spread):
    rows = [(int(i), [float(np.float32(x)) for x in rng.standard_normal(width) * spread]) for i in range(n)]
    for i in range(0, n, 9):
        rows[i] = (rows[i][0], rows[(i * 7) % n][1])
    return rows


@pytest.mark.parametrize("spread", [0.2, 40.0, 1e6])
def test_equals_all_scores(spark, spread):
    rows = rows_for(np.random.default_rng(0), 300, 12, spread)
    rows += [rows[5], rows[10], rows[10], (None, rows[3][1]), (310, None), (320, [])]
    rows += [(330, [1.0, None]), (340, [float("nan")] * 12), (350, [float("inf"), 1.0]), (360, [0.5, -0.25]), (370, [0.0] * 15)]
    docs = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, place string, block int").repartition(3)
    for sizes in ({}, {"block_rows": 37, "query_rows": 4}):
        assert got(K.top_k(docs, every=10, **sizes)) == plain(rows, 10, 5)
    assert got(K.top_k(docs, every=1, k=2)) == plain(rows, 1, 2)


def test_stops_before_the_end_of_the_lists():
    rng = np.random.default_rng(1)
    data = rng.integers(-20, 20, (2000, 4))
    data[:3] = 300
    lists, deepest = K.Lists(data), []
    bounds = lists.bounds

    def spy(queries, depth, kind):
        deepest.append(depth)
        low, high = bounds(queries, depth, kind)
        exact = queries @ data.T
        assert (low <= exact).all() and (exact <= high).all()
        return low, high

    lists.bounds = spy
    queries = np.array([[3, 2, 1, 5], [1, 1, 1, 1]])
    found = {q: (at.tolist(), s.tolist()) for q, at, s in K.search(queries, lists, np.arange(2000), np.array([-1, 1]), 2, first_depth=8)}
    assert found == {0: ([0, 1], [3300, 3300]), 1: ([0, 2], [1200, 1200])} and max(deepest) < 2000


def test_few_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert got(K.top_k(spark.createDataFrame([], schema))) == []
    assert got(K.top_k(spark.createDataFrame([(0, [1.0])], schema))) == []
    two = spark.createDataFrame([(0, [1.0]), (1, [0.5])], schema)
    assert got(K.top_k(two)) == [(0, 1, 1, 256 * 128)]
    assert K.top_k(two.where(F.col("vec_id") == 1)).collect() == []


def test_queries_and_vectors_of_many_tasks(spark):
    rng = np.random.default_rng(2)
    rows = rows_for(rng, 120, 12, 0.2) + [(i + 120, v) for i, v in rows_for(rng, 120, 5, 1e6)] + [(i + 240, v) for i, v in rows_for(rng, 120, 14, 0.2)]
    rows += [(i, [0.5] * 12) for i in range(400, 460)] + [(410, [0.5] * 12), (None, [0.5] * 12)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for parts, group_bytes in ((1, 1000), (5, 4000), (5, 1 << 20)):
        assert got(K.top_k(docs.repartition(parts), every=5, block_rows=19, query_rows=9, group_bytes=group_bytes)) == plain(rows, 5, 5)


def moved(df):
    """Bytes that its exchanges wrote."""
    df.collect()
    left, total = [df._jdf.queryExecution().executedPlan()], 0
    while left:
        plan = left.pop()
        if plan.nodeName() == "AdaptiveSparkPlan":
            left.append(plan.executedPlan())
        elif plan.nodeName().endswith("QueryStage"):
            left.append(plan.plan())
        elif plan.nodeName() == "Exchange":
            total += plan.metrics().get("dataSize").get().value()
        left += [plan.children().apply(i) for i in range(plan.children().size())]
    return total


def test_what_moves_does_not_grow_with_the_number_of_blocks(spark):
    rows = rows_for(np.random.default_rng(3), 2400, 8, 0.2)
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # large tables are not broadcast
    try:
        few, many = (moved(K.top_k(docs, every=4, block_rows=n)) for n in (40, 5))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert 0 < many < 2 * few
