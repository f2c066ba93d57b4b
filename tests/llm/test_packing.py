import numpy as np
import pytest

from veilspark.llm import packing as P

SIZES = (8, 16, 32)


def plain_pack(lengths, sizes, cost):
    """The same rule by looking at all bins for each piece."""
    left, bins, out = sum(lengths), [], []
    for n in lengths:
        fits = [b for b in range(len(bins)) if bins[b][0] - bins[b][1] >= n]
        if fits:
            room = min(bins[b][0] - bins[b][1] for b in fits)
            b = max((b for b in fits if bins[b][0] - bins[b][1] == room), key=lambda b: bins[b][2])
        else:
            size = min((c for c in sorted(sizes) if c >= n), key=lambda c: (cost(c) / min(c, left), c))
            bins.append([size, 0, 0])
            b = len(bins) - 1
        out.append((b, bins[b][1]))
        bins[b][1] += n
        bins[b][2] = len(out)
        left -= n
    return out, [min((c for c in sorted(sizes) if c >= used), key=lambda c: (cost(c), c)) for _, used, _ in bins]


@pytest.mark.parametrize("cost", [P.default_cost, lambda c: c + 5, lambda c: c**0.5, lambda c: 1.0])
def test_equals_the_plain_rule(cost):
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 40, 300):
        lengths = sorted(rng.integers(1, 33, n).tolist(), reverse=True)
        bins, starts, final = P.pack(lengths, SIZES, cost)
        assert (list(zip(bins, starts)), final) == plain_pack(lengths, SIZES, cost)


def test_larger_bins_open_where_pieces_share_them():
    sizes = (512, 1024, 2048, 4096)
    for lengths, most in (([300] * 3000, 1.45), ([260] * 3000, 1.65)):
        assert sum(map(P.default_cost, P.pack(lengths, sizes)[2])) / sum(lengths) > 1.9
        assert sum(map(P.default_cost, P.pack_cheapest(lengths, sizes)[2])) / sum(lengths) < most
    rng = np.random.default_rng(5)
    for n in (0, 1, 3, 900):
        for lengths in (rng.integers(1, 4097, n), rng.integers(257, 700, n), (rng.pareto(1.2, n) * 80 + 1).clip(1, 4096).astype(int)):
            lengths = sorted(lengths.tolist(), reverse=True)
            bins, starts, final = P.pack_cheapest(lengths, sizes)
            held = np.bincount(bins, weights=lengths, minlength=len(final)) if n else []
            assert all(min(c for c in sizes if c >= u) == f for u, f in zip(held, final)) and len(held) == len(final)
            assert len(set(zip(bins, starts))) == n
            assert sum(map(P.default_cost, final)) <= sum(map(P.default_cost, P.pack(lengths, sizes)[2]))


def test_documents(spark):
    rng = np.random.default_rng(2)
    rows = [(int(rng.integers(0, 400)), " ".join("w" for _ in range(int(rng.integers(0, 90)))), "x", 1) for _ in range(500)]
    rows += [rows[0]] * 3 + [(None, "a b c", None, None), (None, None, None, None), (7, "", None, None), (8, " \n", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bin string, n int")
    for limit in (50_000, 100):
        out = P.pack_documents(docs, SIZES, shard_pieces=limit).collect()
        want = sorted(((r[0], len((r[1] or "").split()) + 1) for r in rows), key=str)
        got, by_bin = {}, {}
        for r in out:
            got.setdefault((r.doc_id, r.tokens, r.copy, r.piece), []).append(r)
            by_bin.setdefault((r.shard, r.bin), []).append(r)
        assert all(len(x) == 1 for x in got.values())
        totals = sorted([r.length for r in out])
        assert sum(totals) == sum(n for _, n in want)
        assert totals == sorted(min(32, n - k) for _, n in want for k in range(0, n, 32))
        assert sorted({r.shard for r in out}) == list(range(max(r.shard for r in out) + 1))
        for pieces in by_bin.values():
            pieces.sort(key=lambda r: r.start)
            assert [r.start for r in pieces] == [sum(x.length for x in pieces[:k]) for k in range(len(pieces))]
            used = sum(r.length for r in pieces)
            assert {r.capacity for r in pieces} == {min(c for c in SIZES if c >= used)}
    assert P.sequences(P.pack_documents(docs, SIZES)).agg({"tokens": "sum"}).first()[0] == sum(n for _, n in want)


def test_result_is_the_same_for_any_layout(spark):
    rows = [(i % 50, " ".join("w" * (1 + i * 7 % 40))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one = sorted(map(tuple, P.pack_documents(docs.coalesce(1), SIZES, shard_pieces=90).collect()))
    assert sorted(map(tuple, P.pack_documents(docs.repartition(7), SIZES, shard_pieces=90).collect())) == one


def test_empty_table(spark):
    assert P.pack_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
