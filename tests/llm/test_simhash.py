import re

import numpy as np
import xxhash
from pyspark.sql import types as T

from veilspark.llm import simhash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, ids, radius=4):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, doc in enumerate(ids):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [least.get(find(i)) for i in range(len(fps))]


def test_fingerprint_is_the_plain_one():
    rng = np.random.default_rng(1)
    words = ["ab", "Cd", "é", "ÉX", "x.", "the"]
    texts = [" ".join(rng.choice(words, n)) for n in (0, 1, 3, 4, 5, 50, 4000)] + ["", None, "\t\n ", "a\x0bb\x0cc d e f g h"]
    for text in texts:
        got = simhash.fingerprint(None if text is None else text.encode())
        assert got == plain_fingerprint(text)


def test_long_text_in_pieces(monkeypatch):
    text = " ".join(f"w{i % 977} q{i % 13}" for i in range(3000))
    whole = simhash.fingerprint(text.encode())
    pieces = simhash.word_pieces
    monkeypatch.setattr(simhash, "word_pieces", lambda data: pieces(data, 50))
    assert simhash.fingerprint(text.encode()) == whole == plain_fingerprint(text)


def clustered(rng, n, centres):
    base = rng.integers(0, 1 << 63, centres, dtype=np.uint64)
    out = []
    for _ in range(n):
        x = int(base[rng.integers(centres)])
        for bit in rng.integers(0, 64, rng.integers(0, 8)):
            x ^= 1 << int(bit)
        out.append(x)
    return np.unique(np.array(out, np.uint64))


def test_tree_search_loses_no_link(monkeypatch):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(simhash, "_LEAF", 8)
    for centres in (1, 3, 40, 400):
        points = clustered(rng, 400, centres)
        found = simhash.search(points, 4)
        want = plain_components([int(p) for p in points], list(range(len(points))))
        least = {}
        for i, label in enumerate(found):
            least.setdefault(label, i)
        assert [least[x] for x in found] == want


def test_components_of_documents_with_split_shards(spark):
    rng = np.random.default_rng(3)
    text = [f"t{i}" for i in range(60)]
    rows = []
    for i in range(260):
        words = list(text)
        for at in rng.integers(0, 60, rng.integers(0, 3)):
            words[at] = f"x{rng.integers(0, 5)}"
        rows.append((int(rng.integers(0, 1000)) if i % 50 else None, " ".join(words) if i % 9 else f"own {i} text {i * 7} of it", "s", i))
    rows += [(2000, None, "s", 1), (2001, "", None, 1), (2002, " \n", None, 1), rows[3], rows[3]]
    schema = T.StructType([T.StructField(n, k) for n, k in (("doc_id", T.LongType()), ("text", T.StringType()), ("fp", T.StringType()), ("root", T.IntegerType()))])
    docs = spark.createDataFrame(rows, schema)
    fps = [plain_fingerprint(r[1]) for r in rows]
    want = sorted(zip([r[0] for r in rows], fps, plain_components(fps, [r[0] for r in rows])), key=str)
    for limit in (50_000, 6):
        got = simhash.near_duplicates(docs, shard_rows=limit).collect()
        assert sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got), key=str) == want


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert simhash.near_duplicates(docs).collect() == []


def plain_near_groups(texts, similarity=0.8):
    """A group for each text, by comparing the 5-word shingle sets of all pairs."""
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    group = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= similarity * (len(sets[i]) + len(sets[j]) - both) and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    return group


def test_near_copies_are_found_and_verified(spark):
    rng = np.random.default_rng(11)
    notice = " ".join(f"notice{i}" for i in range(40))
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 3000, int(rng.integers(30, 300)))) + (" " + notice if i % 3 == 0 else "")) for i in range(150)]
    for i in range(150):
        words = rows[i][1].split()
        for at in rng.integers(0, len(words), int(rng.integers(0, max(2, len(words) // 50)))):
            words[at] = f"new{i}"
        rows.append((1000 + i, "\n".join(words).upper()))
    rows += [(2000 + i, notice) for i in range(30)] + [(3000 + i, f"{notice} {i}") for i in range(30)] + [(4000, None), (4001, ""), (4002, "a b"), (4003, "A  b"), (None, rows[0][1]), rows[5]]
    found = simhash.near_copies(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, row int").repartition(6)).collect()
    assert len(found) == len(rows)
    plain = {r: g for r, g in zip(rows, plain_near_groups([t for _, t in rows]))}
    root = {r.doc_id: r.root for r in found}
    same = lambda a, b: root[a] == root[b]
    for (a, _), g in plain.items():  # groups are never larger than the true ones
        assert all(plain[r] == g for r in rows if same(r[0], a))
    true = [(r[0], rows[0 if r[0] is None else r[0] % 1000][0]) for r in rows[150:300]]
    linked = [(a, b) for a, b in true if plain[rows[150 + b]] == plain[rows[b]]]
    assert len(linked) > 100 and np.mean([same(a, b) for a, b in linked]) > 0.95
    assert len({root[2000 + i] for i in range(30)}) == 1 and same(4000, 4001) and same(4002, 4003) and same(None, 0)
    assert simhash.near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_near_copies_lose_no_link(spark):
    """Similarities on both sides of 0.8, texts that share most of their pieces with many unlike ones, and chains."""
    rng = np.random.default_rng(12)
    lines = [" ".join(f"line{k}x{i}" for i in range(12)) for k in range(14)]
    texts = [" ".join(lines[k] for k in rng.permutation(14)[: int(rng.integers(3, 8))]) for _ in range(250)]
    base = [f"chain{i}" for i in range(120)]
    for i in range(40):  # each is like the one before and unlike the first
        base[3 * i] = f"step{i}"
        texts.append(" ".join(base))
    for i in range(120):
        words = [f"w{x}" for x in rng.integers(0, 5000, int(rng.integers(6, 150)))]
        texts.append(" ".join(words))
        for at in rng.integers(0, len(words), max(1, len(words) // 40)):
            words[at] = f"other{i}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    want = plain_near_groups(texts)
    assert len(set(want[250:290])) == 1 and 200 < len(set(want)) < 500
    for options in ({}, {"paired": 3, "block": 7}):
        root = {r.doc_id: r.root for r in simhash.near_copies(docs, **options).collect()}
        first: dict = {}
        assert [first.setdefault(root[i], g) for i, g in enumerate(want)] == want and len(set(root.values())) == len(set(want))
