"""Every stage of the pipeline against a plain version, on planted cases; then run() as a whole."""

import importlib.util
import os

import numpy as np
import pytest

import corpus_pipeline as pipeline


def sibling(name):
    path = os.path.join(os.path.dirname(__file__), f"{name}.py")
    spec = importlib.util.spec_from_file_location(f"plain_{name}", path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


simhash, substring, contaminated, toxic = map(sibling, ("test_simhash", "test_substring_dedup", "test_decontaminate", "test_toxicity"))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, score double, removed map<string,int>"


def row(doc_id, text):
    return (doc_id, text, "en", "s", None if text is None else len(text), "r", 1.5, {"a": 1})


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(8)
    texts, labels = toxic.corpus(rng, 150)
    passage = " ".join(f"P{i}" for i in range(60))
    bench = [(i, " ".join(f"b{x}" for x in rng.integers(0, 500, 30))) for i in range(5)] + [(9, None)]
    rows = [row(10 * i, t) for i, t in enumerate(texts)]
    for i in (1, 2, 4, 5):
        changed = texts[i + 20].split()
        changed[len(changed) // 2 :: 40] = [f"changed{i}"] * len(changed[len(changed) // 2 :: 40])
        rows.append(row(6000 + i, " ".join(changed)))
        rows.append(row(2000 + i, f"{texts[i]} own{i} {passage} {texts[i + 6]}"))
        rows.append(row(3000 + i, f"{texts[i + 1]} {bench[i % 5][1]} tail{i}"))
        rows.append(row(4000 + i, texts[i]))
    rows += [row(None, texts[1]), row(None, "only here without an id"), row(5000, None), row(5001, ""), rows[1], rows[1]]
    root = str(tmp_path_factory.mktemp("data"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(10 * i, y) for i, y in enumerate(labels)], "doc_id long, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root, dict((10 * i, y) for i, y in enumerate(labels)), bench


def pairs(df):
    assert [f.simpleString() for f in df.schema] == [f.simpleString() for f in df.sparkSession.createDataFrame([], SCHEMA).schema]
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_stages(spark, folder):
    root, labels, bench = folder
    docs = spark.read.parquet(f"{root}/documents.parquet")
    steps = dict(pipeline.STAGES)
    assert list(steps) == ["toxicity", "simhash_near_dedup", "substring_dedup", "decontamination", "best_fit_packing"]

    before = pairs(docs)
    docs = pipeline.stage(steps["toxicity"](spark, docs, root), "t")
    kept = pairs(docs)
    assert set(kept) <= set(before)
    wrong = [(d in {k for k, _ in kept}) == (y == 1) for d, y in labels.items()]
    assert np.mean(wrong) < 0.06 and {5000, 5001, None} <= {k for k, _ in kept}

    docs = pipeline.stage(steps["simhash_near_dedup"](spark, docs, root), "s")
    first = {}
    for (d, t), c in zip(kept, simhash.plain_near_groups([t for _, t in kept])):
        first.setdefault(c, []).append((d is None, d or 0, str(t), (d, t)))
    want = sorted((min(x)[3] for x in first.values()), key=str)
    before, kept = kept, pairs(docs)
    assert kept == want and (None, "only here without an id") in kept
    gone = {d for d, _ in before} - {d for d, _ in kept}
    assert {4001, 4002, 4004, 4005, 6001, 6002} & {d for d, _ in before} <= gone

    docs = pipeline.stage(steps["substring_dedup"](spark, docs, root), "c")
    plain = substring.plain(kept, 20)
    cut = pairs(docs)
    assert len(cut) == len(kept)
    again = {d: t for d, t in cut}
    for (d, t), (_, n, gone, _) in zip(kept, plain):
        assert (again[d] == t) if not gone else len(again[d].split()) == n - gone
    assert sum(gone > 0 for _, _, gone, _ in plain) >= 3
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in docs.collect())

    docs = pipeline.stage(steps["decontamination"](spark, docs, root), "d")
    bad = {r[0] for r in contaminated.plain(cut, bench) if r[4]}
    kept = pairs(docs)
    assert kept == [x for x in cut if x[0] not in bad] and bad & set(range(3000, 3010))

    packed = steps["best_fit_packing"](spark, docs, root).collect()
    assert sum(r.length for r in packed) == sum(len((t or "").split()) + 1 for _, t in kept)


def test_run(spark, folder):
    root, _, _ = folder
    out = pipeline.run(spark, root)
    assert out.columns[:3] == ["shard", "bin", "capacity"] and out.count() > 50


def test_empty_tables(spark, tmp_path):
    root = str(tmp_path)
    for name, schema in (("documents", SCHEMA), ("labels", "doc_id long, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{root}/{name}.parquet")
    assert pipeline.run(spark, root).count() == 0
