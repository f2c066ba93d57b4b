import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from veilspark.llm import exact_dedup as X

SCHEMA = "doc_id long, text string, row string, digest map<string,int>, kept double"


def plain(rows):
    """doc_id, keep_id, group_size, kept and digest of each row (doc_id, text)."""
    groups = defaultdict(list)
    for k, (doc, text) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc is None, doc or 0, k))
    out = []
    for text, members in groups.items():
        first = min(members)
        for m in members:
            digest = hashlib.sha256(text.encode()).hexdigest()
            out.append((rows[m[3]][0], rows[first[3]][0], len(members), m[3] == first[3], digest))
    return Counter(out)


def cases(n=300):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        words = [rng.choice(["a", "bb", "é", " ", " ", "漢字", "x\x00y"]) for _ in range(rng.randrange(4))]
        rows.append((i, rng.choice([" ", "\t\n", "", "\x0b"]).join(words)))
    rows += [(1000 + i, "a third of all rows " + " " * (i % 7)) for i in range(n // 2)]
    return rows + [(None, None), (None, ""), (2000, None), (2001, " \t\r\n"), (2000, None), rows[0], rows[0], (None, "own text"), (3000, "long " * 50_000), (3001, "long" * 50_000)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "r", {"a": 1}, 1.5) for r in rows], SCHEMA)


def marked(df):
    return Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.digest) for r in df.collect())


def test_equals_plain_groups(spark):
    rows = cases()
    assert marked(X.mark_duplicates(frame(spark, rows).repartition(7))) == plain(rows)


@pytest.mark.parametrize("options", [{"bits_per_row": 1, "probes": 1}, {"most_bits": 1}, {"probes": 5}])
def test_a_filter_of_any_size_gives_the_same(spark, options):
    rows = cases(120)
    assert marked(X.mark_duplicates(frame(spark, rows), **options)) == plain(rows)


def test_single_rows_pass_the_filter_and_repeated_ones_do_not(spark):
    rows = spark.range(20_000).select((F.col("id") % 15_000).alias("id"), F.unhex(F.sha2((F.col("id") % 15_000).cast("string"), 256)).alias("digest"))
    blocks = X.filter_blocks(20_000, 16, 1 << 30)
    seen = X.repeated_filter(rows, "digest", blocks, 2)
    tested = X.possibly_repeated(rows, seen, "digest", blocks, 2)
    again = tested.where("again")
    assert again.where("id < 5000").count() == 10_000
    assert again.where("id >= 5000").count() < 1_000  # the filter lets few others through
    assert seen.agg(F.sum(F.length("bitmap"))).first()[0] <= blocks * 4096


def test_no_python_worker_and_singles_do_not_shuffle(spark):
    plan = X.mark_duplicates(frame(spark, cases(30)))._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Python|Pandas|Arrow", plan)
    alone = plan.split("Union")[1].split("Exchange")[0] if "Union" in plan else ""
    assert "FileScan" in alone or "Scan parquet" in alone


def test_drop_duplicates_keeps_the_rows_that_stay(spark):
    rows = cases(100)
    left = X.drop_duplicates(frame(spark, rows))
    assert left.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    stay = Counter((k[1], k[4]) for k in plain(rows))
    got = Counter((r.doc_id, hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", r.text or "").encode()).hexdigest()) for r in left.collect())
    assert got == Counter(set(stay))
    longest = {r.doc_id: len(r.text or "") for r in left.collect() if r.doc_id is not None}
    assert longest[1006] > longest.get(1000, 0)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert X.mark_duplicates(empty).count() == 0 and X.drop_duplicates(empty).count() == 0
