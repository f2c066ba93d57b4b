"""Readers, archives and guards."""

import gzip
import json
import zipfile

import pandas as pd
import pytest

from veilspark import load_any, load_tables, preview_file
from veilspark.operators.metadata import table_metadata
from veilspark.sources import decoders
from veilspark.sources.formats import file_format

ROWS = [("C-1", "alice@example.com", 3), ("C-2", "bob@example.com", 4)]
COLUMNS = ["customer_id", "email", "n"]
FRAME = pd.DataFrame(ROWS, columns=COLUMNS)
RECORDS = [dict(zip(COLUMNS, row)) for row in ROWS]


def write(tmp_path, name):
    path = tmp_path / name
    kind = name.rsplit(".", 1)[-1]
    if kind in ("csv", "tsv", "psv"):
        FRAME.to_csv(path, index=False, sep={"csv": ",", "tsv": "\t", "psv": "|"}[kind])
    elif kind == "json":
        path.write_text(json.dumps(RECORDS, indent=1))
    elif kind in ("jsonl", "ndjson"):
        path.write_text("\n".join(json.dumps(r) for r in RECORDS))
    elif kind in ("yaml", "yml"):
        path.write_text("\n".join(f"- customer_id: {a}\n  email: {b}\n  n: {c}" for a, b, c in ROWS))
    elif kind == "xml":
        body = "".join(f"<row><customer_id>{a}</customer_id><email>{b}</email><n>{c}</n></row>" for a, b, c in ROWS)
        path.write_text(f"<data>{body}</data>")
    elif kind == "parquet":
        FRAME.to_parquet(path)
    elif kind == "feather":
        FRAME.to_feather(path)
    elif kind == "orc":
        FRAME.to_orc(path)
    elif kind == "gz":
        path.write_bytes(gzip.compress(FRAME.to_csv(index=False).encode()))
    return str(path)


NAMES = ["t.csv", "t.tsv", "t.psv", "t.json", "t.jsonl", "t.ndjson", "t.yaml", "t.yml", "t.xml", "t.parquet", "t.feather",
         "t.orc", "t.csv.gz"]


@pytest.mark.parametrize("name", NAMES)
def test_every_format_reads_the_same_rows(spark, tmp_path, name):
    df = load_any(spark, write(tmp_path, name)).select(*COLUMNS)
    assert sorted((r[0], r[1], int(r[2])) for r in df.collect()) == ROWS


def test_one_json_object_and_text(spark, tmp_path):
    (tmp_path / "o.json").write_text(json.dumps(RECORDS[0]))
    assert load_any(spark, str(tmp_path / "o.json")).first()["customer_id"] == "C-1"
    (tmp_path / "o.log").write_text("line one\nline two")
    assert load_any(spark, str(tmp_path / "o.log")).first()["value"] == "line one\nline two"
    (tmp_path / "odd.dat").write_text("a,b\n1,2\n")
    assert load_any(spark, str(tmp_path / "odd.dat"), "csv").columns == ["a", "b"]


def test_missing_texts_quotes_and_unnamed_columns(spark, tmp_path):
    (tmp_path / "m.csv").write_text('a,,c\nN/A,"x ""q""\ny",1\nv,NULL,\n')
    rows = load_any(spark, str(tmp_path / "m.csv")).orderBy("a").collect()
    assert rows[0].asDict() == {"a": None, "column_2": 'x "q"\ny', "c": 1}
    assert rows[1].asDict() == {"a": "v", "column_2": None, "c": None}


def test_formats_are_checked_before_reading(spark):
    assert file_format("x.NDJSON") == "jsonl" and file_format("x", "log") == "text"
    for path in ("missing.xlsb", "missing", "missing.exe"):
        with pytest.raises(ValueError):
            load_any(spark, path)


def test_many_yaml_files_with_differing_fields(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("name: x\nsize: 1\n")
    (tmp_path / "b.yaml").write_text("- name: y\n  color: red\n- name: z\n")
    df = load_any(spark, str(tmp_path / "*.yaml"))
    assert sorted(df.columns) == ["color", "name", "size"]
    assert sorted((r["name"], r["size"], r["color"]) for r in df.collect())[0] == ("x", 1, None)


def make_zip(path, members, compression=zipfile.ZIP_DEFLATED):
    with zipfile.ZipFile(path, "w", compression) as archive:
        for name, content in members.items():
            archive.writestr(name, content)
    return str(path)


def test_archive_members_become_tables(spark, tmp_path):
    path = make_zip(
        tmp_path / "a.zip",
        {"one.csv": FRAME.to_csv(index=False), "two.jsonl": "\n".join(map(json.dumps, RECORDS)), "dir/notes.txt": "hello"},
    )
    tables = load_tables(spark, path)
    assert sorted(tables) == ["dir/notes.txt", "one.csv", "two.jsonl"]
    assert tables["one.csv"].count() == 2 and tables["dir/notes.txt"].first()["value"] == "hello"
    assert sorted(r["n"] for r in tables["two.jsonl"].collect()) == [3, 4]
    assert list(load_tables(spark, write(tmp_path, "t.csv"))) == ["t.csv"]


def test_archive_guards(tmp_path, monkeypatch):
    def members(**parts):
        path = make_zip(tmp_path / "g.zip", parts.pop("files"), **parts)
        with open(path, "rb") as handle:
            return list(decoders.zip_members(handle.read()))

    for files in ({}, {"../x.csv": "a"}, {"/x.csv": "a"}, {"x.zip": "a"}, {"x.gz": "a"}, {"x.exe": "a"}):
        with pytest.raises(ValueError):
            members(files=files)
    with pytest.raises(ValueError):
        members(files={"x.csv": "a"}, compression=zipfile.ZIP_BZIP2)
    assert len(members(files={f"{i}.csv": "a" for i in range(100)})) == 100
    with pytest.raises(ValueError):
        members(files={f"{i}.csv": "a" for i in range(101)})
    monkeypatch.setattr(decoders, "MAX_EXTRACTED_BYTES", 10)
    with pytest.raises(ValueError):
        members(files={"x.csv": "a" * 11})


def test_input_size_guard(spark, tmp_path, monkeypatch):
    path = write(tmp_path, "t.feather")
    monkeypatch.setattr(decoders, "MAX_INPUT_BYTES", 10)
    with pytest.raises(Exception, match="exceeds the maximum allowed size"):
        load_any(spark, path).collect()


def test_file_preview(spark, key, tmp_path):
    preview = preview_file(spark, write(tmp_path, "t.csv"), key, 1)
    assert preview["rows"] == 1 and preview["suggested_policy"]["columns"]["email"] == "tokenize"
    assert "alice" not in str(preview["sample"].collect())
    with pytest.raises(ValueError):
        preview_file(spark, str(tmp_path / "a.zip"), key)


def test_metadata_ignores_row_order_but_not_content(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "")], "n int, s string")
    digest = table_metadata(df, "t").first()
    assert (digest["row_count"], digest["column_count"]) == (3, 2)
    assert table_metadata(df.repartition(3).orderBy("s"), "t").first()["digest"] == digest["digest"]
    assert table_metadata(df.na.fill(""), "t").first()["digest"] != digest["digest"]


def test_rows_per_file_bounds_every_file(spark, tmp_path):
    from veilspark.sinks.writers import write_rows

    write_rows(spark.range(250).coalesce(1), f"{tmp_path}/rows", "csv", rows_per_file=100)
    sizes = spark.read.option("header", True).csv(f"{tmp_path}/rows").groupBy("_metadata.file_name").count()
    assert sorted(r["count"] for r in sizes.collect()) == [50, 100, 100]
