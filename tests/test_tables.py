"""Sources, previews, metadata, conversion, splitting and merging of files."""

from datetime import date, datetime

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera import api
from tessera.sinks import files
from tessera.sources import csv, storage, table, xlsx

NAMES = ["quartz", "flint", "mica", "basalt", "agate"]
SAMPLE = pa.table({"id": [1, 2, 3, 4, 5], "name": NAMES, "finds": [7, 0, 12, 3, 3], "site": ["north pit", "ridge", "ridge", "quay", "moor"], "grams": [1.25, 80.5, 0.75, 4096.0, 33.5]})


@pytest.fixture
def sample(tmp_path):
    pq.write_table(SAMPLE, tmp_path / "sample.parquet")
    lines = [",".join(SAMPLE.column_names)] + [",".join(map(str, r.values())) for r in SAMPLE.to_pylist()]
    (tmp_path / "sample.csv").write_text("\n".join(lines) + "\n")
    (tmp_path / "sample.xlsx").write_bytes(files.workbook(SAMPLE.column_names, [list(r.values()) for r in SAMPLE.to_pylist()])[0])
    return tmp_path


@pytest.mark.parametrize("kind", ["parquet", "csv", "xlsx"])
def test_reads_each_format_alike(spark, sample, kind):
    data = api.Dataset(spark, f"{sample}/sample.{kind}")
    assert data.num_rows == 5 and data.num_columns == 5
    assert [t for _, t, _ in data.fields] == ["int64", "string", "int64", "string", "double"]
    assert [tuple(r) for r in data.head(2, ["name", "id"]).collect()] == [("quartz", 1), ("flint", 2)]
    assert [r.id for r in data.tail(2).collect()] == [4, 5]
    assert data.head(0).count() == 0 and data.head(0).columns == SAMPLE.column_names
    assert data.head(99).count() == 5
    assert [r.id for r in data.tail(99).collect()] == [1, 2, 3, 4, 5]


def test_arguments(spark, sample):
    data = api.Dataset(spark, f"{sample}/sample.csv")
    for wrong, message in ((lambda: data.head(-1), "non-negative"), (lambda: data.head(1, []), "cannot be empty"), (lambda: data.tail(1, ["x"]), r"Columns not found in schema: \['x'\]")):
        with pytest.raises(ValueError, match=message):
            wrong()
    with pytest.raises(FileNotFoundError, match="File not found"):
        api.Dataset(spark, f"{sample}/none.csv")
    (sample / "x.json").write_text("{}")
    with pytest.raises(ValueError, match="Unsupported file format"):
        api.Dataset(spark, f"{sample}/x.json")


def test_previews_over_row_groups_and_files(spark, tmp_path, monkeypatch):
    folder = tmp_path / "many.parquet"
    folder.mkdir()
    for k in range(3):
        rows = pa.table({"id": list(range(40 * k, 40 * k + 40)), "value": [f"v{i}" for i in range(40)]})
        pq.write_table(rows, folder / f"part-{k}.parquet", row_group_size=5)
    data = api.Dataset(spark, str(folder))
    assert [r.id for r in data.head(42, ["id"]).collect()] == list(range(42))
    assert [r.id for r in data.tail(3).collect()] == [117, 118, 119]
    assert data.num_row_groups == 24 and data.num_rows == 120
    for few in (100, 2):
        monkeypatch.setattr(table, "FEW", few)
        numbered = {r["__ordinal"]: r.id for r in api.Dataset(spark, str(folder)).numbered().collect()}
        assert numbered == {i: i for i in range(120)} and api.Dataset(spark, str(folder)).num_rows == 120
    read = []
    real = storage.Storage.read
    monkeypatch.setattr(storage.Storage, "read", lambda self, path, start, length: read.append((path[-9:], start)) or real(self, path, start, length))
    for preview, ids, file in ((data.head, [0, 1], "0.parquet"), (data.tail, [118, 119], "2.parquet")):
        read.clear()
        assert [r.id for r in preview(2, ["id"]).collect()] == ids
        # The footer's two reads, then one of the 8 row groups' columns.
        assert {f for f, _ in read} == {file} and len(read) <= 4
    for limit in (0, 1 << 30):  # by a scan of the files that hold the rows; by the driver
        monkeypatch.setattr(table, "PREVIEW_BYTES", limit)
        assert [r.id for r in data.head(42, ["id"]).collect()] == list(range(42)) and [r.id for r in data.tail(50, ["id"]).collect()] == list(range(70, 120))
    monkeypatch.setattr(table, "PREVIEW_BYTES", 0)
    plan = data.head(2, ["id"])._jdf.queryExecution().toString()
    assert "ReadSchema: struct<id:bigint,_tmp_metadata_row_index:bigint>" in plan


@pytest.mark.parametrize("few", [100, 1])
def test_folders_with_columns_in_their_names(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(table, "FEW", few)
    path = f"{tmp_path}/by k.parquet"
    spark.range(90).selectExpr("id", "int(id / 30) AS k").repartition(1).sortWithinPartitions("id").write.partitionBy("k").parquet(path)
    data = api.Dataset(spark, path)
    assert [(n, t) for n, t, _ in data.fields] == [("id", "int64"), ("k", "int32")] and data.num_columns == 2 and data.num_rows == 90
    assert {r["__ordinal"]: (r.id, r.k) for r in data.numbered().collect()} == {i: (i, i // 30) for i in range(90)}
    assert [tuple(r) for r in data.head(32).collect()] == [(i, i // 30) for i in range(32)]
    assert [tuple(r) for r in data.tail(3).collect()] == [(87, 2), (88, 2), (89, 2)]
    paths, rows = data.split(f"{tmp_path}/s-%d.parquet", file_count=4)
    assert rows == 90 and [r.id for p in paths for r in api.Dataset(spark, p).frame.collect()] == list(range(90))
    out = f"{tmp_path}/one.parquet"
    data.convert(out)
    assert [tuple(r) for r in api.Dataset(spark, out).head(90).collect()] == [(i, i // 30) for i in range(90)]


@pytest.mark.parametrize("few", [100, 1])
def test_names_that_urls_encode(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(table, "FEW", few)
    folder = tmp_path / "odd.parquet"
    folder.mkdir()
    for k, name in enumerate(["a b.parquet", "a+b.parquet", "a%20c.parquet"]):
        pq.write_table(pa.table({"id": [k]}), folder / name)
    data = api.Dataset(spark, str(folder))
    in_order = [r.id for r in data.head(3).collect()]
    assert sorted(in_order) == [0, 1, 2] and [r.id for r in data.tail(3).collect()] == in_order
    assert {r["__ordinal"]: r.id for r in data.numbered().collect()} == dict(enumerate(in_order))


def test_csv_splits_unless_a_cell_holds_a_line_break(spark, tmp_path):
    (tmp_path / "plain.csv").write_text('a,b\n1,"x, ""y"""\n' + "2,z\n" * 50)
    (tmp_path / "broken.csv").write_text('a,b\n1,"x\ny"\n2,z\n')
    assert csv.splittable(spark, f"{tmp_path}/plain.csv") and not csv.splittable(spark, f"{tmp_path}/broken.csv")
    assert api.Dataset(spark, f"{tmp_path}/plain.csv").head(1).collect()[0].b == 'x, "y"'
    assert [r.b for r in api.Dataset(spark, f"{tmp_path}/broken.csv").frame.collect()] == ["x\ny", "z"]


def test_metadata(spark, tmp_path):
    schema = pa.schema([pa.field("id", pa.int64(), nullable=False), pa.field("meta", pa.struct([("x", pa.int64()), ("y", pa.string())]))])
    pq.write_table(pa.table({"id": [1, 2, 3], "meta": [{"x": 1, "y": "a"}] * 3}, schema), tmp_path / "n.parquet", compression="gzip")
    data = api.Dataset(spark, f"{tmp_path}/n.parquet")
    found = data.metadata()
    assert found["num_columns"] == 2 and found["num_physical_columns"] == 3 and found["num_rows"] == 3 and found["compression"] == "GZIP"
    assert "num_rows" not in data.metadata(fast=True) and "created_by" in found
    assert data.schema_info()[0] == {"name": "id", "type": "int64", "nullable": False}


def test_csv_types(spark, tmp_path):
    rows = ["i,b,d,ts,f,s,n,mixed,hour", "1,true,2024-01-02,2024-01-02 03:04:05,1.5,x,,1,10:00", '007,False,NA,2024-01-03,1e5,"a,""b""\nc",NULL,zz,11:00', "NA,,2024-02-03,,inf,NA,,2,12:30"]
    (tmp_path / "t.csv").write_text("\n".join(rows) + "\n")
    data = api.Dataset(spark, f"{tmp_path}/t.csv")
    assert {n: t for n, t, _ in data.fields} == {"i": "int64", "b": "bool", "d": "date32[day]", "ts": "timestamp[s]", "f": "double", "s": "string", "n": "null", "mixed": "string", "hour": "string"}
    found = data.frame.collect()
    assert [r.i for r in found] == [1, 7, None] and found[1].s == 'a,"b"\nc' and found[2].s == "NA" and found[0].d == date(2024, 1, 2)
    assert found[0].ts == datetime(2024, 1, 2, 3, 4, 5) and found[2].f == float("inf") and data.num_rows == 3


def test_csv_types_are_found_only_where_needed(spark, tmp_path, monkeypatch):
    (tmp_path / "t.csv").write_text("a,b\n1,x\n2,y\n")
    monkeypatch.setattr(csv, "typed", lambda raw: pytest.fail("all values were read for their types"))
    data = api.Dataset(spark, f"{tmp_path}/t.csv")
    assert data.num_columns == 2 and data.num_rows == 2 and data.metadata(fast=True)["num_columns"] == 2


def test_csv_errors_and_separators(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    with pytest.raises(ValueError, match="Empty CSV file"):
        _ = api.Dataset(spark, f"{tmp_path}/empty.csv").frame
    (tmp_path / "twice.csv").write_text("a,a\n1,2\n")
    with pytest.raises(ValueError, match="Duplicate column names"):
        _ = api.Dataset(spark, f"{tmp_path}/twice.csv").frame
    (tmp_path / "only.csv").write_text("a,b\n")
    assert api.Dataset(spark, f"{tmp_path}/only.csv").head().columns == ["a", "b"]
    (tmp_path / "x.tsv").write_text("id\tname\n1\talice\n")
    assert api.Dataset(spark, f"{tmp_path}/x.tsv").head().collect()[0].name == "alice"
    (tmp_path / "p.csv").write_text("id|name\n1|bob\n")
    assert api.Dataset(spark, f"{tmp_path}/p.csv", delimiter="|").head().collect()[0].name == "bob"


def test_xlsx(spark, tmp_path):
    assert xlsx.headers([" a ", None, "a", "", "a"]) == ["a", "column_2", "a_2", "column_4", "a_3"]
    rows = [[1, 1, True, datetime(2024, 5, 6, 7, 8, 9), None], [2, 2.5, False, datetime(2024, 1, 1), "x"], [3, None, None, None, 4]]
    data, n = files.workbook(["i", "f", "b", "t", "m"], rows)
    assert n == 3
    (tmp_path / "w.xlsx").write_bytes(data)
    found = api.Dataset(spark, f"{tmp_path}/w.xlsx")
    assert [t for _, t, _ in found.fields] == ["int64", "double", "bool", "timestamp[us]", "string"]
    assert found.frame.collect()[0].t == datetime(2024, 5, 6, 7, 8, 9) and found.frame.collect()[2].m == "4"
    for sheet, message in (("7", "out of range"), ("none", "not found")):
        with pytest.raises(Exception, match=message):
            _ = api.Dataset(spark, f"{tmp_path}/w.xlsx", sheet=sheet).frame
    assert api.Dataset(spark, f"{tmp_path}/w.xlsx", sheet="Sheet1").num_rows == 3
    late = files.workbook(["v"], [[i] for i in range(1000)] + [["late"]])[0]
    (tmp_path / "late.xlsx").write_bytes(late)
    assert api.Dataset(spark, f"{tmp_path}/late.xlsx").fields[0][1] == "int64"
    with pytest.raises(Exception, match="row 1002, column v"):
        api.Dataset(spark, f"{tmp_path}/late.xlsx").frame.collect()


@pytest.mark.parametrize("target", ["o.parquet", "o.csv", "o.tsv", "o.xlsx"])
@pytest.mark.parametrize("source", ["parquet", "csv", "xlsx"])
def test_convert(spark, sample, source, target):
    data = api.Dataset(spark, f"{sample}/sample.{source}")
    out = f"{sample}/new/{target}"
    assert data.convert(out, ["name", "grams"]) == 5
    assert [tuple(r) for r in api.Dataset(spark, out).frame.collect()] == list(zip(NAMES, SAMPLE["grams"].to_pylist(), strict=True))
    with pytest.raises(FileExistsError, match="already exists"):
        data.convert(out)
    assert data.convert(out, force=True) == 5
    assert sorted(p.name for p in (sample / "new").iterdir() if not p.name.endswith(".crc")) == [target]


def test_texts_are_quoted_in_csv(spark, tmp_path):
    rows = pa.table({"a": [1, None], "t": ['x "y", z', ""], "d": [0.5, 2.0], "b": [True, None], "n": [None, "line\nbreak"], "day": [date(2024, 1, 2), None]})
    pq.write_table(rows, tmp_path / "r.parquet")
    data = api.Dataset(spark, f"{tmp_path}/r.parquet")
    data.convert(f"{tmp_path}/r.csv")
    assert (tmp_path / "r.csv").read_text() == '"a","t","d","b","n","day"\n1,"x ""y"", z",0.5,true,,2024-01-02\n,"",2.0,,"line\nbreak",\n'
    paths, n = data.split(f"{tmp_path}/r-%d.tsv", record_count=1)
    assert n == 2 and [open(p).read() for p in paths] == ['"a"\t"t"\t"d"\t"b"\t"n"\t"day"\n1\t"x ""y"", z"\t0.5\ttrue\t\t2024-01-02\n', '"a"\t"t"\t"d"\t"b"\t"n"\t"day"\n\t""\t2.0\t\t"line\nbreak"\t\n']
    pq.write_table(pa.table({"s": [{"x": 1}]}), tmp_path / "s.parquet")
    with pytest.raises(ValueError, match="cannot be written as text"):
        api.Dataset(spark, f"{tmp_path}/s.parquet").convert(f"{tmp_path}/s.csv")


@pytest.mark.parametrize("kind", ["parquet", "csv", "tsv"])
def test_folders_as_outputs(spark, sample, kind, monkeypatch):
    monkeypatch.setattr(files, "PART_ROWS", 3)
    out = f"{sample}/many.{kind}/"
    assert api.merge_files(spark, [f"{sample}/sample.parquet", f"{sample}/sample.csv"], out) == 10
    assert len([p for p in (sample / f"many.{kind}").iterdir() if p.name.startswith("part-")]) == 4
    again = api.Dataset(spark, out)
    assert sorted(r.id for r in again.frame.collect()) == sorted([1, 2, 3, 4, 5] * 2) and again.num_rows == 10
    if kind == "parquet":
        assert [r["id"] for r in again.head(10).collect()] == [1, 2, 3, 4, 5] * 2
    with pytest.raises(FileExistsError):
        api.Dataset(spark, f"{sample}/sample.parquet").convert(out)
    with pytest.raises(ValueError, match="also an input"):
        again.convert(out, force=True)
    with pytest.raises(ValueError, match="one file"):
        again.convert(f"{sample}/x.xlsx/")


def test_progress_during_a_job(spark, monkeypatch):
    seen = []
    with files.reported(spark, lambda *x: seen.append(x), 800):
        spark.range(0, 24, 1, 24).rdd.map(lambda x: __import__("time").sleep(1)).count()
    assert seen and all(0 < done < 800 and total == 800 for done, total in seen) and seen == sorted(seen)


def test_convert_keeps_codec_and_refuses(spark, sample):
    pq.write_table(SAMPLE, sample / "g.parquet", compression="gzip")
    data = api.Dataset(spark, f"{sample}/g.parquet")
    data.convert(f"{sample}/h.parquet")
    assert api.Dataset(spark, f"{sample}/h.parquet").codecs == ["GZIP"]
    with pytest.raises(ValueError, match="Unsupported output"):
        data.convert(f"{sample}/h.json")
    with pytest.raises(ValueError, match="also an input"):
        data.convert(f"{sample}/g.parquet", force=True)


@pytest.mark.parametrize("how, sizes", [({"file_count": 4}, [2, 1, 1, 1]), ({"record_count": 2}, [2, 2, 1]), ({"record_count": 9}, [5])])
@pytest.mark.parametrize("kind", ["parquet", "csv"])
def test_split(spark, sample, kind, how, sizes):
    pattern = f"{sample}/part-%02d.{kind}"
    seen = []
    paths, rows = api.Dataset(spark, f"{sample}/sample.{kind}").split(pattern, progress=lambda *x: seen.append(x), **how)
    assert rows == 5 and seen[-1] == (5, 5) and paths == [pattern % i for i in range(len(sizes))]
    found = [[r.id for r in api.Dataset(spark, p).frame.collect()] for p in paths]
    assert [len(f) for f in found] == sizes and sum(found, []) == [1, 2, 3, 4, 5]


def test_split_errors(spark, sample):
    data = api.Dataset(spark, f"{sample}/sample.parquet")
    for how, message in (({}, "must be specified"), ({"file_count": 1, "record_count": 1}, "mutually exclusive"), ({"file_count": 0}, "must be positive"), ({"file_count": 6}, "exceed total"), ({"record_count": 0}, "must be positive")):
        with pytest.raises(ValueError, match=message):
            data.split(f"{sample}/s-%d.parquet", **how)
    with pytest.raises(ValueError, match="Invalid output pattern"):
        data.split(f"{sample}/s.parquet", file_count=1)
    (sample / "s-1.parquet").write_text("")
    with pytest.raises(FileExistsError):
        data.split(f"{sample}/s-%d.parquet", file_count=2)
    assert not (sample / "s-0.parquet").exists()
    pq.write_table(SAMPLE.slice(0, 0), sample / "none.parquet")
    for how in ({"file_count": 1}, {"record_count": 1}):
        with pytest.raises(ValueError, match="Cannot split empty file"):
            api.Dataset(spark, f"{sample}/none.parquet").split(f"{sample}/n-%d.parquet", **how)


def test_failed_commit_leaves_nothing(spark, sample, monkeypatch):
    real = storage.Storage.move

    def broken(self, source, target):
        if target.endswith("/f-1.parquet") and "__chunk" in source:
            raise OSError("no space")
        real(self, source, target)

    monkeypatch.setattr(storage.Storage, "move", broken)
    data = api.Dataset(spark, f"{sample}/sample.parquet")
    with pytest.raises(OSError):
        data.split(f"{sample}/f-%d.parquet", file_count=3)
    assert not [p for p in sample.iterdir() if "f-" in p.name and not p.name.endswith(".crc")]
    # With force, what stood there comes back.
    before = {f"f-{i}.parquet": f"old {i}" for i in range(3)}
    for name, content in before.items():
        (sample / name).write_text(content)
    with pytest.raises(OSError):
        data.split(f"{sample}/f-%d.parquet", file_count=3, force=True)
    assert {p.name: p.read_text() for p in sample.iterdir() if "f-" in p.name and not p.name.endswith(".crc")} == before
    monkeypatch.undo()
    data.split(f"{sample}/f-%d.parquet", file_count=3, force=True)
    assert sorted(p.name for p in sample.iterdir() if "f-" in p.name and not p.name.endswith(".crc")) == sorted(before)


def test_merge(spark, sample):
    out = f"{sample}/m.parquet"
    assert api.merge_files(spark, [f"{sample}/sample.csv", f"{sample}/sample.parquet"], out) == 10
    assert [r.id for r in api.Dataset(spark, out).frame.collect()] == [1, 2, 3, 4, 5] * 2
    pq.write_table(SAMPLE.select(["id", "name"]), sample / "other.parquet")
    for inputs in (["sample.csv", "other.parquet"],):
        with pytest.raises(ValueError, match="Incompatible schemas"):
            api.merge_files(spark, [f"{sample}/{i}" for i in inputs], f"{sample}/no.parquet")
    assert not (sample / "no.parquet").exists()
    with pytest.raises(ValueError, match="At least one input"):
        api.merge_files(spark, [], out)
    with pytest.raises(FileExistsError):
        api.merge_files(spark, [f"{sample}/sample.csv"], out)


def test_merge_types(spark):
    from tessera.operators.merge import merge

    a = spark.range(2).select(F.col("id").cast("int").alias("v"))
    with pytest.raises(ValueError, match="column v is int32 and int64"):
        merge([a, spark.range(2).select(F.col("id").alias("v"))])
    assert merge([spark.range(1).select(F.lit(None).alias("v")), a]).schema["v"].dataType.simpleString() == "int"
