"""The command line and the registered queries."""

import json

import duckdb
import pytest

import __spark_entry__ as registered
from tessera import cli, queries

SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def files(tmp_path):
    (tmp_path / "a.csv").write_text("id,name,score\n1,alice,10\n2,bob,20\n")
    (tmp_path / "b.csv").write_text("id,name,score\n2,bobby,25\n3,carol,30\n")
    return tmp_path


def run(spark, capsys, *args):
    code = cli.main(list(map(str, args)), spark)
    out = capsys.readouterr()
    return code, out.out, out.err


def test_count_schema_head(spark, capsys, files):
    assert run(spark, capsys, "count", files / "a.csv", "-o", "plain")[:2] == (0, "2\n")
    assert json.loads(run(spark, capsys, "--output", "json", "count", files / "a.csv")[1]) == {"count": 2}
    assert run(spark, capsys, "schema", files / "a.csv", "-o", "plain")[1].splitlines()[1] == "id\tint64\tTrue"
    assert json.loads(run(spark, capsys, "head", files / "a.csv", "-n", 1, "-c", "name, id", "-o", "json")[1]) == {"rows": [{"name": "alice", "id": 1}]}
    assert "bob" in run(spark, capsys, "tail", files / "a.csv")[1]
    assert "input_format" in run(spark, capsys, "meta", files / "a.csv", "--fast")[1]


def test_stats_diff_merge_split_convert(spark, capsys, files):
    code, out, _ = run(spark, capsys, "stats", files / "a.csv", "-o", "plain")
    assert code == 0 and out.splitlines()[0] == "name\ttype\tcount\tnull_count\tmin\tmax\tmean\tcardinality\ttop_values"
    assert run(spark, capsys, "diff", files / "a.csv", files / "b.csv", "--key", "id", "-o", "plain")[1].splitlines() == ["row_count_delta\t0", "only_left_count\t1", "only_right_count\t1", "changed_count\t1"]
    assert "changed_rows" in run(spark, capsys, "diff", files / "a.csv", files / "b.csv", "--key", "id")[1]
    assert json.loads(run(spark, capsys, "merge", files / "a.csv", files / "b.csv", files / "m.csv", "-o", "json")[1])["total_rows"] == 4
    assert "total_rows\t4" in run(spark, capsys, "convert", files / "m.csv", files / "m.parquet", "-o", "plain")[1]
    found = json.loads(run(spark, capsys, "split", files / "m.parquet", "-f", 2, "-n", f"{files}/s-%d.csv", "-o", "json")[1])
    assert found["output_files"] == [f"{files}/s-0.csv", f"{files}/s-1.csv"]
    assert "Split Complete" in run(spark, capsys, "split", files / "m.parquet", "-r", 3, "-n", f"{files}/r-%d.parquet")[1]


def test_errors(spark, capsys, files):
    assert "File not found" in run(spark, capsys, "count", files / "x.csv", "-o", "plain")[2]
    assert run(spark, capsys, "split", files / "a.csv")[0] == 1
    assert "Provide at least one input" in run(spark, capsys, "merge", files / "a.csv")[1]
    assert json.loads(run(spark, capsys, "convert", files / "a.csv", files / "b.csv", "-o", "json")[2])["error"].startswith("Output file already exists")
    assert cli.main([]) == 0


def test_plain_output_keeps_one_line(spark, capsys, files):
    (files / "t.csv").write_text('id,text\n1,"a\tb\nnext"\n')
    assert run(spark, capsys, "head", files / "t.csv", "-o", "plain")[1] == "id\ttext\n1\ta\\tb\\nnext\n"


@pytest.fixture(scope="module")
def duck():
    found = duckdb.connect()
    for t in queries.TABLES:
        found.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return found


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query_matches_sql(spark, duck, name):
    found = queries.QUERIES[name](spark, SMALL)
    columns = sorted(found.columns)
    got = sorted(str(tuple(r[c] for c in columns)) for r in found.collect())
    if name in queries.SQL:
        picked = ", ".join(f'"{c}"' for c in columns)
        assert got == sorted(map(str, duck.sql(f"SELECT {picked} FROM ({queries.SQL[name]})").fetchall()))
    assert queries.QUERIES.keys() <= registered.queries().keys()


def test_entry(spark):
    assert registered.entry(spark).count() == 11
