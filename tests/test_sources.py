from __future__ import annotations

import pytest
from pyspark.sql import types as T

from tallyspark.session import work_dir
from tallyspark.sources.quarantine import load_csv
from tallyspark.sources import files, results, tables
from tallyspark.sources.versioned import VersionedDataset
from tallyspark.streaming.landing import ingest_landing
from tests.conftest import rows


@pytest.fixture
def folder(spark):
    path = work_dir(spark, "test")
    files.write_text(spark, f"{path}/a.csv", "id,name,day\n1,x,2023-01-05\n2,,2023-01-06\n")
    files.write_text(spark, f"{path}/b.csv", "name,id\ny,3\n")
    files.write_text(spark, f"{path}/empty.csv", "id,name\n")
    files.write_text(spark, f"{path}/note.txt", "no table")
    return path


def test_csv_types_are_inferred(spark, folder):
    df = tables.read_csv(spark, f"{folder}/a.csv")
    assert [t for _, t in df.dtypes] == ["int", "string", "date"] and df.count() == 2


def test_files_are_matched_by_name(spark, folder):
    df = tables.read_csv(spark, [f"{folder}/a.csv", f"{folder}/b.csv"])
    assert [(r["id"], r["name"]) for r in df.orderBy("id").collect()] == [(1, "x"), (2, None), (3, "y")]


def test_explicit_schema_is_checked_against_the_header(spark, folder):
    schema = T.StructType.fromDDL("id long, name string, day date")
    assert tables.read_csv(spark, f"{folder}/a.csv", schema).dtypes[0] == ("id", "bigint")
    with pytest.raises(Exception):
        tables.read_csv(spark, f"{folder}/a.csv", T.StructType.fromDDL("name string, id long, day date")).collect()


def test_missing_source_fails_before_reading(spark, folder):
    with pytest.raises(FileNotFoundError, match="gone.csv"):
        tables.read_csv(spark, [f"{folder}/a.csv", f"{folder}/gone.csv"])


def test_catalogue(spark, folder):
    found = tables.register_tables(spark, folder)
    assert sorted(found) == ["a", "b", "empty"]
    assert spark.sql("SELECT count(*) FROM a").first()[0] == 2
    assert rows(tables.catalogue(found).drop("analysis_timestamp")) == [
        ("a", 2, 3, "analyzed"),
        ("b", 1, 2, "analyzed"),
        ("empty", 0, 0, "empty_file"),
    ]


def test_column_catalogue(spark, folder):
    found = tables.column_catalogue(tables.register_tables(spark, folder))
    assert [(r["table_name"], r["column_name"], r["missing_count"]) for r in found.orderBy("table_name", "column_name").collect()] == [
        ("a", "day", 0),
        ("a", "id", 0),
        ("a", "name", 1),
        ("b", "id", 0),
        ("b", "name", 0),
        ("empty", "id", 0),
        ("empty", "name", 0),
    ]


def test_text_reading_keeps_malformed_lines(spark, folder):
    files.write_text(spark, f"{folder}/odd.csv", "a,b\n1,2\nx\n3,4,5\n")
    df = tables.read_csv_as_text(spark, f"{folder}/odd.csv")
    assert {t for _, t in df.dtypes} == {"string"} and df.count() == 3
    assert rows(df.select("_corrupt_record").where("a IS NOT NULL").na.drop()) == [("3,4,5",), ("x",)]
    assert rows(tables.malformed_lines(df)) == [(3, 2)]
    with pytest.raises(Exception, match="(?i)malformed"):
        tables.read_csv(spark, f"{folder}/odd.csv").count()


def test_csv_dialect(spark):
    folder = work_dir(spark, "test")
    data = [(1, 'he said "hi"\nand, left'), (2, " blank "), (3, "a\r\nb"), (4, "\\"), (5, ""), (6, None)]
    df = spark.createDataFrame(data, "id int, t string")
    tables.write_csv(df, f"{folder}/t.csv")
    assert sorted(map(tuple, tables.read_csv(spark, f"{folder}/t.csv", df.schema, empty_texts=True).collect())) == data
    assert tables.read_csv(spark, f"{folder}/t.csv").where("t IS NULL").count() == 2
    files.write_text(spark, f"{folder}/q.csv", 'id,name\n1,"a ""b"""\n2,"x\ny"\n')
    assert rows(tables.read_csv(spark, f"{folder}/q.csv")) == [(1, 'a "b"'), (2, "x\ny")]


def test_parts_of_a_directory_are_matched_by_name(spark):
    folder = work_dir(spark, "test")
    files.write_text(spark, f"{folder}/t/1.csv", "id,v\n1,10\n")
    files.write_text(spark, f"{folder}/t/2.csv", "v,id\n20,2\n")
    assert rows(tables.read_csv(spark, f"{folder}/t").select("id", "v")) == [(1, 10), (2, 20)]


def test_types_of_files_are_widened(spark):
    folder = work_dir(spark, "test")
    files.write_text(spark, f"{folder}/1.csv", "id,v,w\n007,10,1\n")
    files.write_text(spark, f"{folder}/2.csv", "v,id,w\n2.5,x9,3000000000\n")
    df = tables.read_csv(spark, [f"{folder}/1.csv", f"{folder}/2.csv"])
    assert dict(df.dtypes) == {"id": "string", "v": "double", "w": "bigint"}
    assert rows(df.select("id", "v", "w")) == [("007", 10.0, 1), ("x9", 2.5, 3000000000)]


@pytest.mark.parametrize("file_format", ["parquet", "csv"])
def test_run_and_save(spark, file_format):
    folder = work_dir(spark, "test")
    query = "SELECT 1 AS a, 'x' AS b"
    first = results.run_and_save(spark, query, folder, "some/dir/my.result.csv", file_format=file_format)
    assert first.result_path == f"{folder}/my.result.{file_format}" and rows(first.read()) == [(1, "x")]
    assert spark.read.text(first.sql_path).first()[0] == query
    second = results.run_and_save(spark, query, folder, "my.result", file_format=file_format)
    assert second.result_path != first.result_path and second.read().count() == 1
    assert second.profile.summary().first()["total_rows"] == 1
    assert results.run_and_save(spark, query, folder).result_path.startswith(f"{folder}/result_")


def test_bounded_load(spark):
    small = spark.createDataFrame([(1, "x")], "a int, b string")
    # [{"a": 1, "b": "x"}] has 20 characters
    assert results.load_size(small).first()["json_chars"] == 20
    assert [tuple(r) for r in results.load_bounded(small)] == [(1, "x")]
    with pytest.raises(results.ResultTooLarge) as error:
        results.load_bounded(spark.range(10_000).toDF("a"))
    assert error.value.profile.summary().first()["total_rows"] == 10_000
    assert results.load_bounded(small.limit(0)) == []


def test_result_book(spark):
    book = results.ResultBook(spark, work_dir(spark, "test"), "q1")
    long_name = "a sheet name: far longer than / others"
    book.write_sheet(spark.sql("SELECT 1 AS a"), long_name)
    book.write_sheet(spark.sql("SELECT 'x' AS b, 2 AS c"), "")
    assert sorted(book.sheets()) == sorted(["Sheet1", long_name])
    # A replacement may read what it replaces; the other sheet stays.
    book.write_sheet(book.read_sheet(long_name).selectExpr("a + 1 AS a", "true AS new"), long_name)
    assert rows(book.read_sheet(long_name)) == [(2, True)] and rows(book.read_sheet("")) == [("x", 2)]
    with pytest.raises(FileNotFoundError):
        book.read_sheet("other")


def test_a_sheet_that_comes_back_changed_is_an_error(spark, monkeypatch):
    book = results.ResultBook(spark, work_dir(spark, "test"), "q1")
    read = VersionedDataset.read
    monkeypatch.setattr(VersionedDataset, "read", lambda *args: read(*args).limit(1))
    with pytest.raises(IOError):
        book.write_sheet(spark.range(5), "numbers")
    with pytest.raises(FileNotFoundError):
        book.read_sheet("numbers")


def test_incomplete_version_is_not_read(spark):
    data = VersionedDataset(spark, work_dir(spark, "test"))
    assert data.latest() is None
    data.write({"rows": spark.sql("SELECT 1 AS a")})
    spark.sql("SELECT 2 AS a").write.parquet(f"{data.path}/v00000002/rows")  # a writer that died
    assert data.latest() == "v00000001"
    assert data.write({"rows": spark.sql("SELECT 3 AS a")}) == "v00000003" and data.latest() == "v00000003"


def test_landing_takes_each_file_once(spark):
    base = work_dir(spark, "test")
    schema = T.StructType.fromDDL("id int, name string")

    def run():
        return ingest_landing(spark, f"{base}/in", f"{base}/table", f"{base}/checkpoint", schema)

    files.write_text(spark, f"{base}/in/1.csv", "id,name\n1,a\n2,b\n")
    assert run().count() == 2
    assert run().count() == 2
    files.write_text(spark, f"{base}/in/2.csv", "id,name\n3,c\n")
    assert rows(run()) == [(1, "a"), (2, "b"), (3, "c")]


def test_landing_reads_quotes_and_keeps_what_does_not_fit(spark):
    base = work_dir(spark, "test")
    schema = T.StructType.fromDDL("id int, name string, _corrupt_record string")
    files.write_text(spark, f"{base}/in/1.csv", 'id,name\n1,"a ""b""\nc"\n2,x,extra\n')
    found = ingest_landing(spark, f"{base}/in", f"{base}/table", f"{base}/checkpoint", schema)
    assert [tuple(r) for r in found.orderBy("id").collect()] == [(1, 'a "b"\nc', None), (2, "x", "2,x,extra")]


def test_lines_that_do_not_fit_are_kept_apart(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text('id,name\n1,x\n2,y,extra\n3,"two\nlines"\n4\n')
    (tmp_path / "in" / "b.csv").write_text("id,name\n5,z\n")
    (tmp_path / "in" / "c.csv").write_text("name,amount\nq,1.5\nr\n")
    loaded = load_csv(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert sorted(map(tuple, loaded.rows.collect()), key=str) == sorted([(1, "x", None), (3, "two\nlines", None), (5, "z", None), (None, "q", 1.5)], key=str)
    assert dict(loaded.rows.dtypes) == {"id": "int", "name": "string", "amount": "double"}
    bad = sorted((r["file"].rsplit("/", 1)[1], r["line"].strip()) for r in loaded.bad.collect())
    assert bad == [("a.csv", "2,y,extra"), ("a.csv", "4"), ("c.csv", "r")] and (loaded.n_rows, loaded.n_bad) == (4, 3)
    assert loaded.profile("t").first()["malformed_rows"] == 3


def test_all_lines_good_or_all_bad(spark, tmp_path):
    (tmp_path / "good.csv").write_text("id,name\n1,x\n")
    (tmp_path / "bad.csv").write_text("id,name\nx\n,,\n")
    good = load_csv(spark, str(tmp_path / "good.csv"), str(tmp_path / "g"))
    assert good.rows.count() == 1 and good.bad.count() == 0 and good.bad.columns == ["file", "line"]
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("name", T.StringType())])
    bad = load_csv(spark, str(tmp_path / "bad.csv"), str(tmp_path / "b"), schema)
    assert bad.rows.count() == 0 and bad.n_bad == 2 and bad.rows.schema == schema
    typed = load_csv(spark, str(tmp_path / "good.csv"), str(tmp_path / "t"), T.StructType([T.StructField("id", T.IntegerType()), T.StructField("name", T.DateType())]))
    assert typed.n_bad == 1 and typed.bad.first()["line"] == "1,x"
