import datetime

import pytest
from pyspark.sql import functions as F, types as T

from evenkeel.operators import schema, versioned
from evenkeel.sources import csvfiles, snapshots, tables


def write(tmp_path, text, name="in.csv"):
    path = tmp_path / name
    path.write_bytes(text.encode())
    return str(path)


def test_csv_delimiter_quotes_and_blank_rows(spark, tmp_path):
    path = write(tmp_path, '\n Name ;"a;b";1st;;Name\nx; "say ""hi"" " ;;3\n;;;;\n  \ny;z\r\n')
    df = csvfiles.csv_ingest(spark, path)
    assert df.columns == ["name", "a_b", "col_1st", "column_4", "name_1"]
    rows = sorted(tuple(r) for r in df.collect())
    assert rows == [("x", 'say "hi"', "", "3", ""), ("y", "z", "", "", "")]
    assert all(f.dataType == T.StringType() for f in df.schema.fields)


@pytest.mark.parametrize("line, want", [("a,b;c", ","), ("a;b;c,d", ";"), ("a\tb\tc,d", "\t"), ("a;b\tc", ","), ("abc", ",")])
def test_find_delimiter(line, want):
    assert csvfiles.find_delimiter(line) == want


def test_sanitize_names():
    assert csvfiles.sanitize_names(["A b", "a__B", "", None, "9x", "é", "a b"]) == [
        "a_b", "a_b_1", "column_3", "column_4", "col_9x", "column_6", "a_b_2"]
    assert csvfiles.sanitize_table_name(" 2024 Sales.csv") == "tbl_2024_sales_csv"


def test_csv_export_bytes(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a"b', None, [1])], "id int, t string, n string, l array<int>").coalesce(1)
    csvfiles.csv_export(df, str(tmp_path / "out"))
    part = next((tmp_path / "out").glob("part-*"))
    assert part.read_bytes() == b'"id","t","n","l"\r\n"1","a""b","","[1]"\r\n'


def test_snapshot_pointer(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        snapshots.read_snapshot(spark, path)
    snapshots.write_snapshot(spark.range(3), path)
    snapshots.write_snapshot(snapshots.read_snapshot(spark, path).filter("id > 0"), path)  # reads what it replaces
    assert snapshots.current_version(spark, path) == "v=2" and snapshots.read_snapshot(spark, path).count() == 2
    with pytest.raises(ValueError):
        snapshots.write_snapshot(spark.range(1), path, "v=2")


def test_failed_write_keeps_the_old_snapshot(spark, tmp_path):
    path = str(tmp_path / "t")
    snapshots.write_snapshot(spark.range(3), path)
    with pytest.raises(Exception):
        snapshots.write_snapshot(spark.range(3).select(F.raise_error(F.lit("no")).alias("x")), path)
    assert snapshots.read_snapshot(spark, path).count() == 3


def test_upsert_is_idempotent_and_ignores_late_events(spark, tmp_path):
    path = str(tmp_path / "u")
    schema_ = "k int, v string, version long, ingest_seq long, is_deleted boolean"
    make = lambda rows: spark.createDataFrame(rows, schema_)
    versioned.upsert(spark, path, make([(1, "a", 5, 1, False), (2, "b", 5, 1, False)]), ["k"])
    batch = make([(1, "late", 4, 2, False), (2, "b", 6, 2, True), (3, "c", 1, 2, False)])
    for _ in range(2):
        versioned.upsert(spark, path, batch, ["k"])
    assert sorted((r["k"], r["v"]) for r in versioned.read_upserted(spark, path).collect()) == [(1, "a"), (3, "c")]
    versioned.upsert(spark, path, make([(2, "late", 5, 9, False)]), ["k"])  # older than the delete
    assert sorted((r["k"], r["v"]) for r in versioned.read_upserted(spark, path).collect()) == [(1, "a"), (3, "c")]


@pytest.mark.parametrize("name, pattern, want", [
    ("cdc_Sales", "sales", True), ("cdc_sales", "cdc%", True), ("x_cdc", "cdc%", False), ("a[1]b", "%[1]%", True),
    ("abc", "a?c", False), ("abc", None, True), ("abc", "%b%", True)])
def test_table_pattern(name, pattern, want):
    assert versioned.matches_pattern(name, pattern) is want


def test_queries_must_read():
    assert tables.only_select(" SELECT 1; ") == "SELECT 1"
    assert tables.only_select("WITH a AS (SELECT 'drop it' AS x) SELECT * FROM a")
    for bad in ("DELETE FROM t", "SELECT 1; SELECT 2", "INSERT INTO t SELECT 1", "SELECT 1; DROP TABLE t"):
        with pytest.raises(ValueError):
            tables.only_select(bad)


def test_bind_params():
    sql = "SELECT :a, :b, ':c', x::int, :sys_today"
    got = tables.bind_params(sql, {"a": 1}, {"a": 9, "b": 2}, tables.system_values(datetime.datetime(2024, 1, 2)))
    assert got == {"a": 1, "b": 2, "sys_today": datetime.date(2024, 1, 2)}
    with pytest.raises(ValueError):
        tables.bind_params("SELECT :gone")


def test_unknown_database_type():
    with pytest.raises(ValueError):
        tables.Source(format="jdbc", type="oracle").jdbc_url()


def test_scan_jdbc_in_parallel(spark, tmp_path):
    """Embedded Derby: the database lives in this process and opens no port."""
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    options = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    spark.range(100).select(F.col("id").cast("int").alias("ID"), F.lit("x").alias("V")).write.format("jdbc").options(
        url=url, dbtable="T", **options).save()
    source = tables.Source(format="jdbc", url=url, options=options)
    df = tables.scan(spark, source, table="T", partition_column="ID", partitions=4)
    assert df.rdd.getNumPartitions() == 4 and df.count() == 100
    assert tables.scan(spark, source, query="SELECT ID FROM T WHERE ID < 10;").count() == 10


# ---------------------------------------------------------------- schemas

def test_schema_compare(spark):
    a = spark.createDataFrame([], "id int, name string, amount decimal(10,2), old int")
    b = spark.createDataFrame([], "id int, Name string, amount decimal(12,2), added int")
    left, right = schema.schema_frame(a, "t", ["ID"]), schema.schema_frame(b, "t", ["id"])
    got = {r["name"]: r["status"] for r in schema.schema_compare(left, right).collect()}
    assert got == {"id": "IDENTICAL", "name": "SOURCE_ONLY", "Name": "TARGET_ONLY", "amount": "DIFFERENT",
                   "old": "SOURCE_ONLY", "added": "TARGET_ONLY"}


def test_schema_compare_all_and_auto_map(spark):
    one, two = spark.createDataFrame([], "id int, v string"), spark.createDataFrame([], "id int, v int")
    a = schema.catalog_frame(spark, {"same": (one, ["id"]), "changed": (one, []), "left": (one, [])})
    b = schema.catalog_frame(spark, {"same": (one, ["id"]), "changed": (two, ["v", "id"]), "right": (two, ["id"])})
    got = {r["table_name"]: r["status"] for r in schema.schema_compare_all(a, b).collect()}
    assert got == {"same": "IDENTICAL", "changed": "DIFFERENT", "left": "SOURCE_ONLY", "right": "TARGET_ONLY"}
    pairs = {r["table_name"]: (r["source_table"], r["target_table"], r["keys"]) for r in schema.auto_map(a, b).collect()}
    assert pairs["same"] == ("same", "same", ["id"]) and pairs["changed"] == ("changed", "changed", ["id", "v"])
    assert pairs["left"][1] is None and pairs["right"][:2] == (None, "right")


@pytest.mark.parametrize("name, want", [
    ("BIGINT", "bigint"), ("int4", "int"), ("numeric(12,2)", "decimal(12,2)"), ("numeric", "double"), ("point", "string"),
    ("interval", "string"), ("timestamp", "timestamp_ntz"), ("varchar(20)", "string"), ("double precision", "double"),
    ("decimal(60, 10)", "decimal(38,10)"), ("bytea", "binary"), ("time", "string")])
def test_spark_type(name, want):
    assert schema.spark_type(name) == want


def test_detect_keys():
    assert schema.detect_keys(["A", "b_seq", "x"], ["a", "SEQ"]) == ["A", "b_seq"]
    assert schema.detect_keys(["x", "y"], ["id"]) == ["x"]


def test_evolve_without_source(spark):
    df = spark.createDataFrame([(1, "a", "b")], "id int, v string, gone string")
    got = schema.evolve(df, T.StructType.fromDDL("id long, v string, fresh date"))
    assert got.schema.simpleString() == "struct<id:bigint,v:string,fresh:date>" and got.first()["fresh"] is None


def test_landing_schema_names_what_is_missing(spark):
    df = spark.createDataFrame([], "SEQ long, kode_data string, detail_data string")
    assert schema.check_landing_schema(df) == ["input_by", "input_dt"]
