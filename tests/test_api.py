"""Reads, writes, metadata and streams through Spark."""

import datetime as d
import os
import pathlib
from decimal import Decimal

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import yxspark as y
from yxspark.functions import wkb_to_shp


@pytest.fixture(scope="module")
def people(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("people") / "people")
    df = spark.range(1, 201).select(
        F.col("id").alias("PersonId"), F.concat(F.lit("Name"), F.col("id").cast("string")).alias("FirstName"), F.when(F.col("id") % 4 != 0, (18 + F.col("id") % 58).cast("int")).alias("Age"),
        (F.col("id") % 2 == 0).alias("Active"), F.expr("date_add(DATE'2020-01-01', int(id))").alias("JoinDate"), F.when(F.col("id") % 3 == 0, F.lit("nöte")).alias("Notes"),
    )
    y.write_yxdb(df, at)
    return at


def test_read(spark, people):
    df = y.read_yxdb(people, spark=spark)
    assert df.count() == 200 and df.where("Age is null").count() == 50
    assert df.schema["JoinDate"].dataType == T.DateType() and df.schema["Notes"].metadata["yxdb.type"] == "V_String"
    assert df.agg(F.sum("PersonId")).first()[0] == 20_100
    assert y.scan(pathlib.Path(people), spark=spark).where("Active").count() == 100


def test_projection(spark, people):
    df = y.read_yxdb_columns(people, ["Age", "PersonId"], spark=spark)
    assert df.columns == ["Age", "PersonId"]
    scan = df._jdf.queryExecution().executedPlan().toString()
    assert "FirstName" not in scan
    for bad in (["Nope"], [], ["Age", "Age"]):
        with pytest.raises(ValueError):
            y.read_yxdb_columns(people, bad, spark=spark)


def test_limit(spark, people):
    for n in (0, 1, 7, 200, 500):
        assert y.read_yxdb(people, n_rows=n, spark=spark).count() == min(n, 200)
        assert sum(t.num_rows for t in y.read_yxdb_batches(people, 64, n_rows=n)) == min(n, 200)
    with pytest.raises(ValueError):
        y.read_yxdb(people, n_rows=-1, spark=spark)


def test_metadata(people):
    assert y.record_count(people) == 200
    assert [f.type for f in y.read_yxdb_fields(people)] == ["Int64", "V_String", "Int32", "Bool", "Date", "V_String"]
    assert y.read_schema(people)[1] == {"name": "FirstName", "type": "V_String", "size": 7, "scale": 0}
    assert y.read_spatial_info(people)["has_spatial_index"] is False


def test_batches_and_cursor(people):
    tables = list(y.read_yxdb_batches(people, 64, columns=["PersonId"]))
    assert [t.num_rows for t in tables] == [64, 64, 64, 8]
    with pytest.raises(ValueError):
        y.read_yxdb_batches(people, 0)
    with y.YxdbRowReader(people, textual=True) as rows:
        with pytest.raises(TypeError):
            rows.read_index(0)
        assert rows.next() and rows.num_records == 200
        first = rows.read_dict()
        assert isinstance(first["JoinDate"], str) and rows.read_name("PersonId") == rows.read_index(0)
        for bad in (lambda: rows.read_name("x"), lambda: rows.read_index(99)):
            with pytest.raises(TypeError):
                bad()
        assert 1 + sum(1 for _ in rows) == 200
    with pytest.raises(ValueError):
        rows.next()


def test_handover(spark, people, tmp_path):
    table = y.read_yxdb_arrow(people, spark=spark)
    assert table.num_rows == 200 and len(y.read_yxdb_pandas(people, spark=spark)) == 200
    y.write_yxdb_arrow(table, tmp_path / "a", spark=spark)
    y.write_yxdb_ipc(y.read_yxdb_ipc(people, spark=spark), tmp_path / "b", spark=spark)
    assert y.record_count(tmp_path / "a") == y.record_count(tmp_path / "b") == 200
    assert sum(pa.ipc.open_stream(b).read_all().num_rows for b in y.read_yxdb_ipc_batches(people, 50)) == 200


def test_single_file_and_order(spark, tmp_path):
    at = str(tmp_path / "one.yxdb")
    y.write_yxdb(spark.range(50_000).select((F.col("id") + 1).cast("int").alias("Id"), (F.col("id") * 1.5).alias("Value"), F.format_string("row_%05d", F.col("id")).alias("Label")), at, single_file=True)
    assert os.path.isfile(at) and y.detect_format(at) == "E1"
    df = y.read_yxdb(at, spark=spark, recordIndex="true")
    assert df.where("_record_index = 99").first().Id == 100 and df.agg(F.sum("Id")).first()[0] == 1_250_025_000
    assert 535_000 * 0.9 < os.path.getsize(at) < 535_000 * 1.6


def test_splits(spark, tmp_path):
    at = str(tmp_path / "many.yxdb")
    y.write_yxdb(spark.range(200_000), at, single_file=True)
    df = y.read_yxdb(at, spark=spark, splitBytes=1)
    assert df.rdd.getNumPartitions() == 4 and df.agg(F.sum("id"), F.count("id")).first()[:] == (200_000 * 199_999 // 2, 200_000)


def test_empty_tables(spark, tmp_path):
    at = str(tmp_path / "none")
    y.write_yxdb(spark.range(0), at)
    assert y.record_count(at) == 0 and y.read_yxdb(at, spark=spark).collect() == [] and list(y.read_yxdb_batches(at)) == []


def test_modes(spark, tmp_path):
    at = str(tmp_path / "m")
    y.write_yxdb(spark.range(3), at)
    y.write_yxdb(spark.range(4), at, mode="append")
    assert y.record_count(at) == 7
    y.write_yxdb(spark.range(2), at)
    assert y.record_count(at) == 2
    with pytest.raises(FileExistsError):
        y.write_yxdb(spark.range(2), at, mode="error")
    y.write_yxdb(spark.range(5), at, mode="ignore")
    assert y.record_count(at) == 2
    with pytest.raises(ValueError):
        y.write_yxdb(spark.range(2), at, mode="merge")


def test_overrides(spark, tmp_path):
    df = spark.createDataFrame([(1, "abcdé", 2.345)], "i long, s string, x double")
    at = str(tmp_path / "o")
    y.write_yxdb_with_overrides(df, at, {"i": {"type": "Byte"}, "s": {"type": "String", "size": 5}, "x": {"type": "FixedDecimal", "size": 10, "scale": 2}})
    row = y.read_yxdb(at, spark=spark).first()
    assert row.i == 1 and row.s == "abcd" and row.x == Decimal("2.35")
    for bad in ({"i": {}}, {"i": {"type": "Nope"}}, {"nope": {"type": "Int16"}}):
        with pytest.raises(ValueError):
            y.write_yxdb_with_overrides(df, at, bad)


def test_rejected(spark, tmp_path):
    at = str(tmp_path / "r")
    for sql in ("SELECT array(1) AS a", "SELECT map(1, 2) AS m", "SELECT named_struct('x', 1) AS s", "SELECT interval 1 day AS i", "SELECT null AS n"):
        with pytest.raises(TypeError):
            y.write_yxdb(spark.sql(sql), at)
    with pytest.raises(ValueError):
        y.write_yxdb(spark.createDataFrame([(1,)], T.StructType([T.StructField("", T.IntegerType())])), at)
    with pytest.raises(TypeError):
        y.write_yxdb([1, 2], at)


def test_string_kinds(spark, tmp_path):
    at = str(tmp_path / "s")
    y.write_yxdb(spark.createDataFrame([("ÿ", "Ā", "", None), ("ab", "😀", "", None)], "narrow string, wide string, empty string, none string"), at)
    assert [(f.type, f.size) for f in y.read_yxdb_fields(at)] == [("V_String", 2), ("V_WString", 2), ("V_String", 1), ("V_String", 1)]


def test_source_by_name(spark, tmp_path):
    y.session(spark)
    at = str(tmp_path / "n")
    df = spark.createDataFrame([(1, "x", d.datetime(2020, 1, 1, 1, 1, 1, 999_999))], "a int, b string, t timestamp_ntz")
    df.write.format("yxdb").mode("overwrite").option("blockCompression", "none").save(at)
    df.write.format("yxdb").mode("append").option("typeOverrides", '{"b": {"type": "WString", "size": 4}}').save(at)
    assert [tuple(r) for r in spark.read.format("yxdb").load(at).collect()] == [(1, "x", d.datetime(2020, 1, 1, 1, 1, 1))] * 2


def test_geometry_columns(spark, tmp_path):
    import struct

    point = struct.pack("<BIdd", 1, 1, 1.0, 2.0)
    at = str(tmp_path / "g")
    y.write_yxdb(spark.createDataFrame([(1, bytearray(point)), (2, None), (3, bytearray())], "i int, geom binary"), at, spatial_columns=["geom"])
    assert y.read_spatial_info(at)["spatial_columns"] == ["geom"]
    assert {r.i: r.geom and bytes(r.geom) for r in y.read_yxdb(at, spark=spark).collect()} == {1: point, 2: None, 3: None}
    assert {bytes(r.geom) for r in y.read_yxdb(at, spark=spark, spatial="raw").where("i = 1").collect()} == {wkb_to_shp(point)}
    field = y.read_yxdb_geoarrow(at, spark=spark).schema.field("geom")
    assert field.metadata[b"ARROW:extension:name"] == b"geoarrow.wkb"
    with pytest.raises(ValueError):
        y.read_yxdb(at, spatial="wkt", spark=spark)
    with pytest.raises(ImportError):
        y.read_yxdb_geo(at)


def test_batch_writer(tmp_path):
    at = tmp_path / "b.yxdb"
    t = pa.table({"a": pa.array([1, 2], pa.int32()), "s": ["x", None]})
    assert y.write_yxdb_batches(at, [t.slice(0, 0), t, t.slice(0, 0), t]) == 4
    assert [r["a"] for b in y.read_yxdb_batches(at) for r in b.to_pylist()] == [1, 2, 1, 2]
    with pytest.raises(ValueError):
        y.write_yxdb_batches(tmp_path / "none.yxdb", [])
    with pytest.raises(RuntimeError):
        with y.YxdbWriter(tmp_path / "gone.yxdb") as w:
            w.write(t)
            raise RuntimeError
    assert not (tmp_path / "gone.yxdb").exists()


def test_stream(spark, tmp_path):
    a, b, marks = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "marks")
    y.write_yxdb(spark.range(10), a)
    y.write_stream(y.read_stream(a, spark=spark), b, marks).awaitTermination()
    y.write_yxdb(spark.range(10, 15), a, mode="append")
    y.write_stream(y.read_stream(a, spark=spark), b, marks).awaitTermination()
    assert sorted(r.id for r in y.read_yxdb(b, spark=spark).collect()) == list(range(15))


def test_filters(spark, tmp_path):
    """The scan's filters against Spark's, over nulls, NaN and texts; a filter leaves other reads of the file alone."""
    rows = [(i, None if i % 5 == 0 else i % 7, float("nan") if i % 11 == 0 else None if i % 13 == 0 else i / 2, None if i % 3 == 0 else f"t{i % 10}é", i % 2 == 0) for i in range(500)]
    df = spark.createDataFrame(rows, "i long, s short, d double, t string, b boolean").coalesce(1)
    at = str(tmp_path / "f")
    y.write_yxdb(df, at)
    whole = y.read_yxdb(at, spark=spark)
    cases = [
        ([("i", ">=", 490)], "i >= 490"), ([("s", "=", 3), ("b", "=", True)], "s = 3 AND b"), ([("s", "!=", 3)], "s != 3"), ([("d", ">", 100)], "d > 100"), ([("d", "<=", 1.5)], "d <= 1.5"), ([("t", "in", ["t1é", "t2é", "no"])], "t IN ('t1é', 't2é', 'no')"),
        ([("t", "starts with", "t4")], "t LIKE 't4%'"), ([("t", "contains", "é")], "t LIKE '%é%'"), ([("t", "ends with", "x")], "t LIKE '%x'"), ([("s", "is null", None), ("d", "is not null", None)], "s IS NULL AND d IS NOT NULL"), ([("i", "<", 0)], "i < 0"), ([("d", "!=", 2)], "d != 2"),
    ]
    for found, sql in cases:
        for columns in (None, ["b", "t"]):
            a, b = y.read_yxdb(at, spark=spark, filters=found, columns=columns), whole.where(sql).select(*(columns or whole.columns))
            assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect())), sql
    assert whole.count() == 500
    for bad in ([("x", "=", 1)], [("i", "=", "a")], [("i", "like", 1)], [("i", "=", 1 << 70)], [("b", "starts with", "t")]):
        with pytest.raises(ValueError):
            y.read_yxdb(at, spark=spark, filters=bad)
    with pytest.raises(ValueError):
        y.read_yxdb(at, spark=spark, filters=[("i", "=", 1)], n_rows=3)


def test_commit_is_seen_whole(spark, tmp_path):
    """From the journal on readers see the new files and none of the old; the next write ends what one began."""
    import json

    from yxspark.codec import files

    at = str(tmp_path / "c")
    y.write_yxdb(spark.range(3).coalesce(1), at)
    (old,) = [p for p, _ in files.listed(at)]
    other = str(tmp_path / "d")
    y.write_yxdb(spark.range(10, 15).coalesce(1), other)
    (new,) = [p for p, _ in files.listed(other)]
    hidden = f"{at}/_job.tmp"
    files.move(new, hidden)
    assert [p for p, _ in files.listed(at)] == [old]  # as if a write had ended before its commit
    open(f"{at}/_commit-x.json", "w").write(json.dumps({"old": [old], "new": [[hidden, f"{at}/part-x.yxdb"]]}))
    assert sorted(r.id for r in y.read_yxdb(at, spark=spark).collect()) == list(range(10, 15))
    os.remove(old)  # as if it had ended in the middle
    assert y.record_count(at) == 5
    y.write_yxdb(spark.range(1).coalesce(1), at, mode="append")
    assert sorted(r.id for r in y.read_yxdb(at, spark=spark).collect()) == [0, *range(10, 15)]
    assert not [n for n in os.listdir(at) if n.startswith("_commit")]


@pytest.mark.parametrize("kind", ["fixed", "variable", "plain"])
def test_single_file_by_many_tasks(spark, tmp_path, kind):
    """Every partition is written by its own task; the index and the order are those of one writer."""
    from yxspark.codec.header import read_header
    from yxspark.plans.splits import block_index, plan

    def with_task(batches):
        from pyspark import TaskContext

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([TaskContext.get().partitionId()] * b.num_rows, pa.int32())], names=["id", "task"])

    df = spark.range(0, 300_000, 1, 7).where("id < 40000 or id > 80000").mapInArrow(with_task, "id long, task int")
    if kind == "variable":
        df = df.withColumn("t", F.when(F.col("id") == 100_000, F.repeat(F.lit("x"), 700_000)).otherwise(F.repeat(F.lit("ab"), (F.col("id") % 40).cast("int"))))
    at = str(tmp_path / "one.yxdb")
    y.write_yxdb(df, at, single_file=True, **({"blockCompression": "none"} if kind == "plain" else {}))
    assert os.listdir(tmp_path) == ["one.yxdb"]
    ids = [*range(40_000), *range(80_001, 300_000)]
    h = read_header(at)
    with open(at, "rb") as f:
        assert h.records == len(ids) and len(block_index(f, h)) == 4
    if kind != "plain":
        assert [s.first for s in plan(h, 1)] == [0, 65_536, 131_072, 196_608]
    back = y.read_yxdb(at, spark=spark, recordIndex="true", splitBytes=1 << 16)
    assert [(r.id, r._record_index) for r in back.select("id", "_record_index").orderBy("_record_index").collect()] == [(v, i) for i, v in enumerate(ids)]
    assert back.select("task").distinct().count() == 7
    if kind == "variable":
        assert back.where("length(t) <> if(id = 100000, 700000, 2 * (id % 40))").count() == 0


def test_single_file_in_order(spark, tmp_path):
    """Sorted rows stay sorted, and stores without random access get the same file."""
    from yxspark.operators import writing

    df = spark.range(200_000).select(((F.col("id") * 7919) % 200_003).alias("v")).orderBy("v")
    y.write_yxdb(df, str(tmp_path / "a.yxdb"), single_file=True)
    before, writing._sparse = writing._sparse, lambda *_: False
    try:
        y.write_yxdb(df, str(tmp_path / "b.yxdb"), single_file=True)
    finally:
        writing._sparse = before
    assert (tmp_path / "a.yxdb").read_bytes() == (tmp_path / "b.yxdb").read_bytes()
    found = [v for t in y.read_yxdb_batches(str(tmp_path / "a.yxdb")) for v in t.column(0).to_pylist()]
    assert found == sorted((i * 7919) % 200_003 for i in range(200_000))


def test_tasks_grow_with_the_table(spark, tmp_path, monkeypatch):
    """A task's share of a table is bounded by bytes, not by the number of cores."""
    from yxspark import queries

    spark.range(100_000).coalesce(1).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    cores = spark.sparkContext.defaultParallelism
    assert queries.tasks_for(df) == cores
    monkeypatch.setattr(queries, "SHARE", 10_000)
    size = sum(p.stat().st_size for p in (tmp_path / "t").iterdir())
    assert size // 10_000 <= queries.tasks_for(df) <= size // 10_000 + cores
    at = str(tmp_path / "dealt")
    y.write_yxdb(df, at, tasks=9)
    assert y.read_yxdb(at, spark=spark).agg(F.countDistinct("id"), F.count("id")).first()[:] == (100_000, 100_000)
    assert len([p for p in os.listdir(at) if p.endswith(".yxdb")]) == 9


def test_single_file_sorts_in_many_tasks(spark, tmp_path):
    """The sort of a table that becomes one file stays in its tasks."""

    def with_task(batches):
        from pyspark import TaskContext

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([TaskContext.get().partitionId()] * b.num_rows, pa.int32())], names=["v", "task"])

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(20_000).select(((F.col("id") * 7919) % 20_011).alias("v")).orderBy("v").mapInArrow(with_task, "v long, task int")
        y.write_yxdb(df, str(tmp_path / "s.yxdb"), single_file=True)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rows = y.read_yxdb(str(tmp_path / "s.yxdb"), spark=spark, recordIndex="true").orderBy("_record_index").collect()
    assert [r.v for r in rows] == sorted((i * 7919) % 20_011 for i in range(20_000)) and len({r.task for r in rows}) > 1


def test_widths_are_found_before_rows_are_dealt(spark, tmp_path, monkeypatch):
    """Text widths come from one aggregate of the table as it is; rows are dealt once, without a sort."""
    from yxspark.operators import writing

    seen, plain = [], writing.text_widths
    monkeypatch.setattr(writing, "text_widths", lambda df, c: (seen.append(df._jdf.queryExecution().optimizedPlan().toString()), plain(df, c))[1])
    df = spark.range(1000).select("id", F.expr("array('a', 'é', 'ж', '😀', cast(X'FF41' as string), null)[int(id % 6)]").alias("t"))
    fields = y.write_yxdb(df.where("id % 6 <> 4"), str(tmp_path / "t"), tasks=3)
    assert len(seen) == 1 and "Repartition" not in seen[0]
    assert (fields[1].type, fields[1].size) == ("V_WString", 2) and y.read_yxdb(str(tmp_path / "t"), spark=spark).count() == 1000 - 166
    assert plain(df.where("id % 6 < 2"), ["t"]) == {"t": (False, 2, 1)} and plain(df.where("id % 6 = 4"), ["t"]) == {"t": (True, 2, 2)}
    assert plain(df.where("id % 6 = 3"), ["t"]) == {"t": (True, 4, 2)} and plain(df.where("id % 6 = 5"), ["t"]) == {"t": (False, 0, 0)}
