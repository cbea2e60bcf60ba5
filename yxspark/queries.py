"""The operators as queries over the driver's tables: each table is written as YXDB once a session, read back through the source, and queried.

Where a query has an SQL counterpart on the original tables, SQL holds it.
"""

from __future__ import annotations

import itertools
import struct
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import yxspark as y


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
_written: dict[tuple, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def folder(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="yxdb-")
    return f"{top.rstrip('/')}/yxdb-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    y.session(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LARGE = ("lineitem", "orders", "documents", "pages", "conversations", "events")
#: Bytes of a table's files that a task writes anew, about.
SHARE = 32 << 20


def tasks_for(df: DataFrame) -> int:
    """To how many tasks a table's rows are dealt: one large input file is still written by all cores, and a task's share doesn't grow with the table."""
    cores, size = df.sparkSession.sparkContext.defaultParallelism, int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return cores * max(1, -(-size // (SHARE * cores)))


def written(spark: SparkSession, sf_dir: str, name: str, make: Callable[[DataFrame], DataFrame] | None = None, label: str = "", **how) -> str:
    """The path of a table that was written as YXDB in this session."""
    key = (spark.sparkContext.applicationId, sf_dir, name, label)
    if key not in _written:
        df = table(spark, sf_dir, name)
        if name in LARGE:
            how = {"tasks": tasks_for(df), **how}
        at = folder(spark)
        y.write_yxdb(make(df) if make else df, at, **how)
        _written[key] = at
    return _written[key]


def back(spark: SparkSession, sf_dir: str, name: str, make=None, label: str = "", read: dict | None = None, **how) -> DataFrame:
    return y.read_yxdb(written(spark, sf_dir, name, make, label, **how), spark=spark, **(read or {}))


# ---- scans ----------------------------------------------------------------------------------------------------------


def _scan(name: str, sql: str | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return back(spark, sf_dir, name)

    run.__name__ = f"scan_{name}"
    query(sql or f"SELECT * FROM {name}")(run)


for _name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents", "pages", "conversations", "labels", "benchmark"):
    _scan(_name)
_scan("events", "SELECT event_id, date_trunc('second', ts)::TIMESTAMP AS ts, user_id, event_type, value, props FROM events")


@query("SELECT * FROM lineitem")
def scan_lineitem_multiblock(spark, sf_dir):
    """One file of many blocks, read by splits of its block index."""
    at = written(spark, sf_dir, "lineitem", label="one", single_file=True)
    return y.read_yxdb(at, spark=spark, splitBytes=1 << 20)


@query("SELECT * FROM orders")
def scan_uncompressed(spark, sf_dir):
    return back(spark, sf_dir, "orders", label="raw", blockCompression="none")


@query("SELECT l_orderkey, l_quantity FROM lineitem")
def project_cols(spark, sf_dir):
    return back(spark, sf_dir, "lineitem", read={"columns": ["l_orderkey", "l_quantity"]})


@query("SELECT * FROM lineitem WHERE l_quantity > 45")
def scan_filter(spark, sf_dir):
    return back(spark, sf_dir, "lineitem", read={"filters": [("l_quantity", ">", 45)]})


@query("SELECT l_orderkey, l_extendedprice FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'")
def scan_filter_project(spark, sf_dir):
    return back(spark, sf_dir, "lineitem", read={"columns": ["l_orderkey", "l_extendedprice"], "filters": [("l_quantity", ">", 45), ("l_returnflag", "=", "R")]})


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity <= 10 AND l_returnflag IN ('A', 'N') AND l_shipdate IS NOT NULL")
def scan_where(spark, sf_dir):
    """Spark's own filter over the same scan."""
    return back(spark, sf_dir, "lineitem").where("l_quantity <= 10 AND l_returnflag IN ('A', 'N') AND l_shipdate IS NOT NULL").select("l_orderkey", "l_linenumber")


def _in_order(spark: SparkSession, sf_dir: str) -> str:
    """orders as one file, its records ascending by key."""
    return written(spark, sf_dir, "orders", lambda df: df.orderBy("o_orderkey"), "ordered", tasks=None, single_file=True)


@query("SELECT * FROM orders ORDER BY o_orderkey LIMIT 100")
def limit_n(spark, sf_dir):
    """The scan stops after the first 100 records."""
    return y.read_yxdb(_in_order(spark, sf_dir), spark=spark, n_rows=100)


@query("SELECT n::INT AS asked, count(o_orderkey)::INT AS got, min(o_orderkey) AS low, max(o_orderkey) AS high FROM (VALUES (0), (1), (250), (100000000)) t(n) LEFT JOIN (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS place FROM orders) ON place <= n GROUP BY n")
def limit_counts(spark, sf_dir):
    """Limits of none, one, some and more than all: how many records come, and which."""
    at, out = _in_order(spark, sf_dir), None
    for n in (0, 1, 250, 100_000_000):
        one = y.read_yxdb(at, spark=spark, n_rows=n, columns=["o_orderkey"]).agg(F.lit(n).alias("asked"), F.count("o_orderkey").cast("int").alias("got"), F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def topk(spark, sf_dir):
    return back(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query("SELECT * FROM nation ORDER BY n_nationkey DESC")
def sort_desc(spark, sf_dir):
    return back(spark, sf_dir, "nation").orderBy(F.desc("n_nationkey"))


@query("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS _record_index, o_orderkey FROM orders")
def record_index(spark, sf_dir):
    """_record_index numbers the records of a file from 0, in their order."""
    return y.read_yxdb(_in_order(spark, sf_dir), spark=spark, recordIndex="true", columns=["o_orderkey"]).select("_record_index", "o_orderkey")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'F'")
def sql_view(spark, sf_dir):
    """CREATE TEMPORARY VIEW ... USING yxdb, then SQL."""
    at = written(spark, sf_dir, "orders")
    y.session(spark)
    name = f"v_{uuid.uuid4().hex[:8]}"
    spark.sql(f"CREATE TEMPORARY VIEW {name} USING yxdb OPTIONS (path '{at}')")
    return spark.sql(f"SELECT o_orderkey, o_orderdate FROM {name} WHERE o_orderstatus = 'F'")


@query("SELECT count(*) AS n, sum(o_orderkey)::BIGINT AS keys, count(DISTINCT o_orderkey) AS distinct_keys, round(sum(o_totalprice), 1) AS price FROM orders")
def batches_union(spark, sf_dir):
    """Batches on the driver: every row of every batch is there once."""
    import math

    n, seen, price = 0, set(), []
    for t in y.read_yxdb_batches(written(spark, sf_dir, "orders"), 4096, columns=["o_orderkey", "o_totalprice"]):
        n += t.num_rows
        seen.update(t.column(0).to_pylist())
        price += t.column(1).to_pylist()
    return spark.createDataFrame([(n, sum(seen), len(seen), round(math.fsum(price), 1))], "n long, keys long, distinct_keys long, price double")


@query("SELECT 250 AS n")
def batches_limit(spark, sf_dir):
    at = written(spark, sf_dir, "orders")
    return spark.createDataFrame([(sum(t.num_rows for t in y.read_yxdb_batches(at, 100, n_rows=250)),)], "n int")


@query("SELECT n_nationkey, n_name FROM nation")
def row_cursor(spark, sf_dir):
    with y.YxdbRowReader(written(spark, sf_dir, "nation")) as rows:
        found = [(rows.read_name("n_nationkey"), rows.read_index(1)) for _ in iter(rows.next, False)]
    return spark.createDataFrame(found, "n_nationkey int, n_name string")


@query("SELECT * FROM nation")
def ipc_round_trip(spark, sf_dir):
    at = folder(spark)
    y.write_yxdb_ipc(y.read_yxdb_ipc(written(spark, sf_dir, "nation")), at, spark=spark)
    return y.read_yxdb(at, spark=spark)


@query("SELECT * FROM orders")
def ipc_batches_round_trip(spark, sf_dir):
    """IPC streams batch by batch, out of one file and into another."""
    at = f"{folder(spark)}/one.yxdb"
    y.write_yxdb_ipc_batches(at, y.read_yxdb_ipc_batches(written(spark, sf_dir, "orders"), 4096))
    return y.read_yxdb(at, spark=spark)


# ---- metadata -------------------------------------------------------------------------------------------------------


@query("SELECT * FROM (VALUES (0, 'r_regionkey', 'Int32', 0, 0), (1, 'r_name', 'V_String', 11, 0)) t(position, name, type, size, scale)")
def meta_fields(spark, sf_dir):
    return y.fields_frame(written(spark, sf_dir, "region"), spark)


@query("SELECT count(*) AS n FROM lineitem")
def meta_record_count(spark, sf_dir):
    return spark.createDataFrame([(y.record_count(written(spark, sf_dir, "lineitem")),)], "n long")


@query("SELECT false AS has_spatial_index, 0 AS spatial_index_pos, 4456964 AS file_id, 1 AS spatial_columns")
def meta_spatial_info(spark, sf_dir):
    info = y.read_spatial_info(written(spark, sf_dir, "customer", _points, "point", spatial_columns=["geom"]))
    return spark.createDataFrame([(info["has_spatial_index"], info["spatial_index_pos"], info["file_id"], len(info["spatial_columns"]))], "has_spatial_index boolean, spatial_index_pos int, file_id int, spatial_columns int")


@query("SELECT 'E1' AS layout")
def detect_layout(spark, sf_dir):
    at = written(spark, sf_dir, "nation", label="one", single_file=True)
    return spark.createDataFrame([(y.detect_format(at),)], "layout string")


# ---- writes ---------------------------------------------------------------------------------------------------------


@query("SELECT * FROM lineitem")
def roundtrip_lineitem(spark, sf_dir):
    """Always writes anew."""
    at, df = folder(spark), table(spark, sf_dir, "lineitem")
    y.write_yxdb(df, at, tasks=tasks_for(df))
    return y.read_yxdb(at, spark=spark)


@query("SELECT s_suppkey::SMALLINT AS s_suppkey, s_name, CAST(s_acctbal AS DECIMAL(12, 2)) AS s_acctbal FROM supplier")
def roundtrip_metadata_types(spark, sf_dir):
    """Native types of a read survive the next write."""
    how = {"s_suppkey": {"type": "Int16"}, "s_name": {"type": "WString", "size": 40}, "s_acctbal": {"type": "FixedDecimal", "size": 14, "scale": 2}}
    first = back(spark, sf_dir, "supplier", lambda df: df.select("s_suppkey", "s_name", "s_acctbal"), "native", type_overrides=how)
    at = folder(spark)
    kinds = [f.type for f in y.write_yxdb(first, at)]
    if kinds != ["Int16", "WString", "FixedDecimal"]:
        raise AssertionError(kinds)
    return y.read_yxdb(at, spark=spark)


@query("SELECT left(c_name, 11) AS c_name, c_custkey::INT AS c_custkey, CAST(c_acctbal AS DECIMAL(9, 1)) AS c_acctbal FROM customer")
def write_field_list(spark, sf_dir):
    """An explicit field list: order, types, sizes and scales are as told."""
    at, fields = folder(spark), [y.FieldInfo("c_name", "String", 11), y.FieldInfo("c_custkey", "Int32"), y.FieldInfo("c_acctbal", "FixedDecimal", 11, 1)]
    y.write_yxdb(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), at, fields=fields)
    if [(f.name, f.type, f.size, f.scale) for f in y.read_yxdb_fields(at)] != [(f.name, f.type, f.size, f.scale) for f in fields]:
        raise AssertionError("other fields than asked for")
    return y.read_yxdb(at, spark=spark)


@query("SELECT c_custkey, left(c_name, 12) AS c_name FROM customer")
def override_string(spark, sf_dir):
    return back(spark, sf_dir, "customer", lambda df: df.select("c_custkey", "c_name"), "string12", type_overrides={"c_name": {"type": "String", "size": 12}})


@query("SELECT p_partkey, left(p_name, 9) AS p_name FROM part")
def override_wstring(spark, sf_dir):
    return back(spark, sf_dir, "part", lambda df: df.select("p_partkey", "p_name"), "wstring9", type_overrides={"p_name": {"type": "WString", "size": 9}})


@query("SELECT p_partkey, CAST(p_retailprice AS DECIMAL(10, 2)) AS p_retailprice FROM part")
def override_decimal(spark, sf_dir):
    return back(spark, sf_dir, "part", lambda df: df.select("p_partkey", "p_retailprice"), "decimal", type_overrides={"p_retailprice": {"type": "FixedDecimal", "size": 12, "scale": 2}})


@query("SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18, 2)) AS o_totalprice FROM orders")
def decimal_roundtrip(spark, sf_dir):
    return back(spark, sf_dir, "orders", lambda df: df.select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("o_totalprice")), "decimal")


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders")
def date_roundtrip(spark, sf_dir):
    return back(spark, sf_dir, "orders", lambda df: df.select("o_orderkey", F.col("o_orderdate").cast("date").alias("o_orderdate")), "date")


@query("SELECT event_id, strftime(ts, '%H:%M:%S') AS t FROM events")
def time_roundtrip(spark, sf_dir):
    found = back(spark, sf_dir, "events", lambda df: df.select("event_id", F.expr("to_time(date_format(ts, 'HH:mm:ss'))").alias("t")), "time")
    return found.select("event_id", F.date_format(F.expr("make_timestamp_ntz(DATE'2000-01-01', t)"), "HH:mm:ss").alias("t"))


@query("SELECT doc_id, hex(encode(text)) AS bytes FROM documents")
def blob_roundtrip(spark, sf_dir):
    return back(spark, sf_dir, "documents", lambda df: df.select("doc_id", F.encode("text", "UTF-8").alias("bytes")), "blob").select("doc_id", F.hex("bytes").alias("bytes"))


@query("SELECT * FROM orders")
def write_batches_union(spark, sf_dir):
    """The batch writer, fed batch by batch on the driver."""
    at = f"{folder(spark)}/one.yxdb"
    y.write_yxdb_batches(at, y.read_yxdb_batches(written(spark, sf_dir, "orders"), 4096))
    return y.read_yxdb(at, spark=spark)


def _sunk(df: DataFrame) -> DataFrame:
    at = folder(df.sparkSession)
    y.sink_yxdb(df, at)
    return y.read_yxdb(at, spark=df.sparkSession)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000")
def sink_filter(spark, sf_dir):
    return _sunk(back(spark, sf_dir, "orders").where("o_totalprice > 200000").select("o_orderkey", "o_totalprice"))


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def sink_group(spark, sf_dir):
    return _sunk(back(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")))


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def sink_join(spark, sf_dir):
    return _sunk(back(spark, sf_dir, "nation").join(back(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name"))


@query("SELECT * FROM nation ORDER BY n_name")
def sink_sort(spark, sf_dir):
    return _sunk(back(spark, sf_dir, "nation").orderBy("n_name"))


@query("SELECT p_partkey, p_size * 2 AS twice, upper(p_brand) AS brand FROM part")
def sink_expr(spark, sf_dir):
    return _sunk(back(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 2).alias("twice"), F.upper("p_brand").alias("brand")))


@query("SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY c_mktsegment ORDER BY n DESC, c_mktsegment LIMIT 3")
def sink_chain(spark, sf_dir):
    return _sunk(back(spark, sf_dir, "customer").where("c_acctbal > 0").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "c_mktsegment").limit(3))


@query("SELECT * FROM nation")
def to_parquet(spark, sf_dir):
    at = folder(spark)
    back(spark, sf_dir, "nation").write.parquet(at)
    return spark.read.parquet(at)


@query("SELECT * FROM nation")
def to_csv(spark, sf_dir):
    at, found = folder(spark), back(spark, sf_dir, "nation")
    found.write.csv(at, header=True)
    return spark.read.schema(found.schema).csv(at, header=True)


@query("SELECT * FROM nation")
def arrow_round_trip(spark, sf_dir):
    at = folder(spark)
    y.write_yxdb_arrow(y.read_yxdb_arrow(written(spark, sf_dir, "nation")), at, spark=spark)
    return y.read_yxdb(at, spark=spark)


@query("SELECT * FROM nation")
def pandas_round_trip(spark, sf_dir):
    at = folder(spark)
    y.write_yxdb_pandas(y.read_yxdb_pandas(written(spark, sf_dir, "nation")), at, spark=spark)
    return y.read_yxdb(at, spark=spark).select(F.col("n_nationkey").cast("int"), "n_name", F.col("n_regionkey").cast("int"))


# ---- relational operators over the source --------------------------------------------------------------------------


@query("SELECT o_orderkey, l_linenumber, o_orderstatus, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def join_inner(spark, sf_dir):
    return back(spark, sf_dir, "lineitem").join(back(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", "l_linenumber", "o_orderstatus", "l_quantity")


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_cross_format(spark, sf_dir):
    return back(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def join_left(spark, sf_dir):
    return back(spark, sf_dir, "customer").join(back(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


def _dear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few enough orders that there are customers without one."""
    return back(spark, sf_dir, "orders").where("o_totalprice > 350000")


def _same_customer():
    return F.col("c_custkey") == F.col("o_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 350000)")
def join_anti(spark, sf_dir):
    return back(spark, sf_dir, "customer").join(_dear(spark, sf_dir), _same_customer(), "left_anti").select("c_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 350000)")
def join_semi(spark, sf_dir):
    return back(spark, sf_dir, "customer").join(_dear(spark, sf_dir), _same_customer(), "left_semi").select("c_custkey", "c_name")


@query("SELECT o_orderkey, c_name FROM orders o RIGHT JOIN customer c ON o_custkey = c_custkey AND o_totalprice > 350000")
def join_right(spark, sf_dir):
    return _dear(spark, sf_dir).join(back(spark, sf_dir, "customer"), _same_customer(), "right").select("o_orderkey", "c_name")


@query("SELECT c_custkey, o_orderkey FROM (SELECT * FROM customer WHERE c_acctbal > 0) FULL JOIN (SELECT * FROM orders WHERE o_totalprice > 350000) ON c_custkey = o_custkey")
def join_full(spark, sf_dir):
    return back(spark, sf_dir, "customer").where("c_acctbal > 0").join(_dear(spark, sf_dir), _same_customer(), "full").select("c_custkey", "o_orderkey")


@query("SELECT n_nationkey, r_regionkey FROM nation JOIN region ON n_nationkey BETWEEN r_regionkey * 3 AND r_regionkey * 3 + 4")
def join_range(spark, sf_dir):
    """Few rows either side: a loop over the broadcast regions."""
    low = F.col("r_regionkey") * 3
    return back(spark, sf_dir, "nation").join(back(spark, sf_dir, "region"), F.col("n_nationkey").between(low, low + 4)).select("n_nationkey", "r_regionkey")


@query("SELECT l_returnflag, count(l_linestatus) AS n FROM lineitem GROUP BY l_returnflag")
def agg_count(spark, sf_dir):
    return back(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count("l_linestatus").alias("n"))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY l_returnflag, l_linestatus")
def agg_sum(spark, sf_dir):
    return back(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("SELECT l_linestatus, round(avg(l_quantity), 4) AS mean FROM lineitem WHERE l_discount > 0.05 GROUP BY l_linestatus ORDER BY l_linestatus")
def agg_chain(spark, sf_dir):
    return back(spark, sf_dir, "lineitem").where("l_discount > 0.05").groupBy("l_linestatus").agg(F.round(F.avg("l_quantity"), 4).alias("mean")).orderBy("l_linestatus")


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY CUBE (o_orderpriority, o_orderstatus)")
def agg_cube(spark, sf_dir):
    return back(spark, sf_dir, "orders").cube("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


def _with_nulls(df: DataFrame) -> DataFrame:
    return df.select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).alias("price"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("priority"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate")).alias("day"))


@query("SELECT count(*) FILTER (WHERE o_orderkey % 3 = 0) AS price, count(*) FILTER (WHERE o_orderkey % 5 = 0) AS priority, count(*) FILTER (WHERE o_orderkey % 7 = 0) AS day FROM orders")
def null_counts(spark, sf_dir):
    return back(spark, sf_dir, "orders", _with_nulls, "nulls").agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in ("price", "priority", "day")))


@query("SELECT DISTINCT p_brand, p_type FROM part")
def distinct_vals(spark, sf_dir):
    return back(spark, sf_dir, "part").select("p_brand", "p_type").distinct()


@query("SELECT 'text' AS name, bool_or(regexp_matches(text, '[^\\x00-\\xFF]')) AS wide, max(octet_length(encode(text)))::INT AS max_bytes, max(length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')))::INT AS max_units FROM documents")
def string_profile(spark, sf_dir):
    return y.string_profile(table(spark, sf_dir, "documents").select("text"))


@query("SELECT * FROM orders")
def union_all(spark, sf_dir):
    low = back(spark, sf_dir, "orders", lambda df: df.where("o_orderkey % 2 = 0"), "even")
    return low.unionByName(back(spark, sf_dir, "orders", lambda df: df.where("o_orderkey % 2 <> 0"), "odd"))


@query("SELECT n_regionkey AS k FROM nation INTERSECT SELECT r_regionkey FROM region")
def intersect(spark, sf_dir):
    return back(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("k")).intersect(back(spark, sf_dir, "region").select("r_regionkey"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 350000")
def except_distinct(spark, sf_dir):
    return back(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).subtract(_dear(spark, sf_dir).select("o_custkey"))


@query("SELECT n_regionkey AS k FROM nation EXCEPT ALL SELECT r_regionkey FROM region")
def except_all(spark, sf_dir):
    return back(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("k")).exceptAll(back(spark, sf_dir, "region").select("r_regionkey"))


@query("SELECT o_custkey, o_orderkey, rank() OVER w::INT AS place, round(sum(o_totalprice) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS three, lag(o_orderkey) OVER w AS before FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def window_frames(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    found = back(spark, sf_dir, "orders")
    return found.select("o_custkey", "o_orderkey", F.rank().over(w).alias("place"), F.round(F.sum("o_totalprice").over(w.rowsBetween(-2, 0)), 2).alias("three"), F.lag("o_orderkey").over(w).alias("before"))


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INT AS place FROM orders")
def window_rank(spark, sf_dir):
    from pyspark.sql import Window

    return back(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")).alias("place"))


@query("SELECT p_partkey AS id, CAST(p_size AS VARCHAR) AS size, p_retailprice * 2 AS twice FROM part")
def expr_project(spark, sf_dir):
    return back(spark, sf_dir, "part").withColumn("twice", F.col("p_retailprice") * 2).withColumnRenamed("p_partkey", "id").select("id", F.col("p_size").cast("string").alias("size"), "twice", "p_brand").drop("p_brand")


# ---- geometry -------------------------------------------------------------------------------------------------------

def _wkb(code: int, *values) -> bytes:
    return struct.pack("<BI", 1, code) + b"".join(struct.pack("<I" if isinstance(v, int) else "<d", v) for v in values)


def _ring(x: float, size: float, clockwise: bool, *more: float) -> bytes:
    corners = [(x, 0.0), (x + size, 0.0), (x + size, size), (x, size), (x, 0.0)]
    points = corners[::-1] if clockwise else corners
    return struct.pack("<I", 5) + b"".join(struct.pack(f"<{2 + len(more)}d", *p, *more) for p in points)


def _hole(x: float, size: float) -> bytes:
    """A clockwise square inside the one of _ring."""
    a, b = size / 4, size / 2
    points = [(x + a, a), (x + a, b), (x + b, b), (x + b, a), (x + a, a)]
    return struct.pack("<I", 5) + b"".join(struct.pack("<2d", *p) for p in points)


# A geometry of each kind for a key.
SHAPES: dict[str, Callable[[int], bytes]] = {
    "point": lambda k: _wkb(1, float(k), -float(k)),
    "point_zm": lambda k: _wkb(3001, float(k), -float(k), k / 2, k / 4),
    "line_z": lambda k: _wkb(1005, 2) + _wkb(1002, 2, float(k), 0.0, 1.0, k + 1.0, 1.0, 2.0) + _wkb(1002, 3, 0.0, 0.0, 3.0, 1.0, 1.0, 4.0, 2.0, 2.0, float(k)),
    "points_m": lambda k: _wkb(2004, 2) + _wkb(2001, float(k), 1.0, 7.0) + _wkb(2001, 2.0, float(k), 8.0),
    "polygon_hole": lambda k: _wkb(6, 1) + _wkb(3, 2) + _ring(float(k), 8.0, False) + _hole(float(k), 8.0),
    "two_polygons_z": lambda k: _wkb(1006, 2) + _wkb(1003, 1) + _ring(float(k), 2.0, False, 5.0) + _wkb(1003, 1) + _ring(k + 10.0, 4.0, False, 6.0),
}


def _shaped(kind: str) -> Callable[[DataFrame], DataFrame]:
    """c_custkey and geom, the WKB of a shape made from the key; null for every third key."""

    def make(df: DataFrame) -> DataFrame:
        def run(batches):
            import pyarrow as pa

            for b in batches:
                keys = b.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([SHAPES[kind](k) if k % 3 else None for k in keys], pa.binary())], names=["c_custkey", "geom"])

        return df.select(F.col("c_custkey").cast("long").alias("c_custkey")).mapInArrow(run, "c_custkey long, geom binary")

    return make


_points = _shaped("point")


def _numbers(wkb: bytes) -> tuple[int, int, list[tuple[float, ...]]]:
    """Of any WKB made here: its code, its number of rings or lines, and all points; a reader of its own, apart from the library's."""
    (code,) = struct.unpack_from("<I", wkb, 1)
    width = 2 + (code // 1000 in (1, 3)) + (code // 1000 in (2, 3))
    at, parts, points = 0, 0, []

    def take(n: int) -> None:
        nonlocal at
        for _ in range(n):
            points.append(struct.unpack_from(f"<{width}d", wkb, at))
            at += 8 * width

    def one() -> None:
        nonlocal at, parts
        kind = struct.unpack_from("<I", wkb, at + 1)[0] % 1000
        at += 5
        if kind == 1:
            take(1)
            return
        (n,) = struct.unpack_from("<I", wkb, at)
        at += 4
        if kind == 2:
            parts += 1
            take(n)
        elif kind == 3:
            for _ in range(n):
                (m,) = struct.unpack_from("<I", wkb, at)
                at += 4
                parts += 1
                take(m)
        else:
            for _ in range(n):
                one()

    one()
    return code, parts, points


def _described(df: DataFrame) -> DataFrame:
    """c_custkey, code, parts, points, and the sums of all coordinates by dimension."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = []
            for k, g in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if g is None:
                    rows.append((k, None, None, None, None, None, None, None))
                    continue
                code, parts, points = _numbers(g)
                sums = [float(sum(x)) for x in zip(*points)]
                rows.append((k, code, parts, len(points), *sums, *[None] * (4 - len(sums))))
            kinds = (pa.int64(), *[pa.int32()] * 3, *[pa.float64()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds], names=["c_custkey", "code", "parts", "points", "x", "y", "third", "fourth"])

    return df.select("c_custkey", "geom").mapInArrow(run, "c_custkey long, code int, parts int, points int, x double, y double, third double, fourth double")


def _geometry(kind: str, code: int, parts: int, points: int, x: str, y_: str, third: str = "NULL", fourth: str = "NULL") -> None:
    sums = ", ".join(f"CASE WHEN c_custkey % 3 <> 0 THEN ({e})::DOUBLE END AS {n}" for n, e in (("x", x), ("y", y_), ("third", third), ("fourth", fourth)))
    whole = ", ".join(f"CASE WHEN c_custkey % 3 <> 0 THEN {v}::INT END AS {n}" for n, v in (("code", code), ("parts", parts), ("points", points)))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _described(back(spark, sf_dir, "customer", _shaped(kind), kind, spatial_columns=["geom"]))

    run.__name__ = f"geo_{kind}"
    query(f"SELECT c_custkey::BIGINT AS c_custkey, {whole}, {sums} FROM customer")(run)


_geometry("point", 1, 0, 1, "c_custkey", "-c_custkey")
_geometry("point_zm", 3001, 0, 1, "c_custkey", "-c_custkey", "c_custkey / 2.0", "c_custkey / 4.0")
_geometry("line_z", 1005, 2, 5, "2 * c_custkey + 4", "4", "10 + c_custkey")
_geometry("points_m", 2004, 0, 2, "c_custkey + 2", "1 + c_custkey", "15")
_geometry("polygon_hole", 6, 2, 10, "10 * c_custkey + 8 * 2 + 2 * 3 + 4 * 2", "8 * 2 + 2 * 3 + 4 * 2")
_geometry("two_polygons_z", 1006, 2, 10, "10 * c_custkey + 2 * 2 + 50 + 4 * 2", "2 * 2 + 4 * 2", "5 * 5 + 5 * 6")


@query("SELECT c_custkey::BIGINT AS c_custkey, 2::INT AS polygons FROM customer WHERE c_custkey % 3 <> 0")
def geo_ring_order(spark, sf_dir):
    """By the rule of shapefiles, clockwise rings begin polygons: the counter-clockwise outer ring comes first all the same, its clockwise hole becomes a polygon of its own."""
    at = written(spark, sf_dir, "customer", _shaped("polygon_hole"), "polygon_hole", spatial_columns=["geom"])
    found = y.read_yxdb(at, spark=spark, ringOrder="esri").where("geom is not null")
    return found.select("c_custkey", F.substring(F.hex("geom"), 11, 2).cast("int").alias("polygons"))


@query("SELECT count(*) FILTER (WHERE c_custkey % 3 = 0) AS nulls, sum(c_custkey) FILTER (WHERE c_custkey % 3 = 0)::BIGINT AS keys FROM customer")
def geo_nulls(spark, sf_dir):
    return back(spark, sf_dir, "customer", _points, "point", spatial_columns=["geom"]).where("geom is null").agg(F.count(F.lit(1)).alias("nulls"), F.sum("c_custkey").alias("keys"))


@query("SELECT c_custkey::BIGINT AS c_custkey, 20::INT AS raw_bytes, 21::INT AS wkb_bytes, true AS alike FROM customer WHERE c_custkey % 3 <> 0")
def geo_modes(spark, sf_dir):
    """Raw shape records and WKB of the same points end in the same coordinates."""
    at = written(spark, sf_dir, "customer", _points, "point", spatial_columns=["geom"])
    raw, wkb = (y.read_yxdb(at, spark=spark, spatial=m).where("geom is not null").select("c_custkey", F.col("geom").alias(m.lower())) for m in ("RAW", "wkb"))
    same = F.substring(F.hex("raw"), 9, 32) == F.substring(F.hex("wkb"), 11, 32)
    return raw.join(wkb, "c_custkey").select("c_custkey", F.octet_length("raw").alias("raw_bytes"), F.octet_length("wkb").alias("wkb_bytes"), same.alias("alike"))


@query("SELECT c_custkey::BIGINT AS c_custkey, 3::INT AS points, (2 * c_custkey + 4)::DOUBLE AS x FROM customer WHERE c_custkey % 3 <> 0")
def geo_functions(spark, sf_dir):
    """shp_to_wkb and wkb_to_shp in SQL expressions, one undoing the other."""
    y.session(spark)
    made = _shaped("line_z")(table(spark, sf_dir, "customer")).where("geom is not null")
    again = made.selectExpr("c_custkey", "shp_to_wkb(wkb_to_shp(geom)) AS geom", "geom AS before").where("geom = before").select("c_custkey", "geom")
    return _described(again).select("c_custkey", (F.col("points") - 2).cast("int").alias("points"), "x")


@query("SELECT c_custkey::BIGINT AS c_custkey, c_custkey % 3 <> 0 AS there FROM customer")
def geo_arrow(spark, sf_dir):
    """The GeoArrow hand-over: a table whose geometry column says so in its metadata."""
    t = y.read_yxdb_geoarrow(written(spark, sf_dir, "customer", _points, "point", spatial_columns=["geom"]), spark=spark)
    if t.schema.field("geom").metadata.get(b"ARROW:extension:name") != b"geoarrow.wkb":
        raise AssertionError("the geometry column isn't marked")
    rows = [(k, g is not None and _numbers(g)[2] == [(float(k), -float(k))]) for k, g in zip(t.column("c_custkey").to_pylist(), t.column("geom").to_pylist())]
    return spark.createDataFrame(rows, "c_custkey long, there boolean")


# ---- the Snappy-based layout ------------------------------------------------------------------------------------------


def snappy_files(spark: SparkSession, sf_dir: str, name: str, columns: dict[str, tuple], label: str = "", broken: Callable = lambda values: False) -> str:
    """The path of a table written in the Snappy-based layout, one file a task. columns: expression by (type, size, scale)."""
    key = (spark.sparkContext.applicationId, sf_dir, name, "e2", label)
    if key not in _written:
        at = folder(spark)
        fields = [y.FieldInfo(n, *how[1:]) for n, how in columns.items()]

        def run(batches):
            import pyarrow as pa
            from pyspark import TaskContext

            from yxspark.codec import e2_encode, files

            n = 0

            def rows():
                nonlocal n
                for b in batches:
                    for i in range(0, b.num_rows, 256):
                        for r in zip(*(c.to_pylist() for c in b.slice(i, 256).columns)):
                            n += 1
                            yield r

            found = rows()
            if (first := next(found, None)) is not None:
                with files.created(f"{at}/part-{TaskContext.get().partitionId():05d}.yxdb") as out:
                    for part in e2_encode.file_parts(fields, itertools.chain([first], found), 1000, broken):
                        out.write(part)
            yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

        base = table(spark, sf_dir, name)
        df = base.select(*(F.expr(how[0]).alias(n) for n, how in columns.items()))
        df.repartition(tasks_for(base), F.monotonically_increasing_id()).mapInArrow(run, "n long").agg(F.sum("n")).collect()
        _written[key] = at
    return _written[key]


_E2_ORDERS = {
    "o_orderkey": ("o_orderkey", "Int64"), "o_custkey": ("cast(o_custkey as int)", "Int32"), "o_orderstatus": ("o_orderstatus", "V_String", 1), "o_totalprice": ("o_totalprice", "Double"),
    "day": ("cast(o_orderdate as date)", "Date"), "at": ("cast(o_orderdate as timestamp_ntz)", "DateTime"), "price": ("if(o_orderkey % 3 = 0, null, cast(o_totalprice as decimal(12,2)))", "FixedDecimal", 14, 2), "odd": ("if(o_orderkey % 5 = 0, null, o_orderkey % 2 = 1)", "Bool"),
}
_E2_SQL = "o_orderkey, o_custkey::INT AS o_custkey, o_orderstatus, o_totalprice, o_orderdate::DATE AS day, o_orderdate::TIMESTAMP AS at, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_totalprice AS DECIMAL(12, 2)) END AS price, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 2 = 1 END AS odd"


@query(f"SELECT {_E2_SQL} FROM orders")
def e2_scan(spark, sf_dir):
    """Numbers, text, dates, datetimes, decimals, booleans and nulls of the Snappy-based layout."""
    return y.read_yxdb(snappy_files(spark, sf_dir, "orders", _E2_ORDERS), spark=spark)


@query("SELECT doc_id, text FROM documents")
def e2_scan_long_texts(spark, sf_dir):
    """Texts in the record, with a length of two bytes, and in blob blocks."""
    return y.read_yxdb(snappy_files(spark, sf_dir, "documents", {"doc_id": ("doc_id", "Int64"), "text": ("text", "V_WString", 1_000_000)}), spark=spark)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000 AND o_orderstatus = 'F'")
def e2_filter_project(spark, sf_dir):
    at = snappy_files(spark, sf_dir, "orders", _E2_ORDERS)
    return y.read_yxdb(at, spark=spark, columns=["o_orderkey", "o_totalprice"], filters=[("o_totalprice", ">", 200000), ("o_orderstatus", "=", "F")])


@query("SELECT o_orderstatus, count(*) AS n, sum(CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_totalprice AS DECIMAL(12, 2)) END)::DECIMAL(22, 2) AS price FROM orders GROUP BY o_orderstatus")
def e2_agg(spark, sf_dir):
    return y.read_yxdb(snappy_files(spark, sf_dir, "orders", _E2_ORDERS), spark=spark).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum("price").cast("decimal(22,2)").alias("price"))


@query("SELECT count(*) AS n, 'E2' AS layout FROM orders")
def e2_detect_and_count(spark, sf_dir):
    at = snappy_files(spark, sf_dir, "orders", _E2_ORDERS)
    from yxspark.codec import files

    layouts = {y.detect_format(p) for p, _ in files.listed(at)}
    return spark.createDataFrame([(y.record_count(at), ",".join(sorted(layouts)))], "n long, layout string")


def _some_broken(spark: SparkSession, sf_dir: str) -> str:
    some = {k: _E2_ORDERS[k] for k in ("o_orderkey", "o_totalprice", "o_orderstatus")}
    return snappy_files(spark, sf_dir, "orders", some, "broken", lambda values: values[0] % 100 == 7)


@query("SELECT CASE WHEN o_orderkey % 100 <> 7 THEN o_orderkey END AS o_orderkey, CASE WHEN o_orderkey % 100 <> 7 THEN o_totalprice END AS o_totalprice, CASE WHEN o_orderkey % 100 <> 7 THEN o_orderstatus END AS o_orderstatus FROM orders")
def e2_corrupt_row(spark, sf_dir):
    """Records that can't be decoded are rows of nulls; those around them are read."""
    return y.read_yxdb(_some_broken(spark, sf_dir), spark=spark)


@query("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderkey % 100 <> 7")
def e2_drop_malformed(spark, sf_dir):
    return y.read_yxdb(_some_broken(spark, sf_dir), spark=spark, mode="DROPMALFORMED")


@query(f"SELECT {_E2_SQL} FROM orders WHERE o_orderkey % 3 <> 0")
def e2_to_e1(spark, sf_dir):
    """From one layout to the other; field types survive."""
    at = folder(spark)
    y.write_yxdb(y.read_yxdb(snappy_files(spark, sf_dir, "orders", _E2_ORDERS), spark=spark).where("o_orderkey % 3 <> 0"), at)
    return y.read_yxdb(at, spark=spark)


# ---- streaming ------------------------------------------------------------------------------------------------------


@query("SELECT * FROM orders")
def stream_files(spark, sf_dir):
    """A stream over a directory's files into a YXDB sink."""
    at, to, marks = written(spark, sf_dir, "orders"), folder(spark), folder(spark)
    y.write_stream(y.read_stream(at, spark=spark), to, marks).awaitTermination()
    return y.read_yxdb(to, spark=spark)


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_aggregate(spark, sf_dir):
    """A stream of event files, aggregated as it comes."""
    at, name = written(spark, sf_dir, "events"), f"agg_{uuid.uuid4().hex[:8]}"
    q = y.read_stream(at, spark=spark).groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by order priority and month of what returned flag R marks, from lineitem and orders read back from YXDB."""
    lines = back(spark, sf_dir, "lineitem", read={"columns": ["l_orderkey", "l_extendedprice", "l_discount"], "filters": [("l_returnflag", "=", "R")]})
    orders = back(spark, sf_dir, "orders", read={"columns": ["o_orderkey", "o_orderdate", "o_orderpriority"]})
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy("o_orderpriority", F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("lines"))


QUERIES["flagship"] = flagship
SQL["flagship"] = "SELECT o_orderpriority, strftime(o_orderdate, '%Y-%m') AS month, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY ALL"
