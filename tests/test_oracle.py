"""Every query with SQL gives what DuckDB gives on the smallest tables."""

import datetime
import math
import os

import duckdb
import pytest

from graphloom.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "~"
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted(tuple(plain(r[i]) for i in order) for r in values)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = duck.execute(catalog.oracle_sql()[name])
    want = rows([c[0] for c in cursor.description], cursor.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["entity_merge", "stream_ingest_merge"])
@pytest.mark.parametrize("files", [1, 3])
def test_arrivals_of_the_same_place(spark, tmp_path, name, files):
    """Of arrivals with the same order and line the one that lies first in the table counts."""
    con = duckdb.connect()
    con.execute("set threads = 1")
    lines = "select i // 20 as l_orderkey, i // 20 as l_partkey, 90 - i * 7 % 50 as l_suppkey, cast(4 + i // 200 as int) as l_linenumber, 'R' || (i * 7 % 41) as l_returnflag, 'F' || (i * 7 % 13) as l_linestatus from range({}, {}) t(i)"
    (tmp_path / "lineitem.parquet").mkdir()
    for k in range(files):
        con.execute(f"copy ({lines.format(600 * k // files, 600 * (k + 1) // files)}) to '{tmp_path}/lineitem.parquet/part-{k}.parquet' (format parquet)")
    con.execute(f"copy (select i as o_orderkey, 'P' || i % 5 as o_orderpriority from range(30) t(i)) to '{tmp_path}/orders.parquet' (format parquet)")
    con.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    con.execute(f"create view orders as select * from '{tmp_path}/orders.parquet'")
    df = catalog.queries()[name](spark, str(tmp_path))
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(catalog.oracle_sql()[name])
    assert got == rows([c[0] for c in cursor.description], cursor.fetchall())


@pytest.mark.parametrize("name", ["entity_merge", "stream_ingest_merge", "delete_document"])
@pytest.mark.parametrize("odd", ["part", "line", "supplier", "no order"])
def test_arrivals_with_nulls(spark, tmp_path, name, odd):
    """Arrivals without a part are no entity, those without a line have no place, and lines without an order only give embeddings."""
    con = duckdb.connect()
    con.execute("set threads = 1")
    null = lambda kind, value: f"case when hash(i * 31) % 9 = 0 then null else {value} end" if kind == odd else value
    lines = f"hash(i) % 80 as l_orderkey, {null('part', 'hash(i) % 80 % 13')} as l_partkey, {null('supplier', 'hash(i + 77) % 50')} as l_suppkey, {null('line', '1 + hash(i + 99) % 7')} as l_linenumber, 'R' || hash(i + 5) % 50 as l_returnflag, 'S' || hash(i + 6) % 50 as l_linestatus"
    con.execute(f"copy (select * replace (l_orderkey::bigint as l_orderkey, l_partkey::bigint as l_partkey, l_suppkey::bigint as l_suppkey, l_linenumber::int as l_linenumber) from (select {lines} from range(400) t(i))) to '{tmp_path}/lineitem.parquet' (format parquet)")
    con.execute(f"copy (select i as o_orderkey, 'P' || i % 5 as o_orderpriority from range({60 if odd == 'no order' else 80}) t(i)) to '{tmp_path}/orders.parquet' (format parquet)")
    for t in ("lineitem", "orders"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    df = catalog.queries()[name](spark, str(tmp_path))
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(catalog.oracle_sql()[name])
    assert got == rows([c[0] for c in cursor.description], cursor.fetchall())
