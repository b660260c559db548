"""Registered queries against their SQL, on the smallest tables."""

from pathlib import Path

import numpy as np
import pytest

import __spark_entry__ as entry
from medialedger.plans.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    return con


def plain(df):
    df = df[sorted(df.columns)].astype(object)

    def one(x):
        if x is None or x != x:
            return None
        if isinstance(x, (bool, np.bool_)):
            return bool(x)
        return int(x) if isinstance(x, (int, np.integer)) else round(float(x), 6) if isinstance(x, (float, np.floating)) else x

    return sorted(repr(tuple(map(one, r))) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_is_its_sql(spark, duck, name):
    assert plain(QUERIES[name](spark, SF).toPandas()) == plain(duck.sql(ORACLE[name]).df())


def test_all_queries_have_sql():
    assert set(QUERIES) == set(ORACLE)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_shuffles_do_not_change_results(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    got = []
    for n in ("1", "32"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append(plain(QUERIES["dup_groups"](spark, SF).toPandas()))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1]


def on_tables(spark, folder, name, **tables):
    """A query and its SQL over tables of its own."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table, select in tables.items():
        con.sql(f"copy ({select}) to '{folder}/{table}.parquet' (format parquet)")
        con.sql(f"create view {table} as select * from '{folder}/{table}.parquet'")
    got, want = QUERIES[name](spark, str(folder)).toPandas(), con.sql(ORACLE[name]).df()
    return plain(got), plain(want)


def test_rate_limit_counts_in_nearest_seconds(spark, tmp_path):
    """Three writes, then one that is within the window by whole seconds only if both ends are rounded, or not; halves to even."""
    starts = {1: ("0.6", "0.2"), 2: ("0.4", "0.9"), 3: ("0.5", "0.5"), 4: ("1.5", "1.5"), 5: ("1.5", "2.5"), 6: ("0.5", "1.5")}
    times = [(user, f"2024-01-01 00:00:0{a}", n) for user, (a, _) in starts.items() for n in range(3)]
    times += [(user, f"2024-01-02 00:00:0{float(b) + k}", 3 + k) for user, (_, b) in starts.items() for k in range(2)]
    values = ", ".join(f"({user * 1000 + n * 60}, timestamp '{t}', {user})" for user, t, n in times)
    got, want = on_tables(spark, tmp_path, "rate_limit", events=f"select event_id::bigint as event_id, ts, user_id::bigint as user_id, 'view' as event_type from (values {values}) v(event_id, ts, user_id)")
    assert got == want
    assert len({r for r in got}) == len(got) > 20


@pytest.mark.parametrize("name", ["tag_menu", "merge_web_tags", "tag_counts", "resolve_tags", "first_spellings"])
def test_tags_belong_to_one_order(spark, tmp_path, name):
    """File names hold seven digits of a key, so that eleven orders here have the name of the first."""
    keys = ", ".join(f"({k})" for k in [*range(1_234_300, 1_234_700), *range(12_345_000, 12_346_000, 3), 2])
    orders = f"select k::bigint as o_orderkey, k::bigint as o_custkey, timestamp '2020-01-01' + to_days(cast(k % 300 as int)) as o_orderdate, 'p' || k as o_orderpriority from (values {keys}) v(k)"
    documents = f"select k::bigint - 1 as doc_id, 'The tree, the Tree' || chr(10) || 'THE sea ' || k || ' ' || (k % 7) as text from (values {keys}) v(k) where k < 2000000"
    got, want = on_tables(spark, tmp_path, name, orders=orders, documents=documents)
    assert got == want
    assert got
