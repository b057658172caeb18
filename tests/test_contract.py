"""Every query of the driver's contract against its SQL, on the smallest tables."""

import decimal
import os

import duckdb
import pytest

import floppyscope.format_queries  # noqa: F401
import floppyscope.media_queries  # noqa: F401
from floppyscope import contract

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def oracle():
    if not os.path.isdir(DATA):
        pytest.skip("no tables here")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", contract.QUERIES)
def test_query(spark, oracle, name):
    df = contract.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    found = oracle.execute(contract.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = [tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert got


def test_chain_walk_follows_long_chains(spark, tmp_path):
    rows = [(1, 3 * i) for i in range(200)] + [(2, 1000)]
    spark.createDataFrame(rows, "o_custkey long, o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = [(r["o_custkey"], r["cluster"], r["step"]) for r in contract.QUERIES["chain_walk"](spark, str(tmp_path)).collect()]
    assert sorted(got) == [(1, 3 * i, i) for i in range(200)] + [(2, 1000, 0)]


def test_journal_replay_keeps_every_user(spark, tmp_path):
    rows = [(i, k, f"e{i}") for i, k in enumerate((0, 3, 199, 200, 200, 950))]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    got = {r["user_id"]: r["event_type"] for r in contract.QUERIES["journal_replay"](spark, str(tmp_path)).collect()}
    assert got == dict.fromkeys(range(951), "none") | {0: "e0", 3: "e1", 199: "e2", 200: "e4", 950: "e5"}


def test_last_before_keeps_probes_without_a_time(spark):
    from floppyscope.operators.relational import last_before

    probes = spark.sql("SELECT * FROM VALUES (TIMESTAMP'2024-01-02 00:00:00', 1L), (NULL, 2L), (TIMESTAMP'2023-01-01 00:00:00', 3L) AS t(ts, id)")
    marks = spark.sql("SELECT * FROM VALUES (TIMESTAMP'2024-01-01 00:00:00', 9L, 'm'), (NULL, 8L, 'n') AS t(ts, id, name)")
    got = {r["id"]: r["name"] for r in last_before(probes, marks, "ts", "id", "name").collect()}
    assert got == {1: "m", 2: None, 3: None}


def test_locate_asof_orders_equal_times_by_id(spark, tmp_path):
    at = [None, "2024-01-01 00:00:00", "2024-01-01 23:59:59", "2024-01-03 00:00:00"]
    rows = [(i, at[i * 7 % 11 % 4], "signup" if i * 5 % 13 % 3 == 0 else "click") for i in range(48)] + [(None, t, "signup") for t in at] + [(None, at[1], "click"), (7, at[2], "signup"), (7, at[2], "click"), (60, at[3], None)]
    spark.createDataFrame(rows, "event_id long, at string, event_type string").selectExpr("event_id", "CAST(at AS TIMESTAMP) AS ts", "event_type").write.parquet(f"{tmp_path}/events.parquet")
    got = [tuple(r) for r in contract.QUERIES["locate_asof"](spark, str(tmp_path)).select("event_id", "signup").collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(contract.ORACLE_SQL["locate_asof"]).fetchall()
    assert sorted(map(repr, got)) == sorted(map(repr, want))
