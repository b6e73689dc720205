import os

import duckdb
import pytest

from tidemill.plans import catalogue
from tidemill.session import table

SF = "/root/testdata/sf0.001"
NAMES = "region nation customer supplier part orders lineitem events documents pages labels conversations"


@pytest.fixture(scope="module")
def db():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for name in NAMES.split():
        c.execute(f"CREATE VIEW {name} AS FROM read_parquet('{SF}/{name}.parquet')")
    return c


def plain(rows):
    return sorted(tuple("" if v is None else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, db, name):
    found = catalogue.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    want = db.execute(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({catalogue.ORACLES[name]})").fetchall()
    assert plain(found.select(*columns).collect()) == plain(want)


def test_every_query_names_its_columns_once(spark):
    for name, query in catalogue.QUERIES.items():
        found = query(spark, SF)
        assert len(set(found.columns)) == len(found.columns), name


@pytest.mark.parametrize("last", ["10:00:00.499999", "10:00:00.5", "10:00:00.500001", "10:00:01.5", "10:00:01.999999", None])
def test_heartbeats_between_seconds(spark, tmp_path, last):
    path, c = f"{tmp_path}/events.parquet", duckdb.connect()
    beats = [f"09:50:0{second}.{part}" for second in range(4) for part in ("0", "4", "5", "999999")]
    values = ", ".join(f"({i}, {f"TIMESTAMP '2024-03-01 {at}'" if at else "NULL::TIMESTAMP"})" for i, at in enumerate([last, None, *(beats if last else [])]))
    c.execute(f"COPY (SELECT * FROM (VALUES {values}) t(user_id, ts)) TO '{path}' (FORMAT parquet)")
    c.execute(f"CREATE VIEW events AS FROM read_parquet('{path}')")
    want = c.execute(f"SELECT user_id, alive FROM ({catalogue.ORACLES['heartbeats']})").fetchall()
    assert plain(catalogue.QUERIES["heartbeats"](spark, str(tmp_path)).select("user_id", "alive").collect()) == plain(want)
