"""Every registered query against its SQL twin."""

import duckdb
import pytest

from tallyloom.plans import registry
from tests.conftest import DATA, plain, rows_of, same_as_sql


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, duck, name):
    same_as_sql(spark, duck, registry.QUERIES[name], registry.SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_without_sql_runs(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_event_hop_windows_round_times_to_milliseconds(spark, tmp_path):
    path = tmp_path / "events.parquet"
    times = ["07:59:59.999499", "07:59:59.9995", "07:59:59.9996", "08:00:00", "08:00:00.0004", "09:59:59.999999", "23:59:59.9997"]
    rows = ", ".join(f"({i}, TIMESTAMP '2024-02-29 {t}', 'click', {2 ** i}::DOUBLE)" for i, t in enumerate(times))
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * FROM (VALUES {rows}) v(event_id, ts, event_type, value)) TO '{path}' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{path}')")
    cursor = con.execute(registry.SQL["event_hop_windows"])
    columns = [c[0] for c in cursor.description]
    wanted = sorted(tuple(map(plain, r)) for r in cursor.fetchall())
    assert rows_of(registry.QUERIES["event_hop_windows"](spark, str(tmp_path)), columns) == wanted
    assert ("2024-03-01 00:00:00", "2024-03-01 02:00:00") in {r[:2] for r in wanted}
