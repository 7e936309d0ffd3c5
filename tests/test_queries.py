from pathlib import Path

import pytest
from oracle import SF, TABLES, check

from strandline import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    check(spark, name, registry.QUERIES[name], registry.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_legacy_migrate_with_long_ids(spark, tmp_path):
    import duckdb

    for t in set(TABLES) - {"events"}:
        (tmp_path / f"{t}.parquet").symlink_to(Path(SF) / f"{t}.parquet")
    duckdb.sql(f"COPY (SELECT * REPLACE (event_id + i AS event_id) FROM '{SF}/events.parquet', (VALUES (0), (1234567), (3000000000)) s(i)) TO '{tmp_path}/events.parquet'")
    check(spark, "legacy_migrate", registry.QUERIES["legacy_migrate"], registry.ORACLE_SQL["legacy_migrate"], str(tmp_path))


def test_entry_module(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert registry.flagship(spark, SF).count() == 1
