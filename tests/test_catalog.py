"""Every query that SQL can express gives what DuckDB gives on the same tables; the others give rows."""

from pathlib import Path

import duckdb
import pytest

from sievewright.plans import catalog


def canonical(value):
    if isinstance(value, float):
        return int(value) if value.is_integer() else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(map(canonical, value))
    return value


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, name):
    df = catalog.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    rows = sorted(repr(tuple(canonical(r[c]) for c in columns)) for r in df.collect())
    if name not in catalog.ORACLES:
        assert rows
        return
    db = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        db.execute(f"create view {p.stem} as select * from '{p}'")
    cursor = db.execute(catalog.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert rows == sorted(repr(tuple(canonical(r[i]) for i in order)) for r in cursor.fetchall())
