"""Every registered query of the library against its SQL in DuckDB, on the smallest tables."""

import math
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from tessera.plans import catalog

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
ROOT = Path(__file__).resolve().parent.parent


def plain(value):
    """A value that both engines' results can be compared by."""
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value + 0.0:.9g}")
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in value.items())
    if hasattr(value, "asDict"):
        return plain(value.asDict())
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    return value


def rows(names, found):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[k]) for k in order) for r in found), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in Path(SF_DIR).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    got = catalog.queries()[name](spark, SF_DIR)
    want = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())


def test_entry_is_imported_without_a_session():
    """Column expressions need a session, so none may stand at the top of a module."""
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert len(e.queries()) > 30 and e.oracle_sql()"], cwd=ROOT, check=True, timeout=120)
