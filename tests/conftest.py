import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (str(ROOT), os.environ.get("PYTHONPATH")) if x)

DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark():
    from weftmark.session import local_session

    s = local_session(4, shuffle_partitions=4, memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def rows(df, *columns):
    """Rows as a sorted list of tuples."""
    got = [tuple(r[c] for c in (columns or df.columns)) for r in df.collect()]
    return sorted(got, key=repr)


def sql_rows(sql: str, folder: Path):
    """Columns and rows of a query in DuckDB over the tables of a folder."""
    import duckdb

    con = duckdb.connect()
    for f in sorted(folder.iterdir()):
        con.execute(f"CREATE VIEW {f.name.split('.')[0]} AS SELECT * FROM '{f}'")
    got = con.sql(sql)
    return got.columns, got.fetchall()


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def same_as_sql(df, sql: str, folder: Path) -> None:
    columns, want = sql_rows(sql, folder)
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    a = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    b = sorted((tuple(plain(dict(zip(columns, r))[c]) for c in order) for r in want), key=repr)
    assert a == b
