"""Every registered query against its SQL, run by another engine on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from orrery.plans import catalog

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def _norm(rows):
    return sorted(tuple(0.0 if isinstance(v, float) and v == 0 else v for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_same_as_sql(spark, db, name):
    found = catalog.QUERIES[name](spark, str(DATA))
    columns = sorted(found.columns)
    want = db.sql(f"SELECT {', '.join(columns)} FROM ({catalog.ORACLE_SQL[name]})").fetchall()
    got = [tuple(r) for r in found.select(*columns).collect()]
    assert len(got) == len(want) and got
    for a, b in zip(_norm(got), _norm(want), strict=True):
        assert all(x == y or isinstance(x, float) and abs(x - y) < 2e-4 for x, y in zip(a, b, strict=True)), (a, b)


def test_whole_tables(spark, db):
    """These queries cover every atom, or every pair of two elements, in each frame."""
    atoms, c, o = db.sql("SELECT count(*), count(*) FILTER (vec_id % 5 = 2), count(*) FILTER (vec_id % 5 = 4) FROM embeddings").fetchall()[0]
    assert catalog.QUERIES["coord_xyz_whole"](spark, str(DATA)).count() == 21 * atoms
    assert catalog.QUERIES["distance_pair_whole"](spark, str(DATA)).count() == 21 * c * o
