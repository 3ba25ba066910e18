"""Every registered query of the graph against DuckDB on the same files."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from __spark_entry__ import QUERIES
from quillgraph.plans.registry import ORACLE_SQL

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def normal(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(f"{r[i]:.9g}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    found = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert normal([tuple(r) for r in df.collect()], df.columns) == normal(found.fetchall(), names)


def test_every_query_has_sql_or_a_reason():
    assert {n for n in QUERIES if n not in ORACLE_SQL} == {"e7_fuzzy_match"}
