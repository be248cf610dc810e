"""Every registered query of the engine against its SQL in DuckDB."""

from pathlib import Path

import duckdb
import pytest

from lodestone.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the driver's tables are not here")


def canonical(rows):
    return sorted(tuple(repr(round(x, 9)) if isinstance(x, float) else repr(x) for x in r) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return con


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", ["merkle_levels", "inclusion_proof_paths", "proof_verify"])
def test_trees_and_proofs_of_every_module(spark, name):
    found = QUERIES[name](spark, SF).select("memory_type").distinct().collect()
    assert {r.memory_type for r in found} == {r.memory_type for r in QUERIES["merkle_root_by_module"](spark, SF).collect()} and len(found) == 5


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, SF)
    result = duck.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(found.columns)
    assert canonical(found.select(*columns).collect()) == canonical(result.fetchall())
