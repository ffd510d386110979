"""Every library query against its SQL in DuckDB."""

import duckdb
import pytest
from meshweave.plans import coverage, queries, shapes, spheres

QUERIES = queries.QUERIES | coverage.QUERIES | shapes.QUERIES | spheres.QUERIES
ORACLE_SQL = queries.ORACLE_SQL | coverage.ORACLE_SQL | shapes.ORACLE_SQL | spheres.ORACLE_SQL
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


def rows(frame):
    clean = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(clean(v) for v in r) for r in frame), key=repr)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"regrid_spheres", "regrid_large_lattice"}))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert rows(map(tuple, df.select(*columns).collect())) == rows(want)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


def test_weight_table_has_the_weights_of_cells_without_items(spark):
    found = queries.esmf_weight_table(spark, SF).collect()
    occupied = {r.cell_id for r in queries.lineitem_field(spark, SF).collect()}
    want = {(r.dst, r.src) for r in queries.lineitem_regridder(spark).weights.collect()}
    assert {(r.row, r.col) for r in found} == want and len(found) == len(want)
    assert any(r.col not in occupied for r in found)
    assert all((r.value > 0) == (r.col in occupied) for r in found)
