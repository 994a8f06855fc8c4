"""Every registered query with oracle SQL agrees with DuckDB (sf0.001)."""

import pytest

import __spark_entry__ as E
from tests.conftest import SMOKE
from tests.helpers import canon

ORACLE = E.oracle_sql()
QUERIES = E.queries()


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


SPARK_TO_DUCK = {"IntegerType()": "INTEGER", "LongType()": "BIGINT", "DoubleType()": "DOUBLE",
                 "StringType()": "VARCHAR", "BooleanType()": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_duckdb(spark, duck, name):
    sdf = QUERIES[name](spark, SMOKE)
    srows, scols = [tuple(r) for r in sdf.collect()], sdf.columns
    rel = duck.sql(ORACLE[name])
    drows, dcols = rel.fetchall(), rel.columns
    assert sorted(scols) == sorted(dcols)
    stypes = {f.name: SPARK_TO_DUCK.get(str(f.dataType), str(f.dataType)) for f in sdf.schema.fields}
    assert stypes == {c: str(t) for c, t in zip(dcols, rel.types)}
    assert len(srows) == len(drows)
    assert canon(srows, scols) == canon(drows, dcols)


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["feature", "iv", "strength"]
    assert len(rows) >= 1
