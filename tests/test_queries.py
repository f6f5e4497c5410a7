"""Every registered query against its DuckDB SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from quire.plans import files, native, pdf, registry  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for n in TABLES:
        c.execute(f"create view {n} as select * from '{sf}/{n}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, duck, name):
    df = registry.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(tuple(str(r[c]) for c in columns) for r in df.collect())
    cur = duck.execute(registry.ORACLE_SQL[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(str(r[names.index(c)]) for c in columns) for r in cur.fetchall())


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_calculator_errors(spark):
    from pyspark.sql import functions as F

    from quire.functions.pdf_functions import calculator

    with pytest.raises(ValueError):
        calculator("{ dup { pop } if }", [F.lit(1.0)])
    row = spark.range(1).select(*[c.alias(str(i)) for i, c in enumerate(calculator("{ 1 2 3 3 1 roll 3 copy pop pop pop -7 2 idiv }", []))]).first()
    assert tuple(row) == (3.0, 1.0, 2.0, -3.0)
