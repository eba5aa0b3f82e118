"""Every registered query of the engine against its SQL on the smallest tables."""

import datetime

import duckdb
import pytest

from ledgerline.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS FROM '{DATA}/{t}.parquet'")
    return c


def canon(rows):
    def text(v):
        if isinstance(v, float):
            return repr(round(v, 6))
        return str(v.replace(tzinfo=None)) if isinstance(v, datetime.datetime) else str(v)

    return sorted(tuple(map(text, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    want = duck.sql(ORACLES[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    assert canon(df.select(*cols).collect()) == canon(want.select(*[f'"{c}"' for c in cols]).fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() >= 0
