"""Every registered query of the graph engine against its SQL on DuckDB."""

import datetime
import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from quillgraph.plans import queries as plans

DATA = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v.replace(tzinfo=None).isoformat() if isinstance(v, datetime.datetime) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", list(plans.QUERIES))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(repr(plain(tuple(r))) for r in df.select(*cols).collect())
    if name not in plans.SQL:
        assert got
        return
    want = duck.sql(plans.SQL[name])
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    assert got == sorted(repr(plain(tuple(r[k] for k in at))) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["s", "name"]


def test_the_rest_does_not_need_the_llm_folder():
    """Nothing outside quillgraph.llm and corpus_pipeline.py imports them, but for the guard of the entry."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for path in glob.glob(f"{root}/quillgraph/**/*.py", recursive=True):
        if "/llm/" not in path:
            assert "llm" not in open(path, encoding="utf-8").read(), path
