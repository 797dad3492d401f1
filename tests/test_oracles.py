"""Every job against its SQL on DuckDB, over whole tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from taskframe.plans.registry import all_jobs

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
JOBS = all_jobs()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"create view {name} as select * from '{path}'")
    return con


def text(value):
    if value is None or (pd.api.types.is_scalar(value) and pd.isna(value)):
        return "NULL"
    if isinstance(value, float):  # pandas turns integers with nulls into floats
        return str(int(value)) if value.is_integer() else repr(round(value, 9))
    return str(value)


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple(text(v) for v in r) for r in
                           df[columns].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", list(JOBS))
def test_job_matches_sql(spark, duck, name):
    job = JOBS[name]
    ours = job.run(spark, SF_DIR).toPandas().astype(object)
    if job.sql is None:
        return
    assert rows(ours) == rows(duck.execute(job.sql).df().astype(object))
