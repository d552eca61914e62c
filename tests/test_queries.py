"""Every registered query of the text engine against its SQL."""

import glob
import os
from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest

from sorimill.functions import grammar
from sorimill.plans import queries as plans
from sorimill.streaming.text import diagnostics_by_window, normalize_stream

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return c


@pytest.fixture(scope="module")
def results(spark):
    """The rows of every query; most of the time goes into planning, which threads share."""

    def rows(name):
        df = plans.queries()[name](spark, FOLDER)
        columns = sorted(df.columns)
        return columns, sorted(str(tuple(r[c] for c in columns)) for r in df.collect())

    with ThreadPoolExecutor(6) as pool:
        return {name: pool.submit(rows, name) for name in plans.queries()}


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query_equals_sql(results, sql, name):
    columns, mine = results[name].result()
    want = sql.sql(plans.oracle_sql()[name])
    assert columns == sorted(want.columns)
    assert mine == sorted(map(str, want.select(", ".join(columns)).fetchall()))
    assert mine


def test_every_kind_has_a_row():
    spoken = "currency iso_currency scaled_currency scaled_range range number_suffix date month_day year_month emergency ordinal time_range unit_per".split()
    assert set(grammar.KINDS) <= {*plans._KINDS, *spoken, "ambiguous_numeric"}


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:00:10", "3개"), ("2024-01-01 00:00:50", "Tom Lee"), ("2024-01-01 00:01:10", "Tom")], "ts string, text string")
    rows.selectExpr("cast(ts as timestamp) as ts", "text").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, text string").parquet(f"{tmp_path}/in")
    for df, name, mode in ((normalize_stream(stream), "spoken", "append"), (diagnostics_by_window(stream, "ts"), "reports", "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").start()
        q.processAllAvailable()
        q.stop()
    assert sorted(r.spoken for r in spark.table("spoken").collect()) == ["Tom", "Tom Lee", "세 개"]
    assert sorted((r.code, r.n) for r in spark.table("reports").collect()) == [("unconverted_latin", 1), ("unconverted_latin", 2)]
