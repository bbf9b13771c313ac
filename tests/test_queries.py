"""Every registered query of the library against its SQL on the smallest tables."""

import importlib
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
NAMES = [n for m in entry.CATALOGUES for n in importlib.import_module(m).QUERIES]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else tuple(map(plain, v)) if isinstance(v, list) else v


@pytest.mark.skipif(not Path(DATA).exists(), reason="no tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    got = entry.queries()[name](spark, DATA)
    found = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    want = sorted(repr(tuple(plain(row[columns.index(c)]) for c in sorted(columns))) for row in found.fetchall())
    assert sorted(got.columns) == sorted(columns)
    assert sorted(repr(tuple(plain(r[c]) for c in sorted(columns))) for r in got.collect()) == want


def test_entry(spark):
    assert entry.entry(spark).columns == ["id", "component"]


@pytest.mark.skipif(not Path(DATA).exists(), reason="no tables")
@pytest.mark.parametrize("name", ["stream_dedupe", "stream_session", "stream_tumbling"])
def test_stream_results_are_files_not_driver_rows(spark, name):
    assert entry.queries()[name](spark, DATA).inputFiles()


@pytest.mark.parametrize("mode", ["append", "complete"])
def test_stream_without_input_has_no_rows(spark, tmp_path, mode):
    from graphloom.streaming.events import drained

    spark.createDataFrame([], "k int").write.parquet(str(tmp_path / "none"))
    rows = spark.readStream.schema("k int").parquet(str(tmp_path / "none"))
    assert drained(rows if mode == "append" else rows.groupBy("k").count(), mode).count() == 0
