"""Links by either of two keys: the pairs of the SQL, made by many tasks, remembered by none."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from graphloom.operators import links as L


def tables(spark, path, customers, suppliers):
    spark.createDataFrame(customers, "c_custkey long, c_nationkey int, c_mktsegment string").coalesce(1).write.parquet(f"{path}/customer.parquet")
    spark.createDataFrame(suppliers, "s_suppkey long, s_nationkey int").coalesce(1).write.parquet(f"{path}/supplier.parquet")
    return str(path)


def test_either_key_with_nulls_and_repeats(spark, tmp_path):
    kinds = [(n, s) for n in (4, 5, None) for s in ("MACHINERY", "BUILDING", None)]
    customers = [(k, *kinds[(k * k + i) % 9]) for k in range(40) for i in range(k % 4)] + [(None, n, s) for n, s in kinds] * 2
    suppliers = [(k, (4, 4, 7, None)[(k + i) % 4]) for k in range(10, 50) for i in range(k % 3 + 1)] + [(None, 4), (None, 4), (None, None)]
    d = tables(spark, tmp_path, customers, suppliers)
    con = duckdb.connect()
    for t in ("customer", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet/*.parquet'")
    want = con.execute(entry.oracle_sql()["link_registers_or"]).fetchall()
    got = [tuple(r) for r in entry.queries()["link_registers_or"](spark, d).select("c_custkey", "s_suppkey").collect()]
    assert len(got) == len(set(got)) > 100
    assert sorted(map(repr, got)) == sorted(map(repr, want))


@pytest.mark.parametrize("customers, suppliers", [([], []), ([(1, 4, "MACHINERY")], []), ([], [(1, 4)])])
def test_either_key_without_rows(spark, tmp_path, customers, suppliers):
    assert entry.queries()["link_registers_or"](spark, tables(spark, tmp_path, customers, suppliers)).collect() == []


def test_no_task_remembers_pairs(spark, tmp_path):
    d = tables(spark, tmp_path, [(k, 4, "MACHINERY") for k in range(400)], [(k, 4) for k in range(200)])
    got = entry.queries()["link_registers_or"](spark, d)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "Aggregate" not in plan[: plan.index("Join")]  # above the joins nothing gathers their rows
    parts = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(parts) == 400 * 200 and max(parts) <= 400 * 200 / 2  # nor does one task make them all


def test_all_pairs_keeps_repeated_rows(spark):
    left, right = spark.createDataFrame([(1,), (1,), (None,)], "a int"), spark.createDataFrame([(2,), (2,)], "b int")
    assert sorted(map(repr, map(tuple, L.all_pairs(left, right).collect()))) == ["(1, 2)"] * 4 + ["(None, 2)"] * 2
