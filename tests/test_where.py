import pytest

from graphloom.operators.where import parse_where, query, where

ROWS = [(0, "Alpha", None, True, ["a", "Bee"], [(1,)], {"k": 1}), (1, "100%_x", 5, False, [], None, {}), (2, None, 7, None, ["a", None], [(2,)], None)]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, "_ord int, name string, n int, flag boolean, words array<string>, parts array<struct<x:int>>, m map<string,int>")


def test_parse():
    assert parse_where("a=1,b~x=y,c:d=e,nothing,=z,") == [("a", "=", "1"), ("b", "~", "x=y"), ("c", "=", "d=e")]
    assert parse_where(None) == parse_where("") == []


@pytest.mark.parametrize(
    "text, ids",
    [
        ("name=Alpha", {0}), ("name~ALPH", {0}), ("name~%_", {1}), ("name=null", {2}), ("name~null", set()), ("name~", {0, 1, 2}), ("n=5", {1}), ("n=null", {0}), ("flag=true", {0}),
        ("flag=null", {2}), ("words=a", {0, 2}), ("words=bee", set()), ("words~BE", {0}), ("parts=1", set()), ("parts~object", {0, 2}), ("m=[object Object]", {0, 1}), ("nokey=undefined", {0, 1, 2}),
        ("nokey~undef", set()), ("nokey~", {0, 1, 2}), ("words=a,flag=null", {2}), ("", {0, 1, 2}),
    ],
)
def test_where(df, text, ids):
    assert {r._ord for r in where(df, text).collect()} == ids


def test_limits(df):
    assert [r._ord for r in query(df, None, limit=2).collect()] == [0, 1]
    assert [r._ord for r in query(df, None, limit=-1).collect()] == [0, 1]
    assert query(df, None, limit=None).count() == 3
