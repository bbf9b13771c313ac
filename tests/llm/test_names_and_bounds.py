"""Columns of any name, odd sources, and bounds on rows and memory."""

import random

import numpy as np
import pyarrow as pa
import pytest

from graphloom.llm import lines, mixing, simhash
from graphloom.llm.components import components
from graphloom.llm.tokens import HELD_IDS, PieceEncoder, encoded
from tests_llm_brute import brute_components

NAMES = ("a.b", "__doc", "__tag", "__gone", "__copies", "__copy", "__once", "__order", "__whole", "__range", "row", "own", "order", "id", "tokens", "c0", "none", "gone", "copies", "tag", "doc", "text2", "select", "x y")


@pytest.fixture(scope="module")
def named(spark, unique):
    """Documents with columns of many names, each holding its place and the document's id."""
    schema = "doc_id bigint, text string, lang string, source string, " + ", ".join(f"`{n}` string" for n in NAMES)
    rows = [(*r[:4], *(f"{n}:{r[0]}" for n in NAMES)) for r in unique]
    return spark.createDataFrame(rows, schema).repartition(3)


def check_names(df, like):
    assert [c for c in df.columns if c not in ("n_removed", "budget")] == like.columns
    for r in df.collect():
        assert all(r[n] == f"{n}:{r.doc_id}" for n in NAMES if n != "copies")
    return df


def test_stages_keep_columns_of_any_name(named):
    check_names(lines.drop_fuzzy_lines(named), named)
    check_names(simhash.keep_one(named), named)
    check_names(mixing.apply_mix(named, weights={"lang": {"en": 2.0}}), named)
    tagged = mixing.with_domain(named).withColumn("tokens", mixing.n_tokens())
    mixed = mixing.mix(tagged)
    assert mixed.count() == named.count() and set(mixed.columns) == set(tagged.columns) | {"budget"}
    for r in mixed.collect():
        assert all(r[n] == f"{n}:{r.doc_id}" for n in NAMES if n not in ("copies", "tokens"))


def test_domains_of_odd_sources(spark):
    rows = [("src3",), ("src99999999999",), ("x",), (None,), ("src2147483647",), ("src2147483648b7",)]
    got = [r.domain for r in mixing.with_domain(spark.createDataFrame(rows, "source string")).collect()]
    assert got == ["web", "reference", "reference", "reference", "reference", "reference"]


@pytest.mark.parametrize(("bits", "n"), [(16, 6000), (22, 6000), (30, 4000)])
def test_simhash_rows_do_not_grow_with_the_bucket(spark, bits, n):
    """Fingerprints that differ in a few free bits: dense, in between and sparse buckets cost a few copies each."""
    r = random.Random(bits)
    base, fps = r.getrandbits(64 - bits) << bits, set()
    while len(fps) < n:
        fps.add(base | r.getrandbits(bits))
    by_id = dict(enumerate(sorted(fps)))
    df = spark.createDataFrame([(i, x - (1 << 64) if x >> 63 else x) for i, x in by_id.items()], "id bigint, fp bigint")
    dealt, known = simhash.deal(df, tile=512)
    # ten block pairs; a row of a large one is there in four blocks at most twice over, never n / 512 times
    assert dealt.count() <= 10 * n * 16
    if bits == 16:
        assert dealt.count() <= 10 * n * 2
    found = {x.id: x.component for x in components(simhash.links(df, tile=512)).collect()}
    label = np.arange(n)
    ids, values = np.array(list(by_id)), np.array(list(by_id.values()), np.uint64)
    one, two = [], []
    for step in range(1, n):
        near = np.flatnonzero(np.bitwise_count(values[step:] ^ values[:-step]) <= 3)
        one.append(near)
        two.append(near + step)
    label = simhash.forest(n, np.concatenate([*one, ids]), np.concatenate([*two, ids]))
    assert [found.get(i, i) for i in range(n)] == label.tolist()


def test_simhash_small_tiles_lose_nothing(spark):
    r = random.Random(5)
    fps = {r.getrandbits(12): i for i in range(300)} | {1 << 40 | r.getrandbits(30): 1000 + i for i in range(300)}
    by_id = {i: x for x, i in fps.items()}
    df = spark.createDataFrame([(i, x) for i, x in by_id.items()], "id bigint, fp bigint")
    want = brute_components(by_id)
    for tile in (2, 16):
        found = {x.id: x.component for x in components(simhash.links(df, tile=tile)).collect()}
        assert {i: found.get(i, i) for i in by_id} == want


def test_long_pieces_are_not_remembered():
    encoder = PieceEncoder()
    text = "".join(random.Random(1).choices("abcdefghij0123456789一二三四五六七八九十", k=1_000_000))
    for _ in range(4):
        for _, ids, counts in encoded(pa.array([text, text[::-1], "a word"]), encoder):
            assert len(ids) == counts.sum()
        assert encoder._used <= HELD_IDS + 4_000_000
    assert len(encoder._slot) < 100_000
