import random

import pytest
from pyspark.sql import functions as F

from voxlake.plans.ordered import CHUNK, HOT, Ordered, oversized


def rows(seed):
    rng = random.Random(seed)
    out = [(1, rng.random() ** 6 * 1000, i, rng.choice([None, 1, 2])) for i in range(700)]  # most positions near 0
    out += [(2, float(i), i, 1) for i in range(5)] + [(3, 5.0, i, i) for i in range(60)]  # a small group; one position
    out += [(None, float(i), i, 2) for i in range(80)]
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(rows(1), "k int, p double, i int, v int")


def build(df):
    o = Ordered.of(df, ["k"], ["p", "i"])
    o = o.row_number("n").previous("before", F.col("v")).following("after", F.struct("i"))
    o = o.running_sum("upto", F.col("i")).running_sum("ahead", F.col("i"), before=True)
    return o.total("whole", F.max("i"))


def test_chunks_are_small_and_in_order(df, chunked):
    with chunked(20):
        o = Ordered.of(df, ["k"], ["p", "i"])
    assert o.cut
    stats = o.df.where(HOT).groupBy("k", CHUNK).agg(F.count("*").alias("n"), F.min("p").alias("lo"), F.max("p").alias("hi")).orderBy("k", CHUNK).collect()
    assert max(r.n for r in stats if r.k == 1) <= 40
    for a, b in zip(stats, stats[1:]):
        assert a.k != b.k or a.hi < b.lo
    assert o.df.where(~F.col(HOT)).select("k").distinct().count() == 2  # the small one, and the one without a range


@pytest.mark.parametrize("limit", [3, 20, 300])
def test_cut_groups_give_the_same_windows(df, chunked, limit):
    with chunked(0):
        plain = build(df)
    with chunked(limit):
        cut = build(df)
        assert cut.cut and not plain.cut
        columns = ["k", "p", "i", "n", "before", "after", "upto", "ahead", "whole"]
        assert sorted(map(str, cut.done().select(columns).collect())) == sorted(map(str, plain.done().select(columns).collect()))


def test_oversized(df, chunked):
    with chunked(699):
        assert oversized(df, ["k"])
    with chunked(700):
        assert not oversized(df, ["k"])


@pytest.mark.parametrize("limit", [4, 30])
@pytest.mark.parametrize("falling", [False, True])
def test_missing_and_endless_positions(spark, chunked, limit, falling):
    """NULL, NaN, infinities and equal keys come in the order of an uncut window."""
    rng = random.Random(6)
    odd = [None, float("nan"), float("inf"), float("-inf"), 3.0]
    df = spark.createDataFrame([(1, rng.choice(odd) if rng.random() < 0.3 else rng.random() * 9, i) for i in range(300)], "k int, p double, i int")

    def numbered():
        o = Ordered.of(df, ["k"], ["p", "i"], falling=falling)
        return o.cut, sorted((r.i, r.n, r.s) for r in o.row_number("n").running_sum("s", F.col("i")).done().collect())

    with chunked(0):
        _, plain = numbered()
    with chunked(limit):
        cut, got = numbered()
    assert cut and got == plain


@pytest.mark.parametrize("name", ["DESCRIPTION", "pos", "NULLS LAST"])
def test_the_name_of_the_order_column_plays_no_part(spark, chunked, name):
    odd = [float("nan") if i % 5 == 0 else None if i % 7 == 0 else float(i % 11) for i in range(30)]
    df = spark.createDataFrame([(1, v, i) for i, v in enumerate(odd)], "k int, p double, i int").withColumnRenamed("p", name)

    def numbered():
        o = Ordered.of(df, ["k"], [F.col(f"`{name}`"), "i"])
        return o.cut, sorted((r.i, r.n) for r in o.row_number("n").done().collect())

    with chunked(0):
        _, plain = numbered()
    with chunked(7):
        cut, got = numbered()
    assert cut and got == plain


@pytest.mark.parametrize("limit", [0, 3, 50])
def test_last_value_before(spark, chunked, limit):
    rng = random.Random(4)
    rows = [(k, i, rng.choice([None, None, None, i])) for k, n in ((1, 90), (2, 4), (None, 20)) for i in range(n)]
    df = spark.createDataFrame(rows, "k int, i int, v int")
    with chunked(limit):
        got = {(r.k, r.i): r.last for r in Ordered.of(df, ["k"], ["i"]).last_before("last", F.col("v")).done().collect()}
    for k in (1, 2, None):
        last = None
        for _, i, v in [r for r in rows if r[0] == k]:
            assert got[k, i] == last
            last = i if v is not None else last
