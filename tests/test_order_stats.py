import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from visitflow.operators.order_stats import exact_quantiles, values_at_ranks
from visitflow.operators.split import first_rows, sample_rows, split_rows, time_split


def quantiles(df, column, qs, **settings_):
    return exact_quantiles(df, {"x": (F.col(column), qs)}, **settings_)["x"]


def test_small_quantiles(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 10, 4)], "x double")
    assert quantiles(df, "x", [0.99, 0.0, 1.0]) == pytest.approx([9.82, 1, 10])
    assert quantiles(df, "x", [0.25, 0.5, 0.75], interpolation="nearest") == [2, 4, 4]
    assert quantiles(df.filter("x > 99"), "x", [0.5]) == [None]


@pytest.mark.parametrize("kind", ["distinct", "one hot value", "few values", "nulls"])
def test_brackets_narrow_to_exact_values(spark, kind):
    """A tiny sort limit forces the sketch and counting passes."""
    rng = random.Random(kind)
    n = 20_000
    values = {
        "distinct": [rng.uniform(-1e6, 1e6) for _ in range(n)],
        "one hot value": [7.0 if rng.random() < 0.4 else rng.gauss(7, 2) for _ in range(n)],
        "few values": [float(rng.randint(0, 9)) for _ in range(n)],
        "nulls": [None if rng.random() < 0.3 else rng.expovariate(1) for _ in range(n)],
    }[kind]
    qs = [0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0]
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(4)
    got = quantiles(df, "x", qs, sorted_rows=10)
    known = [v for v in values if v is not None]
    assert got == pytest.approx([float(v) for v in np.quantile(known, qs)], rel=1e-12)
    assert got == sorted(got)


def test_several_columns_share_the_passes(spark):
    df = spark.range(10_000).select(F.col("id").cast("double").alias("a"), (-F.col("id")).cast("double").alias("b"))
    got = exact_quantiles(
        df, {"a": (F.col("a"), [0.5]), "b": (F.col("b"), [0.1, 0.5])}, sorted_rows=50
    )
    assert got == {"a": [4999.5], "b": [pytest.approx(-8999.1), -4999.5]}


def test_ranks_outside_are_left_out(spark):
    df = spark.range(5).select(F.col("id").cast("double").alias("x"))
    assert values_at_ranks(df, {"x": F.col("x")}, {"x": [-1, 4, 5]}, {"x": 5}) == {("x", 4): 4.0}


def ids(df):
    return sorted(r["visitId"] for r in df.select("visitId").collect())


@pytest.mark.parametrize("sorted_rows", [5, 1_000_000])
def test_time_split_by_text_key(spark, sorted_rows):
    keys = [str(random.Random(i).randint(1, 10**12)) for i in range(3000)]
    rows = [(k, f"v{i}") for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "visitId string, fullVisitorId string").repartition(3)
    train, validation = time_split(df, 0.9, sorted_rows=sorted_rows)
    ordered = sorted(keys)
    assert ids(train) == ordered[:2700]
    assert ids(validation) == ordered[2700:]
    assert ids(first_rows(df, 17, sorted_rows=sorted_rows)) == ordered[:17]


@pytest.mark.parametrize("sorted_rows", [3, 1_000_000])
def test_split_with_one_hot_key_and_copies(spark, sorted_rows):
    """One key and one group of copies hold a third of the rows each."""
    rows = [("5", f"v{i:03}", i) for i in range(200)]
    rows += [("6", "same", 1)] * 200
    rows += [(str(i), "x", i) for i in range(7, 207)]
    df = spark.createDataFrame(rows, "visitId string, fullVisitorId string, n int").repartition(4)
    order = sorted(rows, key=lambda r: (r[0], r[1]))
    for cut in (0, 77, 200, 333, 600):
        head, tail = split_rows(
            df, [F.col("visitId"), F.col("fullVisitorId")], cut, 600, sorted_rows=sorted_rows
        )
        assert sorted(tuple(r) for r in head.collect()) == sorted(order[:cut])
        assert sorted(tuple(r) for r in tail.collect()) == sorted(order[cut:])


def test_ten_rows(spark):
    df = spark.createDataFrame([(str(i), "v") for i in range(10)], "visitId string, fullVisitorId string")
    train, validation = time_split(df)
    assert train.count() == 9 and ids(validation) == ["9"]


def test_null_and_unicode_keys(spark):
    keys = ["", "a", "a\0", "ab", "zebra", "é", "日本", "𝄞", None, None]
    df = spark.createDataFrame([(k, str(i)) for i, k in enumerate(keys)], "visitId string, fullVisitorId string")
    for cut in (1, 4, 8, 9):
        head, tail = split_rows(df, [F.col("visitId")], cut, 10, sorted_rows=1)
        got = [r[0] for r in head.select("visitId").collect()]
        expected = sorted(keys[:8])[:cut] + [None] * max(0, cut - 8)
        assert sorted(got, key=lambda k: (k is None, k)) == expected
        assert tail.count() == 10 - cut


@pytest.mark.parametrize("sorted_rows", [2, 1000])
def test_long_keys_beyond_doubles(spark, sorted_rows):
    keys = [2**62 + i for i in range(20)] + [-(2**62) - i for i in range(20)] + [0, 1]
    df = spark.createDataFrame([(k,) for k in keys], "visitId bigint")
    for cut in (7, 27):
        head, tail = split_rows(df, [F.col("visitId")], cut, 42, sorted_rows=sorted_rows)
        assert ids(head) == sorted(keys)[:cut] and ids(tail) == sorted(keys)[cut:]
    with pytest.raises(ValueError, match="cannot be split"):
        split_rows(df, [F.col("visitId").cast("decimal(20,0)")], 1, 42)


def test_sample(spark):
    df = spark.range(5000)
    a, b = sample_rows(df, 321, sorted_rows=10), sample_rows(df.repartition(7), 321)
    picked = sorted(r[0] for r in a.collect())
    assert len(set(picked)) == 321
    assert picked == sorted(r[0] for r in b.collect())
    assert picked != sorted(r[0] for r in sample_rows(df, 321, seed=1).collect())
    assert sample_rows(df, 9999).count() == 5000


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    values=st.lists(st.floats(-100, 100, width=16), min_size=1, max_size=60),
    qs=st.lists(st.floats(0, 1), min_size=2, max_size=3),
)
def test_quantiles_match_numpy(spark, values, qs):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = quantiles(df, "x", sorted(qs), sorted_rows=4)
    assert got == pytest.approx(list(np.quantile(values, sorted(qs))), rel=1e-9, abs=1e-9)
