"""Merged profiles of parts against exact figures, and how much of the data a merge reads."""

import math
import random

import pytest
from pyspark.sql import functions as F

from visitflow.operators.sketches import DISTINCT_ERROR, RANK_ERROR, add_part, profile_of_states, profile_state, read_states

FRACTIONS = [0.0, 0.1, 0.5, 0.9, 1.0]


def parts(seed):
    draw = random.Random(seed)
    return [
        [(draw.choice([None, math.nan, draw.gauss(0, 10), float(draw.randrange(50))]), draw.choice([None, "a", str(draw.randrange(3000))])) for _ in range(n)]
        for n in (4000, 1, 900, 0)
    ]


@pytest.mark.parametrize("seed", range(2))
def test_merged_parts(spark, tmp_path, seed):
    path = str(tmp_path / "states")
    rows = []
    for i, part in enumerate(parts(seed)):
        rows += part
        add_part(profile_state(spark.createDataFrame(part, "x double, t string"), f"p{i}", ["x"], ["t"]), path)
    found = {r["column"]: r for r in profile_of_states(read_states(spark, path), FRACTIONS).collect()}
    values = sorted(x for x, _ in rows if x is not None and not math.isnan(x))
    x, t = found["x"], found["t"]
    assert (x["rows"], x["missing"]) == (len(rows), len(rows) - len(values))
    assert (x["least"], x["most"]) == (values[0], values[-1])
    mean = sum(values) / len(values)
    assert x["mean"] == pytest.approx(mean)
    assert x["std"] == pytest.approx(math.sqrt(sum((v - mean) ** 2 for v in values) / (len(values) - 1)))
    for q, v in zip(FRACTIONS, x["quantiles"], strict=True):
        below, upto = sum(y < v for y in values), sum(y <= v for y in values)
        assert below / len(values) - RANK_ERROR <= q <= upto / len(values) + RANK_ERROR
    texts = {s for _, s in rows if s is not None}
    assert abs(t["different"] - len(texts)) <= math.ceil(len(texts) * DISTINCT_ERROR)
    assert abs(x["different"] - len(set(values))) <= math.ceil(len(set(values)) * DISTINCT_ERROR)
    assert t["mean"] is None and t["quantiles"] is None and t["missing"] == sum(s is None for _, s in rows)


def test_a_new_part_reads_only_itself(spark, tmp_path):
    """The state of a part comes from its own files; the merge reads states alone."""
    data, path = str(tmp_path / "data"), str(tmp_path / "states")
    for part in ("a", "b"):
        spark.range(100).withColumn("x", F.rand(1)).write.parquet(f"{data}/part={part}")
        state = profile_state(spark.read.parquet(f"{data}/part={part}"), part, ["id", "x"], [])
        assert all(f"part={part}" in f for f in state.inputFiles())
        add_part(state, path)
    merged = profile_of_states(read_states(spark, path), [0.5])
    assert all("/states/" in f for f in merged.inputFiles())
    assert {r["column"]: r["rows"] for r in merged.collect()} == {"id": 200, "x": 200}


def test_no_values(spark, tmp_path):
    empty = spark.createDataFrame([(None, None)], "x double, t string")
    rows = profile_of_states(profile_state(empty, "p", ["x"], ["t"]), [0.5]).collect()
    assert [(r["column"], r["rows"], r["missing"], r["different"], r["mean"], r["std"], r["quantiles"]) for r in sorted(rows)] == [
        ("t", 1, 1, 0, None, None, None), ("x", 1, 1, 0, None, None, None),
    ]
