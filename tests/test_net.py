"""Training of dense nets: gradients against differences, fits against what is to be learned."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from visitflow.operators.model import PREDICTION, score_dense
from visitflow.operators.net import NetShape, fit_net, gradient, predict
from visitflow.operators.prep import FeaturePrep

PREP = FeaturePrep({"x": 0.0, "z": 0.0}, {"x": 0.0, "z": 0.0}, {"x": 1.0, "z": 1.0}, {"c": 4})


def test_gradient_is_the_slope_of_the_loss():
    draw = np.random.default_rng(0)
    shape = NetShape(["x", "z"], {"c": 4, "d": 3}, 2, (5, 3))
    weights = shape.start(3) + draw.normal(0, 0.3, len(shape.start(3)))
    batch = draw.normal(size=(40, 2)), {"c": draw.integers(0, 4, 40), "d": draw.integers(0, 3, 40)}, draw.normal(size=40)
    found, loss, statistics = gradient(shape, weights, *batch)
    assert len(statistics) == 2 * (5 + 3)
    for k in draw.choice(len(weights), 40, replace=False):
        step = np.zeros(len(weights))
        step[k] = 1e-5
        slope = (gradient(shape, weights + step, *batch)[1] - gradient(shape, weights - step, *batch)[1]) / 2e-5
        assert found[k] == pytest.approx(slope, rel=1e-3, abs=1e-3)
    # With a batch's own statistics as running ones, scoring gives the loss of training.
    errors = predict(shape, weights, statistics / 40, *batch[:2]) - batch[2]
    assert (errors**2).sum() == pytest.approx(loss)


@pytest.fixture(scope="module")
def rows(spark):
    draw = np.random.default_rng(1)
    table = [
        (f"{i:05}", float(x), float(z), int(c), float(5 * abs(x) + 2 * z + [0, 9, -4, 3][c] + 100))
        for i, (x, z, c) in enumerate(zip(draw.normal(size=900), draw.normal(size=900), draw.integers(0, 4, 900), strict=True))
    ]
    frame = spark.createDataFrame(table, "visitId string, x double, z double, c bigint, total_revenue double")
    return frame.withColumn("fullVisitorId", F.lit("v")).repartition(4, "visitId").sortWithinPartitions("visitId")


FIT = {"hidden": (16, 8), "embedding": 3, "learning_rate": 0.05}


def test_a_net_learns(spark, rows, tmp_path):
    """What no line fits is learned; a fit that was cut off goes on from its checkpoint and ends at the same net."""
    whole = fit_net(rows, PREP, steps=30, **FIT)
    spread = rows.agg(F.stddev_pop("total_revenue")).first()[0]
    scored = score_dense(rows, whole.net, ["total_revenue"], dtype=np.float64)
    error = scored.agg(F.sqrt(F.avg((F.col(PREDICTION) - F.col("total_revenue")) ** 2))).first()[0]
    assert error < 0.45 * spread
    assert len(whole.history) == 30 and whole.history[-1][0] < 0.5 * whole.history[0][0]
    path = str(tmp_path / "steps")
    fit_net(rows, PREP, steps=2, checkpoint=path, **FIT)
    resumed = fit_net(rows, PREP, steps=4, checkpoint=path, **FIT)
    assert resumed.history == whole.history[:4]


def test_early_stop_and_empty_table(spark, rows):
    noise = rows.withColumn("total_revenue", F.rand(3))
    stopped = fit_net(noise, PREP, steps=40, patience=2, **FIT)
    assert len(stopped.history) < 40
    nothing = fit_net(rows.where("x > 1000"), PREP, steps=3, **FIT)
    assert nothing.history == []
