import numpy as np
import pytest
from pyspark.sql import functions as F

from visitflow.operators.evaluate import (
    compare_visitors,
    evaluation_report,
    regression_metrics,
    visitor_actuals,
    visitor_predictions,
    visitor_table,
    visitors_missing,
)
from visitflow.operators.model import PREDICTION, DenseLayer, DenseNet, fit_regressor, score, score_dense
from visitflow.operators.prep import FeaturePrep, apply_prep
from visitflow.plans.training import train_and_evaluate


def metrics(spark, pairs):
    df = spark.createDataFrame(pairs, "p double, a double")
    return regression_metrics(df, F.col("p"), F.col("a")).first()


def test_metrics(spark):
    r = metrics(spark, [(1.0, 2.0), (3.0, 3.0), (5.0, 1.0)])
    assert (r["n"], r["rmse"], r["mae"]) == (3, pytest.approx((17 / 3) ** 0.5), pytest.approx(5 / 3))
    assert r["r2"] == pytest.approx(1 - 17 / 2)
    assert metrics(spark, [(1.5, 1.0), (1.0, 1.0)])["r2"] == 0.0
    assert metrics(spark, [(1.0, 1.0), (1.0, 1.0)])["r2"] == 1.0
    assert metrics(spark, [(1.0, 1.0)])["r2"] is None


def test_visitors(spark):
    scored = spark.createDataFrame(
        [("a", 1.0, 2.0), ("a", 0.5, 0.0), ("b", 0.0, 1.0), (None, 9.0, 9.0)],
        f"fullVisitorId string, {PREDICTION} double, total_revenue double",
    )
    expected = {"a": (1.5, 2.0), "b": (0.0, 1.0)}
    joined = compare_visitors(visitor_predictions(scored), visitor_actuals(scored))
    for table in (joined, visitor_table(scored)):
        assert {r[0]: (r[1], r[2]) for r in table.collect()} == expected
    assert visitors_missing(scored).first()[0] == 1
    report = {(r[0], r[1]): r[2] for r in evaluation_report(scored.filter("fullVisitorId = 'a'"), scored).collect()}
    assert report["test", "n"] == 2 and report["validation", "n"] == 2
    assert report["test", "mae"] == pytest.approx(0.75)
    assert report["validation", "mae"] == pytest.approx(0.75)


def test_one_shuffle_per_visitor_table(spark):
    scored = spark.range(10).select(
        F.col("id").cast("string").alias("fullVisitorId"),
        F.lit(1.0).alias(PREDICTION),
        F.lit(2.0).alias("total_revenue"),
    )
    plan = visitor_table(scored)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


@pytest.fixture(scope="module")
def sessions(spark):
    rng = np.random.default_rng(1)
    x, z = rng.normal(size=400), rng.normal(size=400)
    rows = [
        (f"v{i % 50}", f"{i:05}", float(3 * a - 1 + 0.01 * b), float(a), float(b))
        for i, (a, b) in enumerate(zip(x, z, strict=True))
    ]
    return spark.createDataFrame(
        rows, "fullVisitorId string, visitId string, total_revenue double, x double, z double"
    ).repartition(2)


def test_linear(sessions):
    scored = score(fit_regressor(sessions, ["x", "z"], kind="linear"), sessions, floor=False)
    assert regression_metrics(scored, F.col(PREDICTION), F.col("total_revenue")).first()["r2"] > 0.9999
    floored = score(fit_regressor(sessions, ["x", "z"], kind="linear"), sessions)
    assert floored.agg(F.min(PREDICTION)).first()[0] == 0.0


def test_boosted_trees_repeat(sessions):
    runs = [
        score(fit_regressor(sessions, ["x", "z"], maxIter=4, maxDepth=3), sessions, floor=False)
        for _ in range(2)
    ]
    r2 = [regression_metrics(r, F.col(PREDICTION), F.col("total_revenue")).first()["r2"] for r in runs]
    assert r2[0] == r2[1] > 0.7
    with pytest.raises(ValueError, match="unknown regressor"):
        fit_regressor(sessions, ["x"], kind="other")


def test_training(spark, sessions):
    result = train_and_evaluate(
        sessions.withColumn("note", F.lit("text")), sessions.drop("z"), kind="linear", max_train=300
    )
    assert result.left_out == ["note"] and result.prep.features == ["x", "z"]
    report = {(r[0], r[1]): r[2] for r in result.report.collect()}
    assert report["validation", "n"] == 30 and report["validation", "r2"] > 0.9999
    assert report["test", "n"] == result.predictions.count() == 50


def test_one_hot_training(spark):
    """Each category's mean is predicted; wide vocabularies stay sparse; unknown and absent indices are clamped."""
    rows = [(f"v{i}", f"{i:05}", float(i % 5 * 10 + i % 2), i % 5) for i in range(400)]
    table = spark.createDataFrame(rows, "fullVisitorId string, visitId string, total_revenue double, c bigint")
    fit = {"kind": "linear", "tol": 1e-12, "maxIter": 300}
    result = train_and_evaluate(table, table.withColumn("c", F.when(F.col("c") != 4, F.col("c"))), indices={"c": 5}, **fit)
    assert result.prep.features == ["c"] and result.left_out == []
    scored = score(result.model, apply_prep(table, result.prep), floor=False)
    means = {r[0]: r[1] for r in scored.groupBy("c").agg(F.avg(PREDICTION)).collect()}
    assert means == pytest.approx({c: c * 10 + 0.5 for c in range(5)}, abs=1e-4)
    assert "_features" not in scored.columns
    wide = fit_regressor(table, ["c"], one_hot={"c": 6000}, **fit)
    assert wide.stages[-1].numFeatures == 6000
    r2 = regression_metrics(score(wide, table, floor=False), F.col(PREDICTION), F.col("total_revenue")).first()["r2"]
    assert r2 > 0.99
    prepared = apply_prep(table.select("visitId", (F.col("c") + 3).alias("c")), result.prep, ["visitId"])
    assert {r["c"] for r in prepared.collect()} == {3, 4}
    assert {r["c"] for r in apply_prep(table.drop("c"), result.prep).collect()} == {0}
    again = FeaturePrep.from_dict(result.prep.to_dict())
    assert again == result.prep and FeaturePrep.from_dict({"fill": {"x": 0.0}, "mean": {"x": 0.0}, "std": {"x": 1.0}}).indices == {}


def test_dense_net(spark):
    rng = np.random.default_rng(7)

    def layer(inputs, outputs):
        return DenseLayer(
            rng.normal(size=(outputs, inputs)), rng.normal(size=outputs), rng.normal(size=outputs),
            rng.normal(size=outputs), rng.normal(size=outputs), rng.uniform(0.5, 2, size=outputs),
        )

    net = DenseNet(
        numeric=["x", "y"],
        embeddings={"c": rng.normal(size=(5, 3))},
        layers=[layer(5, 8), layer(8, 4)],
        out_weight=rng.normal(size=4),
        out_bias=0.25,
    )
    rows = [(str(i), float(rng.normal()), float(rng.normal()), c) for i, c in enumerate([0, 1, 4, 9, -3, None])]
    df = spark.createDataFrame(rows, "id string, x double, y double, c bigint")
    got = {r["id"]: r[PREDICTION] for r in score_dense(df, net, ["id"], floor=False).collect()}
    for name, x, y, c in rows:
        h = np.concatenate([net.embeddings["c"][min(4, max(0, c or 0))], [x, y]])
        for one in net.layers:
            h = one.weight @ h + one.bias
            h = (h - one.running_mean) / np.sqrt(one.running_var + 1e-5) * one.gamma + one.beta
            h = np.maximum(h, 0)
        assert got[name] == pytest.approx(net.out_weight @ h + 0.25, rel=1e-4, abs=1e-4)
    assert min(r[PREDICTION] for r in score_dense(df, net, ["id"]).collect()) >= 0
    absent = {r["id"]: r[PREDICTION] for r in score_dense(df.drop("c"), net, ["id"], floor=False).collect()}
    assert absent["0"] == got["0"] and absent["5"] == got["5"] and absent["2"] != got["2"]
