import copy
import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from visitflow.operators.encode import (
    category_index,
    category_label,
    clamp_index,
    encode_categories,
    hot_index,
    join_index,
    one_hot,
)
from visitflow.operators.policy import (
    DEFAULT_POLICY,
    apply_policy,
    fit_caps,
    model_input,
    order_columns,
    quantile_caps,
)
from visitflow.operators.prep import (
    align_columns,
    apply_prep,
    feature_columns,
    fit_prep,
    medians,
    numeric_features,
    split_features,
)
from visitflow.operators.profile import (
    describe_numeric,
    low_variance_columns,
    profile_columns,
    table_totals,
    top_values,
    value_counts,
)
from visitflow.operators.vocab import (
    categorical_columns,
    dictionary_of,
    fit_vocabulary,
    index_value,
    value_index,
    vocab_sizes,
    vocabulary_spec,
)


def column_of(spark, counts):
    rows = [(v,) for v, n in counts.items() for _ in range(n)]
    return spark.createDataFrame(rows, "c string")


def test_profile(spark):
    df = spark.createDataFrame(
        [("a", 1.0, None, 1), ("a", -0.0, None, 1), (None, 0.0, None, 1)],
        "s string, d double, n string, i int",
    )
    expected = {
        "d": ("double", 3, 0, 2, False),
        "i": ("int", 3, 0, 1, True),
        "n": ("string", 0, 3, 1, True),
        "s": ("string", 2, 1, 2, False),
    }
    for approximate in (False, True):
        rows = profile_columns(df, approximate).collect()
        assert {r["column"]: tuple(r)[1:] for r in rows} == expected
    assert low_variance_columns(profile_columns(df)) == ["i", "n"]
    assert tuple(table_totals(df).first()) == (3, 4)


def test_top_values_break_ties_by_value(spark):
    df = column_of(spark, {"b": 2, "a": 2, "c": 3, None: 2, "d": 1})
    rows = top_values(value_counts(df), 4).orderBy("rank").collect()
    assert [(r["value"], r["n"]) for r in rows] == [("c", 3), (None, 2), ("a", 2), ("b", 2)]


def test_top_values_limit_rows_before_the_shuffle(spark):
    plan = top_values(value_counts(column_of(spark, {"a": 1})))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_describe(spark):
    df = spark.createDataFrame([(1,), (2,), (10,), (4,), (None,)], "x int")
    r = describe_numeric(df).first().asDict()
    assert r == {
        "column": "x", "count": 4, "null_count": 1, "mean": 4.25, "std": pytest.approx(4.0311288741),
        "min": 1, "q25": 2, "q50": 4, "q75": 4, "max": 10,
    }


def test_vocabulary(spark):
    df = column_of(spark, {"": 9, "A": 5, "(not set)": 4, "B": 3, "(Other)": 2})
    spec = fit_vocabulary(df)["columns"]["c"]
    assert spec["top_categories_order"] == ["A", "B"]
    assert (spec["others_index"], spec["vocab_size"], spec["top_n"]) == (4, 5, 2)
    assert spec["requested_top_k"] == 5
    assert spec["value_to_index"]["A"] == 2 and spec["value_to_index"]["(Other)"] == 4
    assert spec["index_to_value"] == {"0": "__NONE__", "1": "__UNKNOWN__", "2": "A", "3": "B", "4": "__OTHER__"}
    texts = [None, "nan", "None", " A ", "UNKNOWN", "zzz", "(Other)", "(not set)", "B"]
    coded = spark.createDataFrame([(t,) for t in texts], "c string")
    index = category_index(F.col("c"), spec["value_to_index"], spec["others_index"])
    assert [r[0] for r in coded.select(index).collect()] == [0, 0, 0, 2, 4, 4, 4, 1, 3]
    label = category_label(index, spec["index_to_value"])
    assert [r[0] for r in coded.select(label).collect()][:4] == ["__NONE__"] * 3 + ["A"]
    table = spark.createDataFrame(list(spec["value_to_index"].items()), "_value string, _index bigint")
    joined = join_index(coded.withColumn("i", F.monotonically_increasing_id()), "c", table, 4)
    assert [r["c"] for r in joined.orderBy("i").collect()] == [0, 0, 0, 2, 4, 4, 4, 1, 3]


@pytest.mark.parametrize("broadcast", [True, False])
def test_join_finds_exact_before_stripped_texts(spark, broadcast):
    table = spark.createDataFrame([("a", 2), (" a", 3), ("b ", 4), ("", 0)], "_value string, _index bigint")
    texts = ["a", " a", "a ", "b", "b ", " b", None, "nan", "zzz", " "]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, c string").withColumn("_value", F.lit("kept"))
    got = join_index(df, "c", table, 9, broadcast, hot=None if broadcast else {"a ": 2, "zzz": 9})
    assert got.columns == ["i", "c", "_value"]
    assert [r["c"] for r in got.orderBy("i").collect()] == [2, 3, 2, 9, 4, 9, 0, 0, 9, 0]


def test_a_hot_value_fills_no_task(spark):
    """Nine tenths of the rows hold one value: they are dealt evenly, and only the rest is joined by its text."""
    table = spark.range(50_000).select(F.concat(F.lit("v"), F.col("id").cast("string")).alias("_value"), (F.col("id") + 2).alias("_index"))
    df = spark.range(0, 40_000, 1, 4).select(
        "id", F.when(F.col("id") % 10 != 0, " v7 ").otherwise(F.concat(F.lit("v"), (F.col("id") * 2).cast("string"))).alias("c")
    )
    settings = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        hot = hot_index(df, "c", table, 1)
        assert hot == {" v7 ": 9}
        joined = join_index(df, "c", table, 1, hot=hot)
        sizes = sorted(r["count"] for r in joined.where("c > 0").groupBy(F.spark_partition_id()).count().collect())
        wrong = joined.where(F.col("c") != F.when(F.col("id") % 10 != 0, 9).when(F.col("id") < 25_000, F.col("id") * 2 + 2).otherwise(1))
        assert len(sizes) == 16 and sizes[-1] <= 2 * sizes[8]
        assert wrong.count() == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_vocabulary_takes_fifteen_values_before_leaving_reserved_out(spark):
    counts = {f"v{i:02}": 100 - i for i in range(14)} | {"Unknown": 200, "tail": 1}
    spec = fit_vocabulary(column_of(spark, counts))["columns"]["c"]
    assert spec["top_n"] == 14 and "tail" not in spec["value_to_index"]
    assert spec["requested_top_k"] == 16


def test_values_that_differ_in_blanks_share_an_index(spark):
    spec = fit_vocabulary(column_of(spark, {"A": 2, " A": 5, "B": 3}))["columns"]["c"]
    assert spec["top_categories_order"] == ["A", "B"]


def test_lookup_tables_agree_with_the_dictionary(spark):
    df = column_of(spark, {"": 9, "A": 5, "__NONE__": 4, "__OTHER__": 3, "B": 1})
    spec = vocabulary_spec(value_counts(df))
    columns = dictionary_of(spec)["columns"]["c"]
    table = {r["value"]: r["index"] for r in value_index(spec).collect()}
    assert table == columns["value_to_index"]
    labels = {str(r["index"]): r["value"] for r in index_value(spec).collect()}
    assert labels == columns["index_to_value"]


def test_categorical_columns(spark):
    df = spark.createDataFrame([], "device string, date string, visitId string, n int, fullVisitorId string")
    assert categorical_columns(df) == ["device"]


def test_large_vocabulary_is_joined(spark):
    entries = {str(i): i for i in range(1000)}
    dictionary = {"columns": {"c": {"value_to_index": entries, "others_index": 1000}}}
    df = spark.createDataFrame([("7",), (" 9 ",), ("x",)], "c string")
    assert sorted(r[0] for r in encode_categories(df, dictionary).collect()) == [7, 9, 1000]


def test_one_hot(spark):
    df = spark.createDataFrame([(None,), (-1,), (9,), (1,)], "c bigint")
    rows = one_hot(df, {"c": 3, "gone": 2}).collect()
    assert ["".join(str(x) for x in r[:3]) for r in rows] == ["100", "100", "001", "010"]
    assert all(r["gone_0"] == r["gone_1"] == 0 for r in rows)
    assert df.select(clamp_index(F.col("c"), 3)).collect()[2][0] == 2


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.text(max_size=4)), min_size=1, max_size=30))
def test_encoded_rows_stay_in_the_vocabulary(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "c string")
    dictionary = fit_vocabulary(df)
    size = vocab_sizes(dictionary)["c"]
    encoded = encode_categories(df, dictionary)
    assert all(0 <= r["c"] < size for r in encoded.collect())
    assert all(sum(r) == 1 for r in one_hot(encoded, {"c": size}).collect())


def test_caps(spark):
    df = spark.createDataFrame([("1",), ("2",), ("10",), ("4",), ("bad",)], "x string")
    assert quantile_caps(df, {"x": 0.75}) == {"x": 4.0}
    caps = [quantile_caps(df, {"x": q})["x"] for q in (0.1, 0.5, 0.9, 0.99)]
    assert caps == sorted(caps)
    policy = {"features": [{"field": "x", "action": "log1p_cap", "cap_quantile": 0.75, "cap_value": 1.0}]}
    fitted = fit_caps(df, policy)
    assert fitted["features"][0]["cap_value"] == 4.0 and policy["features"][0]["cap_value"] == 1.0
    rows = apply_policy(df, fitted).collect()
    assert [r[0] for r in rows] == pytest.approx([math.log1p(v) for v in (1, 2, 4, 4, 0)])
    assert apply_policy(df, {"features": [{"field": "x", "action": "log1p_cap", "cap_quantile": 0.75}]}).collect() == rows


def capped_at(cap):
    """The default policy with stored caps."""
    policy = copy.deepcopy(DEFAULT_POLICY)
    for f in policy["features"]:
        if f["action"] == "log1p_cap":
            f["cap_value"] = cap
    return policy


def test_default_policy_has_no_fitted_caps(spark):
    assert not any("cap_value" in f for f in DEFAULT_POLICY["features"])
    df = spark.createDataFrame([(float(x),) for x in range(101)], "total_product_viewed double")
    fitted = fit_caps(df, capped_at(3.0))
    caps = {f["field"]: f.get("cap_value") for f in fitted["features"] if f["action"] == "log1p_cap"}
    assert caps == {"total_product_viewed": 99.0, "average_price_product_viewed": None}
    assert apply_policy(df, DEFAULT_POLICY).agg(F.max("total_product_viewed")).first()[0] == pytest.approx(math.log1p(99))


def test_policy_and_order(spark):
    df = spark.createDataFrame(
        [("x", 20180131, "7", 1.5, "v1", "s1", 500.0, "Direct")],
        "rest string, date bigint, totals_hits string, total_revenue double, fullVisitorId string,"
        " visitId string, total_product_viewed double, channelGrouping string",
    ).withColumns({"visitStartTime": F.lit(1525132800), "totals_transactions": F.lit(1)})
    dictionary = {"columns": {"channelGrouping": {"value_to_index": {"Direct": 2}, "others_index": 3}}}
    out = model_input(df, capped_at(181.0), dictionary)
    assert out.columns == [
        "fullVisitorId", "visitId", "total_revenue", "total_product_viewed", "totals_hits",
        "date_dow", "date_month", "date_is_weekend", "vst_hour", "vst_dow", "vst_is_weekend",
        "channelGrouping", "rest",
    ]
    r = out.first()
    assert r["total_revenue"] == pytest.approx(math.log1p(1.5))
    assert r["total_product_viewed"] == pytest.approx(math.log1p(181))
    assert r["totals_hits"] == pytest.approx(math.log1p(7))
    assert tuple(r)[5:12] == (2, 1, 0, 0, 1, 0, 2)
    assert order_columns(df.select("rest", "visitId"), ["rest"]).columns == ["visitId", "rest"]


def test_model_input_is_one_projection(spark):
    df = spark.createDataFrame([("a", 1.0)], "channelGrouping string, total_revenue double")
    plan = model_input(df, capped_at(181.0), {"columns": {}})._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Project [") == 1


def test_prep(spark):
    df = spark.createDataFrame(
        [(1.0, 7, 1), (float("nan"), 7, None), (3.0, 7, 5), (None, 7, 2)], "x double, k int, i int"
    )
    assert medians(df, ["x"]) == {"x": 2.0}
    prep = fit_prep(df)
    assert prep.fill == {"x": 2.0, "k": 0.0, "i": 0.0}
    assert prep.mean == {"x": 2.0, "k": 7.0, "i": 2.0}
    assert prep.std["x"] == pytest.approx(math.sqrt(0.5)) and prep.std["k"] == 1.0
    rows = apply_prep(df, prep, keep=[]).collect()
    assert [r["x"] for r in rows] == pytest.approx([-math.sqrt(2), 0, math.sqrt(2), 0])
    assert [r["k"] for r in rows] == [0, 0, 0, 0]
    far = spark.createDataFrame([(1e9, math.inf), (-1e9, -math.inf)], "x double, i double")
    got = apply_prep(far, prep).select("x", "i", "k").collect()
    assert [tuple(r) for r in got] == [(10, 10, -7), (-10, -10, -7)]


def test_feature_lists(spark):
    df = spark.createDataFrame([], "fullVisitorId string, total_revenue double, a int, b string, c bigint")
    assert feature_columns(df) == ["a", "b", "c"]
    assert numeric_features(df) == (["a", "c"], ["b"])
    assert split_features(["a", "c"], {"columns": {"c": {}}}) == (["c"], ["a"])
    row = spark.createDataFrame([(3,)], "a int").select(*align_columns(df.select("a"), ["a", "z"], {"z": 1.5}))
    assert tuple(row.first()) == (3.0, 1.5)
