import json

import pytest
from pyspark.sql import functions as F

from visitflow.functions.literals import parse_json_object
from visitflow.operators.clean import cast_ids, cast_totals, drop_columns
from visitflow.operators.flatten import (
    Leaf,
    add_hit_metrics,
    category_width,
    discover_leaves,
    flatten_json,
    flatten_sessions,
    spread_categories,
)


def metrics(spark, hits, totals=None):
    df = spark.createDataFrame([(hits, totals)], "hits string, totals string")
    return add_hit_metrics(df, totals=parse_json_object(F.col("totals"))).first()


def products(*entries, **hit):
    return str([{"product": list(entries), **hit}])


def test_two_products(spark):
    r = metrics(
        spark,
        products(
            {"productPrice": "23990000", "v2ProductCategory": "Home/Drinkware/"},
            {"productPrice": "24990000", "v2ProductCategory": "Home/Drinkware/"},
        ),
    )
    assert r["total_product_viewed"] == 2
    assert r["categories_viewed"] == ["Drinkware"] and r["total_category_viewed"] == 1
    assert r["average_price_product_viewed"] == pytest.approx(24.49)


PRICE_CASES = [
    ([{"productPrice": "", "localProductPrice": "5000000"}], 5.0),
    ([{"productPrice": "  ", "localProductPrice": "5000000"}], 0.0),
    ([{"productPrice": 0, "localProductPrice": "5000000"}], 5.0),
    ([{"productPrice": "0", "localProductPrice": "5000000"}], 0.0),
    ([{"productPrice": None, "localProductPrice": 5000000}], 5.0),
    ([{"productPrice": False, "localProductPrice": 5e6}], 5.0),
    ([{"productPrice": True}], 1e-6),
    ([{"productPrice": "abc"}, {"productPrice": "2000000"}], 1.0),
    ([{"productPrice": "-1000000"}], 0.0),
    ([{"productPrice": "nan"}, {"productPrice": "4000000"}], 4.0),
    ([{"productPrice": [1]}, {"productPrice": "4000000"}], 2.0),
    ([{"productPrice": [], "localProductPrice": []}, {"productPrice": "4000000"}], 2.0),
    ([{}], 0.0),
    ([], 0.0),
]


def test_mean_price(spark):
    cells = [(i, products(*entries)) for i, (entries, _) in enumerate(PRICE_CASES)]
    df = spark.createDataFrame(cells, "i int, hits string")
    rows = add_hit_metrics(df).orderBy("i").select("average_price_product_viewed").collect()
    assert [r[0] for r in rows] == pytest.approx([mean for _, mean in PRICE_CASES])


def test_entries_that_are_no_products(spark):
    cells = [
        products({"v2ProductCategory": "(not set)"}, 7),
        str([3, {"product": "x"}, {"product": None}, {"a": 1}, {"product": [{}, {}]}]),
        products(7, None),
        "[{'product': [{}]}] junk",
        "{'product': [{}]}",
        "",
        None,
    ]
    df = spark.createDataFrame(list(enumerate(cells)), "i int, hits string")
    rows = add_hit_metrics(df).orderBy("i").collect()
    assert [r["total_product_viewed"] for r in rows] == [2, 2, 2, 0, 0, 0, 0]
    assert [r["categories_viewed"] for r in rows] == [["unknown"], ["unknown"], [], [], [], [], []]


def purchase(action="6", **hit):
    return str([{"eCommerceAction": {"action_type": action}, **hit}])


def test_revenue(spark):
    both = {
        "transaction": {"transactionRevenue": "100000000"},
        "product": [{"productRevenue": "40000000"}],
    }
    mixed = {
        "a": {"transactionRevenue": "1,000"},
        "b": [{"productRevenue": " 2000000 "}],
        "productRevenue": {"productRevenue": "7000000"},
        "totalTransactionRevenue": None,
        "note": "\"productRevenue\":\"9000000\"",
        "c": {"productRevenue": 1000000, "transactionRevenue": True},
    }
    cells = [purchase(**both), purchase("2", **both), purchase(6, **both), purchase(**mixed)]
    df = spark.createDataFrame(list(enumerate(cells)), "i int, hits string")
    rows = add_hit_metrics(df).orderBy("i").collect()
    assert [r["total_revenue"] for r in rows] == pytest.approx([140, 0, 0, 10 + 1e-6])


FALLBACK_CASES = [
    ({"transactionRevenue": "0", "totalTransactionRevenue": "5000000"}, 0.0),
    ({"transactionRevenue": 0, "totalTransactionRevenue": "5000000"}, 5.0),
    ({"totalTransactionRevenue": "5000000"}, 5.0),
    ({"transactionRevenue": "3000000", "totalTransactionRevenue": "5000000"}, 3.0),
    ({"totalTransactionRevenue": "-5"}, 0.0),
    ({"totalTransactionRevenue": "nan"}, 0.0),
    ([], 0.0),
]


def test_revenue_fallback(spark):
    paid = purchase(transactionRevenue="9000000")
    cells = [(i, h, json.dumps(t)) for i, (t, _) in enumerate(FALLBACK_CASES) for h in ("[]", paid)]
    df = spark.createDataFrame(cells, "i int, hits string, totals string")
    rows = add_hit_metrics(df, totals=parse_json_object(F.col("totals"))).collect()
    free = {r["i"]: r["total_revenue"] for r in rows if r["hits"] == "[]"}
    assert free == pytest.approx({i: revenue for i, (_, revenue) in enumerate(FALLBACK_CASES)})
    assert {r["total_revenue"] for r in rows if r["hits"] != "[]"} == {9.0}


def test_spread_categories(spark):
    df = spark.createDataFrame([(["a", "b"], 2), ([], 0)], "categories_viewed array<string>, total_category_viewed bigint")
    assert category_width(df) == 2 and category_width(df, most=1) == 1
    rows = spread_categories(df, 2).select("categories_viewed_0", "categories_viewed_1").collect()
    assert [tuple(r) for r in rows] == [("a", "b"), ("", "")]


def flat(spark, cells, prefix="p"):
    df = spark.createDataFrame([(c,) for c in cells], f"{prefix} string")
    leaves = discover_leaves(df, [prefix])
    return [r.asDict() for r in flatten_json(df, leaves).collect()]


def test_flatten_leaves(spark):
    assert flat(spark, ['{"a":{"b":true},"l":[],"n":null,"e":{}}']) == [
        {"p_a_b": "True", "p_l": "", "p_n": ""}
    ]
    got = flat(spark, ['{"x":1.0,"y":12,"z":1.5,"s":"1.0","l":[1,"it\'s",true,null,2.0],"big":12345678901234567890}'])
    assert got == [
        {
            "p_x": "1.0",
            "p_y": "12",
            "p_z": "1.5",
            "p_s": "1.0",
            "p_l": "[1, \"it's\", True, None, 2.0]",
            "p_big": "12345678901234567890",
        }
    ]


def test_union_of_keys(spark):
    got = flat(spark, ['{"a":"1"}', '{"b":{"c.d":"2"}}', "bad", "  ", None, "[1]"])
    assert got[0] == {"p_a": "1", "p_b_c.d": ""}
    assert got[1] == {"p_a": "", "p_b_c.d": "2"}
    assert got[2:] == [{"p_a": "", "p_b_c.d": ""}] * 4


def test_key_that_is_scalar_or_object(spark):
    got = flat(spark, ['{"a":"x"}', '{"a":{"b":"y","c":{"d":1}}}', '{"a":{"c":"z"}}', '{"a":[1]}'])
    columns = {"p_a": "", "p_a_b": "", "p_a_c": "", "p_a_c_d": ""}
    assert got == [
        {**columns, "p_a": "x"},
        {**columns, "p_a_b": "y", "p_a_c_d": "1"},
        {**columns, "p_a_c": "z"},
        {**columns, "p_a": "[1]"},
    ]


def test_maps_stay_text(spark):
    """Keys that are data are told by their counts: one column of JSON text, whatever their number."""
    cells = [f'{{"m":{{"u{i}":{i}}},"k":{{"a":1}}}}' for i in range(150)] + ['{"m":{}}', '{"m":"text"}', "{}"]
    got = flat(spark, cells)
    assert got[7] == {"p_m": '{"u7":7}', "p_k_a": "1"}
    assert got[150:] == [{"p_m": "", "p_k_a": ""}, {"p_m": "text", "p_k_a": ""}, {"p_m": "", "p_k_a": ""}]
    # As many keys, each in several rows, are columns.
    again = [f'{{"m":{{"u{i % 150}":{i}}}}}' for i in range(300)]
    assert len(flat(spark, again)[0]) == 150
    leaf = Leaf("p", ("m",), whole=True)
    assert Leaf.from_dict(leaf.to_dict()) == leaf and Leaf.from_dict({"source": "p", "path": ["m"]}) == Leaf("p", ("m",))


def test_a_cell_of_many_keys(spark, monkeypatch):
    """200,000 keys in one cell: no name of them reaches the driver."""
    df = spark.range(3).select(
        F.concat(
            F.lit('{"a":{"b":1},"m":{'),
            F.array_join(F.transform(F.sequence(F.lit(1), F.lit(200_000)), lambda i: F.concat(F.lit('"k'), i.cast("string"), F.lit('":1'))), ","),
            F.lit("}}"),
        ).alias("p")
    )
    collected = []
    collect = type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda frame: collected.append(collect(frame)) or collected[-1])
    leaves = discover_leaves(df, ["p"])
    assert leaves == [Leaf("p", ("a", "b")), Leaf("p", ("m",), whole=True)]
    assert sum(map(len, collected)) < 20
    assert flatten_json(df, leaves).select(F.length("p_m") > 1_000_000).first()[0]


def test_root_that_is_a_map(spark):
    df = spark.createDataFrame([(f'{{"u{i}":{i}}}',) for i in range(120)], "p string")
    leaves = discover_leaves(df, ["p"])
    assert leaves == [Leaf("p", (), whole=True)]
    assert flatten_json(df, leaves).first()["p"] == '{"u0":0}'
    assert len(discover_leaves(df.limit(90), ["p"])) == 90
    assert discover_leaves(df.limit(90), ["p"], most_keys=50) == leaves


def test_name_collision_is_an_error(spark):
    with pytest.raises(ValueError, match="same column"):
        flat(spark, ['{"a_b":"1","a":{"b":"2"}}'])


def test_later_data_may_change_types(spark):
    df = spark.createDataFrame([('{"a":true}',), ('{"a":"true"}',), ('{"a":3}',), ('{"a":null}',)], "p string")
    rows = flatten_json(df, [Leaf("p", ("a",))]).collect()
    assert [r[0] for r in rows] == ["True", "true", "3", ""]


RAW = {
    "channelGrouping": "Direct",
    "date": 20180131,
    "fullVisitorId": "00123",
    "visitId": "1517385600",
    "visitNumber": 1,
    "visitStartTime": 1517385600,
    "socialEngagementType": "Not Socially Engaged",
    "customDimensions": "[{'index': '4', 'value': 'EMEA'}]",
    "device": '{"browser":"Chrome","isMobile":false,"language":"not available in demo dataset"}',
    "geoNetwork": '{"country":"Chile"}',
    "totals": '{"hits":"4","pageviews":"x","totalTransactionRevenue":"5000000"}',
    "trafficSource": '{"adwordsClickInfo":{"page":"1"}}',
    "hits": "[{'isEntrance': True, 'product': [{'productPrice': '2000000', 'v2ProductCategory': 'Home/Bags/'}]}]",
}


def test_whole_session(spark):
    schema = ", ".join(f"{k} {'bigint' if isinstance(v, int) else 'string'}" for k, v in RAW.items())
    df = spark.createDataFrame([tuple(RAW.values())], schema)
    out = flatten_sessions(df, discover_leaves(df), width=2)
    assert out.columns == sorted(out.columns)
    assert out.first().asDict() == {
        **{k: RAW[k] for k in list(RAW)[:7]},
        "customDimensions": "EMEA",
        "device_browser": "Chrome",
        "device_isMobile": "False",
        "device_language": "not available in demo dataset",
        "geoNetwork_country": "Chile",
        "totals_hits": "4",
        "totals_pageviews": "x",
        "totals_totalTransactionRevenue": "5000000",
        "trafficSource_adwordsClickInfo_page": "1",
        "total_product_viewed": 1,
        "average_price_product_viewed": 2.0,
        "total_category_viewed": 1,
        "categories_viewed_0": "Bags",
        "categories_viewed_1": "",
        "total_revenue": 5.0,
    }
    cleaned = cast_ids(cast_totals(drop_columns(out))).first().asDict()
    assert "device_language" not in cleaned
    assert cleaned["totals_hits"] == 4 and cleaned["totals_pageviews"] is None
    assert cleaned["totals_totalTransactionRevenue"] == 5e6


def test_hits_are_parsed_once(spark):
    df = spark.createDataFrame([("[]", "{}")], "hits string, totals string")
    plan = add_hit_metrics(df, totals=parse_json_object(F.col("totals")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") + plan.count("jsontostructs") == 1
