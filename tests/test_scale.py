"""Work on cells is done once for each cell, and types are looked up only where they decide."""

from pyspark.sql import functions as F

from visitflow.functions.literals import is_plain_literal, parse_literal, print_depends, variant_text
from visitflow.functions.numbers import text_to_long
from visitflow.operators.flatten import Leaf, flatten_json
from visitflow.operators.literals import parse_literals


def test_a_plain_cell_is_tested_and_swapped_once(spark):
    cell = "[{'a': True, \"b\": None, 'c': 'None, True', 'd': \"it's False\", 'e': [False, None]}, 'NoTrueF', []]"
    df = spark.createDataFrame([(cell,)], "c string")
    assert df.select(is_plain_literal(F.col("c"))).first()[0]
    parsed = parse_literals(df, {"c": "v"})
    assert parsed.select(variant_text(F.col("v"))).first()[0] == (
        '[{"a":true,"b":null,"c":"None, True","d":"it\'s False","e":[false,null]},"NoTrueF",[]]'
    )
    plan = parsed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("\\G") == 1


def test_numbers_of_many_digits_are_not_summed(spark):
    zeros = "0" * 300
    cells = {
        f"[0x{zeros}ff, 0o{zeros}17, 0b{zeros}101]": "[255,15,5]",
        "[0x0, 0o00, 0b0, 'a\\\\b', r'\\d', 'p' '\\n']": '[0,0,0,"a\\\\b","\\\\d","p\\n"]',
        f"[{hex(10**38 - 1)}, {oct(10**38 - 1)}, {bin(10**38 - 1)}]": f"[{10**38 - 1},{10**38 - 1},{10**38 - 1}]",
        f"[{hex(10**38)}]": None,
        f"[{oct(10**38)}]": None,
        f"[{bin(10**38)}]": None,
        f"[0x{'f' * 20_000}]": None,
    }
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    found = df.select("c", parse_literal(F.col("c")).alias("v")).select("c", variant_text(F.col("v")).alias("t")).collect()
    assert {r["c"]: r["t"] for r in found} == cells
    plan = df.select(parse_literal(F.col("c")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("decimal(11,0)") < 12


def test_types_are_looked_up_where_the_print_depends_on_them(spark):
    texts = ["1", "-1", "007", "true", "false", "[]", "{}", "[x", "", "x", "1.5", "True", "1e3", "x1", "truer", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(print_depends(F.col("t"))).collect()] == [True] * 8 + [False] * 7 + [None]
    cells = {
        '{"a":"1"}': "1", '{"a":1}': "1", '{"a":1.0}': "1.0", '{"a":"true"}': "true", '{"a":true}': "True", '{"a":"[]"}': "[]",
        '{"a":[]}': "", '{"a":["x"]}': "['x']", '{"a":"{}"}': "{}", '{"a":{"b":1}}': "", '{"a":{}}': "", '{"a":null}': "",
    }
    df = spark.createDataFrame([(c,) for c in cells], "p string")
    assert [r[0] for r in flatten_json(df, [Leaf("p", ("a",))]).collect()] == list(cells.values())
    whole = flatten_json(df, [Leaf("p", ("a",), whole=True)]).collect()
    assert [r[0] for r in whole if r[0].startswith("{")] == ["{}", '{"b":1}']


def test_plain_whole_numbers(spark):
    texts = {"12": 12, "-7": -7, "12\n": 12, " 12 ": 12, "9" * 18: 10**18 - 1, "9223372036854775807": 2**63 - 1, "9" * 19: None, "1.0": 1, "": None}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(text_to_long(F.col("t"))).collect()] == list(texts.values())
    plan = df.select(text_to_long(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "{1,18}" in plan
