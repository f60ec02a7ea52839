import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitflow.functions.dates import date_parts, unix_parts
from visitflow.functions.literals import (
    custom_dimension_value,
    literal_to_json,
    parse_json_object,
    parse_literal_list,
)
from visitflow.functions.numbers import (
    clip,
    float_or_zero,
    log1p_capped,
    log1p_floor,
    text_to_double,
    text_to_long,
    to_double,
)
from visitflow.functions.sentinels import is_none, is_other, is_reserved, is_unknown
from visitflow.functions.text import last_leaf, trim_ws


def texts(spark, values, **columns):
    """Evaluate column functions over one text column."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    rows = df.select("i", *[f(F.col("c")).alias(n) for n, f in columns.items()]).orderBy("i").collect()
    return [r[1] if len(columns) == 1 else tuple(r)[1:] for r in rows]


def test_text_to_long(spark):
    got = texts(spark, ["1.0", " 12 ", "1d", "abc", "", None, "1.5", "9007199254740993"], x=text_to_long)
    assert got == [1, 12, None, None, None, None, None, 9007199254740993]


def test_text_to_double(spark):
    values = ["1e3", "-.5", "1f", "0x10", " 7\t", "1_000", "inf", "NaN"]
    got = texts(spark, values, x=text_to_double)
    assert got[:6] == [1000.0, -0.5, None, None, 7.0, None]
    assert got[6] == math.inf and math.isnan(got[7])


def test_float_or_zero(spark):
    got = texts(spark, ["1,000", " 2000000 ", None, "abc", "1_000", "True"], x=float_or_zero)
    assert got == [0.0, 2000000.0, 0.0, 0.0, 1000.0, 0.0]


def test_trim_strips_all_white_space(spark):
    assert texts(spark, ["　a b\x1f\n", "\t", None], x=trim_ws) == ["a b", "", None]


def test_log_and_clip(spark):
    df = spark.createDataFrame(
        [(None,), (-3.0,), (0.0,), (math.e - 1,), (500.0,), (float("nan"),)], "x double"
    )
    rows = df.select(log1p_floor(F.col("x")), log1p_capped(F.col("x"), 181)).collect()
    assert [r[0] for r in rows] == pytest.approx([0, 0, 0, 1, math.log1p(500), 0])
    assert [r[1] for r in rows] == pytest.approx([0, 0, 0, 1, math.log1p(181), 0])
    df = spark.createDataFrame(
        [(float("nan"),), (math.inf,), (-math.inf,), (12.0,), (-12.0,), (None,), (3.0,)], "x double"
    )
    got = [r[0] for r in df.select(clip(F.col("x"), 10.0)).collect()]
    assert got == [0, 10, -10, 10, -10, 0, 3]


def test_date_parts(spark):
    got = texts(
        spark,
        ["20180131", "20180230", None, "20180203"],
        **{
            n: (lambda c, n=n: date_parts(to_double(c, T.StringType()))[n])
            for n in ("date_dow", "date_month", "date_is_weekend")
        },
    )
    assert got == [(2, 1, 0), (None, None, 0), (None, None, None), (5, 2, 1)]


def test_unix_parts(spark):
    df = spark.createDataFrame([(1525132800,), (None,), (-1,)], "s bigint")
    parts = unix_parts(F.col("s").cast("double"))
    rows = [tuple(r) for r in df.select(*[c.alias(n) for n, c in parts.items()]).collect()]
    assert rows == [(0, 1, 0), (None, None, 0), (23, 2, 0)]


def test_sentinels(spark):
    values = ["  ", "NONE", "(not provided)", "UNKNOWN", "(not set)", "(Other)", "A", None]
    got = texts(spark, values, none=is_none, unknown=is_unknown, other=is_other, reserved=is_reserved)
    assert [r[0] for r in got] == [True, True, True, False, False, False, False, True]
    assert [r[1] for r in got] == [False, False, False, True, True, False, False, False]
    assert [r[2] for r in got] == [False, False, False, False, False, True, False, False]
    assert [r[3] for r in got] == [True] * 6 + [False, True]


def test_last_leaf(spark):
    values = ["Home/Apparel/Mens/", "", "(not set)", None, "///", " Home/Bags "]
    got = texts(spark, values, x=last_leaf)
    assert got == ["Mens", "unknown", "unknown", "unknown", "unknown", "Bags"]


def test_json_object(spark):
    values = ['{"a":1}', "bad", "  ", None, "[1]", ' {"a":2} ', "{bad}"]
    got = texts(spark, values, x=lambda c: parse_json_object(c).isNotNull())
    assert got == [True, False, False, False, False, True, False]


LITERALS = [
    (r"""[{'a': 'it\'s'}]""", '[{"a":"it\'s"}]'),
    ("""[{'a': "Men's"}]""", '[{"a":"Men\'s"}]'),
    ("[{'a': True, 'b': None, 'c': False}]", '[{"a":true,"b":null,"c":false}]'),
    ("[{'a': 'None, True'}]", '[{"a":"None, True"}]'),
    ("[{'a': 'None, True', 'b': None}]", '[{"a":"None, True","b":null}]'),
    (r"[{'a': 'x\xa0y'}]", '[{"a":"x\u00a0y"}]'),
    (r"[{'a': 'x\\xa0'}]", r'[{"a":"x\\xa0"}]'),
    ("[{'a': 1},]", '[{"a":1}]'),
    ("[{'a': [1, 2,], 'b': ',]'},]", '[{"a":[1,2],"b":",]"}]'),
    ("[]", "[]"),
    (" [1.5, -2e3]", "[1.5,-2000.0]"),
    ("""[{"a": 'say "hi"'}]""", r'[{"a":"say \"hi\""}]'),
    ("[{'a': 1}] junk", "[]"),
    ("{'a': 1}", "[]"),
    ("[true, null]", "[]"),
    ("[nan]", "[]"),
    ("[1] [2]", "[]"),
    ("[{'a': 1}", "[]"),
    ("['a' 'b'", "[]"),
    ("", "[]"),
    (None, "[]"),
    ("  ", "[]"),
]


def test_literal_lists(spark):
    got = texts(spark, [c for c, _ in LITERALS], x=lambda c: F.to_json(parse_literal_list(c)))
    assert got == [expected for _, expected in LITERALS]


def test_large_cell(spark):
    cell = "[" + ", ".join(["{'isEntrance': True, 'title': 'it\\'s None', 'item': None}"] * 20_000) + "]"
    got = texts(spark, [cell], x=lambda c: F.size(parse_literal_list(c)))
    assert got == [20_000]
    assert texts(spark, ["['" + "x" * 1_000_000 + "', None]"], x=lambda c: F.length(literal_to_json(c))) == [
        1_000_010
    ]


def test_custom_dimensions(spark):
    values = [
        "[{'index': '4', 'value': 'North America'}]",
        "[]",
        "",
        None,
        "[{'value': ' a '}, {'index': '1'}, {'value': 'b'}, 3]",
        "{'value': 'a'}",
        "[{'value': 'a'",
        "[{'value': None}, {'value': True}, {'value': 4}, {'value': 1.0}]",
        "[{'value': [1, 'x', None]}]",
    ]
    got = texts(spark, values, x=custom_dimension_value)
    assert got == ["North America", "", "", "", "a, b", "", "", "None, True, 4, 1.0", "[1, 'x', None]"]
