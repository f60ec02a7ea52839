"""Literal cells against Python's own parser, JSON cells against its JSON parser."""

import ast
import json
import random

import pytest
from pyspark.sql import functions as F

from visitflow.functions.literals import is_plain_literal, parse_json_object, plain_outline
from visitflow.operators.flatten import Leaf, flatten_json
from visitflow.operators.literals import parse_literals, unparsed_cells


def read(spark, cells):
    """JSON of each cell as the operator reads it; None for a cell that is no list."""
    df = spark.createDataFrame(list(enumerate(cells)), "i int, c string")
    parsed = parse_literals(df, {"c": "v"}).select("i", F.to_json("v").alias("j"))
    return [None if r["j"] is None else json.loads(r["j"]) for r in parsed.orderBy("i").collect()]


def expected(cell):
    """What Python reads, with numbers as keys and tuples as their text; None for a set or another key."""

    def plain(v):
        if isinstance(v, dict):
            if not all(isinstance(k, (str, int, float)) and not isinstance(k, bool) for k in v):
                raise TypeError
            return {str(k): plain(x) for k, x in v.items()}
        if isinstance(v, (set, bytes, complex)):
            raise TypeError
        if isinstance(v, list):
            return [plain(x) for x in v]
        if isinstance(v, int) and abs(v) >= 10**38:
            raise TypeError  # more digits than DECIMAL holds
        if isinstance(v, str):
            v.encode()  # half of a surrogate pair is no text
        return str(v) if isinstance(v, tuple) else v

    try:
        value = ast.literal_eval(cell)
        return plain(value) if isinstance(value, list) else None
    except (ValueError, SyntaxError, TypeError):
        return None


FORMS = [
    r"['\a\b\f\n\r\t\v\\\'\"']", r"['\101\7\0\x41é\U0001F600']", r"['\q \8 \z']", "['a\\\nb']",
    r"[r'\d\n', R'x', u'y', U'z']", "['a' 'b' \"c\"]", "['a', 'b' 'c', '']", "['' '', '']", "[('t', 1), ('u',)]", "[1_000, 0x1F, 0o17, 0b101]",
    "[1., .5, 1e5, 1E-3, +4, -7, 00]", "[{1: 'a', 2.5: 'b'}]", "[{'k': 1, 'k': 2}]", "[[1, 2,], {'a': 1,},]", "['tab\there']",
    "[\n  {'a': True,\n   'b': None}\n]", "['x: True, y', \"it's None\", True]", "[True,False]", "[ ]", "[[], {}]",
    "['é日🙂', ' ']", "[',]', '}', '[', 1]", "[-1, - 2]", "['a\"b', \"c'd\"]",
    "[0xffffffffffffffffffff, 0XDEAD_BEEF, 0x0, -0x1F]", f"[0b{'1' * 66}, 0b0, 0o{'7' * 30}, 0x{'0' * 80}1]", r"['\U0010FFFF\U0000d7ff\ue000\777']",
    f"[{'9' * 38}, -{'9' * 38}, 1{'0' * 37}]",
]

REJECTED = [
    "", " ", "[1 2]", "[01]", "[1__0]", "[,]", "[1,,2]", "{,}", "[1] [2]", "[1]], [[2]", "[1", "1]", "[']", "['a\nb']", "[true]", "[nan]",
    "({'a': 1},)", "{'a': 1}", "3", "[a]", "['a' 1]", "[None None]", "['x' : 1]", "[{'a' 1}]", "[\\n]", "[{'a', 1}]", "[1]}, {'x':[2]",
    r"['\U00110000']", r"['\UFFFFFFFF']", r"['\ud800']", r"['\uDFFF']", r"['\U0000dABc']", f"[{'9' * 42}]", f"[1{'0' * 38}]", f"[0x{'f' * 40}]",
    f"[0b{'1' * 200}]", f"[0o{'7' * 3000}]", "[0x]", "[0b2]", r"['\U0011000']",
]


def test_every_form(spark):
    got = read(spark, FORMS)
    assert got == [expected(c) for c in FORMS]
    assert None not in got


def test_rejected_cells(spark):
    assert [expected(c) for c in REJECTED] == [None] * len(REJECTED)
    assert read(spark, REJECTED) == [None] * len(REJECTED)


def some_value(draw, depth=0):
    kinds = ["text", "text", "number", "word"] + ["list", "dict"] * (depth < 3)
    kind = draw.choice(kinds)
    if kind == "text":
        return "".join(draw.choices("ab'\"\\ \n\t,:[]{}é日🙂\x07TrueNone", k=draw.randrange(8)))
    if kind == "number":
        return draw.choice([0, -3, 12, 1.5, -2e-3, 10**12, 10**37 + 1, draw.choice([10**38, -(10**41)])])
    if kind == "word":
        return draw.choice([True, False, None])
    if kind == "list":
        return [some_value(draw, depth + 1) for _ in range(draw.randrange(4))]
    return {some_key(draw): some_value(draw, depth + 1) for _ in range(draw.randrange(4))}


def some_key(draw):
    return draw.choice(["a", "b c", "it's", "x\\y", 7])


def some_token(draw):
    """A number in another base, or a text of escapes, in and out of range."""
    if draw.random() < 0.5:
        base, digits = draw.choice([("0x", "0123456789abcdefABCDEF_"), ("0o", "01234567_"), ("0b", "01_")])
        return draw.choice(["", "-"]) + base + "".join(draw.choices(digits, k=draw.choice([0, 1, 5, 17, 20, 33, 66, 130])))
    escapes = [f"\\U{draw.choice([0x41, 0x10FFFF, 0x110000, 0xD800, 0xFFFFFFFF]):08x}", f"\\u{draw.choice([0x41, 0xD83D, 0xDE00, 0xE000]):04x}", "\\x4", "\\x41"]
    return "'" + "".join(draw.choices([*escapes, "a"], k=draw.randrange(4))) + "'"


def test_random_tokens_never_fail(spark):
    draw = random.Random(12)
    cells = ["[" + ", ".join(some_token(draw) for _ in range(draw.randrange(1, 4))) + "]" for _ in range(500)]
    wanted = [expected(c) for c in cells]
    assert read(spark, cells) == wanted
    assert 100 < wanted.count(None) < 400


def test_random_literals_and_damaged_ones(spark):
    draw = random.Random(11)
    cells = [repr([some_value(draw) for _ in range(draw.randrange(4))]) for _ in range(400)]
    for cell in cells[:300]:
        at = draw.randrange(len(cell))
        cells.append(cell[:at] + draw.choice(["", "'", ",", "]", "[", "}", "1", " ", ":", "True"]) + cell[at + draw.randrange(2) :])
    assert read(spark, cells) == [expected(c) for c in cells]


def test_plain_cells_take_the_short_way(spark):
    cells = ["[{'a': '1', 'b': True, 'c': None, 'd': \"Men's True Tee\", 'e': [1, 2.5]}]", "[]", r"['\n']"]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    plain = [r[0] for r in df.select(is_plain_literal(plain_outline(F.col("c")))).collect()]
    assert plain == [True, True, False]
    deep = "[" * 9 + "{'a': None}" + "]" * 9
    assert read(spark, [deep]) == [expected(deep)]


OBJECTS = [
    '{"a":1}', '{"a":1,"a":2}', '{"a":1} junk', '{"a":1}{"b":2}', '{"a":1},{"b":2}', '{"a":1}], [{"b":2}', '{"a":1}}, {"b":{"c":2}',
    '{"a":"]"}', '{"a":["}"]}', "{}", " {} ", "[1]", "1", "{", "", None, '{"a":1},"b":{"c":2}',
]


@pytest.mark.parametrize("cell", OBJECTS)
def test_objects_are_whole(spark, cell):
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    try:
        value = json.loads(cell or "")
    except ValueError:
        value = None
    df = spark.createDataFrame([(cell,)], "c string")
    got = df.select(F.to_json(parse_json_object(F.col("c")))).first()[0]
    assert (None if got is None else json.loads(got)) == (value if isinstance(value, dict) else None)


def test_leaf_of_any_later_type(spark):
    cells = ['{"a":{"k":"v"}}', '{"a":[]}', '{"a":1.0}', '{"a":["b",null]}', '{"a":false}', '{"a":"1.0"}', '{"a":null}', "{}"]
    df = spark.createDataFrame([(c,) for c in cells], "p string")
    rows = flatten_json(df, [Leaf("p", ("a",))]).collect()
    assert [r[0] for r in rows] == ["", "", "1.0", "['b', None]", "False", "1.0", "", ""]


def test_lost_cells_are_counted(spark):
    rows = [("{}", "[]"), ("{", "[1"), ("[1]", "(1,)"), (None, " "), ("{} x", "[1]")]
    df = spark.createDataFrame(rows, "j string, l string")
    got = {(r["column"], r["reason"]): r["cells"] for r in unparsed_cells(df, ["j"], ["l"]).collect()}
    assert got == {("j", "malformed"): 2, ("j", "no_object"): 1, ("l", "malformed"): 1, ("l", "no_list"): 1}
