"""Literals as Python prints them are read by the JSON parser alone, with the same values as by patterns; others are refused."""

import pytest
from pyspark.sql import functions as F

from visitflow.functions.literals import is_read, listed_literal, literal_to_json, parse_literal, variant_text
from visitflow.operators.flatten import add_hit_metrics

READ = [
    "[{'a': True, 'b': None, \"c\": \"it's / None\", 'd': [1, 2.50, -3e5, {}], 'u': 'http://x.y//z /* c */'}]",
    "[{'a': False, 'p': \"Men's True Tee\", 'w': 'null true false'}]",
    " [1, [], ['']] ",
    f"[{'9' * 38}]",
]
REFUSED = [
    "[{'a': 'x: True, y'}]", "[{'a': \"it's: None'\"}]", "[True]", "['a\\x41']", "['a' 'b']", "[u'a']", "[1_0]", "[(1, 'a')]",
    "[true]", "[{'a': null}]", "[1] junk", "[1],[2]", "[1]],[[2]", "[1], \"\x01\"]", "[1 // c\n]", "[1 /* c */]", "[NaN]",
    "[Infinity]", f"[{'9' * 39}]", "[{'k': Nonesuch}]", "[{'k': None 'x'}]", "[{'k': None/2}]", "[{'k': None//2}]", "[{None: 1}]",
    "[{x: 1}]", "[{'a': None}", "[1,]", "[.5]", "[007]", "{'a': 1}", "\n[1]", "", " ", None,
]


def test_the_parser_reads_what_python_prints_and_nothing_else(spark):
    df = spark.createDataFrame([(c,) for c in [*READ, *REFUSED]], "c string")
    by_patterns = F.from_json(literal_to_json(F.col("c")), "variant")
    found = df.select(
        "c",
        is_read(listed_literal(F.col("c"))).alias("read"),
        variant_text(parse_literal(F.col("c"))).alias("now"),
        variant_text(by_patterns).alias("patterns"),
    ).collect()
    assert [r["c"] for r in found if r["read"]] == READ
    assert all(r["now"] is not None for r in found[: len(READ)])
    assert [r["now"] for r in found] == [r["patterns"] for r in found]


def _hit(body: str, action: str = "'6'") -> str:
    return f"{{'eCommerceAction': {{'action_type': {action}}}, {body}}}"


@pytest.mark.parametrize(
    ("hits", "micros"),
    [
        (_hit("'transaction': {'transactionRevenue': '5'}, 'product': [{'productRevenue': '2'}, {'productRevenue': 3.0}]"), 10),
        (_hit("'transactionRevenue': 4") + ", " + _hit("'transactionRevenue': '100'", "'2'"), 4),
        (_hit("'transactionRevenue': 4", "6"), 0),
        (_hit("'deep': [{'er': {'productRevenue': '7'}}], 'transactionRevenue': '1'"), 8),
        (_hit("'transactionRevenue': '1', 'transactionRevenue': '2'"), 2),
        (_hit("'transactionRevenue': True"), 1),
        (_hit("'transactionRevenue': 'true', 'totalTransactionRevenue': None"), 0),
        (_hit("'transaction': {'transaction' 'Revenue': '9'}"), 9),
        (_hit("'deep': {'transaction' 'Revenue': '9'}"), 9),
        (_hit("'deep': {'transaction\\x52evenue': '9'}"), 9),
        (_hit("'product': {'productRevenue': '6'}, 'name': 'productRevenue'"), 6),
        (_hit("'transactionRevenue': ['5'], 'totalTransactionRevenue': {'a': '5'}"), 0),
    ],
)
def test_revenue_is_found_in_the_usual_places_and_in_any_other(spark, hits, micros):
    df = spark.createDataFrame([(f"[{hits}]",)], "hits string")
    assert add_hit_metrics(df).first()["total_revenue"] == pytest.approx(micros / 1e6)
