r"""Cells that hold JSON objects or Python literals, read as VARIANT.

A list literal as Python prints it (no escapes, no control characters, keywords as values of keys) is JSON but for a few
words, and the JSON parser itself tells whether it is (:func:`quick_json`). A cell that it refuses becomes JSON text by
a few replacements if one pattern finds it plain. Any other cell is cut into tokens, each token becomes its JSON, and the
tokens are put together again; that costs more and is done for such cells only. Objects with equal keys keep the last
value, which needs the session setting of :func:`allow_equal_keys`.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from visitflow.functions.binding import let
from visitflow.functions.text import trim_ws

QUOTED = r"""'[^']*+'|"[^"]*+\""""
# A quoted text of a plain cell; with an escape or a control character it is none.
PLAIN_QUOTED = r"""'[^'\\\x00-\x1f]*+'|"[^"\\\x00-\x1f]*+\""""
NESTING = 6
# Digits that DECIMAL holds; a whole number of more is not read, since VARIANT would round it.
MOST_DIGITS = 38


def _plain_value(depth: int, text: str = f"q|{PLAIN_QUOTED}") -> str:
    """Pattern of a value whose numbers JSON writes the same way; a quoted text may also be written q, as in an outline."""
    whole = rf"0|[1-9][0-9]{{0,{MOST_DIGITS - 1}}}+(?![0-9])"
    scalar = rf"{text}|-?(?:{whole})(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?(?![\w.])|(?:True|False|None)(?!\w)"
    if not depth:
        return rf"(?:{scalar})"
    inner = _plain_value(depth - 1, text)
    listed = rf"\[ *+(?:{inner} *+(?:, *+(?=[^\],])|(?=\])))*+\]"
    keyed = rf"""\{{ *+(?:(?:{text}) *+: *+{inner} *+(?:, *+(?=[q'"])|(?=\}})))*+\}}"""
    return rf"(?:{scalar}|{listed}|{keyed})"


# A whole list literal; one that is nested deeper is read token by token.
PLAIN_LIST = rf"^ *+(?=\[){_plain_value(NESTING)} *+$"
KEYWORDS = {"True": "true", "False": "false", "None": "null"}
# A keyword of a plain cell and all from the last one to it: quoted texts are taken whole, and outside them no other word begins so.
KEYWORD_MARK = "\x01"  # no plain cell holds it
NEXT_KEYWORD = rf"""\G((?:[^'"TFN]++|'[^']*+'|"[^"]*+")*+)({"|".join(KEYWORDS)})"""

# A comment with both quotes behind each keyword that is swapped unseen: JSON passes over it, but inside a quoted text it ends
# the text, and no JSON can follow.
QUOTE_GUARD = "/*\"'*/"
END_MARK = "\x01"  # no cell without escapes holds it as a JSON text
LISTED = "$[0]"  # where the cell is in what :func:`listed_literal` gives
# Comments are the guards only, and no number is a word.
QUICK_OPTIONS = {"allowComments": "true", "allowNonNumericNumbers": "false"}

# Tokens of a literal. A tuple without brackets inside is one token.
TEXT = r"""(?:'(?:[^'\\\n]++|\\.)*+'|"(?:[^"\\\n]++|\\.)*+")"""
NUMBER = r"(?:0[xX][0-9a-fA-F_]++|0[oO][0-7_]++|0[bB][01_]++|(?:[0-9][0-9_]*+\.?[0-9_]*+|\.[0-9][0-9_]*+)(?:[eE][+-]?[0-9]++)?)"
TUPLE = rf"\((?:[^()\[\]{{}}'\"]++|{TEXT})*+\)"
TOKEN = rf"(?s)[rRuU]?{TEXT}|{TUPLE}|{NUMBER}(?![\w.])|(?:True|False|None)(?!\w)|[\[\]{{}},:+-]|[ \t\f\r\n]++|."
# Parts of a text token: an escape, or what lies between escapes.
TEXT_PART = r"(?s)\\(?:\r?\n|[0-7]{1,3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|.)|[^\\]++"
SIMPLE_ESCAPES = {"a": "\x07", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v"}
# Marks around JSON texts and numbers, for a comma and for what is no token; JSON escapes them inside texts.
OPEN_TEXT, CLOSE_TEXT, COMMA, OPEN_NUMBER, CLOSE_NUMBER, NO_TOKEN = "\x01\x02\x03\x04\x05\x06"


def allow_equal_keys(spark: SparkSession) -> None:
    """Let VARIANT keep the last of equal keys, as JSON and literals do in Python."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def empty_list() -> Column:
    return F.array().cast("array<variant>")


def is_blank(c: Column) -> Column:
    return c.isNull() | (trim_ws(c) == "")


def literal_outline(c: Column) -> Column:
    """The cell with a ``q`` for each quoted text."""
    return F.regexp_replace(c, f"(?s){QUOTED}", "q")


def plain_outline(c: Column) -> Column:
    """The cell with a ``q`` for each quoted text without escapes; another leaves a quote, which no plain cell has."""
    return F.regexp_replace(c, PLAIN_QUOTED, "q")


def is_plain_literal(c: Column) -> Column:
    """Whether a cell, given itself or its plain outline, is JSON but for its keywords and its kind of quotes."""
    return c.rlike(PLAIN_LIST)


def swap_keywords(c: Column) -> Column:
    """Write the keywords outside quotes of a plain cell as their JSON words.

    One pass marks them all; a mark and its word are then plain texts to replace.
    """
    swapped = F.regexp_replace(c, NEXT_KEYWORD, f"$1{KEYWORD_MARK}$2")
    for word, json_word in KEYWORDS.items():
        swapped = F.replace(swapped, F.lit(KEYWORD_MARK + word), F.lit(json_word))
    return F.when(reduce(or_, [F.contains(c, F.lit(word)) for word in KEYWORDS]), swapped).otherwise(c)


# Escapes that stand for no character: cut ones, code points past the last, and halves of a surrogate pair. A named
# character would need the table of names.
NO_CHARACTER = r"^\\(?:[xuUN]$|U(?!000[0-9a-fA-F]|0010)|(?:u|U0000)[dD][89a-fA-F])"


def _code_point(hexadecimal: Column) -> Column:
    return F.decode(F.unhex(F.lpad(hexadecimal, 8, "0")), "UTF-32")


def _unescaped(part: Column) -> Column:
    """What one part of a text token stands for; an unknown escape stands for itself."""
    code = F.substring(part, 2, 1)
    simple = F.create_map(*[F.lit(x) for pair in SIMPLE_ESCAPES.items() for x in pair])
    return (
        F.when(~part.startswith("\\") | part.rlike(NO_CHARACTER), part)
        .when(code.rlike("[0-7]"), _code_point(F.conv(F.substring(part, 2, 3), 8, 16)))
        .when(code.isin("x", "u", "U") & (F.length(part) > 2), _code_point(F.substring(part, 3, 8)))
        .when(code.isin("\r", "\n"), F.lit(""))
        .when(code.isin("\\", "'", '"'), code)
        .otherwise(F.coalesce(F.try_element_at(simple, code), part))
    )


def _json_text(value: Column) -> Column:
    """The value as a JSON text, quotes included."""
    return F.trim(F.to_json(F.array(value)), F.lit("[]"))


def _text_json(token: Column) -> Column:
    raw = token.rlike("^[rR]")

    def marked(value: Column) -> Column:
        return F.concat(F.lit(OPEN_TEXT), _json_text(value), F.lit(CLOSE_TEXT))

    def by_parts(parts: Column) -> Column:
        unreadable = F.exists(parts, lambda part: part.rlike(NO_CHARACTER))
        return F.when(unreadable, F.lit(NO_TOKEN)).otherwise(marked(F.array_join(F.transform(parts, _unescaped), "")))

    def by_body(body: Column) -> Column:
        escaped = ~raw & F.contains(body, F.lit("\\"))
        return F.when(escaped, let(F.regexp_extract_all(body, F.lit(TEXT_PART), F.lit(0)), by_parts)).otherwise(marked(body))

    return let(F.regexp_extract(token, r"(?s)^[rRuU]?.(.*).$", 1), by_body)


def _whole_number(digits: Column, base: int, width: int) -> Column:
    """Decimal digits of a whole number in another base; null past :data:`MOST_DIGITS`.

    Summed up ``width`` digits at a time, each of which fits 32 bits, with additions that give null where they overflow;
    a number of more digits than any that fits, zeros in front not counted, is not summed at all.
    """
    decimal = f"decimal({MOST_DIGITS},0)"
    most = math.ceil(MOST_DIGITS / math.log10(base))
    digits = F.ltrim(digits, F.lit("0"))
    length = (F.ceil(F.length(digits) / width) * width).cast("int")
    pieces = F.regexp_extract_all(F.lpad(digits, length, F.lit("0")), F.lit(f".{{{width}}}"), F.lit(0))
    scale = F.lit(base**width).cast("decimal(11,0)")

    def step(total: Column, piece: Column) -> Column:
        return F.try_add(F.try_multiply(total, scale), F.conv(piece, base, 10).cast("decimal(11,0)")).cast(decimal)

    summed = F.aggregate(pieces, F.lit(0).cast(decimal), step).cast("string")
    return F.when(F.length(digits) <= most, summed)


def _number_json(token: Column) -> Column:
    digits = F.replace(token, F.lit("_"), F.lit(""))
    base, rest = F.substring(digits, 2, 1), F.substring(digits, 3, 2**31 - 1)
    plain = F.regexp_replace(F.regexp_replace(digits, r"^\.", "0."), r"\.(?![0-9])", ".0")
    number = (
        F.when(base.isin("x", "X"), _whole_number(rest, 16, 8))
        .when(base.isin("o", "O"), _whole_number(rest, 8, 10))
        .when(base.isin("b", "B"), _whole_number(rest, 2, 32))
        .otherwise(F.regexp_replace(plain, "^0+(?=[0-9])", ""))
    )
    wrong = token.rlike(r"^0[0-9_]*[1-9][0-9_]*$|__|_$|^(?!0[xX]).*(?:_[.eE]|[.]_)")

    def marked(found: Column) -> Column:
        large = found.rlike(f"^[0-9]{{{MOST_DIGITS + 1},}}$")
        return F.when(large | found.isNull(), F.lit(NO_TOKEN)).otherwise(F.concat(F.lit(OPEN_NUMBER), found, F.lit(CLOSE_NUMBER)))

    return F.when(wrong, F.lit(NO_TOKEN)).otherwise(let(number, marked))


def _token_json(token: Column) -> Column:
    words = F.create_map(*[F.lit(x) for k, v in KEYWORDS.items() for x in (k, OPEN_NUMBER + v + CLOSE_NUMBER)])
    is_tuple = token.rlike(r"^\(") & literal_outline(token).contains(",")
    return (
        F.when(token.isin(*"[]{}:-"), token)
        .when(token == ",", F.lit(COMMA))
        .when(token.rlike(r"^[ \t\f\r\n+]"), F.lit(""))
        .when(token.rlike(r"(?s)^[rRuU]?['\"]."), _text_json(token))
        .when(token.rlike(r"^\.?[0-9]"), _number_json(token))
        .when(is_tuple, _json_text(token))
        .otherwise(F.coalesce(F.try_element_at(words, token), F.lit(NO_TOKEN)))
    )


def _closes_once(tokens: Column) -> Column:
    """Whether the first bracket is closed by the last token and not before."""
    step = F.aggregate(
        tokens,
        F.struct(F.lit(0).alias("depth"), F.lit(0).alias("closed")),
        lambda acc, t: F.struct(
            (acc["depth"] + F.when(t.isin("[", "{"), 1).when(t.isin("]", "}"), -1).otherwise(0)).alias("depth"),
            # Tokens seen after a depth of 0 was reached by closing.
            (
                acc["closed"]
                + F.when((acc["depth"] == 1) & t.isin("]", "}"), 1)
                .when((acc["closed"] > 0) & ~t.rlike(r"^[ \t\f\r\n]"), 1)
                .otherwise(0)
            ).alias("closed"),
        ),
    )
    return let(step, lambda end: (end["depth"] == 0) & (end["closed"] == 1))


def tokens_json(c: Column) -> Column:
    """JSON text of a list literal, token by token; null when it is none.

    Read are escapes, raw texts, texts side by side, all number forms, keys that are numbers, trailing
    commas, and tuples of scalars, which become their text as it is written. Not read are named
    characters, halves of surrogate pairs, whole numbers of more than 38 digits, sets, bytes, complex numbers,
    other keys, and tuples with brackets inside.
    """
    tokens = F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))

    def joined(found: Column) -> Column:
        text = F.array_join(F.transform(found, _token_json), "")
        return F.when(_closes_once(found), F.replace(text, F.lit(f'"{CLOSE_TEXT}{OPEN_TEXT}"'), F.lit("")))

    def cleaned(text: Column) -> Column:
        wrong = reduce(
            or_, [F.contains(text, F.lit(w)) for w in (f"[{COMMA}", f"{{{COMMA}", COMMA * 2, CLOSE_NUMBER + OPEN_NUMBER, NO_TOKEN)]
        )
        keyed = F.regexp_replace(text, f'{OPEN_NUMBER}([0-9][^{CLOSE_NUMBER}]*+){CLOSE_NUMBER}:', '"$1":')
        ended = F.replace(F.replace(keyed, F.lit(f"{COMMA}]"), F.lit("]")), F.lit(f"{COMMA}}}"), F.lit("}"))
        return F.when(~wrong, F.translate(ended, COMMA + OPEN_TEXT + CLOSE_TEXT + OPEN_NUMBER + CLOSE_NUMBER, ","))

    return F.when(c.rlike(r"^[ \t]*\["), let(let(tokens, joined), cleaned))


def literal_to_json(c: Column) -> Column:
    """JSON text of a Python list literal; null when the cell is no such list."""
    return F.when(is_plain_literal(c), swap_keywords(c)).when(~is_blank(c), tokens_json(c))


def quick_json(c: Column) -> Column:
    """JSON of a list of the cell and a mark, if the cell is a literal as Python prints it; else no JSON, or null.

    No pattern looks at the form of the cell: texts are replaced wherever they stand, in such a way that the result is JSON of the same
    values, or none. Slashes, where the cell could hold a comment, and the words of JSON are written with escapes, which are
    read inside quotes and refused outside. A keyword gets a :data:`QUOTE_GUARD`, refused inside quotes.
    The mark is found behind the list only if nothing else is.
    """
    # A text that is not there is found missing sooner by contains than by replace.
    commented = F.contains(c, F.lit("//")) | F.contains(c, F.lit("/*"))
    plain = F.when(commented, F.replace(c, F.lit("/"), F.lit("\\/"))).otherwise(c)
    escaped = plain
    for word in KEYWORDS.values():
        escaped = F.replace(escaped, F.lit(word), F.lit(f"{word[:-1]}\\u{ord(word[-1]):04x}"))
    text = F.when(reduce(or_, [F.contains(c, F.lit(word)) for word in KEYWORDS.values()]), escaped).otherwise(plain)
    for word, json_word in KEYWORDS.items():
        text = F.replace(text, F.lit(f": {word}"), F.lit(f": {json_word}{QUOTE_GUARD}"))
    listed = F.ltrim(c).startswith("[") & ~F.contains(c, F.lit("\\")) & ~c.rlike(f"[0-9]{{{MOST_DIGITS + 1}}}")
    return F.when(listed, F.concat(F.lit("["), text, F.lit(f',"\\u{ord(END_MARK):04x}"]')))


def is_read(listed: Column) -> Column:
    """Whether the parser read the whole cell from :func:`quick_json`, so without escapes and texts side by side; never null."""
    return F.coalesce(F.try_variant_get(listed, "$[1]", "string") == END_MARK, F.lit(False))


def listed_literal(c: Column) -> Column:
    """VARIANT list whose first entry is the parsed cell; null for no list literal.

    One parser is given the text of :func:`quick_json` and, only if that is not read, the text of :func:`literal_to_json`.
    """

    def parsed(before: Column, attempt: Column) -> Column:
        text = F.when(attempt == 1, quick_json(c)).otherwise(F.concat(F.lit("["), literal_to_json(c), F.lit("]")))
        return F.when(is_read(before), before).otherwise(F.from_json(text, "variant", QUICK_OPTIONS))

    return F.aggregate(F.array(F.lit(1), F.lit(2)), F.lit(None).cast("variant"), parsed)


def parse_literal(c: Column) -> Column:
    """VARIANT of a Python list literal; null for anything else."""
    return F.try_variant_get(listed_literal(c), LISTED, "variant")


def list_or_empty(v: Column, at: str = "$") -> Column:
    return F.coalesce(F.try_variant_get(v, at, "array<variant>"), empty_list())


def parse_literal_list(c: Column) -> Column:
    """``array<variant>`` of a Python list literal; anything else gives an empty array."""
    return list_or_empty(parse_literal(c))


def parse_json_object(c: Column) -> Column:
    """VARIANT of a JSON object; null for blank, malformed or other JSON.

    Spark's parser ignores what follows a value. Inside a list of one entry, and
    inside an object where a bracket could close that list, nothing can follow.
    """
    one = F.try_variant_get(
        F.try_parse_json(F.concat(F.lit("["), c, F.lit("]"))), "$", "array<variant>"
    )
    whole = ~F.contains(c, F.lit("]")) | F.try_parse_json(
        F.concat(F.lit('{"v":'), c, F.lit("}"))
    ).isNotNull()
    shaped = c.rlike(r"^[ \t\n\r]*\{") & c.rlike(r"\}[ \t\n\r]*$")
    return F.when(shaped & whole, let(one, lambda x: F.when(F.size(x) == 1, F.get(x, F.lit(0)))))


def variant_type(v: Column) -> Column:
    return F.schema_of_variant(v)


def variant_text(v: Column) -> Column:
    """Text of a scalar, or compact JSON of a list or an object."""
    return F.try_variant_get(v, "$", "string")


def python_text(v: Column) -> Column:
    """What Python's ``str`` prints for a parsed value.

    JSON ``1.0`` is kept by VARIANT as a decimal without places, hence ``.0``;
    whole numbers are BIGINT, or decimals of 19 and more digits.
    """
    return let(variant_type(v), lambda kind: text_of_type(v, kind))


def text_of_type(v: Column, kind: Column, text: Column | None = None) -> Column:
    """What Python's ``str`` prints for a value of this type, whose text is ``text``."""
    return F.when(kind.startswith("ARRAY"), _list_text(v)).otherwise(
        _scalar_text(kind, variant_text(v) if text is None else text, lambda text: text)
    )


def print_depends(text: Column) -> Column:
    """Whether values of different types have this text but not one print: whole numbers, booleans, lists and objects."""
    return text.rlike(r"^(?:-?[0-9]+$|true$|false$|[\[{])")


def _scalar_text(kind: Column, text: Column, quote: Callable[[Column], Column]) -> Column:
    return (
        F.when(kind == "STRING", quote(text))
        .when(kind == "VOID", F.lit("None"))
        .when(kind == "BOOLEAN", F.initcap(text))
        .when(kind.rlike(r"^DECIMAL\((\d|1[0-8]),0\)$"), F.concat(text, F.lit(".0")))
        .otherwise(text)
    )


def _list_text(v: Column) -> Column:
    """Python's print of a list of scalars; nested parts stay JSON text."""

    def quote(text: Column) -> Column:
        escaped = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
        double = F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"'))
        single = F.replace(escaped, F.lit("'"), F.lit("\\'"))
        return F.when(double, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(
            F.concat(F.lit("'"), single, F.lit("'"))
        )

    def item(x: Column) -> Column:
        return let(variant_type(x), lambda kind: _scalar_text(kind, variant_text(x), quote))

    items = F.try_variant_get(v, "$", "array<variant>")
    return F.concat(F.lit("["), F.array_join(F.transform(items, item), ", "), F.lit("]"))


def is_truthy(text: Column, v: Column) -> Column:
    """Python truth of a parsed value: the text ``0`` is true, the number 0 is not.

    ``text`` is the text of ``v``; the type is looked up only where it decides.
    """
    doubtful = text.isin("", "0", "0.0", "-0.0", "false", "[]", "{}")
    return F.coalesce(
        F.when(doubtful, (variant_type(v) == "STRING") & (text != "")).otherwise(text.isNotNull()),
        F.lit(False),
    )


def custom_dimension_value(c: Column, separator: str = ", ") -> Column:
    """The ``value`` entries of a list of dimension dicts, joined."""
    return dimension_values(parse_literal_list(c), separator)


def dimension_values(dimensions: Column, separator: str = ", ") -> Column:
    """The ``value`` entries of parsed dimension dicts, joined."""
    values = F.transform(dimensions, lambda d: F.try_variant_get(d, "$.value", "variant"))
    present = F.filter(values, lambda v: v.isNotNull())
    return F.array_join(F.transform(present, lambda v: trim_ws(python_text(v))), separator)
