"""JSON of any depth as text in one fixed form, in which patterns find lists, members and fields without a row or a value for each node.

canonical() orders names and takes out blanks. own_first() makes every list an object whose names count through the text, puts : before
every other name, and then { (or [, if it is empty) before the name of a list or object. These marks sort after digits and :, so that
ordering names again has a node's own values before all within it. Every value then stands after ":, and as quotes within texts are
escaped, no pattern with a quote and a mark meets the inside of a text.
Loops are possessive: they take neither stack nor second tries, however long a text is.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from advisorium.operators.json_nodes import DEEPEST

#: A character of a text, as written; any characters; a text; and what is none and holds no other.
CHAR = r'[^"\\]|\\u.{4}|\\[^u]'
CHARS = r'[^"\\]*+(?:\\.[^"\\]*+)*+'
_STRING = f'"{CHARS}"'
_PLAIN = r'[^"\[\]{},:]++'


def _inside(levels: int) -> str:
    """What a list or object may hold, with so many levels of others."""
    plain = r'[^"\[\]{}]*+'
    found = f"{plain}(?:{_STRING}{plain})*+"
    for _ in range(levels):
        found = rf"{plain}(?:(?:{_STRING}|[\[{{]{found}[\]}}]){plain})*+"
    return found


_INSIDE = _inside(DEEPEST - 1)
_ANY = rf"{_STRING}|[\[{{]{_INSIDE}[\]}}]|{_PLAIN}"
#: In texts of canonical(): what each list holds, those within others too; and each of its members.
LISTS = rf'\G[^"\[]*+(?:{_STRING}[^"\[]*+)*+\[(?=({_INSIDE})\])'
MEMBERS = rf"({_ANY}),?+"
#: In texts of own_first(): a node's own value with its name; what a list holds; its members, each after its number.
OWN = rf'"[:\d]{CHARS}":(?:{_STRING}|{_PLAIN})'
NUMBERED = rf'\{{(?=("[\[{{]?\d{{10}}":{_INSIDE})\}})'
NUMBERED_MEMBERS = rf'"[\[{{]?(\d{{10}}":(?:{_ANY})),?+'


def canonical(body: Column) -> Column:
    """A text in JSON in the order of its names, without blanks; null for what is no JSON, or nested deeper than DEEPEST."""
    # a text with few brackets can't be deep, which is told sooner
    brackets = F.octet_length(body) - F.octet_length(F.replace(F.replace(body, F.lit("["), F.lit("")), F.lit("{"), F.lit("")))
    return F.to_json(F.when((brackets <= DEEPEST) | body.rlike(rf"\A\s*+[\[{{]{_INSIDE}[\]}}]"), F.try_parse_json(body)))


def _numbered(json: Column) -> Column:
    """A text of canonical() with its lists as objects; members' names begin with an escape that JSON doesn't have."""
    # cut after each bracket of a list, and each comma within it
    pieces = F.regexp_extract_all(json, F.lit(rf'[^"\[\],]*+(?:(?:{_STRING}|\[\]|,{_STRING}:)[^"\[\],]*+)*+(?:[\[\],]|\z)'), F.lit(0))

    def put(x: Column, i: Column) -> Column:
        number = F.concat(F.lit(r'"\~'), (i + 1_000_000_000).cast("string"), F.lit('":'))
        bare = F.substring(x, F.lit(1), F.length(x) - 1)
        return F.when(x.endswith(","), F.concat(x, number)).when(x.endswith("["), F.concat(bare, F.lit("{"), number)).when(x.endswith("]"), F.concat(bare, F.lit("}"))).otherwise(x)

    return F.array_join(F.transform(pieces, put), "")


def own_first(json: Column) -> Column:
    """A text of canonical() with each node's own values before those within it, in the form told above."""
    marked = lambda x: F.regexp_replace(x, rf'\G([^"]*+(?:(?<=:){_STRING}[^"]*+)*+)"(?:\\~(\d++)":|({CHARS})"(:))(?=([\[{{])?)', '$1"$5$4$2$3":')
    # a whole number of floating point would be read as a decimal, and lose its .0
    floats = lambda x: F.regexp_replace(x, rf'\G((?:[^".]++|{_STRING}|\.(?!0[,}}]))*+)\.0(?=[,}}])', "$1.0e0")
    numbered = marked(_numbered(json))
    ordered = F.to_json(F.try_parse_json(F.when(json.contains(".0"), floats(numbered)).otherwise(numbered)))
    # what holds no other is in order as it is
    return F.when(json.rlike(r"\A\{[^\[{]*+\z"), marked(json)).otherwise(ordered)


def said(text: Column) -> Column:
    """A text as it was before it was written in JSON, given without its quotes."""
    return F.when(text.contains("\\"), F.try_variant_get(F.try_parse_json(F.concat(F.lit('"'), text, F.lit('"'))), "$", "string")).otherwise(text)
