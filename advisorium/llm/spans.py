"""Where patterns match in whole texts, with DataFrame functions only.

Spark extracts matches but not their places. Splitting a text by the same pattern gives the gaps between
the matches, and running sums of gap and match lengths are the places, in code points.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Kind(NamedTuple):
    name: str
    pattern: str  # Java's notation; must not match the empty string
    group: int = 0  # what is returned as value
    only_if: str = ""  # a cheaper text that all matches hold
    context: bool = False  # whether the words before a match are returned


#: Longer words stand in contexts by their digest.
LONGEST = 64


def last_two(words: Column) -> Column:
    """The last two of an array, or the one it has (slice gives none for a start beyond the array)."""
    return F.reverse(F.slice(F.reverse(words), 1, 2))


def last_words(text: Column) -> Column:
    """The last two words of a text, in lower case."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    return F.transform(last_two(words), lambda w: F.when(F.length(w) <= LONGEST, w).otherwise(F.md5(w)))


def numbered(k: int, context: bool) -> Callable[[Column, Column], Column]:
    """Of a match's (whole, gap before it, value) and its number, what is kept of it."""

    def one(x: Column, i: Column) -> Column:
        left = last_words(x["g"]) if context else F.lit(None).cast("array<string>")
        return F.struct(F.lit(k).alias("kind"), i.alias("i"), F.length(x["g"]).alias("gap"), F.length(x["w"]).alias("n"), x["v"].alias("value"), left.alias("left"))

    return one


def matches(docs: DataFrame, kinds: list[Kind], id_col: str, text_col: str, named: Callable[[Column], Column] = lambda value: value) -> DataFrame:
    """One row per match: row, doc_id, digest (the text's xxhash64), kind (its place in kinds), begin, finish, value, left; texts without one give a row with kind null.

    Matches are leftmost and do not overlap within a kind. row numbers the input rows, so that repeated ids
    stay apart; it is Spark's row id, so what is read must be the same each time, as files are. A null text is
    read as empty. left has the two words before a match of a kind with context, wherever in the text they stand;
    those that are matches of that kind themselves stand there as named(value).
    """
    text = F.coalesce(F.col("m_text"), F.lit(""))
    found = []
    for k, kind in enumerate(kinds):
        whole, gaps = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), F.split(text, kind.pattern, -1)
        value = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(kind.group)) if kind.group else whole
        zipped = F.arrays_zip(whole.alias("w"), F.slice(gaps, 1, F.size(whole)).alias("g"), value.alias("v"))

        has = text.rlike(kind.pattern) if not kind.only_if else text.contains(kind.only_if) & text.rlike(kind.pattern)
        found.append(F.when(has, F.transform(zipped, numbered(k, kind.context))))
    none = F.array().cast("array<struct<kind:int,i:int,gap:int,n:int,value:string,left:array<string>>>")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("m_text")).withColumn("digest", F.xxhash64("m_text"))
    rows = rows.select("row", "doc_id", "digest", F.explode_outer(F.concat(*[F.coalesce(x, none) for x in found])).alias("m")).select("row", "doc_id", "digest", "m.*")
    order = Window.partitionBy("row", "kind").orderBy("i")
    placed = rows.repartition("row").withColumn("finish", F.sum(F.col("gap").cast("long") + F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    if any(k.context for k in kinds):
        # the gap's own words, then the match before it, the words before that and one match more: two words at least, if there are any
        none = F.array().cast("array<string>")

        def earlier(n: int) -> Column:
            value = F.lag("value", n).over(order)
            return F.when(value.isNotNull(), F.array(named(value))).otherwise(none)

        words = F.concat(earlier(2), F.coalesce(F.lag("left", 1).over(order), none), earlier(1), F.col("left"))
        placed = placed.withColumn("left", last_two(words))
    return placed.select("row", "doc_id", "digest", "kind", (F.col("finish") - F.col("n")).alias("begin"), "finish", "value", "left")


def with_touches(placed: DataFrame, base: Column) -> DataFrame:
    """placed with the column touches: whether a match overlaps one of its row that is base.

    One that begins no later must end after its begin, one that begins no earlier must begin before its end; so the
    greatest end so far and the least begin from there on tell, as running values in order and in reverse order.
    """
    upto = (Window.unboundedPreceding, Window.currentRow)
    before = F.max(F.when(base, F.col("finish"))).over(Window.partitionBy("row").orderBy("begin").rangeBetween(*upto))
    after = F.min(F.when(base, F.col("begin"))).over(Window.partitionBy("row").orderBy(F.desc("begin")).rangeBetween(*upto))
    return placed.withColumn("touches", F.coalesce(before > F.col("begin"), F.lit(False)) | F.coalesce(after < F.col("finish"), F.lit(False)))


def joined(spans: Column, names: list[str]) -> Column:
    """kind:start:end of each (in the given order), comma-joined; of none, the empty string."""
    named = F.array(*[F.lit(x) for x in names])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(named, s["kind"] + 1), s["begin"].cast("string"), s["finish"].cast("string"))), ",")
