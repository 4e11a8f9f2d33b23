"""Operator 7, personal data: base patterns, and bootstrapped contextual extraction of further identifiers.

Tokens with digits or an at sign are instances; the words before them, and a token's shape, are their
lexical patterns. Instances that hold a base span are the seeds. Round by round, patterns are scored by the
confidence of their distinct instances and instances by their patterns, on the graph of both as joins and
sums, until no confidence changes; what high-confidence patterns point to is found too. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from advisorium.llm.common import cut, table
from advisorium.llm.spans import Kind, joined, matches, with_touches

#: Possessive repeats keep Java's matcher from recursing on long runs; what follows them cannot be given back
#: to a match here. A local part is only tried from its run's start (or from where the last match ended).
KINDS = [
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", only_if="@"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", only_if="+"),
    Kind("found", r"(?<!\S)(?=[^\s0-9@]*+[0-9@])\S++", context=True),
]
NAMES = [k.name for k in KINDS]
FOUND = len(KINDS) - 1


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)
    digit = lambda i: F.substring(digits, n - i, F.lit(1)).cast("int")  # noqa: E731  from the right
    worth = lambda i: F.when(i % 2 == 0, digit(i)).when(digit(i) > 4, digit(i) * 2 - 9).otherwise(digit(i) * 2)
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + worth(i)) % 10 == 0


def valid(kind: Column, value: Column) -> Column:
    """Whether a match is kept: parts, digits and check digits in their limits."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    short = F.transform(F.split(value, r"\."), lambda x: F.regexp_replace(x, "^0+", ""))
    ip = F.forall(short, lambda x: (F.length(x) < 3) | ((F.length(x) == 3) & (x <= "255")))
    card = F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    return F.when(kind == 1, ip).when(kind == 2, card).when(kind == 3, F.length(digits).between(9, 15)).otherwise(True)


def shape(token: Column) -> Column:
    """An at sign, at least four digits, or fewer: as @, 0000 or 0."""
    return F.when(token.contains("@"), "@").when(F.length(F.regexp_replace(token, "[^0-9]", "")) >= 4, "0000").otherwise("0")


def patterns_of(words: Column, token: Column) -> Column:
    """The lexical patterns of an instance: the word before it, and the two words before it, each with the token's shape."""
    near = F.when(F.size(words) > 0, F.concat_ws(" ", F.element_at(words, -1), shape(token)))
    both = F.when(F.size(words) > 1, F.concat_ws(" ", F.array_join(words, " "), shape(token)))
    return F.filter(F.array(near, both), lambda p: p.isNotNull())


def bootstrap(mentions: DataFrame, rounds: int = 60, least_support: int = 3, least_confidence: float = 0.8) -> DataFrame:
    """Tokens that high-confidence patterns find: token. mentions has token, seed (boolean) and patterns (array).

    A pattern's confidence is the mean confidence of its distinct tokens, if at least least_support of them
    are confident, else 0; a token's is 1 for seeds, else one minus the product of its patterns' doubts, rounded down to
    three decimals. Only patterns and tokens of at least least_confidence count in the next round. Confidence only ever grows,
    and rounds go on until it is the same for all tokens (RuntimeError if it still grows after rounds).
    """
    edges = cut(mentions.select("token", "seed", F.explode("patterns").alias("pattern")).groupBy("token", "pattern").agg(F.max("seed").alias("seed")), "edges")
    seeds = sure = cut(edges.where("seed").select("token").distinct().withColumn("confidence", F.lit(1.0)), "seeds")
    doubt = F.exp(F.sum(F.log(F.greatest(1 - F.col("trust"), F.lit(1e-9)))))
    confidence = F.floor((1 - doubt) * 1000 + 1e-6) / 1000
    others = edges.where("not seed").join(seeds.select("token"), "token", "left_anti").select("token", "pattern")
    before = None
    for _ in range(rounds):
        rated = edges.join(sure, "token", "left").groupBy("pattern").agg(F.count("confidence").alias("support"), (F.coalesce(F.sum("confidence"), F.lit(0.0)) / F.count("*")).alias("trust"))
        trusted = rated.where((F.col("support") >= least_support) & (F.col("trust") >= least_confidence)).select("pattern", "trust")
        reached = cut(others.join(trusted, "pattern").groupBy("token").agg(confidence.alias("confidence")).where(F.col("confidence") >= least_confidence), "reached")
        now = reached.agg(F.count("*"), F.sum(F.round(F.col("confidence") * 1000).cast("long"))).first()
        if now == before:
            return reached.select("token")
        before, sure = now, seeds.unionByName(reached)
    raise RuntimeError(f"confidences still grew after {rounds} rounds")


def personal_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 60, least_support: int = 3, least_confidence: float = 0.8) -> DataFrame:
    """One row per input row: row, doc_id, digest (the text's xxhash64), n_email, n_ip, n_card, n_phone, base (spans), spans (all); a span has kind, begin, finish.

    Spans are in code points, end exclusive, by kind and then start. Identifiers found by bootstrapping are
    spans of kind found and touch no base span. An instance is a token between white space with a digit or an at
    sign; words of letters alone are contexts and never instances.

    A null or empty text has no spans; without seeds nothing is found beside the base. Repeated rows and
    null ids are each returned, texts are read whole, other columns are not read, and an empty table gives
    no rows.
    """
    found = matches(docs, KINDS, id_col, text_col, shape)
    token = F.col("kind") == FOUND
    found = with_touches(found.where(F.col("kind").isNull() | valid(F.col("kind"), F.col("value"))), ~token)
    span = F.struct("kind", "begin", "finish")
    mention = F.struct("kind", "begin", "finish", F.col("value").alias("token"), patterns_of(F.col("left"), F.col("value")).alias("patterns"), F.col("touches").alias("seed"))
    by_row = found.groupBy("row", "doc_id", "digest").agg(F.array_sort(F.collect_list(F.when(~token, span))).alias("base"), F.collect_list(F.when(token, mention)).alias("mentions"))
    by_row = cut(by_row, "mentions")
    each = by_row.select("row", F.explode("mentions").alias("m")).select("row", "m.*")
    more = bootstrap(each.select("token", "seed", "patterns"), rounds, least_support, least_confidence)
    added = each.where("not seed").join(more, "token", "left_semi").groupBy("row").agg(F.collect_list(F.struct("kind", "begin", "finish")).alias("added"))
    none = F.array().cast("array<struct<kind:int,begin:bigint,finish:bigint>>")
    number = lambda k: F.size(F.filter("base", lambda b: b["kind"] == k)).cast("long")
    out = by_row.select("row", "doc_id", "digest", "base").join(added, "row", "left")
    return out.select("row", "doc_id", "digest", *[number(k).alias(f"n_{NAMES[k]}") for k in range(FOUND)], "base", F.array_sort(F.concat("base", F.coalesce("added", none))).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in angle brackets; of spans that overlap, the first to start, then the longest."""
    named = F.array(*[F.lit(x) for x in NAMES])
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["begin"].alias("begin"), (-s["finish"]).alias("f"), s["kind"].alias("kind"))))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(done: Column, s: Column) -> Column:
        label = F.concat(F.lit("<"), F.element_at(named, s["kind"] + 1), F.lit(">"))
        before = F.substring(text, (done["at"] + 1).cast("int"), (s["begin"] - done["at"]).cast("int"))
        grown = F.struct(F.concat(done["out"], F.array(before, label)).alias("out"), (-s["f"]).alias("at"))
        return F.when(s["begin"] >= done["at"], grown).otherwise(F.struct(done["out"].alias("out"), F.greatest(done["at"], -s["f"]).alias("at")))

    done = F.aggregate(order, start, step)
    return F.when(F.size(spans) > 0, F.concat(F.array_join(done["out"], ""), F.substring(text, (done["at"] + 1).cast("int"), F.length(text)))).otherwise(text)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents, as counts and span texts."""
    found = personal_spans(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(joined(F.col("base"), NAMES), 256).alias("base_sha256"), joined(F.col("spans"), NAMES).alias("spans"))
