"""Joins of names by few edits or by containment, as equi-joins: no pair of names is tried that shares no part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from advisorium.functions import urls
from advisorium.operators.records import small

#: Characters of the grams by which contained names are found; no shorter name is looked for.
GRAM = 4


def shortened(name: Column, edits: int) -> Column:
    """The name, and all that is left of it when up to edits characters are taken out, each once."""
    found = F.array(name)
    for _ in range(edits):
        cut = F.flatten(F.transform(found, lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda i: F.concat(F.left(x, i - 1), F.substring(x, i + 1, F.length(x))))))
        found = F.array_distinct(F.concat(found, cut))
    return found


def grams(name: Column, size: int = GRAM) -> Column:
    """Distinct stretches of size characters."""
    places = F.sequence(F.lit(1), F.greatest(F.length(name) - size + 1, F.lit(1)))
    return F.array_distinct(F.transform(places, lambda i: F.substring(name, i, F.lit(size))))


def within_edits(names: DataFrame, targets: DataFrame, edits: Column, most: int) -> DataFrame:
    """(name, target, distance) of distinct names (name) and targets (target) that differ, by at most edits, which may depend on the target, and at most most.

    Two texts within k edits share what is left when up to k characters are taken out of each, so they meet by equality on
    that; names longer than any target could be near are not spread.
    """
    longest = targets.agg(F.max(F.length("target"))).first()[0] or 0
    spread = names.where(F.length("name") <= longest + most).select("name", F.explode(shortened(F.col("name"), most)).alias("s_key"))
    # a target that allows fewer edits is spread as far as it allows
    reach = F.lit(None).cast("array<string>")
    for k in range(most + 1):
        reach = F.when(edits == k, shortened(F.col("target"), k)).otherwise(reach)
    aimed = targets.select("target", edits.alias("s_edits"), F.explode(reach).alias("s_key"))
    met = spread.join(small(aimed), "s_key").select("name", "target", "s_edits").distinct().withColumn("distance", F.levenshtein("name", "target"))
    return met.where((F.col("distance") > 0) & (F.col("distance") <= F.col("s_edits"))).select("name", "target", "distance")


def near_names(names: DataFrame, targets: DataFrame, name: str = "name", target: str = "target", short: int = 6, least: int = GRAM) -> DataFrame:
    """(name, target, distance) of distinct names and the targets that they resemble, but not those that they equal.

    A target of up to short characters allows one edit, a longer one two; a target that stands whole within a
    longer name has distance 0 unless it is within those edits. Targets under least characters, and null names, meet
    nothing. Names meet as in within_edits(); containment meets by the target's first GRAM characters among all the name's.
    """
    if least < GRAM:
        raise ValueError(f"targets must have at least {GRAM} characters")
    own = names.select(F.col(name).alias("name")).where("name is not null").distinct()
    known = targets.select(F.col(target).alias("target")).where(F.length("target") >= least).distinct()
    edited = within_edits(own, known, F.when(F.length("target") <= short, 1).otherwise(2), 2)
    held = own.select("name", F.explode(grams(F.col("name"))).alias("s_key")).join(small(known.select("target", F.left("target", F.lit(GRAM)).alias("s_key"))), "s_key")
    held = held.where(F.contains("name", F.col("target")) & (F.col("name") != F.col("target"))).select("name", "target", F.lit(0).alias("distance")).distinct()
    return edited.unionByName(held).groupBy("name", "target").agg(F.max("distance").alias("distance"))


def typosquats(hosts: DataFrame, official: DataFrame, host: str = "host") -> DataFrame:
    """(host, imitates, distance) of hosts that read like an official domain without being or lying under one, or under a government's.

    official has domain and position; of several the one of the smallest position counts. Organisations' labels are compared,
    without what is generic in a host.
    """
    label = urls.organisation(F.col("host"))
    plain = hosts.select(F.col(host).alias("host")).where("host is not null").distinct()
    # every suffix of a host meets the official domains by equality
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    owned = plain.select("host", F.explode(suffixes).alias("domain")).join(small(official.select("domain").distinct()), "domain").select("host").distinct()
    strange = plain.join(owned, "host", "left_anti").where(~urls.under_any(F.col("host"), urls.GOVERNMENTS)).withColumn("t_label", label)
    named = official.select("domain", "position", urls.organisation(F.col("domain")).alias("t_target"))
    near = near_names(strange, named, "t_label", "t_target").select(F.col("name").alias("t_label"), F.col("target").alias("t_target"), "distance")
    met = strange.join(near, "t_label").join(small(named), "t_target")
    return met.groupBy("host").agg(F.min_by(F.struct(F.col("domain").alias("imitates"), "distance"), F.struct("position", "domain")).alias("x")).select("host", "x.*")
