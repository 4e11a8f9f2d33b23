"""Scores, severities and dates of records as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Severity names by rank, lowest first (fixed values).
SEVERITIES = ["low", "medium", "high", "critical"]


def severity(score: Column) -> Column:
    """Severity by CVSS score: critical from 9, high from 7, medium from 4, low above 0; null for 0 and null."""
    return F.when(score >= 9, "critical").when(score >= 7, "high").when(score >= 4, "medium").when(score > 0, "low")


def severity_rank(name: Column) -> Column:
    """4 for critical down to 1 for low; 0 for anything else."""
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in SEVERITIES]), name), F.lit(0)), F.lit(0)).cast("int")


def weighted(checks: list[tuple[Column, float]]) -> Column:
    """100 times the passed weight over the determined weight, rounded half to even; 50 if nothing is determined."""
    passed = sum((F.when(c, w).otherwise(0.0) for c, w in checks), F.lit(0.0))
    known = sum((F.when(c.isNotNull(), w).otherwise(0.0) for c, w in checks), F.lit(0.0))
    return F.when(known == 0, 50).otherwise(F.bround(100 * passed / F.nullif(known, F.lit(0.0)))).cast("int")


def completeness(fields: list[Column]) -> Column:
    """Per cent of fields that are filled; 0 counts as filled, null and the empty string do not."""
    filled = sum((F.when(c.isNotNull() & (c.cast("string") != ""), 1).otherwise(0) for c in fields), F.lit(0))
    return F.bround(filled * 100 / len(fields)).cast("int")


def resync_tier(age_hours: Column) -> Column:
    """Re-sync priority by age: 1 up to a day, 2 up to a week, 3 up to thirty days, else 4; unknown ages are new."""
    age = F.coalesce(age_hours, F.lit(0.0))
    return F.when(age <= 24, 1).when(age <= 24 * 7, 2).when(age <= 24 * 30, 3).otherwise(4)


def date_accepted(old: Column, new: Column, collected: Column, now: Column, verified: Column) -> Column:
    """Whether a new publication date replaces the old: credible, not after discovery unless verified, and earlier."""
    credible = (new >= F.lit("1999-01-01").cast("timestamp_ntz")) & (new <= now + F.expr("INTERVAL 2 DAYS"))
    late = (new > collected + F.expr("INTERVAL 1 DAY")) & ~verified
    return F.coalesce(credible & ~F.coalesce(late, F.lit(False)) & (old.isNull() | (new < old)), F.lit(False))


#: Base metrics of a CVSS vector with their values, and what version 4 calls some of them (fixed values).
METRICS = {"AV": "NALP", "AC": "LH", "PR": "NLH", "UI": "NRPA", "S": "CU", "C": "HLN", "I": "HLN", "A": "HLN"}
VERSION_4 = {"VC": "C", "VI": "I", "VA": "A", "AT": "AC"}


def cvss_metrics(vector: Column) -> Column:
    """The base metrics of a CVSS vector as a map by version 3's names; the first value of a metric counts, unknown ones are left out."""
    pairs = F.regexp_extract_all(F.upper(vector), F.lit("[A-Z]{1,2}:[A-Z]"), F.lit(0))

    def renamed_pair(p: Column) -> Column:
        for new, old in VERSION_4.items():
            p = F.regexp_replace(p, f"^{new}:", f"{old}:")
        return p

    renamed = F.transform(pairs, renamed_pair)
    known = F.array_distinct(F.filter(renamed, lambda p: p.isin([f"{k}:{v}" for k, values in METRICS.items() for v in values])))
    key = lambda p: F.substring_index(p, ":", 1)
    first = F.aggregate(known, F.array().cast("array<string>"), lambda s, p: F.when(F.exists(s, lambda q: key(q) == key(p)), s).otherwise(F.concat(s, F.array(p))))
    return F.map_from_entries(F.transform(first, lambda p: F.struct(key(p), F.substring_index(p, ":", -1))))


def exploitation(status: Column, references: Column) -> Column:
    """kev for a stated status or a reference to the catalogue of exploited vulnerabilities, poc for one to published proof, else null."""
    joined = F.lower(F.array_join(references, " "))
    known = joined.contains("known-exploited-vulnerabilit")
    proof = joined.rlike(r"exploit-db\.com|/exploits?/|packetstorm|metasploit|proof.of.concept")
    return F.when(F.trim(status) != "", "kev").when(known, "kev").when(proof, "poc")


def worst_severity(names: Column) -> Column:
    """Of severity names in either case the highest, null if none is known."""
    ranked = F.filter(F.transform(names, lambda x: F.struct(severity_rank(F.lower(x)).alias("rank"), F.lower(x).alias("name"))), lambda x: x["rank"] > 0)
    return F.array_max(ranked)["name"]


def pass_ratio(checks: list[Column]) -> Column:
    """Per cent of determined checks that passed, rounded half to even; 0 if none is determined."""
    passed = sum((F.when(c, 1).otherwise(0) for c in checks), F.lit(0))
    known = sum((F.when(c.isNotNull(), 1).otherwise(0) for c in checks), F.lit(0))
    return F.coalesce(F.bround(100 * passed / F.nullif(known, F.lit(0))), F.lit(0)).cast("int")


def shown_value(value: Column) -> Column:
    """A value for a label of change: 60 characters at most, or that it is missing."""
    return F.when(F.coalesce(value, F.lit("")) == "", "non renseigné").otherwise(F.left(value, F.lit(60)))


def change_label(name: str, old: Column, new: Column) -> Column:
    """name : before → after, or name : after (ajouté) where there was nothing before; null if nothing changed."""
    label = F.when(F.coalesce(old, F.lit("")) == "", F.concat(F.lit(f"{name} : "), shown_value(new), F.lit(" (ajouté)"))).otherwise(F.concat(F.lit(f"{name} : "), shown_value(old), F.lit(" → "), shown_value(new)))
    return F.when(~old.eqNullSafe(new), label)


def registry_score(body: Column) -> Column:
    """Score and severity of a registry's JSON object: version 3.1's first metric, else 3.0's, else 2's; a label that is no severity gives way to the score."""
    best = F.lit(None).cast("struct<score:double,severity:string>")
    for name in ("cvssMetricV2", "cvssMetricV30", "cvssMetricV31"):
        at = f"$.metrics.{name}[0]"
        score = F.get_json_object(body, f"{at}.cvssData.baseScore").try_cast("double")
        label = F.lower(F.coalesce(F.get_json_object(body, f"{at}.cvssData.baseSeverity"), F.get_json_object(body, f"{at}.baseSeverity")))
        here = F.struct(score.alias("score"), F.coalesce(F.when(label.isin(SEVERITIES), label), severity(score)).alias("severity"))
        best = F.when(F.get_json_object(body, at).isNotNull(), here).otherwise(best)
    return best


#: Words of sensational titles (fixed values), and the length under which a page says too little.
SENSATIONAL = ["choquant", "incroyable", "vous n'allez pas croire", "urgent", "alerte maximale", "catastrophe", "scandale", "explosif", "shocking", "you won't believe", "breaking", "must read", "insane", "terrifying"]
ENOUGH = 500


def credibility(body: Column, reputation: Column, official: Column, ids: Column, known: Column, dated: Column, owner: Column, confirmed: Column) -> Column:
    """A page's credibility from 0 to 100 by weighted checks; under a blacklisted host it is 10 at most.

    reputation: as urls.reputation says; official: true or null; ids: number of ids; known: whether the registry has them, or
    null; dated, owner: whether the page tells its date and organisation; confirmed: by other sources, or null.
    """
    low = F.lower(body)
    calm = ~F.contains(body, F.lit("!!!"))
    for word in SENSATIONAL:
        calm &= ~low.contains(word)
    linked = low.rlike("<a |https?://|<link")
    checks = [
        (F.when(official, True), 3.0), (F.when(reputation == "whitelisted", True), 2.0), (F.when(reputation == "blacklisted", False), 4.0), (ids > 0, 1.5), (F.when(ids > 0, known), 1.5),
        (F.trim(F.regexp_extract(body, r"(?is)<title[^>]*>(.*?)</title>", 1)) != "", 1.0), (dated, 2.0), (owner, 3.0), (calm, 1.0), (F.length(F.trim(body)) >= ENOUGH, 1.0), (linked, 1.0), (confirmed, 1.5),
    ]
    score = weighted(checks)
    return F.when(reputation == "blacklisted", F.least(score, F.lit(10))).otherwise(score)


#: Words of technical discussions (fixed values).
TECHNICAL_WORDS = ["exploit", "poc", "proof of concept", "patch", "mitigation", "workaround", "vulnerab", "attack", "payload", "advisory", "remediation", "detection", "analysis", "correctif", "faille"]


def overall(technical: Column, credible: Column, authentic: Column) -> Column:
    """A source's score from 0 to 100: three tenths technical, half credibility, two tenths authenticity, rounded half to even."""
    return F.bround((3 * technical + 5 * credible + 2 * authentic) / 10).cast("int")


def decision(total: Column, technical: Column, banned: Column, approve: int, review: int, least: int) -> Column:
    """rejected if banned or under review; review if under approve or technically under least; else approved."""
    return F.when(banned | (total < review), "rejected").when((total < approve) | (technical < least), "review").otherwise("approved")


def discussion_relevance(cve_id: Column, title: Column, body: Column, comment: Column, answers: Column, comments: Column) -> Column:
    """How much a discussion is about an id, from 0 to 1: nothing unless it cites the id; then half, more for the title unless it is a
    comment, for technical words and for answers, less if it cites five other ids or more. Nulls count as absent."""
    said = F.lower(F.concat_ws(" ", title, body))
    cited = F.array_distinct(F.transform(F.regexp_extract_all(said, F.lit(r"cve-\d{4}-\d{4,}"), F.lit(0)), F.upper))
    points = lambda c, n: F.when(F.coalesce(c, F.lit(False)), n).otherwise(0)
    total = 50 + points(F.contains(F.upper(title), F.upper(cve_id)) & ~F.coalesce(comment, F.lit(False)), 30) + points(said.rlike("|".join(TECHNICAL_WORDS)), 15) + points((F.coalesce(answers, F.lit(0)) > 0) | (F.coalesce(comments, F.lit(0)) >= 3), 5)
    total = total - points(F.size(F.array_except(cited, F.array(F.upper(cve_id)))) >= 5, 20)
    return (F.when(F.coalesce(F.array_contains(cited, F.upper(cve_id)), F.lit(False)), F.greatest(F.lit(0), F.least(F.lit(100), total))).otherwise(0) / 100).cast("decimal(3,2)")
