"""Risks by phrases and whole words: what the former patterns found, read once for each text that is said."""

import re

from pyspark.sql import functions as F

import __spark_entry__
from advisorium.functions import matching

PATTERNS = {
    r"remote code execution|arbitrary code|\brce\b|code arbitraire|exécution de code": "Exécution de code arbitraire à distance",
    r"denial of service|\bdos\b|déni de service": "Déni de service",
    r"information disclosure|sensitive (information|data)|data exposure|divulgation|fuite d": "Divulgation d'informations sensibles",
    r"privilege escalation|elevation of privilege|escalade de privil|élévation de privil": "Élévation de privilèges",
    r"cross-site scripting|\bxss\b": "Injection de scripts (XSS)",
    r"sql injection|injection sql": "Injection SQL",
    r"server-side request forgery|\bssrf\b": "Falsification de requêtes côté serveur (SSRF)",
    r"authentication bypass|security bypass|contournement": "Contournement de la politique de sécurité",
    r"spoofing|usurpation": "Usurpation d'identité",
    r"buffer overflow|out-of-bounds|dépassement de tampon|hors limites": "Corruption de mémoire",
}


def test_phrases_and_words_are_those_of_the_patterns(spark):
    bare = [re.sub(r"\\b", "", x) for p in PATTERNS for x in p.replace("sensitive (information|data)", "sensitive information|sensitive data").split("|")]
    texts = [f.format(x) for x in bare for f in ("A {}.", "a{}", "{}s", "é{}", "({})", "{0} {0}")] + ["fuite", "a dosé dos", "ßxss", "DOS_", "", "rce dos xss ssrf spoofing hors limites fuite d usurpation"]
    low = F.lower("t")
    free = F.filter(F.array(*[F.when(low.rlike(f"(?U){p}"), F.lit(x)) for p, x in PATTERNS.items()]), lambda x: x.isNotNull())
    rows = spark.createDataFrame([(x,) for t in texts for x in (t, t.upper())], "t string").select("t", matching.risks(F.col("t"), F.lit(None).cast("string")).alias("a"), free.alias("b")).collect()
    assert [r for r in rows if r.a != r.b] == [] and sum(bool(r.a) for r in rows) > 200


def test_what_is_said_alike_is_read_once(spark):
    plan = __spark_entry__.queries()["risk_labels"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 2
