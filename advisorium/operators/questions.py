"""Questions in words as conditions over records: a parsed question is data, its filter an ordinary column."""

from __future__ import annotations

import datetime as dt
import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from advisorium.functions import dates, scoring

#: Severity words by severity (fixed values).
SEVERITY_WORDS = {"critical": ["critical", "critique", "critiques"], "high": ["high", "élevée", "élevées"], "medium": ["medium", "moyenne", "moyennes"], "low": ["low", "faible", "faibles"]}
#: Words that carry no criterion (fixed values).
EMPTY_WORDS = {"the", "a", "of", "for", "which", "what", "show", "list", "me", "all", "vulnerabilities", "vulnerability", "since", "last", "days", "day", "this", "week", "month", "year", "today", "yesterday", "in", "with", "score", "above", "about", "how", "many", "are", "there"}


class Parsed(NamedTuple):
    ids: list[str]
    severity: str | None
    least_score: float | None
    first: dt.date | None
    last: dt.date | None
    words: list[str]


def parsed(question: str, today: dt.date) -> Parsed:
    """Ids, severity, least score, period and remaining words of a question."""
    low = question.lower()
    ids = list(dict.fromkeys(x.upper() for x in re.findall(r"cve-\d{4}-\d{4,}", low)))
    tokens = re.findall(r"[^\W_]+", re.sub(r"cve-\d{4}-\d{4,}", " ", low))
    severity = next((name for name, words in SEVERITY_WORDS.items() if any(w in tokens for w in words)), None)
    score = re.search(r"(?:score|cvss)\s*(?:above|>=|over|≥)\s*(\d+(?:\.\d+)?)", low)
    period = dates.period_of(question, today)
    used = {w for words in SEVERITY_WORDS.values() for w in words} | EMPTY_WORDS | {"cvss", "over"}
    return Parsed(ids, severity, float(score[1]) if score else None, *(period or (None, None)), [t for t in tokens if t not in used and not t.isdigit()])


def condition(p: Parsed, words: bool = True) -> Column:
    """All criteria of a parsed question at once; words must each stand whole in vendor or product."""
    found = F.lit(True)
    if p.ids:
        found &= F.col("cve_id").isin(p.ids)
    if p.severity:
        found &= scoring.severity(F.col("cvss_score")) == p.severity
    if p.least_score is not None:
        found &= F.col("cvss_score") >= p.least_score
    if p.first and p.last:
        found &= (F.col("published_at") >= F.lit(str(p.first)).cast("timestamp_ntz")) & (F.col("published_at") < F.lit(str(p.last + dt.timedelta(days=1))).cast("timestamp_ntz"))
    for w in p.words if words else []:
        found &= F.lower(F.concat_ws(" ", "vendor", "product")).rlike(rf"(^|[^a-z0-9]){re.escape(w)}([^a-z0-9]|$)")
    return found


def answer(records: DataFrame, question: str, today: dt.date) -> DataFrame:
    """Records that a question asks for; if none has its words and it has another criterion, the words are dropped."""
    p = parsed(question, today)
    found = records.where(condition(p))
    structured = p.ids or p.severity or p.least_score is not None or p.first
    if p.words and structured and found.isEmpty():
        return records.where(condition(p, words=False))
    return found
