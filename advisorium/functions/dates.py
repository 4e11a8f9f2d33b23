"""Dates in texts, period phrases and schedules as columns or literals."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: French month names in full, with and without accents, and English ones by three letters (fixed values).
FRENCH_MONTHS = {"janvier": 1, "février": 2, "fevrier": 2, "mars": 3, "avril": 4, "mai": 5, "juin": 6, "juillet": 7, "août": 8, "aout": 8, "septembre": 9, "octobre": 10, "novembre": 11, "décembre": 12, "decembre": 12}
ENGLISH_MONTHS = {"jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12}
#: Units of relative times (fixed values).
UNITS = {
    "SECOND": ["s", "sec", "secs", "second", "seconds", "seconde", "secondes"], "MINUTE": ["m", "mn", "min", "mins", "minute", "minutes"],
    "HOUR": ["h", "he", "heure", "heures", "hour", "hours"], "DAY": ["j", "jour", "jours", "d", "day", "days"], "WEEK": ["sem", "semaine", "semaines", "w", "week", "weeks"],
}
#: Words that show a relative time, those that mean now, and those that mean the day before (fixed values).
RELATIVE = ["ago", "il y a", "auparavant", "hier", "yesterday", "aujourd'hui", "aujourdhui", "today", "just now", "à l'instant", "à l’instant", "min", "h"]
PRESENT = ["just now", "à l'instant", "à l’instant", "maintenant", "now", "today", "aujourd'hui", "aujourd’hui", "aujourdhui"]
PAST_DAY = ["yesterday", "hier"]
#: Phrases before a date that tell what it is, by kind (fixed values).
CUES = {
    "deadline": ["due date", "duedate", "date d'échéance", "date d'echeance", "échéance", "echeance", "deadline", "expires", "expire", "remediation due", "action due"],
    "modified": ["last updated", "lastupdated", "modified", "date modified", "updated", "mis à jour", "dernière modification", "derniere modification"],
    "publish": ["date added", "dateadded", "added on", "published", "date published", "publication", "publié le", "publié", "date de publication", "pubdate", "pub date", "created", "date created", "disclosed", "disclosure", "release date", "released", "dc:date", "dc.date"],
}


def _looked_up(names: dict[str, int], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), key)


def month_number(name: Column) -> Column:
    """The month of a French full or English name, the latter by its first three letters, in either case; null for anything else."""
    low = F.lower(F.trim(name))
    return F.coalesce(_looked_up(FRENCH_MONTHS, low), _looked_up(ENGLISH_MONTHS, F.left(low, F.lit(3))))


def _day(year: Column, month: Column, day: Column) -> Column:
    """A date of numbers as texts, as midnight; null if there is no such day."""
    return F.concat_ws("-", year, F.lpad(month.cast("string"), 2, "0"), F.lpad(day, 2, "0")).try_cast("date").cast("timestamp_ntz")


def relative_time(text: Column, now: Column) -> Column:
    """The time that a text like "2h ago", "il y a 30 minutes" or "hier" means; null if it is none."""
    low = F.lower(F.trim(text))
    every = sorted({x for words in UNITS.values() for x in words}, key=lambda x: (-len(x), x))
    pattern = rf"(\d{{1,6}})\s*({'|'.join(every)})\b"
    n, unit = F.regexp_extract(low, pattern, 1).try_cast("int"), F.regexp_extract(low, pattern, 2)
    ahead = F.lit(None).cast("timestamp_ntz")
    for name, words in UNITS.items():
        ahead = F.when(unit.isin(words), F.timestamp_add(name, -n, now)).otherwise(ahead)
    said = F.lower(text).rlike("|".join(rf"(?U)\b{x}\b" if x in ("ago", "min", "h") else x for x in RELATIVE))
    return F.when(said, F.when(low.isin(PRESENT), now).when(low.isin(PAST_DAY), F.timestamp_add("DAY", F.lit(-1), now)).otherwise(ahead))


def parsed_time(text: Column, now: Column) -> Column:
    """A text as a time without zone, in UTC: relative times, ISO, the first YYYY-MM-DD, "Mon D, YYYY", "D Mon YYYY", then numbers.

    Of numbers with slashes or points the first is the month if it is at most 12, else the day. A named month with an
    impossible day gives null.
    """
    bare = F.trim(text)
    iso = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?)?"
    naive = F.when(bare.rlike(iso + "$"), bare).try_cast("timestamp_ntz")
    zoned = F.when(bare.rlike(iso + r"(?:Z|[+-]\d{2}:\d{2})$"), bare).try_cast("timestamp")
    utc = F.to_utc_timestamp(zoned, F.current_timezone()).cast("timestamp_ntz")
    part = lambda p, i: F.regexp_extract(text, p, i)
    first = F.regexp_extract(text, r"\d{4}-\d{2}-\d{2}", 0).try_cast("date").cast("timestamp_ntz")
    name = r"\p{L}{3,9}"
    month_first, day_first, numbers = rf"(?<![\p{{L}}\d])({name})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})\b", rf"\b(\d{{1,2}})(?:st|nd|rd|th)?\s+({name})\.?\s+(\d{{4}})\b", r"\b(\d{1,2})[/.](\d{1,2})[/.](\d{4})\b"
    one, two = month_number(part(month_first, 1)), month_number(part(day_first, 2))
    a, b, year = part(numbers, 1), part(numbers, 2), part(numbers, 3)
    by_number = F.when(a.try_cast("int") <= 12, _day(year, a, b)).otherwise(_day(year, b, a))
    named = F.when(one.isNotNull(), _day(part(month_first, 3), one, part(month_first, 2))).when(two.isNotNull(), _day(part(day_first, 3), two, part(day_first, 1))).when(year != "", by_number)
    return F.coalesce(relative_time(text, now), naive, utc, first, named)


def date_kind(before: Column) -> Column:
    """What a date is by the nearest phrase in the text before it: publish, modified or deadline; else plain."""
    low = F.lower(before)
    at = [F.struct((F.length(low) - F.nullif(F.instr(F.reverse(low), cue[::-1]), F.lit(0)) - len(cue) + 2).alias("at"), F.lit(-k).alias("k"), F.lit(kind).alias("kind")) for k, (kind, cues) in enumerate(CUES.items()) for cue in cues]
    best = F.array_max(F.filter(F.array(*at), lambda x: x["at"].isNotNull()))
    return F.coalesce(best["kind"], F.lit("plain"))


def content_kind(body: Column, content_type: Column, method: Column) -> Column:
    """Whether a body is json, xml or html, by its first character, its stated type and how it was collected."""
    bare, said, how = F.ltrim(F.regexp_replace(F.coalesce(body, F.lit("")), r"^\s+", "")), F.lower(F.coalesce(content_type, F.lit(""))), F.lower(F.coalesce(method, F.lit("")))
    head = F.lower(F.left(bare, F.lit(2000)))
    xml = said.rlike("xml|rss|atom") | (how == "rss") | head.startswith("<?xml") | head.contains("<rss") | head.contains("<feed")
    return F.when(F.left(bare, F.lit(1)).isin("{", "["), "json").when(xml, "xml").otherwise("html")


def names_day(text: Column, day: dt.date) -> Column:
    """Whether a text names a day: as ISO, with slashes with and without zeros, in French, or in English with and without a comma."""
    french = list(FRENCH_MONTHS)[[*FRENCH_MONTHS.values()].index(day.month)]
    english = day.strftime("%B").lower()
    forms = [day.isoformat(), f"{day:%d/%m/%Y}", f"{day.day}/{day.month}/{day.year}", f"{day.day} {french} {day.year}", f"{english} {day.day}, {day.year}", f"{english} {day.day} {day.year}"]
    low = F.lower(text)
    found = F.lit(False)
    for x in forms:
        found |= F.coalesce(low.contains(x), F.lit(False))
    return found


def fresh(made: Column, now: Column, hours: int, version: Column | None = None, wanted: int = 1) -> Column:
    """Whether something made within so many hours, and by the wanted version of its rule, may be used again."""
    young = F.coalesce(F.timestamp_diff("SECOND", made, now) < 3600 * hours, F.lit(False))
    return young if version is None else young & F.coalesce(version == wanted, F.lit(False))


def iso_day(text: Column) -> Column:
    """The first date of a text as YYYY-MM-DD: ISO, then DD/MM/YYYY, then day, month name and year, then Month D, YYYY; null if there is none."""
    iso = F.regexp_extract(text, r"(\d{4}-\d{2}-\d{2})", 1)
    slash = r"(\d{1,2})/(\d{1,2})/(\d{4})"
    named = r"(\d{1,2})(?:er)?\s+(\p{L}+)\.?\s+(\d{4})"
    part = lambda p, i: F.regexp_extract(text, p, i)
    two = lambda c: F.lpad(c, 2, "0")
    by_slash = F.when(part(slash, 3) != "", F.concat_ws("-", part(slash, 3), two(part(slash, 2)), two(part(slash, 1))))
    month = month_number(part(named, 2))
    by_name = F.when(month.isNotNull(), F.concat_ws("-", part(named, 3), two(month.cast("string")), two(part(named, 1))))
    english = r"(\p{L}{3,9})\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})"
    first = month_number(part(english, 1))
    by_english = F.when(first.isNotNull(), F.concat_ws("-", part(english, 3), two(first.cast("string")), two(part(english, 2))))
    return F.coalesce(F.nullif(iso, F.lit("")), by_slash, by_name, by_english)


def period_of(phrase: str, today: dt.date) -> tuple[dt.date, dt.date] | None:
    """First and last day that a question's period phrase means, or None: today, yesterday, last N days, this week, month or year."""
    low = phrase.lower()
    if m := re.search(r"(?:last|derniers?|dernières?)\s+(\d+)\s+(?:days|jours)|(\d+)\s+derniers\s+jours", low):
        return today - dt.timedelta(days=int(m[1] or m[2])), today
    if re.search(r"\byesterday\b|\bhier\b", low):
        return (today - dt.timedelta(days=1),) * 2
    if re.search(r"\btoday\b|aujourd'?hui", low):
        return today, today
    if re.search(r"this week|cette semaine", low):
        return today - dt.timedelta(days=today.weekday()), today
    if re.search(r"this month|ce mois", low):
        return today.replace(day=1), today
    if re.search(r"this year|cette année", low):
        return today.replace(month=1, day=1), today
    return None


#: Names under which pages' metadata give their publication (fixed values).
META_DATES = ["article:published_time", "date", "dcterms.date", "datepublished", "dc.date", "pubdate"]


def page_date(html: Column) -> Column:
    """When a page was published, as a struct of day, found and confidence, all null if it doesn't say.

    Structured data come first (published, created, modified), then metadata, then the date after a phrase of publication in
    the visible text, then any date there.
    """
    blocks = F.array_join(F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]+application/ld\+json[^>]*>(.*?)</script>"), F.lit(1)), "\n")
    stated = F.coalesce(*[iso_day(F.regexp_extract(blocks, rf'"{key}"\s*:\s*"([^"]*)"', 1)) for key in ("datePublished", "dateCreated", "dateModified")])
    own = rf"(?i)\b(?:name|property|itemprop)\s*=\s*[\"'](?:{'|'.join(x.replace('.', chr(92) + '.') for x in META_DATES)})[\"']"
    metas = F.filter(F.regexp_extract_all(html, F.lit(r"(?i)<meta\s[^>]*>"), F.lit(0)), lambda m: m.rlike(own) & m.rlike(r"(?i)\bcontent\s*="))
    meta = iso_day(F.regexp_extract(F.get(metas, F.lit(0)), r"(?i)\bcontent\s*=\s*[\"']([^\"']*)[\"']", 1))
    visible = F.regexp_replace(html, "<[^>]+>", " ")
    after = iso_day(F.regexp_extract(visible, r"(?i)(?:publi\p{L}*|posted|date)\s*(?:le\b|on\b|:)?\s*(.{6,40})", 1))
    found = [(stated, "json_ld", 0.95), (meta, "html_metadata", 0.9), (after, "text_extraction", 0.8), (iso_day(visible), "text_extraction", 0.7)]
    how = lambda i: F.coalesce(*[F.when(f[0].isNotNull(), F.lit(f[i])) for f in found])
    return F.struct(F.coalesce(*[f[0] for f in found]).alias("day"), how(1).alias("found"), how(2).alias("confidence"))


def catch_up(last: Column, midnight: Column, most: int = 7) -> Column:
    """Where a day's window of collection begins, as a struct of since and why; it ends a day after midnight.

    At the last run that succeeded, but at most so many days before the end; two days before it if that run was today; at
    midnight if there was none.
    """
    back = lambda days: F.timestamp_add("DAY", F.lit(1 - days), midnight)
    capped, today = last < back(most), last >= midnight
    since = F.when(last.isNull(), midnight).when(capped, back(most)).when(today, back(2)).otherwise(last)
    return F.struct(since.alias("since"), F.when(last.isNull(), "no run").when(capped, "capped").when(today, "today").otherwise("since run").alias("why"))


def due_status(failing: Column, given_up: Column, found: Column, delay: Column, late: float) -> Column:
    """How a due collection ended: degraded if all failing sources were given up, else partial; without failures empty, late or complete."""
    done = F.when(found <= 0, "suspicious_empty").when(delay > late, "completed_late").otherwise("completed")
    return F.when(failing == 0, done).when(given_up, "degraded").otherwise("partial")
