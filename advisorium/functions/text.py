"""Identifiers, slugs, cleaning and language of texts as columns."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from advisorium.functions.columns import once

#: Stop words by language, in natural order.
STOP_WORDS = {"en": ["the", "and", "of", "to", "in", "is", "that", "for", "with", "this"], "fr": ["le", "la", "les", "de", "des", "et", "une", "est", "pour", "que"], "de": ["der", "die", "und", "das", "den", "von", "mit", "ist", "ein", "auf"], "es": ["el", "los", "que", "en", "por", "una", "con", "para", "del", "se"]}


def cve_ids(text: Column) -> Column:
    """Distinct CVE ids, upper-cased, in order of first sight."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(?i)CVE-\d{4}-\d{4,}"), F.lit(0)), F.upper))


def slug(text: Column) -> Column:
    """Lower case, every run of other characters than a-z and 0-9 as one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def strip_qualifier(text: Column) -> Column:
    """Without parenthesised parts; the original if nothing is left."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(text, r"\([^)]*\)", " "), r"\s+", " "))
    return F.when(bare == "", text).otherwise(bare)


def strip_tags(html: Column) -> Column:
    """Text of HTML: scripts and styles dropped, tags as spaces, basic entities decoded, white space collapsed."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), r"(?s)<[^>]*>", " ")
    for entity, character in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(character))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def language_by_stop_words(text: Column, upto: int = 6000) -> Column:
    """The language with most stop words in the first characters, ties in order of name; null if there is none."""
    words = F.split(F.lower(F.substring(text, 1, upto)), r"[^a-zäöüßàâçéèêëîïôûùñáíóú]+")

    def count(own: list[str]) -> Column:
        return F.size(F.filter(words, lambda w: w.isin(own)))

    counts = [F.struct(count(own).alias("n"), F.lit(-k).alias("k"), F.lit(name).alias("lang")) for k, (name, own) in enumerate(sorted(STOP_WORDS.items()))]
    best = F.array_max(F.array(*counts))
    return F.when(best["n"] > 0, best["lang"])


def redact(text: Column) -> Column:
    """Values after password, secret, token and key words as three asterisks."""
    return F.regexp_replace(text, r"(?i)((?:password|secret|token|api_?key)\s*[:=]\s*)\S+", "$1***")


def capped(text: Column, most: int) -> Column:
    """At most so many characters, with an ellipsis where it was cut."""
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.left(text, F.lit(most))), F.lit("…"))).otherwise(text)


#: Marks of code, of pages that were not shown, and of a site's own frame (fixed values).
CODE_MARKS = ["@media", ":root{", "<style", "<script", "nreum", "<!--", '"@context"', "function(", "function (", "px){", "display:none", "max-width:", "font-family:", "background-color:"]
UNSHOWN_MARKS = ["you are being redirected", "potential security issue", "enable javascript", "javascript is disabled", "access denied", "just a moment", "checking your browser", "attention required", "activez le javascript", "403 forbidden", "404 not found"]
FRAME_MARKS = [
    "cookie policy", "cookie consent", "accept cookies", "utilisation des cookies", "politique de cookies", "newsletter", "sign in", "log in", "subscribe", "all rights reserved",
    "privacy policy", "terms of use", "terms of service", "menu principal", "mentions legales", "by company size", "small and medium teams", "book a demo", "sign up", "pricing",
    "skip to content", "skip to main content", "quick links", "suggested searches", "aller au contenu", "back to top", "choose your language", "select region",
]
#: Titles of a portal's sections (fixed pattern).
SECTION_TITLE = r"(?i)(overview|insights|trends|newest|latest|trending)\b.{0,40}\b(cves?|vulnerabilit)|\b(cves?|vulnerabilit)\w*\b.{0,40}\b(overview|insights|trends)"
#: Function words by language that tell English from French (fixed values).
ENGLISH_WORDS = "the is are was were this that which allow allows could would may an of to in on for with from by before through via attacker remote vulnerability issue affected prior".split()
FRENCH_WORDS = "le la les des une un est sont été cette ce ces qui que dont permet permettre pourrait vulnérabilité faille attaquant distant avant par dans sur pour avec depuis affecté".split()
#: Risk words by severity (fixed values).
RISK_WORDS = {"critical": ["critique", "critical"], "high": ["élevé", "eleve", "élevée", "haut", "important", "high"], "medium": ["moyen", "moyenne", "modéré", "modere", "medium"], "low": ["faible", "bas", "low"]}


def advisory_ids(text: Column) -> Column:
    """Distinct GHSA ids, upper-cased, in order of first sight."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(?i)GHSA(?:-[0-9a-z]{4}){3}"), F.lit(0)), F.upper))


def is_cve_id(text: Column) -> Column:
    """Whether the whole text is a CVE id, with four digits or more."""
    return F.coalesce(text.rlike(r"^CVE-\d{4}-\d{4,}$"), F.lit(False))


def holds_any(text: Column, marks: list[str]) -> Column:
    """Whether a text holds any mark, in either case."""
    def held(low: Column) -> Column:
        found = F.lit(False)
        for x in marks:
            found |= low.contains(x.lower())
        return F.coalesce(found, F.lit(False))

    return once(F.lower(text), held)


def fold_accents(text: Column) -> Column:
    """Letters without their accents: composed Latin ones by what they are composed of, combining marks dropped."""
    pairs = [(chr(c), d[0]) for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)] if len(d := unicodedata.normalize("NFD", chr(c))) > 1 and all(unicodedata.category(x) == "Mn" for x in d[1:])]
    return F.regexp_replace(F.translate(text, "".join(a for a, _ in pairs), "".join(b for _, b in pairs)), r"\p{Mn}+", "")


def is_stop_word(token: Column, stop_words: list[str]) -> Column:
    """Whether all parts of a token are stop words without accents, numbers, or of at most two letters."""
    parts = F.filter(F.split(F.lower(token), "[-'’_]"), lambda x: x != "")
    return F.forall(parts, lambda x: fold_accents(x).isin(stop_words) | x.rlike(r"^\d+$") | (F.length(x) <= 2))


def looks_english(text: Column) -> Column:
    """At least 25 characters, and more English function words than French ones."""
    def count(words: list[str]) -> Column:
        return F.regexp_count(F.lower(text), F.lit(rf"(?U)\b(?:{'|'.join(words)})\b"))

    return F.coalesce((F.length(F.trim(text)) >= 25) & (count(ENGLISH_WORDS) > count(FRENCH_WORDS)), F.lit(False))


def last_sentence(text: Column, least: int = 40) -> Column:
    """The text up to its last finished sentence; whole if it ends with a mark; null if no sentence ends beyond least."""
    bare = F.trim(text)
    kept = F.regexp_extract(bare, r"(?s)^(.*\.)[ \n]", 1)
    return F.when(bare.rlike("[.!?»]$"), bare).when(F.length(kept) > least + 1, kept)


def french_list(items: Column) -> Column:
    """Items joined by commas, the last by et."""
    n = F.size(items)
    return F.when(n < 2, F.array_join(items, "")).otherwise(F.concat(F.array_join(F.slice(items, 1, F.greatest(n - 1, F.lit(1))), ", "), F.lit(" et "), F.element_at(items, -1)))


def bullets(text: Column) -> Column:
    """The parts of a text between semicolons, bullets, line ends and sentences, without last points and bare words of severity."""
    parts = F.transform(F.split(text, r"\s*[;•\n]\s*|\.\s+(?=[A-ZÀ-Ý])"), lambda x: F.regexp_replace(F.trim(x), r"\.+$", ""))
    return F.filter(parts, lambda x: (x != "") & ~F.lower(F.trim(x)).isin([w for words in RISK_WORDS.values() for w in words]))


def risk_severity(label: Column) -> Column:
    """The severity that a French or English word of risk means; null for any other."""
    low = F.lower(F.trim(label))
    found = F.lit(None).cast("string")
    for name, words in RISK_WORDS.items():
        found = F.when(low.isin(words), F.lit(name)).otherwise(found)
    return found


def bare_text(value: Column) -> Column:
    """A value without tags, which begin with a letter, slash or exclamation mark; entities of presentation decoded, those that can
    carry a payload kept; white space collapsed; null if nothing is left."""
    def character(x: Column) -> Column:
        code = F.when(F.lower(x).startswith("x"), F.conv(F.substring(x, 2, 9), 16, 10)).otherwise(x).try_cast("int")
        over = F.greatest(code - 0x10000, F.lit(0))
        pairs = F.when(code < 0x10000, F.lpad(F.hex(code), 4, "0")).otherwise(F.concat(F.hex(F.shiftright(over, 10) + 0xD800), F.hex(over % 1024 + 0xDC00)))
        return F.when(code.isNull() | code.isin(34, 38, 60, 62) | (code > 0x10FFFF), F.concat(F.lit("&#"), x, F.lit(";"))).when(code < 32, " ").otherwise(F.decode(F.unhex(pairs), "UTF-16BE"))

    def decoded(out: Column) -> Column:
        # numeric entities: what lies between two of them stays, each is read by itself
        spelled = F.regexp_extract_all(out, F.lit(r"&#(x?[0-9a-fA-F]+);"), F.lit(1))
        between = F.split(out, r"&#x?[0-9a-fA-F]+;", -1)
        joined = F.array_join(F.flatten(F.zip_with(between, F.concat(F.transform(spelled, character), F.array(F.lit(""))), lambda a, b: F.array(a, b))), "")
        return F.when(out.rlike(r"&#x?[0-9a-fA-F]+;"), joined).otherwise(out)

    def read(given: Column) -> Column:
        out = F.regexp_replace(given, r"<[a-zA-Z/!][^>]{0,80}>", " ")
        for entity, plain in (("&nbsp;", " "), ("&#39;", "'"), ("&apos;", "'")):
            out = F.replace(out, F.lit(entity), F.lit(plain))
        marked = F.contains(given, F.lit("<")) | F.contains(given, F.lit("&"))
        bare = F.trim(F.regexp_replace(F.when(marked, once(out, decoded)).otherwise(given), r"\s+", " "))
        return once(bare, lambda b: F.nullif(b, F.lit("")))

    return once(value, read)


def repeats_like_menu(text: Column, least: int = 8, share: float = 0.4) -> Column:
    """Whether a short text has at least so many words of over two letters, one of which is a share of all or more: sorted, then runs."""
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)[\w'-]+"), F.lit(0)), lambda w: F.length(w) > 2)
    start = F.struct(F.lit("").alias("word"), F.lit(0).alias("run"), F.lit(0).alias("most"))

    def step(s: Column, w: Column) -> Column:
        run = F.when(s["word"] == w, s["run"] + 1).otherwise(1)
        return F.struct(w.alias("word"), run.alias("run"), F.greatest(s["most"], run).alias("most"))

    runs = lambda w: (F.size(w) >= least) & (F.aggregate(F.array_sort(w), start, step)["most"] >= share * F.size(w))
    return F.coalesce(once(words, runs), F.lit(False))


def _spoiled(value: Column, bare: Column) -> Column:
    return holds_any(value, CODE_MARKS) | holds_any(bare, CODE_MARKS) | holds_any(bare, UNSHOWN_MARKS)


def _kept(value: Column, fit: Callable[[Column, Column], Column]) -> Column:
    """The bare text of a value if fit(value, bare text), else null; both are read once."""
    return once(value, lambda v: once(bare_text(v), lambda b: F.when(fit(v, b), b)))


def clean_description(value: Column) -> Column:
    """A usable description of 40 characters or more, or null: no code, no page that was not shown, no frame of a site if under 200."""
    return _kept(value, lambda v, b: (F.length(b) >= 40) & ~_spoiled(v, b) & ~((F.length(b) < 200) & holds_any(b, FRAME_MARKS)))


def clean_product(value: Column) -> Column:
    """A usable product or vendor of at most 160 characters, or null: no id, no code, no section's title."""
    return _kept(value, lambda v, b: (F.length(b) <= 160) & ~b.rlike(r"(?i)CVE-\d{4}-\d{4,}") & ~_spoiled(v, b) & ~b.rlike(SECTION_TITLE))


def clean_text(value: Column, least: int = 12) -> Column:
    """A usable short text of at least so many characters, or null: no code, no frame of a site, no menu."""
    return _kept(value, lambda v, b: (F.length(b) >= least) & ~_spoiled(v, b) & ~holds_any(b, FRAME_MARKS) & ~repeats_like_menu(b))


def unescaped(value: Column) -> Column:
    """A text with its basic entities decoded."""
    out = value
    for entity, character in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(character))
    return out


def text_lines(html: Column) -> Column:
    """The lines of HTML: ends of blocks end lines, tags go, basic entities are decoded, white space is collapsed, empty lines go."""
    broken = F.regexp_replace(F.regexp_replace(html, r"(?i)<(?:br|/p|/div|/li|/h[1-6]|/tr|/dt|/dd|/td|/th|/section|/article)[^>]*>", "\n"), "<[^>]+>", " ")
    for entity, character in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        broken = F.replace(broken, F.lit(entity), F.lit(character))
    return F.filter(F.transform(F.split(broken, "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")


def json_object(text: Column) -> Column:
    """The outermost braces of a fenced or chatty text if they hold valid JSON, else null."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(found).isNotNull(), found)
