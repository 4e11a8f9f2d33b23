"""Fields of an advisory's page by their labels, as columns: lines below a label, definition lists, tables and labels in the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from advisorium.functions import dates, text, urls
from advisorium.functions.columns import once

#: Labels of lines, in lower case, and the fields that they name (fixed values).
LINE_LABELS = {
    "title": ["titre", "objet", "title"],
    "advisory_id": ["refer", "référence", "reference", "numéro de référence", "numero de reference", "n° de référence", "n°de référence"],
    "published_at": ["date de publication", "publié le", "published"],
    "updated_at": ["date version", "dernière mise à jour", "mis à jour le"],
    "risk_level": ["niveau de risque", "niveau de gravité", "criticité", "risk level"],
    "impact": ["impact", "risque", "risques", "description du risque", "risk", "risk description"],
    "impact_level": ["niveau d'impact", "niveau d’impact", "impact level"],
    "platform": ["plateforme", "plate-forme"],
    "affected_block": ["systèmes affectés", "systemes affectes", "systèmes", "affected systems"],
    "product": ["produits impactés", "produits affectés", "produits concernés", "produit"],
    "fixed_version": ["versions corrigées", "version corrigée", "correctif"],
    "cve_block": ["identificants du problème", "identifiants du problème", "identificateurs externes", "identifiants externes", "external identifiers", "identifiants cve", "cve"],
    "description": ["bilan de la vulnérabilité", "bilan", "résumé de la vulnérabilité", "vulnerability summary"],
    "solution": ["solution vulnérabilités", "solution", "solutions", "recommandation", "recommandations"],
    "references_block": ["source d'information", "sources d'information", "références"],
}
#: Lines of a page's foot and frame, which end a value (fixed values).
FOOT = ["version", "adresse", "téléphone", "telephone", "email", "e-mail", "pied de page", "aller au contenu principal", "fil d'ariane", "select your language", "déclarer un incident", "l'ancs", "tuncert", "actualités", "accueil"]
#: Labels of lists, tables and running text by field, in order (fixed values).
FIELD_LABELS = {
    "published_at": ["date de publication", "publié le", "date de création", "créé le", "date", "published", "release date"],
    "updated_at": ["dernière mise à jour", "date de mise à jour", "mis à jour le", "modifié le", "updated", "last updated"],
    "product": ["produits affectés", "produits concernés", "produit", "logiciels affectés", "affected products", "product"],
    "vendor": ["éditeur", "editeur", "fournisseur", "constructeur", "vendor"],
    "impact": ["impact", "conséquences", "consequences"],
    "affected_versions": ["versions affectées", "versions concernées", "versions vulnérables", "affected versions"],
    "fixed_version": ["versions corrigées", "version corrigée", "correctifs", "correctif", "fixed version", "patched"],
    "platform": ["plateformes", "plateforme", "systèmes affectés", "systèmes", "platform", "os"],
    "solution": ["solutions", "solution", "recommandations", "recommandation", "mesures", "remédiation", "remediation"],
    "description": ["description", "résumé", "resume", "synthèse", "summary"],
    "title": ["titre", "objet", "title"],
}
#: Labels before a page's own ids, in order, hosts that are no reference, and hosts of known portals (fixed values).
ID_LABELS = ["identificateurs externes", "identifiants externes", "external identifiers", "identificants du problème", "identifiants du problème", "identifiant du problème", "identifiants cve", "références cve", "cve", "problem identifiers", "identifiers"]
SOCIAL = ["facebook.", "twitter.", "x.com", "linkedin.", "youtube.", "instagram.", "t.me", "whatsapp."]
PORTALS = ["ancs.tn", "tuncert.tn", "dgssi.gov.ma"]
#: An advisory's own number (fixed pattern).
NUMBER = r"(?i)\b(?:[A-Za-z]{2,8}CERT|CERT[-/]?[A-Za-z]{0,4})\s*/\s*Vuln\.?\s*\d{4}-\d+\b"


#: The fields of an advisory.
FIELDS = ["advisory_id", "title", "published_at", "updated_at", "risk_level", "severity", "impact", "platform", "affected_systems", "product", "affected_versions", "fixed_version", "solution", "description", "vendor", "cves", "references"]


def bare(html: Column) -> Column:
    """A piece of HTML as one line of text; null if nothing is left."""
    return once(F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]+>", " "), r"\s+", " ")), lambda x: F.nullif(x, F.lit("")))


def _key(line: Column) -> Column:
    """A line as a label: lower case, without white space and colons at its end."""
    low = F.lower(F.trim(line))
    return F.trim(F.when(F.contains(line, F.lit(":")), F.regexp_replace(low, ":+$", "")).otherwise(low))


def sections(lines: Column) -> Column:
    """Sections of a page's lines as (field, values): each label with the lines below it, up to the next label or line of the foot."""
    field = F.create_map(*[F.lit(x) for name, labels in LINE_LABELS.items() for label in labels for x in (label, name)])
    stops = [label for labels in LINE_LABELS.values() for label in labels] + FOOT
    numbered = F.transform(lines, lambda x, i: F.struct(i.alias("at"), _key(x).alias("key")))

    def between(ends: Column) -> Column:
        until = lambda i: F.coalesce(F.get(ends, i + 1)["at"], F.size(lines))
        return F.transform(ends, lambda x, i: F.struct(F.try_element_at(field, x["key"]).alias("field"), F.slice(lines, x["at"] + 2, F.greatest(until(i) - x["at"] - 1, F.lit(0))).alias("values")))

    # each label asks for the next one: the list of them is made once, not once a label
    found = once(F.filter(numbered, lambda x: x["key"].isin(stops)), between)
    return F.filter(found, lambda s: s["field"].isNotNull() & (F.size(s["values"]) > 0))


def values_of(found: Column, name: str) -> Column:
    """The lines of a field's first section that has any; null if there is none."""
    return F.get(F.filter(found, lambda s: s["field"] == name), F.lit(0))["values"]


def pairs(html: Column) -> Column:
    """(form, label, value) of definition lists and of table rows, labels in lower case without a colon, in order of sight.

    Patterns only read a page that holds the tag that they need.
    """
    def read(form: int, tag: str, pattern: str) -> Column:
        labels, values = F.regexp_extract_all(html, F.lit(pattern), F.lit(1)), F.regexp_extract_all(html, F.lit(pattern), F.lit(2))
        label = lambda a: F.trim(F.regexp_replace(F.lower(F.trim(F.regexp_replace(a, r"\s+", " "))), r"\s*:$", ""))
        found = F.zip_with(labels, values, lambda a, b: F.struct(F.lit(form).alias("form"), label(a).alias("label"), b.alias("value")))
        return F.when(~F.contains(F.lower(html), F.lit(tag)), F.array().cast("array<struct<form: int, label: string, value: string>>")).otherwise(found)

    return F.concat(read(0, "<dt", r"(?is)<dt[^>]*>([^<]*)</dt>\s*<dd[^>]*>(.*?)</dd>"), read(1, "<td", r"(?is)<t[hd][^>]*>([^<]*)</t[hd]>\s*<td[^>]*>(.*?)</td>"))


def inline(html: Column, label: str) -> Column:
    """What follows a label that ends a tag's content, else a label with a colon, up to the next break; at most 600 characters."""
    name = rf"(?iu)\Q{label}\E"
    after = bare(F.regexp_extract(html, rf"(?s){name}\s*:?\s*</[^>]+>\s*(.*?)(?:<br|</p>|</div>|</li>|<strong|<dt|<th|$)", 1))
    said = bare(F.regexp_extract(html, rf"(?s){name}\s*:\s*(.*?)(?:<br|</p>|</div>|</li>|\n|$)", 1))
    return F.left(F.coalesce(after, said), F.lit(600))


def folded(html: Column) -> Column:
    """A page in a case of its own: it holds every label, in lower case, that inline() finds in the page in any case, and a colon just after it."""
    low, others = F.lower(html), "ıſ\u0307"
    some = F.contains(low, F.lit(others[0])) | F.contains(low, F.lit(others[1])) | F.contains(low, F.lit(others[2]))
    return F.regexp_replace(F.replace(F.when(some, F.translate(low, others, "is")).otherwise(low), F.lit("</"), F.lit(":")), r"\s+:", ":")


def labelled(html: Column, low: Column, found: Column, labels: list[str]) -> Column:
    """The first value that is not empty: label by label, of each the definition list, then the table, then the text; low is folded(html), found pairs(html).

    Pairs are only searched, and patterns only read a page, where they hold the label.
    """
    def first(label: str, form: int) -> Column:
        return bare(F.get(F.filter(found, lambda p: (p["form"] == form) & (p["label"] == label)), F.lit(0))["value"])

    def value(label: str) -> tuple[Column, Column]:
        return F.when(F.array_contains(found["label"], label), F.coalesce(first(label, 0), first(label, 1))), F.when(F.contains(low, F.lit(f"{label}:")), inline(html, label))

    return F.coalesce(*[x for label in labels for x in value(label)])


def title(html: Column) -> Column:
    """A page's title up to the first upright bar; null if that is empty."""
    whole = text.unescaped(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    return F.nullif(F.trim(F.substring_index(F.regexp_replace(whole, r"\s+", " "), "|", 1)), F.lit(""))


def paragraph(lines: Column) -> Column:
    """The description among lines: of the four before the first label of reference the nearest over 40 characters, else the first line over 60."""
    fit = lambda x, n: (F.length(x) > n) & ~_key(x).isin(FOOT)

    def near(at: Column) -> Column:
        before = F.reverse(F.slice(lines, F.greatest(at - 4, F.lit(1)).cast("int"), F.least(at - 1, F.lit(4)).cast("int")))
        return F.when(at > 1, F.get(F.filter(before, lambda x: fit(x, 40)), F.lit(0)))

    places = lambda keys: F.array_min(F.filter(F.array(*[F.nullif(F.array_position(keys, x), F.lit(0).cast("long")) for x in ("refer", "référence", "reference")]), lambda x: x.isNotNull()))
    said = once(once(F.transform(lines, _key), places), near)
    return F.coalesce(said, F.get(F.filter(lines, lambda x: fit(x, 60) & ~x.startswith("http")), F.lit(0)))


def page_ids(html: Column) -> Column:
    """CVE ids within 1500 characters of the first label of ids that has any, else those of the whole page."""
    def of(low: Column) -> Column:
        # a label's place is only counted where it is held, and a text after one is only read while no other had ids
        places = F.filter(F.array(*[F.when(F.contains(low, F.lit(label)), F.instr(low, label)) for label in ID_LABELS]), lambda at: at.isNotNull())
        near = lambda found, at: F.when(F.size(found) > 0, found).otherwise(text.cve_ids(F.substring(html, at, F.lit(1500))))
        return F.aggregate(places, F.array().cast("array<string>"), near, lambda found: F.when(F.size(found) > 0, found).otherwise(text.cve_ids(html)))

    return once(F.lower(html), of)


def is_portal(html: Column, host: Column) -> Column:
    """Whether a listing is one of advisories: a known host, or numbers of advisories and no CVE id."""
    numbers = F.coalesce(html.rlike(NUMBER), F.lit(False)) & ~F.coalesce(html.rlike(r"(?i)CVE-\d{4}-\d{4,}"), F.lit(False))
    return urls.under_any(F.regexp_replace(F.lower(host), r"^\.+", ""), PORTALS) | numbers


def advisories(pages: DataFrame, now: Column) -> DataFrame:
    """pages (html, url, more) with the fields of an advisory's page: those of FIELDS.

    Lines below labels come first; what they leave open is looked for in lists, tables and text. Times are without zone; those that can't be
    read are null. A null page has null fields and empty lists. Columns of the pages' own are kept, but for those called like a field.
    """
    none = F.array().cast("array<string>")
    # each step is read several times by the next, so each is a projection of its own
    own = pages.select(F.struct("*").alias("a_doc"), "url", F.coalesce("html", F.lit("")).alias("a_page"))
    own = own.withColumns({"a_lines": text.text_lines(F.col("a_page")), "a_pairs": pairs(F.col("a_page")), "a_low": folded(F.col("a_page")), "a_heading": title(F.col("a_page")), "a_host": F.coalesce(urls.host(F.col("url")), F.lit(""))})
    own = own.withColumn("a_found", sections(F.col("a_lines")))
    own = own.withColumns({f"a_{name}": values_of(F.col("a_found"), name) for name in LINE_LABELS})
    lines_of = lambda name: F.col(f"a_{name}")
    joined = lambda name, by=" ": F.nullif(F.trim(F.array_join(lines_of(name), by)), F.lit(""))
    first = lambda name: F.nullif(F.trim(F.get(lines_of(name), F.lit(0))), F.lit(""))
    page = F.col("a_page")
    or_label = lambda value, name: F.coalesce(value, labelled(page, F.col("a_low"), F.col("a_pairs"), FIELD_LABELS[name]))
    own_number = F.when(F.contains(F.col("a_low"), F.lit("cert")) & F.contains(F.col("a_low"), F.lit("vuln")), F.regexp_extract(page, NUMBER, 0))
    number = F.coalesce(F.nullif(own_number, F.lit("")), F.nullif(F.regexp_extract("url", NUMBER, 0), F.lit("")))
    meta = text.unescaped(F.regexp_extract(page, r"""(?i)<meta[^>]+(?:name|property)=["'](?:description|og:description)["'][^>]+content=["']([^"']+)["']""", 1))
    block = F.coalesce(lines_of("affected_block"), none)
    cited = text.cve_ids(F.array_join(F.coalesce(lines_of("cve_block"), none), " "))
    named = F.flatten(F.transform(F.coalesce(lines_of("references_block"), none), lambda x: F.regexp_extract_all(x, F.lit(r"""https?://[^\s"'<>]+"""), F.lit(0))))

    def outside(x: Column) -> Column:
        def foreign(name: Column) -> Column:
            social = F.lit(False)
            for s in SOCIAL:
                social |= name.contains(s)
            return (name != F.col("a_host")) & ~social

        return x.startswith("http") & once(F.coalesce(urls.host(x), F.lit("")), foreign)

    linked = F.filter(F.regexp_extract_all(page, F.lit(r"""(?i)href=["']([^"']+)["']"""), F.lit(1)), outside)
    told = {
        "advisory_id": F.coalesce(first("advisory_id"), F.regexp_replace(number, r"\s+", "")), "title": or_label(F.coalesce(first("title"), F.col("a_heading")), "title"),
        "a_published_text": F.array(first("published_at"), labelled(page, F.col("a_low"), F.col("a_pairs"), FIELD_LABELS["published_at"])),
        "a_updated_text": F.array(first("updated_at"), labelled(page, F.col("a_low"), F.col("a_pairs"), FIELD_LABELS["updated_at"])),
        "a_risk": joined("risk_level"), "a_impact_text": or_label(joined("impact", " ; "), "impact"), "a_platform_text": or_label(F.coalesce(joined("platform"), F.get(block, F.lit(0))), "platform"),
        "a_product_text": or_label(F.coalesce(F.col("a_heading"), joined("product")), "product"), "affected_versions": or_label(F.coalesce(joined("product"), F.nullif(F.array_join(block, " ; "), F.lit(""))), "affected_versions"),
        "a_fix": or_label(joined("fixed_version"), "fixed_version"), "a_solution_text": or_label(joined("solution"), "solution"),
        "a_description_text": or_label(F.coalesce(joined("description"), paragraph(F.col("a_lines")), F.nullif(F.trim(meta), F.lit(""))), "description"),
        "vendor": labelled(page, F.col("a_low"), F.col("a_pairs"), FIELD_LABELS["vendor"]), "cves": F.when(F.size(cited) > 0, cited).otherwise(page_ids(page)), "references": F.slice(F.array_distinct(F.concat(named, linked)), 1, 12), "affected_systems": block,
    }
    moment = lambda c: F.get(F.filter(F.transform(c, lambda x: dates.parsed_time(x, now)), lambda x: x.isNotNull()), F.lit(0))
    out = own.withColumns(told).withColumns({"a_published": moment("a_published_text"), "a_updated": moment("a_updated_text")})
    kept = [F.col("a_doc").getField(c).alias(c) for c in pages.columns if c not in FIELDS]
    renamed = {"published_at": "a_published", "updated_at": "a_updated", "risk_level": "a_risk", "impact": "a_impact_text", "platform": "a_platform_text", "product": "a_product_text", "fixed_version": "a_fix", "solution": "a_solution_text", "description": "a_description_text"}
    fields = {name: text.risk_severity(F.col("a_risk")) if name == "severity" else F.col(renamed.get(name, name)) for name in FIELDS}
    return out.select(*kept, *[c.alias(name) for name, c in fields.items()])
