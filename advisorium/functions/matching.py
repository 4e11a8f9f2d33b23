"""What a record says of products and vendors, and what is safe to show of foreign texts, as columns."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from advisorium.functions import text

#: Vendors as they are shown, and entries that name none (fixed values).
VENDOR_NAMES = {
    "microsoft": "Microsoft", "mozilla": "Mozilla", "red hat": "Red Hat", "redhat": "Red Hat", "ibm": "IBM", "php": "PHP", "f5": "F5", "vmware": "VMware", "gitlab": "GitLab", "node.js": "Node.js",
    "nodejs": "Node.js", "wordpress": "WordPress", "cisco": "Cisco", "adobe": "Adobe", "oracle": "Oracle", "google": "Google", "linux": "Linux", "apache software foundation": "Apache", "apache": "Apache",
    "php group": "PHP", "the php group": "PHP", "fortinet": "Fortinet", "sap": "SAP", "atlassian": "Atlassian",
}
NO_VENDOR = ["", "n/a", "na", "none", "null", "unknown", "inconnu", "autres", "other", "-"]
#: Risks by weakness (fixed values).
WEAKNESS_RISKS = {
    "CWE-79": "Injection de scripts (XSS)", "CWE-89": "Injection SQL", "CWE-352": "Falsification de requête (CSRF)", "CWE-918": "Falsification de requêtes côté serveur (SSRF)",
    "CWE-22": "Traversée de répertoire", "CWE-787": "Écriture hors limites (corruption mémoire)", "CWE-125": "Lecture hors limites", "CWE-862": "Contournement d'autorisation",
    "CWE-287": "Contournement d'authentification", "CWE-269": "Élévation de privilèges", "CWE-400": "Déni de service (épuisement de ressources)", "CWE-502": "Désérialisation non sécurisée",
    "CWE-94": "Injection de code",
}
#: Risks by phrases of a text, and by words that must stand alone, in order (fixed values).
TEXT_RISKS = {
    "Exécution de code arbitraire à distance": (["remote code execution", "arbitrary code", "code arbitraire", "exécution de code"], ["rce"]),
    "Déni de service": (["denial of service", "déni de service"], ["dos"]),
    "Divulgation d'informations sensibles": (["information disclosure", "sensitive information", "sensitive data", "data exposure", "divulgation", "fuite d"], []),
    "Élévation de privilèges": (["privilege escalation", "elevation of privilege", "escalade de privil", "élévation de privil"], []),
    "Injection de scripts (XSS)": (["cross-site scripting"], ["xss"]),
    "Injection SQL": (["sql injection", "injection sql"], []),
    "Falsification de requêtes côté serveur (SSRF)": (["server-side request forgery"], ["ssrf"]),
    "Contournement de la politique de sécurité": (["authentication bypass", "security bypass", "contournement"], []),
    "Usurpation d'identité": (["spoofing", "usurpation"], []),
    "Corruption de mémoire": (["buffer overflow", "out-of-bounds", "dépassement de tampon", "hors limites"], []),
}
#: Words before which a product's name ends in a line of affected systems (fixed pattern).
VERSION_WORDS = r"\b(versions?|versoions?|all\s+versions|ant[ée]rieures?|avant|before|prior\s+to|jusqu|[àa]\s+la\s+version)\b|[<>]"

#: Words that mean one's own collection, that ask what something is, and that name its subjects (fixed patterns).
OWN_WORDS = r"en base|dans la base|de la base|base de connaissances|database|collect[ée]|notre catalogue|catalogue (?:de |des )?(?:cve|vuln)|aujourd|\bhier\b|cette semaine|derni[èe]re semaine|derniers? jours|ce mois|cette ann[ée]e|\bliste[rz]?\b|affiche|combien|nos sources|mes sources|nos (?:cve|vuln)|mes (?:cve|vuln)"
DEFINITION_WORDS = r"qu.est.ce que|qu.est.ce qu|c.est quoi|que signifie|d[ée]finition|diff[ée]rence entre|[àa] quoi sert|what\s+is\s|what.s the difference"
SUBJECT_WORDS = r"\bcve\b|vuln[ée]rabilit|bulletin|\b[ée]diteur\b"


def auto_aliases(name: Column, vendor: Column) -> Column:
    """Aliases of a product that has none of its own, lower case: broad (name, vendor and name, vendor alone) and strict (without the vendor alone)."""
    n, v = F.lower(F.trim(F.coalesce(name, F.lit("")))), F.lower(F.trim(F.coalesce(vendor, F.lit(""))))
    full = F.when(~F.contains(n, v), F.concat(v, F.lit(" "), n))
    said = lambda *parts: F.array_distinct(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")))
    return F.struct(said(n, full, v).alias("broad"), said(n, full).alias("strict"))


def structured_text(vendor: Column, product: Column, affected: Column, systems: Column) -> Column:
    """What a record's own fields say of its product, lower case, joined by semicolons; systems only if nothing else is stated.

    Products lose what stands in parentheses, as that names where they run; null fields and lists count as empty.
    """
    none = F.array().cast("array<string>")
    heads = lambda c: F.transform(F.coalesce(c, none), text.strip_qualifier)
    bare = text.strip_qualifier(product)
    both = F.when((vendor != "") & (product != ""), F.concat(vendor, F.lit(" "), bare))
    said = lambda c: F.filter(c, lambda x: x.isNotNull() & (x != ""))
    own = said(F.concat(F.array(vendor, bare), heads(affected), F.array(both)))
    return F.lower(F.array_join(F.when(F.size(own) > 0, own).otherwise(said(heads(systems))), " ; "))


def vendor_name(vendor: Column) -> Column:
    """A vendor as it is shown: known spellings, else with a capital first unless it is upper case or has several words; null if it names none."""
    bare = F.trim(vendor)
    low = F.lower(bare)
    known = F.try_element_at(F.create_map(*[F.lit(x) for pair in VENDOR_NAMES.items() for x in pair]), low)
    own = F.when((bare == F.upper(bare)) & (bare != low) | bare.contains(" "), bare).otherwise(F.concat(F.upper(F.left(bare, F.lit(1))), F.substring(bare, 2, 1 << 30)))
    return F.when(~low.isin(NO_VENDOR), F.coalesce(known, own))


#: Vendors in titles that are shown in another spelling than with capitals first (fixed values).
TITLE_NAMES = {
    "redhat": "Red Hat", "red hat": "Red Hat", "ibm": "IBM", "sap": "SAP", "php": "PHP", "f5": "F5", "vmware": "VMware", "nodejs": "Node.js", "node.js": "Node.js", "gitlab": "GitLab", "jetbrains": "JetBrains", "openssl": "OpenSSL",
    "bind": "BIND", "xen": "Xen", "palo alto": "Palo Alto Networks", "sonicwall": "SonicWall", "moveit": "MOVEit",
}


def title_name(vendor: Column) -> Column:
    """A vendor, in lower case, as a title's vendor is shown."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in TITLE_NAMES.items() for x in pair]), vendor), F.initcap(vendor))


def named_product(title: Column) -> Column:
    """The capitalised word after product or produit in a title; null if there is none."""
    return F.nullif(F.regexp_extract(title, r"(?:produits?|products?)\s+([A-Z][\w.-]+)", 1), F.lit(""))


def products_of_lines(lines: Column, most: int = 15) -> Column:
    """Names before the versions in lines of affected systems: words repeated at once count once, names once in either case, two characters or more."""

    def named(line: Column) -> Column:
        words = F.split(F.btrim(F.regexp_replace(line, rf"(?isU)(?:{VERSION_WORDS}).*$", ""), F.lit(" -–:·,;")), r"\s+")
        return F.array_join(F.filter(words, lambda w, i: F.coalesce(F.lower(F.get(words, i - 1)) != F.lower(w), F.lit(True))), " ")

    names = F.filter(F.transform(lines, named), lambda x: F.length(x) >= 2)
    low = F.transform(names, F.lower)
    return F.slice(F.filter(names, lambda x, i: F.array_position(low, F.lower(x)) == i + 1), 1, most)


def risks(said: Column, weakness: Column, most: int = 8) -> Column:
    """Distinct risks that a record states: first by the weaknesses it names, then by phrases and words of its text, in their order.

    A pattern is only tried for a word that the text holds, as it costs far more than looking for that.
    """
    named = F.transform(F.regexp_extract_all(F.upper(F.coalesce(weakness, F.lit(""))), F.lit(r"CWE-\d+"), F.lit(0)), lambda w: F.try_element_at(F.create_map(*[F.lit(x) for pair in WEAKNESS_RISKS.items() for x in pair]), w))
    low = F.lower(F.concat_ws(" ", said, weakness))
    says = lambda phrases, words: reduce(or_, [low.contains(x) for x in phrases] + [low.contains(x) & low.rlike(rf"(?U)\b{x}\b") for x in words])
    read = F.array(*[F.when(says(*told), F.lit(label)) for label, told in TEXT_RISKS.items()])
    return F.slice(F.array_distinct(F.filter(F.concat(named, read), lambda x: x.isNotNull())), 1, most)


def neutral(value: Column, most: int = 4000) -> Column:
    """A foreign text that can't pass for instructions: no control characters, no marks of roles or turns, no order to drop rules; capped.

    Null gives the empty string.
    """
    out = F.regexp_replace(F.coalesce(value, F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", " ")
    out = F.regexp_replace(out, r"<\|[^|<>]{0,40}\|>|\[/?INST\]|</?(?:system|assistant|user)>", " ")
    out = F.regexp_replace(out, r"(?im)^\s*(?:system|assistant|user)\s*:", "[role]")
    out = F.regexp_replace(out, r"(?i)\b(?:ignore|forget|disregard)\s+(?:all\s+)?(?:previous|prior|above)\s+(?:instructions|rules)", "[removed]")
    return F.left(F.trim(F.regexp_replace(out, r"\s+", " ")), F.lit(most))


def centred(value: Column, word: Column, budget: int = 6000) -> Column:
    """A text within a budget of characters: whole if it fits; else its first quarter of the budget and what stands around a word,
    a third of the rest before it; only the beginning if the word is absent, null, or in that quarter."""
    head = budget // 4
    room = budget - head
    at = F.instr(F.lower(value), F.lower(word)) - 1
    start = F.greatest(F.lit(head), at - room // 3)
    around = F.concat(F.left(value, F.lit(head)), F.lit(" […] "), F.substr(value, start + 1, F.lit(room)))
    return F.when(F.length(value) <= budget, value).when(at >= head, around).otherwise(F.left(value, F.lit(budget)))


def file_name(title: Column, most: int = 80) -> Column:
    """A title as a name of a file: without accents, runs of other characters than letters, digits, points and hyphens as one underscore,
    none of these at the ends; document if nothing is left."""
    bare = F.regexp_replace(text.fold_accents(title), r"[^A-Za-z0-9.-]+", "_")
    return F.coalesce(F.nullif(F.btrim(F.left(F.btrim(bare, F.lit("._-")), F.lit(most)), F.lit("._-")), F.lit("")), F.lit("document"))


def advisory_id(value: Column, prefix: str = "CERT") -> Column:
    """The first id like PREFIX-2024-AVI-0001 of a text, upper case, white space within it removed; null if there is none."""
    found = F.regexp_extract(value, rf"(?i)\b{prefix}[A-Z]*\s*-\s*\d{{4}}\s*-\s*[A-Z]{{2,4}}\s*-\s*\d{{3,5}}", 0)
    return F.nullif(F.upper(F.regexp_replace(found, r"\s+", "")), F.lit(""))


def question_scope(question: Column, ids: Column, vendor: Column, filtered: Column) -> Column:
    """internal, external or auto: whether a question asks for the collection, for common knowledge, or for either.

    ids, vendor: what it names, null or empty if nothing; filtered: whether it holds criteria of records. A definition without
    a target is external, even with filters; null questions are auto.
    """
    says = lambda words: F.coalesce(question.rlike(f"(?iU){words}"), F.lit(False))
    named, owned = F.coalesce(F.size(ids) > 0, F.lit(False)), F.coalesce(vendor != "", F.lit(False))
    own, definition = says(OWN_WORDS), says(DEFINITION_WORDS)
    direct = named | F.coalesce(filtered, F.lit(False)) | own
    return F.when(definition & ~named & ~owned & ~own, "external").when(direct | owned | says(SUBJECT_WORDS), "internal").otherwise("auto")
