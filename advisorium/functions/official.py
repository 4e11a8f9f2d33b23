"""Which page speaks for a product's vendor: names in hosts, scores of references, official source and site, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from advisorium.functions import text, urls

#: Words of companies' names that tell nothing, names of collections that are no vendor, and platforms (fixed values).
GENERIC_WORDS = ["networks", "systems", "software", "technologies", "technology", "group", "corporation", "corp", "inc", "ltd", "labs", "security", "solutions", "international", "company", "project", "foundation", "team", "open", "source", "server", "cloud", "data", "digital", "global", "enterprise"]
NO_VENDORS = ["nvd", "nist", "cve", "cwe", "mitre", "cisa", "cert", "vuln", "vulndb", "opencve", "tenable", "vulners", "packetstorm", "exploit", "advisory", "advisories", "bulletin", "detail", "record", "database"]
PLATFORMS = ["linux", "windows", "macos", "mac", "unix", "android", "ios", "ipados", "solaris", "freebsd", "openbsd", "netbsd", "aix", "debian", "ubuntu", "multiple", "divers", "tous", "all"]
#: Vendors by their products (fixed values).
MAKERS = {
    "chrome": "google", "chromium": "google", "android": "google", "chromeos": "google", "firefox": "mozilla", "thunderbird": "mozilla", "edge": "microsoft", "windows": "microsoft", "office": "microsoft", "sharepoint": "microsoft",
    "exchange": "microsoft", "outlook": "microsoft", "azure": "microsoft", "teams": "microsoft", "iis": "microsoft", "safari": "apple", "macos": "apple", "ios": "apple", "ipados": "apple", "fortios": "fortinet", "fortiweb": "fortinet",
    "fortimanager": "fortinet", "ios-xe": "cisco", "nx-os": "cisco", "asa": "cisco", "pan-os": "paloalto", "tomcat": "apache", "httpd": "apache", "log4j": "apache", "openshift": "redhat", "rhel": "redhat", "jboss": "redhat",
    "vcenter": "vmware", "esxi": "vmware", "vsphere": "vmware", "zimbra": "zimbra", "gitlab": "gitlab", "jenkins": "jenkins",
}
#: Hosts of code, scores of authorities, paths of advisories, and trackers of issues (fixed values and patterns).
CODE_HOSTS = ["github.com", "gitlab.com", "bitbucket.org", "sourceforge.net"]
AUTHORITIES = {"nvd.nist.gov": 50, "cve.org": 45, "cisa.gov": 42, "cert.ssi.gouv.fr": 40, "kb.cert.org": 38, "cert.europa.eu": 36}
ADVISORY_PATH = r"(?i)/(security|advisor|advisories|bulletin|release|download|patch|errata|kb|support|update|vuln|announce)"
TRACKER_HOST, TRACKER_PATH = r"(?i)^(jira|bugs?|bugzilla|tracker)\.", r"(?i)(/browse/|/issues?/|/ticket/|/bug/)"
#: From this score on a page belongs to the vendor (fixed value).
OWNED = 90


def vendor_slugs(vendor: Column, products: Column) -> Column:
    """Names by which a vendor may stand in a host: whole, with hyphens, its telling words, and the maker behind a product.

    Of the first three products the first word that is no platform counts; one that holds a CVE id is none. Names under three letters are
    left out; nulls count as empty.
    """
    none = F.array().cast("array<string>")
    first_word = lambda p: F.get(F.filter(F.split(F.trim(p), r"\s+"), lambda w: ~F.regexp_replace(F.lower(w), "[^a-z0-9]+", "").isin(PLATFORMS)), F.lit(0))
    told = F.filter(F.slice(F.coalesce(products, none), 1, 3), lambda p: (p != "") & ~p.rlike(r"(?i)CVE-\d{4}-\d{4,}"))
    names = F.filter(F.transform(F.concat(F.array(vendor), F.transform(told, first_word)), lambda n: F.trim(F.regexp_replace(F.lower(n), "[^a-z0-9 ]+", ""))), lambda n: F.length(n) >= 3)
    makers = F.create_map(*[F.lit(x) for pair in MAKERS.items() for x in pair])

    def forms(n: Column) -> Column:
        words = F.filter(F.split(n, " +"), lambda w: w != "")
        whole = F.replace(n, F.lit(" "), F.lit(""))
        own = F.when(F.size(words) > 1, F.filter(words, lambda w: (F.length(w) >= 4) & ~w.isin(GENERIC_WORDS))).otherwise(none)
        made = F.filter(F.transform(F.concat(F.array(whole), words), lambda w: F.try_element_at(makers, w)), lambda m: m.isNotNull())
        return F.concat(F.array(whole, F.replace(n, F.lit(" "), F.lit("-"))), own, F.slice(made, 1, 1))

    return F.array_distinct(F.filter(F.flatten(F.transform(names, forms)), lambda s: (s != "") & ~s.isin(NO_VENDORS)))


def reference_score(url: Column, slugs: Column) -> Column:
    """How well a url serves as official source: the vendor's host 100, its space on a host of code 90, authorities 36 to 50, else 0; advisories gain 6, trackers lose 20."""
    host, path = urls.host(url), F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1))
    bonus = F.when(path.rlike(ADVISORY_PATH), 6).otherwise(0) - F.when(host.rlike(TRACKER_HOST) | path.rlike(TRACKER_PATH), 20).otherwise(0)
    owned = F.exists(slugs, lambda s: F.rlike(host, F.concat(F.lit("(^|[.-])"), s, F.lit("([.-]|$)"))))
    owner = F.regexp_extract(path, "^/*([^/]+)", 1)
    authority = F.lit(None).cast("int")
    for name, score in reversed(AUTHORITIES.items()):
        authority = F.when(urls.under_any(host, [name]), score).otherwise(authority)
    found = F.when(owned, 100 + bonus).when(urls.under_any(host, CODE_HOSTS), F.when((owner != "") & F.array_contains(slugs, owner), 90 + bonus).otherwise(0)).otherwise(authority + bonus)
    return F.coalesce(found, F.lit(0))


def official_reference(references: Column, slugs: Column, cve_id: Column) -> Column:
    """The reference of the highest score above 0, the first of several; those that name other CVE ids only never count."""
    def scored(r: Column, i: Column) -> Column:
        cited = text.cve_ids(r)
        foreign = F.coalesce((F.size(cited) > 0) & ~F.array_contains(cited, F.upper(cve_id)), F.lit(False))
        return F.struct(F.when(r.rlike("^https?://") & ~foreign, reference_score(F.trim(r), slugs)).otherwise(0).alias("score"), (-i).alias("place"), F.trim(r).alias("url"))

    best = F.array_max(F.filter(F.transform(F.coalesce(references, F.array().cast("array<string>")), scored), lambda x: x["score"] > 0))
    return best["url"]


def official_source(references: Column, slugs: Column, cve_id: Column, collected: Column) -> Column:
    """The official source of a vulnerability: its best reference, else its own record at the id's authority; null without either.

    The page that it was collected from never counts, unless it is the vendor's own.
    """
    own = F.coalesce(reference_score(collected, slugs) >= OWNED, F.lit(False))
    others = F.filter(references, lambda r: own | collected.isNull() | ~F.coalesce(urls.page_key(r) == urls.page_key(collected), F.lit(False)))
    record = F.when(cve_id != "", F.concat(F.lit("https://www.cve.org/CVERecord?id="), cve_id))
    return F.coalesce(official_reference(others, slugs, cve_id), record)


def vendor_site(vendor: Column) -> Column:
    """The site of a vendor that is called by its domain; null for any other."""
    low = F.regexp_replace(F.lower(F.trim(vendor)), "/+$", "")
    name = F.when(low.rlike("^https?://"), urls.host(low)).otherwise(low)
    return F.when(name.rlike(r"^[a-z0-9][a-z0-9.-]*\.[a-z]{2,24}$"), F.concat(F.lit("https://"), name, F.lit("/")))


def official_site(references: Column, slugs: Column, vendor: Column) -> Column:
    """The vendor's own page among references, advisories first, else its site if it is called by its domain; null if nothing is sure."""
    http = F.filter(F.transform(F.coalesce(references, F.array().cast("array<string>")), F.trim), lambda r: r.rlike("^https?://"))
    owned = F.filter(http, lambda r: reference_score(r, slugs) >= OWNED)
    path = lambda r: F.regexp_extract(r, r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.get(F.filter(owned, lambda r: path(r).rlike(ADVISORY_PATH)), F.lit(0)), F.get(owned, F.lit(0)), vendor_site(vendor))
