"""Hosts, sites and pages of urls as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Second-level suffixes under which a site's own label is the third (fixed values).
COMPOUND = ["co.uk", "gouv.fr", "gov.uk", "com.au", "co.jp", "ac.uk", "com.br"]


def host(url: Column) -> Column:
    """Lower-case host without user, port and dots at its ends; null if there is none."""
    found = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    return F.nullif(F.regexp_replace(found, r"^\.+|\.+$", ""), F.lit(""))


def registrable(name: Column) -> Column:
    """The last two labels of a host, or three under a compound suffix."""
    two = F.substring_index(name, ".", -2)
    return F.when(two.isin(COMPOUND), F.substring_index(name, ".", -3)).otherwise(two)


def same_site(a: Column, b: Column) -> Column:
    """Equal hosts but for www, or one under the other."""
    x, y = F.regexp_replace(a, r"^www\.", ""), F.regexp_replace(b, r"^www\.", "")
    return (x == y) | F.endswith(x, F.concat(F.lit("."), y)) | F.endswith(y, F.concat(F.lit("."), x))


def page_key(url: Column) -> Column:
    """What makes two urls the same page: host without www, path without a last slash in lower case, query."""
    path = F.lower(F.regexp_replace(F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1), "/+$", ""))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return F.concat_ws("|", F.regexp_replace(host(url), r"^www\.", ""), path, query)


def links(html: Column) -> Column:
    """Distinct targets of links, in order of sight."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r'<a\s[^>]*href="([^"]*)"'), F.lit(1)))


#: Hosts that serve a page's frame, hosts of communities, and labels that name no organisation (fixed values).
FRAME_HOSTS = ["fonts.googleapis.com", "fonts.gstatic.com", "gmpg.org", "w3.org", "schema.org", "gravatar.com", "googletagmanager.com", "google-analytics.com", "doubleclick.net", "aliexpress.com", "amazon-adsystem.com", "cdn.jsdelivr.net", "cdnjs.cloudflare.com", "unpkg.com", "bootstrapcdn.com", "polyfill.io", "govdelivery.com", "list-manage.com", "mailchi.mp"]
COMMUNITY_HOSTS = ["reddit.com", "twitter.com", "x.com", "facebook.com", "linkedin.com", "t.me", "mastodon.social", "bsky.app", "instagram.com", "youtube.com"]
GENERIC_LABELS = ["gov", "gouv", "com", "org", "net", "edu", "ac", "co", "go", "gob", "mil", "int", "info", "biz", "www"]
#: Domains under which only governments register (fixed values).
GOVERNMENTS = ["gov", "gouv.fr", "gov.uk", "gc.ca", "govt.nz", "gov.ma", "gov.sg", "gov.au", "gov.in", "gov.br", "gov.za", "gov.it", "gob.es", "gov.pl", "gov.tn", "go.jp", "go.kr", "gov.tr", "gov.pt", "gv.at", "admin.ch", "bund.de", "europa.eu"]
#: Paths of sharing, feeds, themes and tags, and of single discussions (fixed patterns).
FRAME_PATH = r"(?i)/(submit|share|sharer|intent/tweet|shareArticle|feed|rss|wp-json|wp-content|wp-includes|xmlrpc\.php|tag|category|author)(/|$)"
DISCUSSION_PATH = r"(?i)/(comments|status|posts?|threads?)/"


def under_any(name: Column, domains: list[str]) -> Column:
    """Whether a host is one of the domains or lies under one."""
    return F.coalesce(name.rlike(rf"(^|\.)({'|'.join(x.replace('.', chr(92) + '.') for x in domains)})$"), F.lit(False))


def decorative(url: Column) -> Column:
    """Whether a url belongs to a page's frame and documents nothing: frames' hosts and paths, communities but for single discussions, home pages, anything but http."""
    name, path = host(url), F.regexp_extract(url, r"^[a-z]+://[^/?#]*([^?#]*)", 1)
    home = F.coalesce((F.regexp_replace(path, "/", "") == "") & ~url.rlike(r"\?."), F.lit(True))
    http = F.coalesce(url.rlike("^https?://"), F.lit(False)) & name.isNotNull()
    return F.when(~http | under_any(name, FRAME_HOSTS), True).when(under_any(name, COMMUNITY_HOSTS), ~path.rlike(DISCUSSION_PATH)).otherwise(home | path.rlike(FRAME_PATH))


def organisation(name: Column) -> Column:
    """The label that names the organisation of a host: from the right, the first that is not generic; the last label never counts."""
    labels = F.reverse(F.split(name, r"\."))
    own = F.filter(F.slice(labels, 2, F.greatest(F.size(labels), F.lit(1))), lambda x: (x != "") & ~x.isin(GENERIC_LABELS))
    return F.coalesce(F.get(own, F.lit(0)), name)


def cites_other_id(url: Column, cve_id: Column) -> Column:
    """Whether a url names CVE ids and cve_id isn't among them."""
    cited = F.transform(F.regexp_extract_all(url, F.lit(r"(?i)CVE-\d{4}-\d{4,}"), F.lit(0)), F.upper)
    return F.coalesce((F.size(cited) > 0) & ~F.array_contains(cited, F.upper(cve_id)), F.lit(False))


def pdf_links(html: Column, most: int = 5) -> Column:
    """The first distinct link targets that are PDF files."""
    return F.slice(F.array_distinct(F.regexp_extract_all(html, F.lit(r"""(?i)href=["']([^"']+\.pdf(?:\?[^"']*)?)["']"""), F.lit(1))), 1, most)


def first_without(urls: Column, words: list[str]) -> Column:
    """The first http url of a list that holds none of the words, in either case."""
    own = F.filter(urls, lambda u: F.lower(u).startswith("http") & ~F.lower(u).rlike("|".join(x.replace(".", r"\.") for x in words)))
    return F.get(own, F.lit(0))


def source_key(url: Column) -> Column:
    """A url by which equal sources are found: trimmed, lower case, without last slashes."""
    return F.regexp_replace(F.lower(F.trim(url)), "/+$", "")


def publication_key(url: Column, title: Column) -> Column:
    """A publication's url in lower case without last slashes, else its title as a slug of at most 120 characters."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.coalesce(F.nullif(source_key(url), F.lit("")), F.left(slug, F.lit(120)))


def reputation(name: Column, trusted: list[str], banned: list[str]) -> Column:
    """blacklisted if a host is or lies under a banned domain, else whitelisted under a trusted or a government's one, else unknown."""
    return F.when(under_any(name, banned) if banned else F.lit(False), "blacklisted").when(under_any(name, [*trusted, *GOVERNMENTS]), "whitelisted").otherwise("unknown")
