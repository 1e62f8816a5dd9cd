"""URL functions: canonical form, redaction, vendor detection, host and address predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track, and names of parameters that carry secrets.
TRACKING = r"(?i)^(utm_.+|fbclid|gclid|mc_cid|mc_eid|ref|referrer|source)$"
SENSITIVE = r"(?i)(^|[-_])(auth|authorization|credential|jwt|key|password|secret|session|sig|signature|token)($|[-_])|api[-_]?key|access[-_]?token|^x-(amz|goog)-"
# IPv4 networks that are not public.
PRIVATE_V4 = ("0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4")


_SCHEME = r"^[a-zA-Z][a-zA-Z0-9+.-]*://"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*)://", 1))


def authority(url: Column) -> Column:
    """Host and port as they stand, without credentials."""
    return F.regexp_replace(F.regexp_extract(url, rf"{_SCHEME}([^/?#]*)", 1), "^.*@", "")


def host(url: Column) -> Column:
    """Host in lower case, IPv6 addresses in their brackets, without the point that may end it."""
    return F.regexp_replace(F.lower(F.regexp_extract(authority(url), r"^(\[[^\]]*\]|[^:]*)", 1)), r"\.$", "")


def port(url: Column) -> Column:
    """A port that is given and not the scheme's own, else null."""
    given = F.regexp_extract(authority(url), r"^(?:\[[^\]]*\]|[^:]*):0*(\d+)$", 1)
    own = F.when(scheme(url) == "https", "443").when(scheme(url) == "http", "80").otherwise("")
    return F.when((given != "") & (given != own), given.cast("int"))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def origin(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), host(url), F.coalesce(F.concat(F.lit(":"), port(url).cast("string")), F.lit("")))


def resolved(where: Column) -> Column:
    """A path without ``.`` and ``..`` segments."""
    up, stay = r"(?i)^(\.|%2e){2}$", r"(?i)^(\.|%2e)$"
    kept = F.aggregate(
        F.split(where, "/"),
        F.array().cast("array<string>"),
        lambda had, s: F.when(s.rlike(up), F.slice(had, F.lit(1), F.greatest(F.size(had) - 1, F.lit(1)))).when(s.rlike(stay), had).otherwise(F.concat(had, F.array(s))),
    )
    return F.concat(F.array_join(kept, "/"), F.when(where.rlike(r"(?i)/(\.|%2e){1,2}$"), "/").otherwise(""))


def _parameters(url: Column) -> Column:
    """Parameters sorted by name, those of one name as they came, encoded as forms are."""
    decoded = lambda text: F.coalesce(F.try_url_decode(text), text)
    value = lambda p: F.when(F.contains(p, F.lit("=")), F.regexp_replace(p, "^[^=]*=", "")).otherwise("")
    given = F.filter(F.split(query(url), "&"), lambda p: p != "")
    told = F.transform(given, lambda p, i: F.struct(decoded(F.substring_index(p, "=", 1)).alias("name"), i.alias("i"), decoded(value(p)).alias("value")))
    kept = F.filter(told, lambda p: ~p["name"].rlike(TRACKING) & ~p["name"].rlike(SENSITIVE))
    return F.array_join(F.transform(F.array_sort(kept), lambda p: F.concat(F.url_encode(p["name"]), F.lit("="), F.url_encode(p["value"]))), "&")


def canonical(url: Column, schemes: str = "https") -> Column:
    """Canonical form, null where the scheme is another one, the URL has credentials or its port is none: lower-case host, only ports that
    are not the scheme's own, no fragment, no tracking or secret parameters, the others sorted by name, dot segments resolved, single slashes, none at the end."""
    valid = url.rlike(rf"(?i)^({schemes})://(\[[0-9a-f:.]+\]|[^/?#@:\[\]]+)(:\d*)?([/?#]|$)") & (F.coalesce(port(url), F.lit(0)) <= 65_535)
    where = F.regexp_replace(F.regexp_replace(resolved(path(url)), "/{2,}", "/"), "/$", "")
    left = _parameters(url)
    out = F.concat(origin(url), F.when(where == "", F.lit("/")).otherwise(where), F.when(left != "", F.concat(F.lit("?"), left)).otherwise(F.lit("")))
    return F.when(valid, out)


def redacted(url: Column) -> Column:
    """A URL as telemetry may hold it: its query, if any, behind a mark."""
    return F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), r"\?.*$", "?[REDACTED]")


def host_matches(name: Column, pattern: Column) -> Column:
    """``*.suffix`` matches hosts strictly below the suffix, another pattern itself."""
    suffix = F.substring(pattern, 2, 1_000)
    return F.when(pattern.startswith("*."), name.endswith(suffix) & (F.length(name) > F.length(suffix))).otherwise(name == pattern)


def host_of_domain(name: Column, domain: Column) -> Column:
    return (name == domain) | name.endswith(F.concat(F.lit("."), domain))


def v4_number(address: Column) -> Column:
    """An IPv4 address as a number, null if it is none."""
    parts = F.split(address, r"\.")
    number = F.aggregate(parts, F.lit(0).cast("long"), lambda acc, x: acc * 256 + x.cast("long"))
    return F.when(address.rlike(r"^((25[0-5]|2[0-4]\d|1?\d?\d)(\.|$)){4}$") & ~address.endswith("."), number)


def is_public_v4(address: Column) -> Column:
    number, private = v4_number(address), F.lit(False)
    for network in PRIVATE_V4:
        base, bits = network.split("/")
        low = 0
        for part in base.split("."):
            low = low * 256 + int(part)
        private = private | number.between(low, low + 2 ** (32 - int(bits)) - 1)
    return F.coalesce(~private, F.lit(False))


def path_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def vendor(url: Column) -> Column:
    """Board vendor, tenant and region of a URL: ``struct(vendor, tenant, region)``, nulls where none is known."""
    at = host(url)
    step = F.filter(F.split(path(url), "/"), lambda s: s != "")
    nth = lambda i: F.get(step, F.lit(i))
    token = lambda x: F.when(F.lower(x).rlike("^[a-z0-9][a-z0-9_.-]{0,127}$"), F.lower(x))
    found = lambda v, t, r: F.struct(F.lit(v).alias("vendor"), token(t).alias("tenant"), F.lit(r).cast("string").alias("region"))
    return (
        F.when(at.isin("boards.greenhouse.io", "job-boards.greenhouse.io"), found("greenhouse", nth(0), None))
        .when((at == "boards-api.greenhouse.io") & (nth(0) == "v1") & (nth(1) == "boards"), found("greenhouse", nth(2), None))
        .when((at == "api.lever.co") & (nth(0) == "v0") & (nth(1) == "postings"), found("lever", nth(2), "global"))
        .when((at == "api.eu.lever.co") & (nth(0) == "v0") & (nth(1) == "postings"), found("lever", nth(2), "eu"))
        .when(at == "jobs.lever.co", found("lever", nth(0), "global"))
        .when(at == "jobs.eu.lever.co", found("lever", nth(0), "eu"))
        .when(at == "jobs.ashbyhq.com", found("ashby", nth(0), None))
        .when((at == "api.ashbyhq.com") & (nth(0) == "posting-api") & (nth(1) == "job-board"), found("ashby", nth(2), None))
        .otherwise(found(None, F.lit(None).cast("string"), None))
    )


def enumeration_urls(name: Column, tenant: Column, region: Column) -> Column:
    """URLs that list a board: one, or all pages of a hundred postings up to the last that may be asked for."""
    base = F.when(region == "eu", F.lit("https://api.eu.lever.co")).otherwise(F.lit("https://api.lever.co"))
    pages = F.transform(F.sequence(F.lit(0), F.lit(9_900), F.lit(100)), lambda s: F.concat(base, F.lit("/v0/postings/"), tenant, F.lit("?mode=json&limit=100&skip="), s.cast("string")))
    return (
        F.when(name == "greenhouse", F.array(F.concat(F.lit("https://boards-api.greenhouse.io/v1/boards/"), tenant, F.lit("/jobs"))))
        .when(name == "lever", pages)
        .when(name == "ashby", F.array(F.concat(F.lit("https://api.ashbyhq.com/posting-api/job-board/"), tenant, F.lit("?includeCompensation=true"))))
    )
