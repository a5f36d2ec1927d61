"""URL functions. All are column expressions but normalize_url, match_url and resolve, which are Arrow UDFs."""

from __future__ import annotations

from urllib.parse import parse_qsl, quote, unquote, urlencode, urljoin, urlsplit, urlunsplit

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: scheme, authority, path, query
URL = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"

# Reason phrases of HTTP status codes.
STATUS_TEXT = {
    200: "OK",
    201: "Created",
    204: "No Content",
    301: "Moved Permanently",
    302: "Found",
    304: "Not Modified",
    307: "Temporary Redirect",
    308: "Permanent Redirect",
    400: "Bad Request",
    401: "Unauthorized",
    403: "Forbidden",
    404: "Not Found",
    410: "Gone",
    429: "Too Many Requests",
    500: "Internal Server Error",
    502: "Bad Gateway",
    503: "Service Unavailable",
    504: "Gateway Timeout",
}
# Resource types by file extension.
EXTENSION_TYPES = {
    "html": ("html", "htm"),
    "css": ("css",),
    "js": ("js", "mjs"),
    "image": ("jpg", "jpeg", "png", "gif", "svg", "webp", "ico"),
    "pdf": ("pdf",),
    "font": ("woff", "woff2", "ttf", "eot"),
}
# Extensions of what is no HTML page.
NON_HTML = [
    "jpg", "jpeg", "png", "gif", "svg", "webp", "ico", "bmp", "tiff", "avif", "pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "css", "js", "mjs", "woff", "woff2", "ttf",
    "eot", "otf", "mp3", "mp4", "avi", "mov", "webm", "ogg", "wav", "zip", "tar", "gz", "rar", "7z", "json", "xml", "rss", "yaml", "yml", "map", "wasm", "exe", "dmg", "txt",
    "csv", "rtf",
]
# Query parameters that only track.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "mc_cid", "mc_eid", "_ga")


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def scheme(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(_c(url), URL, 1))


def netloc(url: Column | str) -> Column:
    return F.regexp_extract(_c(url), URL, 2)


def host(url: Column | str) -> Column:
    """The lower-case host without user and port; NULL if there is none."""
    bare = F.regexp_replace(F.regexp_replace(netloc(url), r"^.*@", ""), r":\d*$", "")
    return F.nullif(F.lower(bare), F.lit(""))


def path(url: Column | str, default: str = "/") -> Column:
    p = F.regexp_extract(_c(url), URL, 3)
    return F.when(p == "", F.lit(default)).otherwise(p)


def query(url: Column | str) -> Column:
    return F.regexp_extract(_c(url), URL, 4)


def status_group(code: Column | str) -> Column:
    c = _c(code)
    out = F.when(c.isNull(), "unknown")
    for n in (2, 3, 4, 5):
        out = out.when((c >= n * 100) & (c < n * 100 + 100), f"{n}xx")
    return out.otherwise("other")


def status_text(code: Column | str) -> Column:
    known = F.create_map(*[F.lit(x) for kv in STATUS_TEXT.items() for x in kv])
    return F.coalesce(known[_c(code).cast("int")], F.lit("Unknown"))


def resource_type(content_type: Column | str, url: Column | str) -> Column:
    ct = F.trim(F.lower(F.substring_index(F.coalesce(_c(content_type), F.lit("")), ";", 1)))
    p = F.lower(path(url))
    out = F.when(ct.contains("html"), "html").when(ct.startswith("image/"), "image").when(ct.contains("css"), "css")
    out = out.when(ct.contains("javascript") | ct.contains("ecmascript"), "js").when(ct.contains("pdf"), "pdf")
    out = out.when(ct.contains("font") | ct.contains("woff"), "font")
    for kind, ends in EXTENSION_TYPES.items():
        out = out.when(p.rlike(rf"\.(?:{'|'.join(ends)})$"), kind)
    return out.otherwise("other")


def likely_html(url: Column | str) -> Column:
    """The last path segment has no extension, or none of a non-HTML file."""
    ext = F.lower(F.regexp_extract(F.regexp_replace(path(url), "/+$", ""), r"\.([^./]*)$", 1))
    return ~ext.isin(NON_HTML)


def folder_depth(url: Column | str) -> Column:
    return F.size(F.filter(F.split(path(url), "/"), lambda s: s != ""))


def shape(p: Column | str) -> Column:
    """The template shape of a path: its first segment, then {n} for segments that start with a digit, {s} for others."""
    parts = F.filter(F.split(F.coalesce(_c(p), F.lit("/")), "/"), lambda s: s != "")
    named = F.transform(parts, lambda s, i: F.when(s.rlike(r"^\d"), "{n}").when(i == 0, s).otherwise("{s}"))
    return F.concat(F.lit("/"), F.array_join(named, "/"))


def is_internal(url: Column | str, hosts: list[str], subdomains_of: str | None = None) -> Column:
    """The host, with or without www., is one of hosts; or ends with a root domain (without a dot boundary)."""
    h = host(url)
    inside = h.isin(hosts) | F.regexp_replace(h, r"^www\.", "").isin(hosts)
    if subdomains_of:
        inside = inside | h.endswith(subdomains_of)
    return F.coalesce(inside, F.lit(False))


def header_canonical(link_header: Column | str) -> Column:
    """The target of a Link header with rel="canonical"."""
    h = _c(link_header)
    target = F.trim(F.regexp_replace(F.substring_index(h, ";", 1), r"^[\s<]+|[\s>]+$", ""))
    return F.when(h.contains('rel="canonical"'), target)


def normalize(url: str) -> str:
    """Scheme and host in lower case, no fragment, query pairs sorted, percent-encoding in one form, no empty path."""
    try:
        u = urlsplit(url.strip())
    except ValueError:
        return url
    p = "%2F".join(quote(unquote(x), safe="/:@!$&'()*+,;=~-._") for x in u.path.replace("%2f", "%2F").split("%2F"))
    pairs = sorted(parse_qsl(u.query, keep_blank_values=True))
    return urlunsplit((u.scheme.lower(), u.netloc.lower().rstrip(":"), p or "/", urlencode(pairs), ""))


def normalize_for_match(url: str) -> str:
    """For joins across systems: lower case, no tracking parameters, no trailing slash, no fragment."""
    u = urlsplit(url.strip().lower())
    pairs = [kv for kv in parse_qsl(u.query) if kv[0] not in TRACKING]
    return urlunsplit((u.scheme, u.netloc, u.path.rstrip("/") or "/", urlencode(pairs), ""))


def match_forms(url: str) -> list[str]:
    """The forms of a URL for joins, with all of its tracking parameters, then always one less from the end, to none."""
    u = urlsplit(url.strip().lower())
    pairs = parse_qsl(u.query)
    tracks = [i for i, kv in enumerate(pairs) if kv[0] in TRACKING]
    kept = [[kv for i, kv in enumerate(pairs) if i not in gone] for gone in (set(tracks[n:]) for n in range(len(tracks), -1, -1))]
    return [urlunsplit((u.scheme, u.netloc, u.path.rstrip("/") or "/", urlencode(x), "")) for x in kept]


def join(base: str | None, href: str | None) -> str | None:
    if not base or not href:
        return href
    try:
        return urljoin(base, href)
    except ValueError:
        return href


def _each(f):
    return lambda *cols: pa.array([None if row[-1] is None else f(*row) for row in zip(*(c.to_pylist() for c in cols), strict=True)], pa.string())


@F.arrow_udf(T.StringType())
def normalize_url(url: pa.Array) -> pa.Array:
    return _each(normalize)(url)


@F.arrow_udf(T.StringType())
def match_url(url: pa.Array) -> pa.Array:
    return _each(lambda u: normalize_for_match(u) if u else u)(url)


@F.arrow_udf(T.ArrayType(T.StringType()))
def match_urls(url: pa.Array) -> pa.Array:
    return pa.array([match_forms(u) if u else u if u is None else [u] for u in url.to_pylist()], pa.list_(pa.string()))


@F.arrow_udf(T.StringType())
def resolve(base: pa.Array, href: pa.Array) -> pa.Array:
    return _each(join)(base, href)


def url_hash(url: Column | str) -> Column:
    return F.sha2(normalize_url(_c(url)), 256)


def body_hash(body: Column | str, content_type: Column | str, status: Column | str) -> Column:
    """SHA-256 of a page's body; null for what is no HTML or an error."""
    html = F.lower(_c(content_type)).contains("html") & (_c(status) < 400)
    return F.when(html, F.sha2(_c(body).cast("binary"), 256))


def compact_key(hash_: Column | str) -> Column:
    """The first 16 hexadecimal digits of a hash as a number."""
    return F.conv(F.substring(_c(hash_), 1, 16), 16, 10).cast("decimal(20,0)")


def follow(url: Column | str, include: list[str], exclude: list[str], max_length: int | None = None, max_depth: int | None = None) -> Column:
    """Whether a crawl follows a URL. Patterns are globs or regular expressions. An exclude match says no; with include
    patterns the first match says yes, whatever the limits, and no match says no; else the limits decide."""
    import fnmatch

    def match(pattern: str) -> Column:
        glob = fnmatch.translate(pattern).replace("(?s:", "(?s)").removesuffix(")\\Z").removesuffix(")\\z")
        return _c(url).rlike(f"^(?:{glob})$") | _c(url).rlike(pattern if _valid(pattern) else r"(?!)")

    ok = F.lit(True)
    if max_length is not None:
        ok = ok & (F.length(_c(url)) <= max_length)
    if max_depth is not None:
        ok = ok & (folder_depth(url) <= max_depth)
    if include:
        ok = F.lit(False)
        for p in include:
            ok = ok | match(p)
    for p in exclude:
        ok = ok & ~match(p)
    return ok


def _valid(pattern: str) -> bool:
    import re

    try:
        re.compile(pattern)
    except re.error:
        return False
    return True
