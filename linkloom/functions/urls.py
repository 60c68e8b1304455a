"""URL functions as column expressions."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from linkloom.functions import whatwg

_HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#]*@)?(\[[^\]]*\]|[^/?#:]*)"
#: A root-relative href that resolving leaves as it is but for letters to encode, and an origin that is in canonical form.
_PLAIN = r"^/(?:(?!\.{1,2}(?:/|$))[A-Za-z0-9_~!$&()*+,;=:@.\-\u00C0-\u024F]+(?:/|$))*$"
_KEPT = {"%2F": "/", "%7E": "~", "%21": "!", "%24": "$", "%26": "&", "%28": "(", "%29": ")", "%2B": "+", "%2C": ",", "%3B": ";", "%3D": "=", "%3A": ":", "%40": "@"}
_ORIGIN = r"^(https?://[a-z0-9\-]+(?:\.[a-z][a-z0-9\-]*)+)(?:[/?#]|$)"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


@F.arrow_udf(StringType())
def _resolve(raw: pa.Array, base: pa.Array) -> pa.Array:
    return pa.array([whatwg.resolve(a, b) for a, b in zip(raw.to_pylist(), base.to_pylist(), strict=True)], pa.string())


def resolve(raw: Column | str, base: Column | str) -> Column:
    """Absolute href of raw on base, null if malformed.

    Plain root-relative hrefs are joined in the JVM; only the others go through Python.
    """
    raw, base = _col(raw), _col(base)
    fast, href = plain_href(raw, base)
    return F.when(fast, href).otherwise(_resolve(F.when(~fast, raw), base))


def plain_href(raw: Column, base: Column) -> tuple[Column, Column]:
    """(whether the JVM can resolve raw on base, its href if so): root-relative, no dot segments, Latin letters at most to encode."""
    origin = F.regexp_extract(base, _ORIGIN, 1)
    coded = F.url_encode(raw)
    for code, plain in _KEPT.items():
        coded = F.replace(coded, F.lit(code), F.lit(plain))
    return F.coalesce(raw.rlike(_PLAIN) & (origin != ""), F.lit(False)), F.concat(origin, F.when(raw.rlike(r"^[\x00-\x7F]*$"), raw).otherwise(coded))


@F.arrow_udf(StringType())
def canonical(url: pa.Array) -> pa.Array:
    """The canonical form of an absolute URL, null if malformed."""

    def one(x: str | None) -> str | None:
        try:
            return None if x is None else whatwg.parse(x).href
        except (whatwg.BadUrl, UnicodeError):
            return None

    return pa.array([one(x) for x in url.to_pylist()], pa.string())


def normalize(href: Column | str) -> Column:
    """A canonical href without fragment and without one trailing slash of the whole string, unless the path is only '/'."""
    bare = F.regexp_replace(_col(href), "#.*$", "")
    rooted = F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1) == "/"
    return F.when(bare.endswith("/") & ~rooted, bare.substr(F.lit(1), F.length(bare) - 1)).otherwise(bare)


def protocol(href: Column | str) -> Column:
    """Scheme with colon, as in 'https:'."""
    return F.lower(F.regexp_extract(_col(href), r"^([A-Za-z][A-Za-z0-9+.\-]*:)", 1))


def hostname(href: Column | str) -> Column:
    """Host without user and port, lower-cased; '' if there is none."""
    return F.lower(F.regexp_extract(_col(href), _HOST, 1))


def pathname(href: Column | str) -> Column:
    """Path without query and fragment."""
    return F.regexp_extract(_col(href), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def is_web(href: Column | str) -> Column:
    """Only http and https are classified."""
    return protocol(href).isin("http:", "https:")


def same_domain(host: Column | str, start_host: Column | str, include_subdomains: bool | Column) -> Column:
    """Equal hosts, or with subdomains either a dot-suffix of the other. A column says so for each row."""
    host, start = _col(host), _col(start_host)
    if include_subdomains is False:
        return host == start
    below = host.endswith(F.concat(F.lit("."), start)) | start.endswith(F.concat(F.lit("."), host))
    return (host == start) | (below if include_subdomains is True else include_subdomains & below)


def in_scope(path: Column | str, prefix: str | Column) -> Column:
    """Whether a path is the prefix or below it; an empty prefix holds all. A column gives each row's prefix."""
    path = _col(path)
    if isinstance(prefix, Column):
        return (prefix == "") | (path == prefix) | path.startswith(F.concat(prefix, F.lit("/")))
    return F.lit(True) if not prefix else (path == prefix) | path.startswith(prefix + "/")


def scope_prefix(start_url: str, scope: str = "domain", path_prefix: str = "") -> str:
    """The explicit prefix, else the start path when the scope is 'path'; without trailing slashes."""
    if not path_prefix and scope == "path":
        try:
            path_prefix = whatwg.parse(start_url).pathname
        except whatwg.BadUrl:
            path_prefix = ""
    return path_prefix.rstrip("/")


def host_group(url: Column | str) -> Column:
    """Grouping key by host: without user and ':port', lower-cased."""
    found = F.regexp_extract(_col(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]+)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(found, "^[^@]*@", ""), r":\d+$", ""))
    return F.when(host == "", F.lit("(unknown host)")).otherwise(host)


def folder_group(url: Column | str) -> Column:
    """Grouping key by host and first folder: 'host/first/' or 'host/'."""
    host = host_group(url)
    first = F.get(F.filter(F.split(pathname(url), "/"), lambda x: x != ""), F.lit(0))
    return F.when(host == "(unknown host)", F.lit("(unknown)")).when(first.isNull(), F.concat(host, F.lit("/"))).otherwise(F.concat(host, F.lit("/"), first, F.lit("/")))


def tracker_host(url: Column | str) -> Column:
    """As host_group, but any scheme text counts and the port is cut at the first colon."""
    rest = F.regexp_extract(_col(url), r"(?s)^.*?://([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(rest, "^[^@]*@", ""), ":.*$", ""))
    return F.when(host == "", F.lit("(unknown host)")).otherwise(host)


def tracker_folder(url: Column | str) -> Column:
    """First folder by tracker_host."""
    host = tracker_host(url)
    path = F.regexp_replace(F.regexp_extract(_col(url), r"(?s)^.*?://[^/]*/(.*)$", 1), r"(?s)[?#].*$", "")
    first = F.get(F.filter(F.split(path, "/"), lambda x: x != ""), F.lit(0))
    return F.when(host == "(unknown host)", F.lit("(unknown)")).when(first.isNull(), F.concat(host, F.lit("/"))).otherwise(F.concat(host, F.lit("/"), first, F.lit("/")))


def page_file_name(url: Column | str) -> Column:
    """A file name for a page: no scheme, other characters to one '_', trimmed, 120 at most, else 'page'."""
    steps = [(r"(?s)^.*?://", ""), (r"[^A-Za-z0-9._-]", "_"), (r"__+", "_"), (r"^[_.]+", ""), (r"[_.]+$", "")]
    name = reduce(lambda c, s: F.regexp_replace(c, *s), steps, _col(url))
    return F.when(name == "", F.lit("page")).otherwise(F.substring(name, 1, 120))


def site_path(stem: str, index: Column | int, host: Column | str, ext: str) -> Column:
    """'stem.<i>-<host>.ext' with other characters of the host as '_'."""
    index = F.lit(index) if isinstance(index, int) else index
    return F.concat(F.lit(stem + "."), index.cast("string"), F.lit("-"), F.regexp_replace(_col(host), r"(?i)[^a-z0-9.\-]", "_"), F.lit(ext))


def encode_component(text: Column | str) -> Column:
    """Percent-encoding of a URL component: all but letters, digits and -_.!~*'()."""
    out = F.url_encode(_col(text))
    for coded, plain in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(coded), F.lit(plain))
    return out


def url_key(url: Column | str) -> Column:
    """A 64-bit key of a URL, for compact seen sets."""
    return F.xxhash64(_col(url))
