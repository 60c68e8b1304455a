"""Links and titles out of HTML and documents.

``html`` and ``doc`` are read once per row and never enter a shuffle: the extracted arrays are
projected first, then exploded.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from linkloom.functions import http, text, urls, whatwg

#: Fixed patterns: comments, base, anchors, titles; attribute values quoted or bare.
_VALUE = r"""("[^"]*"|'[^']*'|[^\s">]+)"""
COMMENT = r"(?s)<!--.*?-->"
BASE = rf"(?i)<base\b[^>]*\bhref\s*=\s*{_VALUE}"
ANCHOR = rf"(?i)<a\b[^>]*?\bhref\s*=\s*{_VALUE}"
TITLE = r"(?is)<title[^>]*>(.*?)</title>"
SKIPPED = r"(?i)^(?:javascript:|mailto:|tel:|data:)"
TITLE_CAP = 300


def _inner(value: Column) -> Column:
    """An attribute value without its quotes."""
    return F.regexp_replace(value, r"""(?s)^(["'])(.*)\1$""", "$2")


def title(html: Column) -> Column:
    """The first title, collapsed, at most 300 characters, references left as they are."""
    return F.substring(text.collapse(F.regexp_extract(F.regexp_replace(html, COMMENT, ""), TITLE, 1)), 1, TITLE_CAP)


@F.arrow_udf(StructType([StructField("raw_href", StringType()), StructField("href", StringType())]))
def _link(raw: pa.Array, base_href: pa.Array, page_url: pa.Array) -> pa.Array:
    """Decoded and resolved hrefs, null for those left out; of null raw hrefs (resolved in the JVM) nothing is done."""
    out = []
    for href, base, page in zip(raw.to_pylist(), base_href.to_pylist(), page_url.to_pylist(), strict=True):
        decoded = text.decode_entity(href) if href else ""
        if not decoded or decoded.startswith("#") or re.match(SKIPPED, decoded):
            out.append(None)
            continue
        on = whatwg.resolve(text.decode_entity(base), page) if base else page
        found = whatwg.resolve(decoded, on or page)
        out.append(found and {"raw_href": decoded, "href": found})
    return pa.array(out, pa.struct([("raw_href", pa.string()), ("href", pa.string())]))


def links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(page_url, pos, raw_href, href, protocol, host, path) of every anchor, in order, repeats kept.

    Comments are cut, the first base href is honoured, fragments-only and script-like hrefs and
    malformed ones are dropped. Scripts and styles aren't cut.
    """
    source = F.regexp_replace(F.coalesce(F.col(html), F.lit("")), COMMENT, "")
    found = pages.select(
        F.col(url).alias("page_url"),
        text.trim(_inner(F.regexp_extract(source, BASE, 1))).alias("base_href"),
        F.regexp_extract_all(source, F.lit(ANCHOR), F.lit(1)).alias("hrefs"),
    )
    each = found.select("page_url", "base_href", F.posexplode("hrefs").alias("pos", "value"))
    each = each.select("page_url", "base_href", "pos", text.trim(_inner(F.col("value"))).alias("raw"))
    plain, href = urls.plain_href(F.col("raw"), F.col("page_url"))
    fast = plain & (F.col("base_href") == "") & ~F.col("raw").contains("&")
    link = F.when(fast, F.struct(F.col("raw").alias("raw_href"), href.alias("href"))).otherwise(_link(F.when(~fast, F.col("raw")), "base_href", "page_url"))
    out = each.select("page_url", "pos", link.alias("link")).where(F.col("link.href").isNotNull()).select("page_url", "pos", "link.raw_href", "link.href")
    return out.select("*", urls.protocol("href").alias("protocol"), urls.hostname("href").alias("host"), urls.pathname("href").alias("path"))


def zip_entries(data: bytes) -> Iterator[tuple[str, bytes]]:
    """(name, content) of a zip's stored and deflated entries by its central directory; bad entries are left out."""
    end = data.rfind(b"PK\x05\x06", max(0, len(data) - 22 - 65535))
    if end < 0 or end + 22 > len(data):
        return
    count, at = struct.unpack_from("<H", data, end + 10)[0], struct.unpack_from("<I", data, end + 16)[0]
    for _ in range(count):
        if data[at : at + 4] != b"PK\x01\x02" or at + 46 > len(data):
            return
        method, size = struct.unpack_from("<H", data, at + 10)[0], struct.unpack_from("<I", data, at + 20)[0]
        names, extra, comment = struct.unpack_from("<3H", data, at + 28)
        head = struct.unpack_from("<I", data, at + 42)[0]
        name = data[at + 46 : at + 46 + names].decode("utf-8", "replace")
        at += 46 + names + extra + comment
        if data[head : head + 4] != b"PK\x03\x04" or head + 30 > len(data):
            continue
        start = head + 30 + sum(struct.unpack_from("<2H", data, head + 26))
        try:
            yield name, data[start : start + size] if method == 0 else zlib.decompress(data[start : start + size], -15)
        except zlib.error:
            continue


def office_links(data: bytes) -> list[str]:
    """http(s) targets of an Office file's relationship parts."""
    parts = (content.decode("utf-8", "replace") for name, content in zip_entries(data) if name.lower().endswith(".rels"))
    return [t.replace("&amp;", "&") for xml in parts for t in re.findall(r'Target="([^"]+)"', xml) if re.match("https?://", t, re.I)]


@F.arrow_udf(ArrayType(StringType()))
def _office(docs: pa.Array) -> pa.Array:
    return pa.array([[] if x is None else office_links(x) for x in docs.to_pylist()], pa.list_(pa.string()))


def pdf_links(doc: Column) -> Column:
    """URI actions of a PDF, backslash escapes of brackets undone."""
    found = F.regexp_extract_all(F.decode(doc, "ISO-8859-1"), F.lit(r"(?s)/URI\s*\(((?:\\.|[^\\)])*)\)"), F.lit(1))
    return F.transform(found, lambda x: F.regexp_replace(x, r"\\([()\\])", "$1"))


def raw_urls(doc: Column) -> Column:
    """URLs in a file's bytes read as Latin-1, then as UTF-16LE."""
    pattern = F.lit(r"""(?i)https?://[^\s"'<>)\]}\x00]{3,}""")
    even = F.substring(doc, F.lit(1), (F.floor(F.octet_length(doc) / 2) * 2).cast("int"))
    wide = _wide(even)
    return F.concat(F.regexp_extract_all(F.decode(doc, "ISO-8859-1"), pattern, F.lit(0)), F.regexp_extract_all(wide, pattern, F.lit(0)))


@F.arrow_udf(StringType())
def _wide(docs: pa.Array) -> pa.Array:
    return pa.array(["" if x is None else x.decode("utf-16-le", "replace") for x in docs.to_pylist()], pa.string())


def document_links(docs: DataFrame, url: str = "url", doc: str = "doc", doc_type: str = "doc_type") -> DataFrame:
    """(page_url, doc_type, n, href) rows of documents: distinct http(s) links by type, trailing punctuation cut; href is null for documents without links."""
    kind = F.coalesce(F.nullif(F.nullif(F.col(doc_type), F.lit("")), F.lit("sniff")), http.sniff(F.col(doc)), F.lit("doc"))
    typed = docs.select(F.col(url).alias("page_url"), F.col(doc).alias("doc"), kind.alias("doc_type"))
    office = F.when(F.col("doc_type") == "ooxml", F.col("doc"))
    raws = F.when(F.col("doc_type") == "ooxml", _office(office)).when(F.col("doc_type") == "pdf", pdf_links(F.col("doc"))).otherwise(raw_urls(F.when(~F.col("doc_type").isin("ooxml", "pdf"), F.col("doc"))))
    each = typed.withColumn("raws", F.coalesce(raws, F.array().cast("array<string>"))).select("page_url", "doc_type", F.posexplode_outer("raws").alias("pos", "raw"))
    each = each.withColumn("raw", F.regexp_replace(text.trim(F.col("raw")), r"""[).,;'">]+$""", ""))
    usable = F.when((F.col("raw") != "") & ~F.col("raw").rlike(r"(?i)^(?:mailto:|tel:|javascript:)"), F.col("raw"))
    each = each.withColumn("href", urls.resolve(usable, F.col("page_url"))).withColumn("href", F.when(urls.is_web("href"), F.col("href")))
    kept = each.groupBy("page_url", "doc_type", "href").agg(F.min("pos").alias("pos"))
    counts = kept.groupBy("page_url", "doc_type").agg(F.count("href").alias("n"), F.sort_array(F.collect_list(F.when(F.col("href").isNotNull(), F.struct("pos", "href")))).alias("all"))
    return counts.select("page_url", "doc_type", "n", F.explode_outer("all").alias("x")).select("page_url", "doc_type", "n", F.col("x.pos").alias("pos"), F.col("x.href").alias("href"))


def document_title(doc_type: Column, n: Column) -> Column:
    """'(pdf, N links)'; Office Open XML is shown as office-doc."""
    return F.format_string("(%s, %d links)", F.when(doc_type == "ooxml", "office-doc").otherwise(doc_type), n)


def body_verdict(html: Column, doc: Column) -> Column:
    """null, or the error of a body over the caps (an HTML body over 5 Mi units is an error; a document is read up to its cap)."""
    return F.when(F.length(html) > http.MAX_HTML, "body too large")
