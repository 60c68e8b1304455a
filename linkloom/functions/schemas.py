"""Explicit schemas of the files and tables; nothing is inferred on read."""

from __future__ import annotations

RESPONSE = "url string, status int, content_type string, retry_after string, html string, doc binary, doc_type string, error string"
PAGE = "url string, title string, status int, depth int, internal bigint, external bigint"
FLAGGED = "url string, reason string, source string, kind string"
_FOUND = "array<string>"
REPORT_FLAGGED = f"array<struct<url: string, reason: string, kind: string, foundOn: {_FOUND}>>"
SUMMARY = "struct<" + ", ".join(f"{c}: bigint" for c in "pagesCrawled queued externalLinks linkInstances brokenLinkInstances outOfScope errorsInternal errorsExternal blocked suppressed retries runtimeMs".split()) + ">"
SETTINGS = "struct<concurrency: int, delay: int, rps: double, maxPages: int, maxDepth: int, includeSubdomains: boolean, checkExternal: boolean>"
LOG = "struct<manifest: string, singleFile: boolean, parts: array<struct<part: int, file: string, started: string, bytes: bigint, lines: bigint>>>"
REPORT = (
    f"crawledAt string, partial boolean, scope string, settings {SETTINGS}, log {LOG}, summary {SUMMARY}, "
    "internalPages array<struct<url: string, title: string, status: int, depth: int, internal: bigint, external: bigint>>, "
    f"externalLinks array<struct<url: string, host: string, status: string, foundOn: {_FOUND}>>, outOfScopeLinks array<struct<url: string, foundOn: {_FOUND}>>, "
    f"errors {REPORT_FLAGGED}, suppressedErrors {REPORT_FLAGGED}, blocked {REPORT_FLAGGED}"
)
COMBINED = (
    "crawledAt string, sites array<struct<url: string, host: string, status: string, reportFile: string, jsonFile: string, "
    f"summary: {SUMMARY}, errors: {REPORT_FLAGGED}, blocked: {REPORT_FLAGGED}>>"
)
#: One superset of all journal events, told apart by t.
EVENT = (
    "t string, v int, run string, startUrl string, scope string, depth int, subs boolean, startedAt string, at string, "
    "u string, s int, d int, ti string, ct string, r string, k string, src string, `in` array<string>, ex array<array<string>>, oo array<string>"
)
STATE = "app string, host string, v map<string, string>"
MANIFEST = "run string, startUrl string, startedAt string, base string, ext string, maxBytes bigint, parts array<struct<part: int, file: string, started: string, bytes: bigint, lines: bigint>>, complete boolean, updatedAt string"
VERDICT = "url string, kind string, was string, status int, disposition string, note string, title string, finalUrl string"
#: The host of a url.
HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)"
