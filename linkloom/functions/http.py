"""Verdicts on HTTP outcomes, content types and waiting times as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkloom.functions import text

#: Fixed values.
BLOCKED_STATUS = (401, 403, 405, 406, 408, 409, 429, 451, 999)
HEAD_DOUBTFUL = (0, 400, 403, 405, 406, 429, 501)
MAX_HTML, MAX_DOC = 5 * 1024 * 1024, 25 * 1024 * 1024
CHALLENGE = r"(?i)just a moment|attention required|checking your browser|verify you are human|cf-browser-verification|please wait while|ddos protection|access denied|are you a robot"
DEAD = r"name_not_resolved|enotfound|connection_refused|econnrefused|connection_closed|address_unreachable|ehostunreach|enetunreach|ssl|cert|err_cert|certificate"
BACKOFF_MS = 5000
NUMBER = r"^\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\s*$"
PLAIN_ACCEPT = "text/html,application/xhtml+xml,*/*"
BROWSER_ACCEPT = "text/html,application/xhtml+xml,application/xml;q=0.9,image/avif,image/webp,*/*;q=0.8"
OLE_TYPES, PDF_PATH, OOXML_PATH, OLE_PATH = ("msword", "ms-excel", "ms-powerpoint", "vnd.ms-"), r"\.pdf(\?|$)", r"\.(docx|xlsx|pptx)(\?|$)", r"\.(doc|xls|ppt)(\?|$)"


def disposition(status: Column, error: Column) -> Column:
    """ok, broken or blocked (refused or uncertain) of a probe; status 0 means no response."""
    blocked = status.isin(*BLOCKED_STATUS) | status.between(500, 599)
    silent = F.when(F.coalesce(error, F.lit("")).rlike("(?i)timeout"), "blocked").otherwise("broken")
    return F.when(status.between(200, 399), "ok").when(blocked, "blocked").when(status == 0, silent).otherwise("broken")


def render_disposition(status: Column, error: Column, title: Column) -> Column:
    """The verdict of a rendering check: challenge titles and unknown failures are blocked."""
    err = F.lower(F.coalesce(error, F.lit("")))
    silent = F.when(err.rlike("timeout|timed out"), "blocked").when(err.rlike(DEAD), "broken").otherwise("blocked")
    blocked = status.isin(*BLOCKED_STATUS) | status.between(500, 599)
    return F.when(F.coalesce(title, F.lit("")).rlike(CHALLENGE), "blocked").when(status.between(200, 399), "ok").when(blocked, "blocked").when(status == 0, silent).otherwise("broken")


def render_note(status: Column, error: Column, title: Column) -> Column:
    """The note beside a rendering verdict."""
    err = F.lower(F.coalesce(error, F.lit("")))
    silent = F.when(err.rlike("timeout|timed out"), "timeout").otherwise(F.coalesce(F.nullif(error, F.lit("")), F.lit("no response")))
    challenge = F.concat(F.lit("challenge/interstitial: "), F.substring(F.trim(title), 1, 80))
    return F.when(F.coalesce(title, F.lit("")).rlike(CHALLENGE), challenge).when(status == 0, silent).otherwise(F.concat(F.lit("HTTP "), status.cast("string")))


def detail(status: Column, error: Column) -> Column:
    """'HTTP n', or the error, or 'no response'."""
    return F.when(status > 0, F.concat(F.lit("HTTP "), status.cast("string"))).otherwise(F.coalesce(F.nullif(error, F.lit("")), F.lit("no response")))


def probe(head_status: Column, head_error: Column, get_status: Column, get_error: Column) -> tuple[Column, Column]:
    """(status, error) of a HEAD with a GET where the HEAD is doubtful: the GET wins if it has a status."""
    has_error = F.coalesce(head_error, F.lit("")) != ""
    doubtful = has_error | head_status.isin(*HEAD_DOUBTFUL) | (head_status >= 500)
    answered = doubtful & (get_status > 0)
    status = F.when(answered, get_status).otherwise(head_status)
    both = F.when(doubtful & (head_status == 0), F.coalesce(F.nullif(get_error, F.lit("")), head_error)).otherwise(head_error)
    return status, F.when(answered, get_error).otherwise(both)


def document_type(content_type: Column, path: Column) -> Column:
    """pdf, ooxml or ole by content type or extension, else null."""
    c, p = F.lower(F.coalesce(content_type, F.lit(""))), F.lower(F.coalesce(path, F.lit("")))
    ole = reduce(lambda acc, x: acc | c.contains(x), OLE_TYPES, p.rlike(OLE_PATH))
    return F.when(c.contains("pdf") | p.rlike(PDF_PATH), "pdf").when(c.contains("openxmlformats") | p.rlike(OOXML_PATH), "ooxml").when(ole, "ole")


def sniff(doc: Column) -> Column:
    """pdf, ooxml or ole by the first bytes, else null."""
    head = F.hex(F.substring(doc, 1, 4))
    return F.when(F.octet_length(doc) >= 4, F.when(head == "25504446", "pdf").when(head.startswith("504B"), "ooxml").when(head == "D0CF11E0", "ole"))


def content_gate(content_type: Column, path: Column, scan_docs: bool = True) -> Column:
    """html (read as text), doc (read as bytes), sniff (bytes if they look like a document) or skip."""
    ct, kind = F.coalesce(content_type, F.lit("")), document_type(content_type, path)
    html = kind.isNull() & (ct != "") & ct.rlike("(?i)html|xml|text/")
    media = ct.rlike("(?i)^image/|^video/|^audio/")
    docs = F.when(~media & kind.isNotNull(), "doc").when(~media & (ct.rlike("(?i)octet-stream") | (ct == "")), "sniff").otherwise("skip") if scan_docs else F.lit("skip")
    return F.when(html, "html").otherwise(docs)


def request_headers(user_agent: str, browser: bool = False) -> dict[str, str]:
    """Headers of a plain or a browser-like request."""
    if browser:
        return {"User-Agent": user_agent, "Accept": BROWSER_ACCEPT, "Accept-Language": "en-US,en;q=0.9"}
    return {"User-Agent": user_agent, "Accept": PLAIN_ACCEPT}


def retry_after(value: Column, now: Column, max_ms: int) -> Column:
    """Milliseconds of a Retry-After header, seconds or HTTP date, held to 0..max_ms."""
    seconds = F.when(value.rlike(NUMBER), text.trim(value).try_cast("double"))
    date = F.try_to_timestamp(F.regexp_replace(value, r"^[A-Za-z]{3}, (\d{2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2}) GMT$", "$1"), F.lit("dd MMM yyyy HH:mm:ss"))
    ms = F.coalesce(seconds * 1000, (F.unix_millis(date) - F.unix_millis(now)).cast("double"), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(ms, F.lit(float(max_ms))))


def backoff(streak: Column, retry_ms: Column, max_ms: int) -> Column:
    """The wait after the n-th throttled answer in a row, before jitter: Retry-After, or 5 s doubling up to max_ms."""
    doubling = F.least(F.lit(float(max_ms)), BACKOFF_MS * F.pow(F.lit(2.0), streak - 1))
    return F.when(retry_ms > 0, retry_ms.cast("double")).otherwise(doubling)


def jittered(wait: Column) -> Column:
    """A wait spread by 0.85 to 1.15, so that workers don't go in step."""
    return F.round(wait * (0.85 + 0.3 * F.rand()))


def request_gap_ms(rps: float, crawl_delay: float) -> float:
    """Milliseconds between requests: the larger of the rate's and the crawl delay's."""
    return max(1000 / rps if rps > 0 else 0, crawl_delay * 1000 if crawl_delay > 0 else 0)
