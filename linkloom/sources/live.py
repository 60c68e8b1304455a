"""Fetching urls live, as a Spark data source or over a table of urls.

``spark.read.format("linkloom_fetch")`` has the options: urls (separated by blanks), method, user_agent, browser, timeout (ms), redirects, partitions.
Rows are (url, status, content_type, retry_after, body, error); a failed request has status 0 and an error.
As a stream it has the option frontier instead of urls, a folder of levels (``write_level``): each level is fetched once, file by file, so
that a lost executor repeats the urls of its files only, and a restarted stream goes on with the next level.
"""

from __future__ import annotations

import http.client
import random
import re
import socket
import time
from collections.abc import Iterable, Iterator
from email.utils import parsedate_to_datetime
from urllib.parse import urlsplit

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from linkloom.functions import whatwg
from linkloom.functions.http import BACKOFF_MS, HEAD_DOUBTFUL, MAX_DOC, NUMBER, content_gate, document_type, request_gap_ms, request_headers, sniff
from linkloom.plans.config import CrawlConfig
from linkloom.sources.tail import at_store

MOVED, REDIRECTS = (301, 302, 303, 307, 308), 5
SCHEMA = "url string, status int, content_type string, retry_after string, body binary, error string"


def fetch(url: str, method: str = "GET", headers: dict[str, str] | None = None, timeout: float = 20, redirects: int = REDIRECTS, most: int = MAX_DOC) -> tuple:
    """One row of SCHEMA; redirects are followed, the last one over the limit is returned itself."""
    asked = url
    for left in range(redirects, -1, -1):
        try:
            parts = urlsplit(whatwg.parse(url).href)
        except (whatwg.BadUrl, UnicodeError):
            return asked, 0, None, None, None, "bad URL" if url == asked else "bad redirect"
        if parts.scheme not in ("http", "https"):
            return asked, 0, None, None, None, "unsupported protocol"
        kind = http.client.HTTPSConnection if parts.scheme == "https" else http.client.HTTPConnection
        connection = kind(parts.hostname, parts.port, timeout=timeout)
        try:
            connection.request(method, (parts.path or "/") + (f"?{parts.query}" if parts.query else ""), headers=headers or {})
            answer = connection.getresponse()
            location = answer.getheader("Location")
            if answer.status in MOVED and location and left:
                url = whatwg.resolve(location, url) or "\0"
                continue
            body = b"" if method == "HEAD" else answer.read(most)
            return asked, answer.status, answer.getheader("Content-Type"), answer.getheader("Retry-After"), body, None
        except (OSError, http.client.HTTPException) as e:
            return asked, 0, None, None, None, "timeout" if isinstance(e, socket.timeout | TimeoutError) else str(e) or type(e).__name__
        finally:
            connection.close()
    raise AssertionError("unreachable")


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        urls, n = self.options.get("urls", "").split(), int(self.options.get("partitions", "4"))
        return [InputPartition(urls[k::n]) for k in range(min(n, max(1, len(urls))))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return _fetched(self.options, partition.value)


def _fetched(options: dict[str, str], urls: Iterable[str]) -> Iterator[tuple]:
    headers = request_headers(options.get("user_agent", "linkloom/1.0"), options.get("browser", "false") == "true")
    for url in urls:
        yield fetch(url, options.get("method", "GET"), headers, float(options.get("timeout", "20000")) / 1000, int(options.get("redirects", str(REDIRECTS))))


class _Frontier(DataSourceStreamReader):
    """Levels of a frontier: an offset is the number of levels that are there whole, a partition one file of a level."""

    def __init__(self, options: dict[str, str]):
        self.options = dict(options)

    def initialOffset(self) -> dict:
        return {"level": 0}

    def latestOffset(self) -> dict:
        store, folder = at_store(self.options["frontier"])
        n = 0
        while store.get_file_info(f"{folder}/level={n}/_SUCCESS").type == fs.FileType.File:
            n += 1
        return {"level": n}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        store, folder = at_store(self.options["frontier"])
        found = [f for level in range(start["level"], end["level"]) for f in store.get_file_info(fs.FileSelector(f"{folder}/level={level}"))]
        names = sorted(f"{self.options['frontier'].rstrip('/')}/{'/'.join(f.path.split('/')[-2:])}" for f in found if f.size and not f.base_name.startswith(("_", ".")))
        return [InputPartition(name) for name in names]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        store, path = at_store(partition.value)
        with store.open_input_stream(path, compression=None) as f:
            return _fetched(self.options, f.read().decode().split())


def write_level(urls: DataFrame, frontier: str, level: int, size: int = 1000) -> None:
    """A level of a frontier: files of at most so many urls (url), each the work of one task."""
    urls.select("url").write.mode("overwrite").option("maxRecordsPerFile", size).text(f"{frontier.rstrip('/')}/level={level}")


class FetchSource(DataSource):
    """Register with ``spark.dataSource.register(FetchSource)``."""

    @classmethod
    def name(cls) -> str:
        return "linkloom_fetch"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Frontier(self.options)


def retry_seconds(value: str | None, now: float) -> float:
    """Seconds of a Retry-After header: a finite number or an HTTP date, else 0."""
    if re.fullmatch(NUMBER, value or ""):
        return max(0.0, float(value))
    try:
        return max(0.0, parsedate_to_datetime(value).timestamp() - now) if value else 0.0
    except (ValueError, TypeError):
        return 0.0


class Patience:
    """The backoff that all requests of a task share: throttled answers in a row lengthen it, others shorten it."""

    def __init__(self, config: CrawlConfig, sleep=time.sleep, now=time.time, spread=random.random):
        self.config, self.sleep, self.now, self.spread, self.streak = config, sleep, now, spread, 0

    def fetch(self, url: str) -> tuple:
        """fetch with retries of throttled answers (429, 503): after Retry-After, or 5 s doubling, spread by 0.85 to 1.15, at most max_backoff."""
        headers = request_headers(self.config.user_agent, self.config.browser)
        for attempt in range(self.config.max_retries + 1):
            row = fetch(url, "GET", headers, self.config.timeout / 1000, most=max(self.config.max_doc_bytes, 1))
            if row[1] not in (429, 503):
                self.streak = max(0, self.streak - 1)
                return row
            self.streak += 1
            if attempt == self.config.max_retries:
                return row
            wait = retry_seconds(row[3], self.now()) or BACKOFF_MS / 1000 * 2 ** min(self.streak - 1, 30)
            self.sleep(min(self.config.max_backoff, wait) * (0.85 + 0.3 * self.spread()))
        raise AssertionError("unreachable")


def fetch_table(urls: DataFrame, config: CrawlConfig) -> DataFrame:
    """Responses (schemas.RESPONSE) of a table's urls, fetched by at most ``concurrency`` tasks that keep the request gap between them."""
    n = config.concurrency
    pause = max(request_gap_ms(config.rps, config.crawl_delay) * n, config.delay) / 1000

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        patience = Patience(config)
        for frame in frames:
            rows = []
            for url in frame["url"]:
                rows.append(patience.fetch(url))
                time.sleep(pause)
            yield pd.DataFrame(rows, columns=["url", "status", "content_type", "retry_after", "body", "error"])

    got = urls.select("url").repartition(n).mapInPandas(run, SCHEMA)
    path = F.regexp_extract("url", r"^[A-Za-z][^:]*://[^/?#]*([^?#]*)", 1)
    gate = content_gate(F.col("content_type"), path, config.scan_docs)
    html = F.when(gate == "html", F.decode("body", "UTF-8"))
    doc = F.when((gate == "doc") | (gate == "sniff") & sniff(F.col("body")).isNotNull(), F.col("body"))
    return got.select("url", "status", F.coalesce("content_type", F.lit("")).alias("content_type"), "retry_after", html.alias("html"), doc.alias("doc"), F.coalesce(document_type(F.col("content_type"), path), sniff(F.col("body"))).alias("doc_type"), "error")


def probe_table(urls: DataFrame, config: CrawlConfig) -> DataFrame:
    """(url, status, error): a HEAD, and a GET where it is doubtful; the GET wins if it is answered."""
    headers = request_headers(config.user_agent, config.browser)

    def one(url: str) -> tuple:
        status, error = (fetch(url, "HEAD", headers, config.timeout / 1000)[k] for k in (1, 5))
        if error or status in HEAD_DOUBTFUL or status >= 500:
            got = fetch(url, "GET", headers, config.timeout / 1000, most=0)
            if got[1]:
                return url, got[1], got[5]
            return url, status, (got[5] or error) if status == 0 else error
        return url, status, error

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([one(u) for u in frame["url"]], columns=["url", "status", "error"])

    return urls.select("url").repartition(config.concurrency).mapInPandas(run, "url string, status int, error string")


def crawl_delay(spark: SparkSession, config: CrawlConfig) -> float:
    """The crawl delay in seconds: the option, else that of the start origin's robots.txt for us, 0 on any failure."""
    from linkloom.sources.readers import robots_delay

    if config.crawl_delay or config.ignore_robots:
        return config.crawl_delay
    start = whatwg.parse(config.start_url)
    port = "" if start.port is None else f":{start.port}"
    row = fetch(f"{start.scheme}://{start.host}{port}/robots.txt", "GET", request_headers(config.user_agent, config.browser), config.timeout / 1000)
    if not 0 < row[1] < 400 or not row[4]:
        return 0.0
    lines = spark.createDataFrame(list(enumerate(row[4].decode("utf-8", "replace").splitlines())), "line int, value string")
    return robots_delay(lines, config.user_agent).first().delay
