"""Crawl options with their bounds."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, fields, replace

from linkloom.functions import urls, whatwg

#: Words for "no limit".
UNLIMITED = re.compile(r"(?:none|unlimited|all|inf|infinity)\Z", re.I)
BROWSER_AGENT = "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/124.0.0.0 Safari/537.36"


def limit(value: str | int | float | None, least: int) -> int | None:
    """A count, or None for no limit: a word for it, infinity or a negative number."""
    if value is None or isinstance(value, str) and UNLIMITED.match(value):
        return None
    number = float(value)
    return None if number < 0 or number == float("inf") else max(least, int(number))


@dataclass(frozen=True)
class CrawlConfig:
    """Options of a crawl. Out-of-range numbers are held to their bounds, not refused."""

    start_url: str = ""
    max_pages: int | None = 200
    max_depth: int | None = 3
    scope: str = "domain"
    path_prefix: str = ""
    concurrency: int = 4
    delay: float = 100
    rps: float = 0
    timeout: float = 20_000
    recheck: bool = True
    scan_docs: bool = True
    max_doc_bytes: int = 25 * 1024 * 1024
    max_retries: int = 5
    max_backoff: float = 300
    crawl_delay: float = 0
    ignore_robots: bool = False
    max_urls: int = 0
    max_referrers: int = 0
    seen: str = "memory"
    seen_file: str = "crawl-seen.idx"
    checkpoint: int = 25
    log: str = "crawl-progress.log"
    log_max_bytes: int = 5 * 1024 * 1024
    stop_file: str = ""
    pause_file: str = ""
    tune_file: str = ""
    include_subdomains: bool = False
    check_external: bool = False
    browser: bool = False
    user_agent: str = ""
    allowlist: str = "crawl-allowlist.txt"
    suggest: str = "crawl-allowlist.suggested.txt"
    out: str = "crawl-report.html"
    json: str = ""
    paginate: bool = False
    page_size: int = 1000
    allowlist_export: bool = False
    state: str = ""
    resume: str = ""
    recheck_from: str = ""
    rebuild_from: str = ""

    def __post_init__(self) -> None:
        put = lambda name, value: object.__setattr__(self, name, value)
        put("max_pages", limit(self.max_pages, 1))
        put("max_depth", limit(self.max_depth, 0))
        for name, least in (("delay", 0), ("rps", 0), ("timeout", 1000), ("max_doc_bytes", 0), ("max_retries", 0), ("max_backoff", 1), ("crawl_delay", 0), ("max_urls", 0), ("max_referrers", 0), ("checkpoint", 0), ("log_max_bytes", 0), ("page_size", 1)):
            put(name, max(least, getattr(self, name)))
        put("concurrency", max(1, min(32, self.concurrency)))
        if self.path_prefix:
            put("scope", "path")
        if self.scope not in ("domain", "path") or self.seen not in ("memory", "compact", "disk"):
            raise ValueError(f"scope {self.scope!r} or seen {self.seen!r} is unknown")
        if self.resume and not self.state:
            put("state", self.resume)
        if not self.user_agent:
            put("user_agent", BROWSER_AGENT if self.browser else "linkloom/1.0")
        if self.start_url:
            whatwg.parse(self.start_url)

    def prefix(self) -> str:
        """The path prefix that confines the crawl."""
        return urls.scope_prefix(self.start_url, self.scope, self.path_prefix)

    def url_cap(self) -> int | None:
        """The most distinct urls to remember: max_urls, else 50 times max_pages; compact and disk stores are bounded in any case."""
        cap = self.max_urls or (None if self.max_pages is None else self.max_pages * 50)
        return 1_000_000 if cap is None and self.seen != "memory" else cap

    def tuned(self, content: str) -> CrawlConfig:
        """With the pacing that a tune file's JSON sets; other keys and bad numbers are ignored."""
        try:
            given = json.loads(content)
        except ValueError:
            return self
        names = {"delay": "delay", "rps": "rps", "crawlDelay": "crawl_delay", "timeout": "timeout"}
        number = lambda v: isinstance(v, int | float) and not isinstance(v, bool)
        return replace(self, **{ours: given[theirs] for theirs, ours in names.items() if isinstance(given, dict) and number(given.get(theirs))})


def _flags() -> dict[str, tuple[str, object]]:
    """Option text to (field, constant) of those without a value."""
    out = {f"--{f.name.replace('_', '-')}": (f.name, True) for f in fields(CrawlConfig) if f.type == "bool"}
    out |= {f"--no-{n}": (n.replace("-", "_"), False) for n in ("recheck", "scan-docs", "paginate", "allowlist-export")}
    return out | {"--no-log": ("log", "")}


def parse_options(argv: list[str]) -> list[CrawlConfig]:
    """Configs from command-line options, one for each start url (or one, for a saved report)."""
    flags, typed, starts, given = _flags(), {f"--{f.name.replace('_', '-')}": f for f in fields(CrawlConfig) if f.type != "bool" and f.name != "start_url"}, [], {}
    words = iter(argv)
    for word in words:
        if word in flags:
            given[flags[word][0]] = flags[word][1]
        elif word in typed:
            value = next(words, None)
            if value is None:
                raise ValueError(f"no value for {word}")
            field = typed[word]
            if field.name in ("scope", "seen"):
                value = value.lower()
            if field.type != "str" and not (field.name in ("max_pages", "max_depth") and UNLIMITED.match(value)):
                value = float(value) if "float" in field.type else int(float(value))
            given[field.name] = value
            if field.name == "page_size":
                given["paginate"] = True
        elif word.startswith("-"):
            raise ValueError(f"unknown option {word}")
        else:
            starts.append(word)
    if not starts and not given.get("recheck_from") and not given.get("rebuild_from"):
        raise ValueError("no start url")
    return [CrawlConfig(start_url=s, **given) for s in starts or [""]]


def effective(saved: dict | None, config: CrawlConfig) -> dict:
    """Settings to show: a saved report's where it has them, else the config's."""
    names = {"concurrency": "concurrency", "delay": "delay", "rps": "rps", "maxPages": "max_pages", "maxDepth": "max_depth", "includeSubdomains": "include_subdomains", "checkExternal": "check_external"}
    return {theirs: saved[theirs] if saved and theirs in saved else getattr(config, ours) for theirs, ours in names.items()}
