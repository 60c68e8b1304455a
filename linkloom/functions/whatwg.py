"""URL parsing and resolution as browsers do it (the public URL standard), in plain Python.

Used inside Arrow functions for hrefs that the SQL fast path of ``urls.resolve`` can't take.
"""

from __future__ import annotations

import ipaddress
import re
import unicodedata
from dataclasses import dataclass, field
from urllib.parse import unquote_to_bytes

#: Fixed values of the standard: default ports of special schemes and percent-encode sets.
SPECIAL = {"http": 80, "https": 443, "ws": 80, "wss": 443, "ftp": 21, "file": None}
FRAGMENT = set(' "<>`')
QUERY = set(' "#<>')
PATH = QUERY | set("?^`{}")
USERINFO = PATH | set("/:;=@[\\]|")
FORBIDDEN_HOST = set("\0\t\n\r #/:<>?@[\\]^|%") | {chr(c) for c in range(32)} | {"\x7f"}


class BadUrl(ValueError):
    """The input is no URL."""


def _encode(text: str, unsafe: set[str]) -> str:
    return "".join(c if " " <= c < "\x7f" and c not in unsafe else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in text)


@dataclass
class Url:
    """A parsed URL; ``opaque`` holds the path of URLs like mailto:."""

    scheme: str
    username: str = ""
    password: str = ""
    host: str | None = None
    port: int | None = None
    path: list[str] = field(default_factory=list)
    opaque: str | None = None
    query: str | None = None
    fragment: str | None = None

    @property
    def pathname(self) -> str:
        return self.opaque if self.opaque is not None else "".join("/" + p for p in self.path)

    @property
    def href(self) -> str:
        out = self.scheme + ":"
        if self.host is not None:
            out += "//"
            if self.username or self.password:
                out += self.username + (":" + self.password if self.password else "") + "@"
            out += self.host + (f":{self.port}" if self.port is not None else "")
        elif self.opaque is None and len(self.path) > 1 and self.path[0] == "":
            out += "/."
        out += self.pathname
        if self.query is not None:
            out += "?" + self.query
        return out + ("#" + self.fragment if self.fragment is not None else "")


def _ipv4(host: str) -> str | None:
    labels = host.split(".")
    if labels[-1] == "" and len(labels) > 1:
        labels.pop()
    if not (re.fullmatch(r"[0-9]+", labels[-1]) or re.fullmatch(r"0[xX][0-9A-Fa-f]*", labels[-1])):
        return None
    if len(labels) > 4:
        raise BadUrl(host)
    numbers = []
    for label in labels:
        if re.fullmatch(r"0[xX][0-9A-Fa-f]*", label):
            numbers.append(int(label[2:] or "0", 16))
        elif re.fullmatch(r"0[0-7]*", label):
            numbers.append(int(label, 8))
        elif re.fullmatch(r"[1-9][0-9]*", label):
            numbers.append(int(label))
        else:
            raise BadUrl(host)
    if any(n > 255 for n in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(numbers)):
        raise BadUrl(host)
    return str(ipaddress.IPv4Address(sum(n << 8 * (3 - i) for i, n in enumerate(numbers[:-1])) + numbers[-1]))


def _host(raw: str, special: bool) -> str:
    if raw.startswith("["):
        if not raw.endswith("]"):
            raise BadUrl(raw)
        try:
            return f"[{ipaddress.IPv6Address(raw[1:-1]).compressed}]"
        except ValueError as e:
            raise BadUrl(raw) from e
    if not special:
        if FORBIDDEN_HOST.difference("%") & set(raw):
            raise BadUrl(raw)
        return _encode(raw, set())
    name = unicodedata.normalize("NFKC", unquote_to_bytes(raw).decode("utf-8", "replace").lower()).lower()
    name = re.sub("[。．｡]", ".", name.replace("­", "").replace("​", ""))
    labels = [x if x.isascii() else "xn--" + x.encode("punycode").decode() for x in name.split(".")]
    name = ".".join(labels)
    if not name or FORBIDDEN_HOST & set(name):
        raise BadUrl(raw)
    return _ipv4(name) or name


def _authority(url: Url, raw: str) -> None:
    special = url.scheme in SPECIAL
    credentials, at, server = raw.rpartition("@")
    if at:
        user, _, word = credentials.partition(":")
        url.username, url.password = _encode(user, USERINFO), _encode(word, USERINFO)
    m = re.fullmatch(r"(\[[^\]]*\]|[^:]*)(?::(.*))?", server, re.S)
    if not m or (not m[1] and (special and url.scheme != "file" or at or m[2] is not None)):
        raise BadUrl(raw)
    if m[2]:
        if not re.fullmatch("[0-9]+", m[2]) or int(m[2]) > 65535:
            raise BadUrl(raw)
        url.port = None if int(m[2]) == SPECIAL.get(url.scheme) else int(m[2])
    url.host = _host(m[1], special) if m[1] else ""
    if url.scheme == "file" and url.host == "localhost":
        url.host = ""


def _walk(url: Url, raw: str, base: list[str]) -> None:
    special = url.scheme in SPECIAL
    parts = re.split(r"[/\\]" if special else "/", raw)
    out = list(base)
    for at, part in enumerate(parts):
        last, plain = at == len(parts) - 1, part.lower().replace("%2e", ".")
        if plain == "..":
            if out:
                out.pop()
            if last:
                out.append("")
        elif plain == ".":
            if last:
                out.append("")
        else:
            out.append(_encode(part, PATH))
    url.path = out


def parse(raw: str, base: Url | None = None) -> Url:
    """Parse a URL, relative to base where it has no scheme of its own."""
    text = re.sub("[\t\n\r]", "", raw.strip("".join(map(chr, range(33)))))
    text, hash_, fragment = text.partition("#")
    m = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", text)
    scheme = m[1].lower() if m else None
    if scheme is None and base is None or scheme is None and base.opaque is not None and (text or not hash_):
        raise BadUrl(raw)
    rest = text[m.end() :] if m else text
    special = (scheme or base.scheme) in SPECIAL
    slash = "/\\" if special else "/"
    if scheme and special and base and base.scheme == scheme and not (rest[:1] and rest[0] == "/" and rest[1:2] == "/"):
        if not (rest[:1] in ("/", "\\") and rest[1:2] in ("/", "\\") and rest[:1]):
            scheme = None  # a special URL without authority is relative to a base of its scheme
    url = Url(scheme or base.scheme)
    if scheme is not None and not special and rest[:1] != "/":
        path, mark, query = rest.partition("?")
        url.opaque = _encode(path, set())
        url.query = _encode(query, QUERY) if mark else None
    else:
        head, mark, query = rest.partition("?")
        if scheme is not None and special and scheme != "file":
            authority, path = True, re.sub(r"^[/\\]+", "", head)
        elif len(head) > 1 and head[0] in slash and head[1] in slash:
            authority, path = True, head[2:]
        else:
            authority, path = False, head
        if authority:
            end = min((path.find(c) for c in slash if c in path), default=len(path))
            _authority(url, path[:end])
            path = path[end:]
            if path or special:
                _walk(url, path[1:], [])
        else:
            if scheme is None:
                url.username, url.password, url.host, url.port, url.opaque = base.username, base.password, base.host, base.port, base.opaque
            elif scheme == "file":
                url.host = ""
            if scheme is None and not path:
                url.path = list(base.path)
                if not mark:
                    url.query = base.query
            elif path[:1] and path[0] in slash:
                _walk(url, path[1:], [])
            else:
                _walk(url, path, base.path[:-1] if scheme is None else [])
        if mark:
            url.query = _encode(query, QUERY | {"'"} if special else QUERY)
    if hash_:
        url.fragment = _encode(fragment, FRAGMENT)
    return url


def resolve(raw: str | None, base: str | None) -> str | None:
    """The absolute form of raw as found on base; None if malformed."""
    if raw is None or base is None:
        return None
    try:
        return parse(raw, parse(base)).href
    except (BadUrl, UnicodeError):
        return None
