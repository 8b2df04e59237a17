"""Paged HTTP sources: pagination, record selection, cursors, limits and an egress allow-list."""

from __future__ import annotations

import json
import re
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sluice.errors import ContractError

Fetch = Callable[[str, dict], tuple[bytes, dict]]


def select(document, path: str):
    """The value at a dotted path (``$`` is the whole); None where it is absent."""
    at = document
    for part in [p for p in path.lstrip("$").split(".") if p]:
        if not isinstance(at, dict) or part not in at:
            return None
        at = at[part]
    return at


def with_query(url: str, **params) -> str:
    parts = urllib.parse.urlsplit(url)
    query = dict(urllib.parse.parse_qsl(parts.query, keep_blank_values=True)) | {k: str(v) for k, v in params.items() if v is not None}
    return urllib.parse.urlunsplit(parts._replace(query=urllib.parse.urlencode(query)))


def link_next(headers: dict, url: str) -> str | None:
    """The rel="next" target of a Link header, resolved against the page's URL."""
    text = next((v for k, v in headers.items() if k.lower() == "link"), "")
    for target, rest in re.findall(r"<([^>]*)>([^<]*)", text):
        if re.search(r"""rel\s*=\s*"?[^";]*\bnext\b""", rest, re.I):
            return urllib.parse.urljoin(url, target)
    return None


@dataclass(frozen=True)
class Pagination:
    """kind: none, page, offset, cursor, next_token, link or auto (link header, then a next token or URL)."""

    kind: str = "auto"
    param: str = ""
    path: str = ""
    size: int = 100
    size_param: str = ""
    start: int = 1
    most_pages: int = 100_000

    def first(self, url: str) -> str:
        extra = {self.size_param: self.size} if self.size_param else {}
        if self.kind == "page":
            return with_query(url, **{self.param or "page": self.start}, **extra)
        if self.kind == "offset":
            return with_query(url, **{self.param or "offset": 0}, **extra)
        return with_query(url, **extra) if extra else url

    def following(self, url: str, document, headers: dict, records: int, page: int) -> str | None:
        """The next page's URL, or None after the last."""
        if self.kind == "none":
            return None
        if self.kind == "page":
            return with_query(url, **{self.param or "page": self.start + page}) if records else None
        if self.kind == "offset":
            return with_query(url, **{self.param or "offset": page * self.size}) if records >= self.size else None
        if self.kind in ("cursor", "next_token"):
            token = select(document, self.path or ("next_cursor" if self.kind == "cursor" else "next_token"))
            return with_query(url, **{self.param or ("cursor" if self.kind == "cursor" else "page_token"): token}) if token not in (None, "", False) else None
        if (found := link_next(headers, url)) is not None or self.kind == "link":
            return found
        for path, param in (("next_page_token", "page_token"), ("next_token", "page_token"), ("next_cursor", "cursor"), ("meta.next_cursor", "cursor"), ("next", ""), ("links.next", ""), ("paging.next", "")):
            token = select(document, path)
            if isinstance(token, (str, int)) and token not in ("", False):
                return with_query(url, **{param: token}) if param else urllib.parse.urljoin(url, str(token))
        return None


@dataclass(frozen=True)
class Endpoint:
    url: str
    records: str = "$"
    pagination: Pagination = Pagination()
    cursor_param: str | None = None
    cursor_field: str | None = None
    cursor_after: object = None
    headers: dict = field(default_factory=dict)
    allowed_hosts: tuple[str, ...] = ()
    attempts: int = 4


def check_egress(url: str, allowed: tuple[str, ...]) -> None:
    host = urllib.parse.urlsplit(url).hostname or ""
    if not any(host == a or (a.startswith("*.") and host.endswith(a[1:])) for a in allowed):
        raise ContractError(f"{host} is not an allowed host")


def wait_seconds(headers: dict, attempt: int, now: float) -> float:
    """How long rate-limit headers ask to wait; else a doubling pause."""
    low = {k.lower(): v for k, v in headers.items()}
    if low.get("retry-after", "").isdigit():
        return float(low["retry-after"])
    if low.get("x-ratelimit-remaining") == "0" and low.get("x-ratelimit-reset", "").isdigit():
        return max(0.0, float(low["x-ratelimit-reset"]) - now)
    return 0.2 * 2**attempt


def _http(url: str, headers: dict) -> tuple[bytes, dict]:
    with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=60) as reply:  # noqa: S310
        return reply.read(), dict(reply.headers)


def pages(endpoint: Endpoint, fetch: Fetch = _http) -> Iterator[list[dict]]:
    """Records page by page; failed requests are tried again within bounds, a page that repeats its URL is an error."""
    url = endpoint.pagination.first(endpoint.url)
    if endpoint.cursor_param and endpoint.cursor_after is not None:
        url = with_query(url, **{endpoint.cursor_param: endpoint.cursor_after})
    seen: set[str] = set()
    for page in range(1, endpoint.pagination.most_pages + 1):
        check_egress(url, endpoint.allowed_hosts)
        if url in seen:
            raise ContractError(f"page {url} follows itself")
        seen.add(url)
        body, headers = _tried(endpoint, url, fetch)
        document = json.loads(body)
        found = select(document, endpoint.records)
        found = [] if found is None else found if isinstance(found, list) else [found]
        yield found
        following = endpoint.pagination.following(url, document, headers, len(found), page)
        if following is None:
            return
        url = following
    raise ContractError("more pages than allowed")


def _tried(endpoint: Endpoint, url: str, fetch: Fetch) -> tuple[bytes, dict]:
    for attempt in range(endpoint.attempts):
        try:
            return fetch(url, endpoint.headers)
        except OSError as error:
            code = getattr(error, "code", None)
            if attempt + 1 == endpoint.attempts or (code is not None and code < 500 and code != 429):
                raise
            time.sleep(min(60.0, wait_seconds(dict(getattr(error, "headers", None) or {}), attempt, time.time())))
    raise ContractError("no attempt is allowed")


def records(endpoint: Endpoint, fetch: Fetch = _http) -> Iterator[dict]:
    """All records; with a cursor only those beyond it (a source may filter inexactly)."""
    for page in pages(endpoint, fetch):
        for r in page:
            if endpoint.cursor_field and endpoint.cursor_after is not None and not (r.get(endpoint.cursor_field) is not None and r[endpoint.cursor_field] > endpoint.cursor_after):
                continue
            yield r


class RestSource(DataSource):
    """Options: endpoint (JSON of the fields of ``Endpoint``).  Several endpoints, a list, are read in parallel."""

    @classmethod
    def name(cls) -> str:
        return "sluice_rest"

    def schema(self) -> str:
        return "record string"

    def reader(self, schema) -> DataSourceReader:
        return _RestReader(json.loads(self.options["endpoint"]))


class _Endpoint(InputPartition):
    pass


class _RestReader(DataSourceReader):
    def __init__(self, endpoints) -> None:
        self.endpoints = endpoints if isinstance(endpoints, list) else [endpoints]

    def partitions(self) -> list[InputPartition]:
        return [_Endpoint(e) for e in self.endpoints]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        spec = dict(partition.value)
        spec["pagination"] = Pagination(**spec.get("pagination", {}))
        spec["allowed_hosts"] = tuple(spec.get("allowed_hosts", ()))
        for r in records(Endpoint(**spec)):
            yield (json.dumps(r),)


def read_rest(spark: SparkSession, endpoints: list[dict], schema: str) -> DataFrame:
    """Records of REST endpoints under a schema; one task per endpoint."""
    from pyspark.sql import functions as F

    spark.dataSource.register(RestSource)
    raw = spark.read.format("sluice_rest").option("endpoint", json.dumps(endpoints)).load()
    return raw.select(F.from_json("record", schema).alias("r")).select("r.*")
