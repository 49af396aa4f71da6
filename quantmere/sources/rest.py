"""REST sources: paginated JSON as a Python data source, one partition per symbol.

The vendors differ in a description: path, parameters, where the rows are and
how fields are named.  The transport is a callable, so tests need no network.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import AuthError, MalformedDataError, NotFoundError, QuotaError, TransientError

#: Default look-back in days by interval.
LOOKBACK = {"1m": 7, "2m": 60, "5m": 60, "15m": 60, "30m": 60, "60m": 730, "1h": 730, "1d": 365, "1wk": 365, "1mo": 365}
PAGES = 10_000


def default_start(interval: str, end: datetime) -> datetime:
    return end - timedelta(days=LOOKBACK.get(interval, 365))


def http_get(url: str, params: dict, headers: dict, *, timeout: float = 30.0, attempts: int = 4) -> dict | list:
    """GET with exponential waits on 429, 5xx and connection errors."""
    full = f"{url}?{urllib.parse.urlencode(params)}" if params else url
    for k in range(attempts):
        try:
            with urllib.request.urlopen(urllib.request.Request(full, headers=headers), timeout=timeout) as r:
                return json.load(r)
        except urllib.error.HTTPError as e:
            if e.code in (401, 403):
                raise AuthError(str(e)) from e
            if e.code == 404:
                raise NotFoundError(str(e)) from e
            if e.code != 429 and e.code < 500:
                raise MalformedDataError(str(e)) from e
            error: Exception = QuotaError(str(e)) if e.code == 429 else TransientError(str(e))
        except (urllib.error.URLError, TimeoutError) as e:
            error = TransientError(str(e))
        if k + 1 < attempts:
            time.sleep(2.0**k)
    raise error


@dataclass
class Vendor:
    """How one market-data service is asked and answers."""

    base_url: str
    path: str = "/{symbol}"
    params: dict[str, str] = field(default_factory=dict)
    headers: dict[str, str] = field(default_factory=dict)
    rows: str | None = None  # dotted place of the row list; None: the answer itself
    fields: dict[str, str] = field(default_factory=lambda: {"ts": "date", "open": "open", "high": "high", "low": "low", "close": "close", "volume": "volume"})
    adjusted: str | None = None  # field that replaces close
    keyed: bool = False  # rows come as {time: row}
    paged: bool = False
    cursor: str | None = None  # parameter that takes the last time in ms + 1
    limit: int = 1000


#: Descriptions of well-known public services, by name.
VENDORS: dict[str, Vendor] = {
    "daily_rest": Vendor("https://api.example.com", "/historical/{symbol}", rows="historical", adjusted="adjClose"),
    "keyed_series": Vendor(
        "https://api.example.com", "/query", {"function": "TIME_SERIES_DAILY", "symbol": "{symbol}"}, rows="Time Series (Daily)", keyed=True,
        fields={"ts": "", "open": "1. open", "high": "2. high", "low": "3. low", "close": "4. close", "volume": "5. volume"},
    ),
    "candles": Vendor("https://api.example.com", "/candles", {"symbol": "{symbol}", "timeframe": "{interval}"}, rows="candles", paged=True, fields={"ts": "t", "open": "o", "high": "h", "low": "l", "close": "c", "volume": "v"}),
    "exchange_klines": Vendor("https://api.example.com", "/klines", {"symbol": "{symbol}", "interval": "{interval}", "limit": "1000"}, cursor="startTime", fields={"ts": "0", "open": "1", "high": "2", "low": "3", "close": "4", "volume": "5"}),
}


def _time(value) -> datetime:
    """ISO text or epoch (s or ms) as UTC without a zone."""
    try:
        if isinstance(value, (int, float)) or (isinstance(value, str) and value.isdigit() and len(value) > 8):
            v = float(value)
            return datetime.fromtimestamp(v / 1000 if v > 1e11 else v, timezone.utc).replace(tzinfo=None)
        t = datetime.fromisoformat(str(value).replace("Z", "+00:00"))
        return t.astimezone(timezone.utc).replace(tzinfo=None) if t.tzinfo else t
    except ValueError as e:
        raise MalformedDataError(f"bad time {value!r}") from e


def parse_rows(payload, vendor: Vendor, symbol: str) -> Iterator[tuple]:
    """(asset, ts, open, high, low, close, volume) of one answer."""
    rows = payload
    for part in (vendor.rows or "").split(".") if vendor.rows and vendor.rows not in (payload if isinstance(payload, dict) else ()) else [vendor.rows] if vendor.rows else []:
        if not isinstance(rows, dict) or part not in rows:
            raise MalformedDataError(f"no {vendor.rows!r} in the answer")
        rows = rows[part]
    items = rows.items() if vendor.keyed else ((None, r) for r in rows)
    for when, r in items:
        get = (lambda k, r=r: r[int(k)] if isinstance(r, list) else r.get(k))
        try:
            f = vendor.fields
            close = get(vendor.adjusted) if vendor.adjusted and get(vendor.adjusted) is not None else get(f["close"])
            yield (symbol, _time(when if vendor.keyed else get(f["ts"])), *(float(get(f[k])) for k in ("open", "high", "low")), float(close), float(get(f["volume"]) or 0))
        except (TypeError, ValueError, KeyError, IndexError) as e:
            raise MalformedDataError(f"{symbol}: {e}") from e


def fetch(vendor: Vendor, symbol: str, interval: str, start: datetime | None, end: datetime | None, get: Callable = http_get) -> Iterator[tuple]:
    """All bars of a symbol, page by page."""
    fill = lambda s: s.format(symbol=symbol, interval=interval)
    params = {k: fill(v) for k, v in vendor.params.items()}
    inside = lambda r: (start is None or r[1] >= start) and (end is None or r[1] <= end)
    since = start
    for page in range(1, PAGES + 1):
        ask = dict(params)
        if vendor.paged:
            ask["page"] = str(page)
        if vendor.cursor and since is not None:
            ask[vendor.cursor] = str(int(since.replace(tzinfo=timezone.utc).timestamp() * 1000))
        payload = get(vendor.base_url + fill(vendor.path), ask, vendor.headers)
        rows = list(parse_rows(payload, vendor, symbol))
        yield from filter(inside, rows)
        if vendor.cursor:
            if len(rows) < vendor.limit or (end is not None and rows[-1][1] >= end):
                return
            since = rows[-1][1] + timedelta(milliseconds=1)
        elif vendor.paged and isinstance(payload, dict) and (payload.get("has_next") or page < int(payload.get("total_pages") or 0)):
            continue
        else:
            return
    raise MalformedDataError(f"more than {PAGES} pages")


SCHEMA = "asset string, ts timestamp_ntz, open double, high double, low double, close double, volume double"


class _Symbol(InputPartition):
    pass


class RestBarsReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.o = options

    def partitions(self) -> list[InputPartition]:
        return [_Symbol(s.strip()) for s in self.o["symbols"].split(",") if s.strip()]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        vendor = VENDORS[self.o.get("vendor", "daily_rest")]
        when = lambda k: _time(self.o[k]) if k in self.o else None
        yield from fetch(vendor, partition.value, self.o.get("interval", "1d"), when("start"), when("end"))


class RestBars(DataSource):
    """``spark.read.format("rest_bars").option("vendor", ..).option("symbols", "A,B")``."""

    @classmethod
    def name(cls) -> str:
        return "rest_bars"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return RestBarsReader(dict(self.options))
