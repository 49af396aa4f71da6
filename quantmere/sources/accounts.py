"""Account statements: sectioned CSV exports, NAV, flows, positions and trades."""

from __future__ import annotations

import csv
import io
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import AmbiguousError, MalformedDataError
from ..operators.nav import attribute_to_next, returns_from_nav, signed_flows, synthetic_nav

HEADER = "ClientAccountID"
#: Columns by which a section is known.
SECTIONS = {
    "nav": {"ReportDate", "Total"},
    "cash": {"Date/Time", "Amount", "Type"},
    "positions": {"Symbol", "Position", "MarkPrice"},
    "trades": {"Symbol", "TradeDate", "TradePrice"},
}
FLOW_TYPES = ("deposit", "withdrawal")


@dataclass
class Statement:
    """Raw sections of an export, as rows by column name."""

    sections: dict[str, list[dict[str, str]]] = field(default_factory=dict)
    unknown: list[list[str]] = field(default_factory=list)


def parse_statement(text: str, *, require_nav: bool = True, require_cash: bool = False, strict: bool = False) -> Statement:
    """Split at header lines, name each section by its columns; several of one kind are joined."""
    out, columns, kind = Statement(), None, None
    for row in csv.reader(io.StringIO(text)):
        if not row:
            continue
        if row[0] == HEADER:
            columns = row
            kind = next((k for k, need in SECTIONS.items() if need <= set(row)), None)
            if kind is None:
                if strict:
                    raise MalformedDataError(f"unknown section {row}")
                out.unknown.append(row)
        elif columns is None:
            raise MalformedDataError("rows before the first header")
        elif kind:
            if len(row) != len(columns):
                raise MalformedDataError(f"{kind}: {len(row)} fields for {len(columns)} columns")
            out.sections.setdefault(kind, []).append(dict(zip(columns, row, strict=True)))
    for need, k in ((require_nav, "nav"), (require_cash, "cash")):
        if need and not out.sections.get(k):
            raise MalformedDataError(f"no {k} section")
    return out


def _date(text: str) -> datetime:
    for form in ("%Y%m%d;%H%M%S", "%Y%m%d", "%Y-%m-%d"):
        try:
            return datetime.strptime(text, form)
        except ValueError:
            continue
    raise MalformedDataError(f"bad date {text!r}")


def _number(text: str, name: str) -> float:
    try:
        return float(text.replace(",", ""))
    except ValueError as e:
        raise MalformedDataError(f"{name}: bad number {text!r}") from e


class StatementAccounts:
    """NAV and flows of a sectioned export; a statement is a small file, parsed on the driver."""

    def __init__(self, spark: SparkSession, *texts: str) -> None:
        self.spark = spark
        merged = [parse_statement(t) for t in texts]
        self.nav_rows = [r for s in merged for r in s.sections.get("nav", [])]
        self.cash_rows = [r for s in merged for r in s.sections.get("cash", [])]
        self.position_rows = [r for s in merged for r in s.sections.get("positions", [])]
        self.trade_rows = [r for s in merged for r in s.sections.get("trades", [])]

    def raw_nav(self) -> DataFrame:
        rows = {(r[HEADER], _date(r["ReportDate"])): (r[HEADER], _date(r["ReportDate"]), r.get("CurrencyPrimary"), _number(r["Total"], "Total")) for r in self.nav_rows}
        return self.spark.createDataFrame(list(rows.values()), "account string, ts timestamp, currency string, nav double")

    def flows(self) -> DataFrame:
        """Deposits and withdrawals in base currency, sign as type, amounts positive."""
        out = []
        for r in self.cash_rows:
            if not any(k in r["Type"].lower() for k in FLOW_TYPES):
                continue
            rate = _number(r["FXRateToBase"], "FXRateToBase") if r.get("FXRateToBase", "").strip() else 1.0
            amount = _number(r["Amount"], "Amount") * rate
            if amount:
                out.append((r[HEADER], datetime.combine(_date(r["Date/Time"]).date(), datetime.min.time()), "INJECTION" if amount > 0 else "WITHDRAWAL", abs(amount), r.get("CurrencyPrimary"), r.get("Description")))
        return self.spark.createDataFrame(out, "account string, ts timestamp, flow_type string, amount double, currency string, notes string")

    def nav(self, *, adjust_for_flows: bool = True) -> DataFrame:
        """NAV by date; adjusted, the path that the first funded NAV would have taken without flows."""
        nav = self.raw_nav()
        if not adjust_for_flows:
            return nav
        return synthetic_nav(nav.join(signed_flows(self.flows(), nav), ["account", "ts"], "left"))

    def list_accounts(self) -> DataFrame:
        nav = self.raw_nav().groupBy("account").agg(F.count_distinct("currency").alias("n"), F.first("currency").alias("currency"), F.min("ts").alias("first"), F.max("ts").alias("last"))
        if nav.filter("n > 1").limit(1).count():
            raise AmbiguousError("an account with several currencies")
        return nav.drop("n")

    def positions(self) -> DataFrame:
        rows = [(r[HEADER], r["Symbol"], _number(r["Position"], "Position"), _number(r["MarkPrice"], "MarkPrice")) for r in self.position_rows]
        return self.spark.createDataFrame(rows, "account string, asset string, qty double, price double")

    def trades(self) -> DataFrame:
        rows = [(r[HEADER], _date(r["TradeDate"]), r["Symbol"], _number(r.get("Quantity", "0"), "Quantity"), _number(r["TradePrice"], "TradePrice")) for r in self.trade_rows]
        return self.spark.createDataFrame(rows, "account string, ts timestamp, asset string, qty double, price double")

    def to_returns(self, *, basis: str = "aum", method: str = "daily_twr") -> DataFrame:
        return account_returns(self.raw_nav(), self.flows(), basis=basis, method=method)


def account_returns(nav: DataFrame, flows: DataFrame, *, basis: str = "nav_per_share", method: str = "total_return") -> DataFrame:
    """Returns of accounts from NAV and flows.

    nav_per_share takes (account, ts, nav, shares) and adds distributions per share;
    aum takes total NAV and needs a method that removes flows.
    """
    if basis == "nav_per_share":
        if method not in ("none", "total_return"):
            raise ValueError("per-share NAV goes with 'none' or 'total_return'")
        per = attribute_to_next(flows.filter(F.col("flow_type") == "DISTRIBUTION"), nav)
        joined = nav.join(per, ["account", "ts"], "left")
        shares = F.col("shares") if "shares" in nav.columns else F.lit(1.0)
        return returns_from_nav(joined.withColumn("dist", F.try_divide(F.coalesce("amount", F.lit(0.0)), shares)), method=method)
    if basis != "aum":
        raise ValueError("basis is 'nav_per_share' or 'aum'")
    if method == "total_return":
        raise ValueError("total NAV needs 'none', 'modified_dietz' or 'daily_twr'")
    return returns_from_nav(nav.join(signed_flows(flows, nav), ["account", "ts"], "left"), method=method)
