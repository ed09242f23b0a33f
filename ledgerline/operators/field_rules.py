"""How fields of the four sheets are filled from one another (D-5): a declarative map, compiled to one projection a stage.

A rule names its mode and, if it has one, a source in another sheet; a derivation names what it reads. The compiler orders rules by what they read of other
rules' fields, refuses cycles, and puts all rules whose inputs are settled into one projection, so the plan is a join of the sheets and a few
projections, whatever the number of rules."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.statements import KEY

#: Modes and sources of the fields that have rules, by sheet.
RULES: dict[str, dict[str, tuple[str, str | None]]] = {
    "balance": {
        "asset_liability_ratio": ("direct_or_derive", None),
        "equity_total_equity": ("direct_or_derive", None),
        "liability_contract_liabilities": ("direct_or_reuse", "liability_advance_from_customers"),
    },
    "cash": {
        "net_cash_flow": ("direct_or_derive", None),
        "operating_cf_ratio_of_net_cf": ("direct_or_derive", None),
        "investing_cf_ratio_of_net_cf": ("direct_or_derive", None),
        "financing_cf_ratio_of_net_cf": ("direct_or_derive", None),
    },
    "kpi": {
        "eps": ("direct", None),
        "total_operating_revenue": ("direct_or_reuse", "income.total_operating_revenue"),
        "operating_revenue_yoy_growth": ("direct_or_reuse", "income.operating_revenue_yoy_growth"),
        "operating_revenue_qoq_growth": ("direct_or_derive", None),
        "net_profit_10k_yuan": ("direct_or_reuse", "income.net_profit"),
        "net_profit_yoy_growth": ("direct_or_reuse", "income.net_profit_yoy_growth"),
        "net_profit_qoq_growth": ("direct_or_derive", None),
        "net_asset_per_share": ("direct_or_derive", None),
        "roe": ("direct_or_derive", None),
        "operating_cf_per_share": ("direct_or_derive", None),
        "net_profit_excl_non_recurring": ("direct", None),
        "net_profit_excl_non_recurring_yoy": ("direct_or_derive", None),
        "gross_profit_margin": ("direct_or_derive", None),
        "net_profit_margin": ("direct_or_derive", None),
        "roe_weighted_excl_non_recurring": ("direct_or_derive", None),
    },
}
#: Parts of names of percentages, and the size from which on one is suspicious.
PERCENTAGES, SUSPICIOUS = ("yoy", "qoq", "ratio", "margin", "roe"), 1_000.0
MODES = ("direct", "reuse", "direct_or_reuse", "prefer_reuse", "derive", "direct_or_derive", "prefer_derive")


class Derivation(NamedTuple):
    """What a field can be computed from: the fields it reads (sheet.field) and a function of their columns."""

    reads: tuple[str, ...]
    value: Callable[..., Column]


def _some(a: Column, b: Column) -> Column:
    """a, or b where a is missing or 0."""
    return F.coalesce(F.nullif(a, F.lit(0.0)), b)


def _shares(profit: Column, eps: Column) -> Column:
    """The number of shares that profit (10k) and earnings a share imply, if it is between a million and a trillion."""
    n = F.try_divide(profit * 10_000, eps)
    return F.when(F.abs(n).between(1e6, 1e12), n)


def _percent(a: Column, b: Column) -> Column:
    return F.try_divide(a, b) * 100


_R, _P = ("income.total_operating_revenue", "kpi.total_operating_revenue"), ("income.net_profit", "kpi.net_profit_10k_yuan")
_EQUITY, _NET = "balance.equity_total_equity", "cash.net_cash_flow"
DERIVATIONS: dict[str, Derivation] = {
    "balance.asset_liability_ratio": Derivation(("balance.liability_total_liabilities", "balance.asset_total_assets"), _percent),
    "balance.equity_total_equity": Derivation(("balance.asset_total_assets", "balance.liability_total_liabilities"), lambda a, b: a - b),
    "cash.net_cash_flow": Derivation(tuple(f"cash.{x}_cf_net_amount" for x in ("operating", "investing", "financing")), lambda a, b, c: a + b + c),
    **{f"cash.{x}_cf_ratio_of_net_cf": Derivation((f"cash.{x}_cf_net_amount", _NET), _percent) for x in ("operating", "investing", "financing")},
    "kpi.net_asset_per_share": Derivation((_EQUITY, *_P, "kpi.eps"), lambda e, p, own, eps: F.try_divide(e * 10_000, _shares(_some(p, own), eps))),
    "kpi.operating_cf_per_share": Derivation(("cash.operating_cf_net_amount", *_P, "kpi.eps"), lambda c, p, own, eps: F.try_divide(c * 10_000, _shares(_some(p, own), eps))),
    "kpi.roe": Derivation((*_P, _EQUITY), lambda p, own, e: _percent(_some(p, own), e)),
    "kpi.roe_weighted_excl_non_recurring": Derivation(("kpi.net_profit_excl_non_recurring", _EQUITY), _percent),
    "kpi.gross_profit_margin": Derivation((*_R, "income.operating_expense_cost_of_sales"), lambda r, own, c: _percent(_some(r, own) - c, _some(r, own))),
    "kpi.net_profit_margin": Derivation((*_P, *_R), lambda p, own_p, r, own: _percent(_some(p, own_p), _some(r, own))),
}


def stages(rules: dict[str, dict[str, tuple[str, str | None]]] = RULES, derivations: dict[str, Derivation] = DERIVATIONS) -> list[list[str]]:
    """The fields with rules (sheet.field) in stages: each reads only fields without rules and those of earlier stages. Raises ValueError for cycles and
    unknown modes."""
    modes = {f"{sheet}.{field}": (mode, source) for sheet, fields in rules.items() for field, (mode, source) in fields.items()}
    if odd := sorted({m for m, _ in modes.values()} - {*MODES}):
        raise ValueError(f"unknown modes: {', '.join(odd)}")

    def reads(name: str) -> set[str]:
        mode, source = modes[name]
        used = {source} if source and "reuse" in mode else set()
        return (used | {*derivations[name].reads} if "derive" in mode and name in derivations else used) - {name}

    left = {name: reads(name) & {*modes} for name in modes}
    out: list[list[str]] = []
    while left:
        ready = [name for name, needs in left.items() if not needs & {*left}]
        if not ready:
            raise ValueError(f"rules read one another: {', '.join(sorted(left))}")
        out.append(ready)
        left = {name: needs for name, needs in left.items() if name not in ready}
    return out


def filled(name: str, mode: str, own: Column, source: Column | None, derived: Column | None) -> Column:
    """A field by its mode. Percentages beyond SUSPICIOUS count as missing where a field is derived, and go where it is read only directly."""
    percentage = any(p in name for p in PERCENTAGES)
    suspicious = F.abs(own) > SUSPICIOUS if percentage else F.lit(False)
    if mode == "direct":
        return F.when(~F.coalesce(suspicious, F.lit(False)), own)
    if "reuse" in mode:
        return own if source is None else F.coalesce(source, own) if mode == "prefer_reuse" else F.coalesce(own, source)
    if derived is None:
        return own
    return F.coalesce(derived, own) if mode == "prefer_derive" else F.coalesce(F.when(~suspicious, own), derived, own)


def joined(sheets: dict[str, DataFrame]) -> DataFrame:
    """The key, has_<sheet>, and <sheet>.<field> of all sheets: a row for each record that any sheet has."""
    parts = [df.select(*KEY, F.lit(True).alias(f"has_{s}"), *[F.col(c).cast("double").alias(f"{s}.{c}") for c, t in df.dtypes if c not in (*KEY, "stock_abbr", "serial_number") and t != "string"]) for s, df in sheets.items()]
    return reduce(lambda a, b: a.join(b, KEY, "full_outer"), parts)


def apply_rules(sheets: dict[str, DataFrame], rules: dict[str, dict[str, tuple[str, str | None]]] = RULES, derivations: dict[str, Derivation] = DERIVATIONS) -> DataFrame:
    """The joined sheets with all rules applied. A field that no sheet has is missing; sources without a sheet name nothing; records of a sheet
    that has no row are left as they are. At last revenue and profit of key figures are those of income where they are missing."""
    wide = joined(sheets)
    named = {*wide.columns, *(f"{s}.{f}" for s, fields in rules.items() for f in fields if s in sheets)}
    read = lambda c: F.col(f"`{c}`") if c in wide.columns else F.lit(None).cast("double")
    for stage in stages(rules, derivations):
        new = {}
        for name in stage:
            sheet, field = name.split(".", 1)
            if name not in named:
                continue
            mode, source = rules[sheet][field]
            derived = derivations[name].value(*map(read, derivations[name].reads)) if name in derivations else None
            value = filled(field, mode, read(name), read(source) if source and "." in source else None, derived)
            new[name] = F.when(F.col(f"has_{sheet}"), value).otherwise(read(name))
        wide = wide.withColumns(new)
    last = {"kpi.total_operating_revenue": "income.total_operating_revenue", "kpi.net_profit_10k_yuan": "income.net_profit"}
    return wide.withColumns({k: F.when(F.col("has_kpi"), F.coalesce(read(k), read(v))).otherwise(read(k)) for k, v in last.items() if k in wide.columns})
