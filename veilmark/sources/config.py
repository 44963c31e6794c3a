"""Small JSON settings: what a matter is really called, and the rules of a world. Read on the driver,
strictly: unknown fields, wrong types and blank names are errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilmark.functions.json_values import Rejected, exact_object, kind, parse
from veilmark.functions.match import normal_form
from veilmark.functions.text import parties
from veilmark.operators.world import WorldRules


def load_ground(text: str) -> list[str]:
    """Aliases from {"identities": [...], "party_aliases": [[...], ...]}: one at least, none blank."""
    value = exact_object(parse(text), {"identities", "party_aliases"})
    groups = value["party_aliases"]
    if not isinstance(value["identities"], list) or not isinstance(groups, list) or any(not isinstance(g, list) or not g for g in groups):
        raise Rejected("identities and groups of aliases must be lists")
    out = [*value["identities"], *(a for g in groups for a in g)]
    if not out or any(not isinstance(a, str) or not normal_form(a) for a in out):
        raise Rejected("aliases must be names")
    return out


def load_rules(text: str) -> WorldRules:
    """Rules from lists of objects under date_orders, numeric_ranges, ratio_ranges and compatible; all optional."""
    value = parse(text)
    if not isinstance(value, dict) or value.keys() - {"date_orders", "numeric_ranges", "ratio_ranges", "compatible"}:
        raise Rejected("fields")

    def rows(name: str, *keys: str) -> list[list]:
        listed = value.get(name, [])
        if not isinstance(listed, list):
            raise Rejected("rules must be lists")
        return [[exact_object(r, set(keys))[k] for k in keys] for r in listed]

    def number(x: object, optional: bool = False) -> float | None:
        if x is None and optional:
            return None
        if kind(x) != "number":
            raise Rejected("a bound must be a number")
        return float(x)

    return WorldRules(
        tuple((a, b) for a, b in rows("date_orders", "left", "right")),
        {k: (number(a, True), number(b, True)) for k, a, b in rows("numeric_ranges", "key", "lower", "upper")},
        {(n, d): (number(a), number(b)) for n, d, a, b in rows("ratio_ranges", "numerator", "denominator", "lower", "upper")},
        {(a, b): tuple((x, y) for x, y in pairs) for a, b, pairs in rows("compatible", "left", "right", "pairs")},
    )


def ground_of(matter: Column) -> Column:
    """The aliases that a matter's label gives away: the deal by name, and each party."""
    names = parties(matter)
    return F.concat(F.array(F.concat(F.array_join(names, " / "), F.lit(" deal"))), names)
