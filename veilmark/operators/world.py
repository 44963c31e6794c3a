"""Checks of an invented world: one row of bindings for each key, rules as small tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.functions.text import inline_scalar, iso_date, json_number
from veilmark.operators.template import profile


@dataclass(frozen=True)
class WorldRules:
    """Dates in order, numbers in ranges, ratios in ranges, and values that go together."""

    date_orders: tuple[tuple[str, str], ...] = ()
    numeric_ranges: dict[str, tuple[float | None, float | None]] = field(default_factory=dict)
    ratio_ranges: dict[tuple[str, str], tuple[float, float]] = field(default_factory=dict)
    compatible: dict[tuple[str, str], tuple[tuple[str, str], ...]] = field(default_factory=dict)


# Keys that are dates wherever they occur, and their order.
DATES = ("SIGNING_DATE", "CLOSING_DATE", "TERMINATION_DATE")
DATE_ORDERS = (("SIGNING_DATE", "CLOSING_DATE"), ("SIGNING_DATE", "TERMINATION_DATE"))


def profile_violations(profiles: DataFrame, segments: DataFrame) -> DataFrame:
    """W1: profiles (trace_id, placeholders) that are not those of their segments (trace_id, payload_json)."""
    own = profile(segments).withColumnRenamed("placeholders", "_own")
    none = F.array().cast("array<string>")
    differs = F.coalesce("placeholders", none) != F.coalesce("_own", none)
    return profiles.join(own, "trace_id", "left").where(differs).select("trace_id", F.lit("W1").alias("rule"), F.lit("").alias("what"))


def violations(worlds: DataFrame, profiles: DataFrame, rules: WorldRules = WorldRules(), segments: DataFrame | None = None) -> DataFrame:
    """``worlds``: trace_id, key, value_json. ``profiles``: trace_id, placeholders. Returns trace_id, rule and what
    (key or keys) of each violation. A rule about a key that a trace does not bind is violated there. With
    ``segments`` the profiles themselves are checked, too."""
    w = worlds.select("trace_id", "key", "value_json")
    text = F.col("value_json")
    scalar = F.regexp_like(text, F.lit(r'^("|-?\d|true$|false$|null$)'))
    finite = ~F.regexp_like(text, F.lit(r"^-?\d")) | json_number(text).isNotNull()
    own = w.select(
        "trace_id",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(~F.regexp_like("key", F.lit("^[A-Z][A-Z0-9_]*$")), F.struct(F.lit("W2").alias("rule"), F.col("key").alias("what"))),
                    F.when(~(scalar & finite) | F.contains(text, F.lit("{{")), F.struct(F.lit("W4").alias("rule"), F.col("key").alias("what"))),
                    F.when(F.col("key").isin(*DATES) & iso_date(inline_scalar(text)).isNull(), F.struct(F.lit("W5").alias("rule"), F.col("key").alias("what"))),
                )
            )
        ).alias("v"),
    ).select("trace_id", "v.*")
    maps = profiles.select("trace_id", "placeholders").join(w.groupBy("trace_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value_json"))).alias("m")), "trace_id", "left")
    maps = maps.withColumn("m", F.coalesce("m", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))))
    get = lambda k: F.try_element_at("m", F.lit(k))
    date = lambda k: iso_date(inline_scalar(get(k)))
    number = lambda k: json_number(get(k))
    bad = [("W3", "", F.array_sort(F.map_keys("m")) != F.array_sort("placeholders"))]
    bad += [("W5", f"{a}<={b}", date(a) > date(b)) for a, b in DATE_ORDERS]
    bad += [("W6", f"{a}<={b}", ~F.coalesce(date(a) <= date(b), F.lit(False))) for a, b in rules.date_orders]
    for k, (low, high) in rules.numeric_ranges.items():
        fits = number(k).isNotNull() & (F.lit(True) if low is None else number(k) >= low) & (F.lit(True) if high is None else number(k) <= high)
        bad.append(("W7", k, ~F.coalesce(fits, F.lit(False))))
    for (a, b), (low, high) in rules.ratio_ranges.items():
        r = F.try_divide(number(a), number(b))
        bad.append(("W8", f"{a}/{b}", ~F.coalesce((r >= low) & (r <= high), F.lit(False))))
    for (a, b), pairs in rules.compatible.items():
        one = F.lit(False)
        for x, y in pairs:
            one = one | ((inline_scalar(get(a)) == x) & (inline_scalar(get(b)) == y))
        bad.append(("W9", f"{a}~{b}", ~F.coalesce(one, F.lit(False))))
    across = maps.select("trace_id", F.explode(F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(r).alias("rule"), F.lit(what).alias("what"))) for r, what, c in bad)))).alias("v")).select("trace_id", "v.*")
    out = own.unionByName(across)
    return out if segments is None else out.unionByName(profile_violations(profiles, segments))
