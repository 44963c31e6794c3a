"""Templates: which placeholders a trace has, and filling them from one world."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from veilmark.functions import json_values as J
from veilmark.functions.text import PLACEHOLDER, inline_scalar


def profile(segments: DataFrame) -> DataFrame:
    """trace_id, placeholders: sorted and distinct, over all keys and values of the payloads."""
    own = segments.select("trace_id", F.explode_outer(F.regexp_extract_all("payload_json", F.lit(PLACEHOLDER), F.lit(1))).alias("key"))
    return own.groupBy("trace_id").agg(F.array_sort(F.collect_set("key")).alias("placeholders"))


def fill_json(payload: Column, world: Column) -> Column:
    """``world``: map of key to JSON scalar. A quoted placeholder that is a whole value becomes the binding, type
    and all; within longer texts and in keys it becomes the binding's text."""
    exact = lambda text, kv: F.regexp_replace(text, F.concat(F.lit(r'"\{\{'), kv["key"], F.lit(r'\}\}"(?!\s*:)')), F.regexp_replace(kv["value"], r"([\\$])", r"\\$1"))
    # An inline text goes inside a JSON string, so it is escaped as one.
    escaped = lambda v: F.regexp_replace(F.to_json(F.struct(inline_scalar(v).alias("v"))), r'^\{"v":"|"\}$', "")
    inline = lambda text, kv: F.replace(text, F.concat(F.lit("{{"), kv["key"], F.lit("}}")), escaped(kv["value"]))
    entries = F.map_entries(world)
    return F.aggregate(entries, F.aggregate(entries, payload, exact), inline)


@F.pandas_udf(StructType().add("payload", StringType()).add("error", StringType()))
def fill_strict(payload: pd.Series, world: pd.Series) -> pd.DataFrame:
    """The authoritative fill: ``world`` is a JSON object. An unbound placeholder or a key that two keys
    become is an error, never a guess."""

    def one(p: str, w: str) -> tuple[str | None, str | None]:
        try:
            out = J.filled(J.parse(p), J.parse(w))
            return (None, "placeholder left") if J.placeholders(out) else (J.dump(out), None)
        except J.Rejected as e:
            return None, str(e)

    return pd.DataFrame([one(p, w) for p, w in zip(payload, world)], columns=["payload", "error"])


@F.pandas_udf(StringType())
def repair_shape(before: pd.Series, after: pd.Series) -> pd.Series:
    return pd.Series([J.dump(J.repaired(J.parse(a), J.parse(b))) for a, b in zip(before, after)])


@F.pandas_udf(ArrayType(StringType()))
def payload_texts(payload: pd.Series) -> pd.Series:
    """Every key and leaf of a payload as text."""
    return payload.map(lambda p: J.leaves(J.parse(p)))
