"""Trace validation as sets of violations: a trace is valid if it has none.

Every rule is a native predicate or a window over trace_id; all of them share one exchange on it.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from veilmark.functions.json_values import Rejected, parse, shape_error
from veilmark.functions.trace_rules import KINDS, ROLES, TOOL_ARGUMENTS

@F.pandas_udf(StringType())
def json_error(text: pd.Series) -> pd.Series:
    """Null for a strict JSON object, else what is wrong."""

    def one(t: str | None) -> str | None:
        try:
            return None if isinstance(parse(t), dict) else "not an object"
        except Rejected as e:
            return str(e)

    return text.map(one)


def shape_errors(placeholders: bool):
    @F.pandas_udf(StringType())
    def run(before: pd.Series, after: pd.Series) -> pd.Series:
        def one(a: str | None, b: str | None) -> str | None:
            try:
                return shape_error(parse(a), parse(b), placeholders)
            except Rejected as e:
                return str(e)

        return pd.Series([one(a, b) for a, b in zip(before, after)], dtype=object)

    return run


def blank(c: Column | str) -> Column:
    return F.coalesce(F.trim(c) == "", F.lit(True))


def keys_are(json: Column | str, *names: str) -> Column:
    return F.coalesce(F.array_sort(F.json_object_keys(json)) == F.array(*map(F.lit, sorted(names))), F.lit(False))


def raw_starts(json: Column | str, key: str, start: str) -> Column:
    """Does the one field of a JSON object start so? Tells a string from an object without a parse."""
    return F.regexp_like(json, F.lit(rf'^\s*\{{\s*"{key}"\s*:\s*{start}'))


def argument_errors(arguments: Column, tool: Column) -> Column:
    """Arguments of a known tool must have its fields, of the right types; other tools take anything."""
    bad = F.lit(False)
    for name, fields in TOOL_ARGUMENTS.items():
        keys = F.json_object_keys(arguments)
        required, known = [f for f, _, r in fields if r], [f for f, _, _ in fields]
        rule = (F.size(F.array_except(F.array(*map(F.lit, required)), keys)) > 0) | (F.size(F.array_except(keys, F.array(*map(F.lit, known)))) > 0)
        v = F.try_parse_json(arguments)
        for f, kind, _ in fields:
            there, of = F.array_contains(keys, f), F.schema_of_variant(F.variant_get(v, f"$.{f}", "variant"))
            if kind == "string":
                rule = rule | (there & ((of != "STRING") | blank(F.get_json_object(arguments, f"$.{f}"))))
            else:
                rule = rule | (there & ((of != "BIGINT") | (F.try_variant_get(v, f"$.{f}", "bigint") < 1)))
        bad = F.when(tool == name, F.coalesce(rule, F.lit(True))).otherwise(bad)
    return bad


def violations(segments: DataFrame, strict_json: bool = True) -> DataFrame:
    """``segments``: trace_id, pos, segment_id, role, kind, payload_json, tool_name, call_id. Returns trace_id,
    pos and rule of each violation. ``strict_json`` also runs the Arrow check of the JSON domain."""
    trace, by = Window.partitionBy("trace_id"), Window.partitionBy("trace_id").orderBy("pos")
    call, done = F.col("kind") == "tool_call", F.col("kind") == "tool_result"
    message, tool = F.col("kind") == "message", call | done
    rows = segments.select(
        "*",
        F.count("*").over(Window.partitionBy("trace_id", "segment_id")).alias("same_id"),
        F.sum(F.when(call, 1).otherwise(0)).over(Window.partitionBy("trace_id", "call_id")).alias("calls"),
        F.sum(F.when(call, 1).otherwise(0)).over(Window.partitionBy("trace_id", "call_id").orderBy("pos")).alias("calls_so_far"),
        F.sum(F.when(done, 1).otherwise(0)).over(Window.partitionBy("trace_id", "call_id").orderBy("pos")).alias("results_so_far"),
        F.first(F.when(call, F.col("tool_name")), ignorenulls=True).over(Window.partitionBy("trace_id", "call_id").orderBy("pos")).alias("called"),
        F.sum(F.when(call, 1).when(done, -1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("open"),
        (F.col("pos") == F.max("pos").over(trace)).alias("is_last"),
    )
    p = "payload_json"
    rules: list[tuple[str, Column]] = [
        ("V1", blank("trace_id")),
        ("V2", blank("segment_id") | (F.col("same_id") > 1)),
        ("V3", ~F.coalesce(F.col("role").isin(*ROLES) & F.col("kind").isin(*KINDS), F.lit(False))),
        ("V4", F.json_object_keys(p).isNull() | F.try_parse_json(p).isNull()),
        ("V5", message & ((F.col("role") == "tool") | F.col("tool_name").isNotNull() | F.col("call_id").isNotNull() | ~keys_are(p, "text") | ~raw_starts(p, "text", '"'))),
        ("V6", message & (F.col("open") > 0)),
        ("V7", call & ((F.col("role") != "assistant") | blank("tool_name") | blank("call_id") | ~keys_are(p, "arguments") | ~raw_starts(p, "arguments", r"\{") | (F.col("calls") > 1))),
        ("V8", call & argument_errors(F.get_json_object(p, "$.arguments"), F.col("tool_name"))),
        ("V9", done & ((F.col("role") != "tool") | blank("tool_name") | blank("call_id") | ~keys_are(p, "result") | (F.col("calls_so_far") == 0) | (F.col("results_so_far") > F.col("calls_so_far")) | (F.col("called") != F.col("tool_name")))),
        ("V10", F.col("is_last") & (F.col("open") > 0)),
    ]
    found = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(r)) for r, c in rules)))
    out = rows.select("trace_id", "pos", F.explode(found).alias("rule"))
    if strict_json:
        out = out.unionByName(segments.where(json_error(p).isNotNull()).select("trace_id", "pos", F.lit("V4").alias("rule"))).distinct()
    return out


def first_violation(found: DataFrame) -> DataFrame:
    """For each invalid trace, the violation that comes first by place and rule."""
    n = F.substring("rule", 2, 9).cast("int")
    return found.groupBy("trace_id").agg(F.min(F.struct("pos", n.alias("n"), "rule")).alias("f")).select("trace_id", "f.pos", "f.rule")


def reference_violations(original: DataFrame, rewritten: DataFrame) -> DataFrame:
    """V11: a rewrite keeps the count, order and envelopes of segments and the shapes of their payloads."""
    envelope = ("segment_id", "role", "kind", "tool_name", "call_id")
    o, r = original.alias("o"), rewritten.alias("r")
    both = o.join(r, ["trace_id", "pos"], "full_outer")
    same = F.lit(True)
    for c in envelope:
        same = same & F.col(f"o.{c}").eqNullSafe(F.col(f"r.{c}"))
    missing = F.col("o.kind").isNull() | F.col("r.kind").isNull()
    checked = both.withColumn("shape", F.when(~missing, shape_errors(False)(F.col("o.payload_json"), F.col("r.payload_json"))))
    why = F.when(missing, "count").when(~same, "envelope").when(F.col("shape").isNotNull(), F.concat(F.lit("shape: "), F.col("shape")))
    return checked.select("trace_id", "pos", why.alias("rule")).where("rule is not null")
