"""Reading and writing traces: source records, canonical records, and traces built from tables.

Payloads stay JSON text, so key order, unbounded integers and null fields survive.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilmark.functions.text import action, call_detail, clip, matter, result_detail

EVENT = "event_id string, sequence int, role string, event_type string, timestamp string, timestamp_kind string, content string, model_latency_ms double, model_token_usage string, tool_call_id string, tool_name string, arguments string, result string, elapsed_ms double, observed_tool_run_at string"
PROVENANCE = "dataset_kind string, author_attribution string, conversation_mode string, tool_execution_mode string, language_model_api_called_at_runtime boolean, timestamp_policy string, fictional_internal_dialogue boolean, vendor_internal_log boolean"
SOURCE = f"schema_version string, trace_id string, case_id string, task_id string, workflow string, as_of_date string, provenance struct<{PROVENANCE.replace(' ', ':').replace(',:', ',')}>, artifacts array<string>, final_outcome string, events array<struct<{EVENT.replace(' ', ':').replace(',:', ',')}>>"
SEGMENT = "segment_id string, role string, kind string, payload string, tool_name string, call_id string"
CANONICAL = f"trace_id string, segments array<struct<{SEGMENT.replace(' ', ':').replace(',:', ',')}>>"
WORKFLOW = "^[a-z][a-z0-9_]{0,63}$"


# What the source form says of a trace that nobody recorded.
NOT_RECORDED, MADE, NOT_RUN = "not recorded for synthetic trace", "synthetic", "not executed; tool records are synthetic"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Source records from JSON lines, with the place of each in its file. Fields without a fixed shape
    (arguments, results) are kept as JSON text."""
    return spark.read.schema(SOURCE).json(path).withColumn("pos", F.monotonically_increasing_id())


def nth_record(records: DataFrame, n: int) -> DataFrame:
    """The record at a place, from 0, in file order. A lookup by trace_id is the cheaper way."""
    ranked = records.select("pos").orderBy("pos").limit(n + 1).agg(F.max("pos").alias("pos"), F.count("*").alias("n")).where(F.col("n") == n + 1)
    return records.join(F.broadcast(ranked.select("pos")), "pos")  # one row


def flatten_records(records: DataFrame) -> DataFrame:
    """One row for each step: trace_id, matter, step, action, detail."""
    e = records.select("trace_id", matter(F.col("case_id"), F.col("workflow")).alias("matter"), F.inline("events"))
    detail = F.when(F.col("event_type") == "message", clip(F.col("content"))).when(F.col("event_type") == "tool_call", call_detail(F.col("arguments"))).otherwise(result_detail(F.col("result"), F.col("tool_name")))
    return e.select("trace_id", "matter", F.col("sequence").alias("step"), action(F.col("role"), F.col("event_type"), F.col("tool_name")).alias("action"), detail.alias("detail"))


def nested(steps: DataFrame) -> DataFrame:
    """One row for each trace, with its steps in order."""
    return steps.groupBy("trace_id", "matter").agg(F.array_sort(F.collect_list(F.struct("step", "action", "detail"))).alias("steps"))


def payload(kind: Column, content: Column, arguments: Column, result: Column) -> Column:
    """The payload of an event as JSON text."""
    quoted = F.regexp_extract(F.to_json(F.struct(content.alias("text"))), r'(?s)^\{"text":(.*)\}$', 1)  # with the line ends that JSON leaves as they are
    text = F.concat(F.lit('{"text":'), quoted, F.lit("}"))
    return F.when(kind == "message", text).when(kind == "tool_call", F.concat(F.lit('{"arguments":'), arguments, F.lit("}"))).when(kind == "tool_result", F.concat(F.lit('{"result":'), result, F.lit("}")))


def import_records(records: DataFrame) -> DataFrame:
    """Segments of records in the events form, with fresh neutral ids: trace_id, pos, segment_id, role, kind,
    payload_json, tool_name, call_id, error. Only content, arguments and results are taken over. ``error``
    names what is wrong with a row: an unknown type, a place that is not the sequence, a missing field."""
    e = records.select("trace_id", F.posexplode("events")).select("trace_id", (F.col("pos") + 1).alias("pos"), "col.*")
    p = payload(F.col("event_type"), F.col("content"), F.col("arguments"), F.col("result"))
    error = (
        F.when(~F.coalesce(F.col("event_type").isin("message", "tool_call", "tool_result"), F.lit(False)), "unsupported event type")
        .when(F.col("sequence").isNotNull() & (F.col("sequence") != F.col("pos")), "sequence is not array order")
        .when(p.isNull() | F.col("event_id").isNull() | F.col("role").isNull(), "missing field")
    )
    rows = e.select("trace_id", "pos", F.col("event_id").alias("segment_id"), "role", F.col("event_type").alias("kind"), p.alias("payload_json"), "tool_name", F.col("tool_call_id").alias("call_id"), error.alias("error"))
    return neutralize(rows)


def import_canonical(records: DataFrame) -> DataFrame:
    """Segments of records in the canonical form, with fresh neutral ids."""
    e = records.select("trace_id", F.posexplode("segments")).select("trace_id", (F.col("pos") + 1).alias("pos"), "col.*")
    missing = F.when(F.greatest(F.col("segment_id").isNull(), F.col("role").isNull(), F.col("kind").isNull(), F.col("payload").isNull()), "missing field")
    return neutralize(e.select("trace_id", "pos", "segment_id", "role", "kind", F.col("payload").alias("payload_json"), "tool_name", "call_id", missing.alias("error")))


def import_any(raw: DataFrame) -> DataFrame:
    """``raw``: value (a JSON line). Both forms; a record must have exactly one. Others: one row with an error."""
    fields = raw.withColumn("keys", F.json_object_keys("value"))
    has = lambda k: F.coalesce(F.array_contains("keys", k), F.lit(False))
    one = has("segments") != has("events")
    old = import_records(fields.where(one & has("events")).select(F.from_json("value", SOURCE).alias("r")).select("r.*"))
    new = import_canonical(fields.where(one & has("segments")).select(F.from_json("value", CANONICAL).alias("r")).select("r.*"))
    bad = fields.where(~one).select(F.get_json_object("value", "$.trace_id").alias("trace_id"), F.lit("exactly one of segments and events is needed").alias("error"))
    return old.unionByName(new).unionByName(bad, allowMissingColumns=True)


def neutralize(segments: DataFrame) -> DataFrame:
    """Fresh ids that say nothing: segment_0001 and on by place, call_0001 and on by first appearance."""
    by = Window.partitionBy("trace_id").orderBy("pos")
    first = F.min(F.when(F.col("call_id").isNotNull(), F.col("pos"))).over(Window.partitionBy("trace_id", "call_id"))
    rows = segments.withColumn("segment_id", F.format_string("segment_%04d", F.row_number().over(by))).withColumn("_first", F.when(F.col("call_id").isNotNull(), first))
    n = F.dense_rank().over(Window.partitionBy("trace_id", F.col("call_id").isNull()).orderBy("_first"))
    return rows.withColumn("call_id", F.when(F.col("call_id").isNotNull(), F.format_string("call_%04d", n))).drop("_first")


def canonical_records(segments: DataFrame) -> DataFrame:
    """One JSON document for each trace: trace_id, record."""
    one = F.concat(
        F.lit('{"segment_id":"'), F.col("segment_id"), F.lit('","role":"'), F.col("role"), F.lit('","kind":"'), F.col("kind"), F.lit('","payload":'), F.col("payload_json"),
        F.lit(',"tool_name":'), F.coalesce(F.concat(F.lit('"'), F.col("tool_name"), F.lit('"')), F.lit("null")), F.lit(',"call_id":'), F.coalesce(F.concat(F.lit('"'), F.col("call_id"), F.lit('"')), F.lit("null")), F.lit("}"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("pos", one.alias("j"))))
    return segments.groupBy("trace_id").agg(F.concat(F.lit('{"trace_id":"'), F.col("trace_id"), F.lit('","segments":['), F.array_join(F.transform(ordered, lambda x: x["j"]), ","), F.lit("]}")).alias("record"))


def source_events(segments: DataFrame, fresh: Column | None = None) -> DataFrame:
    """Events in the source form under fresh ids: case_id, trace_id, event_id, sequence, role, event_type,
    tool_call_id, tool_name, payload_json. ``fresh`` makes the 12 hexadecimal digits of a trace; by default
    they follow from its id, so that a retried task writes the same."""
    digits = fresh if fresh is not None else F.substring(F.sha2("trace_id", 256), 1, 12)
    rows = segments.withColumn("case_id", F.concat(F.lit("synthetic_"), digits)).withColumn("t", F.concat("case_id", F.lit("_t01")))
    rows = rows.withColumn("sequence", F.row_number().over(Window.partitionBy("trace_id").orderBy("pos")))
    first = F.when(F.col("call_id").isNotNull(), F.min("pos").over(Window.partitionBy("trace_id", "call_id")))
    rows = rows.withColumn("_first", first)
    n = F.dense_rank().over(Window.partitionBy("trace_id", F.col("call_id").isNull()).orderBy("_first"))
    call = F.when(F.col("call_id").isNotNull(), F.concat("t", F.format_string(".call%03d", n)))
    return rows.select("case_id", F.col("t").alias("trace_id"), F.concat("t", F.format_string(".e%03d", F.col("sequence"))).alias("event_id"), "sequence", "role", F.col("kind").alias("event_type"), call.alias("tool_call_id"), "tool_name", "payload_json")


def source_records(segments: DataFrame, workflow: str | None = None, fresh: Column | None = None) -> DataFrame:
    """Records in the source form, ready for ``df.write.json``. Times and metrics are null, never invented."""
    if workflow is not None and not re.fullmatch(WORKFLOW, workflow):
        raise ValueError("workflow must be lower snake case")
    e = source_events(segments, fresh)
    j = F.col("payload_json")
    event = F.struct(
        "event_id", "sequence", "role", "event_type", F.lit(None).cast("string").alias("timestamp"), F.lit(NOT_RECORDED).alias("timestamp_kind"),
        F.get_json_object(j, "$.text").alias("content"), F.lit(None).cast("double").alias("model_latency_ms"), F.lit(None).cast("string").alias("model_token_usage"), "tool_call_id", "tool_name",
        F.get_json_object(j, "$.arguments").alias("arguments"), F.get_json_object(j, "$.result").alias("result"), F.lit(None).cast("double").alias("elapsed_ms"), F.lit(None).cast("string").alias("observed_tool_run_at"),
    )
    provenance = F.struct(
        F.lit("veilmark").alias("dataset_kind"), F.lit("veilmark").alias("author_attribution"), F.lit(MADE).alias("conversation_mode"),
        F.lit(NOT_RUN).alias("tool_execution_mode"), F.lit(True).alias("language_model_api_called_at_runtime"), F.lit("none").alias("timestamp_policy"),
        F.lit(True).alias("fictional_internal_dialogue"), F.lit(False).alias("vendor_internal_log"),
    )
    out = e.groupBy("case_id", "trace_id").agg(F.array_sort(F.collect_list(F.struct("sequence", event.alias("e")))).alias("es"))
    return out.select(
        F.lit("1.0").alias("schema_version"), "trace_id", "case_id", F.concat("case_id", F.lit("_task01")).alias("task_id"), F.lit(workflow).cast("string").alias("workflow"),
        F.lit(None).cast("string").alias("as_of_date"), provenance.alias("provenance"), F.transform("es", lambda x: x["e"]).alias("events"), F.array().cast("array<string>").alias("artifacts"), F.lit(None).cast("string").alias("final_outcome"),
    )


def conversation_steps(conversations: DataFrame) -> DataFrame:
    """Steps of a table of messages (conv_id, turn, role, text)."""
    return conversations.select(F.concat(F.lit("conv_"), F.col("conv_id")).alias("trace_id"), (F.col("turn") + 1).cast("int").alias("step"), F.col("role").alias("action"), clip(F.coalesce("text", F.lit(""))).alias("detail"))


def conversation_segments(conversations: DataFrame) -> DataFrame:
    text = payload(F.lit("message"), F.coalesce("text", F.lit("")), F.lit(None).cast("string"), F.lit(None).cast("string"))
    rows = conversations.select(F.concat(F.lit("conv_"), F.col("conv_id")).alias("trace_id"), (F.col("turn") + 1).cast("int").alias("pos"), F.lit("").alias("segment_id"), "role", F.lit("message").alias("kind"), text.alias("payload_json"), F.lit(None).cast("string").alias("tool_name"), F.lit(None).cast("string").alias("call_id"))
    return neutralize(rows)


def event_segments(events: DataFrame) -> DataFrame:
    """A call and its result for each row of a table of events (event_id, user_id, event_type, props)."""
    base = events.select(F.concat(F.lit("user_"), F.col("user_id")).alias("trace_id"), F.col("event_id"), F.col("event_type").alias("tool_name"), F.concat(F.lit("c"), F.col("event_id")).alias("call_id"), F.coalesce("props", F.lit("{}")).alias("props"))
    call = base.select("trace_id", (F.col("event_id") * 2).alias("pos"), F.lit("").alias("segment_id"), F.lit("assistant").alias("role"), F.lit("tool_call").alias("kind"), F.concat(F.lit('{"arguments":'), F.col("props"), F.lit("}")).alias("payload_json"), "tool_name", "call_id")
    done = base.select("trace_id", (F.col("event_id") * 2 + 1).alias("pos"), F.lit("").alias("segment_id"), F.lit("tool").alias("role"), F.lit("tool_result").alias("kind"), F.lit('{"result":{"ok":true}}').alias("payload_json"), "tool_name", "call_id")
    return neutralize(call.unionByName(done))


def fingerprint(df: DataFrame) -> str:
    """Says whether two tables hold the same rows, in any order: one pass, and one number to the driver."""
    plain = df.select(*(F.to_json(F.struct(c)).alias(f"c{i}") for i, c in enumerate(sorted(df.columns))))
    row = plain.agg(F.count("*"), F.sum(F.xxhash64(*plain.columns).cast("decimal(38,0)")), F.bit_xor(F.xxhash64(F.lit("other"), *plain.columns))).first()
    return hashlib.sha256(repr((sorted(df.columns), *row)).encode()).hexdigest()[:24]


def cached(spark: SparkSession, path: str, build, of: DataFrame | None = None) -> DataFrame:
    """What is stored at ``path``, or else what ``build`` gives, stored there first. The write is atomic per
    job: a reader sees all or nothing. ``of``, the input, makes it one store for each input: what was made of
    other rows is never given back."""
    path = path if of is None else f"{path}/{fingerprint(of)}"
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_new(df: DataFrame, path: str, replace: bool = False) -> None:
    """Refuses to replace what is there unless told to."""
    df.write.mode("overwrite" if replace else "errorifexists").json(path)


def update_slots(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """``cache``: id, source_id, matter, steps_json. ``fresh``: source_prefix, title, matter (null: keep), steps_json.
    A slot whose source has the prefix and whose matter ends with the title takes the fresh steps."""
    c, f = cache.alias("c"), fresh.alias("f")
    on = F.startswith(F.coalesce("c.source_id", F.lit("")), F.col("f.source_prefix")) & (F.element_at(F.split("c.matter", " — "), -1) == F.col("f.title"))
    return c.join(f, on, "left").select("c.id", "c.source_id", F.coalesce("f.matter", "c.matter").alias("matter"), F.coalesce("f.steps_json", "c.steps_json").alias("steps_json"))
