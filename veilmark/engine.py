"""The facade: original, redacted and synthetic traces, reconstruction and verification, as DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilmark.functions.text import action, call_detail, clip, fill_detail, mark_pii, mark_placeholders, parties, result_detail, strip_parties
from veilmark.operators import score
from veilmark.operators.loop import Synthesis, published, synthesize
from veilmark.operators.spans import scrub, standin_spans

#: A model slot: trace_id, text in; trace_id, companies, year out. It sees transformed text only.
Adversary = Callable[[DataFrame], DataFrame]


def original(steps: DataFrame, names: tuple[str, ...] = ()) -> DataFrame:
    return steps.withColumn("detail", mark_pii(F.col("detail"), names))


def redact(steps: DataFrame, detector=standin_spans) -> DataFrame:
    """``steps``: trace_id, matter, step, action, detail. Values become tokens, then parties [ORG_n]; tokens are marked."""
    return scrub(steps, detector).withColumn("detail", mark_placeholders(strip_parties(F.col("detail"), parties(F.col("matter")))))


def reconstruct(transformed: DataFrame, guessed: DataFrame) -> DataFrame:
    """Tokens of parties filled with the adversary's guesses."""
    none = F.array().cast("array<string>")
    out = transformed.join(guessed.select("trace_id", "companies"), "trace_id", "left")
    return out.withColumn("detail", fill_detail(F.col("detail"), F.coalesce("companies", none))).withColumn("trace_id", F.concat(F.lit("recon-"), F.col("trace_id"))).drop("companies")


def verify(originals: DataFrame, transformed: DataFrame, adversary: Adversary) -> DataFrame:
    """The micro-averaged recovery of parties and years from transformed traces."""
    guessed = adversary(score.trace_text(transformed))
    return score.verify_score(score.deal_hits(originals.select("trace_id", "matter").distinct(), guessed))


def synthetic(segments: DataFrame, ground: DataFrame, order: DataFrame, how: Synthesis, most: int) -> DataFrame:
    """Steps of made-up traces (trace_id, source_id, step, action, detail): the first ``most`` of ``order`` (trace_id, place)
    that pass the loop, under ids syn-001 and on."""
    made = published(synthesize(segments, ground, how), order, most)
    rows = made.select(F.col("id").alias("trace_id"), "source_id", F.posexplode("payloads").alias("at", "payload"))
    # The loop keeps the order and the envelopes of a trace's segments.
    at = F.row_number().over(Window.partitionBy("trace_id").orderBy("pos")) - 1
    envelopes = segments.select(F.col("trace_id").alias("source_id"), "role", "kind", "tool_name", at.alias("at"))
    part = lambda k: F.get_json_object("payload", f"$.{k}")
    detail = F.when(F.col("kind") == "message", clip(part("text"))).when(F.col("kind") == "tool_call", call_detail(part("arguments"))).otherwise(result_detail(part("result"), F.col("tool_name")))
    out = rows.join(envelopes, ["source_id", "at"])
    return out.select("trace_id", "source_id", (F.col("at") + 1).alias("step"), action(F.col("role"), F.col("kind"), F.col("tool_name")).alias("action"), detail.alias("detail"))
