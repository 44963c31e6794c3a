"""``spark-submit -m veilmark MODE --input records.jsonl --output DIR``. Refuses to replace an output unless told to.

original, redact  traces, marked or redacted
validate          the violations of records
score             accuracy of an adversary: --transformed DIR (of redact), --answers FILE (lines of trace_id and text)
synth             made-up traces: --ground FILE (of one matter), --roles MODULE:FACTORY (a callable that gives a Synthesis)
trace             the attempts at one trace: as synth, with --trace-id
"""

from __future__ import annotations

import argparse
import importlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark import engine
from veilmark.operators import score
from veilmark.operators.loop import Synthesis, synthesize
from veilmark.operators.spans import detect
from veilmark.operators.validate import violations
from veilmark.sources import traces
from veilmark.sources.config import load_ground

MODES = ("original", "redact", "validate", "score", "synth", "trace")


def scores(spark: SparkSession, records: DataFrame, transformed: str, answers: str) -> DataFrame:
    steps = traces.flatten_records(records)
    found = detect(steps.select("trace_id", "detail")).select("trace_id", "detail", F.explode("spans").alias("s"))
    truth = found.select("trace_id", "s.category", F.substring("detail", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("value")).distinct()
    seen = spark.read.schema("trace_id string, steps array<struct<step:int,action:string,detail:string>>").json(transformed).select("trace_id", F.inline("steps"))
    pairs = score.pair_by_id(score.trace_text(steps).withColumn("pos", F.lit(1)), score.trace_text(seen).withColumn("pos", F.lit(1)))
    said = spark.read.schema("trace_id string, text string").json(answers)
    return score.score_pairs(pairs, truth, lambda asked: asked.select("trace_id").join(said, "trace_id"))


def roles(name: str) -> Synthesis:
    module, factory = name.split(":")
    return getattr(importlib.import_module(module), factory)()


def main(argv: Sequence[str] | None = None) -> None:
    args = argparse.ArgumentParser(prog="veilmark", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    args.add_argument("mode", choices=MODES)
    args.add_argument("--input", required=True)
    args.add_argument("--output", required=True)
    args.add_argument("--limit", type=int, default=0, help="traces in file order; 0: all")
    args.add_argument("--replace", action="store_true")
    for option in ("--transformed", "--answers", "--ground", "--roles", "--trace-id"):
        args.add_argument(option)
    a = args.parse_args(argv)
    needed = {"score": ("transformed", "answers"), "synth": ("ground", "roles"), "trace": ("ground", "roles", "trace_id")}.get(a.mode, ())
    if missing := [n for n in needed if getattr(a, n) is None]:
        args.error(f"{a.mode} needs --{', --'.join(missing)}".replace("_", "-"))
    spark = SparkSession.builder.appName("veilmark").getOrCreate()
    records = traces.read_records(spark, a.input)
    if a.limit:
        records = records.orderBy("pos").limit(a.limit)
    if a.mode == "validate":
        out = violations(traces.import_records(records))
    elif a.mode in ("original", "redact"):
        steps = traces.flatten_records(records)
        out = traces.nested(engine.original(steps) if a.mode == "original" else engine.redact(steps))
    elif a.mode == "score":
        out = scores(spark, records, a.transformed, a.answers)
    else:
        named = load_ground("\n".join(r[0] for r in spark.read.text(a.ground, wholetext=True).collect()))  # a small setting
        records = records.where(F.col("trace_id") == a.trace_id) if a.mode == "trace" else records
        segments = traces.import_records(records).where("error is null")
        ground = records.select("trace_id", F.explode(F.array(*map(F.lit, named))).alias("alias"))
        if a.mode == "trace":
            out = synthesize(segments, ground, roles(a.roles))
        else:
            placed = score.round_robin(records.select("trace_id", "case_id", "pos"), "case_id", "pos")
            order = placed.select("trace_id", F.struct("turn", "group_first").alias("place"))
            out = engine.synthetic(segments, ground, order, roles(a.roles), a.limit or 10)
    traces.write_new(out, a.output, a.replace)


if __name__ == "__main__":
    main()
