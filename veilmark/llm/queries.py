"""One query for each operator of this subpackage, over its whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.llm.common import table
from veilmark.llm.decontam import ORACLE as DECONTAM_ORACLE
from veilmark.llm.decontam import contaminated
from veilmark.llm.fingerprints import edited_fingerprints
from veilmark.llm.html_main import extracted
from veilmark.llm.line_runs import without_repeated_runs
from veilmark.llm.mixing import mixed
from veilmark.llm.simhash import groups
from veilmark.llm.suffix_dedup import without_repeats
from veilmark.llm.toxicity import toxicity
from veilmark.llm.unit_dedup import ORACLE as UNIT_ORACLE
from veilmark.llm.unit_dedup import without_repeated_units
from veilmark.llm.url_reputation import ORACLE as URL_ORACLE
from veilmark.llm.url_reputation import judged


def op1_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = without_repeats(table(spark, sf_dir, "documents"))
    return kept.select(
        "doc_id",
        "n_bytes",
        F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["stop"] - x["start"]).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op3_unit_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = without_repeated_units(table(spark, sf_dir, "documents"))
    return kept.select(
        "doc_id",
        "n_units",
        F.size("removed").cast("long").alias("n_removed"),
        F.array_join(F.transform("removed", lambda x: F.concat_ws("-", x["start"], x["stop"])), ",").alias("removed_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op4_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = without_repeated_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.array_join("removed", ",").alias("removed_lines"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_simhash_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return own.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return own.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op7_fair_queueing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))


def op8_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op9_factorization_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_closed_syncmers": op1_closed_syncmers,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_unit_hashing": op3_unit_hashing,
    "op4_line_runs": op4_line_runs,
    "op5_simhash_ball": op5_simhash_ball,
    "op6_decontamination": op6_decontamination,
    "op7_fair_queueing": op7_fair_queueing,
    "op8_host_reputation": op8_host_reputation,
    "op9_factorization_machine": op9_factorization_machine,
    "op10_tree_scoring": op10_tree_scoring,
}

ORACLE: dict[str, str] = {
    "op3_unit_hashing": UNIT_ORACLE,
    "op6_decontamination": DECONTAM_ORACLE,
    "op8_host_reputation": URL_ORACLE,
}
