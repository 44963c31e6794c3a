"""A corpus from documents: toxic ones out, repeated runs of lines out, one of each group of near
copies, benchmark text out, and sources mixed to target weights.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the
next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.llm.common import table, written
from veilmark.llm.decontam import decontaminated
from veilmark.llm.line_runs import without_repeated_runs
from veilmark.llm.mixing import mixture
from veilmark.llm.near_copies import without_near_copies
from veilmark.llm.toxicity import scored, trained

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model rejects go. It learns from the labelled documents of the table."""
    model = trained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored(docs.select(COLUMNS), model).where("score < 0.5").select(COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines go; a document of which nothing is left goes too."""
    own = without_repeated_runs(docs.select(COLUMNS))
    cut = F.size("removed") > 0
    text = F.when(cut, F.col("kept")).otherwise(F.col("text"))
    return own.where(~(cut & (F.trim(F.translate("kept", "\t\n\r\f\x0b", "")) == ""))).select("doc_id", text.alias("text"), "lang", "source", F.when(cut, F.char_length("kept").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, 0.8 alike or more in shingles of five words, one document stays."""
    return without_near_copies(docs.select(COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark text in them go."""
    return decontaminated(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix, in order of virtual finish time: documents with the number of the repeat."""
    return mixture(docs.select(COLUMNS))


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
]

#: Learned scores and hashed shuffles are not to be had in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each from what the one before has written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
