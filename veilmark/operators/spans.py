"""From detected spans to consistent, numbered placeholders.

detect (Arrow) -> resolve overlaps (native fold) -> number (windows) -> splice (native). A trace with one row is
numbered within the row and moves nowhere; the others are dealt once, by trace_id, and every window and the
splice follow that.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from veilmark.functions.text import DISPLAY_PATTERNS, alias_norm, placeholder_prefix

SPANS = "array<struct<start:int,end:int,category:string>>"
SPAN_TYPE = ArrayType(StructType().add("start", IntegerType()).add("end", IntegerType()).add("category", StringType()))

# The detection patterns. Quantifiers are bounded, so matching stays linear.
EMAIL = r"[A-Za-z0-9._%+\-]{1,64}@[A-Za-z0-9][A-Za-z0-9.\-]{0,253}\.[A-Za-z]{2,24}"
DIGIT_RUN = r"\d(?:[ \-]?\d){12,}"
SECRETS = (
    r"\bsk-[A-Za-z0-9_\-]{16,}",
    r"\b(?:sk|rk|pk|api)[_\-](?:live|test|prod|proj)[_\-][A-Za-z0-9_\-]{8,}",
    r"\bAKIA[0-9A-Z]{16}\b",
    r"\bgh[pousr]_[A-Za-z0-9]{20,}\b",
    r"\bgithub_pat_[A-Za-z0-9_]{20,}\b",
    r"\bxox[baprs]-[A-Za-z0-9\-]{10,}\b",
    r"\bAIza[0-9A-Za-z_\-]{35}\b",
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
)
_EMAIL, _RUN, _SECRETS = re.compile(EMAIL), re.compile(DIGIT_RUN), [re.compile(s) for s in SECRETS]
_STANDIN = [(re.compile(DISPLAY_PATTERNS[k]), c) for k, c in (("PHONE", "private_phone"), ("DATE", "private_date"), ("ADDRESS", "private_address"))]
_ALNUM_RIGHT = re.compile(r"[A-Za-z0-9]*")


def luhn(digits: str) -> bool:
    twice = (int(d) * 2 for d in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in twice)) % 10 == 0


def within_identifier(text: str, start: int, end: int) -> bool:
    """Is the unbroken digit run a piece of an id? It touches a letter, and its token still has letters
    among the digits once a word is taken off each end."""
    run = text[start:end]
    if not run.isdigit() or not (re.match("[A-Za-z]", text[end : end + 1]) or re.match("[A-Za-z]", text[max(0, start - 1) : start])):
        return False
    left = start
    while left and text[left - 1].isascii() and text[left - 1].isalnum():
        left -= 1
    token = text[left:start] + run + _ALNUM_RIGHT.match(text, end)[0]
    return bool(re.search("[A-Za-z]", re.sub(r"^[A-Za-z]+|[A-Za-z]+$", "", token)))


def card_spans(text: str) -> Iterator[tuple[int, int]]:
    """In each digit run, the longest and then earliest window of 19 to 13 digits that passes Luhn."""
    for m in _RUN.finditer(text):
        if within_identifier(text, m.start(), m.end()):
            continue
        at = [i for i in range(m.start(), m.end()) if text[i].isdigit()]
        digits = "".join(text[i] for i in at)
        windows = ((a, n) for n in range(min(19, len(at)), 12, -1) for a in range(len(at) - n + 1))
        for a, n in windows:
            if luhn(digits[a : a + n]):
                yield at[a], at[a + n - 1] + 1
                break


def structured_spans(text: str | None) -> list[tuple[int, int, str]]:
    """Emails, secrets and card numbers, overlaps and all."""
    if not text:
        return []
    out = [(*m.span(), "private_email") for m in _EMAIL.finditer(text)] if "@" in text else []
    out += [(*m.span(), "secret") for s in _SECRETS for m in s.finditer(text)]
    return out + [(a, b, "account_number") for a, b in card_spans(text)]


def standin(text: str | None) -> list[tuple[int, int, str]]:
    """What stands in for a learned detector: phone, date and address patterns."""
    return [(*m.span(), c) for p, c in _STANDIN for m in p.finditer(text)] if text else []


def _rows(spans: list[tuple[int, int, str]]) -> list[dict]:
    return [{"start": a, "end": b, "category": c} for a, b, c in spans]


@F.pandas_udf(SPAN_TYPE)
def regex_spans(text: pd.Series) -> pd.Series:
    return text.map(lambda t: _rows(structured_spans(t)))


@F.pandas_udf(SPAN_TYPE)
def standin_spans(text: pd.Series) -> pd.Series:
    return text.map(lambda t: _rows(standin(t)))


def valid_spans(spans: Column, text: Column) -> Column:
    return F.filter(spans, lambda s: (s["start"] >= 0) & (s["start"] < s["end"]) & (s["end"] <= F.length(text)))


def merge_spans(primary: Column, secondary: Column) -> Column:
    """Greedy, without overlaps: all of the first list before the second; in each, longer before shorter,
    then earlier. Half-open spans that touch do not overlap."""

    def order(a: Column, b: Column) -> Column:
        la, lb = a["end"] - a["start"], b["end"] - b["start"]
        return F.when(la > lb, -1).when(la < lb, 1).when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0)

    both = F.concat(F.array_sort(primary, order), F.array_sort(secondary, order))
    free = lambda acc, s: ~F.exists(acc, lambda k: (s["start"] < k["end"]) & (s["end"] > k["start"]))
    return F.aggregate(both, F.array().cast(SPANS), lambda acc, s: F.when(free(acc, s), F.concat(acc, F.array(s))).otherwise(acc))


def detect(steps: DataFrame, text: str = "detail", learned=standin_spans) -> DataFrame:
    """Adds ``spans``, resolved; patterns win over what the learned detector says."""
    found = steps.withColumn("_p", regex_spans(text)).withColumn("_s", learned(F.col(text)))
    found = found.withColumn("spans", merge_spans(merge_spans(valid_spans(F.col("_p"), F.col(text)), F.array().cast(SPANS)), valid_spans(F.col("_s"), F.col(text))))
    return found.drop("_p", "_s")


def number_aliases(spans: DataFrame) -> DataFrame:
    """``spans``: trace_id, step, start, category, value. Adds norm, n and token: within a trace and category
    the distinct norms are numbered by first appearance, in order of (step, start), null steps first. A null
    trace_id is a trace."""
    place = [c for c in ("step", "_row", "start") if c in spans.columns]
    keyed = spans.withColumn("norm", alias_norm(F.col("value")))
    first = F.min(F.struct(*place)).over(Window.partitionBy("trace_id", "category", "norm"))
    n = F.dense_rank().over(Window.partitionBy("trace_id", "category").orderBy("first"))
    return keyed.withColumn("first", first).withColumn("n", n.cast("long")).withColumn("token", token_of(F.col("category"), F.col("n"))).drop("first")


def token_of(category: Column, n: Column) -> Column:
    return F.concat(F.lit("["), placeholder_prefix(category), F.lit("_"), n, F.lit("]"))


def numbered_in_row(spans: Column, text: Column) -> Column:
    """start, end and token of each span of one text, numbered by first appearance in it alone."""
    value = lambda s: alias_norm(F.substring(text, s["start"] + 1, s["end"] - s["start"]))
    known = F.transform(F.array_sort(spans, lambda a, b: a["start"] - b["start"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["category"].alias("category"), value(s).alias("norm")))
    distinct = lambda category: F.array_distinct(F.transform(F.filter(known, lambda k: k["category"] == category), lambda k: k["norm"]))
    return F.transform(known, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), token_of(s["category"], F.array_position(distinct(s["category"]), s["norm"])).alias("token")))


def splice(text: Column, plan: Column) -> Column:
    """``plan``: start, end and token of spans that do not overlap. Gaps and tokens in order."""
    by = F.array_sort(plan, lambda a, b: a["start"] - b["start"])
    done = F.aggregate(
        by,
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, s: F.struct(F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), s["token"]).alias("out"), s["end"].alias("at")),
    )
    return F.when(F.size(plan) > 0, F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))).otherwise(text)


def scrub(steps: DataFrame, learned=standin_spans, single: bool = False) -> DataFrame:
    """``steps``: trace_id, step, detail and more. Each detected value becomes its trace's token.

    Steps are numbered in order of (step, text); null steps come first, and rows with a null trace_id are one trace.
    Rows equal in trace_id and step are steps of their own. Null detail: stays null. ``single`` says that each
    row is a trace by itself: then nothing is shuffled, and trace_id and step do not matter."""
    plan = F.array().cast("array<struct<start:int,end:int,token:string>>")
    found = detect(steps.select("trace_id", "step", F.col("detail").alias("_text"), F.struct(*steps.columns).alias("_own")), "_text", learned)
    done = lambda plan: [splice(F.col("_text"), plan).alias(c) if c == "detail" else F.col("_own")[c].alias(c) for c in steps.columns]
    if single:
        return found.select(done(F.coalesce(numbered_in_row(F.col("spans"), F.col("_text")), plan)))
    # Dealt once: all windows and the fold that puts the rows back together ask for no more than trace_id.
    dealt = found.repartition(F.col("trace_id"))
    row = Window.partitionBy("trace_id").orderBy("step", "_text")  # what ties has equal spans
    each = dealt.withColumn("_row", F.row_number().over(row)).select("*", F.explode_outer("spans").alias("_s"))
    value = alias_norm(F.substring("_text", F.col("_s.start") + 1, F.col("_s.end") - F.col("_s.start")))
    each = each.withColumn("_norm", value)
    place = F.struct("_row", F.col("_s.start"))
    first = F.min(place).over(Window.partitionBy("trace_id", "_s.category", "_norm"))
    n = F.dense_rank().over(Window.partitionBy("trace_id", "_s.category").orderBy("_first"))
    told = each.withColumn("_first", first).withColumn("_token", F.when(F.col("_s").isNotNull(), F.struct("_s.start", "_s.end", token_of(F.col("_s.category"), n).alias("token"))))
    # The first row of each step carries its columns; the others bring their spans along.
    by = Window.partitionBy("trace_id", "_row")
    rows = told.withColumn("_plan", F.collect_list("_token").over(by)).withColumn("_k", F.row_number().over(by.orderBy(F.col("_s.start").asc_nulls_first()))).where("_k = 1")
    return rows.select(done(F.col("_plan")))
