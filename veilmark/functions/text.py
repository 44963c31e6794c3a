"""Column functions over the text of a trace. All are native expressions and compose freely.

Patterns meant for any text are Unicode-aware (``(?U)``); those of the structured detectors are ASCII.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Stands on both sides of a marked span.
MARK = "\x01"

# The display patterns, in the order in which they apply.
DISPLAY_PATTERNS = {
    "PHONE": r"\+1 \(\d{3}\) \d{3}-\d{4}",
    "EMAIL": r"[\w.]+@[\w.]+\.\w+",
    "SSN": r"\b\d{3}-\d{2}-\d{4}\b",
    "A-NUMBER": r"A-\d{3}-\d{3}-\d{3}",
    "DATE": r"\b\d{4}-\d{2}-\d{2}\b",
    "ADDRESS": r"\b\d{2,4} [\w ]+?(?:Ave|St|Street|Avenue|Rd|Road), [\w ]+, [A-Z]{2} \d{5}",
}
PLACEHOLDER_TOKEN = r"\[[A-Z][A-Z0-9_]*\]"
PLACEHOLDER = r"\{\{([A-Z][A-Z0-9_]*)\}\}"

# The prefix of the token that stands for each category.
CATEGORY_PREFIX = {
    "private_person": "PERSON",
    "private_email": "EMAIL",
    "private_phone": "PHONE",
    "private_address": "ADDRESS",
    "private_url": "URL",
    "private_date": "DATE",
    "account_number": "ACCOUNT",
    "secret": "SECRET",
}

# Display names of known cases.
CASES = {
    "microsoft_activision": "Microsoft / Activision Blizzard",
    "adobe_figma": "Adobe / Figma",
    "cisco_splunk": "Cisco / Splunk",
    "amazon_irobot": "Amazon / iRobot",
    "jetblue_spirit": "JetBlue / Spirit",
    "chiesi_amryt": "Chiesi / Amryt",
    "renesas_transphorm": "Renesas / Transphorm",
    "renesas_sequans": "Renesas / Sequans",
    "pelican_gse": "Pelican / GSE",
    "altair_datawatch": "Altair / Datawatch",
}


def clip(text: Column | str) -> Column:
    """White space runs become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def action(role: Column, kind: Column, tool: Column) -> Column:
    return F.when(kind == "message", role).otherwise(F.concat_ws(" ", tool, F.when(kind == "tool_call", "call").otherwise("result")))


def truthy(json: Column, path: str) -> Column:
    """The scalar at a JSON path unless it is missing, null, false, zero or empty."""
    v = F.get_json_object(json, path)
    return F.when(~v.isin("", "false", "0", "0.0", "[]", "{}"), v)


@F.pandas_udf(StringType())
def json_text(raw: pd.Series) -> pd.Series:
    """A JSON value in one form: ASCII, a space after each comma and colon. Nulls stay; what is no JSON stays as it is."""

    def one(t: str | None) -> str | None:
        try:
            return None if t is None else json.dumps(json.loads(t))
        except (ValueError, RecursionError):
            return t

    return raw.map(one)


def call_detail(arguments: Column) -> Column:
    """The query, else the chunk, else all arguments."""
    named = F.coalesce(truthy(arguments, "$.query"), truthy(arguments, "$.chunk_id"))
    return clip(F.coalesce(named, json_text(F.when(named.isNull(), F.coalesce(arguments, F.lit("{}"))))))


def result_detail(result: Column, tool: Column) -> Column:
    """Search results are summed up: how many, and the first three chunks."""
    chunks = F.from_json(F.get_json_object(result, "$.results"), "array<struct<chunk_id:string>>")
    top = F.array_join(F.transform(F.slice(F.coalesce(chunks, F.array().cast("array<struct<chunk_id:string>>")), 1, 3), lambda x: x["chunk_id"]), ", ")
    search = F.concat(F.coalesce(F.get_json_object(result, "$.matched_chunks"), F.lit("0")), F.lit(" matches — top: "), top)
    told = F.when(tool == "search_documents", search).otherwise(F.get_json_object(result, "$.text"))
    return clip(F.coalesce(told, json_text(F.when(told.isNull(), F.coalesce(result, F.lit("{}"))))))


def title(snake: Column) -> Column:
    """Spaces for underscores; a letter is upper case unless another stands before it."""
    letters = F.split(F.replace(snake, F.lit("_"), F.lit(" ")), "")
    inside = lambda i: F.regexp_like(F.get(letters, i - 1), F.lit(r"\A\p{L}\z"))
    return F.array_join(F.transform(letters, lambda c, i: F.when(F.coalesce(inside(i), F.lit(False)), F.lower(c)).otherwise(F.upper(c))), "")


def case_key(case_id: Column) -> Column:
    """Without the last part, which is the year."""
    return F.regexp_replace(case_id, "_[^_]*$", "")


def matter(case_id: Column, workflow: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in CASES.items() for x in kv))
    return F.concat(F.coalesce(F.try_element_at(known, case_key(case_id)), title(case_key(case_id))), F.lit(" — "), title(workflow))


def parties(label: Column) -> Column:
    """The companies that a matter's label names."""
    return F.split(F.get(F.split(label, " — "), F.lit(0)), " / ")


def deal_year(trace_id: Column) -> Column:
    return F.nullif(F.regexp_extract(trace_id, r"((?:19|20)\d{2})", 1), F.lit(""))


def strip_parties(text: Column, names: Column) -> Column:
    """The i-th party, or its first word alone, becomes [ORG_i]; case does not matter, word ends do.

    Longer forms go first, so that a full name never leaves its tail behind."""
    token = lambda i: F.concat(F.lit("[ORG_"), i + 1, F.lit("]"))
    forms = F.flatten(F.transform(names, lambda n, i: F.transform(F.array(n, F.get(F.split(n, " "), F.lit(0))), lambda f: F.struct(f.alias("f"), token(i).alias("t")))))
    quoted = lambda f: F.concat(F.lit(r"(?iU)\b\Q"), f, F.lit(r"\E\b"))
    return F.aggregate(F.filter(forms, lambda x: x["f"] != ""), text, lambda a, x: F.regexp_replace(a, quoted(x["f"]), x["t"]))


def mark_pii(text: Column, names: tuple[str, ...] = ()) -> Column:
    """Names first, longest first, then the display patterns; later ones see the marks of earlier ones."""
    for name in sorted(names, key=len, reverse=True):
        text = F.replace(text, F.lit(name), F.lit(MARK + name + MARK))
    for kind, pattern in DISPLAY_PATTERNS.items():
        found = F.regexp_replace(text, pattern, MARK + "$0" + MARK)
        # An unbounded pattern is tried only where it can match.
        text = F.when(F.contains(text, F.lit("@")), found).otherwise(text) if kind == "EMAIL" else found
    return text


def mark_placeholders(text: Column) -> Column:
    return F.regexp_replace(text, PLACEHOLDER_TOKEN, MARK + "$0" + MARK)


def unmarked(text: Column) -> Column:
    return F.replace(text, F.lit(MARK), F.lit(""))


def fill_detail(text: Column, guesses: Column) -> Column:
    """[ORG_n] becomes the n-th guess, or the first if there are fewer (or n is 0, or no whole number that fits);
    no guesses, no change."""
    tokens = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[ORG_(\d+)\]"), F.lit(1)))
    guess = lambda n: F.coalesce(F.get(guesses, n.try_cast("int") - 1), F.get(guesses, F.lit(0)))
    filled = F.aggregate(tokens, text, lambda a, n: F.replace(a, F.concat(F.lit("[ORG_"), n, F.lit("]")), guess(n)))
    return F.when(F.size(guesses) > 0, filled).otherwise(text)


def placeholder_prefix(category: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in CATEGORY_PREFIX.items() for x in kv))
    other = F.regexp_replace(F.regexp_replace(F.upper(category), "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.try_element_at(known, category), F.nullif(other, F.lit("")), F.lit("PII"))


def alias_norm(value: Column) -> Column:
    """What two spellings of one entity share: its letters and digits."""
    return F.coalesce(F.nullif(F.regexp_replace(F.lower(value), "[^a-z0-9]+", ""), F.lit("")), F.lower(F.trim(value)))


def luhn(digits: Column) -> Column:
    """Does a string of digits pass the Luhn check? Anything else, the empty string too, does not."""
    n = F.length(digits)
    each = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(digits, i, F.lit(1)).try_cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1))
    fits = F.aggregate(each, F.lit(0), lambda a, d: a + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0
    return F.when(digits.isNotNull(), F.regexp_like(digits, F.lit(r"\A[0-9]+\z")) & F.coalesce(fits, F.lit(False)))


def iso_date(text: Column) -> Column:
    """The date if the text is YYYY-MM-DD and on the calendar, else null."""
    return F.when(F.regexp_like(text, F.lit(r"^\d{4}-\d{2}-\d{2}$")), F.try_to_date(text, "yyyy-MM-dd"))


def json_number(value_json: Column) -> Column:
    """The number if the JSON scalar is a finite one, else null; true and false are none."""
    n = F.when(F.regexp_like(value_json, F.lit(r"^-?(0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?$")), value_json.try_cast("double"))
    return F.when(F.abs(n) < float("inf"), n)


def inline_scalar(value_json: Column) -> Column:
    """How a JSON scalar reads inside a text."""
    return F.when(F.startswith(value_json, F.lit('"')), F.get_json_object(F.concat(F.lit('{"v":'), value_json, F.lit("}")), "$.v")).otherwise(value_json)


def dashboard_clip(text: Column, most: int = 240) -> Column:
    """At most so many characters; a mark that the cut leaves open is closed."""
    cut = F.substring(text, 1, most)
    odd = (F.length(cut) - F.length(unmarked(cut))) % 2 == 1
    return F.when(F.length(text) <= most, text).otherwise(F.concat(cut, F.when(odd, MARK).otherwise(""), F.lit(" …")))


def detail_parts(text: Column) -> Column:
    """Parts between marks; those at odd places are marked."""
    return F.transform(F.split(text, MARK), lambda x, i: F.struct(x.alias("part"), (i % 2 == 1).alias("marked")))


def score_class(score: Column) -> Column:
    return F.when(score >= 50, "bad").when(score >= 10, "warn").otherwise("good")


def dot_class(score: Column) -> Column:
    return F.when(score > 90, "red").when(score == 0, "green").otherwise("yellow")


def only_placeholders(text: Column) -> Column:
    return F.contains(text, F.lit("{{")) & F.regexp_like(text, F.lit(r"(?U)^(?:\{\{[A-Z][A-Z0-9_]*\}\}|[^\w]|_)*$"))


def ascii_words(text: Column) -> Column:
    """Lower-cased words of ASCII letters and digits, one space between."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def mentions_exact(words: Column, alias: Column) -> Column:
    """Is the alias a run of whole words, however it is spaced? Both are arrays of normalised words, as columns
    of their own: an expression in their place would run again for each word."""
    compact = F.array_join(alias, "")

    def runs(width: Column) -> Column:
        at = F.when(F.size(words) >= width, F.sequence(F.lit(1), F.size(words) - width + 1)).otherwise(F.array().cast("array<int>"))
        return F.exists(at, lambda i: F.array_join(F.slice(words, i, width), "") == compact)

    return (compact != "") & F.exists(F.sequence(F.greatest(F.size(alias) - 1, F.lit(1)), F.size(alias) + 1), runs)
