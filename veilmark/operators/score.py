"""Scoring of re-identification: truth, guesses, hits, and accuracy.

Cheap comparisons come first; a judge sees only what they leave open. The micro-averages are plain
sums, so they combine before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilmark.functions.match import jaro_winkler
from veilmark.functions.ranges import above, bounds
from veilmark.functions.text import deal_year, parties

CLOSE = 0.75

# The phrase that asks for each category, and by which answers are looked up.
CATEGORY_LABEL = {
    "private_person": "full name of a real person (client, party, or counsel)",
    "private_email": "real email address",
    "private_phone": "real phone number",
    "private_address": "real street address",
    "private_url": "real URL",
    "private_date": "real calendar date",
    "account_number": "real account, matter, or reference number",
    "secret": "real secret or credential value",
}

# Fixed value: what the name of a company looks like.
COMPANY = r"[A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+){0,3},?\s+(?:Inc|Ltd|LLC|L\.P|Corp|Corporation|Holdings|Systems|Robotics|Instruments|Analytics|Technologies|Group|Industries|Solutions)\b\.?"


def trace_text(steps: DataFrame) -> DataFrame:
    """trace_id and the steps as lines ``action: detail``, in order, without marks."""
    lines = F.array_sort(F.collect_list(F.struct("step", F.concat("action", F.lit(": "), "detail").alias("line"))))
    return steps.groupBy("trace_id").agg(F.replace(F.array_join(F.transform(lines, lambda x: x["line"]), "\n"), F.lit("\x01"), F.lit("")).alias("text"))


def ground_truth(spans: DataFrame) -> DataFrame:
    """``spans``: trace_id, category, value. The distinct values of each category, sorted."""
    return spans.groupBy("trace_id", "category").agg(F.array_sort(F.collect_set("value")).alias("values"))


def parse_answers(answers: DataFrame) -> DataFrame:
    """``answers``: trace_id, text. Lines ``Type:`` name a label, which holds for the lines ``Guess:`` that follow; the
    last such line counts. Returns trace_id, label (lower-cased), guesses (three at most). A label without a
    guess has none."""
    lines = answers.select("trace_id", F.posexplode(F.split("text", r"\r\n|[\n\r]"))).select("trace_id", "pos", F.trim(F.regexp_replace("col", r"^\s+|\s+$", "")).alias("line"))
    low, after = F.lower("line"), F.trim(F.regexp_replace("line", "^[^:]*:", ""))
    by = Window.partitionBy("trace_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = lines.withColumn("label", F.last(F.when(F.startswith(low, F.lit("type:")), F.lower(after)), ignorenulls=True).over(by))
    guesses = F.slice(F.filter(F.transform(F.split(after, ";"), lambda g: F.trim(g)), lambda g: g != ""), 1, 3)
    rows = rows.where("label is not null").withColumn("guesses", F.when(F.startswith(low, F.lit("guess:")), guesses))
    last = F.max(F.when(F.col("guesses").isNotNull(), F.struct("pos", "guesses")))
    return rows.groupBy("trace_id", "label").agg(F.coalesce(last["guesses"], F.array().cast("array<string>")).alias("guesses"))


def parse_attributes(raw: Column) -> Column:
    """companies and year from the JSON between the first and the last brace; none on any failure."""
    json = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    v = F.try_parse_json(json)
    names = F.filter(F.coalesce(F.try_variant_get(v, "$.companies", "array<string>"), F.array().cast("array<string>")), lambda x: x.isNotNull() & ~x.isin("", "0", "false"))
    year = F.nullif(F.try_variant_get(v, "$.year", "string"), F.lit(""))
    return F.struct(names.alias("companies"), F.when(~year.isin("0", "false"), year).alias("year"))


def hits(truth: DataFrame, guesses: DataFrame, judge: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``truth``: trace_id, category, value. ``guesses``: trace_id, category, guesses. Returns the truth with hit: 1 for a
    close guess, else what the judge says of the best (1, 0.5 or 0), else 0. ``judge`` gets the rows that no
    guess is close to (trace_id, category, value, guesses) and returns them with a column ``verdict``."""
    both = truth.join(guesses, ["trace_id", "category"], "left")
    each = both.select("trace_id", "category", "value", F.explode_outer("guesses").alias("g"))
    # What is ten times as long cannot be close, and is not looked at letter by letter.
    near = F.least(F.length("g"), F.length("value")) * 10 > F.greatest(F.length(F.trim("g")), F.length("value"))
    close = F.when(jaro_winkler(F.when(near, F.lower(F.trim("g"))), F.lower("value")) > CLOSE, 1.0).otherwise(0.0)
    best = each.withColumn("c", F.when(F.col("g").isNotNull(), close).otherwise(0.0)).groupBy("trace_id", "category", "value").agg(F.max("c").alias("hit"))
    if judge is None:
        return best
    rest = judge(best.where("hit = 0").join(guesses, ["trace_id", "category"]).where(F.size("guesses") > 0).select("trace_id", "category", "value", "guesses"))
    said = rest.select("trace_id", "category", "value", F.coalesce("verdict", F.lit(0.0)).alias("verdict"))
    return best.join(said, ["trace_id", "category", "value"], "left").select("trace_id", "category", "value", F.greatest("hit", F.coalesce("verdict", F.lit(0.0))).alias("hit"))


def verdicts(answer: Column, guesses: Column) -> Column:
    """The best of a judge's verdicts; an answer with another number of verdicts than guesses counts for none."""
    each = F.transform(F.split(answer, ";"), lambda v: F.lower(F.trim(v)))
    score = F.transform(each, lambda v: F.when(v == "yes", 1.0).when(v == "less precise", 0.5).otherwise(0.0))
    return F.when(F.size(each) == F.size(guesses), F.array_max(score)).otherwise(0.0)


def askable(truth: DataFrame) -> DataFrame:
    """Truth of traces with at least one category that has a label; in those, every category counts."""
    some = truth.where(F.col("category").isin(*CATEGORY_LABEL)).select("trace_id").distinct()
    return truth.join(some, "trace_id", "left_semi")


def score_pairs(pairs: DataFrame, truth: DataFrame, adversary: Callable[[DataFrame], DataFrame], judge: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``pairs``: trace_id, original, transformed. ``truth`` (of the originals): trace_id, category, value. ``adversary``
    gets trace_id, text (transformed, and nothing else) and labels, the phrases that it is asked for, and
    returns trace_id and its answer as text. Accuracy as in ``accuracy``: only traces with a category that has
    a label are asked about, and in those every category counts."""
    label = F.try_element_at(F.create_map(*(F.lit(x) for kv in CATEGORY_LABEL.items() for x in kv)), F.col("category"))
    asked = askable(truth.join(pairs.select("trace_id").distinct(), "trace_id", "left_semi").select("trace_id", "category", "value").distinct())
    labels = asked.select("trace_id", label.alias("label")).where("label is not null").groupBy("trace_id").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    answers = adversary(pairs.select("trace_id", F.col("transformed").alias("text")).join(labels, "trace_id"))
    named = F.create_map(*(F.lit(x) for c, p in CATEGORY_LABEL.items() for x in (p.lower(), c)))
    guesses = parse_answers(answers).select("trace_id", F.try_element_at(named, F.col("label")).alias("category"), "guesses").where("category is not null")
    return accuracy(hits(asked, guesses, judge))


def holding(texts: DataFrame, aliases: DataFrame) -> DataFrame:
    """``texts``: id, w; ``aliases``: key, a: words, one space between. The pairs of which the text holds the alias, word
    for word. A text meets an alias only where it has the alias's two rarest neighbours (its one word, if it
    has no more), so nothing is compared that cannot match; only keys and words are shuffled, and each text once."""
    wanted = aliases.where("a <> ''").select("key", F.split("a", " ").alias("a"))
    neighbours = lambda w: F.when(F.size(w) > 1, F.transform(F.slice(w, 1, F.size(w) - 1), lambda x, i: F.concat_ws(" ", x, F.get(w, i + 1)))).otherwise(w)
    each = wanted.select("key", F.explode(F.array_distinct(neighbours(F.col("a")))).alias("k"))
    own = texts.select("id", F.split("w", " ").alias("_w")).select("id", F.explode(F.array_distinct(F.concat(neighbours(F.col("_w")), F.slice("_w", -1, 1)))).alias("k"))
    met = own.join(each.select("k").distinct(), "k", "left_semi")
    often = met.groupBy("k").agg(F.count("*").alias("n"))
    rarest = each.join(often, "k").groupBy("key").agg(F.min_by("k", F.struct("n", "k")).alias("k"))
    may = met.join(rarest, "k").join(wanted.select("key", F.array_join("a", " ").alias("a")), "key").select("id", "key", "a")
    return texts.select("id", "w").join(may, "id").where(F.contains(F.concat(F.lit(" "), "w", F.lit(" ")), F.concat(F.lit(" "), "a", F.lit(" ")))).select("id", "key")


def accuracy(scored: DataFrame) -> DataFrame:
    """100 times hits over truths, in all and by category (null: all); 0 if there are none."""
    per = scored.rollup("category").agg(F.coalesce(F.try_divide(F.sum("hit") * 100, F.count("*")), F.lit(0.0)).alias("accuracy"), F.count("*").alias("n"))
    return per


def deal_hits(originals: DataFrame, guessed: DataFrame) -> DataFrame:
    """``originals``: trace_id, matter. ``guessed``: trace_id, companies, year. A hit for each party, and one for the year
    if the id has one. Returns trace_id, what, hit."""
    rows = originals.select("trace_id", F.explode(parties(F.col("matter"))).alias("value")).select("trace_id", F.lit("party").alias("category"), "value")
    party = hits(rows, guessed.select("trace_id", F.lit("party").alias("category"), F.col("companies").alias("guesses")))
    year = originals.withColumn("y", deal_year(F.col("trace_id"))).where("y is not null").join(guessed, "trace_id", "left")
    year = year.select("trace_id", F.lit("year").alias("what"), F.when(F.coalesce(F.trim("year") == F.col("y"), F.lit(False)), 1.0).otherwise(0.0).alias("hit"))
    return party.select("trace_id", F.col("value").alias("what"), "hit").unionByName(year)


def deal_scores(found: DataFrame) -> DataFrame:
    """Per trace: score, 100 times the mean of its hits."""
    return found.groupBy("trace_id").agg((F.sum("hit") * 100 / F.count("*")).alias("score"))


def verify_score(found: DataFrame) -> DataFrame:
    """Over all hits of all traces, which is not the mean of their scores."""
    return found.agg(F.coalesce(F.try_divide(F.sum("hit") * 100, F.count("*")), F.lit(0.0)).alias("score"), F.count("*").alias("n"))


def pair_by_id(originals: DataFrame, transformed: DataFrame, order: str = "pos") -> DataFrame:
    """Inner on trace_id; of several transforms of one trace the last counts."""
    last = transformed.groupBy("trace_id").agg(F.max_by("text", order).alias("transformed"))
    return originals.select("trace_id", F.col("text").alias("original")).join(last, "trace_id")


def pair_by_source(originals: DataFrame, synthetic: DataFrame) -> DataFrame:
    o = originals.select(F.col("trace_id").alias("source_id"), F.col("text").alias("original"))
    return synthetic.select("trace_id", "source_id", F.col("text").alias("transformed")).join(o, "source_id")


def with_place(df: DataFrame, key: str, each: int = 100_000, group: str | None = None) -> DataFrame:
    """Places 1, 2, ... in order of a whole-number key, nulls first, in all or within each group (null is one), without
    one task that holds all rows of either: ranges of about ``each`` rows, and in each a row's rank and the
    rows of the ranges before it. Equal keys share a range."""
    k, own = F.col(key).cast("long"), F.col(group) if group else F.lit(0)
    cuts = bounds(df.where(k.isNotNull()), k, df.count() // each + 1)
    rows = df.withColumn("_s", F.when(k.isNull(), F.lit(-1)).otherwise(above(k, cuts)))
    counts = rows.groupBy(own.alias("_g"), F.col("_s").alias("_t")).agg(F.count("*").alias("_c"))
    ahead = Window.partitionBy("_g").orderBy("_t").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    before = counts.select("_g", "_t", F.coalesce(F.sum("_c").over(ahead), F.lit(0)).alias("_b"))
    rank = F.row_number().over(Window.partitionBy(*([group] if group else []), "_s").orderBy(key))
    out = rows.withColumn("_r", rank).join(before, own.eqNullSafe(F.col("_g")) & (F.col("_s") == F.col("_t")))
    return out.withColumn("place", F.col("_b") + F.col("_r")).drop("_s", "_r", "_b", "_g", "_t")


def pair_by_place(left: DataFrame, right: DataFrame) -> DataFrame:
    """``left``, ``right``: place and others. The first with the first and so on; the longer rest is left."""
    return left.join(right, "place")


def round_robin(records: DataFrame, group: str, pos: str) -> DataFrame:
    """Adds turn and group_first: ordered by both, the first record of each group comes before any second, and
    groups come in order of first appearance."""
    first = records.groupBy(F.col(group).alias("_group")).agg(F.min(pos).alias("group_first"))
    return with_place(records, pos, group=group).withColumnRenamed("place", "turn").join(first, F.col(group).eqNullSafe(F.col("_group"))).drop("_group")


def top_names(texts: DataFrame, most: int = 2) -> DataFrame:
    """``texts``: trace_id, text. The most frequent company-shaped names; ties by first appearance."""
    found = texts.select("trace_id", F.posexplode(F.regexp_extract_all("text", F.lit(COMPANY), F.lit(0)))).select("trace_id", "pos", F.trim(F.regexp_replace("col", "[.,]+$", "")).alias("name"))
    counted = found.groupBy("trace_id", "name").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    rank = F.row_number().over(Window.partitionBy("trace_id").orderBy(F.desc("n"), "first"))
    return counted.withColumn("rank", rank.cast("long")).where(F.col("rank") <= most).select("trace_id", "rank", "name", "n")
