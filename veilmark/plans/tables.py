"""Queries that run an operator over whole tables, with values made of the columns, where the tables hold nothing of
the operator's own kind. Each has a twin that computes the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilmark.functions import text as T
from veilmark.functions.match import normalize_identity
from veilmark.operators import score as S
from veilmark.operators import template, validate, world
from veilmark.operators.world import WorldRules
from veilmark.plans.registry import query, table
from veilmark.sources import traces as R
from veilmark.sources.config import ground_of


@query(r"""
SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?i)\b' || a || '\b', '[ORG_1]', 'g'), '(?i)\b' || string_split(a, ' ')[1] || '\b', '[ORG_1]', 'g'), '(?i)\b' || b || '\b', '[ORG_2]', 'g'), '(?i)\b' || b || '\b', '[ORG_2]', 'g') AS text
FROM (SELECT p_partkey, p_name || ', a ' || lower(p_type) || ' ' || upper(p_name) || '; ' || string_split(p_name, ' ')[1] || 's and ' || string_split(p_name, ' ')[1] AS text, p_name AS a, p_type AS b FROM part)
""")
def strip_parties(spark, d):
    p = table(spark, d, "part")
    first = F.split("p_name", " ")[0]
    text = F.concat("p_name", F.lit(", a "), F.lower("p_type"), F.lit(" "), F.upper("p_name"), F.lit("; "), first, F.lit("s and "), first)
    label = F.concat("p_name", F.lit(" / "), "p_type", F.lit(" — Review"))
    return p.select("p_partkey", T.strip_parties(text, T.parties(label)).alias("text"))


@query("""
SELECT o_orderkey, CASE WHEN len(g) = 0 THEN text ELSE replace(replace(text, '[ORG_' || i || ']', coalesce(g[i], g[1])), '[ORG_' || j || ']', coalesce(g[j], g[1])) END AS text FROM (
  SELECT o_orderkey, o_orderkey % 5 AS i, o_custkey % 4 AS j, '[ORG_' || (o_orderkey % 5) || '] owes [ORG_' || (o_custkey % 4) || '], not [PERSON_1]' AS text,
    CASE WHEN o_orderkey % 3 = 0 THEN [] ELSE ['Customer ' || o_custkey, o_orderpriority] END AS g FROM orders)
""")
def fill_detail(spark, d):
    text = F.concat(F.lit("[ORG_"), F.col("o_orderkey") % 5, F.lit("] owes [ORG_"), F.col("o_custkey") % 4, F.lit("], not [PERSON_1]"))
    guesses = F.when(F.col("o_orderkey") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("Customer "), "o_custkey"), F.col("o_orderpriority")))
    return table(spark, d, "orders").select("o_orderkey", T.fill_detail(text, guesses).alias("text"))


@query("""
SELECT o_orderkey, '{"text":"Customer#' || o_custkey || ' \\"first\\" pays ' || o_orderkey || '","amount":' || o_orderkey || ',"paid":' || (o_orderstatus = 'F') || ',"Customer#' || o_custkey || ' \\"first\\"":null}' AS payload FROM orders
""")
def fill_world(spark, d):
    buyer = F.concat(F.lit('"Customer#'), "o_custkey", F.lit(r" \"first\""), F.lit('"'))
    bound = F.create_map(F.lit("BUYER"), buyer, F.lit("PRICE"), F.col("o_orderkey").cast("string"), F.lit("PAID"), (F.col("o_orderstatus") == "F").cast("string"))
    payload = F.lit('{"text":"{{BUYER}} pays {{PRICE}}","amount":"{{PRICE}}","paid":"{{PAID}}","{{BUYER}}":null}')
    return table(spark, d, "orders").select("o_orderkey", template.fill_json(payload, bound).alias("payload"))


@query("""
WITH w AS (
  SELECT o_orderkey, o_custkey AS price, o_orderkey % 50 AS fee, CAST(o_orderdate AS DATE) AS signed, CAST(o_orderdate AS DATE) + CAST(o_custkey % 20 - 5 AS INTEGER) AS closed, o_orderkey % 2 AS law, o_orderkey % 3 AS court, o_orderkey % 11 = 0 AS lost, o_orderkey % 13 = 0 AS odd FROM orders
)
SELECT CAST(o_orderkey AS VARCHAR) AS trace_id, rule, what FROM (
  SELECT o_orderkey, 'W2' AS rule, 'low key' AS what, odd AS bad FROM w
  UNION ALL SELECT o_orderkey, 'W3', '', odd OR lost FROM w
  UNION ALL SELECT o_orderkey, 'W5', 'SIGNING_DATE<=CLOSING_DATE', signed > closed FROM w
  UNION ALL SELECT o_orderkey, 'W6', 'SIGNING_DATE<=CLOSING_DATE', signed > closed FROM w
  UNION ALL SELECT o_orderkey, 'W7', 'PRICE', price NOT BETWEEN 10 AND 120 FROM w
  UNION ALL SELECT o_orderkey, 'W8', 'FEE/PRICE', lost OR price = 0 OR fee / price NOT BETWEEN 0.1 AND 0.5 FROM w
  UNION ALL SELECT o_orderkey, 'W9', 'LAW~COURT', NOT (law = 0 AND court = 0 OR law = 1 AND court = 1) FROM w
) WHERE bad
""")
def world_violations(spark, d):
    """A world for each order, with keys missing, misnamed and out of bounds here and there."""
    key = F.col("o_orderkey")
    day = lambda c: F.concat(F.lit('"'), F.date_format(c, "yyyy-MM-dd"), F.lit('"'))
    signed = F.to_date("o_orderdate")
    listed = {"PRICE": F.col("o_custkey"), "FEE": key % 50, "SIGNING_DATE": day(signed), "CLOSING_DATE": day(F.date_add(signed, (F.col("o_custkey") % 20 - 5).cast("int"))), "LAW": key % 2, "COURT": key % 3}
    own = F.array(*(F.when(~((F.lit(k) == "FEE") & (key % 11 == 0)), F.struct(F.lit(k).alias("key"), v.cast("string").alias("value_json"))) for k, v in listed.items()), F.when(key % 13 == 0, F.struct(F.lit("low key").alias("key"), F.lit("1").alias("value_json"))))
    orders = table(spark, d, "orders").withColumn("trace_id", key.cast("string"))
    worlds = orders.select("trace_id", F.explode(F.array_compact(own)).alias("w")).select("trace_id", "w.*")
    rules = WorldRules((("SIGNING_DATE", "CLOSING_DATE"),), {"PRICE": (10, 120)}, {("FEE", "PRICE"): (0.1, 0.5)}, {("LAW", "COURT"): (("0", "0"), ("1", "1"))})
    return world.violations(worlds, orders.select("trace_id", F.array(*map(F.lit, sorted(listed))).alias("placeholders")), rules)


@query("""
SELECT event_id, CASE event_id % 8 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN 'fields' WHEN 3 THEN 'type' WHEN 4 THEN 'length' WHEN 5 THEN 'duplicate key' WHEN 6 THEN 'number is not finite' ELSE 'not JSON' END AS error FROM events
""")
def shape_rules(spark, d):
    """What a rewrite of an event's properties does to their shape."""
    k = F.coalesce(F.get_json_object("props", "$.k"), F.lit("0"))
    before = F.concat(F.lit('{"k":'), k, F.lit(',"of":[1,'), F.col("event_id"), F.lit("]}"))
    tail = F.concat(F.lit(',"of":[1,'), F.col("user_id"), F.lit("]}"))
    forms = [F.concat(F.lit('{"k":"{{K}}"'), tail), F.concat(F.lit('{"k":7.5'), tail), F.concat(F.lit('{"j":7'), tail), F.concat(F.lit('{"k":true'), tail), F.lit('{"k":1,"of":[1]}'), F.concat(F.lit('{"k":1,"k":1'), tail), F.concat(F.lit('{"k":1e999'), tail), F.concat(F.lit('{"k"'), tail)]
    after = F.coalesce(*(F.when(F.col("event_id") % 8 == i, f) for i, f in enumerate(forms)))
    return table(spark, d, "events").select("event_id", before.alias("b"), after.alias("a")).select("event_id", validate.shape_errors(True)("b", "a").alias("error"))


@query("""
SELECT 'e' || event_id AS trace_id, 'real email address' AS label, CASE WHEN event_id % 3 = 0 THEN 'late@x.org' ELSE 'u' || user_id || '@x.org; ' || event_type || '; 3' END AS guesses FROM events
UNION ALL SELECT 'e' || event_id, 'real phone number', '' FROM events WHERE event_id % 2 = 0
""")
def parse_answers(spark, d):
    e = F.col("event_id")
    guess = F.concat(F.lit("Guess: lost\nType: Real Email Address \r\nInference: none\nGuess: u"), "user_id", F.lit("@x.org; ; "), "event_type", F.lit(" ;3; 4"))
    text = F.concat(guess, F.when(e % 3 == 0, "\nguess: late@x.org").otherwise(""), F.when(e % 2 == 0, "\nType: real phone number\nCertainty: 2").otherwise(""))
    answers = table(spark, d, "events").select(F.concat(F.lit("e"), e).alias("trace_id"), text.alias("text"))
    return S.parse_answers(answers).select("trace_id", "label", F.array_join("guesses", "; ").alias("guesses"))


@query("""
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'U' || user_id || '; ' || event_type WHEN 1 THEN event_type ELSE '' END AS companies, CASE event_id % 4 WHEN 0 THEN CAST(2000 + user_id % 30 AS VARCHAR) WHEN 1 THEN CAST(user_id + 1 AS VARCHAR) END AS year FROM events
""")
def parse_attributes(spark, d):
    e, u = F.col("event_id") % 4, F.col("user_id")
    whole = F.concat(F.lit('Sure: {"companies":["U'), u, F.lit('","'), "event_type", F.lit('",""],"year":"'), 2000 + u % 30, F.lit('"} done'))
    number = F.concat(F.lit('{"companies":["'), "event_type", F.lit('"],"year":'), u + 1, F.lit("}"))
    answer = F.when(e == 0, whole).when(e == 1, number).when(e == 2, F.lit('{"companies":["A"], broken')).otherwise("no JSON")
    return table(spark, d, "events").select("event_id", S.parse_attributes(answer).alias("a")).select("event_id", F.array_join("a.companies", "; ").alias("companies"), "a.year")


@query("""
WITH w AS (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM documents),
a AS (SELECT *, w[2] || w[3] AS strung, w[3] || w[2] AS turned FROM w)
SELECT doc_id, coalesce(len(w) > 2 AND strung <> '', false) AS strung,
  coalesce(len(w) > 2 AND turned <> '' AND (list_contains(w, turned) OR len(list_filter(range(1, len(w)), lambda i: w[i] || w[i + 1] = turned)) > 0), false) AS turned FROM a
""")
def mentions_spaced(spark, d):
    """Does each document name its second and third word, strung together, and in turned order?"""
    docs = table(spark, d, "documents").select("doc_id", F.split(T.ascii_words(F.col("text")), " ").alias("w"))
    alias = lambda a, b: F.array(F.concat(F.get("w", F.lit(a)), F.get("w", F.lit(b))))
    own = docs.select("doc_id", "w", alias(1, 2).alias("a"), alias(2, 1).alias("b"))
    named = lambda a: F.coalesce((F.size("w") > 2) & T.mentions_exact(F.col("w"), F.col(a)), F.lit(False))
    return own.select("doc_id", named("a").alias("strung"), named("b").alias("turned"))


@query("SELECT c_custkey, trim(regexp_replace(lower(c_name || ' (' || c_mktsegment || ')'), '[^a-z0-9]+', ' ', 'g')) AS form FROM customer")
def normalized_names(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", normalize_identity(F.concat("c_name", F.lit(" ("), "c_mktsegment", F.lit(")"))).alias("form"))


_GROUP = "upper(left(w, 1)) || substr(w, 2)"


@query(f"""
WITH own AS (SELECT p_brand, p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: {_GROUP}), ' ') || ' Group' AS name FROM part),
n AS (SELECT p_brand, name, count(*) AS n, min(p_partkey) AS first FROM own GROUP BY 1, 2)
SELECT p_brand AS trace_id, rank, name, n FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, first) AS rank FROM n) WHERE rank <= 2
""")
def top_parties(spark, d):
    """A text for each brand, with a company for each part; and the companies it names most."""
    parts = table(spark, d, "part").groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_partkey", F.concat(F.initcap("p_name"), F.lit(" Group")).alias("name")))).alias("own"))
    return S.top_names(parts.select(F.col("p_brand").alias("trace_id"), F.array_join(F.transform("own", lambda x: x["name"]), "., then ").alias("text")))


@query("SELECT DISTINCT '-' || lower(o_orderpriority) AS category, regexp_replace(regexp_replace(upper(o_orderpriority), '[^A-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS prefix FROM orders UNION SELECT event_type, upper(event_type) FROM events")
def placeholder_prefixes(spark, d):
    kinds = table(spark, d, "orders").select(F.concat(F.lit("-"), F.lower("o_orderpriority")).alias("category")).union(table(spark, d, "events").select("event_type")).distinct()
    return kinds.select("category", T.placeholder_prefix(F.col("category")).alias("prefix"))


@query("SELECT c_custkey, c_name || ' / ' || n_name || ' deal; ' || c_name || '; ' || n_name AS aliases FROM customer JOIN nation ON c_nationkey = n_nationkey")
def ground_from_labels(spark, d):
    own = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return own.select("c_custkey", F.array_join(ground_of(F.concat("c_name", F.lit(" / "), "n_name", F.lit(" — Review"))), "; ").alias("aliases"))


@query("""SELECT event_id, '{"k": ' || user_id || ', "gone": null, "of": [{"type": "' || event_type || '"}]}' AS payload FROM events""")
def repair_shapes(spark, d):
    """A rewrite that lost a null field and brought others along."""
    before = F.concat(F.lit('{"k":1,"gone":null,"of":[{"type":"x"}]}'))
    after = F.concat(F.lit('{"new":[],"of":[{"type":"'), "event_type", F.lit('","also":1}],"k":'), "user_id", F.lit("}"))
    return table(spark, d, "events").select("event_id", template.repair_shape(before, after).alias("payload"))


@query("SELECT 'conv_' || conv_id AS trace_id, (turn + 1)::BIGINT AS pos, 'text|' || coalesce(text, '') AS texts FROM conversations")
def payload_leaves(spark, d):
    s = R.conversation_segments(table(spark, d, "conversations"))
    return s.select("trace_id", F.col("pos").cast("long").alias("pos"), F.array_join(template.payload_texts("payload_json"), "|").alias("texts"))


@query("""
WITH t AS (SELECT c_custkey, c_mktsegment AS value, CASE c_custkey % 4 WHEN 0 THEN [' ' || lower(c_mktsegment)] WHEN 1 THEN [left(c_mktsegment, 5), 'x'] WHEN 2 THEN ['zzz', 'qqq'] ELSE NULL END AS guesses FROM customer)
SELECT 'c' || c_custkey AS trace_id, 'segment' AS category, value,
  CASE WHEN guesses IS NULL THEN 0.0::DOUBLE WHEN list_max(list_transform(guesses, lambda g: jaro_winkler_similarity(lower(trim(g)), lower(value)))) > 0.75 THEN 1.0 WHEN c_custkey % 3 = 0 THEN 0.5 ELSE 0.0 END AS hit FROM t
""")
def judged_hits(spark, d):
    """The judge gets only what no guess is close to, and its best verdict counts."""
    key, v = F.col("c_custkey"), F.col("c_mktsegment")
    own = table(spark, d, "customer").select(F.concat(F.lit("c"), key).alias("trace_id"), F.lit("segment").alias("category"), v.alias("value"), (key % 4).alias("k"))
    guesses = F.when(F.col("k") == 0, F.array(F.concat(F.lit(" "), F.lower("value")))).when(F.col("k") == 1, F.array(F.left("value", F.lit(5)), F.lit("x"))).otherwise(F.array(F.lit("zzz"), F.lit("qqq")))
    answer = F.when(F.substring("trace_id", 2, 99).cast("long") % 3 == 0, "no; less precise").otherwise("no; maybe")
    judge = lambda rest: rest.withColumn("verdict", S.verdicts(answer, F.col("guesses")))
    return S.hits(own.drop("k"), own.where("k < 3").select("trace_id", "category", guesses.alias("guesses")), judge)


_TOKENS = "CASE event_id % 5 WHEN 0 THEN '{{A}}, {{K_' || user_id || '}}!' WHEN 1 THEN '{{A}} and ' || event_type WHEN 2 THEN '_{{K}}' WHEN 3 THEN '...' ELSE '{{' || event_type || '}}' END"


@query(rf"SELECT event_id, contains(s, '{{{{') AND regexp_matches(s, '^(?:\{{\{{[A-Z][A-Z0-9_]*\}}\}}|[^\w]|_)*$') AS is_only FROM (SELECT event_id, {_TOKENS} AS s FROM events)")
def only_placeholders(spark, d):
    e = F.col("event_id") % 5
    s = F.when(e == 0, F.concat(F.lit("{{A}}, {{K_"), "user_id", F.lit("}}!"))).when(e == 1, F.concat(F.lit("{{A}} and "), "event_type")).when(e == 2, "_{{K}}").when(e == 3, "...").otherwise(F.concat(F.lit("{{"), "event_type", F.lit("}}")))
    return table(spark, d, "events").select("event_id", T.only_placeholders(s).alias("is_only"))


@query("""
WITH c AS (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations)
SELECT trace_id, pos, rule FROM (
  SELECT 'conv_' || conv_id AS trace_id, (turn + 1)::BIGINT AS pos, 'V3' AS rule, conv_id % 3 = 0 AND turn = 1 AS bad FROM c
  UNION ALL SELECT 'conv_' || conv_id, turn + 1, 'V5', conv_id % 4 = 0 AND turn = 0 FROM c
  UNION ALL SELECT 'conv_' || conv_id, turn + 1, 'V2', conv_id % 5 = 0 AND turn < 2 FROM c
) WHERE bad
""")
def conversation_violations(spark, d):
    """Conversations with a role, a payload or an id spoilt in some of them; nothing else is wrong in any."""
    n = F.substring("trace_id", 6, 99).cast("long")
    own = R.conversation_segments(table(spark, d, "conversations"))
    own = own.withColumn("role", F.when((n % 3 == 0) & (F.col("pos") == 2), "narrator").otherwise(F.col("role")))
    own = own.withColumn("payload_json", F.when((n % 4 == 0) & (F.col("pos") == 1), '{"text":["x"]}').otherwise(F.col("payload_json")))
    own = own.withColumn("segment_id", F.when((n % 5 == 0) & (F.col("pos") < 3), "same").otherwise(F.col("segment_id")))
    return validate.violations(own).select("trace_id", F.col("pos").cast("long").alias("pos"), "rule")


@query("SELECT 'conv_' || conv_id AS trace_id, (turn + 1)::BIGINT AS pos, 'message' AS kind, role, coalesce(text, '') AS text FROM conversations")
def record_roundtrip(spark, d):
    """Export to the source form and import again: every message comes back as it was."""
    segments = R.conversation_segments(table(spark, d, "conversations"))
    ids = segments.select("trace_id", F.concat(F.lit("synthetic_"), F.substring(F.sha2("trace_id", 256), 1, 12), F.lit("_t01")).alias("fresh")).distinct()
    records = R.source_records(segments, "review_matter")
    again = R.import_any(records.select(F.to_json(F.struct(*records.columns), {"ignoreNullFields": "false"}).alias("value")))
    back = again.where("error is null").withColumnRenamed("trace_id", "fresh").join(ids, "fresh")
    return back.select("trace_id", F.col("pos").cast("long").alias("pos"), "kind", "role", F.get_json_object("payload_json", "$.text").alias("text"))


@query("""
SELECT 'user_' || user_id AS trace_id, (event_id * 2 + k)::BIGINT AS step, CASE WHEN k = 0 THEN event_type || ' call' ELSE event_type || ' result' END AS action,
  CASE WHEN k = 1 THEN CASE WHEN event_id % 2 = 0 THEN 'done ' || event_id ELSE '{"ok": ' || event_id || '}' END WHEN event_id % 3 = 0 THEN 'find ' || event_id WHEN event_id % 3 = 1 THEN 'c' || user_id ELSE '{"n": [' || event_id || ', null]}' END AS detail
FROM events, (VALUES (0), (1)) AS t(k)
""")
def flatten_tool_events(spark, d):
    """Records with tool calls and results, flattened as the traces of a file are."""
    e, u = F.col("event_id"), F.col("user_id")
    arguments = F.when(e % 3 == 0, F.concat(F.lit('{"chunk_id":"no","query":" find  '), e, F.lit(' "}'))).when(e % 3 == 1, F.concat(F.lit('{"query":"","chunk_id":"c'), u, F.lit('"}'))).otherwise(F.concat(F.lit('{"n":['), e, F.lit(",null]}")))
    result = F.when(e % 2 == 0, F.concat(F.lit('{"text":"done\\n '), e, F.lit('"}'))).otherwise(F.concat(F.lit('{"ok":'), e, F.lit("}")))
    both = table(spark, d, "events").select(u, F.explode(F.array(*(F.struct((e * 2 + k).alias("sequence"), F.lit("assistant").alias("role"), F.lit(kind).alias("event_type"), F.col("event_type").alias("tool_name"), (arguments if k == 0 else F.lit(None).cast("string")).alias("arguments"), (result if k else F.lit(None).cast("string")).alias("result"), F.lit(None).cast("string").alias("content")) for k, kind in enumerate(("tool_call", "tool_result"))))).alias("x"))
    records = both.groupBy("user_id").agg(F.array_sort(F.collect_list("x")).alias("events")).select(F.concat(F.lit("user_"), "user_id").alias("trace_id"), F.lit("adobe_figma_2022").alias("case_id"), F.lit("review").alias("workflow"), "events")
    return R.flatten_records(records).select("trace_id", F.col("step").cast("long").alias("step"), "action", "detail")


@query("""
WITH t AS (SELECT 'c' || c_custkey AS trace_id, CASE c_custkey % 3 WHEN 0 THEN 'private_email' WHEN 1 THEN 'account_number' ELSE 'employee_id' END AS category, c_name AS value, c_custkey FROM customer),
h AS (SELECT category, CASE WHEN c_custkey % 2 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit FROM t WHERE category <> 'employee_id')
SELECT category, sum(hit) * 100 / count(*) AS accuracy, count(*) AS n FROM h GROUP BY ROLLUP (category)
""")
def score_pairs(spark, d):
    """The whole scorer: truth of the originals, an adversary that sees transformed texts only, hits and accuracy. Traces
    whose every category has no label are not asked about."""
    key = F.col("c_custkey")
    category = F.when(key % 3 == 0, "private_email").when(key % 3 == 1, "account_number").otherwise("employee_id")
    own = table(spark, d, "customer").select(F.concat(F.lit("c"), key).alias("trace_id"), category.alias("category"), F.col("c_name").alias("value"))
    pairs = own.select("trace_id", F.lit("the original").alias("original"), F.when(F.substring("trace_id", 2, 99).cast("long") % 2 == 0, F.col("value")).otherwise("gone").alias("transformed"))

    def adversary(asked):
        line = F.concat(F.lit("Type: "), F.element_at("labels", 1), F.lit("\nGuess: "), "text")
        return asked.select("trace_id", line.alias("text"))

    return S.score_pairs(pairs, own, adversary)
