"""The registered queries of the engine, each with its DuckDB twin where SQL can express it."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.functions import text as T
from veilmark.functions.match import jaro_winkler, mentions, normalize_identity
from veilmark.operators import score as S
from veilmark.operators import spans as P
from veilmark.operators import template, validate, world
from veilmark.operators.loop import Synthesis, published, synthesize
from veilmark.operators.models import ClueAttacker, PatternRewriter, RuleGenerator, WordListInferrer
from veilmark.operators.world import WorldRules
from veilmark.plans import fixtures as X
from veilmark.plans.registry import ORACLE, QUERIES, case, query, table
from veilmark.sources import traces as R
from veilmark.sources.config import ground_of

#: What (?U)\\s matches, for a dialect whose \\s is ASCII.
SPACE = r"[\s\v\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
PHONE = T.DISPLAY_PATTERNS["PHONE"]
LUHN = "list_sum(list_transform(range(1, length({d}) + 1), lambda i: CASE WHEN (length({d}) - i) % 2 = 0 THEN CAST(substr({d}, i, 1) AS INTEGER) ELSE CAST(substr({d}, i, 1) AS INTEGER) * 2 - CASE WHEN CAST(substr({d}, i, 1) AS INTEGER) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"


# --- sources and flattening ---------------------------------------------------------------------


@query(f"""
SELECT 'conv_' || conv_id AS trace_id, (turn + 1)::BIGINT AS step, role AS action, trim(regexp_replace(coalesce(text, ''), '{SPACE}', ' ', 'g')) AS detail
FROM conversations
""")
def flatten_conversations(spark, d):
    return R.conversation_steps(table(spark, d, "conversations")).withColumn("step", F.col("step").cast("long"))


@query(f"""
SELECT trace_id, string_agg(action || ': ' || detail, chr(10) ORDER BY step) AS text FROM (
  SELECT 'conv_' || conv_id AS trace_id, turn AS step, role AS action, trim(regexp_replace(coalesce(text, ''), '{SPACE}', ' ', 'g')) AS detail FROM conversations
) GROUP BY trace_id
""")
def conversation_text(spark, d):
    return S.trace_text(R.conversation_steps(table(spark, d, "conversations")))


@query("""
SELECT 'conv_' || conv_id AS trace_id, (turn + 1)::BIGINT AS pos, format('segment_{:04d}', row_number() OVER (PARTITION BY conv_id ORDER BY turn)) AS segment_id, role FROM conversations
""")
def neutral_segment_ids(spark, d):
    return R.conversation_segments(table(spark, d, "conversations")).select("trace_id", F.col("pos").cast("long").alias("pos"), "segment_id", "role")


@query("""
SELECT 'user_' || user_id AS trace_id, event_id * 2 + k AS pos,
  format('segment_{:04d}', row_number() OVER (PARTITION BY user_id ORDER BY event_id * 2 + k)) AS segment_id,
  format('call_{:04d}', dense_rank() OVER (PARTITION BY user_id ORDER BY event_id)) AS call_id,
  CASE WHEN k = 0 THEN 'tool_call' ELSE 'tool_result' END AS kind, event_type AS tool_name
FROM events, (VALUES (0), (1)) AS t(k)
""")
def neutral_call_ids(spark, d):
    return R.event_segments(table(spark, d, "events")).select("trace_id", "pos", "segment_id", "call_id", "kind", "tool_name")


@query("""
SELECT 'conv_' || conv_id AS trace_id, '{"trace_id":"conv_' || conv_id || '","segments":[' || string_agg('{"segment_id":"segment_' || lpad(CAST(rn AS VARCHAR), 4, '0') || '","role":"' || role || '","kind":"message","payload":{"text":' || to_json(coalesce(text, '')) || '},"tool_name":null,"call_id":null}', ',' ORDER BY turn) || ']}' AS record
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) GROUP BY conv_id
""")
def canonical_records(spark, d):
    return R.canonical_records(R.conversation_segments(table(spark, d, "conversations")))


@query("SELECT 'conv_' || conv_id AS trace_id, (turn + 1)::BIGINT AS step, role AS action FROM conversations WHERE conv_id = (SELECT min(conv_id) FROM conversations)")
def point_lookup(spark, d):
    c = table(spark, d, "conversations")
    one = c.agg(F.min("conv_id").alias("conv_id"))
    return R.conversation_steps(c.join(F.broadcast(one), "conv_id", "left_semi")).select("trace_id", F.col("step").cast("long").alias("step"), "action")  # one row


@query(f"""
WITH {X.DEALS.sql}, cases(k, name) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in T.CASES.items())})
SELECT trace_id, coalesce(name, 'Green Leaf') || ' — ' || CASE workflow WHEN 'structure_payment' THEN 'Structure Payment' WHEN 'draft_memo' THEN 'Draft Memo' WHEN 'review' THEN 'Review' ELSE 'Compare Terms' END AS matter,
  nullif(regexp_extract(trace_id, '((?:19|20)\\d{{2}})', 1), '') AS year
FROM deals LEFT JOIN cases ON k = regexp_replace(case_id, '_[^_]*$', '')
""")
def matter_labels(spark, d):
    return X.DEALS.df(spark).select("trace_id", T.matter(F.col("case_id"), F.col("workflow")).alias("matter"), T.deal_year(F.col("trace_id")).alias("year"))


@query(f"WITH {X.SLOTS.sql}, {X.FRESH.sql} SELECT id, source_id, coalesce(f.matter, s.matter) AS matter, coalesce(f.steps_json, s.steps_json) AS steps_json FROM slots s LEFT JOIN fresh f ON starts_with(coalesce(source_id, ''), source_prefix) AND string_split(s.matter, ' — ')[-1] = title")
def slot_update(spark, d):
    return R.update_slots(X.SLOTS.df(spark), X.FRESH.df(spark))


# --- detection, numbering and splicing ----------------------------------------------------------


@query(f"""
WITH p AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '{PHONE}')) AS value, generate_subscripts(regexp_extract_all(text, '{PHONE}'), 1) AS i FROM documents
), n AS (SELECT doc_id, value, i, regexp_replace(lower(value), '[^a-z0-9]+', '', 'g') AS norm FROM p)
SELECT 'doc_' || doc_id AS trace_id, norm, dense_rank() OVER (PARTITION BY doc_id ORDER BY first) AS n, '[PHONE_' || dense_rank() OVER (PARTITION BY doc_id ORDER BY first) || ']' AS token
FROM (SELECT doc_id, norm, min(i) AS first FROM n GROUP BY doc_id, norm)
""")
def alias_table(spark, d):
    docs = table(spark, d, "documents").select(F.concat(F.lit("doc_"), F.col("doc_id")).alias("trace_id"), "text")
    found = docs.select("trace_id", F.posexplode(F.regexp_extract_all("text", F.lit(PHONE), F.lit(0))).alias("start", "value"))
    own = P.number_aliases(found.select("trace_id", F.lit(1).alias("step"), "start", F.lit("private_phone").alias("category"), "value"))
    return own.select("trace_id", "norm", "n", "token").distinct()


@query(f"""
SELECT lang, sum(len(regexp_extract_all(text, '{P.EMAIL}')))::BIGINT AS emails, sum(len(regexp_extract_all(text, '{PHONE}')))::BIGINT AS phones, sum(len(regexp_extract_all(text, '{P.DIGIT_RUN}')))::BIGINT AS digit_runs FROM documents GROUP BY lang
""")
def pii_counts_by_lang(spark, d):
    n = lambda p: F.sum(F.size(F.regexp_extract_all("text", F.lit(p), F.lit(0)))).cast("long")
    return table(spark, d, "documents").groupBy("lang").agg(n(P.EMAIL).alias("emails"), n(PHONE).alias("phones"), n(P.DIGIT_RUN).alias("digit_runs"))


@query(f"""
SELECT doc_id, digits, {LUHN.format(d="digits")} AS valid FROM (SELECT doc_id, unnest(list_transform(regexp_extract_all(text, '{P.DIGIT_RUN}'), lambda r: regexp_replace(r, '[ -]', '', 'g'))) AS digits FROM documents)
""")
def luhn_runs(spark, d):
    runs = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(P.DIGIT_RUN), F.lit(0))).alias("run")).select("doc_id", F.regexp_replace("run", "[ -]", "").alias("digits"))
    return runs.withColumn("valid", T.luhn(F.col("digits")))


@query()
def card_window_scan(spark, d):
    """The cards of all documents. Whether a run is a piece of an id hangs on what stands around it, which DuckDB's
    patterns cannot look at: tested by brute force."""
    found = table(spark, d, "documents").where(F.regexp_like("text", F.lit(P.DIGIT_RUN))).select("doc_id", "text", F.explode(P.regex_spans("text")).alias("s")).where("s.category = 'account_number'")
    # Spans are of cards only; the text between start and end may hold separators.
    return found.select("doc_id", F.regexp_replace(F.substring("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")), "[ -]", "").alias("card"))


@case("""SELECT * FROM (VALUES (1, '5-21'), (2, '8-21'), (3, '8-27'), (5, '4-20'), (6, '7-23'), (7, '7-27')) AS t(id, spans)""")
def card_context(spark, d):
    found = X.CARDS.df(spark).withColumn("s", P.regex_spans("text")).where(F.size("s") > 0)
    return found.select("id", F.array_join(F.transform(F.array_sort("s"), lambda x: F.concat_ws("-", x["start"], x["end"])), ",").alias("spans"))


@query("WITH RECURSIVE " + X.INTERVALS.sql + """, o AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY src, s - e, s) AS k FROM intervals
), fold(id, k, kept) AS (
  SELECT DISTINCT id, 0::BIGINT, CAST([] AS STRUCT(s INTEGER, e INTEGER)[]) FROM o
  UNION ALL
  SELECT f.id, o.k, CASE WHEN len(list_filter(f.kept, lambda x: o.s < x.e AND o.e > x.s)) > 0 THEN f.kept ELSE list_append(f.kept, {'s': o.s, 'e': o.e}) END FROM fold f JOIN o ON o.id = f.id AND o.k = f.k + 1
)
SELECT id, array_to_string(list_transform(list_sort(kept), lambda x: x.s || '-' || x.e), ',') AS spans FROM (SELECT id, max_by(kept, k) AS kept FROM fold GROUP BY id)
""")
def merge_spans(spark, d):
    span = F.struct(F.col("s").alias("start"), F.col("e").alias("end"), F.lit("x").alias("category"))
    of = lambda src: F.collect_list(F.when(F.col("src") == src, span))
    own = X.INTERVALS.df(spark).groupBy("id").agg(of("p").alias("p"), of("s").alias("q"))
    merged = F.array_sort(P.merge_spans(F.col("p"), F.col("q")))
    return own.select("id", F.array_join(F.transform(merged, lambda x: F.concat_ws("-", x["start"], x["end"])), ",").alias("spans"))


def _mark_sql() -> str:
    out = "text"
    for p in T.DISPLAY_PATTERNS.values():
        out = f"regexp_replace({out}, '({p})', chr(1) || '\\1' || chr(1), 'g')"
    return out


@query(f"WITH {X.MARKED.sql} SELECT id, {_mark_sql()} AS pii, regexp_replace(text, '({T.PLACEHOLDER_TOKEN})', chr(1) || '\\1' || chr(1), 'g') AS tokens FROM marked")
def mark_fixture(spark, d):
    return X.MARKED.df(spark).select("id", T.mark_pii(F.col("text")).alias("pii"), T.mark_placeholders(F.col("text")).alias("tokens"))


@query(f"SELECT doc_id, {_mark_sql()} AS marked FROM documents")
def mark_pii(spark, d):
    return table(spark, d, "documents").select("doc_id", T.mark_pii(F.col("text")).alias("marked"))


@query(f"""SELECT doc_id, regexp_replace(regexp_replace(text, '{P.EMAIL}', '[EMAIL]', 'g'), '{PHONE}', '[PHONE]', 'g') AS text FROM documents""")
def redact_constant(spark, d):
    text = F.regexp_replace(F.regexp_replace("text", P.EMAIL, "[EMAIL]"), PHONE, "[PHONE]")
    return table(spark, d, "documents").select("doc_id", text.alias("text"))


@query()
def redact_numbered(spark, d):
    """Detection, numbering and splicing over documents, each its own trace of one step."""
    steps = table(spark, d, "documents").select(F.concat(F.lit("doc_"), F.col("doc_id")).alias("trace_id"), F.lit(1).alias("step"), F.col("text").alias("detail"))
    return P.scrub(steps, single=True)


@query(f"SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '{PHONE}'))), '; ') AS v FROM documents WHERE len(regexp_extract_all(text, '{PHONE}')) > 0")
def ground_truth_values(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("trace_id"), F.explode(F.regexp_extract_all("text", F.lit(PHONE), F.lit(0))).alias("value"))
    return S.ground_truth(docs.withColumn("category", F.lit("private_phone"))).select(F.col("trace_id").alias("doc_id"), F.array_join("values", "; ").alias("v"))


@case("""SELECT * FROM (VALUES ('adobe_figma_2022_t01', '[ORG_1] pays [ORG_2]; [ORG_1]''s [ORG_2], not Adobes'), ('jetblue_spirit_1999_t01', '[ORG_1] and the [ORG_2] of [ORG_1]'), ('cisco_splunk_2023_t02', 'no party'), ('unknown_case_t03', '[ORG_1] grows [ORG_1]')) AS t(trace_id, text)""")
def strip_parties(spark, d):
    own = X.TEXTS.df(spark).join(X.DEALS.df(spark), "trace_id")
    return own.select("trace_id", T.strip_parties(F.col("text"), T.parties(T.matter(F.col("case_id"), F.col("workflow")))).alias("text"))


# --- validation, templates, worlds --------------------------------------------------------------

@query("WITH " + X.TRACES.sql + """, j AS (
  SELECT *, list_sort(json_keys(payload_json)) AS k, json_type(payload_json, '$.text') AS tt, json_type(payload_json, '$.arguments') AS argt,
    count(*) OVER (PARTITION BY trace_id, segment_id) AS same_id,
    count(*) FILTER (WHERE kind = 'tool_call') OVER (PARTITION BY trace_id, call_id) AS calls,
    count(*) FILTER (WHERE kind = 'tool_call') OVER (PARTITION BY trace_id, call_id ORDER BY pos) AS cs,
    count(*) FILTER (WHERE kind = 'tool_result') OVER (PARTITION BY trace_id, call_id ORDER BY pos) AS rs,
    first_value(CASE WHEN kind = 'tool_call' THEN tool_name END IGNORE NULLS) OVER (PARTITION BY trace_id, call_id ORDER BY pos) AS called,
    sum(CASE kind WHEN 'tool_call' THEN 1 WHEN 'tool_result' THEN -1 ELSE 0 END) OVER (PARTITION BY trace_id ORDER BY pos) AS open,
    max(pos) OVER (PARTITION BY trace_id) AS last
  FROM traces
)
SELECT trace_id, pos, rule FROM (
  SELECT trace_id, pos, 'V2' AS rule, trim(segment_id) = '' OR same_id > 1 AS bad FROM j
  UNION ALL SELECT trace_id, pos, 'V3', role NOT IN ('system', 'user', 'assistant', 'tool') OR kind NOT IN ('message', 'tool_call', 'tool_result') FROM j
  UNION ALL SELECT trace_id, pos, 'V5', kind = 'message' AND (role = 'tool' OR tool_name IS NOT NULL OR call_id IS NOT NULL OR k <> ['text'] OR tt <> 'VARCHAR') FROM j
  UNION ALL SELECT trace_id, pos, 'V6', kind = 'message' AND open > 0 FROM j
  UNION ALL SELECT trace_id, pos, 'V7', kind = 'tool_call' AND (role <> 'assistant' OR k <> ['arguments'] OR argt <> 'OBJECT' OR calls > 1) FROM j
  UNION ALL SELECT trace_id, pos, 'V8', kind = 'tool_call' AND tool_name = 'read_section' AND json_type(payload_json, '$.arguments.chunk_id') <> 'VARCHAR' FROM j
  UNION ALL SELECT trace_id, pos, 'V9', kind = 'tool_result' AND (role <> 'tool' OR k <> ['result'] OR cs = 0 OR rs > cs OR called <> tool_name) FROM j
  UNION ALL SELECT trace_id, pos, 'V10', pos = last AND open > 0 FROM j
) WHERE bad
""")
def trace_violations(spark, d):
    return validate.violations(X.TRACES.df(spark))


@query("""
SELECT event_id, coalesce(list_sort(json_keys(props)) <> ['k'] OR json_type(props, '$.k') NOT IN ('BIGINT', 'UBIGINT'), true) AS bad FROM events
""")
def tool_args_check(spark, d):
    props = F.coalesce("props", F.lit("{}"))
    v = F.try_parse_json(props)
    bad = ~validate.keys_are(props, "k") | (F.schema_of_variant(F.variant_get(v, "$.k", "variant")) != "BIGINT")
    return table(spark, d, "events").select("event_id", F.coalesce(bad, F.lit(True)).alias("bad"))


@query("WITH " + X.TEMPLATES.sql + r""" SELECT trace_id, coalesce(string_agg(DISTINCT k, ',' ORDER BY k), '') AS placeholders FROM (SELECT trace_id, k FROM templates LEFT JOIN LATERAL (SELECT unnest(regexp_extract_all(payload_json, '\{\{([A-Z][A-Z0-9_]*)\}\}', 1)) AS k) ON true) GROUP BY trace_id""")
def placeholder_profile(spark, d):
    return template.profile(X.TEMPLATES.df(spark)).select("trace_id", F.array_join("placeholders", ",").alias("placeholders"))


@case("""SELECT * FROM (VALUES
  ('t1', 1, '{"text":"Brightwater Freight charters Tern for 21000"}'), ('t1', 2, '{"arguments":{"hire":21000,"note":"signed 2031-01-06"}}'),
  ('t2', 1, '{"result":{"paid":false,"none":null,"text":"false and null and 7.5"}}'), ('t3', 1, '{"text":"nothing to fill"}')) AS t(trace_id, pos, payload)""")
def fill_world(spark, d):
    maps = X.WORLDS.df(spark).groupBy("trace_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value_json"))).alias("w"))
    own = X.TEMPLATES.df(spark).join(maps, "trace_id", "left")
    return own.select("trace_id", "pos", F.when(F.col("w").isNull(), F.col("payload_json")).otherwise(template.fill_json(F.col("payload_json"), F.col("w"))).alias("payload"))


@case("""SELECT * FROM (VALUES
  ('late', 'W5', 'SIGNING_DATE<=CLOSING_DATE'), ('late', 'W6', 'SIGNING_DATE<=CLOSING_DATE'), ('off', 'W5', 'SIGNING_DATE'), ('off', 'W5', 'CLOSING_DATE'), ('off', 'W6', 'SIGNING_DATE<=CLOSING_DATE'), ('off', 'W7', 'PRICE'), ('off', 'W8', 'FEE/PRICE'), ('off', 'W9', 'LAW~COURT'),
  ('dear', 'W3', ''), ('dear', 'W7', 'PRICE'), ('dear', 'W8', 'FEE/PRICE'), ('zero', 'W4', 'COURT'), ('zero', 'W7', 'PRICE'), ('zero', 'W8', 'FEE/PRICE'), ('zero', 'W9', 'LAW~COURT')) AS t(trace_id, rule, what)""")
def world_violations(spark, d):
    worlds = X.CHECKED_WORLDS.df(spark)
    profiles = worlds.select("trace_id").distinct().select("trace_id", F.array(*map(F.lit, X.KEYS)).alias("placeholders"))
    rules = WorldRules((("SIGNING_DATE", "CLOSING_DATE"),), {"PRICE": (10, 1000)}, {("FEE", "PRICE"): (0.01, 0.1)}, {("LAW", "COURT"): (("Delaware", "Chancery"), ("England", "Old Bailey"))})
    return world.violations(worlds, profiles, rules)


@query("WITH " + X.SCALARS.sql + r"""
SELECT id, value_json, CASE WHEN starts_with(value_json, '"') THEN substr(value_json, 2, length(value_json) - 2) ELSE value_json END AS inline,
  CASE WHEN regexp_matches(value_json, '^"\d{4}-\d{2}-\d{2}"$') THEN TRY_CAST(substr(value_json, 2, 10) AS DATE) END IS NOT NULL AS is_date,
  CASE WHEN regexp_matches(value_json, '^-?\d') AND isfinite(TRY_CAST(value_json AS DOUBLE)) THEN TRY_CAST(value_json AS DOUBLE) END AS number
FROM scalars""")
def scalar_forms(spark, d):
    text = T.inline_scalar(F.col("value_json"))
    return X.SCALARS.df(spark).select("id", "value_json", text.alias("inline"), (F.startswith("value_json", F.lit('"')) & T.iso_date(text).isNotNull()).alias("is_date"), T.json_number(F.col("value_json")).alias("number"))


@case("""SELECT * FROM (VALUES (1, NULL), (2, 'fields'), (3, 'type'), (4, 'length'), (5, NULL), (6, 'type'), (7, 'number is not finite'), (8, 'duplicate key')) AS t(id, error)""")
def shape_rules(spark, d):
    rows = [(1, '{"a":5}', '{"a":"{{PRICE}}"}'), (2, '{"a":5}', '{"b":5}'), (3, '{"a":5}', '{"a":true}'), (4, '{"a":[1,2]}', '{"a":[1]}'), (5, '{"a":1}', '{"a":2.5}'), (6, '{"a":{}}', '{"a":"{{X}}"}'), (7, '{"a":1}', '{"a":1e999}'), (8, '{"a":1}', '{"a":1,"a":1}')]
    return spark.createDataFrame(rows, "id int, b string, a string").select("id", validate.shape_errors(True)("b", "a").alias("error"))


# --- pairing, matching, scoring -----------------------------------------------------------------


@query("SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn, min(doc_id) OVER (PARTITION BY source) AS group_first FROM documents")
def round_robin_order(spark, d):
    out = S.round_robin(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id")
    return out.select("doc_id", "source", F.col("turn").cast("long").alias("turn"), "group_first")


@query("SELECT c.conv_id, c.n AS original, o.n AS transformed FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id) c JOIN (SELECT conv_id, max_by(length(text), turn) AS n FROM conversations GROUP BY conv_id) o USING (conv_id)")
def pair_by_id(spark, d):
    c = table(spark, d, "conversations")
    left = c.groupBy(F.col("conv_id").alias("trace_id")).agg(F.count("*").alias("text"))
    out = S.pair_by_id(left, c.select(F.col("conv_id").alias("trace_id"), F.col("turn").alias("pos"), F.length("text").cast("long").alias("text")))
    return out.select(F.col("trace_id").alias("conv_id"), "original", "transformed")


@query("SELECT l.doc_id AS trace_id, d.doc_id AS source_id, d.n_chars AS original, l.toxic::BIGINT AS transformed FROM labels l JOIN documents d ON l.doc_id = d.doc_id")
def pair_by_source(spark, d):
    o = table(spark, d, "documents").select(F.col("doc_id").alias("trace_id"), F.col("n_chars").alias("text"))
    s = table(spark, d, "labels").select(F.col("doc_id").alias("trace_id"), F.col("doc_id").alias("source_id"), F.col("toxic").cast("long").alias("text"))
    return S.pair_by_source(o, s).select("trace_id", "source_id", "original", "transformed")


@query("SELECT place, doc_id, item_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS place FROM documents) JOIN (SELECT item_id, row_number() OVER (ORDER BY item_id) AS place FROM benchmark) USING (place)")
def pair_by_index(spark, d):
    a = S.with_place(table(spark, d, "documents").select("doc_id"), "doc_id")
    b = S.with_place(table(spark, d, "benchmark").select("item_id"), "item_id")
    return S.pair_by_place(a, b).select(F.col("place").cast("long").alias("place"), "doc_id", "item_id")


@query("SELECT n.n_name, c.n_name AS guess, jaro_winkler_similarity(lower(n.n_name), lower(c.n_name)) > 0.75 AS close FROM nation n JOIN nation c ON n.n_regionkey = c.n_regionkey")
def jaro_winkler_match(spark, d):
    n = table(spark, d, "nation")
    g = n.select("n_regionkey", F.col("n_name").alias("guess"))
    return n.join(g, "n_regionkey").select("n_name", "guess", (jaro_winkler(F.lower("n_name"), F.lower("guess")) > S.CLOSE).alias("close"))


@query("SELECT s.lang AS category, sum(l.toxic) * 100.0 / count(*) AS accuracy, count(*) AS n FROM labels l JOIN documents s USING (doc_id) GROUP BY ROLLUP (s.lang)")
def per_category_accuracy(spark, d):
    """Hits and truths by category, with the micro-average over all."""
    own = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return S.accuracy(own.select(F.col("lang").alias("category"), F.col("toxic").cast("double").alias("hit")))


_DEAL_SQL = f"""
WITH {X.DEALS.sql}, {X.GUESSED.sql}, cases(k, name) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in T.CASES.items())}),
p AS (SELECT trace_id, unnest(string_split(coalesce(name, 'Green Leaf'), ' / ')) AS value FROM deals LEFT JOIN cases ON k = regexp_replace(case_id, '_[^_]*$', '')),
h AS (
  SELECT trace_id, value AS what, max(CASE WHEN g IS NOT NULL AND jaro_winkler_similarity(lower(trim(g)), lower(value)) > 0.75 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS hit
  FROM (SELECT trace_id, value, g FROM p LEFT JOIN guessed USING (trace_id) LEFT JOIN LATERAL (SELECT unnest(companies) AS g) ON true) GROUP BY trace_id, value
  UNION ALL
  SELECT trace_id, 'year', CASE WHEN coalesce(trim(year) = regexp_extract(trace_id, '((?:19|20)\\d{{2}})', 1), false) THEN 1.0 ELSE 0.0 END FROM deals LEFT JOIN guessed USING (trace_id) WHERE regexp_matches(trace_id, '(19|20)\\d{{2}}')
)
"""


def _deals(spark):
    originals = X.DEALS.df(spark).select("trace_id", T.matter(F.col("case_id"), F.col("workflow")).alias("matter"))
    return S.deal_hits(originals, X.GUESSED.df(spark))


@query(_DEAL_SQL + "SELECT trace_id, what, hit FROM h")
def deal_hits(spark, d):
    return _deals(spark)


@query(_DEAL_SQL + "SELECT trace_id, sum(hit) * 100 / count(*) AS score FROM h GROUP BY trace_id")
def deal_scores(spark, d):
    return S.deal_scores(_deals(spark))


@query(_DEAL_SQL + "SELECT sum(hit) * 100 / count(*) AS score, count(*) AS n FROM h")
def verify_score(spark, d):
    return S.verify_score(_deals(spark))


@case("""SELECT * FROM (VALUES ('a1', 'real email address', 'a@x.org; b@x.org; c@x.org'), ('a1', 'real url', 'http://one'), ('a2', 'real phone number', '3'), ('a3', 'real secret or credential value', '')) AS t(trace_id, label, guesses)""")
def parse_answers(spark, d):
    return S.parse_answers(X.ANSWERS.df(spark)).select("trace_id", "label", F.array_join("guesses", "; ").alias("guesses"))


@case("""SELECT * FROM (VALUES (1, 'Adobe; Figma', '2022'), (2, '', NULL), (3, '', NULL), (4, 'A', '2021'), (5, '', NULL)) AS t(id, companies, year)""")
def parse_attributes(spark, d):
    own = X.RAW_ATTRIBUTES.df(spark).withColumn("a", S.parse_attributes(F.col("answer")))
    return own.select("id", F.array_join("a.companies", "; ").alias("companies"), "a.year")


_WORDS_SQL = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"


@query(f"""
WITH d AS (SELECT doc_id, ' ' || {_WORDS_SQL.format("text")} || ' ' AS w FROM documents), b AS (SELECT item_id, {_WORDS_SQL.format("text")} AS a FROM benchmark)
SELECT doc_id, item_id FROM d JOIN b ON a <> '' AND contains(w, ' ' || a || ' ')
""")
def mentions_exact(spark, d):
    """Which documents hold which items, whole."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), T.ascii_words(F.col("text")).alias("w"))
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("key"), T.ascii_words(F.col("text")).alias("a"))
    return S.holding(docs, items).select(F.col("id").alias("doc_id"), F.col("key").alias("item_id"))


@case("SELECT * FROM (VALUES (0, true), (1, true), (2, false), (3, false)) AS t(id, named)")
def mentions_spaced(spark, d):
    """Word runs that equal an alias however it is spaced."""
    rows = [(0, "at Blue Heron wharf", "BlueHeron"), (1, "Nord-licht, then", "Nordlicht"), (2, "blueherons", "BlueHeron"), (3, "", "x")]
    own = spark.createDataFrame(rows, "id int, t string, a string").select("id", F.split(T.ascii_words(F.col("t")), " ").alias("t"), F.split(T.ascii_words(F.col("a")), " ").alias("a"))
    return own.select("id", T.mentions_exact(F.col("t"), F.col("a")).alias("named"))


_MENTIONS = [
    ("The NORDLICHT'S last crossing", "Nordlicht", True, "the nordlicht s last crossing"), ("a Blue-Heron wharf", "BlueHeron", True, "a blue heron wharf"), ("Kestrell docks at nine", "Kestrel", True, "kestrell docks at nine"),
    ("hold the harbour", "Harbour Gate", False, "hold the harbour"), ("t i d e", "TIDE", False, "t i d e"), ("ＯＲＲＩＮ shipping", "orrin", True, "orrin shipping"), ("of no account", "Calloway", False, "of no account"),
]


@case("SELECT * FROM (VALUES " + ", ".join(f"({i}, {str(ok).lower()}, '{f}')" for i, (_, _, ok, f) in enumerate(_MENTIONS)) + ") AS t(id, named, form)")
def mentions_fuzzy(spark, d):
    rows = [(i, t, a) for i, (t, a, _, _) in enumerate(_MENTIONS)]
    return spark.createDataFrame(rows, "id int, t string, a string").select("id", mentions("t", "a").alias("named"), normalize_identity("t").alias("form"))


@case("""SELECT * FROM (VALUES ('n1', 1::BIGINT, 'Acme Holdings', 3::BIGINT), ('n1', 2, 'Borealis Systems', 2), ('n2', 1, 'Dune Analytics', 2), ('n2', 2, 'Elm Corp', 2)) AS t(trace_id, rank, name, n)""")
def top_parties(spark, d):
    return S.top_names(X.NAMES.df(spark))


@case("""SELECT * FROM (VALUES (1, 'Tern and Tern and [PERSON_1]'), (2, 'Gull Tern'), (3, '[ORG_1] stays')) AS t(id, text)""")
def fill_detail(spark, d):
    return X.TOKENS.df(spark).select("id", T.fill_detail(F.col("text"), F.col("guesses")).alias("text"))


@query("""SELECT doc_id, CASE WHEN length(text) <= 240 THEN text ELSE left(text, 240) || ' …' END AS clipped,
  CASE WHEN n_chars % 101 >= 50 THEN 'bad' WHEN n_chars % 101 >= 10 THEN 'warn' ELSE 'good' END AS score_class, CASE WHEN n_chars % 101 > 90 THEN 'red' WHEN n_chars % 101 = 0 THEN 'green' ELSE 'yellow' END AS dot
FROM documents""")
def dashboard(spark, d):
    s = F.col("n_chars") % 101
    return table(spark, d, "documents").select("doc_id", T.dashboard_clip(F.col("text")).alias("clipped"), T.score_class(s).alias("score_class"), T.dot_class(s).alias("dot"))


@case("""SELECT * FROM (VALUES ('private_email', 'EMAIL'), ('employee_id', 'EMPLOYEE_ID'), ('--', 'PII'), ('secret', 'SECRET'), ('a b.c', 'A_B_C')) AS t(category, prefix)""")
def placeholder_prefixes(spark, d):
    return spark.createDataFrame([("private_email",), ("employee_id",), ("--",), ("secret",), ("a b.c",)], "category string").select("category", T.placeholder_prefix(F.col("category")).alias("prefix"))


@case("""SELECT * FROM (VALUES ('adobe_figma_2022_t01', 'Adobe / Figma deal; Adobe; Figma'), ('cisco_splunk_2023_t02', 'Cisco / Splunk deal; Cisco; Splunk'), ('unknown_case_t03', 'Green Leaf deal; Green Leaf'), ('jetblue_spirit_1999_t01', 'JetBlue / Spirit deal; JetBlue; Spirit')) AS t(trace_id, aliases)""")
def ground_from_cases(spark, d):
    return X.DEALS.df(spark).select("trace_id", F.array_join(ground_of(T.matter(F.col("case_id"), F.col("workflow"))), "; ").alias("aliases"))


@case("""SELECT * FROM (VALUES (1, '{"a": 2, "b": null}'), (2, '{"x": [{"k": 1}]}'), (3, '{"a": [1, 2]}')) AS t(id, payload)""")
def repair_shapes(spark, d):
    rows = [(1, '{"a":1,"b":null}', '{"a":2,"c":3}'), (2, '{"x":[{"k":0}]}', '{"x":[{"k":1,"z":2}]}'), (3, '{"a":[1]}', '{"a":[1,2]}')]
    return spark.createDataFrame(rows, "id int, b string, a string").select("id", template.repair_shape("b", "a").alias("payload"))


@case("""SELECT * FROM (VALUES ('t1', 1, 'text; {{CHARTERER}} charters {{VESSEL}} for {{RATE}}'), ('t1', 2, 'arguments; hire; {{RATE}}; note; signed {{SIGNING_DATE}}'), ('t2', 1, 'result; paid; {{PAID}}; none; {{NOTE}}; text; {{PAID}} and {{NOTE}} and {{RATE}}'), ('t3', 1, 'text; nothing to fill')) AS t(trace_id, pos, texts)""")
def payload_leaves(spark, d):
    return X.TEMPLATES.df(spark).select("trace_id", "pos", F.array_join(template.payload_texts("payload_json"), "; ").alias("texts"))


@query("SELECT 'conv_' || conv_id AS trace_id, (turn + 1)::BIGINT AS pos, CASE WHEN turn = 0 THEN 'shape: type' ELSE 'count' END AS rule FROM conversations WHERE turn = 0 OR turn = 1")
def reference_check(spark, d):
    """Rewrites that turned the first text into a number and lost the second segment."""
    own = R.conversation_segments(table(spark, d, "conversations"))
    bad = own.where("pos <> 2").withColumn("payload_json", F.when(F.col("pos") == 1, F.lit('{"text":5}')).otherwise(F.col("payload_json")))
    return validate.reference_violations(own, bad).select("trace_id", F.col("pos").cast("long").alias("pos"), "rule")


@case("""SELECT * FROM (VALUES ('t', 'c', 'Vancouver', 0.5::DOUBLE), ('t', 'c', 'Vienna', 1.0), ('t', 'c', 'Rome', 0.0), ('u', 'c', 'Paris', 0.0)) AS t(trace_id, category, value, hit)""")
def judged_hits(spark, d):
    """The judge gets only what no guess is close to, and its best verdict counts."""
    truth = spark.createDataFrame([("t", "c", "Vancouver"), ("t", "c", "Vienna"), ("t", "c", "Rome"), ("u", "c", "Paris")], "trace_id string, category string, value string")
    guesses = spark.createDataFrame([("t", "c", ["Canada", "vienna "])], "trace_id string, category string, guesses array<string>")
    answer = F.when(F.col("value") == "Vancouver", "less precise; no").otherwise("no")
    return S.hits(truth, guesses, lambda rest: rest.withColumn("verdict", S.verdicts(answer, F.col("guesses"))))


@case("""SELECT * FROM (VALUES (1, true), (2, false), (3, true), (4, false)) AS t(id, is_only)""")
def only_placeholders(spark, d):
    rows = [(1, "{{A}}, {{B_2}}!"), (2, "{{A}} and more"), (3, "_{{A}}"), (4, "...")]
    return spark.createDataFrame(rows, "id int, s string").select("id", T.only_placeholders(F.col("s")).alias("is_only"))


# --- loops --------------------------------------------------------------------------------------

CLUE = "demurrage counted in half tides"


def demo() -> tuple[list[tuple], Synthesis]:
    """A charter party with one term that gives it away, and stand-ins that take two rounds over it."""
    terms = "Orrin Shipping lets the Maren Two to Halcyon Line at 18500 a day from 2024-08-05, " + CLUE
    rows = [
        ("charter", 1, "segment_0001", "user", "message", '{"text": "Is this fixture in order? ' + terms + '"}', None, None),
        ("charter", 2, "segment_0002", "assistant", "tool_call", '{"arguments": {"owner": "Orrin Shipping", "rate": 18500}}', "find_fixture", "call_0001"),
        ("charter", 3, "segment_0003", "tool", "tool_result", '{"result": {"vessel": "Maren Two", "hire": [18500, "a day"], "laycan": "2024-08-05", "note": null}}', "find_fixture", "call_0001"),
        ("charter", 4, "segment_0004", "assistant", "message", '{"text": "It is. ' + terms + '."}', None, None),
    ]
    how = Synthesis(
        WordListInferrer({"parties": ("Halcyon Line", "Orrin Shipping", "Maren Two"), "amounts": ("18500",)}),
        PatternRewriter((("Halcyon Line", "{{CHARTERER}}", 0), ("Orrin Shipping", "{{OWNER}}", 0), ("Maren Two", "{{VESSEL}}", 0), (r"\b18500\b", "{{RATE}}", 0), ("2024-08-05", "{{SIGNING_DATE}}", 0), (CLUE, "demurrage as usual", 1))),
        RuleGenerator(("Brightwater Freight", "Calloway Marine", "Tern")),
        ClueAttacker({"half tides": "the Maren Two fixture"}),
        rounds=3,
        rules=WorldRules(numeric_ranges={"RATE": (12_000, 30_000)}),
    )
    return rows, how


def _demo_tables(spark, names: tuple[str, ...]) -> tuple[DataFrame, DataFrame, Synthesis]:
    rows, how = demo()
    return spark.createDataFrame(rows, X.SEGMENT), spark.createDataFrame([("charter", n) for n in names], "trace_id string, alias string"), how


@query("""SELECT * FROM (VALUES ('charter', 'passed_attack', 1, 'reidentified'), ('charter', 'passed_attack', 2, 'passed_attack')) AS t(trace_id, status, round, attempt)""")
def synthesize_loop(spark, d):
    segments, ground, how = _demo_tables(spark, ("the Maren Two fixture", "Halcyon Line"))
    return synthesize(segments, ground, how).select("trace_id", "status", "round", "attempt")


@query("""SELECT 'syn-001' AS id, 'charter' AS source_id, 4::BIGINT AS n""")
def synthesize_published(spark, d):
    segments, ground, how = _demo_tables(spark, ("the Maren Two fixture",))
    order = spark.createDataFrame([("charter", 1)], "trace_id string, place int")
    return published(synthesize(segments, ground, how), order, 10).select("id", "source_id", F.size("payloads").cast("long").alias("n"))


@query("""
SELECT 'conv_' || conv_id AS trace_id, 'passed_attack' AS status, 1 AS round, count(*) AS n FROM conversations GROUP BY conv_id
""")
def synthesize_conversations(spark, d):
    """The whole loop over every conversation: what comes near a name by chance is taken out in the first round, and
    each passes."""
    segments = R.conversation_segments(table(spark, d, "conversations"))
    ground = segments.select("trace_id", F.lit("Halcyon Line").alias("alias")).distinct()
    how = replace(demo()[1], rules=WorldRules())  # rules bind every trace, and these invent nothing
    done = synthesize(segments, ground, how)
    return done.select("trace_id", "status", "round", F.size("payloads").cast("long").alias("n"))
