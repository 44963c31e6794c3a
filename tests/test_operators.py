"""Properties and cases of single operators."""

import json
import time
from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilmark import engine
from veilmark.functions import json_values as J
from veilmark.functions import match, ranges, text
from veilmark.functions.match import Aliases, jaro_winkler_of, names, normal_form
from veilmark.functions.trace_rules import Segment, trace_error
from veilmark.operators import calls, loop, score, spans, template, validate, world
from veilmark.operators.models import Hint, Inference, ModelError, PatternRewriter, Report, RuleGenerator, WordListInferrer
from veilmark.operators.score import verdicts
from veilmark.operators.world import WorldRules
from veilmark.plans import fixtures as X
from veilmark.plans.queries import CLUE, demo
from veilmark.sources import traces as R
from veilmark.streaming.redact import aliased, redacted, resolved


@given(st.lists(st.tuples(st.integers(0, 40), st.integers(1, 12)), max_size=12))
@settings(max_examples=60, deadline=None)
def test_resolved_spans_never_overlap(pairs):
    kept = resolved([(a, a + n, "x") for a, n in pairs])
    assert all(a[1] <= b[0] for a, b in zip(kept, kept[1:]))
    assert not pairs or max(n for _, n in pairs) in [k[1] - k[0] for k in kept]


def test_merge_is_the_greedy_one(spark):
    import random

    rng = random.Random(1)
    cases = []
    for i in range(40):
        make = lambda: [(a := rng.randrange(30), a + rng.randrange(1, 9), "c") for _ in range(rng.randrange(6))]
        cases.append((i, make(), make()))
    df = spark.createDataFrame(cases, f"id int, p {spans.SPANS}, s {spans.SPANS}")
    got = {r.id: [(x.start, x.end) for x in r.m] for r in df.select("id", spans.merge_spans(F.col("p"), F.col("s")).alias("m")).collect()}
    for i, p, s in cases:
        kept = []
        for group in (p, s):
            for a, b, _ in sorted(group, key=lambda x: (x[0] - x[1], x[0])):
                if all(b <= x or a >= y for x, y in kept):
                    kept.append((a, b))
        assert got[i] == kept


def test_scrub_numbers_by_first_appearance(spark):
    text = ["mail a.b@x.org, +1 (555) 010-1234 and c@y.org", "again A.B@X.ORG then +1 (555) 010-9999 or +1 (555) 010-1234"]
    df = spark.createDataFrame([("t", i, t) for i, t in enumerate(text)], "trace_id string, step int, detail string")
    got = [r.detail for r in spans.scrub(df).orderBy("step").collect()]
    assert got == ["mail [EMAIL_1], [PHONE_1] and [EMAIL_2]", "again [EMAIL_1] then [PHONE_2] or [PHONE_1]"]
    assert [r.detail for r in spans.scrub(df.repartition(8)).orderBy("step").collect()] == got


def test_secrets_and_cards():
    secret = "sk-" + "a1" * 10
    for text in (f"x {secret} y", "AK" + "IA" + "ABCDEFGHIJKLMNOP", "gh" + "p_" + "a" * 24, "xox" + "b-" + "1" * 12, "-----BEGIN " + "RSA PRIVATE KEY-----"):
        assert [c for _, _, c in spans.structured_spans(text)] == ["secret"]
    assert spans.luhn("4242424242424242") and not spans.luhn("4111111111111112")
    assert list(spans.card_spans("ab4242424242424242cd9e")) == []
    assert list(spans.card_spans("card4242424242424242")) == [(4, 20)]


def test_strict_json():
    for bad in ("NaN", '{"a":1e999}', '{"a":1,"a":2}', "{", "", '{"a":-Infinity}'):
        with pytest.raises(J.Rejected):
            J.parse(bad)
    assert J.parse('{"a":123456789012345678901234567890}')["a"] == 123456789012345678901234567890


@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=4), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=3), x, max_size=3), max_leaves=12))
@settings(max_examples=60, deadline=None)
def test_shape_is_reflexive_and_fill_of_nothing_is_identity(value):
    assert J.shape_error(value, value, False) is None
    if not J.placeholders(value):
        assert J.filled(value, {}) == value
    assert J.repaired(value, value) == value


def test_fill_strict(spark):
    rows = [('{"{{K}}":"{{V}}","t":"{{V}} x"}', '{"K":"k","V":7.5}'), ('{"a":"{{MISSING}}"}', "{}"), ('{"k":1,"{{K}}":2}', '{"K":"k"}')]
    got = spark.createDataFrame(rows, "p string, w string").select(template.fill_strict("p", "w").alias("r")).collect()
    assert json.loads(got[0].r.payload) == {"k": 7.5, "t": "7.5 x"}
    assert [r.r.error for r in got] == [None, "unbound placeholder", "duplicate key"]
    assert J.repaired({"a": 1, "b": None}, {"a": 2, "c": 3}) == {"a": 2, "b": None}


def test_names():
    assert names("the Nordlicht's hull", "Nordlicht") and names("Blue Heron", "BlueHeron") and names("Kestrell", "Kestrel") and names("Harbor-Gates of old", "harborgates")
    assert not names("hold the harbour", "Harbour Gate") and not names("t i d e", "TIDE") and not names("", "x") and not names("x", " - ")
    many = Aliases(["Nordlicht", "Blue Heron"])
    assert many.first("by blueheron or nordlicht") == "blueheron" and many.first("neither") is None and Aliases(["a", "-"]).blank


def slowly_named(text, alias):
    """All stretches of words against the alias, one by one."""
    words, target = normal_form(text).split(), normal_form(alias).split()
    letters = "".join(target)
    for n in {len(target) - 1, len(target), len(target) + 1} - {0}:
        for run in ("".join(words[i : i + n]) for i in range(len(words) - n + 1)):
            if letters and (run == letters or n == len(target) and len(letters) >= 5 and SequenceMatcher(None, run, letters, autojunk=False).ratio() >= 0.85):
                return True
    return False


@given(st.text("abAB é-", max_size=30), st.text("abAB é", max_size=9))
@settings(max_examples=400, deadline=None)
def test_names_match_brute_force(text, alias):
    assert names(text, alias) == slowly_named(text, alias)


def test_similarity():
    assert jaro_winkler_of("martha", "marhta") == pytest.approx(0.9611, abs=1e-4) and jaro_winkler_of("", "a") == 0


def test_loop_rounds():
    class Always:
        model_id = "x"

        def infer(self, text, attributes):
            return [Inference("a", "v")]

    count = []

    class Count:
        def rewrite(self, text, found, hints):
            count.append(hints)
            return text + "!"

    assert loop.anonymize("t", ["a"], 2, Always(), Count()) == "t!!" and len(count) == 2
    assert loop.anonymize("t", ["a"], 0, Always(), Count(), (Hint("h"),)) == "t"
    never = WordListInferrer({})
    assert loop.anonymize("t", ["a"], 5, never, Count(), (Hint("h"),)) == "t!"
    with pytest.raises(ModelError):
        loop.selected([Inference("a", "v", certainty=2.0)], ["a"])
    for bad in ("a", [""], {"a": 1}):
        with pytest.raises(ValueError):
            loop.anonymize("t", bad, 1, never, Count())
    assert loop.asked({"b", "a"}) == ("a", "b") and loop.asked(["b", "a", "b"]) == ("b", "a")
    for bad in ("h", [Hint(5)], [Hint("x", (1,))], ["x"]):
        with pytest.raises(ValueError):
            loop.checked_hints(bad)


def test_anonymize_texts(spark):
    rows = spark.createDataFrame([("by Orrin Shipping",), (None,), ("by none",)], "t string")
    got = loop.anonymize_texts(rows, "t", ["parties"], 2, demo()[1].inferrer, PatternRewriter((('"?Orrin Shipping', "{{OWNER}}", 0),)))
    assert [r.t for r in got.collect()] == ["by Orrin Shipping", None, "by none"]  # no JSON: nothing to go over
    quoted = spark.createDataFrame([('"by Orrin Shipping"',)], "t string")
    assert loop.anonymize_texts(quoted, "t", ["parties"], 2, demo()[1].inferrer, demo()[1].rewriter).first().t == '"by {{OWNER}}"'


def segments_of(rows):
    return [Segment(r[2], r[3], r[4], J.parse(r[5]), r[6], r[7]) for r in rows]


def test_synthesis_states():
    rows, how = demo()
    own = segments_of(rows)
    status, _, attempts, done = how.run("t", own, ["the Maren Two fixture"])
    assert status == "passed_attack" and [a[1] for a in attempts] == ["reidentified", "passed_attack"] and CLUE not in "".join(done)
    assert json.loads(done[1]) == {"arguments": {"owner": "Calloway Marine", "rate": 21000}} and json.loads(done[2])["result"]["hire"] == [21000, "a day"]
    how.rounds = 0
    assert how.run("t", own, ["x"]) == ("failed", "budget_exhausted", [], None)
    how.rounds, seen = 2, []

    class Spy:
        model_id = "spy"

        def attack(self, texts, instruction):
            seen.append(texts)
            return Report(completed=False)

    how.attacker = Spy()
    assert how.run("t", own, ["Brightwater Freight"])[1] == "reidentified" and not seen  # a real name left: no attack
    assert how.run("t", own, ["the Maren Two fixture"])[1] == "invalid_attack"
    assert all("Maren Two fixture" not in t for texts in seen for t in texts)
    with pytest.raises(ValueError):
        how.run("t", own[1:3][::-1], ["zz top"])
    with pytest.raises(ValueError):
        how.run("t", own, [" - "])


@pytest.mark.parametrize("change", ["tool", "check", "matcher", "rules", "model", "world", "placeholder"])
def test_what_ends_a_round(change):
    rows, how = demo()

    def no(*_):
        raise J.Rejected("no")

    class Broken:
        model_id = "broken"

        def infer(self, text, attributes):
            raise ModelError("secret")

        def generate(self, keys, rules):
            return []

    want = ("failed", "invalid_candidate")
    if change == "tool":
        how.tool_checks = {"find_fixture": lambda a: a["rate"] == 18500}
    elif change == "check":
        how.candidate_check = no
    elif change == "matcher":
        how.matcher, want = (lambda report, aliases: False), ("passed_attack", None)
    elif change == "rules":
        how.rules = WorldRules(date_orders=(("SIGNING_DATE", "CLOSING_DATE"),))
    elif change == "model":
        how.inferrer, want = Broken(), ("failed", "model_error")
    elif change == "world":
        how.generator, want = Broken(), ("failed", "model_error")
    else:
        how.generator = RuleGenerator(("{{OTHER}}",))
    status, reason, attempts, done = how.run("t", segments_of(rows), ["the Maren Two fixture"])
    assert (status, reason) == want and (done is None) == (status == "failed") and "secret" not in str(attempts)


def test_trace_error_agrees_with_the_tables(spark):
    """The rules over plain values and over tables name the same traces, and the same first rule."""
    rows = X.TRACES.rows
    found = {r.trace_id: r.rule for r in validate.first_violation(validate.violations(X.TRACES.df(spark))).collect()}
    for t in dict.fromkeys(r[0] for r in rows):
        own = [Segment(r[2], r[3], r[4], J.parse(r[5]), r[6], r[7]) for r in sorted((r for r in rows if r[0] == t), key=lambda r: r[1])]
        assert (trace_error(t, own) is None) == (t not in found), t
    assert trace_error("t", []) == "V1" == trace_error(" ", own)
    assert trace_error("good", segments_of(demo()[0]), segments_of(demo()[0])) is None
    assert trace_error("bad", segments_of(demo()[0]), segments_of(demo()[0])[::-1]) == "V11"


def test_publish_goes_on_where_it_ended(spark, tmp_path):
    rows, how = demo()
    segments = spark.createDataFrame([(f"t{i}", *r[1:]) for i in range(5) for r in rows], X.SEGMENT)
    ground = spark.createDataFrame([(f"t{i}", "Brightwater Freight" if i == 1 else "the Maren Two fixture") for i in range(5)], "trace_id string, alias string")
    order = spark.createDataFrame([(f"t{i}", i + 1) for i in range(5)], "trace_id string, place int")
    path = str(tmp_path / "syn")
    assert [(r.id, r.source_id) for r in loop.publish(segments, ground, order, how, 2, path, 1).orderBy("id").collect()] == [("syn-001", "t0"), ("syn-002", "t2")]
    assert [r.source_id for r in loop.publish(segments, ground, order, how, 9, path).orderBy("id").collect()] == ["t0", "t2", "t3", "t4"]


def test_reference_violations(spark):
    a = spark.createDataFrame([("t", 1, "s1", "user", "message", '{"text":"a"}', None, None), ("t", 2, "s2", "user", "message", '{"text":"b"}', None, None)], "trace_id string, pos int, segment_id string, role string, kind string, payload_json string, tool_name string, call_id string")
    b = a.withColumn("payload_json", F.when(F.col("pos") == 1, '{"text":5}').otherwise(F.col("payload_json"))).where("pos = 1")
    assert {(r.pos, r.rule) for r in validate.reference_violations(a, b).collect()} == {(1, "shape: type"), (2, "count")}
    assert validate.reference_violations(a, a).count() == 0
    assert validate.first_violation(validate.violations(b)).first().rule == "V5"


def test_import_errors(spark):
    raw = ['{"trace_id":"a"}', '{"trace_id":"b","events":[],"segments":[]}', '{"trace_id":"c","events":[{"event_id":"e","sequence":2,"role":"user","event_type":"message","content":"x"}]}', '{"trace_id":"d","segments":[{"segment_id":"s","role":"user","kind":"message","payload":{"text":"x"}}]}']
    got = {r.trace_id: r.error for r in R.import_any(spark.createDataFrame([(x,) for x in raw], "value string")).collect()}
    assert got["a"] == got["b"] and got["a"] and got["c"] == "sequence is not array order" and got["d"] is None


def test_files(spark, tmp_path):
    rec = R.source_records(R.conversation_segments(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")), "review")
    path = str(tmp_path / "r")
    R.write_new(rec, path)
    with pytest.raises(Exception):
        R.write_new(rec, path)
    back = R.read_records(spark, path)
    assert back.count() == rec.count() and R.nth_record(back, 0).count() == 1 and R.nth_record(back, 10**6).count() == 0
    assert R.flatten_records(back).count() == 87 and R.nested(R.flatten_records(back)).count() == rec.count()
    calls = []
    build = lambda: calls.append(1) or rec.select("trace_id")
    assert R.cached(spark, path + "c", build).count() == R.cached(spark, path + "c", build).count() and len(calls) == 1


def test_engine(spark):
    steps = spark.createDataFrame([("adobe_figma_2022_t01", "Adobe / Figma — Review", 1, "user", "Adobe, a@b.org"), ("adobe_figma_2022_t01", "Adobe / Figma — Review", 2, "user", "figma")], "trace_id string, matter string, step int, action string, detail string")
    red = engine.redact(steps)
    assert [r.detail for r in red.orderBy("step").collect()] == ["\x01[ORG_1]\x01, \x01[EMAIL_1]\x01", "\x01[ORG_2]\x01"]
    guess = lambda t: t.select("trace_id", F.array(F.lit("Adobe Inc"), F.lit("Figma")).alias("companies"), F.lit("2021").alias("year"))
    assert engine.verify(steps, red, guess).first().score == pytest.approx(200 / 3)
    assert engine.reconstruct(red, guess(red.select("trace_id").distinct())).where("step = 2").first().detail == "\x01Figma\x01"
    assert "\x01a@b.org\x01" in engine.original(steps).first().detail
    assert spark.range(1).select(verdicts(F.lit("no; Less Precise"), F.array(F.lit("a"), F.lit("b")))).first()[0] == 0.5


def test_stream(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "trace_id string, step int, detail string"
    for batch in ([("t", 1, "a@b.org"), ("t", 2, "c@d.org and a@b.org")], [("t", 3, "c@d.org x@y.org")]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").json(src)
        q = redacted(spark.readStream.schema(schema).json(src)).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert [r.detail for r in spark.read.parquet(out).orderBy("step").collect()] == ["[EMAIL_1]", "[EMAIL_2] and [EMAIL_1]", "[EMAIL_2] [EMAIL_3]"]


def test_settings_and_findings():
    from veilmark.operators.models import kept_findings
    from veilmark.sources.config import load_ground, load_rules

    assert load_ground('{"identities":["X deal"],"party_aliases":[["Acme","ACM"]]}') == ["X deal", "Acme", "ACM"]
    for bad in ('{"identities":[],"party_aliases":[]}', '{"identities":[" - "],"party_aliases":[]}', '{"identities":["a"]}', '{"identities":["a"],"party_aliases":[[]]}', "[]"):
        with pytest.raises(J.Rejected):
            load_ground(bad)
    rules = load_rules('{"date_orders":[{"left":"A","right":"B"}],"numeric_ranges":[{"key":"P","lower":1,"upper":null}],"ratio_ranges":[{"numerator":"F","denominator":"P","lower":0,"upper":1}],"compatible":[{"left":"L","right":"C","pairs":[["a","b"]]}]}')
    assert loop.world_error({"A": "2026-01-01", "B": "2026-01-02", "P": 5, "F": 1, "L": "a", "C": "b"}, set("ABPFLC"), rules) is None
    assert loop.world_error({"A": "2026-01-01", "B": "2026-01-02", "P": 5, "F": 1, "L": "a", "C": "c"}, set("ABPFLC"), rules) == "W9"
    for bad in ('{"other":[]}', '{"numeric_ranges":[{"key":"P","lower":true,"upper":1}]}'):
        with pytest.raises(J.Rejected):
            load_rules(bad)
    found = [Inference("a", ["x", None, 3]), Inference("a", "{{A}}"), Inference("a", "v", 1.0, ("in text", "not there"))]
    kept = kept_findings(found, "all in text", lambda s: s.startswith("{{"))
    assert [(i.value, i.spans) for i in kept] == [("x; 3", ()), ("v", ("in text",))]
    with pytest.raises(J.Rejected):
        J.flat_value([[1]])
    assert J.flat_value({"signing": 2022, "no": None}) == "signing: 2022"


def slowly_scrubbed(rows):
    """Spans, numbers and splices one step at a time: (trace_id, step, detail) and what comes of it."""
    out, known, count = [], {}, {}
    for t, step, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "")):
        out.append((t, step, aliased(text, known.setdefault(t, {}), count.setdefault(t, {}))))
    return sorted(map(str, out))


STEP = "trace_id string, step int, detail string"


def test_scrub_leaks_nothing_and_loses_nothing(spark):
    """Null and repeated keys, null and empty texts, and columns of the operator's own names."""
    rows = [(None, 1, "mail a@b.org"), ("t", None, "mail c@d.org"), ("t", 1, "mail a@b.org x"), ("t", 1, "zz c@d.org x"), ("t", 1, "zz c@d.org x"), (None, None, "a@b.org and e@f.org"), ("u", 1, None), ("u", 2, ""), ("u", 3, "none"), ("v", 1, "+1 (555) 010-1234 A@b.org a@B.org")]
    own = spark.createDataFrame(rows, STEP).withColumns({c: F.lit(c) for c in ("start", "end", "category", "token", "plan", "spans", "first", "n", "value")})
    got = spans.scrub(own)
    assert got.columns == own.columns
    assert sorted(str((r.trace_id, r.step, r.detail)) for r in got.collect()) == slowly_scrubbed(rows)
    assert not any("@" in (r.detail or "") for r in got.collect()) and spans.scrub(spark.createDataFrame([], STEP)).count() == 0
    assert got.where("spans <> 'spans' or n <> 'n'").count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 1


def test_scrubbed_documents_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(f"doc_{r.doc_id}", 1, r.text) for r in docs.collect()]
    steps = spark.createDataFrame(rows, STEP)
    want = slowly_scrubbed(rows)
    for single in (False, True):
        assert sorted(str(tuple(r)) for r in spans.scrub(steps, single=single).collect()) == want
    together = [("all", i, t) for i, (_, _, t) in enumerate(rows)]
    assert sorted(str(tuple(r)) for r in spans.scrub(spark.createDataFrame(together, STEP)).collect()) == slowly_scrubbed(together)


def test_long_tokens_around_digits():
    assert list(spans.card_spans("b1" + "x" * 300 + "4242424242424242")) == []  # a letter among digits, however far
    assert list(spans.card_spans("x" * 300 + "4242424242424242")) == [(300, 316)]


def test_edges_of_column_functions(spark):
    one = spark.range(1).select(text.fill_detail(F.lit("[ORG_99999999999] [ORG_0] [ORG_2]"), F.array(F.lit("A"), F.lit("B"))).alias("f"), text.luhn(F.lit("")).alias("l"), text.luhn(F.lit("42x")).alias("m"), text.luhn(F.lit("4242424242424242")).alias("v")).first()
    assert tuple(one) == ("A A B", False, False, True)


def test_places(spark):
    keys = [None, 5, -3, 10**15, 5, None, 0, -(10**12)] + list(range(0, 3000, 7))
    own = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, i int").repartition(3)
    for each in (100_000, 50):
        got = score.with_place(own, "k", each).orderBy("place").collect()
        assert [r.place for r in got] == list(range(1, len(keys) + 1))
        assert [r.k for r in got] == sorted(keys, key=lambda k: (k is not None, k or 0))
    grouped = own.withColumn("g", F.when(F.col("i") % 3 > 0, F.col("i") % 3))
    for each in (100_000, 50):
        got = score.with_place(grouped, "k", each, "g").collect()
        for g in (None, 1, 2):
            mine = sorted((r for r in got if r.g == g), key=lambda r: r.place)
            assert [r.place for r in mine] == list(range(1, len(mine) + 1)) and [r.k for r in mine] == sorted((r.k for r in mine), key=lambda k: (k is not None, k or 0))
    start = time.time()
    spark.range(10).select(ranges.above(F.col("id"), list(range(0, 80_000, 10)))).collect()
    assert time.time() - start < 10 and spark.range(99).where(ranges.above(F.col("id"), [3, 7, 50]) != F.when(F.col("id") < 3, 0).when(F.col("id") < 7, 1).when(F.col("id") < 50, 2).otherwise(3)).count() == 0


def test_misspelt_names_are_inferred_and_rewritten():
    assert Aliases(["Blue Heron"]).written("A Blue Herron, a BlueHeron,\nbluë\nheron; blue heroes") == ["Blue Herron", "BlueHeron", "bluë\nheron"]
    assert match.respelt("Blue Heron blue  heron", ("Blue Heron", "Nordlicht")) == {"Blue Heron": ("blue  heron",)} and match.respelt("neither", ("Blue Heron",)) == {}
    words = ["\ufb01ne ½ e\u0301te\u0301_x", "\u1112\u1161\u11ab abc", "q\u0323\u0301 Stra\u00dfe"]
    for t in words:
        assert [w for w, _, _ in match.placed_words(t)] == match.words_of(t)
    inferrer = WordListInferrer({"parties": ("Blue Heron", "Nordlicht"), "amounts": ("18500",)})
    text = '{"text": "Nordlicht, blue herron and 1850 blue herrons\\nblue herron"}'
    found = inferrer.infer(text, ("parties", "amounts"))
    assert [(i.attribute, i.value, i.spans) for i in found] == [("parties", "Nordlicht", ("Nordlicht",)), ("parties", "Blue Heron", ("blue herron", "blue herrons"))]
    rewriter = PatternRewriter((("Blue Heron", "{{BUYER}}", 0), ("Nordlicht", "{{SELLER}}", 0)))
    new = rewriter.rewrite(text, found, ())
    assert new == '{"text": "{{SELLER}}, {{BUYER}} and 1850 {{BUYER}}\\n{{BUYER}}"}' and inferrer.infer(new, ("parties", "amounts")) == []
    assert rewriter.rewrite("a", [Inference("parties", "Unknown", spans=("a",))], ()) == "a"


def demo_roles():
    return demo()[1]


def test_synthetic_traces_and_command_line(spark, tmp_path):
    from veilmark.__main__ import main

    rows, how = demo()
    segments = spark.createDataFrame([(f"adobe_figma_202{i}_t0{i}", *r[1:]) for i in range(3) for r in rows], X.SEGMENT)
    order = segments.select("trace_id").distinct().withColumn("place", F.substring("trace_id", -1, 1).cast("int"))
    ground = segments.select("trace_id", F.lit("the Maren Two fixture").alias("alias")).distinct()
    got = engine.synthetic(segments, ground, order, how, 2).orderBy("trace_id", "step").collect()
    assert [(r.trace_id, r.step, r.action) for r in got][:5] == [("syn-001", 1, "user"), ("syn-001", 2, "find_fixture call"), ("syn-001", 3, "find_fixture result"), ("syn-001", 4, "assistant"), ("syn-002", 1, "user")]
    assert got[1].detail == '{"owner": "Calloway Marine", "rate": 21000}' and len(got) == 8 and "Orrin" not in str(got)
    d = str(tmp_path)
    R.source_records(segments, "review").coalesce(1).write.json(f"{d}/in")
    (tmp_path / "ground.json").write_text('{"identities":["the Maren Two fixture"],"party_aliases":[]}')
    with pytest.raises(SystemExit):
        main(["synth", "--input", f"{d}/in", "--output", f"{d}/x"])
    more = ["--ground", f"{d}/ground.json", "--roles", "tests.test_operators:demo_roles"]
    main(["synth", "--input", f"{d}/in", "--output", f"{d}/synth", "--limit", "2", *more])
    assert spark.read.json(f"{d}/synth").select("trace_id").distinct().count() == 2
    one = spark.read.json(f"{d}/in").select("trace_id").first()[0]
    main(["trace", "--input", f"{d}/in", "--output", f"{d}/trace", "--trace-id", one, *more])
    assert [r.attempt for r in spark.read.json(f"{d}/trace").orderBy("round").collect()] == ["reidentified", "passed_attack"]
    for mode in ("original", "redact", "validate"):
        main([mode, "--input", f"{d}/in", "--output", f"{d}/{mode}"])
    spark.read.json(f"{d}/in").select("trace_id", F.lit("Type: real calendar date\nGuess: 2024-08-05").alias("text")).write.json(f"{d}/answers")
    main(["score", "--input", f"{d}/in", "--output", f"{d}/score", "--transformed", f"{d}/redact", "--answers", f"{d}/answers"])
    assert {(r.accuracy, r.n) for r in spark.read.json(f"{d}/score").collect()} == {(100.0, 3)}
    done = loop.synthesize(segments, ground, how)
    assert [tuple(r) for r in loop.summary(done).collect()] == [("passed_attack", None, 3, 6)]


def test_caches_by_input(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "x"), (2, None)], "i int, t string"), spark.createDataFrame([(1, "y")], "i int, t string")
    made = []
    for df in (a, b, a.orderBy("i", ascending=False)):
        got = R.cached(spark, str(tmp_path / "c"), lambda df=df: made.append(1) or df, of=df)
        assert got.count() == df.count()
    assert len(made) == 2


def test_titles_and_parts(spark):
    one = spark.range(1).select(text.title(F.lit("o'neill_3rd_édition")).alias("t"), text.detail_parts(F.lit("a\x01b\x01")).alias("p")).first()
    assert one.t == "O'neill_3rd_édition".replace("_", " ").title() and [tuple(x) for x in one.p] == [("a", False), ("b", True), ("", False)]


def test_profiles_are_checked(spark):
    own = X.TEMPLATES.df(spark)
    right = template.profile(own)
    wrong = right.withColumn("placeholders", F.when(F.col("trace_id") == "t1", F.array(F.lit("RATE"))).otherwise(F.col("placeholders")))
    worlds = X.WORLDS.df(spark)
    assert world.violations(worlds, right, segments=own).count() == 0
    assert {(r.trace_id, r.rule) for r in world.violations(worlds, wrong, segments=own).collect()} == {("t1", "W1"), ("t1", "W3")}


def test_calls(spark):
    def factory():
        count = {"n": 0}

        def client(prompt):
            count["n"] += 1
            if prompt == "never" or prompt == "once" and count["n"] % 2:
                raise OSError("down")
            return '{"answer": "' + prompt + '"}' if prompt != "odd" else '{"other": 1}'

        return client

    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "a"), (4, "b")], "i int, p string").withColumn("said", F.lit("old"))
    got = {r.i: r.said for r in calls.asked(rows, "p", "said", factory, calls.exact_fields({"answer"})).collect()}
    assert got == {1: '{"answer": "a"}', 2: None, 3: '{"answer": "a"}', 4: '{"answer": "b"}'}
    bad = spark.createDataFrame([(1, "odd"), (2, "never"), (3, "a")], "i int, p string").coalesce(1)
    assert {r.i: r.said is None for r in calls.asked(bad, "p", "said", factory, calls.exact_fields({"answer"}), 3, True).collect()} == {1: True, 2: True, 3: False}
    with pytest.raises(ModelError) as e:
        calls.answered(factory(), "never", tries=2)
    assert "never" not in str(e.value) and calls.answered(factory(), "once", tries=2) == '{"answer": "once"}'
    with pytest.raises(Exception):
        calls.asked(bad, "p", "said", factory).collect()


def test_stream_state_times_out(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("t", 1, "a@b.org 2031-01-06"), ("t", 2, None)], STEP).coalesce(1).write.json(src, ignoreNullFields=False)
    q = redacted(spark.readStream.schema(STEP).json(src), idle_ms=60_000).writeStream.format("memory").queryName("idle").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r.detail for r in spark.table("idle").orderBy("step").collect()] == ["[EMAIL_1] [DATE_1]", None]
