"""Small inline tables, once for Spark and once as VALUES for DuckDB. Literals are ours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

Rows = list[tuple]


class Fixture:
    def __init__(self, name: str, schema: str, rows: Rows):
        self.name, self.schema, self.rows = name, schema, rows

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.schema)

    @property
    def sql(self) -> str:
        """``name(columns) AS (VALUES ...)``, for a WITH clause."""
        cols = [c.strip().split(" ", 1) for c in self.schema.split(",")]
        kinds = {"string": "VARCHAR", "int": "INTEGER", "long": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "array<string>": "VARCHAR[]"}

        def one(v: object, kind: str) -> str:
            lit = "NULL" if v is None else str(v) if not isinstance(v, (str, list)) else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else "[" + ", ".join(one(x, "string") for x in v) + "]"
            return f"CAST({lit} AS {kinds[kind]})"

        rows = ", ".join("(" + ", ".join(one(v, k) for v, (_, k) in zip(r, cols)) + ")" for r in self.rows)
        return f'{self.name}({", ".join(c for c, _ in cols)}) AS (VALUES {rows})'


SEGMENT = "trace_id string, pos int, segment_id string, role string, kind string, payload_json string, tool_name string, call_id string"
_M = lambda t, p, text, role="user", sid=None: (t, p, sid or f"s{p}", role, "message", '{"text":"' + text + '"}', None, None)
_C = lambda t, p, call, tool="lookup", args='{"q":"x"}', sid=None: (t, p, sid or f"s{p}", "assistant", "tool_call", '{"arguments":' + args + "}", tool, call)
_R = lambda t, p, call, tool="lookup", sid=None: (t, p, sid or f"s{p}", "tool", "tool_result", '{"result":{"ok":true}}', tool, call)

TRACES = Fixture(
    "traces",
    SEGMENT,
    [
        _M("good_text", 1, "hello"),
        _C("good_call", 1, "a"), _R("good_call", 2, "a"), _M("good_call", 3, "done", "assistant"),
        _C("parallel", 1, "a"), _C("parallel", 2, "b"), _R("parallel", 3, "a"), _R("parallel", 4, "b"),
        _M("tool_message", 1, "x", "tool"),
        ("extra_key", 1, "s1", "user", "message", '{"text":"a","content":"b"}', None, None),
        ("number_text", 1, "s1", "user", "message", '{"text":5}', None, None),
        _M("bad_role", 1, "x", "narrator"),
        _M("same_id", 1, "x", sid="s"), _M("same_id", 2, "y", sid="s"),
        _C("missing_result", 1, "a"),
        _R("stray_result", 1, "a"),
        _C("early_message", 1, "a"), _M("early_message", 2, "hm"), _R("early_message", 3, "a"),
        _C("other_tool", 1, "a", "lookup"), _R("other_tool", 2, "a", "search"),
        _C("same_call", 1, "a"), _R("same_call", 2, "a"), _C("same_call", 3, "a"), _R("same_call", 4, "a"),
        _C("bad_arguments", 1, "a", "read_section", '{"case_id":"c","chunk_id":7}'), _R("bad_arguments", 2, "a", "read_section"),
        _C("good_arguments", 1, "a", "search_documents", '{"case_id":"c","query":"q","limit":3}'), _R("good_arguments", 2, "a", "search_documents"),
        ("blank_id", 1, " ", "user", "message", '{"text":"a"}', None, None),
    ],
)

TEMPLATES = Fixture("templates", "trace_id string, pos int, payload_json string", [
    ("t1", 1, '{"text":"{{CHARTERER}} charters {{VESSEL}} for {{RATE}}"}'),
    ("t1", 2, '{"arguments":{"hire":"{{RATE}}","note":"signed {{SIGNING_DATE}}"}}'),
    ("t2", 1, '{"result":{"paid":"{{PAID}}","none":"{{NOTE}}","text":"{{PAID}} and {{NOTE}} and {{RATE}}"}}'),
    ("t3", 1, '{"text":"nothing to fill"}'),
])
WORLDS = Fixture("worlds", "trace_id string, key string, value_json string", [
    ("t1", "CHARTERER", '"Brightwater Freight"'), ("t1", "VESSEL", '"Tern"'), ("t1", "RATE", "21000"), ("t1", "SIGNING_DATE", '"2031-01-06"'),
    ("t2", "PAID", "false"), ("t2", "NOTE", "null"), ("t2", "RATE", "7.5"),
])
CHECKED_WORLDS = Fixture("checked", "trace_id string, key string, value_json string", [
    ("ok", "PRICE", "120"), ("ok", "FEE", "6"), ("ok", "SIGNING_DATE", '"2031-01-06"'), ("ok", "CLOSING_DATE", '"2031-04-01"'), ("ok", "LAW", '"Delaware"'), ("ok", "COURT", '"Chancery"'),
    ("late", "PRICE", "120"), ("late", "FEE", "6"), ("late", "SIGNING_DATE", '"2031-07-07"'), ("late", "CLOSING_DATE", '"2031-04-01"'), ("late", "LAW", '"Delaware"'), ("late", "COURT", '"Chancery"'),
    ("off", "PRICE", "true"), ("off", "FEE", "6"), ("off", "SIGNING_DATE", '"2031-02-30"'), ("off", "CLOSING_DATE", '"20310401"'), ("off", "LAW", '"Delaware"'), ("off", "COURT", '"Old Bailey"'),
    ("dear", "PRICE", "5000"), ("dear", "FEE", "4000"), ("dear", "SIGNING_DATE", '"2031-01-06"'), ("dear", "CLOSING_DATE", '"2031-04-01"'), ("dear", "LAW", '"England"'), ("dear", "COURT", '"Old Bailey"'), ("dear", "MORE", "1"),
    ("zero", "PRICE", "0"), ("zero", "FEE", "6"), ("zero", "SIGNING_DATE", '"2031-01-06"'), ("zero", "CLOSING_DATE", '"2031-04-01"'), ("zero", "LAW", '"England"'), ("zero", "COURT", '"{{COURT}}"'),
])
KEYS = ["CLOSING_DATE", "COURT", "FEE", "LAW", "PRICE", "SIGNING_DATE"]

INTERVALS = Fixture("intervals", "id string, src string, s int, e int", [
    ("nested", "p", 0, 10), ("nested", "p", 2, 5), ("touching", "p", 0, 4), ("touching", "p", 4, 8), ("equal", "p", 0, 5), ("equal", "p", 3, 8),
    ("groups", "p", 4, 6), ("groups", "s", 0, 10), ("groups", "s", 6, 9), ("apart", "s", 1, 3), ("apart", "s", 5, 9), ("chain", "p", 0, 6), ("chain", "p", 5, 12), ("chain", "p", 11, 14),
])

_KEY = "sk-" + "abcdefghij" + "klmnopqrst"
MARKED = Fixture("marked", "id int, text string", [
    (1, "call +1 (555) 010-1234 or mail ann.lee@mail.example.org today"), (2, "ssn 123-45-6789 and file A-123-456-789"), (3, "on 2031-01-06 at 12 Main Street, Spring Field, NY 12345"),
    (4, "[PERSON_1] met [ORG_2] and [x] not [Org_1]"), (5, ""), (6, "nothing here"), (7, "key " + _KEY + " leaked"),
])
CARDS = Fixture("cards", "id int, text string", [
    (1, "card 4242424242424242 ok"), (2, "card 4111111111111112 no"), (3, "grouped 4242 4242 4242 4242 here"), (4, "id ab4242424242424242cd9e"), (5, "card4242424242424242"),
    (6, "fused 94242424242424242 x"), (7, "two 4242424242424242 5555555555554444 x"), (8, "no digits"), (9, "short 123456789012"),
])
ANSWERS = Fixture("answers", "trace_id string, text string", [
    ("a1", "Type: real email address\nInference: seen\nGuess: a@x.org; b@x.org; ; c@x.org; d@x.org\nCertainty: 4\nType: real URL\nGuess: http://one"),
    ("a2", "Guess: lost\nType: Real Phone Number\nGuess: 1; 2\nGuess: 3"),
    ("a3", "Type: real secret or credential value\nInference: none"),
    ("a4", "no form at all"),
])
DEALS = Fixture("deals", "trace_id string, case_id string, workflow string", [
    ("adobe_figma_2022_t01", "adobe_figma_2022", "structure_payment"), ("cisco_splunk_2023_t02", "cisco_splunk_2023", "draft_memo"), ("unknown_case_t03", "green_leaf_2001", "review"),
    ("jetblue_spirit_1999_t01", "jetblue_spirit_1999", "compare_terms"),
])
GUESSED = Fixture("guessed", "trace_id string, companies array<string>, year string", [
    ("adobe_figma_2022_t01", ["Adobe Inc", "Sketch"], "2022"), ("cisco_splunk_2023_t02", [], None), ("jetblue_spirit_1999_t01", ["Spirit", "JetBlue"], " 2001 "),
])
TEXTS = Fixture("texts", "trace_id string, text string", [
    ("adobe_figma_2022_t01", "Adobe pays Figma; ADOBE's figma, not Adobes"), ("jetblue_spirit_1999_t01", "JetBlue and the Spirit of jetblue"), ("cisco_splunk_2023_t02", "no party"), ("unknown_case_t03", "Green Leaf grows green"),
])
TOKENS = Fixture("tokens", "id int, text string, guesses array<string>", [(1, "[ORG_1] and [ORG_3] and [PERSON_1]", ["Tern", "Gull"]), (2, "[ORG_2] [ORG_1]", ["Tern", "Gull"]), (3, "[ORG_1] stays", [])])
NAMES = Fixture("named", "trace_id string, text string", [
    ("n1", "Acme Holdings bought Borealis Systems. Acme Holdings, then Borealis Systems, and Acme Holdings paid Cedar Group."), ("n2", "Dune Analytics and Elm Corp. met; Elm Corp. left Dune Analytics"), ("n3", "nobody"),
])
SLOTS = Fixture("slots", "id string, source_id string, matter string, steps_json string", [
    ("syn-001", "adobe_figma_2022_t01", "X / Y — Draft Memo", "[1]"), ("syn-002", "cisco_splunk_2023_t02", "P / Q — Draft Memo", "[2]"), ("syn-003", None, "R / S — Review", "[3]"),
])
FRESH = Fixture("fresh", "source_prefix string, title string, matter string, steps_json string", [("adobe_figma", "Draft Memo", "A / B — Draft Memo", "[9]"), ("adobe_figma", "Review", None, "[8]")])
RAW_ATTRIBUTES = Fixture("raw", "id int, answer string", [
    (1, 'Sure: {"companies":["Adobe","Figma"],"year":"2022"} done'), (2, '{"companies":[],"year":null}'), (3, "no json"), (4, '{"companies":["A",""],"year":2021}'), (5, '{"companies":["A"], broken'),
])
SCALARS = Fixture("scalars", "id int, value_json string", [(1, '"2031-01-06"'), (2, '"2031-02-30"'), (3, "12"), (4, "-1.5e3"), (5, "true"), (6, "null"), (7, '"12"'), (8, "1e999"), (9, '"20310106"')])
