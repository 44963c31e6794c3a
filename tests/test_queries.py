"""Every registered query of the engine against its DuckDB twin."""

import duckdb
import pytest

from veilmark.plans import queries, tables  # noqa: F401
from veilmark.plans.registry import CASES, ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([float(r[i]) if type(r[i]).__name__ == "Decimal" else r[i] for i in order]) for r in values)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_twin(spark, duck, name):
    own = QUERIES[name](spark, SF)
    got = own.collect()
    if name in ORACLE:
        cur = duck.execute(ORACLE[name])
        cols = [c[0] for c in cur.description]
        assert sorted(cols) == sorted(own.columns)
        assert rows(own.columns, got) == rows(cols, cur.fetchall())
    else:
        assert got


@pytest.mark.parametrize("name", sorted(CASES))
def test_case(spark, duck, name):
    run, sql = CASES[name]
    own = run(spark, SF)
    cur = duck.execute(sql)
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(own.columns) and rows(own.columns, own.collect()) == rows(cols, cur.fetchall())


def test_cards_match_brute_force(spark):
    """Every digit of every document, one at a time."""

    def slow(text):
        i, n = 0, len(text)
        while i < n:
            if not text[i].isdigit():
                i += 1
                continue
            j, at = i, [i]
            while True:  # the next digit may follow one space or hyphen
                k = j + 1 + (j + 2 < n and text[j + 1] in " -" and text[j + 2].isdigit())
                if k >= n or not text[k].isdigit():
                    break
                j = k
                at.append(j)
            if len(at) >= 13:
                left, right = i, j + 1
                while left and text[left - 1].isascii() and text[left - 1].isalnum():
                    left -= 1
                while right < n and text[right].isascii() and text[right].isalnum():
                    right += 1
                touches = (left < i and text[i - 1].isalpha()) or (right > j + 1 and text[j + 1].isalpha())
                inner = text[left:right].strip("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
                if not (text[i : j + 1].isdigit() and touches and any(c.isalpha() for c in inner)):
                    digits = "".join(text[a] for a in at)
                    found = [digits[a : a + m] for m in range(19, 12, -1) for a in range(len(digits) - m + 1) if sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits[a : a + m]))) % 10 == 0]
                    if found:
                        yield found[0]
            i = j + 1

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    want = sorted((r.doc_id, c) for r in docs for c in slow(r.text or ""))
    got = sorted(tuple(r) for r in QUERIES["card_window_scan"](spark, "/root/testdata/sf0.01").collect())
    assert got == want and len(want) > 10


def test_names_by_chance(spark, tmp_path):
    """Syllables that come near a name, and names spelt or spaced otherwise, go in the first round; any line end may be in a text."""
    said = ["an haly onines ou", "halyon inhe", "haly oninre. haly oniner", "HALCYON\nLINE", "by HalcyonLine (Halcyn Line)", "Halcyon Line, 18500", "the hal\u0301cyo\u0301n line", "Orin Shipping", "nothing", "", None, "a\u2028b", "\u2029", "a\u0085"]
    turns = [(i, k, ("user", "assistant")[k], t) for i, t in enumerate(said) for k in range(2)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    cur = con.execute(ORACLE["synthesize_conversations"])
    own = QUERIES["synthesize_conversations"](spark, str(tmp_path))
    assert rows(own.columns, own.collect()) == rows([c[0] for c in cur.description], cur.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 200
    assert set(e.oracle_sql()) <= set(e.queries())
