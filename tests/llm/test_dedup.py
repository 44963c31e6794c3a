import random

import duckdb
import pytest

from tests.llm.helpers import awkward, crowded, docs, empty, prose
from veilmark.llm import line_runs, suffix_dedup, unit_dedup
from veilmark.llm.queries import op3_unit_hashing

NONE = -(2**63)


def covered(rows):
    """Bytes that a string of 50 of a smaller doc_id covers, by trying all."""
    first = {}
    for d, t in rows:
        for p in range(len(t) - 49):
            k = t[p : p + 50]
            first[k] = min(first.get(k, d), d)
    out = []
    for d, t in rows:
        gone = bytearray(len(t))
        for p in range(len(t) - 49):
            if first[t[p : p + 50]] < d:
                gone[p : p + 50] = b"\1" * 50
        out.append((d, len(t), bytes(c for c, g in zip(t, gone) if not g)))
    return sorted(out)


def spliced(seed):
    rng = random.Random(seed)
    parts = [prose(100 + i, rng.randrange(3, 40)) for i in range(12)]
    return [(i, " ".join(rng.choice(parts)[rng.randrange(9) :] for _ in range(rng.randrange(1, 6))), None, None, None) for i in range(40)]


@pytest.mark.parametrize("rows", [awkward(), spliced(1), spliced(2), [(i, "a" * (40 + i), None, None, None) for i in range(30)]])
def test_suffixes_match_brute_force(spark, rows, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 3000)
    monkeypatch.setattr(suffix_dedup, "BUCKET", 500)
    got = suffix_dedup.without_repeats(docs(spark, rows)).collect()
    want = covered([(NONE if r[0] is None else r[0], (r[1] or "").encode()) for r in rows])
    assert sorted((NONE if r.doc_id is None else r.doc_id, r.n_bytes, bytes(r.kept)) for r in got) == want
    assert all(r.n_bytes - sum(x.stop - x.start for x in r.removed) == len(r.kept) for r in got)


def test_cover_meets_every_distance():
    d, v = suffix_dedup.COVER, suffix_dedup.MODULUS
    assert {(a - b) % v for a in d for b in d} == set(range(v))


def test_suffix_edges(spark):
    assert suffix_dedup.without_repeats(empty(spark)).count() == 0
    assert suffix_dedup.without_repeats(crowded(docs(spark))).count() == len(awkward())
    assert suffix_dedup.without_repeats(docs(spark, [(1, None, None, None, None)])).first().n_bytes == 0


def test_units_match_sql(spark, tmp_path):
    rows = [(i, r[1].replace(" ", ". ", 3) if r[1] else r[1], *r[2:]) for i, r in enumerate(awkward())] + [(100 + r[0], *r[1:]) for r in spliced(3)]
    docs(spark, rows).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = op3_unit_hashing(spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    cur = con.execute(unit_dedup.ORACLE)
    cols = [c[0] for c in cur.description]
    assert sorted(tuple(r[c] for c in cols) for r in got) == sorted(cur.fetchall())


def test_unit_edges(spark):
    assert unit_dedup.without_repeated_units(empty(spark)).count() == 0
    got = unit_dedup.without_repeated_units(crowded(docs(spark))).collect()
    assert len(got) == len(awkward())
    line = "one two three four five six"
    rows = [(2, line + "\n" + line, None, None, None), (1, "x y\n  One  TWO three four\tfive six ", None, None, None)]
    got = {r.doc_id: r for r in unit_dedup.without_repeated_units(docs(spark, rows), 5).collect()}
    assert got[1].removed == [] and got[2].kept == "" and [(s.start, s.stop) for s in got[2].removed] == [(0, 27), (28, 55)]


def test_units_of_one_id_stay_in_their_rows(spark):
    """The second row of an id keeps its only copy, though another row of that id loses one at the same place."""
    line = " ".join(f"w{i}" for i in range(13))
    rows = [(5, line + "\n" + line, None, None, None), (5, "a" * len(line) + "\n" + line, None, None, None), (6, line, None, None, None)]
    got = {(r.doc_id, r.n_units): r.kept for r in unit_dedup.without_repeated_units(docs(spark, rows)).collect()}
    assert got == {(5, 2): line + "\n", (5, 1): "a" * len(line) + "\n" + line, (6, 1): ""}


def test_runs_of_short_units_go(spark):
    """54 words in sentences of nine, set between other words: no unit counts by itself, their runs do."""
    passage = " ".join(prose(50 + i, 9) + "." for i in range(6))
    rows = [(i, f"{prose(100 + i, 8)}. {passage} {prose(200 + i, 8)}.\n{prose(300 + i, 9)}.", None, None, None) for i in range(3)]
    own = docs(spark, rows)
    assert all(r.kept == rows[r.doc_id][1] for r in unit_dedup.without_repeated_units(own).collect())
    got = {r.doc_id: r.kept for r in unit_dedup.without_repeated_units(own, runs=True).collect()}
    assert got == {0: rows[0][1]} | {i: rows[i][1].replace(passage + " ", "") for i in (1, 2)}
    once = "a. " * 12
    got = {r.doc_id: r.kept for r in unit_dedup.without_repeated_units(docs(spark, [(d, "a. " * 100, None, None, None) for d in (1, 2)]), runs=True).collect()}
    assert got == {1: once, 2: ""}


def passages_brute(rows, least):
    places, out = {}, {}
    for d, t in rows:
        own, at = [], 0
        for u in t.replace(". ", ".\n").split("\n"):
            if u.strip():
                own.append((at, at + len(u), tuple(u.lower().split())))
            at += len(u) + 1
        for i in range(len(own)):
            for j in range(i + 1, len(own) + 1):
                if sum(len(u[2]) for u in own[i:j]) >= least:
                    places.setdefault(tuple(u[2] for u in own[i:j]), []).append((d, own[i][0], own[j - 1][1]))
                    break
    gone = {d: set() for d, _ in rows}
    for found in places.values():
        d0, _, stop0 = min(found)
        for d, start, stop in found:
            if d > d0 or start >= stop0:
                gone[d] |= set(range(start, stop + 1))
    for d, t in rows:
        out[d] = "".join(c for i, c in enumerate(t) if i not in gone[d])
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_runs_of_units_match_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = [prose(i, rng.randrange(1, 9)) for i in range(6)] + ["", "  ", prose(9, 14).upper()]
    rows = [(i, "".join(rng.choice(pool) + rng.choice([". ", "\n"]) for _ in range(rng.randrange(1, 20))), None, None, None) for i in range(30)]
    got = {r.doc_id: r for r in unit_dedup.without_repeated_units(docs(spark, rows), 10, runs=True).collect()}
    assert {d: r.kept for d, r in got.items()} == passages_brute([r[:2] for r in rows], 10)
    assert all(a.stop < b.start for r in got.values() for a, b in zip(r.removed, r.removed[1:]))
    assert unit_dedup.without_repeated_units(crowded(docs(spark)), runs=True).count() == len(awkward())


def test_very_long_text_and_hot_id(spark):
    """A text of nearly two million characters, and an id that holds nearly all rows, in each of the three operators."""
    long = "\n".join(prose(i, 30) for i in range(9000))
    rows = [(1, long, None, None, None), (2, long[:1_000_000], None, None, None)] + [(3, prose(20_000 + i, 20), None, None, None) for i in range(200)]
    own = docs(spark, rows)
    assert len(long) > 1_900_000
    got = unit_dedup.without_repeated_units(own).collect()
    assert len(got) == 202 and sum(len(r.kept) for r in got if r.doc_id == 2) < 300 and all(not r.removed for r in got if r.doc_id == 3)
    got = line_runs.without_repeated_runs(own).collect()
    assert len(got) == 202 and sum(len(r.kept) for r in got if r.doc_id == 2) < 300 and all(not r.removed for r in got if r.doc_id == 3)
    got = suffix_dedup.without_repeats(own).collect()
    assert len(got) == 202 and [len(r.kept) for r in got if r.doc_id == 2] == [0] and all(not r.removed for r in got if r.doc_id == 3)


def runs_brute(rows, least):
    seqs = sorted(rows)
    own = [[b for _, b in line_runs.lines(t)] for _, _, t in seqs]
    numbers = [[i for i, _ in line_runs.lines(t)] for _, _, t in seqs]
    seen, out = {}, {}
    for s, ls in enumerate(own):
        for i in range(len(ls)):
            for j in range(i + 1, len(ls) + 1):
                seen.setdefault(tuple(ls[i:j]), (s, i))
    for s, ls in enumerate(own):
        gone = set()
        for i in range(len(ls)):
            for j in range(i + 1, len(ls) + 1):
                if seen[tuple(ls[i:j])] < (s, i) and sum(len(b.split()) for b in ls[i:j]) >= least:
                    gone |= set(numbers[s][i:j])
        out[seqs[s][0]] = sorted(gone)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_runs_match_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = [prose(i, rng.randrange(1, 9)) for i in range(9)] + ["", "  "]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 14))), None, None, None) for i in range(25)]
    got = {r.doc_id: r.removed for r in line_runs.without_repeated_runs(docs(spark, rows), 10).collect()}
    assert got == runs_brute([(r[0], 0, r[1]) for r in rows], 10)


def test_run_edges(spark):
    assert line_runs.without_repeated_runs(empty(spark)).count() == 0
    got = line_runs.without_repeated_runs(crowded(docs(spark)))
    assert got.count() == len(awkward())
    assert set(crowded(docs(spark)).columns) | {"n_lines"} == set(got.columns)
    a = prose(1, 80)
    by = {(r.doc_id, r.text): r.kept for r in got.collect()}
    b = prose(2, 80)
    assert by[-3, b + "\n" + a] == a and by[1, a] == by[5, a] == by[7, b] == "" and by[None, b] == b


def test_short_repeated_lines_go(spark):
    """A line of nine words, and a run of two short lines, in many documents; a lone short line stays."""
    hot, pair, short = "Click here to read more about this very story", "Read on\nor come back", "the end"
    rows = [(i, f"{prose(100 + i, 12)}\n{hot}\n{prose(200 + i, 12)}\n{pair}\n{prose(300 + i, 12)}\n{short}", None, None, None) for i in range(20)]
    got = {r.doc_id: r.removed for r in line_runs.without_repeated_runs(docs(spark, rows)).collect()}
    assert got == {0: []} | {i: [1, 3, 4] for i in range(1, 20)}
