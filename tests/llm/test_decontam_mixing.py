import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import awkward, crowded, docs, empty, prose
from veilmark.llm import common, decontam, mixing
from veilmark.llm.queries import op6_decontamination

ITEM = "item_id long, text string"


def test_hits_match_sql(spark, tmp_path):
    a, b = prose(1, 80).split(), prose(2, 80).split()
    items = [(1, " ".join(a[10:40])), (2, " ".join(b[:9])), (3, "x"), (4, ""), (5, None), (6, " ".join(b[20:30]).upper()), (7, "alpha beta"), (30, " ".join(a[10:40])), (8, "alpha1 alpha1 alpha1 " * 9)]
    rows = [(i, *r[1:]) for i, r in enumerate(awkward())] + [(100, "alpha1 " * 40, None, None, None), (101, "Alpha,beta;x", None, None, None), (102, " ".join(a[5:25]) + " !! " + " ".join(b[:9]), None, None, None), (103, "éx x", None, None, None)]
    docs(spark, rows).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, ITEM).coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    cur = con.execute(decontam.ORACLE)
    cols = [c[0] for c in cur.description]
    want = sorted(cur.fetchall())
    assert any(r[cols.index("n_items")] > 2 for r in want)
    for most in (decontam.BROADCAST, 0):
        decontam.BROADCAST, before = most, decontam.BROADCAST
        try:
            assert sorted(tuple(r[c] for c in cols) for r in op6_decontamination(spark, str(tmp_path)).collect()) == want
        finally:
            decontam.BROADCAST = before


def test_hit_edges(spark):
    items = spark.createDataFrame([(None, "alpha beta"), (2, prose(1, 20))], ITEM)
    none = spark.createDataFrame([], ITEM)
    assert decontam.contaminated(empty(spark), items).count() == 0
    got = decontam.contaminated(docs(spark), none).collect()
    assert len(got) == len(awkward()) and all(r.n_hit == 0 and r["items"] == [] for r in got)
    got = decontam.contaminated(crowded(docs(spark)), items)
    assert got.count() == len(awkward()) and got.where("n_hit > 0").count() == 5
    assert hashlib.sha256(b"").hexdigest() == got.where("n_hit = 0").selectExpr("sha2(array_join(items, ','), 256) as s").first().s


def fill(sizes, budget=1.5, epochs=2):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, target, free = budget * sum(sizes.values()), {}, set(order)
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > epochs * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = epochs * sizes[s]
            left -= target[s]
            free.remove(s)
    return target


def cut(rows, budget=1.5):
    """The order of all copies by finish time, cut by hand: words taken for each row of (before, size, source_size, weight, tie)."""
    order = sorted((((r.source_size * e + r.before + r.size) / r.weight, t, r.size, i) for i, r in enumerate(rows) for e, t in enumerate(r.ties)))
    out, at = [0] * len(rows), 0
    for _, _, size, i in order:
        if at + size / 2 <= budget * sum(r.size for r in rows):
            out[i] += size
        at += size
    return out


@pytest.mark.parametrize("each", [common.RANGE, 60])
@pytest.mark.parametrize("rows", [awkward(), [(i, prose(i, 1 + i % 50), None, f"s{i % 7 if i % 3 else 0}", 0) for i in range(400)]])
def test_mix(spark, rows, each, monkeypatch):
    monkeypatch.setattr(common, "RANGE", each)
    got = mixing.mixed(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(d), len((t or "").encode().split())) for d, t, *_ in rows)
    tags = mixing.tagged(mixing.sized(docs(spark, rows)))
    source = tags.withColumn("ties", F.array(*(mixing.tie(F.lit(e)) for e in range(2)))).collect()
    sizes, taken, target, places = {}, {}, {}, {}
    for r in source:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.size * len(r.copies)
        target[r.source] = r.target
        places.setdefault(r.source, []).append((r.before, r.before + r.size))
        assert len(r.copies) <= 2
    want = fill(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s])
        spans = sorted(p for p in places[s] if p[0] < p[1])  # the queue: documents after one another, from 0
        assert [a for a, _ in spans] == [0, *(z for _, z in spans[:-1])][: len(spans)]
    assert [r.size * len(r.copies) for r in source] == cut(source)
    assert abs(sum(taken.values()) - sum(want.values())) <= max(r.size for r in source) / 2
    assert sum(r.taken for r in got) == sum(taken.values())
    assert sorted(map(str, mixing.mixed(docs(spark, rows).repartition(5)).collect())) == sorted(map(str, got))


def test_sources_end_near_their_targets(spark):
    rows = [(i, prose(i, 5 + i % 40), None, f"s{i % 11}" if i % 3 else "hot", 0) for i in range(3000)]
    own = mixing.tagged(mixing.sized(docs(spark, rows))).collect()
    for s in {r.source for r in own}:
        mine = [r for r in own if r.source == s]
        assert abs(sum(r.size * len(r.copies) for r in mine) - mine[0].target) <= max(r.size for r in own)
    plan = mixing.mixture(docs(spark, rows))._jdf.queryExecution().toString()
    assert "rangepartitioning(virtual_finish" in plan


def test_mixture(spark):
    assert mixing.mixed(empty(spark)).count() == 0 and mixing.mixture(empty(spark)).count() == 0
    out = mixing.mixture(crowded(docs(spark)))
    times = [r.virtual_finish for r in out.collect()]
    assert times == sorted(times) and len(times) >= len(awkward())
    words = lambda rows: sum(len((r.text or "").encode().split()) for r in rows)
    assert words(out.collect()) == sum(r.taken for r in mixing.mixed(docs(spark)).collect())
    assert all(t.target == 0 for t in mixing.mixed(docs(spark, [(1, "", None, "a", 0), (2, None, None, "b", 0)])).collect())
