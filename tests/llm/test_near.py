import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tests.llm.helpers import awkward, crowded, docs, empty, prose
from veilmark.llm import near_copies, simhash
from veilmark.llm.components import components


def bits(text, n=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in " \t\n\r\x0b\f" else c for c in low).split(" ") if w]
    grams = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] if len(words) >= n else [" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def union(n, linked):
    label = list(range(n))
    for _ in range(n):
        for i in range(n):
            for j in range(n):
                if linked(i, j) and label[j] < label[i]:
                    label[i] = label[j]
    return label


def test_awkward_rows(spark):
    rows = [r for r in awkward() if r[0] is not None]
    got = sorted(simhash.groups(docs(spark, rows)).collect(), key=lambda r: (r.doc_id, r.fp))
    rows = sorted(rows, key=lambda r: (r[0], bits(r[1]) - (1 << 64) * (bits(r[1]) >> 63)))
    fp = [bits(r[1]) for r in rows]
    assert [r.fp % (1 << 64) for r in got] == fp
    part = union(len(fp), lambda i, j: (fp[i] ^ fp[j]).bit_count() <= 4)
    assert [r.component_id for r in got] == [min(rows[j][0] for j in range(len(rows)) if part[j] == part[i]) for i in range(len(rows))]


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 3000])
def test_every_link_is_found(spark, bucket, monkeypatch):
    """Chains of fingerprints 4 bits apart, strangers 5 bits off, and a dense ball."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = np.random.default_rng(1)
    fps = []
    for _ in range(15):
        x = int(rng.integers(0, 1 << 63))
        fps.append(x)
        for step in (4, 3, 5, 4, 1):
            for b in rng.choice(64, step, replace=False):
                x ^= 1 << int(b)
            fps.append(x)
    ball = int(rng.integers(0, 1 << 63))
    fps += [ball ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (40, 2))]
    fps = sorted(set(fps))
    df = spark.createDataFrame([(f - (1 << 64) * (f >> 63),) for f in fps], "fp long")
    part = {r.node % (1 << 64): r.component for r in components(simhash.linked_fingerprints(df)).collect()}
    label = union(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    for i, f in enumerate(fps):
        alone = label.count(label[i]) == 1
        assert (f not in part) == alone
        if not alone:
            assert [part[g] == part[f] if g in part else False for g in fps] == [label[j] == label[i] for j in range(len(fps))]


def test_edges(spark):
    assert simhash.groups(empty(spark)).count() == 0
    assert simhash.groups(crowded(docs(spark))).count() == len(awkward())
    assert simhash.groups(docs(spark, [(None, "a b", None, None, None)])).first().component_id is None
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 99), (7, 7)], "u long, v long")
    assert {r.node: r.component for r in components(chain).collect()} == {**{i: 0 for i in range(61)}, 99: 99, 100: 99}


def test_near_copies(spark):
    def edited(text, every):
        return " ".join(w + "x" if i % every == every // 2 else w for i, w in enumerate(text.split()))

    rows = []
    for i in range(30):
        t = prose(1000 + i, 300)
        rows += [(10 * i, t, None, None, None), (10 * i + 1, edited(t, 100), None, None, None), (10 * i + 2, t, None, None, None)]
    kept = {r.doc_id for r in near_copies.without_near_copies(docs(spark, rows)).collect()}
    assert {10 * i for i in range(30)} <= kept and len(kept) <= 32
    assert near_copies.without_near_copies(empty(spark)).count() == 0
    own = near_copies.without_near_copies(crowded(docs(spark)))
    assert set(own.columns) == set(crowded(docs(spark)).columns)
    ids = [r.doc_id for r in own.collect()]
    assert ids.count(1) == 2 and 5 not in ids and 7 in ids


def test_strangers_between_near_copies():
    """A pair that neither stands next to one another in its value nor with the value's first one."""
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 1 << 63, (41, 3), np.uint64)
    fps[:, 0] = fps[0, 0]  # two fingerprints in common: all meet, and are strangers
    for a, b, flip in ((5, 30, 0b1011), (11, 24, 0b1011), (24, 40, 0b110000)):
        fps[b] = fps[a]
        fps[b, 2] ^= np.uint64(flip)
    bits, bucket = 0, 0
    batch = pa.RecordBatch.from_pydict({"bucket": pa.array([bucket], pa.int32()), "data": pa.array([fps.tobytes()], pa.binary())})
    ids = near_copies._ids(fps).tolist()
    links = {(ids.index(u), ids.index(v)) for b in near_copies._linked(bits)([batch]) for u, v in zip(b["u"].to_pylist(), b["v"].to_pylist())}
    assert links == {(30, 5), (24, 11), (40, 11)}


@pytest.mark.parametrize("block", [near_copies.BLOCK, 30_000])
def test_only_what_is_alike_is_linked(spark, block, monkeypatch):
    """Pairs at exactly 0.8 and more, pairs well below, and many that share one passage."""
    monkeypatch.setattr(near_copies, "BLOCK", block)
    rng = np.random.default_rng(5)

    def fresh(n):
        return [f"w{x}" for x in rng.integers(0, 1 << 40, n)]

    passage, rows = fresh(124), []
    for i in range(40):
        t = fresh(184)  # 180 shingles, of which the first 160 stay: 160 of 200
        rows += [(10 * i, t), (10 * i + 1, t[:164] + fresh(20))]
        rows += [(10 * i + 4, u := fresh(184)), (10 * i + 5, u[:150] + fresh(34))]  # 146 of 214
        rows += [(10 * i + 7, passage + fresh(60))]
    own = docs(spark, [(k, " ".join(t), None, None, None) for k, t in rows])
    group = {r.doc_id: r.group for r in near_copies.near_groups(own).collect()}
    assert sum(group[10 * i] == group[10 * i + 1] for i in range(40)) >= 37
    assert len(set(group.values())) == 200 - sum(group[10 * i] == group[10 * i + 1] for i in range(40))


def test_few_buckets_get_a_fingerprint():
    """At a size where buckets are 256: of each of the six, 37 get it, and all that meet meet there."""
    fps = np.random.default_rng(7).integers(0, 1 << 63, (500, 3), np.uint64)
    batch = pa.RecordBatch.from_pydict({"fp": pa.array([f.tobytes() for f in fps], pa.binary())})
    sent = sum(len(d) for b in near_copies._dealt(8)([batch]) for d in b["data"].to_pylist())
    assert sent <= len(fps) * near_copies.PARTS * 37 * 24


@pytest.mark.parametrize("bucket, round_", [(near_copies.BUCKET, near_copies.ROUND), (20_000, near_copies.ROUND), (20_000, 1), (3000, 60_000)])
def test_candidates_match_brute_force(spark, bucket, round_, monkeypatch):
    """One bucket and many, one round and several, values of a dense group in slices."""
    rng = np.random.default_rng(9)
    fps = rng.integers(0, 1 << 63, (60, 3), np.uint64)
    near = [fps[i // 4].copy() for i in range(120)] + [fps[0].copy() for _ in range(60)]
    for i, f in enumerate(near):
        for b in rng.choice(192, 8 + i % 40, replace=False).tolist():
            f[b // 64] ^= np.uint64(1 << (b % 64))
    fps = np.unique(np.concatenate([fps, np.array(near)]), axis=0)
    words = np.ascontiguousarray(fps).view("<u4")
    apart = np.bitwise_count(words[:, None] ^ words[None])
    linked = (apart.min(axis=2) <= near_copies.RADIUS) & (apart.sum(axis=2) <= near_copies.LIMIT)
    want = near_copies.local_components(len(fps), *np.nonzero(linked)).tolist()
    monkeypatch.setattr(near_copies, "BUCKET", bucket)
    monkeypatch.setattr(near_copies, "ROUND", round_)
    df = spark.createDataFrame([(bytearray(f.tobytes()),) for f in fps], "fp binary")
    part = {r.node: r.component for r in components(near_copies._candidates(df, len(fps))).collect()}
    ids = near_copies._ids(fps).tolist()
    got = [part.get(i, i) for i in ids]
    assert 20 < len(set(want)) < len(fps) - 50
    assert [got.index(c) for c in got] == [want.index(c) for c in want]


def test_slices_hold_every_variant_once(monkeypatch):
    monkeypatch.setattr(near_copies, "BUCKET", 100)
    value = np.random.default_rng(4).integers(0, 1 << 32, 50, np.uint64)
    fits = [(np.arange(30), near_copies.MASKS[:40]), (np.arange(30, 50), near_copies.MASKS[40:])]
    slices = [sorted((int(r), int(value[r] ^ x)) for i, m in some for r in i for x in m) for some in near_copies._slices(value, fits)]
    assert len(slices) > 30 and sorted(v for s in slices for v in s) == sorted((int(r), int(value[r] ^ x)) for i, m in fits for r in i for x in m)
    values = [{v for _, v in s} for s in slices]
    assert sum(map(len, values)) == len(set().union(*values))
