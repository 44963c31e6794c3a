"""Near copies at a similarity of 0.8 or more, by SimHash and meeting in the middle.

Shingles of five words that two texts share in 0.8 of all leave SimHashes of 64 bits about ten bits
apart, and a ball of that radius has too many values to list. So a text has six fingerprints of 32
bits. Two texts are candidates if in any of the six they differ in at most 4 bits: each fingerprint
emits all 529 values within 2 bits, and equal values meet, as in ``simhash``. Those that
meet are candidates if they are within a loose bound on all 192 bits together. All members of a value are
compared, in blocks. Groups are spread over buckets by a linear map, and a bucket sends one link for each
member at most. Each bit of a bucket's number sums up bits of its own, so that two flips reach few buckets: of
2^b, 1 + b + b(b-1)/2 get a fingerprint. What would be over ``ROUND`` bytes is sent in rounds, down to one
fingerprint of the six in each, and what a round has sent goes before the next.

What candidates connect is a loose component. Within each, all pairs of texts are compared exactly, on
their sets of shingles, and only a similarity of 0.8 or more links. A large component is cut into blocks,
and each pair of blocks is compared by itself; it too sends one link for each member at most.

Of pairs at a similarity of 0.8, 97 in 100 meet in some fingerprint, and of those that copy each other
more closely, nearly all. Pairs at 0.8 differ in about 29 of 192 bits (standard deviation 5).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.llm.common import scratch, shielded, written
from veilmark.llm.components import components, local_components

WORDS = 5
#: Fingerprints of 32 bits, bits within which two meet, and bits of all 192 within which a pair is a candidate.
PARTS, RADIUS, LIMIT = 6, 4, 45
BUCKET = 8 << 20
#: Bytes that a round sends to buckets, if that is several of the six.
ROUND = 1 << 30
#: Pairs of fingerprints that are compared at once.
PAIRS = 1 << 20
#: Bytes of text in a block of a loose component, bytes that a text counts as at least, and columns of a product.
BLOCK, LEAST, COLUMNS = 2 << 20, 2048, 2048
MASKS = np.array([0] + [sum(1 << i for i in c) for k in range(1, RADIUS // 2 + 1) for c in combinations(range(32), k)], np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def digests(text: str | None) -> np.ndarray:
    """Of each shingle, repeated ones too. Fewer than five words: one shingle. No words: none."""
    own = (text or "").encode().lower().split()
    if not own:
        return np.empty(0, np.uint64)
    whole = b" ".join(own)
    stops = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1) - 1
    starts = np.concatenate([[0], stops[:-1] + 1])[: max(1, len(own) - WORDS + 1)].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(whole[a:z], 42) for a, z in zip(starts, stops[WORDS - 1 :].tolist() or [len(whole)])], np.uint64)


def fingerprint(text: str | None) -> bytes:
    """24 bytes: for each of 192 bits, is it set in over half of the shingles' digests? No words: zero."""
    h = digests(text)
    if not len(h):
        return bytes(24)
    out = []
    for k in range(PARTS // 2):
        x = h if k == 0 else (h ^ np.uint64(k)) * _ODD
        x = x if k == 0 else (x ^ (x >> np.uint64(29))) * _ODD
        x = x if k == 0 else x ^ (x >> np.uint64(32))
        bits = np.unpackbits(np.ascontiguousarray(x, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(np.packbits(bits * 2 > len(h), bitorder="little").tobytes())
    return b"".join(out)


def _hashed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        fp = [fingerprint(t) for t in batch["text"].to_pylist()]
        ids = [xxhash.xxh3_64_intdigest(f) - (1 << 63) for f in fp]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text_hash"], batch["n"], pa.array(ids, pa.int64()), pa.array(fp, pa.binary())], ["doc_id", "text_hash", "n", "id", "fp"])


def _own_rows(bits: int) -> list[np.uint64]:
    """The map to buckets: no two bits of a bucket's number depend on one bit of the fingerprint."""
    return [np.uint64(sum(1 << j for j in range(i, 32, bits))) for i in range(bits)]


def _mixed_rows(bits: int) -> list[np.uint64]:
    """A map that spreads the values of a dense group evenly."""
    return list(np.random.default_rng(32).integers(1, 1 << 32, bits, np.uint64))


def _syndrome(x: np.ndarray, rows: list[np.uint64]) -> np.ndarray:
    out = np.zeros(len(x), np.int64)
    for i, r in enumerate(rows):
        out |= (np.bitwise_count(x & r) & 1).astype(np.int64) << i
    return out


def _parts(fp: np.ndarray) -> np.ndarray:
    """``fp``: rows of three words. Rows of six fingerprints."""
    return fp.view("<u4").reshape(len(fp), PARTS).astype(np.uint64)


def _moves(bits: int) -> np.ndarray:
    return np.unique(_syndrome(MASKS, _own_rows(bits)))


def _dealt(bits: int, chosen: range = range(PARTS)):
    own_rows, moves = _own_rows(bits), _moves(bits)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            all_ = np.frombuffer(b"".join(batch["fp"].to_pylist()), np.uint64).reshape(-1, 3)
            step = 1 + (1 << 20) // len(moves)
            for at in range(0, len(all_), step):
                fp = np.ascontiguousarray(all_[at : at + step])
                parts = _parts(fp)
                for j in chosen:
                    to = (_syndrome(parts[:, j], own_rows)[:, None] ^ moves).ravel()
                    order = np.argsort(to, kind="stable")
                    cuts = np.flatnonzero(np.diff(to[order])) + 1
                    rows = np.split(np.repeat(fp, len(moves), axis=0)[order], cuts)
                    which = to[order][np.concatenate([[0], cuts])] + (j << bits)
                    yield pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array([r.tobytes() for r in rows], pa.binary())], ["bucket", "data"])

    return run


def _ids(fp: np.ndarray) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(f.tobytes()) - (1 << 63) for f in fp], np.int64)


def _linked(bits: int):
    rows = _own_rows(bits)
    of = _syndrome(MASKS, rows)
    masks = {s: MASKS[of == s] for s in np.unique(of).tolist()}

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        for batch in it:
            for bucket, data in zip(batch["bucket"].to_pylist(), batch["data"].to_pylist()):
                if held and bucket not in held:
                    yield from done(held)
                    held = {}
                held.setdefault(bucket, []).append(data)
        yield from done(held)

    def done(held: dict[int, list[bytes]]) -> Iterator[pa.RecordBatch]:
        for bucket, blobs in held.items():
            fp = np.frombuffer(b"".join(blobs), np.uint64).reshape(-1, 3)
            part, own_bucket = bucket >> bits, bucket & ((1 << bits) - 1)
            value = _parts(np.ascontiguousarray(fp))[:, part]
            own = _syndrome(value, rows)
            fits = [(np.flatnonzero(own == s), m) for s in np.unique(own).tolist() if (m := masks.get(s ^ own_bucket)) is not None]
            label = np.arange(len(fp))
            for some in _slices(value, fits):
                label = _tied(*_meeting(value, some), fp, label)
            tied = np.flatnonzero(label != np.arange(len(fp)))
            yield pa.RecordBatch.from_arrays([pa.array(_ids(fp[tied])), pa.array(_ids(fp[label[tied]]))], ["u", "v"])

    return run


def _slices(value: np.ndarray, fits: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[list[tuple[np.ndarray, np.ndarray]]]:
    """``fits`` (rows, and the masks that each of them gets) by slices of the values that come of it, where they are far over
    ``BUCKET``, as a dense group's may be. Equal values are in one slice."""
    n = sum(len(i) * len(m) for i, m in fits)
    extra = _mixed_rows(max(0, int(np.ceil(np.log2(max(1, n) / (2 * BUCKET))))))
    if not extra:
        yield fits
        return
    of = [(i, _syndrome(value[i], extra), m, _syndrome(m, extra)) for i, m in fits]
    for s in range(1 << len(extra)):
        yield [(i[a == s ^ g], m[b == g]) for i, a, m, b in of for g in np.unique(b).tolist()]


def _meeting(value: np.ndarray, fits: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The members of each value that several have, after one another, and: is it the first of its value?"""
    # A value above, the number of its fingerprint below: one sort brings equals together.
    all_, at = np.empty(sum(len(i) * len(m) for i, m in fits), np.uint64), 0
    for i, m in fits:
        to = all_[at : at + len(i) * len(m)].reshape(len(i), len(m))
        np.bitwise_xor(value[i][:, None], m, out=to)
        np.left_shift(to, np.uint64(32), out=to)
        np.bitwise_or(to, i.astype(np.uint64)[:, None], out=to)
        at += to.size
    all_.sort()
    # Only what meets something is looked at further; in stretches, for less memory.
    same = [np.flatnonzero(all_[a + 1 : a + PAIRS + 1] >> np.uint64(32) == all_[a : a + len(all_[a + 1 : a + PAIRS + 1])] >> np.uint64(32)) + a + 1 for a in range(0, len(all_), PAIRS)]
    same = np.concatenate(same) if same else np.empty(0, np.int64)
    met = np.union1d(same, same - 1)
    i, top = (all_[met] & np.uint64(0xFFFFFFFF)).astype(np.int64), all_[met] >> np.uint64(32)
    return i, np.append(True, top[1:] != top[:-1])[: len(top)]


def _tied(i: np.ndarray, new: np.ndarray, fp: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Components of the rows of ``fp`` under: in one value, and within ``LIMIT`` bits of all; and those of ``label``.

    ``i``: the members of each value after one another; ``new``: is it the first of its value? All members
    of a value are compared, but for those that are in one component already."""

    def tie(u: np.ndarray, v: np.ndarray) -> None:
        nonlocal label
        apart = np.flatnonzero(label[u] != label[v])
        u, v = u[apart], v[apart]
        sure = np.bitwise_count(fp[u] ^ fp[v]).sum(axis=1) <= LIMIT
        if sure.any():
            label = local_components(len(fp), np.concatenate([np.arange(len(fp)), u[sure]]), np.concatenate([label, v[sure]]))

    if not len(i):
        return label
    starts, group = np.flatnonzero(new), np.cumsum(new) - 1
    sizes = np.diff(np.append(starts, len(i)))
    # With the one before and with the first: what settles a dense group.
    at = np.flatnonzero(~new)
    for other in (at - 1, starts[group[at]]):
        for k in range(0, len(at), PAIRS):
            tie(i[at[k : k + PAIRS]], i[other[k : k + PAIRS]])
    # What is outside the largest component of its value, with all of the value.
    order = np.lexsort((label[i], group))
    run = np.flatnonzero(np.append(True, (np.diff(group[order]) != 0) | (np.diff(label[i[order]]) != 0)))
    length = np.diff(np.append(run, len(i)))
    of = group[order[run]]
    by = np.lexsort((length, of))
    largest = by[np.append(np.flatnonzero(np.diff(of[by])), len(by) - 1)]
    outside = np.ones(len(run), bool)
    outside[largest] = False
    rest = order[np.repeat(outside, length)]
    ends = np.cumsum(sizes[group[rest]])
    k = 0
    while k < len(rest):
        z = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + PAIRS, "right")))
        some, n = rest[k:z], sizes[group[rest[k:z]]]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        tie(np.repeat(i[some], n), i[np.repeat(starts[group[some]], n) + within])
        k = z
    return label


def _sets(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        data = [np.unique(digests(t)).tobytes() for t in batch["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("text_hash", "comp", "b", "blocks")), pa.array(data, pa.binary())], ["text_hash", "comp", "b", "blocks", "data"])


def common(sets: list[np.ndarray], n: int) -> np.ndarray:
    """How many shingles each of the first ``n`` sets has in common with each of the others; n = 0: all with all."""
    k = 0 if n == 0 else n
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, first, column, times = np.unique(np.concatenate(sets), return_index=True, return_inverse=True, return_counts=True)
    # Columns in order of their first set, so that the sets of a chunk are few where most are unlike.
    seen = np.flatnonzero(times > 1)
    number = np.full(len(times), -1)
    number[seen[np.argsort(first[seen])]] = np.arange(len(seen))
    column = number[column]
    rows, column = rows[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    out = np.zeros((n or len(sets), len(sets) - k), np.float32)
    cuts = np.searchsorted(column, np.arange(0, len(seen) + COLUMNS, COLUMNS))
    for j, (a, z) in enumerate(zip(cuts, cuts[1:])):
        own, at = np.unique(rows[a:z], return_inverse=True)
        x = np.zeros((len(own), COLUMNS), np.float32)
        x[at, column[a:z] - j * COLUMNS] = 1
        left, right = (own < n, own >= n) if n else (slice(None), slice(None))
        out[np.ix_(own[left], own[right] - k)] += x[left] @ x[right].T
    return out.astype(np.int64)


def _alike(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by comp, lo, hi: links of texts at 0.8 or more, one of blocks lo and one of hi."""
    key, held, out = None, [], []
    for batch in it:
        for *k, b, text_hash, data in zip(*(batch[c].to_pylist() for c in ("comp", "lo", "hi", "b", "text_hash", "data"))):
            if k != key:
                out += _compared(held)
                key, held = k, []
            held.append((b, text_hash, data))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["u", "v"])
        out = []
    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in _compared(held)], pa.int64()) for i in (0, 1)], ["u", "v"])


def _compared(held: list[tuple[int, int, bytes]]) -> list[tuple[int, int]]:
    if len(held) < 2:
        return []
    held.sort(key=lambda x: x[:2])
    ids = [h for _, h, _ in held]
    sets = [np.frombuffer(d, np.uint64) for _, _, d in held]
    size = np.array([len(s) for s in sets])
    n = sum(b == held[0][0] for b, _, _ in held) % len(held)  # 0: of one block
    # 0.8 or more of the union, in whole numbers.
    u, v = np.nonzero(9 * common(sets, n) >= 4 * (size[: n or len(size), None] + size[n:]))
    label = local_components(len(ids), u, v + n)
    return [(ids[i], ids[j]) for i, j in enumerate(label.tolist()) if i != j]


def _candidates(fps: DataFrame, n: int) -> DataFrame:
    """Links (u, v) between ``n`` fingerprints (fp). What is sent to buckets is on disk for one round at a time."""
    bits = min(32, max(2, int(np.ceil(np.log2(max(1.0, n * len(MASKS) / BUCKET))))))
    each = min(PARTS, max(1, ROUND // max(1, n * len(_moves(bits)) * 8 * (PARTS // 2))))
    out = None
    for first in range(0, PARTS, each):
        parts = range(first, min(PARTS, first + each))
        dealt = fps.mapInArrow(_dealt(bits, parts), "bucket int, data binary").repartitionById(len(parts) << bits, F.col("bucket") - F.lit(first << bits)).sortWithinPartitions("bucket")
        links = dealt.mapInArrow(_linked(bits), "u long, v long")
        if each < PARTS:
            links = written(links.distinct(), "links")
        out = links if out is None else out.unionByName(links)
    return out


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and group of each row of ``docs``: what is linked has one group.

    Null or blank text: one group of its own. Equal texts: one group. Fewer than five words: one shingle.
    Empty table: no rows."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.octet_length("text").alias("n"), "text")
    own = written(docs.mapInArrow(_hashed, "doc_id long, text_hash long, n int, id long, fp binary"), "near")
    fps = written(own.select("id", "fp").distinct(), "distinct")
    part = components(_candidates(fps.select("fp"), fps.count()))
    # One row of each text, and those of loose components with several texts dealt to blocks.
    once = own.groupBy("text_hash", "id").agg(F.min("doc_id").alias("doc_id"), F.greatest(F.max("n"), F.lit(LEAST)).alias("n"))
    texts = written(once.join(part, once.id == part.node, "left").select("text_hash", "doc_id", "n", F.coalesce("component", "id").alias("comp")), "texts")
    # Written, so that the join gets exchanges of its own, which Spark can split where a component is large.
    sizes = written(texts.groupBy("comp").agg(F.count("*").alias("m"), F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks")).where("m > 1").drop("m"), "sizes")
    loose = texts.join(sizes, "comp").select(F.col("text_hash").alias("_h"), F.col("doc_id").alias("_d"), "comp", "blocks", F.pmod(F.xxhash64("text_hash"), "blocks").cast("int").alias("b"))
    loose = written(loose, "loose")
    full = docs.join(loose, (F.col("text_hash") == F.col("_h")) & F.col("doc_id").eqNullSafe(F.col("_d"))).select("text_hash", "comp", "b", "blocks", "text")
    if own.groupBy("doc_id", "text_hash").count().where("count > 1").limit(1).count():
        full = full.dropDuplicates(["text_hash"])  # rows repeated in full
    sets = full.mapInArrow(_sets, "text_hash long, comp long, b int, blocks int, data binary").withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key = ["comp", "lo", "hi"]
    pairs = sets.select("comp", F.least("b", "x").alias("lo"), F.greatest("b", "x").alias("hi"), "b", "text_hash", "data").repartition(*key).sortWithinPartitions(*key)
    alike = components(pairs.mapInArrow(_alike, "u long, v long"))
    return own.join(alike, own.text_hash == alike.node, "left").select("doc_id", "text_hash", F.coalesce("component", "text_hash").alias("group"))


def without_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` but for near copies: of each group the row of the least (doc_id, text digest)
    stays, once. Null doc_ids come last. Columns stay as they are."""
    docs, back = shielded(docs, "_h", "_d", "_t")
    with scratch() as keep:
        own = written(near_groups(docs.select("doc_id", "text")), "groups")
        rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
        # Written, so that the join gets exchanges of its own, which Spark can split where a group is large.
        first = written(own.groupBy("group").agg(F.min(rank).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "first")
        gone = keep(written(own.join(first, "group").where(rank != F.col("first")).select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t")).distinct(), "gone"))
        repeated = own.groupBy("doc_id", "text_hash").count().where("count > 1").limit(1).count() > 0
    keyed = docs.withColumn("_h", F.xxhash64("text"))
    kept = keyed.join(gone, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_h") == F.col("_t")), "left_anti")
    if repeated:
        kept = kept.dropDuplicates(["doc_id", "_h"])  # rows repeated in full
    return kept.drop("_h").withColumnsRenamed(back)
