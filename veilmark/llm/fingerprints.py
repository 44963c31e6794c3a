"""Document fingerprints from closed syncmers.

A k-mer of code points is chosen when the smallest (by a fixed hash) of its inner s-mers is its
first or its last. The choice depends on the k-mer alone, so the same passage yields the same
anchors wherever it stands, and the anchors of a spliced text are those of its pieces plus the few
that cross the seam; ``edited_fingerprints`` uses just that.

The fingerprint of a text is the 32-bit hashes of its anchors in text order, eight hexadecimal
digits each. A text without any anchor (shorter than k, mostly) has one hash of the whole; the empty
text has the empty string. Likeness is the Jaccard index of two anchor sets, 1 for equal texts.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.llm.common import by_ranges, parts_for

K, S = 40, 8
_B = np.uint64(0x9E3779B97F4A7C15)
_M = np.uint64(0xD6E8FEB86659FD93)
#: Code points worked on at once, so that numpy's arrays stay small.
CHUNK = 1_000_000
#: Ranges of doc_id at most.
RANGES = 100_000


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _M
    h ^= h >> np.uint64(29)
    return h


def _pow(n: int) -> np.uint64:
    return np.uint64(pow(int(_B), n, 1 << 64))


def anchors(texts: list[str], k: int = K, s: int = S) -> list[tuple[np.ndarray, np.ndarray]]:
    """Start positions and 32-bit hashes of each text's closed syncmers, in text order.

    k has to be a multiple of s, and s a power of two."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lens)
    n = int(ends[-1]) if len(texts) else 0
    if n < k:
        return [(np.empty(0, np.int64), np.empty(0, np.uint32))] * len(texts)
    h = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    h = h * _M
    step = 1
    while step < s:
        h = h[:-step] * _pow(step) + h[step:]
        step *= 2
    z, w = _mix(h), k - s + 1
    low, have = z, 1
    while have < w:
        by = min(have, w - have)
        low = np.minimum(low[:-by], low[by:])
        have += by
    at = np.flatnonzero((z[: len(low)] == low) | (z[w - 1 :] == low))
    owner = np.searchsorted(ends, at, side="right")
    inside = at + k <= ends[owner]
    at, owner = at[inside], owner[inside]
    whole = h[at]
    for j in range(s, k, s):
        whole = whole * _pow(s) + h[at + j]
    hashes = (_mix(whole) >> np.uint64(32)).astype(np.uint32)
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    first = ends - lens
    return [(at[a:b] - first[i], hashes[a:b]) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]))]


def _or_whole(hashes: np.ndarray, text: str) -> np.ndarray:
    if len(hashes) or not text:
        return hashes
    return np.array([zlib.crc32(text.encode())], np.uint32)


def as_string(hashes: np.ndarray) -> str:
    return hashes.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard index of two sorted sets of anchors; two empty ones are alike."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _pairs(texts: list[str]) -> Iterator[tuple]:
    """Each text but the last with the one that follows it."""
    k = K
    own = anchors(texts)
    whole = [_or_whole(h, t) for (_, h), t in zip(own, texts)]
    sets = [np.unique(h) for h in whole]
    keep = [len(t) - len(t) // 2 for t in texts[:-1]]
    take = [min(len(t) // 2, len(x)) for t, x in zip(texts, texts[1:])]
    seams = anchors([t[max(0, a - k + 1) : a] + x[: min(k - 1, b)] for t, x, a, b in zip(texts, texts[1:], keep, take)])
    for i, (a, b) in enumerate(zip(keep, take)):
        edited = texts[i][:a] + texts[i + 1][:b]
        (p, h), (q, g) = own[i], own[i + 1]
        e = np.concatenate([h[: np.searchsorted(p, a - k, side="right")], seams[i][1], g[: np.searchsorted(q, b - k, side="right")]])
        e = _or_whole(e, edited)
        yield len(texts[i]), hashlib.sha256(edited.encode()).hexdigest(), as_string(whole[i]), as_string(e), likeness(sets[i], np.unique(e)), likeness(sets[i], sets[i + 1])


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_anchors long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("n_anchors", pa.int64())])


def _edited(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []  # (doc_id, text, is it only looked at)

    def out(rows: list[tuple]) -> pa.RecordBatch:
        n = sum(not r[2] for r in rows[:-1])
        made = [(r[0], *x, len(x[2]) // 8) for r, x in zip(rows[:n], _pairs([r[1] for r in rows[: n + 1]]))]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), _ARROW)], schema=_ARROW)

    size = 0
    for batch in it:
        for row in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), batch["tail"].to_pylist()):
            if row[2] and held and held[-1][2]:
                continue  # repeated rows of the neighbour's first document: the smallest text counts
            held.append(row)
            size += len(row[1])
            if size > CHUNK and len(held) > 1:
                if not held[0][2]:
                    yield out(held)
                held, size = held[-1:], len(held[-1][1])
    if len(held) > 1 and not held[0][2]:
        yield out(held)


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and their likeness.

    The edited text: the last floor(n/2) code points are replaced by the first as many (or all) of
    the next document in order of (doc_id, text); the last document is followed by the first.

    Documents are dealt once, by ranges of doc_id; a range's task also gets the first document of
    the next range, so nothing is joined and no order is computed in one task.

    Null text: as empty. Null doc_id: before all others, kept as null. Repeated rows: each gives a
    row. Empty table: no rows. A single document is its own neighbour. Extra columns are ignored."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    key = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    # A task reads its range in stretches, so ranges may grow; what is broadcast is two numbers for each.
    n = min(RANGES, parts_for(spark, rows.agg(F.sum(F.octet_length("text"))).first()[0], 24 << 20))
    ranges, n = by_ranges(rows, key, n)
    rows = rows.withColumn("b", ranges)
    first = rows.groupBy("b").agg(F.min(key).alias("k"))
    before = first.join(_previous(first), "b").select("k", "to")
    tails = rows.join(F.broadcast(before), key == F.col("k")).select("doc_id", "text", F.col("to").alias("b"), F.lit(1).alias("tail"))
    dealt = rows.select("doc_id", "text", "b", F.lit(0).alias("tail")).unionByName(tails)
    dealt = dealt.repartitionById(n, F.col("b")).sortWithinPartitions("tail", F.col("doc_id").asc_nulls_first(), "text")
    return dealt.select("doc_id", "text", "tail").mapInArrow(_edited, EDITED)


def _previous(first: DataFrame) -> DataFrame:
    """For each range with rows, the range that precedes it; the last precedes the first."""
    spark = first.sparkSession
    b = sorted(r[0] for r in first.select("b").collect())  # as many as there are ranges
    return F.broadcast(spark.createDataFrame([(x, b[i - 1]) for i, x in enumerate(b)], "b int, to int"))


def _own(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        ids, texts, at = batch["doc_id"].to_pylist(), batch["text"].to_pylist(), 0
        while at < len(texts):
            to, size = at + 1, len(texts[at])
            while to < len(texts) and size + len(texts[to]) <= CHUNK:
                size += len(texts[to])
                to += 1
            found = anchors(texts[at:to])
            whole = [_or_whole(h, t) for (_, h), t in zip(found, texts[at:to])]
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids[at:to], pa.int64()), "fingerprint": [as_string(h) for h in whole], "positions": pa.array([p.tolist() for p, _ in found], pa.list_(pa.int64()))})
            at = to


def fingerprints(docs: DataFrame) -> DataFrame:
    """The general operator: fingerprint and anchor positions (code points) of each document.

    Null text: as empty, with the empty fingerprint. Rows stay as many as they were."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(_own, "doc_id long, fingerprint string, positions array<long>")
