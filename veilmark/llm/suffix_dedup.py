"""Substring dedup: bytes that an earlier document holds within a string of 50 are removed.

The order of suffixes is built block by block over a difference cover, so that no task holds more
than one block of text or one bucket of suffixes:

* Chunks. Texts are cut where their content says so, every 64 bytes or so. A chunk with the 49 bytes
  that follow it fixes every string of 50 that starts in it. If an earlier document has it too, all
  of these are repeats, and their suffixes need no place in the order: the first copy stands for them.
* Cover sample of what remains. D is a difference cover modulo 31: for any two positions i, j there
  is a d < 31 with both i + d and j + d in the cover. Two equal strings of 50 bytes thus share a
  cover suffix at the same distance from their starts, and the first 20 bytes of that suffix lie
  inside both. Those prefixes get names, and names are compared across blocks, bucket by bucket.
* Suffix buckets. Only suffixes that start up to 30 bytes before a cover suffix with a shared name
  can start a repeat. These go to buckets by a digest of their first 50 bytes, and each bucket is
  sorted by itself. Suffixes are only told apart up to 50 bytes, so ties that go deeper need no
  further order: the first of a run in document order is the source, the others repeat it.

Documents are dealt to blocks by ranges of doc_id. An earlier block then holds smaller ids only, so
a bucket sends back one bit for each distinct suffix of a block (does an earlier block have it), and
suffixes carry neither document nor position. What repeats within a block is sent once, so copies of
a passage, however many, come to one suffix for each block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.llm.common import by_ranges, parts_for, written

#: A perfect difference set modulo 31.
COVER, MODULUS = (0, 1, 3, 8, 12, 18), 31
WINDOW = 50
NAMED = WINDOW - MODULUS + 1
#: Bytes of text in a block, and suffixes in a bucket.
BLOCK, BUCKET = 4 << 20, 4 << 20
_P = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _P[3]
    h ^= h >> np.uint64(29)
    h *= _P[1]
    h ^= h >> np.uint64(32)
    return h


class Block:
    """The documents of a block as one run of bytes, in order of (doc_id, text)."""

    def __init__(self, ids: list[int], texts: list[bytes]):
        self.ids, self.texts = ids, texts
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        self.ends = np.cumsum(lens)
        self.starts = self.ends - lens
        self.n = int(self.ends[-1]) if len(texts) else 0
        self.buffer = b"".join([*texts, bytes(64)])
        self.word = np.ndarray((self.n + 56,), "<u8", self.buffer, 0, (1,))
        # Equal ids count as one document.
        self.rank = np.cumsum(np.concatenate([[0], np.asarray(ids[1:], object) != np.asarray(ids[:-1], object)]).astype(np.int64)) if ids else np.empty(0, np.int64)

    def owner(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, at, side="right")

    def digest(self, at: np.ndarray, length: int) -> np.ndarray:
        h = np.full(len(at), np.uint64(length))
        for d in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
            h = _mix(h * _P[0] + self.word[at + d])
        return h

    def chunks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and documents of all chunks, and digests of two words each."""
        cut = np.flatnonzero(self.word[: self.n] * _P[0] >> np.uint64(58) == 0)
        cut = cut[cut + 8 <= self.ends[self.owner(cut)]]
        starts = np.union1d(cut, self.starts[self.starts < self.ends])
        ends = np.append(starts[1:], self.n)
        owner = self.owner(starts)
        stops = np.minimum(ends + WINDOW - 1, self.ends[owner])
        digest, view = xxhash.xxh3_128_digest, memoryview(self.buffer)
        made = b"".join([digest(view[a:z], c) for a, z, c in zip(starts.tolist(), stops.tolist(), (ends - starts).tolist())])
        return starts, ends, owner, np.frombuffer(made, np.uint64).reshape(-1, 2)

    def names(self, bits: int, remains: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cover positions that a remaining string of 50 can hold, their documents, and names: the
        bucket's number above 32 bits of digest."""
        before = np.concatenate([[0], np.cumsum(remains, dtype=np.int32)])
        at = (np.arange(0, self.n, MODULUS)[:, None] + np.array(COVER)).ravel()
        at = at[at + NAMED <= self.n]
        at = at[before[at + 1] > before[np.maximum(at - MODULUS + 1, 0)]]
        owner = self.owner(at)
        fits = at + NAMED <= self.ends[owner]
        at, owner = at[fits], owner[fits]
        h = self.digest(at, NAMED)
        return at, owner, ((h >> np.uint64(63 - bits) >> np.uint64(1)) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))


def _order(keys: np.ndarray) -> np.ndarray:
    """A stable order by key. Keys and places are packed into one number, as far as they fit, since plain
    sorts are quicker; if keys that differ agree in what fits, the order is found the plain way."""
    low = np.uint64(32 if keys.dtype == np.uint32 else len(keys).bit_length())
    top = keys.astype(np.uint64) << low if keys.dtype == np.uint32 else keys >> low << low
    packed = np.sort(top | np.arange(len(keys), dtype=np.uint64))
    order = (packed & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
    k, top = keys[order], packed >> low
    return np.argsort(keys, kind="stable") if ((k[1:] != k[:-1]) & (top[1:] == top[:-1])).any() else order


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A stable order by key, starts of the runs in it, and each element's run."""
    order = _order(keys)
    k = keys[order]
    new = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.empty(0, bool)
    run = np.empty(len(k), np.int64)
    run[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), run


class Sent:
    """The distinct suffixes of a block by bucket: what is sent, and what each answer bit is about."""

    def __init__(self, bucket: np.ndarray, value: np.ndarray, rank: np.ndarray, buckets: int):
        # Positions come in document order, and all sorts are stable: a run's first is its earliest.
        by = np.argsort(bucket.astype(np.uint16), kind="stable") if buckets <= 1 << 16 else np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[by], np.arange(buckets + 1))
        self.index = np.empty(len(value), np.int64)
        self.parts: list[np.ndarray] = []
        first, last, at = [], [], 0
        for a, b in zip(cuts[:-1], cuts[1:]):
            own = by[a:b]
            order, starts, run = _groups(value[own])
            self.index[own] = run + at
            self.parts.append(value[own][order[starts]])
            first.append(rank[own[order[starts]]])
            last.append(rank[own[order[np.append(starts[1:], len(own)) - 1]]] if len(own) else rank[:0])
            at += len(starts)
        self.first, self.last = np.concatenate(first), np.concatenate(last)

    def answers(self, masks: dict[int, bytes]) -> np.ndarray:
        """For each suffix: the bit its bucket sent back."""
        bits = [np.unpackbits(np.frombuffer(masks[i], np.uint8), count=len(p)).astype(bool) if len(p) else np.empty(0, bool) for i, p in enumerate(self.parts)]
        return np.concatenate(bits)[self.index] if bits else np.empty(0, bool)


def _bucket(h: np.ndarray, bits: int) -> np.ndarray:
    return h >> np.uint64(63 - bits) >> np.uint64(1)


def _chunked(block: Block, bits: int) -> tuple[tuple, Sent]:
    starts, ends, owner, digest = block.chunks()
    return (starts, ends, owner), Sent(_bucket(digest[:, 0], bits), digest[:, 1], block.rank[owner], 1 << bits)


def _repeats(block: Block, bits: int, masks: dict[int, bytes]) -> np.ndarray:
    """For each byte: does a string of 50 start here that a chunk of an earlier document has?"""
    (starts, ends, owner), sent = _chunked(block, bits)
    known = sent.answers(masks) | (sent.first[sent.index] < block.rank[owner])
    out = np.repeat(known, ends - starts)
    return out


def _whole(block: Block) -> np.ndarray:
    """For each byte: does a string of 50 start here at all?"""
    lens = block.ends - block.starts
    some = np.maximum(lens - WINDOW + 1, 0)
    return np.repeat(np.tile([True, False], len(lens)), np.stack([some, lens - some], 1).ravel())


def _named(block: Block, bits: int, remains: np.ndarray) -> tuple[np.ndarray, Sent]:
    at, owner, name = block.names(bits, remains)
    return at, Sent(name >> np.uint64(32), name.astype(np.uint32), block.rank[owner], 1 << bits)


def _candidates(block: Block, bits: list[int], remains: np.ndarray, masks: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray, Sent]:
    """Starts of all remaining strings of 50 bytes that may repeat, and what is sent about them."""
    at, names = _named(block, bits[1], remains)
    shared = names.answers(masks) | (names.first != names.last)[names.index]
    at = at[shared]
    edge = np.bincount(np.maximum(at - MODULUS + 1, 0), minlength=block.n + 1)[: block.n + 1] - np.bincount(at + 1, minlength=block.n + 1)[: block.n + 1]
    start = np.flatnonzero((np.cumsum(edge[: block.n]) > 0) & remains)
    owner = block.owner(start)
    h = block.digest(start, WINDOW)
    other = _mix(h * _P[2] + block.word[start] * _P[0] + block.word[start + WINDOW - 8])
    return start, owner, Sent(_bucket(other, bits[2]), h, block.rank[owner], 1 << bits[2])


def _blocks(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Block, dict[int, dict[int, bytes]]]]:
    """A partition is a block: answers first (by step and bucket), then documents."""
    ids, texts, masks, b = [], [], {1: {}, 2: {}, 3: {}}, -1
    for batch in it:
        for kind, at, bucket, doc, data in zip(*(batch[c].to_pylist() for c in ("kind", "b", "bucket", "doc_id", "data"))):
            b = at
            if kind:
                masks[kind][bucket] = data
            else:
                ids.append(doc)
                texts.append(data)
    if ids:
        yield b, Block(ids, texts), masks


_SENT = pa.schema([("bucket", pa.int32()), ("b", pa.int32()), ("data", pa.binary())])


def _send(b: int, sent: Sent) -> Iterator[pa.RecordBatch]:
    for i, p in enumerate(sent.parts):
        if len(p):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([b], pa.int32()), pa.array([p.tobytes()], pa.binary())], schema=_SENT)


def _compared(step: int):
    """One bucket: for each block's entries, is it in any other block (names), in an earlier one (else)?"""
    dtype = np.uint32 if step == 2 else np.uint64

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in it:
            for i, b, data in zip(*(batch[c].to_pylist() for c in ("bucket", "b", "data"))):
                if held and i not in held:  # sorted by bucket: one bucket is held at a time
                    yield from done(held)
                    held = {}
                held.setdefault(i, []).append((b, data))
        yield from done(held)

    def done(held: dict[int, list]) -> Iterator[pa.RecordBatch]:
        for i, rows in held.items():
            rows.sort(key=lambda r: r[0])
            values = [np.frombuffer(d, dtype) for _, d in rows]
            order, starts, run_of = _groups(np.concatenate(values))
            if step == 2:
                bit = np.diff(np.append(starts, len(order)))[run_of] > 1
            else:
                bit = np.ones(len(order), bool)
                bit[order[starts]] = False
            cuts = np.cumsum([len(v) for v in values])
            for (b, _), x in zip(rows, np.split(bit, cuts[:-1])):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([b], pa.int32()), pa.array([np.packbits(x).tobytes()], pa.binary())], schema=_SENT)

    return run


_KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("kept", pa.binary())])


def _cut(block: Block, at: np.ndarray) -> Iterator[pa.RecordBatch]:
    gone = np.cumsum(np.bincount(at, minlength=block.n + 1) - np.bincount(at + WINDOW, minlength=block.n + 1)[: block.n + 1])[: block.n] > 0
    rows: list[tuple] = []
    size = 0
    for doc, text, a, z in zip(block.ids, block.texts, block.starts.tolist(), block.ends.tolist()):
        own = gone[a:z]
        if not own.any():
            rows.append((doc, len(text), [], text))
        else:
            edge = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8)))
            rows.append((doc, len(text), [{"start": x, "stop": y} for x, y in edge.reshape(-1, 2).tolist()], np.frombuffer(text, np.uint8)[~own].tobytes()))
        size += len(text)
        if size > 4 << 20 or z == block.n and doc is block.ids[-1]:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _KEPT)], schema=_KEPT)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _KEPT)], schema=_KEPT)


def without_repeats(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_bytes, the removed byte spans (start, stop) and the kept bytes.

    A byte goes when some string of 50 bytes that covers it also starts in a document with a smaller
    doc_id; overlaps count, and all strings are judged on the input. The result is exact but for
    64-bit digests of strings that share a bucket.

    Null text: as empty. Null doc_id: before all others. Repeated doc_ids: one document to others, and
    no row removes bytes of another. Texts under 50 bytes: kept. Empty table: no rows. Extra
    columns are ignored."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("data"))
    key = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    size = rows.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    b, n = by_ranges(rows, key, parts_for(spark, size, BLOCK))
    texts = rows.select(F.lit(0).alias("kind"), b.alias("b"), F.lit(0).alias("bucket"), "doc_id", "data")

    # Buckets of chunks, names and suffixes, each of a bounded number of entries.
    bits = [max(4, int(np.ceil(np.log2(max(1.0, size * share / BUCKET))))) for share in (1 / 64, len(COVER) / MODULUS, 1)]

    def blocks(*answers: DataFrame) -> DataFrame:
        all_rows = texts
        for kind, x in enumerate(answers, 1):
            all_rows = all_rows.unionByName(x.select(F.lit(kind).alias("kind"), "b", "bucket", F.lit(None).cast("long").alias("doc_id"), "data"))
        return all_rows.repartitionById(n, F.col("b")).sortWithinPartitions(F.col("kind").desc(), F.col("doc_id").asc_nulls_first(), "data")

    def answered(sent: DataFrame, step: int, width: int) -> DataFrame:
        dealt = sent.repartitionById(1 << width, F.col("bucket")).sortWithinPartitions("bucket", "b")
        return written(dealt.mapInArrow(_compared(step), "bucket int, b int, data binary"), f"answers{step}")

    def remains(block, masks):
        return _whole(block) & ~_repeats(block, bits[0], masks[1])

    def chunk(it):
        for at, block, _ in _blocks(it):
            yield from _send(at, _chunked(block, bits[0])[1])

    def name(it):
        for at, block, masks in _blocks(it):
            yield from _send(at, _named(block, bits[1], remains(block, masks))[1])

    def suffix(it):
        for at, block, masks in _blocks(it):
            yield from _send(at, _candidates(block, bits, remains(block, masks), masks[2])[2])

    def cut(it):
        for _, block, masks in _blocks(it):
            left = remains(block, masks)
            start, owner, sent = _candidates(block, bits, left, masks[2])
            later = sent.answers(masks[3]) | (sent.first[sent.index] < block.rank[owner])
            yield from _cut(block, np.concatenate([np.flatnonzero(_whole(block) & ~left), start[later]]))

    sent = "bucket int, b int, data binary"
    one = answered(blocks().mapInArrow(chunk, sent), 1, bits[0])
    two = answered(blocks(one).mapInArrow(name, sent), 2, bits[1])
    three = answered(blocks(one, two).mapInArrow(suffix, sent), 3, bits[2])
    return blocks(one, two, three).mapInArrow(cut, "doc_id long, n_bytes long, removed array<struct<start:long,stop:long>>, kept binary")
