"""SimHash near-dedup by meeting in the middle.

A fingerprint has 64 bits; bit i is set if it is set in over half of the XXH64 digests (seed 42) of
the text's word shingles, repeats included. Two fingerprints that differ in at most 4 bits both lie
within 2 bits of some third value. So each distinct fingerprint stands for all 2081 values within 2
bits; equal values meet in a bucket, and whatever meets is linked.

Buckets are syndromes: a fixed linear map of the 64 bits. Flipping bits moves a value by the
syndromes of those bits, so which variants of a fingerprint fall in a bucket follows from the
fingerprint. It is sent once to each bucket that gets any of them, and the variants are made there:
the shuffle carries fingerprints, not variants. And a dense ball of near copies spreads over all
buckets evenly, however many fingerprints it holds.

A bucket sends on the components of what met in it, one link for each member at most, and no list of
pairs; then components are joined over all buckets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.llm.common import scratch, written
from veilmark.llm.components import components, local_components

#: Variants in a bucket, on average.
BUCKET = 4 << 20
RADIUS = 4
MASKS = np.array([0] + [sum(1 << i for i in c) for k in range(1, RADIUS // 2 + 1) for c in combinations(range(64), k)], np.uint64)


def simhash(text: str | None, words: int) -> int:
    """Signed, as Spark has it. Words are runs of other than ASCII white space, A-Z lower-cased."""
    own = (text or "").encode().lower().split()
    if not own:
        return 0
    whole = b" ".join(own)
    if len(own) < words:
        hashes = [xxhash.xxh64_intdigest(whole, 42)]
    else:
        stops = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1) - 1
        starts = np.concatenate([[0], stops[:-1] + 1])[: len(own) - words + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(whole[a:z], 42) for a, z in zip(starts, stops[words - 1 :].tolist())]
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(hashes), bitorder="little").view("<i8")[0])


def _hashed(words: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text_hash"], pa.array([simhash(t, words) for t in batch["text"].to_pylist()], pa.int64())], ["doc_id", "text_hash", "fp"])

    return run


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id, text_hash (XXH64 of the text) and fp (long). A text of fewer words: one shingle; of none, or
    null: zero."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(_hashed(words), "doc_id long, text_hash long, fp long")


def _rows(bits: int) -> np.ndarray:
    """The map to syndromes: which bits each bit of the syndrome sums up, modulo 2."""
    return np.random.default_rng(64).integers(0, 1 << 63, bits, np.uint64) * np.uint64(2) + np.random.default_rng(65).integers(0, 2, bits, np.uint64)


def _syndrome(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), np.int64)
    for i, r in enumerate(rows):
        out |= (np.bitwise_count(x & r) & 1).astype(np.int64) << i
    return out


def _dealt(bits: int):
    rows = _rows(bits)
    moves = np.unique(_syndrome(MASKS, rows))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            fp = batch["fp"].to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fp), 1 + (1 << 22) // len(moves)):
                some = fp[at : at + 1 + (1 << 22) // len(moves)]
                to = (_syndrome(some, rows)[:, None] ^ moves).ravel()
                order = np.argsort(to, kind="stable")
                cuts = np.flatnonzero(np.diff(to[order])) + 1
                blobs = np.split(np.repeat(some, len(moves))[order], cuts)
                which = to[order][np.concatenate([[0], cuts])] if len(order) else []
                yield pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array([b.tobytes() for b in blobs] if len(order) else [], pa.binary())], ["bucket", "data"])

    return run


def _linked(bits: int):
    rows = _rows(bits)
    of = _syndrome(MASKS, rows)
    masks = {s: MASKS[of == s] for s in np.unique(of).tolist()}

    def key(v: np.ndarray, width: np.uint64) -> np.ndarray:
        return (v * np.uint64(0x9E3779B97F4A7C15)) >> width << width

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
            fp = np.unique(np.frombuffer(b"".join(blobs), np.uint64))
            width = np.uint64(max(1, len(fp).bit_length()))
            own = _syndrome(fp, rows)
            made = []
            for s in np.unique(own).tolist():
                if (m := masks.get(s ^ bucket)) is not None:
                    i = np.flatnonzero(own == s).astype(np.uint64)
                    made.append((key(fp[i.astype(np.int64)][:, None] ^ m, width) | i[:, None]).ravel())
            # A variant's digest above, the number of its fingerprint below: one sort brings equals together.
            all_ = np.sort(np.concatenate(made)) if made else np.empty(0, np.uint64)
            i, top = (all_ & ((np.uint64(1) << width) - np.uint64(1))).astype(np.int64), all_ >> width
            at = np.flatnonzero(top[1:] == top[:-1])
            u, v = i[at], i[at + 1]
            near = np.bitwise_count(fp[u] ^ fp[v]) <= RADIUS
            lost = np.unique(top[at[~near]])  # two variants with one digest: told apart by the variants
            pairs = [np.unique((u[near].astype(np.int64) * len(fp)) + v[near])]
            for t in lost.tolist():
                a, z = np.searchsorted(top, [np.uint64(t), np.uint64(t + 1)])
                by: dict[int, list[int]] = {}
                for j in i[a:z].tolist():
                    m = masks[int(own[j]) ^ bucket]
                    for x in (fp[j] ^ m)[key(fp[j] ^ m, width) >> width == np.uint64(t)].tolist():
                        by.setdefault(x, []).append(j)
                pairs.append(np.array([x * len(fp) + y for g in by.values() for x, y in zip(g, g[1:])], np.int64))
            both = np.concatenate(pairs)
            label = local_components(len(fp), both // max(1, len(fp)), both % max(1, len(fp)))
            tied = np.flatnonzero(label != np.arange(len(fp)))
            yield pa.RecordBatch.from_arrays([pa.array(fp[tied].view(np.int64)), pa.array(fp[label[tied]].view(np.int64))], ["u", "v"])

    return run


def linked_fingerprints(fps: DataFrame) -> DataFrame:
    """``fps``: fp (long), distinct. Links u, v whose components are those of all pairs within 4 bits."""
    n = fps.count()
    bits = max(4, int(np.ceil(np.log2(max(1.0, n * len(MASKS) / BUCKET)))))
    dealt = fps.mapInArrow(_dealt(bits), "bucket int, data binary").repartitionById(1 << bits, F.col("bucket")).sortWithinPartitions("bucket")
    return dealt.mapInArrow(_linked(bits), "u long, v long")


def groups(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id, text_hash, fp, group (the least fingerprint of the component) and component_id: the smallest
    doc_id that links within 4 bits reach.

    A row for each row of ``docs``. Null or blank text: fingerprint zero, linked like any other. Null
    doc_id: stays null and names no component unless nothing else does. Empty table: no rows."""
    with scratch() as keep:
        own = keep(written(fingerprints(docs, words), "simhash"))
        fps = written(own.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
        part = components(linked_fingerprints(fps.select("fp")))
        least = fps.join(part, fps.fp == part.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("group"))
        named = least.groupBy("group").agg(F.min("first").alias("component_id"))
        groups = keep(written(least.select("fp", "group").join(named, "group"), "named"))
    return own.join(groups, "fp").select("doc_id", "text_hash", "fp", "group", "component_id")
