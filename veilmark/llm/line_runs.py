"""Line dedup: repeated runs of lines, by a suffix array over sequences of line ids.

Each document is a sequence of line ids (a line is its text without white space at both ends; blank
lines do not count). The suffixes of all sequences are ranked by prefix doubling: by their first line, and
then, round after round, by the pair of ranks of a suffix and of the one 2^a lines on, in sorted order over
ranges. The rank of a suffix is the place in the suffix array where its class starts, the class being the
suffixes with the same first 2^a lines; and a class of n suffixes is the interval of places [rank, rank + n) in
which neighbours have a longest common prefix of 2^a lines or more. An interval of any other depth is
where two of these overlap: the same first 2^a and the same last 2^a lines.

A suffix whose interval holds nothing else leaves, as no longer run of it can repeat; so rounds work on
what repeats and not on the corpus, and go only as deep as a run has to be. A run repeats if it has
``min_words`` words at least. Every maximal repeated run is the union of runs that just reach this number,
forward from each of its lines and backward from each; so intervals of these depths are enough. Each keeps
the copy that is first in the corpus; the lines of the others are deleted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilmark.llm.common import discard, running, scratch, shielded, written

MIN_WORDS = 5
NO_ID = -(2**63)


def lines(text: str) -> list[tuple[int, bytes]]:
    """Number (of all lines) and content of each line that counts."""
    return [(i, b) for i, line in enumerate(text.split("\n")) if (b := line.encode().strip())]


def runs(words: list[int], least: int) -> list[set[int]]:
    """For each start: the lengths of the runs that just reach ``least`` words from one end."""
    out: list[set[int]] = [set() for _ in words]
    i, total = 0, 0
    for j, w in enumerate(words):  # forward: [i, j] reaches it, [i, j) does not
        total += w
        while total >= least:
            out[i].add(j - i + 1)
            total -= words[i]
            i += 1
    i, total = 0, 0
    for j, w in enumerate(words):  # backward: [i, j] reaches it, (i, j] does not
        total += w
        while total - words[i] >= least:
            total -= words[i]
            i += 1
        if total >= least:
            out[i].add(j - i + 1)
    return out


_SCAN = pa.schema([("d1", pa.int64()), ("d2", pa.int64()), ("k", pa.int64()), ("h", pa.int64()), ("i", pa.int32()), ("w", pa.list_(pa.int32()))])


def _scan(least: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols: list[list] = [[] for _ in _SCAN]
        for batch in it:
            for k, h, text in zip(*(batch[c].to_pylist() for c in ("k", "h", "text"))):
                own = lines(text)
                for i, ((_, b), w) in enumerate(zip(own, runs([len(b.split()) for _, b in own], least))):
                    d = hashlib.md5(b).digest()
                    for c, v in zip(cols, (int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True), k, h, i, sorted(w))):
                        c.append(v)
                if len(cols[0]) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _SCAN)], schema=_SCAN)
                    cols = [[] for _ in _SCAN]
        if cols[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _SCAN)], schema=_SCAN)

    return run


_CUT = pa.schema([("n_lines", pa.int64()), ("removed", pa.list_(pa.int32())), ("kept", pa.string())])


def _cut(keep: list[str]):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            made: list[tuple] = []
            for text, gone in zip(batch["_text"].to_pylist(), batch["_gone"].to_pylist()):
                own = lines(text)
                at = {own[j][0] for a, w in gone or () for j in range(a, a + w)} if gone else set()
                made.append((len(own), sorted(at), "\n".join(x for i, x in enumerate(text.split("\n")) if i not in at) if at else text))
            cols = list(zip(*made)) if made else [(), (), ()]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), *(pa.array(c, f.type) for c, f in zip(cols, _CUT))], [*keep, *_CUT.names])

    return run


def intervals(suffixes: DataFrame, key: list[str], rank: str) -> DataFrame:
    """The intervals of the suffix array that hold several suffixes, by key in sorted order: the key and the place at
    which each starts. Written, so that a join with them gets exchanges of its own, which Spark can split where an
    interval is long."""
    sizes = suffixes.groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 1")
    return written(running(sizes, [F.col(c) for c in key], "intervals", **{rank: F.col("_n")}).select(*key, rank), "ranks")


def without_repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of ``docs`` with three columns more: n_lines (that count), removed (numbers of the
    deleted lines, from 0) and kept (the text without them).

    Copies are ordered by (doc_id, digest of the text, line). Null text: as empty, kept as null text.
    Null doc_id: before all others. Rows equal in doc_id and text are one document. Overlapping
    copies within a document: later lines go. Empty table: no rows. Columns of ``docs`` that bear
    the new names are replaced."""
    docs, back = shielded(docs.drop("n_lines", "removed", "kept"), "_k", "_h", "_text", "_gone")
    rows = docs.select("*", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_k"), F.xxhash64("text").alias("_h"), F.coalesce("text", F.lit("")).alias("_text"))
    seq = rows.select(F.col("_k").alias("k"), F.col("_h").alias("h"), F.col("_text").alias("text")).mapInArrow(_scan(min_words), "d1 long, d2 long, k long, h long, i int, w array<int>")
    with scratch() as keep:
        place = F.struct("k", "h", "i")
        # Depth 1: a line that occurs once is in no repeated run.
        ids = intervals(seq, ["d1", "d2"], "r0")
        live = written(seq.join(ids, ["d1", "d2"]).select("k", "h", "i", "w", "r0").distinct(), "round")
        discard(ids)  # as soon as may be, for less disk
        top = live.agg(F.max(F.array_max("w"))).first()[0] or 1
        for a in range(1, top.bit_length()):
            by = Window.partitionBy("k", "h").orderBy("i").rangeBetween(1 << (a - 1), 1 << (a - 1))
            pairs = live.withColumn("r", F.first(f"r{a - 1}").over(by))
            ranks = intervals(pairs.where(f"r{a - 1} is not null and r is not null"), [f"r{a - 1}", "r"], f"r{a}")
            before, live = live, written(pairs.join(ranks, [f"r{a - 1}", "r"], "left").drop("r"), "round")
            discard(before)
            discard(ranks)
        level = F.floor(F.log2("w")).cast("int")
        rank = F.coalesce(*(F.when(F.col("a") == a, F.col(f"r{a}")) for a in range(top.bit_length()))) if top > 1 else F.col("r0")
        starts = live.withColumn("w", F.explode("w")).withColumn("a", level).withColumn("p", rank).where("p is not null")
        ends = live.select("k", "h", F.col("i").alias("j"), F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.col(f"r{a}").alias("q")) for a in range(top.bit_length())))).alias("x")).select("k", "h", "j", "x.*").where("q is not null")
        both = starts.withColumn("j", F.expr("cast(i + w - shiftleft(1, a) as int)")).select("k", "h", "i", "w", "a", "j", "p").join(ends, ["k", "h", "j", "a"])
        both = written(both.select("k", "h", "i", "w", "p", "q"), "runs")
        discard(live)
        first = written(both.groupBy("w", "p", "q").agg(F.min(place).alias("f"), F.count("*").alias("n")).where("n > 1").drop("n"), "first")
        later = keep(written(both.join(first, ["w", "p", "q"]).where(place > F.col("f")).select("k", "h", "i", "w"), "later"))
    gone = later.groupBy("k", "h").agg(F.collect_set(F.array("i", "w")).alias("_gone")).withColumnsRenamed({"k": "_k", "h": "_h"})
    keep = docs.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "n_lines long, removed array<int>, kept string"])
    return rows.join(gone, ["_k", "_h"], "left").select(*docs.columns, "_text", "_gone").mapInArrow(_cut(keep), schema).withColumnsRenamed(back)
