"""Substring dedup by hashing units: lines, split further at sentence ends.

Units are normalised (A-Z lower-cased, runs of ASCII white space to one space, trimmed) and known by
a 128-bit digest. Digests are grouped over the whole corpus; the earliest occurrence by (doc_id,
start) stays and the others go, each with the separator that follows it. Spans are offsets of code
points in the original text.

Sentences are units of their own because a passage may be set into the middle of a line. Units of
fewer than ``min_words`` words stay: short sentences repeat in texts that copy nothing. Short lines that
repeat are ``line_runs``'s to delete. With ``runs`` short units count with those that follow (``passages``); the
query does without, as its SQL does.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.llm.common import scratch, written

#: One code point for one, so that offsets stay those of the text.
SENTENCE = re.compile(r"([.!?]) ")
MIN_WORDS = 12
NO_ID = -(2**63)


def units(text: str, min_words: int = MIN_WORDS) -> Iterator[tuple[int, int, int, int]]:
    """Digest (two signed numbers), start and stop of each unit that counts."""
    start = 0
    for unit in SENTENCE.sub("\\1\n", text).split("\n"):
        stop = start + len(unit)
        words = unit.encode().lower().split()
        if len(words) >= min_words:
            d = hashlib.md5(b" ".join(words)).digest()
            yield int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True), start, stop
        start = stop + 1


def passages(text: str, min_words: int = MIN_WORDS) -> Iterator[tuple[int, int, int, int]]:
    """Digest, start and stop of each passage: from each unit on, the fewest units in a row that hold ``min_words`` words
    or more. Units without words lie between others and do not count."""
    own: list[tuple[int, int, list[bytes]]] = []
    start = 0
    for unit in SENTENCE.sub("\\1\n", text).split("\n"):
        if words := unit.encode().lower().split():
            own.append((start, start + len(unit), words))
        start += len(unit) + 1
    end = n = 0
    for i, (start, _, words) in enumerate(own):
        while n < min_words and end < len(own):
            n += len(own[end][2])
            end += 1
        if n < min_words:
            return
        d = hashlib.md5(b"\n".join(b" ".join(u[2]) for u in own[i:end])).digest()
        yield int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True), start, own[end - 1][1]
        n -= len(words)


_FOUND = pa.schema([("d1", pa.int64()), ("d2", pa.int64()), ("k", pa.int64()), ("h", pa.int64()), ("at", pa.int64()), ("more", pa.list_(pa.int64()))])


def _scan(parts: Callable[[str, int], Iterator[tuple[int, int, int, int]]], min_words: int):
    """Each distinct part of a document: where it is first, and where else."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _FOUND)], schema=_FOUND)

        cols: list[list] = [[] for _ in _FOUND]
        for batch in it:
            for k, h, text in zip(*(batch[c].to_pylist() for c in ("k", "h", "text"))):
                own: dict[tuple[int, int], list[int]] = {}
                for a, b, start, stop in parts(text, min_words):
                    own.setdefault((a, b), []).append(start << 32 | (stop - start))
                for (a, b), at in own.items():
                    for c, v in zip(cols, (a, b, k, h, at[0], at[1:])):
                        c.append(v)
                if len(cols[0]) > 100_000:
                    yield out()
                    cols = [[] for _ in _FOUND]
        if cols[0]:
            yield out()

    return run


_CUT = pa.schema([("doc_id", pa.int64()), ("n_units", pa.int64()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("kept", pa.string())])


def _cut(parts: Callable[[str, int], Iterator[tuple[int, int, int, int]]], min_words: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for batch in it:
            for doc, text, gone in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), batch["gone"].to_pylist()):
                gone = {(g["at"], g["d1"]) for g in gone or ()}
                n, spans, kept, at = 0, [], [], 0
                for d1, _, start, stop in parts(text, min_words):
                    n += 1
                    if (start << 32 | (stop - start), d1) not in gone:
                        continue
                    if start < at:  # passages overlap
                        spans[-1]["stop"] = stop
                    else:
                        spans.append({"start": start, "stop": stop})
                        kept.append(text[at:start])
                    at = stop + 1
                kept.append(text[at:])
                rows.append((doc, n, spans, "".join(kept)))
                size += len(text)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _CUT)], schema=_CUT)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _CUT)], schema=_CUT)

    return run


def without_repeated_units(docs: DataFrame, min_words: int = MIN_WORDS, runs: bool = False) -> DataFrame:
    """Per document: doc_id, n_units (that count), removed spans (start, stop) and the kept text.

    Null text: as empty. Null doc_id: before all others. Rows with one doc_id do not take units from each
    other; rows equal in doc_id and text get equal results. Empty table: no rows. Extra columns are ignored. A digest shared by any number of documents is
    one row once counted; its units meet it in a join that Spark can split.

    With ``runs`` passages take the place of units: short units go too where they repeat in a row. n_units is the number
    of passages then, removed spans that overlap are one, and in the document of the least id only those places go that
    do not overlap the first."""
    parts = passages if runs else units
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("k"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    found = rows.select("k", "h", "text").mapInArrow(_scan(parts, min_words), "d1 long, d2 long, k long, h long, at long, more array<long>")
    with scratch() as keep:
        repeated = written(found.groupBy("d1", "d2").agg(F.min("k").alias("k1"), F.count("*").alias("n")).where("n > 1").drop("n"), "repeated")
        # The document of the least id keeps the first of its places, any other none.
        again = F.filter("more", lambda x: F.shiftright(x, 32) >= F.shiftright("at", 32) + F.col("at").bitwiseAND(F.lit(0xFFFFFFFF))) if runs else F.col("more")
        later = found.join(repeated, ["d1", "d2"], "left").select("k", "h", "d1", F.when(F.col("k") > F.col("k1"), F.concat(F.array("at"), "more")).otherwise(again).alias("at"))
        later = keep(written(later.where(F.size("at") > 0).select("k", "h", F.explode("at").alias("at"), "d1").select("k", "h", F.struct("at", "d1").alias("g")), "later"))
    gone = later.groupBy("k", "h").agg(F.collect_set("g").alias("gone"))
    return rows.join(gone, ["k", "h"], "left").select("doc_id", "text", "gone").mapInArrow(_cut(parts, min_words), "doc_id long, n_units long, removed array<struct<start:long,stop:long>>, kept string")


#: The same in DuckDB's SQL, for the columns of the query.
ORACLE = f"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, string_split(regexp_replace(coalesce(text, ''), '([.!?]) ', '\\1' || chr(10), 'g'), chr(10)) AS u FROM documents
), listed AS (
  SELECT doc_id, text, unnest(u) AS unit, generate_subscripts(u, 1) AS i FROM cut
), placed AS (
  SELECT *, coalesce(sum(length(unit) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
    trim(regexp_replace(translate(unit, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\v\\f\\r]+', ' ', 'g'), ' ') AS norm
  FROM listed
), judged AS (
  SELECT *, norm <> '' AND length(norm) - length(replace(norm, ' ', '')) + 1 >= {MIN_WORDS} AS counts FROM placed
), ranked AS (
  SELECT *, counts AND row_number() OVER (PARTITION BY counts, md5(norm) ORDER BY doc_id, start) > 1 AS gone FROM judged
)
SELECT doc_id, count(*) FILTER (WHERE counts) AS n_units, count(*) FILTER (WHERE gone) AS n_removed,
  coalesce(string_agg(start || '-' || (start + length(unit)), ',' ORDER BY start) FILTER (WHERE gone), '') AS removed_spans,
  sha256(coalesce(string_agg(substr(any_text, start + 1, length(unit) + 1), '' ORDER BY start) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM (SELECT *, text AS any_text FROM ranked) GROUP BY doc_id
"""
