"""Benchmark decontamination by a prefix-filtered set join. DataFrames only, no Python on the way.

An item's windows are its runs of ``window`` words. A window is a set of shingles of five words, and to
occur in a document it needs them all; so one shingle is a sufficient prefix: the rarest over all
documents, in the order of document counts. A window with a shingle that no document has is out.
Documents meet windows on that one shingle; position and length bounds drop windows that would start
before the document or run beyond it; and each survivor is compared word for word with the document.

A document's shingles are first looked up in a map of bits of all item shingles, two of 16 bits for each, up
to ``LONGS`` longs (a million shingles; beyond, more of the others get through to the join); the few that remain take along the words around them, so that the comparison needs
no second look at the text, and no text is shuffled. Item shingles are broadcast only if they are
``BROADCAST`` at most, by count; beyond that they are joined by shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmark.llm.common import lower_ascii, scratch, shielded, written

WINDOW, SHINGLE = 10, 5
#: Of 8 bytes each, with as much again for the hash table.
BROADCAST = 500_000
#: Of the map at most. One in 70 of the shingles that no item has gets through to the join.
LONGS = 1 << 18
NO_ID = -(2**63)
_GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words_of(text: Column | str) -> Column:
    """Runs of digits, letters a-z (A-Z lower-cased) and whatever is not ASCII; null: none."""
    plain = F.octet_length(text) == F.char_length(text)
    low = F.when(plain, F.lower(text)).otherwise(lower_ascii(text))  # `lower` is quick, and right for ASCII
    return F.array_remove(F.split(F.coalesce(low, F.lit("")), _GAP), "")


def _hash(words: Column, at: Column, n: int) -> Column:
    return F.xxhash64(*(F.get(words, at + i) for i in range(n)))


def _positions(words: str, n: int) -> Column:
    """Starts of all shingles of n words, from 0."""
    return F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """item (string), m (words) and tokens of each window, repeats dropped. An item of fewer words, but
    not none, is one window. Items with a null id or no words have none."""
    w = items.select(F.col("item_id").cast("string").alias("item"), words_of("text").alias("w")).where("item is not null and size(w) > 0")
    at = w.select("item", "w", F.least(F.size("w"), F.lit(window)).alias("m"), F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))).alias("o"))
    return at.select("item", "m", F.slice("w", F.col("o") + 1, F.col("m")).alias("tokens")).distinct()


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("*", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_k"), F.xxhash64("text").alias("_h"))


def _hits(keyed: DataFrame, items: DataFrame, window: int, shingle: int) -> tuple[DataFrame, DataFrame]:
    """For each document its n_words, and for those with hits n_hit and items; both by (_k, _h)."""
    wins = written(item_windows(items, window).groupBy("tokens", "m").agg(F.array_sort(F.collect_set("item")).alias("ids")).withColumn("win", F.xxhash64("tokens")), "windows")
    shapes = sorted(min(r[0], shingle) for r in wins.select("m").distinct().collect())  # as many as there are lengths up to the window's
    shapes = sorted(set(shapes)) or [shingle]

    def shingles(words: str, n: int) -> Column:
        return F.transform(_positions(words, n), lambda i: F.struct(i.alias("p"), _hash(F.col(words), i, n).alias("s")))

    parts = [wins.where(F.least("m", F.lit(shingle)) == n).select("win", "tokens", "m", F.explode(shingles("tokens", n)).alias("x"), F.lit(n).alias("n")) for n in shapes]
    own = parts[0]
    for p in parts[1:]:
        own = own.unionByName(p)
    own = written(own.select("win", "tokens", "m", "n", F.col("x.p").alias("o"), F.col("x.s").alias("s")), "shingles")
    wanted = own.select("s", "n").distinct()
    n_shingles = own.count()
    if n_shingles <= BROADCAST:
        wanted = F.broadcast(wanted)

    # Two bits for each item shingle: a map of LONGS numbers at most, summed up by Spark.
    longs = min(LONGS, 1 << max(6, (n_shingles // 4).bit_length()))

    def places(s: Column) -> list[tuple[Column, Column]]:
        """Slot and bit of each of a shingle's two bits."""
        other = F.xxhash64(s)
        return [(F.pmod(x, F.lit(longs)).cast("int"), F.pmod(F.shiftright(x, 32), F.lit(64)).cast("int")) for x in (s, other)]

    each = own.select("s").distinct().select(F.explode(F.array(*(F.struct(slot.alias("slot"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("v")) for slot, bit in places(F.col("s"))))).alias("x"))
    bits = {r[0]: r[1] for r in each.groupBy("x.slot").agg(F.bit_or("x.v")).collect()}
    table = F.split(F.lit(",".join(str(bits.get(i, 0)) for i in range(longs))), ",").cast("array<bigint>")

    def known(s: Column) -> Column:
        (slot, bit), (slot2, bit2) = places(s)
        return (F.getbit(F.get(table, slot), bit) == 1) & (F.getbit(F.get(table, slot2), bit2) == 1)

    # One pass over the texts: which positions may hold a wanted shingle, with the words around each, and
    # a row for each document.
    here = keyed.select("_k", "_h", words_of("text").alias("w"))
    around = window - min(shingle, window)

    def cell(n: int):
        def make(x: Column) -> Column:
            start = F.greatest(x["p"] - around, F.lit(0))
            return F.struct(x["p"].alias("p"), x["s"].alias("s"), F.lit(n).alias("n"), start.alias("c"), F.slice("w", start + 1, x["p"] + n + around - start).alias("near"))

        return make

    cells = [F.transform(F.filter(shingles("w", n), lambda x: known(x["s"])), cell(n)) for n in shapes]
    row = F.array(F.struct(F.lit(-1).alias("p"), F.lit(0).cast("long").alias("s"), F.lit(0).alias("n"), F.lit(0).alias("c"), F.array().cast("array<string>").alias("near")))
    rows = here.select("_k", "_h", F.size("w").alias("n_words"), F.explode(F.concat(row, *cells)).alias("x")).select("_k", "_h", "n_words", "x.*")
    seen = written(rows.join(wanted.withColumn("hit", F.lit(True)), ["s", "n"], "left").where("p < 0 or hit").drop("hit"), "seen")
    found = seen.where("p >= 0")

    # Rarity over all documents; the prefix of a window is its rarest shingle.
    rarity = found.select("s", "n", "_k", "_h").distinct().groupBy("s", "n").agg(F.count("*").alias("df"))
    ranked = own.join(rarity, ["s", "n"], "left")
    prefix = ranked.groupBy("win", "tokens", "m", "n").agg(F.min(F.struct("df", "o", "s")).alias("x"), F.count("df").alias("known"), F.count("*").alias("all")).where("known = all")
    prefix = written(prefix.join(wins.select("tokens", "ids"), "tokens").select("tokens", "ids", "m", "n", F.col("x.s").alias("s"), F.col("x.o").alias("o")), "prefix")
    at = F.col("p") - F.col("o")
    sure = found.join(prefix, ["s", "n"]).withColumn("at", at).where((F.col("at") >= 0) & (F.col("at") + F.col("m") <= F.col("n_words")) & (F.slice("near", F.greatest(F.col("at") - F.col("c") + 1, F.lit(1)), F.col("m")) == F.col("tokens")))
    hits = sure.groupBy("_k", "_h").agg(
        F.size(F.array_distinct(F.flatten(F.collect_set(F.sequence(F.col("at"), F.col("at") + F.col("m") - 1))))).cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("items"),
    )
    counted = seen.where("p < 0").select("_k", "_h", F.col("n_words").cast("long").alias("n_words")).distinct()
    return counted, hits


def contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` with three columns more: n_words, n_hit (words inside any occurrence of a
    window) and items (ids, as sorted strings, of items with occurring windows).

    Null text: no words, no hit. Null doc_id: as any other. Rows equal in doc_id and text get equal
    results. No items, or only such without words: no hits. Empty table: no rows. Columns of ``docs``
    that bear the new names are replaced."""
    docs, back = shielded(docs.drop("n_words", "n_hit", "items"), "_k", "_h")
    keyed = _keyed(docs)
    none = F.array().cast("array<string>")
    with scratch() as keep:
        counted, hits = _hits(keyed, items, window, shingle)
        facts = keep(written(counted.join(hits, ["_k", "_h"], "left").select("_k", "_h", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", none).alias("items")), "hits"))
    return keyed.join(facts, ["_k", "_h"]).select(*docs.columns, "n_words", "n_hit", "items").withColumnsRenamed(back)


def decontaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` without those that hold any window of an item. Only keys of contaminated rows
    meet the texts; Spark broadcasts them if their size allows, and else joins by shuffle."""
    docs, back = shielded(docs, "_k", "_h")
    keyed = _keyed(docs)
    with scratch() as keep:
        gone = keep(written(_hits(keyed, items, window, shingle)[1].select("_k", "_h"), "contaminated"))
    return keyed.join(gone, ["_k", "_h"], "left_anti").drop("_k", "_h").withColumnsRenamed(back)


#: The same in DuckDB's SQL, for the columns of the query.
ORACLE = f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, array_to_string(w[i : i + {WINDOW} - 1], ' ') AS t, least(len(w), {WINDOW}) AS m
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), lens AS (SELECT DISTINCT m FROM win),
grams AS (
  SELECT doc_id, i, m, array_to_string(w[i : i + m - 1], ' ') AS t
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, lens WHERE len(w) >= m)
), hit AS (
  SELECT doc_id, i, m, item_id FROM grams JOIN win USING (t, m)
), counted AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT doc_id, i, m FROM hit)) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN counted USING (doc_id) LEFT JOIN named USING (doc_id)
"""
