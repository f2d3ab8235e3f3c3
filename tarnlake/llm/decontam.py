"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations alone.

An item's windows are its runs of WINDOW words (all its words, if fewer). A window occurs in a document only if
all its words do, so by the prefix filter its one rarest word is enough to join on: words are ordered by how
often they occur in all documents. Each occurrence of that word at a position p of a document bounds the
window's place: it starts at p minus the word's place in it, which must be 0 or more and leave room for all its
words (positional and length bounds). Then the words there are compared one by one.

Defined results: a null or wordless text has no words, no hits and is clean; an item without words has no
windows; equal items each count, and repeated item_ids count once; a null doc_id keeps its row, with the hits of
all rows of that id (repeated doc_ids are told apart by a hash of their text, so rows alike in both share one
result); an empty documents table gives no rows, an empty benchmark none that is hit; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnlake.llm.common import ascii_lower, written

WINDOW = 13
#: Distinct windows up to which they are broadcast (about 300 bytes each); beyond, the join is shuffled.
BROADCAST_WINDOWS = 100_000
WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text: runs of a-z after ASCII lower-casing, digits and characters beyond ASCII."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), lambda w: w != "")


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Distinct (gram, item): windows and the items that hold them."""
    x = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - F.lit(size - 1), F.lit(1)))
    x = x.select("item", "w", F.explode(starts).alias("s")).select("item", F.slice("w", F.col("s"), F.lit(size)).alias("gram"))
    return x.distinct()


def word_counts(docs: DataFrame, vocabulary: DataFrame, small: bool) -> DataFrame:
    """How often each word of vocabulary (word) occurs in all docs (w)."""
    if small:
        vocabulary = F.broadcast(vocabulary)
    return docs.select(F.explode("w").alias("word")).join(vocabulary, "word").groupBy("word").count()


def occurrences(docs: DataFrame, grams: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id, th, start, n, gid): every place where a window occurs. docs: doc_id, th and words w; grams: gid and gram."""
    small = grams.count() <= BROADCAST_WINDOWS
    vocabulary = grams.select(F.explode("gram").alias("word")).distinct()
    counts = word_counts(docs, vocabulary, small)
    # the rarest word of each window, and its first place there; a word that no document has ends the search for it
    placed = grams.select("gid", "gram", F.posexplode("gram").alias("place", "word")).join(F.broadcast(counts) if small else counts, "word", "left")
    rank = F.struct(F.coalesce("count", F.lit(0)).alias("count"), "word", "place")
    rare = placed.groupBy("gid").agg(F.min(rank).alias("r"), F.first("gram").alias("gram")).filter("r.count > 0")
    rare = rare.select(F.col("r.word").alias("word"), F.col("r.place").alias("place"), "gram", "gid", F.size("gram").alias("n"))
    at = F.col("p") - F.col("place")
    inside = (at >= 0) & (at + F.col("n") <= F.col("n_words"))
    if small:  # the words travel along as they are until the comparison, in the same stage
        met = docs.select("doc_id", "th", "w", F.size("w").alias("n_words"), F.posexplode("w").alias("p", "word")).join(F.broadcast(rare), "word").filter(inside)
        met = met.filter(F.slice("w", at + 1, F.col("n")) == F.col("gram"))
    else:
        around = F.slice("w", F.greatest(F.col("p") - (size - 2), F.lit(1)), F.lit(2 * size - 1))
        met = docs.select("doc_id", "th", "w", F.size("w").alias("n_words"), F.posexplode("w").alias("p", "word"))
        met = met.select("doc_id", "th", "n_words", "p", "word", around.alias("near"), F.least("p", F.lit(size - 1)).alias("back"))
        met = met.join(rare, "word").filter(inside).filter(F.slice("near", F.col("back") - F.col("place") + 1, F.col("n")) == F.col("gram"))
    return met.select("doc_id", "th", at.alias("start"), "n", "gid")


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Per row of docs: n_words, n_hit, items (sorted ids as strings) and contaminated."""
    x = docs.select("doc_id", F.xxhash64("text").alias("th"), words_of(F.col("text")).alias("w"))
    held = windows(benchmark, size)
    grams = written(held.select("gram").distinct().withColumn("gid", F.monotonically_increasing_id()), "windows")
    found = occurrences(x, grams, size).distinct()
    by_doc = Window.partitionBy("doc_id", "th").orderBy("start", "n")
    reached = F.max(F.col("start") + F.col("n")).over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    end = F.col("start") + F.col("n")
    fresh = F.greatest(end - F.greatest("start", F.coalesce(reached, F.lit(0))), F.lit(0))
    # a hit carries its window's number; lists of items are made a document, from its distinct windows
    hits = found.select("doc_id", "th", "gid", fresh.alias("fresh")).groupBy("doc_id", "th").agg(F.sum("fresh").cast("long").alias("n_hit"), F.collect_set("gid").alias("gids"))
    items = hits.select("doc_id", "th", "n_hit", F.explode("gids").alias("gid")).join(held.join(grams, "gram").select("gid", "item"), "gid")
    hits = items.groupBy("doc_id", "th").agg(F.first("n_hit").alias("n_hit"), F.array_sort(F.collect_set("item")).alias("items"))
    hits = hits.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "n_hit", "items")
    rows = x.select("doc_id", "th", F.size("w").cast("long").alias("n_words"))
    y = rows.join(hits, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return y.select("doc_id", "th", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items")).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with all columns, that are not contaminated."""
    bad = contamination(docs, benchmark).filter("contaminated").select(F.col("doc_id").alias("__tl_id"), F.col("th").alias("__tl_th")).distinct()
    return docs.join(bad, docs.doc_id.eqNullSafe(F.col("__tl_id")) & (F.xxhash64(docs.text) == F.col("__tl_th")), "left_anti")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    got = contamination(docs, items)
    return got.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


ORACLE = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x{00}-\\x{2F}\\x{3A}-\\x{60}\\x{7B}-\\x{7F}]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x{00}-\\x{2F}\\x{3A}-\\x{60}\\x{7B}-\\x{7F}]+') AS w FROM benchmark),
grams AS (SELECT DISTINCT item, w[s:s + 12] AS g FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(g) AS n FROM grams),
runs AS (SELECT doc_id, s, n, w[s:s + n - 1] AS g FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, s, n, item FROM runs JOIN grams USING (g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS said FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(said, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN found ON d.doc_id = found.doc_id
"""
