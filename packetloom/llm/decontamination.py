"""Benchmark decontamination by size-partitioned MinHash containment search.

A short item inside a long document has next to no resemblance with it, so both
are partitioned by size.  Items fall into classes of up to 16, 64, 256, ...
shingles.  For a class of bound u a document is read in overlapping stretches of 2u
shingles, each begun u after the last; whatever part of a document holds an item lies within
one of them, whose size is that of the item up to a constant.  The sketch of a
stretch is its u least shingle hashes (bottom-k MinHash), that of an item its
least few.  If the stretch has at least 80 percent of the item's shingles, a hash
of the item is missing from the stretch's sketch with a probability below 2**-q
for q shingles found, and one common hash makes a candidate.  Candidates are
confirmed by the exact containment of the item's shingles in the whole document.
The smallest class has so few hashes to be found by that documents keep all of
theirs for it, so its items are found surely.

Only DataFrame operations are used.  The items' sketches are broadcast if their
number is below a bound and joined by shuffle otherwise; documents are not
shuffled in the search.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case, a shingle has five; a text
with fewer words is one shingle.  Cases: null and empty texts match nothing; a
null item_id or doc_id is an id like others; repeated rows give one pair; an
empty table gives an empty result.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

from .shared import table, unused

WORDS, SHARE = 5, 80
SKETCH = 16
#: Sketch rows that may be broadcast (a hash and an item id each).
BROADCAST_ROWS = 200_000


def word_list(text: str) -> Column:
    low = F.translate(F.coalesce(F.col(text), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    low = F.btrim(low, F.lit(" \t\n\x0b\f\r"))
    return F.when(low == "", F.array().cast("array<string>")).otherwise(F.split(low, "[\\x20\\x09-\\x0D]+"))


def with_shingles(df: DataFrame, text: str, words: int, name: str = "shingles") -> DataFrame:
    """Adds the hashes of all shingles in order, repeats included."""
    df = df.withColumn("_words", F.transform(word_list(text), lambda w: F.xxhash64(w)))
    several = F.transform(F.sequence(F.lit(0), F.size("_words") - words), lambda i: F.xxhash64(*(F.col("_words")[i + k] for k in range(words))))
    one = F.array(F.xxhash64(*(F.get("_words", F.lit(k)) for k in range(words - 1))))
    return df.withColumn(name, F.when(F.size("_words") >= words, several).when(F.size("_words") > 0, one).otherwise(F.array().cast("array<bigint>"))).drop("_words")


def stretches(shingles: str, bound: int) -> Column:
    """The least ``bound`` hashes of every stretch, as one array of distinct values."""
    begin = F.sequence(F.lit(1), F.greatest(F.size(shingles) - bound, F.lit(1)), F.lit(bound))
    each = F.transform(begin, lambda b: F.slice(F.sort_array(F.array_distinct(F.slice(F.col(shingles), b, 2 * bound))), 1, bound))
    return F.array_distinct(F.flatten(each))


def contained(docs: DataFrame, items: DataFrame, words: int = WORDS, share: int = SHARE) -> DataFrame:
    """doc_id, item_id, n_shared, n_item: items of which a document has at least ``share`` percent of the shingles."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = with_shingles(items.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct(), "text", words, "item").withColumn("item", F.array_distinct("item")).where("size(item) > 0")
    items = table(items.select("item_id", "item", F.size("item").alias("n_item")), "items")
    c = F.greatest(F.ceil(F.log2("n_item") / 2), F.lit(2)).cast("int").alias("c")  # the class has up to 4 ** c shingles
    sizes = sorted(r[0] for r in items.select(c).distinct().collect())  # at most one row for each power of four
    if not sizes:
        return docs.limit(0).select("doc_id", F.lit(0).cast("long").alias("item_id"), F.lit(0).cast("long").alias("n_shared"), F.lit(0).cast("long").alias("n_item"))
    mine = items.select("item_id", c, F.explode(F.slice(F.sort_array("item"), 1, SKETCH)).alias("hash"))
    if mine.count() <= BROADCAST_ROWS:
        mine = F.broadcast(mine)
    # Shingles are computed once; each class takes its hashes of them.
    tagged = lambda x: lambda h: F.struct(F.lit(x).alias("c"), h.alias("hash"))
    each = [F.transform(F.array_distinct("shingles") if x == 2 else stretches("shingles", 4**x), tagged(x)) for x in sizes]
    hashes = with_shingles(docs, "text", words).select("doc_id", F.inline(F.concat(*each)))
    found = hashes.join(mine, ["c", "hash"]).select("doc_id", "item_id")
    # The pairs' true size lets Spark choose how to join the texts.
    wanted = table(found.distinct(), "candidates").withColumnRenamed("doc_id", "d")
    texts = docs.join(wanted.select("d").distinct(), F.col("doc_id").eqNullSafe(F.col("d")), "left_semi")
    texts = with_shingles(texts, "text", words).select("doc_id", F.array_distinct("shingles").alias("shingles"))
    both = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("d"))).join(items.withColumnRenamed("item_id", "i"), F.col("item_id").eqNullSafe(F.col("i")))
    out = both.select("doc_id", "item_id", F.size(F.array_intersect("item", "shingles")).cast("long").alias("n_shared"), F.col("n_item").cast("long").alias("n_item"))
    return out.where(F.col("n_shared") * 100 >= F.col("n_item") * share).distinct()


def without_contaminated(docs: DataFrame, items: DataFrame, words: int = WORDS, share: int = SHARE) -> DataFrame:
    """docs, all columns, without documents that contain an item."""
    name = unused(docs, "_bad")
    bad = table(contained(docs, items, words, share).select(F.col("doc_id").alias(name)).distinct(), "contaminated")
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(F.col(name)), "left_anti")


ORACLE_SQL = """
WITH texts AS (
  SELECT 'd' AS side, doc_id AS id, text FROM documents
  UNION ALL
  SELECT 'i', item_id, text FROM benchmark
), low AS (
  SELECT side, id, trim(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM texts
), words AS (
  SELECT side, id, regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+') AS w FROM low WHERE t <> ''
), grams AS (
  SELECT DISTINCT side, id, array_to_string(w[i:i+4], ' ') AS g
  FROM (SELECT side, id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words)
), size AS (SELECT id, count(*) AS n_item FROM grams WHERE side = 'i' GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared, any_value(n_item) AS n_item
FROM grams d JOIN grams i ON d.g = i.g AND d.side = 'd' AND i.side = 'i' JOIN size ON size.id = i.id
GROUP BY d.id, i.id HAVING count(*) * 100 >= any_value(n_item) * 80
"""
