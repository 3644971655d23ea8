"""Document fingerprints: threshold-scaled sketches of word shingles, in Spark's own functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltbed.llm.common import by_size, text_or_empty, written

#: Words of a shingle, and the part of all hashes that a sketch retains: one in KEEP.
WORDS, KEEP = 5, 8
#: Ids of one ordering block, and blocks that one window orders.
IDS, BLOCKS = 512, 4096
_BELOW = -(1 << 63) + (1 << 64) // KEEP


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the lower-cased text's runs of other characters than ASCII's white space."""
    words = F.array_remove(F.split(F.lower(text), "[ \\t\\n\\x0B\\f\\r]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def shingle_hashes(hashes: str) -> Column:
    """hashes: name of a column of word_hashes(). Fewer words than a shingle's are one shingle; none has none."""
    h = F.col(hashes)
    ends = F.sequence(F.lit(0), F.size(h) - WORDS)
    whole = F.transform(ends, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WORDS)]))
    return F.when(F.size(h) >= WORDS, whole).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))


def sketch(shingles: str) -> Column:
    """shingles: name of a column of shingle_hashes(). The distinct hashes in the lowest KEEPth part, sorted.

    Sketches of two texts merge by union, since the bound is the same for all. Where no hash is below it, the least one
    stands for the text, so that only a text without words has an empty sketch; a merge may drop it.
    """
    low = F.array_sort(F.array_distinct(F.filter(F.col(shingles), lambda h: h < F.lit(_BELOW))))
    return F.when(F.size(low) > 0, low).when(F.size(shingles) > 0, F.array(F.array_min(shingles))).otherwise(low)


def with_sketch(df: DataFrame, text: str, to: str) -> DataFrame:
    return df.withColumn("_words", word_hashes(F.col(text))).withColumn("_shingles", shingle_hashes("_words")).withColumn(to, sketch("_shingles")).drop("_words", "_shingles")


def containment(a: Column, b: Column) -> Column:
    """The shared part of the smaller sketch; 1 for two empty ones, 0 for one empty one."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise((F.size(a) == F.size(b)).cast("double"))


def printed(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda h: F.hex(h)), ",")


def following(keys: DataFrame) -> DataFrame:
    """keys: key (distinct longs). Returns key, next: the largest smaller key, after the smallest the largest.

    Keys are ordered within blocks of IDS numbers; the blocks' own numbers are put in order the same way until BLOCKS
    or fewer are left, so that no window sorts more rows than those bounds.
    """
    whole = Window.orderBy(F.desc("key"))
    if keys.limit(BLOCKS + 1).count() <= BLOCKS:
        first = keys.agg(F.max("key")).first()[0]
        return keys.select("key", F.coalesce(F.lead("key").over(whole), F.lit(first)).cast("long").alias("next"))
    block = F.floor(F.col("key") / IDS).cast("long")
    own = Window.partitionBy("_block").orderBy(F.desc("key"))
    tops = keys.groupBy(block.alias("key")).agg(F.max(F.col("key")).alias("_top"))
    after = following(tops.select("key")).join(tops.select(F.col("key").alias("next"), "_top"), "next").select(F.col("key").alias("_block"), "_top")
    within = keys.withColumn("_block", block).withColumn("_next", F.lead("key").over(own))
    return within.join(after, "_block").select("key", F.coalesce("_next", "_top").alias("next"))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text and _next, the next document's text, of every row.

    docs: doc_id and text; other columns are ignored, a null text is empty. The next document is that of the next
    smaller doc_id, after the smallest that of the largest; a document alone is its own next. Rows that repeat a doc_id follow each
    other by text. A row without doc_id has no place in the order, and is its own next. No documents: no rows.

    Texts are shuffled once, by blocks of IDS ids. A block gets a copy of the first row of the block that follows it,
    so its window knows every row's next one; those copies are one row for each block.
    """
    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    block = F.floor(F.col("doc_id") / IDS).cast("long")
    tops = written(rows.filter(F.col("doc_id").isNotNull()).groupBy(block.alias("key")).agg(F.max("doc_id").alias("doc_id")), "blocks")
    order = following(tops.select("key"))
    to = written(order.join(tops.withColumnRenamed("key", "next"), "next").select("doc_id", F.col("key").alias("_block")), "tops")
    first = rows.join(by_size(to), "doc_id").groupBy("doc_id", "_block").agg(F.min("text").alias("text"))
    own = rows.filter(F.col("doc_id").isNotNull()).select("doc_id", "text", block.alias("_block"), F.lit(False).alias("_copy"))
    both = own.union(first.select("doc_id", "text", "_block", F.lit(True)))
    line = Window.partitionBy("_block").orderBy("_copy", F.desc("doc_id"), "text")
    ordered = both.withColumn("_next", F.lead("text").over(line)).filter(~F.col("_copy")).select("doc_id", "text", "_next")
    alone = rows.filter(F.col("doc_id").isNull()).select("doc_id", "text", F.col("text").alias("_next"))
    return ordered.union(alone)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and how alike they are.

    The edited text's last floor(n_chars / 2) code points are those that the next document (with_next()) begins with, as
    many as it has. Alike is the shared part of the smaller sketch.
    """
    pairs = with_next(docs)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("_next"), F.lit(1), half))
    df = pairs.withColumn("n_chars", n.cast("long")).withColumn("_edited", edited)
    df = with_sketch(df, "text", "_own").drop("text")
    df = with_sketch(df, "_next", "_after").drop("_next")
    df = df.withColumn("edited_sha256", F.sha2("_edited", 256))
    df = with_sketch(df, "_edited", "_other").drop("_edited")
    return df.select(
        "doc_id", "n_chars", "edited_sha256", printed(F.col("_own")).alias("fingerprint"), printed(F.col("_other")).alias("edited_fingerprint"),
        containment(F.col("_own"), F.col("_other")).alias("near_edited"), containment(F.col("_own"), F.col("_after")).alias("near_next"),
    )
