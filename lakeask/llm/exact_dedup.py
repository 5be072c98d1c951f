"""Exact dedup by two-pass Bloom filtering, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import stage

#: Most 64-bit words of the second filter, which is broadcast (128 MB). It grows with the repeated texts up to here, which has
#: over five bits for each of 10^8 of them; beyond, more single rows take the exact step, but a repeated one never is lost.
BROADCAST_WORDS = 1 << 24
#: Words of a page: the filter is broadcast as arrays, not as a row for each word.
PAGE = 512

#: A group of copies is hot with more rows than this and than a thousandth of all repeated rows. Fewer than a thousand groups
#: can be hot, which bounds what is broadcast.
HOT_ROWS = 1_000


def _pattern(h: Column, words: int) -> Column:
    """A hash's place in a blocked Bloom filter as one number: the word it falls in, then three of 64 bits, six binary digits each,
    from other parts of the hash."""
    return F.shiftleft(h.bitwiseAND(F.lit(words - 1)), 18).bitwiseOR(F.shiftrightunsigned(h, 40).bitwiseAND(F.lit((1 << 18) - 1)))


def _bits(pattern: Column) -> Column:
    """The word with a pattern's three bits set."""
    bit = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(pattern, at).bitwiseAND(F.lit(63)).cast("int")) for at in (0, 6, 12)]
    return bit[0].bitwiseOR(bit[1]).bitwiseOR(bit[2])


def _page(word: Column) -> Column:
    return F.shiftrightunsigned(word, PAGE.bit_length() - 1)


def _power(least: int) -> int:
    return 1 << max(least - 1, 0).bit_length()


def repeated_filter(hashes: DataFrame, bits_per_row: int = 16) -> tuple[DataFrame, int]:
    """Second Bloom filter of the hashes (column h) that may occur more than once, as (page, masks), and its number of words.

    The first pass sets each hash's pattern in a filter of `bits_per_row` bits a row. Its bit arrays would weigh rows x tasks, so
    tasks send the patterns they set, one number each and repeats already summed, and those set twice go into the second
    filter. A hash not in that occurs once for certain. The second filter has 16 bits for each pattern in it.
    """
    words = _power(bits_per_row * max(hashes.count(), 1) // 64)
    twice = hashes.groupBy(_pattern(F.col("h"), words).alias("pattern")).count().filter("count > 1").select("pattern")
    twice = stage(twice, "bloom")
    size = min(_power(max(twice.count() // 4, 1)), words, BROADCAST_WORDS)
    word = F.shiftrightunsigned("pattern", 18).bitwiseAND(F.lit(size - 1))
    zeros = hashes.sparkSession.range(size).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("mask"))
    table = twice.select(word.alias("word"), _bits(F.col("pattern")).alias("mask")).union(zeros).groupBy("word").agg(F.bit_or("mask").alias("mask"))
    pages = table.groupBy(_page(F.col("word")).alias("page")).agg(F.transform(F.sort_array(F.collect_list(F.struct("word", "mask"))), lambda x: x["mask"]).alias("masks"))
    return stage(pages, "filter"), size


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows of docs as struct `row`, with keep_id, group_size, kept and text_sha256.

    Null texts equal empty ones. Of equal texts the row with the largest id stays; null ids rank below all others; rows
    that repeat both id and text share their verdict. Rows whose hash the filters prove single are never shuffled,
    nor are rows of hot groups, whose verdicts are broadcast, so that no task gets more than a bounded group.
    Other columns travel inside `row`, so their names can't clash. An empty table gives an empty one.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("t"), F.struct("*").alias("row"))
    hashed = docs.select(F.xxhash64(text).alias("h"))
    pages, size = repeated_filter(hashed)
    rows = rows.withColumn("h", F.xxhash64("t")).withColumn("text_sha256", F.sha2("t", 256)).drop("t")
    rows = rows.withColumn("word", F.col("h").bitwiseAND(F.lit(size - 1))).withColumn("page", _page(F.col("word")))
    bits = _bits(_pattern(F.col("h"), size))
    mask = F.element_at("masks", F.col("word").bitwiseAND(F.lit(PAGE - 1)).cast("int") + 1)
    flagged = rows.join(F.broadcast(pages), "page", "left").withColumn("maybe", mask.bitwiseAND(bits) == bits)  # every page is there
    groups = flagged.filter("maybe").groupBy("text_sha256").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = stage(groups, "copies")
    repeated = groups.agg(F.sum("group_size")).first()[0] or 0
    hot = groups.filter(F.col("group_size") > max(repeated // 1000, HOT_ROWS)).withColumnRenamed("keep_id", "hot_id").withColumnRenamed("group_size", "hot_size")
    known = flagged.join(F.broadcast(hot), "text_sha256", "left")
    kept = F.col("id").eqNullSafe(F.col("keep_id")).alias("kept")
    settled = known.filter(~F.col("maybe") | F.col("hot_size").isNotNull())
    settled = settled.withColumns({"keep_id": F.when(F.col("hot_size").isNull(), F.col("id")).otherwise(F.col("hot_id")), "group_size": F.coalesce("hot_size", F.lit(1).cast("long"))})
    settled = settled.select("row", "keep_id", "group_size", kept, "text_sha256")
    again = known.filter(F.col("maybe") & F.col("hot_size").isNull()).select("row", "id", "text_sha256")
    return settled.union(again.join(groups, "text_sha256", "left").select("row", "keep_id", "group_size", kept, "text_sha256"))
