"""Operator 10: line deduplication by range-partitioned hashes and keep bitmaps. DataFrame functions only.

Line keys become 128-bit hashes; the (key, document, position) rows are range-partitioned by key and document, so a key
that fills a third of the rows spreads over many partitions, and sorted there by key, document, position. A window streams
over that order and marks the first line of each run of a key and document, which is what documents are counted by; runs
fold into bitmap words in the same partitions. The largest document of a key comes from partial maxima. What leaves is a
bitmap of kept lines for each document that loses any, compressed by leaving out words without a dropped line; text is
only read again where the bitmap is applied.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vocalis.llm.common import caseless, fresh, need, without, written

SPACE = " \t\n\x0b\x0c\r"
#: A key counts as hot from this share of all folded rows on; at most its inverse of keys can reach it.
HOT_SHARE = 1 / 1000


def line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    lines = docs.select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "line"))
    key = F.btrim("line", F.lit(SPACE))
    folded = caseless(key)
    return lines.where(F.char_length(key) >= min_chars).select(F.xxhash64(folded).alias("h1"), F.xxhash64(F.lit(7), folded).alias("h2"), "doc_id", "th", "pos")


def dropped_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Bitmaps of documents that lose lines: doc_id, th (hash of the text), words array<struct<word int, bits long>>: those
    words of 64 lines that lose any, with the bits of the kept lines.

    docs: doc_id (any orderable type), text. A row is known by doc_id and its text's hash: rows repeated whole act as
    one, rows that share a doc_id count as one document. A null doc_id is one document, below all others. Null and
    empty texts have one empty line. A table without rows gives none; extra columns are ignored.
    """
    need(docs, "doc_id", "text")
    rows = written(line_keys(docs, min_chars), "line-keys")
    # the window's sort within each range is by key, document, position
    run = W.partitionBy("h1", "h2", "doc_id").orderBy("pos", "th")
    ranged = rows.repartitionByRange("h1", "h2", "doc_id").withColumn("first", (F.row_number().over(run) == 1).cast("long"))
    word = F.floor(F.col("pos") / 64).cast("int").alias("word")
    folded = written(ranged.groupBy("h1", "h2", "doc_id", "th", word).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits"), F.sum("first").alias("firsts")), "line-runs")
    keys = folded.groupBy("h1", "h2").agg(F.sum("firsts").alias("n_docs"), F.count("*").alias("n"), F.max("doc_id").alias("keep"))
    keys = written(keys.where(F.col("n_docs") >= min_docs), "line-common")
    hot_from = max(min_docs, int(folded.count() * HOT_SHARE) + 1)
    hot = keys.where(F.col("n") >= hot_from).select("h1", "h2", F.col("keep").alias("hot_keep"), F.lit(True).alias("hot"))
    cold = keys.where(F.col("n") < hot_from).select("h1", "h2", "keep")
    tagged = folded.join(F.broadcast(hot), ["h1", "h2"], "left")
    goes = ~F.col("doc_id").eqNullSafe(F.col("keep"))
    from_hot = tagged.where("hot").withColumn("keep", F.col("hot_keep")).where(goes)
    from_cold = tagged.where("hot is null").join(cold, ["h1", "h2"]).where(goes)
    gone = from_hot.select("doc_id", "th", "word", "bits").unionByName(from_cold.select("doc_id", "th", "word", "bits"))
    bits = gone.groupBy("doc_id", "th", "word").agg(F.bit_or("bits").alias("bits"))
    return bits.groupBy("doc_id", "th").agg(F.sort_array(F.collect_list(F.struct("word", F.bitwise_not("bits").alias("bits")))).alias("words"))


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """docs with every column, text without its dropped lines, and n_lines, n_dropped (long), keep_words: the words
    (64 lines each) of the bitmap of kept lines that are not all ones, null where nothing is dropped.

    Columns of docs called n_lines, n_dropped or keep_words give way. A null text stays null where nothing is dropped
    from it, which is always.
    """
    docs = without(docs, "n_lines", "n_dropped", "keep_words")
    d, h = fresh(docs, "_d", "_h")
    drops = dropped_lines(docs, min_chars, min_docs).select(F.col("doc_id").alias(d), F.col("th").alias(h), F.col("words").alias("keep_words"))
    out = docs.join(drops.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col(d)) & (F.xxhash64("text") == F.col(h)), "left")
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    # a lambda's argument is worked out once a row: all words of the bitmap, by which each line then finds its own at once
    by_word = F.map_from_entries("keep_words")
    bound = F.transform(F.array(F.struct(lines.alias("ls"), by_word.alias("m"))), lambda x: F.struct(x["ls"].alias("ls"), F.transform(F.sequence(F.lit(0), F.floor((F.size(x["ls"]) - 1) / 64).cast("int")), lambda w: F.coalesce(F.try_element_at(x["m"], w), F.lit(-1).cast("long"))).alias("ws")))
    kept = F.transform(bound, lambda x: F.array_join(F.filter(x["ls"], lambda _, i: F.get(x["ws"], F.floor(i / 64).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i % 64)) != 0), "\n"))
    return (
        out.withColumn("n_lines", F.size(lines).cast("long"))
        .withColumn("n_dropped", F.coalesce(F.aggregate("keep_words", F.lit(0).cast("long"), lambda a, w: a + F.bit_count(F.bitwise_not(w["bits"]))), F.lit(0)).cast("long"))
        .withColumn("text", F.when(F.col("keep_words").isNull(), F.col("text")).otherwise(kept[0]))
        .drop(d, h)
    )
