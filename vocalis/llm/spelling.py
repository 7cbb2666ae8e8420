"""Operator 12: spelling variants grouped by a symmetric-delete join.

Every word emits itself and its single deletions. Words that meet under a shared key are at distance one where the key is
one of them (an inserted letter), or where both lose a letter at the same place (a replaced one): so the place is part of
the key, no pair that fails is ever made, and what meets is verified. Words under one key and place differ in that letter
only, so there are never more of them than letters; each takes their number and its best neighbour from their sorted
list, and no pairs are spelled out. Then each word's most frequent neighbour is its form, and roots are joined by
doubling: a form is at least FACTOR times as frequent as its word, so paths are short and never turn back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocalis.llm.common import discard, need, written

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
LEAST_LENGTH, LEAST_COUNT, FACTOR = 5, 3, 2
#: Deletions of words up to this length are the keys themselves; those of longer ones are hashed, and pairs verified.
LONG = 64


def lower_ascii(run: Column) -> Column:
    """A run of Latin letters with A-Z lower-cased and no others."""
    return F.when(F.octet_length(run) == F.char_length(run), F.lower(run)).otherwise(F.translate(run, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def misspelt(word: Column, doc_id: Column, one_in: int = 97) -> Column:
    """The word as a document writes it: one in so many pairs of document and word lose a letter, drawn by crc32."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    at = (h % F.char_length(word)).cast("int")
    return F.when(h % one_in == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.char_length(word)))).otherwise(word)


def document_words(docs: DataFrame) -> DataFrame:
    """(doc_id, word): each run of letters of each text, lower-cased. Null and empty texts have none."""
    need(docs, "doc_id", "text")
    return docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("word")).select("doc_id", lower_ascii(F.col("word")).alias("word"))


def vocabulary(words: DataFrame) -> DataFrame:
    """(word, n) of the words long and frequent enough; counted before the shuffle, so a hot word costs no more."""
    kept = words.where(F.char_length("word") >= LEAST_LENGTH)
    return kept.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _apart(side: DataFrame) -> DataFrame:
    """A side of a join that grows with the vocabulary: never broadcast, which would bring it through the driver."""
    return side.hint("merge")


def _best(near: DataFrame) -> DataFrame:
    return near.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("near").alias("near"))


def _side(word: str, near: str, n: str) -> Column:
    """One link as (word, n_near, near): the smallest near is the best one, frequent words first, then by code points."""
    return F.struct(F.col(word).alias("word"), F.lit(1).cast("long").alias("n_near"), F.struct(F.negative(F.col(n)).alias("rank"), F.col(near).alias("word")).alias("near"))


def short_links(words: DataFrame) -> DataFrame:
    """(word, n_near, near) of links whose longer word has at most LONG + 1 code points; several rows a word."""
    some = words.where(F.char_length("word") <= LONG + 1)
    place = F.sequence(F.lit(1), F.char_length("word"))
    key = lambda i: F.concat(F.substring(F.col("word"), F.lit(1), i - 1), F.substring(F.col("word"), i + 1, F.lit(LONG + 1)))
    new = lambda i: (i == 1) | (F.substring(F.col("word"), i, F.lit(1)) != F.substring(F.col("word"), i - 1, F.lit(1)))
    cuts = some.select("word", "n", F.inline(F.transform(place, lambda i: F.struct(i.alias("place"), key(i).alias("key"), new(i).alias("new")))))
    # letters of a run leave the same word, which is emitted once; it meets the word that is the key itself
    whole = some.select(F.col("word").alias("key"), F.col("n").alias("key_n"))
    joined = cuts.where("new").join(_apart(whole), "key").where(F.levenshtein("word", "key", 1) == 1)
    inserted = joined.select(F.inline(F.array(_side("word", "key", "key_n"), _side("key", "word", "n"))))
    # under one key and place stand words that differ in this place's letter, each once
    met = cuts.groupBy("key", "place").agg(F.sort_array(F.collect_list(F.struct(F.negative("n").alias("rank"), "word"))).alias("all")).where(F.size("all") > 1)
    each = F.transform("all", lambda x, i: F.struct(x["word"].alias("word"), (F.size("all") - 1).cast("long").alias("n_near"), F.when(i > 0, F.col("all")[0]).otherwise(F.col("all")[1]).alias("near")))
    return inserted.unionByName(met.select(F.inline(each)).where(F.levenshtein("word", "near.word", 1) == 1))


_PRIMES = (2_147_483_647, 2_147_483_629)


def _rolling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, word) -> (id, key, place, whole): hashes of a long word and of its single deletions, from prefix sums."""
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for name, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            points = np.frombuffer(word.encode("utf-32-le"), "<u4").astype(np.int64)
            n = len(points)
            keys = np.zeros(n + 1, np.int64)
            for prime in _PRIMES:
                power, before = [1], [0]
                for p in points.tolist():
                    before.append((before[-1] + p * power[-1]) % prime)
                    power.append(power[-1] * 1_000_003 % prime)
                up, sums = np.array(power), np.array(before)
                back = pow(1_000_003, -1, prime)
                # what stands behind the place moves one to the left
                keys[:n] = keys[:n] * (1 << 31) + (sums[:-1] + (sums[-1] - sums[1:]) % prime * back) % prime
                keys[n] = keys[n] * (1 << 31) + sums[-1]
            new = np.concatenate(([True], points[1:] != points[:-1], [True]))
            for column, values in zip(out, ([name] * (n + 1), keys.tolist(), [*range(1, n + 1), 0], new.tolist()), strict=True):
                column += values
            if len(out[0]) > 500_000:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=["id", "key", "place", "new"])
                out = [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int64(), pa.int32(), pa.bool_()), strict=True)], names=["id", "key", "place", "new"])


def long_links(words: DataFrame) -> DataFrame:
    """(word, n_near, near) of all other links: deletions of long words as hashes, candidates verified on the words."""
    some = words.where(F.char_length("word") > LONG).withColumn("id", F.sha2("word", 256))
    keys = some.select("id", "word").mapInArrow(_rolling, "id string, key long, place int, new boolean")
    cuts, whole = keys.where("place > 0"), keys.where("place = 0").select(F.col("id").alias("other"), "key")
    pairs = cuts.where("new").join(_apart(whole), "key").select("id", "other", "place", F.lit(True).alias("shorter"))
    same = cuts.select(F.col("id").alias("other"), "key", "place")
    pairs = pairs.unionByName(cuts.join(_apart(same), ["key", "place"]).where("id < other").select("id", "other", "place", F.lit(False).alias("shorter")))
    ours, theirs = some.select("id", "word", "n"), some.select(F.col("id").alias("other"), F.col("word").alias("word_2"), F.col("n").alias("n_2"))
    cut = lambda w: F.concat(F.substring(F.col(w), F.lit(1), F.col("place") - 1), F.substring(F.col(w), F.col("place") + 1, F.char_length(F.col(w))))
    real = pairs.join(_apart(ours), "id").join(_apart(theirs), "other").where((F.char_length("word") > LONG + 1) & (cut("word") == F.when(F.col("shorter"), F.col("word_2")).otherwise(cut("word_2"))))
    return real.select(F.inline(F.array(_side("word", "word_2", "n_2"), _side("word_2", "word", "n"))))


def variants(words: DataFrame) -> DataFrame:
    """(word, n) -> word, n, n_near, form, form_n, root.

    n_near counts the words at distance one; form is the most frequent of them (ties: the least in code-point order) if
    it is at least FACTOR times as frequent as the word, else null; root is the last word that forms lead to, the word
    itself where there is none. Words are distinct; no rows give none.
    """
    need(words, "word", "n")
    near = _best(short_links(words).unionByName(long_links(words)))
    form = F.when(F.negative("near.rank") >= FACTOR * F.col("n"), F.col("near"))
    found = words.select("word", "n").join(_apart(near), "word", "left").withColumn("form", form)
    named = written(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("form.word").alias("form"), F.negative("form.rank").alias("form_n")), "word-forms")
    roots = written(named.where("form is not null").select("word", F.col("form").alias("root")), "word-roots")
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = written(roots.join(_apart(further), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("on")), "word-roots")
        discard(roots)
        roots = moved
        if roots.where("on").isEmpty():
            break
    return named.join(_apart(roots.select("word", "root")), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
