"""Operator 2: benchmark decontamination with one Aho-Corasick automaton over words.

Every word of the benchmark becomes one character, every other word of a document a filler, so the automaton walks a
document once, word by word, and an end position is a word's index. Word indexes of hits map back to the original
text. The benchmark is split by total words into blocks of bounded size; each block is one automaton and one pass,
which add to the same hit lists, so a benchmark of any size gives the same result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalis.llm.common import fresh, need, small_batches, tidy, without, written

WINDOW = 10
#: Words of benchmark text in one automaton: at most ten nodes each, about 150 MB in a worker. Bytes of its text.
BLOCK_WORDS, BLOCK_BYTES = 200_000, 4 << 20
FILLER = "\x01"
FIRST = 0x100
_LETTER = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")

_built: dict[str, tuple] = {}


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words: runs of ASCII letters and digits and of anything beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(_LETTER).split() if text else []


def _code(n: int) -> str:
    n += FIRST
    return chr(n + 0x800 if n >= 0xD800 else n)


def build(items: list[tuple[str | None, list[bytes]]], window: int) -> tuple:
    """(word to character, automaton); the automaton's value is (words in the pattern, ids of the items that hold it)."""
    codes: dict[bytes, str] = {}
    owners: dict[str, set] = {}
    for name, words in items:
        for w in words:
            if w not in codes:
                codes[w] = _code(len(codes))
        coded = "".join(codes[w] for w in words)
        for i in range(max(1, len(words) - window + 1)):
            owners.setdefault(coded[i : i + window], set()).add(name)
    found = ahocorasick.Automaton()
    for pattern, names in owners.items():
        found.add_word(pattern, (len(pattern), sorted(n for n in names if n is not None)))
    found.make_automaton()
    return codes, found


def scan(words: list[bytes], codes: dict, found) -> tuple[list[list[int]], set[str]]:
    """Hit word ranges [first, past] and ids of the items found."""
    get = codes.get
    ranges: list[list[int]] = []
    names: set[str] = set()
    for last, (n, ids) in found.iter("".join([get(w, FILLER) for w in words])):
        names.update(ids)
        if ranges and last - n + 1 <= ranges[-1][1] and last - n + 1 >= ranges[-1][0]:
            ranges[-1][1] = last + 1
        else:
            ranges.append([last - n + 1, last + 1])
    return ranges, names


def union(ranges: list) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _segments(window: int, block_words: int):
    """Blocks of items (name, words, block): a block ends when its words or bytes are full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, size = 0, 0, 0
        step = max(1, block_words - window + 1)
        for batch in batches:
            rows = ([], [], [])
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                for at in range(0, max(1, len(words) - window + 1) if words else 0, step):
                    part = words[at : at + block_words]
                    if held and (held + len(part) > block_words or size > BLOCK_BYTES):
                        block, held, size = block + 1, 0, 0
                    held, size = held + len(part), size + sum(map(len, part))
                    for col, x in zip(rows, (name, b" ".join(part), block), strict=True):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), pa.array(rows[1], pa.binary()), pa.array(rows[2], pa.int32())], names=["name", "words", "block"])

    return run


def blocks(benchmark: DataFrame, window: int, block_words: int) -> Iterator[list[tuple[str | None, bytes]]]:
    """The benchmark's items in blocks of bounded size, read block by block; one empty block of an empty benchmark.

    Items are dealt evenly to so many tasks as there are blocks' worth of text, and each task fills its blocks in turn.
    """
    sized = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null")
    total = sized.agg(F.sum(F.char_length("text"))).first()[0] or 0
    n = max(1, -(-total // (2 * block_words)))  # a word and its separator take two characters at least
    dealt = (sized.coalesce(1) if n == 1 else sized.repartition(n)).mapInArrow(_segments(window, max(block_words, window)), "name string, words binary, block int")
    dealt = written(dealt.withColumn("task", F.spark_partition_id()), "benchmark-blocks")
    found = dealt.select("task", "block").distinct().orderBy("task", "block").collect()
    for r in found:
        yield [(x.name, bytes(x.words)) for x in dealt.where((F.col("task") == r.task) & (F.col("block") == r.block)).select("name", "words").collect()]
    if not found:
        yield []


_MERGED = "hits array<int>, ids array<string>"
_SPANS = "array<struct<begin: int, end: int>>"


def _automaton(shared, key: str, window: int) -> tuple:
    if key not in _built:
        _built.clear()
        _built[key] = build([(n, w.split(b" ")) for n, w in shared.value], window)
    return _built[key]


def _flat(ranges: list[list[int]]) -> list[int]:
    return [x for r in ranges for x in r]


def _hits(shared, key: str, window: int):
    """(md5 of a text, hits, ids) of texts with a hit; a task tells copies it has seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, found = _automaton(shared, key, window)
        for batch in batches:
            rows = ([], [], [])
            for h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ranges, ids = scan(words_of(text), codes, found)
                if ranges:
                    for col, x in zip(rows, (h, _flat(union(ranges)), sorted(ids)), strict=True):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), pa.array(rows[1], pa.list_(pa.int32())), pa.array(rows[2], pa.list_(pa.string()))], names=["h", "hits", "ids"])

    return run


def _judged(keep: list[str], window: int, shared=None, key: str = ""):
    """The last step: hits of the one automaton, or those brought along (last two columns), as the result's columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, found = _automaton(shared, key, window) if shared else (None, None)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            split = [words_of(t) for t in texts]
            if shared:
                got = [scan(w, codes, found) if w and codes else ([], set()) for w in split]
            else:
                old = zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True)
                got = [([*zip(h[::2], h[1::2], strict=True)] if h else [], ids or []) for h, ids in old]
            hits = [union(g[0]) for g in got]
            ids = [sorted(set(g[1])) for g in got]
            n_hit = [sum(b - a for a, b in h) for h in hits]
            spans = [located(t, h) if h else [] for t, h in zip(texts, hits, strict=True)]
            cols = [batch.column(n) for n in keep] + [
                pa.array([len(w) for w in split], pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.string())),
                pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in ids], pa.string()), pa.array([x > 0 for x in n_hit], pa.bool_()), pa.array(spans, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, *NEW])

    return tidy(run)


def located(text: str, ranges: list) -> list[dict]:
    """Code points of the original text that a run of words covers."""
    at = [m.span() for m in _WORD.finditer(text)]
    return [{"begin": at[a][0], "end": at[b - 1][1]} for a, b in ranges]


NEW = ("n_words", "n_hit", "n_items", "items", "items_sha256", "contaminated", "spans")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, keep: list[str] | None = None) -> DataFrame:
    """docs with n_words, n_hit, n_items (long), items (ids as sorted strings), items_sha256, contaminated, spans.

    docs: text and any other columns, of which those with one of the new names give way; keep names those to return
    (all). spans are code points of the original text, end exclusive, one for each run of hit words. A null or empty
    text has no words and no hits; rows repeated whole each get their result. Items without words, and null ids, count
    for nothing; repeated items act as one. Empty tables give no rows or no hits.
    """
    need(docs, "text")
    need(benchmark, "item_id", "text")
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    docs = without(docs, *NEW)
    keep = docs.columns if keep is None else keep
    frame = docs.select(*dict.fromkeys([*keep, "text"]))
    last = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema), f"n_words long, n_hit long, n_items long, items array<string>, items_sha256 string, contaminated boolean, spans {_SPANS}"])
    parts = blocks(benchmark, window, block_words)
    first, second = next(parts), next(parts, None)
    name = lambda items: hashlib.sha256(repr((items, window)).encode()).hexdigest()
    if second is None:
        return frame.mapInArrow(_judged(keep, window, spark.sparkContext.broadcast(first), name(first)), last)
    found: list[DataFrame] = []
    hashed = docs.select(F.md5("text").alias("h"), "text").where("h is not null")
    for items in chain((first, second), parts):
        shared = spark.sparkContext.broadcast(items)
        hits = hashed.mapInArrow(_hits(shared, name(items), window), f"h string, {_MERGED}")
        found.append(written(hits.groupBy("h").agg(F.first("hits").alias("hits"), F.first("ids").alias("ids")), "block-hits"))
        shared.destroy()
    merged = reduce(DataFrame.unionByName, found).groupBy("h").agg(F.flatten(F.collect_list("hits")).alias("hits"), F.flatten(F.collect_list("ids")).alias("ids"))
    h, hits, ids = fresh(frame, "_h", "_hits", "_ids")
    merged = merged.select(F.col("h").alias(h), F.col("hits").alias(hits), F.col("ids").alias(ids))
    joined = frame.join(merged, F.md5("text") == F.col(h), "left").drop(h)
    return joined.mapInArrow(_judged(keep, window), last)
