"""Operator 9: best-fit packing of tokenised documents, certified by lower bounds.

Tokenising emits one small row for each piece; texts and ids go no further. Pieces are dealt into partitions of bounded
size, each packed by best-fit decreasing. Dual-feasible functions bound from below the bins a partition needs; one that
meets its bound is certified. The pieces in unfilled bins of the others are exchanged (dealt anew) and packed again,
which lets partial bins of different partitions complete each other, until all that is left fits one partition or an
exchange certifies and fills nothing more.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalis.llm.common import need, small_batches, tidy, written
from vocalis.llm.word_bpe import Encoder

CAPACITY = 2048
#: Pieces packed together in one task.
GROUP_PIECES = 200_000

_encoders: dict[str, Encoder] = {}


def _pieces(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        enc, step = _encoders[path], 4 * capacity
        for batch in batches:
            rows = ([], [], [], [], [])
            for doc, ids in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1).to_pylist()), strict=True):
                ids += b"\0\0\0\0"
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    for col, x in zip(rows, (doc, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], batch.schema.field(0).type), pa.array(rows[1], pa.int32()), *(pa.array(c, pa.int64()) for c in rows[2:])], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        enc.forget()

    return tidy(run)


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece of at most capacity tokens: doc_id, piece, start, length, ids_crc32."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_pieces(tokenizer, capacity), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs, from dual-feasible functions. counts[s]: pieces of size s, s from 0 to capacity.

    Two families: rounding to k-ths (sizes whose (k+1)-fold is no multiple of the capacity are rounded down to k-ths),
    and cutting at eps (pieces above capacity - eps count whole, those below eps not at all).
    """
    sizes = np.nonzero(counts)[0]
    sizes = sizes[sizes > 0]
    if not len(sizes):
        return 0
    n = counts[sizes].astype(np.int64)
    best = -(-int((sizes * n).sum()) // capacity)
    for k in range(1, 33):
        whole = (sizes * (k + 1)) % capacity == 0
        worth = np.where(whole, sizes * k, (sizes * (k + 1)) // capacity * capacity)  # in units of 1 / (k * capacity)
        best = max(best, -(-int((worth * n).sum()) // (k * capacity)))
    for eps in sizes[sizes <= capacity // 2]:
        worth = np.where(sizes > capacity - eps, capacity, np.where(sizes < eps, 0, sizes))
        best = max(best, -(-int((worth * n).sum()) // capacity))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: bin of each piece, offset in it, and room left in each bin.

    Open bins stand in stacks by their room; a bit mask of the stacks in use finds the tightest in one step.
    """
    order = np.argsort(-lengths, kind="stable")
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    room: list[int] = []
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for i in order.tolist():
        s = int(lengths[i])
        fits = mask >> s
        if fits:
            r = (fits & -fits).bit_length() - 1 + s
            b = stacks[r].pop()
            if not stacks[r]:
                mask &= ~(1 << r)
        else:
            b, r = len(room), capacity
            room.append(capacity)
        where[i], offset[i] = b, capacity - r
        room[b] = r - s
        if r > s:
            stacks[r - s].append(b)
            mask |= 1 << (r - s)
    return where, offset, np.array(room, np.int64)


def _pack(capacity: int, group_bits: int):
    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], ignore_index=True)
        lengths = part["length"].to_numpy()
        where, offset, room = best_fit(lengths, capacity)
        gap = len(room) - lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        filled = room[where] == 0
        return part.assign(sequence_id=(np.int64(key[0]) << group_bits) + where, offset=offset, done=filled | (gap <= 0), gap=np.int64(gap))

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """pieces (doc_id, piece, start, length, ids_crc32) with sequence_id, offset (long) and certified: whether the
    sequence is full or its partition meets its bound; no sequence is over capacity.

    Rows repeated whole are pieces like any others, and pieces are dealt by a number of their own, so rows that share a
    doc_id spread like any. A table without rows gives none. Sequence ids carry their partition in the high bits;
    full-size pieces never reach a packing task.
    """
    kind = pieces.schema["doc_id"].dataType.simpleString()
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    numbered = written(pieces.select(*columns, F.monotonically_increasing_id().alias("row")), "pieces")  # from here on row is fixed
    full = numbered.where(F.col("length") == capacity).select(*columns, (F.lit(1 << 62) + F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(True).alias("certified"))
    left, done, made, turn = numbered.where(F.col("length") < capacity), [full], 0, 0
    n_left, last = left.count(), None
    while n_left:
        groups = max(1, -(-n_left // group_pieces))
        dealt = left.withColumn("g", F.pmod(F.xxhash64("row", F.lit(turn)), F.lit(groups)) + made)
        out = dealt.groupBy("g").applyInPandas(_pack(capacity, 32), f"g long, doc_id {kind}, piece int, start long, length long, ids_crc32 long, row long, sequence_id long, offset long, done boolean, gap long")
        packed = written(out, f"packed-{turn}")
        made, turn, last = made + groups, turn + 1, n_left
        n_left = packed.where("not done").count()
        ends = groups == 1 or n_left == last
        done.append((packed if ends else packed.where("done")).select(*columns, "sequence_id", "offset", F.col("done").alias("certified")))
        if ends:
            break
        left = packed.where("not done").select(*columns, "row")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Tokenises docs (doc_id, text; extra columns are ignored) and packs the pieces.

    A null or empty text is the single id 0; null and repeated doc_ids are as any; no rows give none. tokenizer: path of
    a tokenizers file, on every executor.
    """
    need(docs, "doc_id", "text")
    return pack(pieces_of(docs, tokenizer, capacity), capacity, group_pieces)


def certificate(packed: DataFrame, capacity: int = CAPACITY) -> tuple[int, int]:
    """(sequences used, lower bound): at most capacity rows come to the driver."""
    counts = np.zeros(capacity + 1, np.int64)
    for r in packed.groupBy("length").count().collect():
        counts[r["length"]] = r["count"]
    return packed.select("sequence_id").distinct().count(), lower_bound(counts, capacity)
