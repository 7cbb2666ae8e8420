"""Operator 13: hard negatives by bit-sliced integer products.

Rows are packed into chunks, queries into blocks, and every block meets every chunk. There a score is built from the
bit-planes of the candidates' components, most significant first. What the planes to come can add lies between bounds that
halve with each plane, so a score is an interval that tightens; a candidate goes as soon as its interval can no longer
qualify, and only those left get exact scores. Two such passes: the positives of each anchor, then for each positive the
negatives in its band of scores. A block and a chunk return a few rows a query, so shuffles do not grow with candidates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vocalis.llm.common import discard, need, small_batches, tidy, written

SCALE = 256
#: Components in a chunk of candidates, and rows in a block of queries.
CHUNK_CELLS, BLOCK_ROWS = 1 << 19, 512
#: Whole numbers below this are exact as doubles; wider products are done in whole numbers of any size.
EXACT = 1 << 53
_ENDS = (1 << 63) - 1


def participants(rows: DataFrame) -> DataFrame:
    """(vec_id, label, x) of the rows whose label and vector are there and whose components are all finite.

    Rows without a vec_id cannot be named and take no part. Of rows that share one, the least by label, then vector, does.
    """
    need(rows, "vec_id", "label", "embedding")
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    kept = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(finite)
    element = rows.schema["embedding"].dataType.elementType.simpleString()
    one = F.struct(F.col("label").cast("long").alias("label"), F.col("embedding").cast(f"array<{'float' if element == 'float' else 'double'}>").alias("x"))
    return kept.groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min(one).alias("r")).select("vec_id", "r.label", "r.x")


def packed(rows: DataFrame, cells: int) -> DataFrame:
    """Rows put together as arrays, one for each column, with at most so many components."""
    fields = [f"{f.name} array<{f.dataType.simpleString()}>" for f in rows.schema.fields]
    at = rows.columns.index("x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows_held = width = 0

        def pack() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            ends = pa.array([0, table.num_rows], pa.int32())
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, c.chunk(0)) for c in table.columns], names=table.column_names)

        for batch in batches:
            if not batch.num_rows:
                continue
            widest = max(1, max(batch.column(at).value_lengths().to_pylist()))
            step = max(1, cells // widest)
            for k in range(0, batch.num_rows, step):
                part = batch.slice(k, step)
                if held and max(width, widest) * (rows_held + part.num_rows) > cells:
                    yield pack()
                    held, rows_held, width = [], 0, 0
                held.append(part)
                rows_held, width = rows_held + part.num_rows, max(width, widest)
        if held:
            yield pack()

    return rows.mapInArrow(tidy(run), ", ".join(fields))


def _numbers(column: pa.ListArray, k: int) -> np.ndarray:
    return column[k].values.to_numpy()


def _whole(vectors: pa.ListArray, width: int) -> np.ndarray:
    """Vectors as rows of whole numbers, floor(SCALE * x): int64, or of any size where one needs it."""
    sizes = vectors.value_lengths().to_numpy()
    x = np.zeros((len(vectors), width))
    x[np.arange(width) < sizes[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
    if np.abs(x).max(initial=0) * SCALE < EXACT:
        return np.floor(x * SCALE).astype(np.int64)
    return np.array([[int(v) * SCALE if abs(v) * SCALE >= EXACT else int(np.floor(v * SCALE)) for v in row] for row in x.tolist()], object)


def _clamped(scores: np.ndarray) -> np.ndarray:
    return np.minimum(np.maximum(scores, -_ENDS - 1), _ENDS)


def _kth(values: np.ndarray, k: int) -> float:
    return np.partition(values, len(values) - k)[len(values) - k]


def narrowed(queries: np.ndarray, rows: np.ndarray, allowed: np.ndarray, rule: Callable) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query (its number, the rows left, their exact scores). allowed[q, r]: a row may be one of its candidates.
    rule(q, lower, upper) tells which candidates may still qualify, given their intervals."""
    most = int(np.abs(rows).max(initial=0)) * int(np.abs(queries).max(initial=0)) * max(1, rows.shape[1])
    kind = np.float64 if most < EXACT else object
    queries = queries.astype(kind)
    held = _clamped if kind is object else lambda scores: scores
    top = int(np.abs(rows).max(initial=0)).bit_length()
    above, below = queries.clip(min=0).sum(1), queries.clip(max=0).sum(1)
    # the sign plane counts negatively, all others positively
    score = queries @ ((rows >> top).astype(kind) * (1 << top)).T
    plane = top
    while plane > 0 and ((1 << plane) - 1) * np.median((above - below).astype(np.float64)) > 2 * np.std(score.astype(np.float64)):
        plane -= 1
        score += queries @ ((rows >> plane) & 1).astype(kind).T * (1 << plane)
    planes = [((rows >> p) & 1).astype(kind) for p in range(plane)]
    for q in range(len(queries)):
        left = np.flatnonzero(allowed[q])
        part = score[q, left]
        for p in range(plane, -1, -1):
            if p < plane:
                part = part + planes[p][left] @ queries[q] * (1 << p)
            rest = (1 << p) - 1
            keep = rule(q, held(part + rest * below[q]), held(part + rest * above[q]))
            left, part = left[keep], part[keep]
            if not len(left):
                break
        yield q, left, held(part)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The first k by score, higher ones first, then by id."""
    if len(scores) > k:
        some = np.flatnonzero(scores >= _kth(scores, k))
        return some[np.lexsort((ids[some], -scores[some]))][:k]
    return np.lexsort((ids, -scores))


def _meeting(batches: Iterator[pa.RecordBatch], rule_of: Callable, allowed_of: Callable, results: Callable, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Each row of a batch is a block of queries beside a chunk of rows."""
    for batch in batches:
        column = dict(zip(batch.schema.names, batch.columns, strict=True))
        for k in range(batch.num_rows):
            get = lambda name: _numbers(column[name], k)  # noqa: B023, E731
            ours, theirs = column["q_x"][k].values, column["x"][k].values
            width = max(1, *ours.value_lengths().to_pylist(), *theirs.value_lengths().to_pylist())
            queries, rows = _whole(ours, width), _whole(theirs, width)
            lists = {n: column[n][k].as_py() for n in column if n in ("q_ps", "q_scores")}
            q_id, q_label, ids, labels = get("q_vec_id"), get("q_label"), get("vec_id"), get("label")
            out: list[tuple] = []
            for q, left, scores in narrowed(queries, rows, allowed_of(q_id, q_label, ids, labels), rule_of(lists)):
                out += results(int(q_id[q]), q, ids[left], scores, lists)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * len(schema), schema, strict=True)], schema=schema)


def _find_positives(k: int):
    def rule_of(_):
        return lambda q, lower, upper: upper >= _kth(lower, k) if len(lower) > k else np.ones(len(lower), bool)

    def allowed_of(q_id, q_label, ids, labels):
        return (q_label[:, None] == labels) & (q_id[:, None] != ids)

    def results(anchor, q, ids, scores, _):
        first = _best(scores, ids, k)
        return list(zip([anchor] * len(first), ids[first].tolist(), map(int, scores[first]), strict=True))

    schema = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64())])
    return tidy(lambda batches: _meeting(batches, rule_of, allowed_of, results, schema))


def _find_negatives(k: int, least: int, most: int):
    def bands(scores: list[int]) -> list[tuple[int, int]]:
        """The whole scores s with least * positive <= 100 * s <= most * positive."""
        return [(-(-least * s // 100), most * s // 100) for s in scores]

    def rule_of(lists):
        every = [bands(s) for s in lists["q_scores"]]

        def rule(q, lower, upper):
            keep = np.zeros(len(lower), bool)
            for low, high in every[q]:
                may = (upper >= low) & (lower <= high)
                sure = lower[(lower >= low) & (upper <= high)]
                keep |= may & (upper >= _kth(sure, k)) if len(sure) > k else may
            return keep

        return rule

    def allowed_of(q_id, q_label, ids, labels):
        return q_label[:, None] != labels

    def results(anchor, q, ids, scores, lists):
        out = []
        for positive, said, (low, high) in zip(lists["q_ps"][q], lists["q_scores"][q], bands(lists["q_scores"][q]), strict=True):
            inside = np.flatnonzero((scores >= low) & (scores <= high))
            first = inside[_best(scores[inside], ids[inside], k)]
            out += zip([anchor] * len(first), [positive] * len(first), [said] * len(first), ids[first].tolist(), map(int, scores[first]), strict=True)
        return out

    schema = pa.schema([(n, pa.int64()) for n in ("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score")])
    return tidy(lambda batches: _meeting(batches, rule_of, allowed_of, results, schema))


def _blocks(queries: DataFrame, name: str) -> DataFrame:
    """Queries in blocks, as a written table. Their number is counted, so that few rows make few blocks."""
    parts = max(1, -(-queries.count() // BLOCK_ROWS))
    return written(packed(queries.repartition(parts), BLOCK_ROWS << 12).select(*[F.col(c).alias(f"q_{c}") for c in queries.columns]), name)


def hard_negatives(rows: DataFrame, anchors: str = "vec_id % 100 = 0", positives: int = 5, negatives: int = 5, least: int = 80, most: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows: vec_id, label, embedding (numbers); extra columns are ignored. A row's score is its integer inner product with
    the anchor, each component x as floor(256 * x). anchors is an SQL condition on vec_id and label. An anchor's positives
    are the first rows of its label but for itself; each one's negatives are the first rows of other labels whose score is
    between least and most hundredths of the positive's. Higher scores come first, ties by the smaller vec_id; the next in
    line is never cut off by a tie. Missing components of shorter vectors are zeros; scores beyond 64 bits count as the
    largest or least such number. See participants() for rows that take no part. An anchor without positives, or a positive without negatives,
    gives no rows; no rows give none.
    """
    small_batches(rows.sparkSession)
    chunks = written(packed(participants(rows), CHUNK_CELLS), "vector-chunks")
    each = chunks.select(F.inline(F.arrays_zip("vec_id", "label", "x"))).where(anchors)
    blocks = _blocks(each, "anchor-blocks")
    found = blocks.crossJoin(chunks).mapInArrow(_find_positives(positives), "anchor_id long, positive_id long, positive_score long")
    first = W.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    best = found.withColumn("k", F.row_number().over(first)).where(F.col("k") <= positives)
    listed = best.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("k", "positive_id", "positive_score"))).alias("ps"))
    near = each.join(listed, F.col("vec_id") == F.col("anchor_id")).select("vec_id", "label", "x", F.col("ps.positive_id").alias("ps"), F.col("ps.positive_score").alias("scores"))
    queries = written(near, "anchors")
    blocks_2 = _blocks(queries, "positive-blocks")
    discard(blocks)
    discard(queries)
    got = blocks_2.crossJoin(chunks).mapInArrow(_find_negatives(negatives, least, most), "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    order = W.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = got.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
