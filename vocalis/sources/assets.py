"""Assets of a model bundle as DataFrames: float matrices, vocabularies, word tables. A file that is not what it should be
is refused with its name before anything is read from it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a matrix that one Arrow batch carries.
BATCH_ROWS = 4096


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def read_matrix(spark: SparkSession, path: str, width: int) -> DataFrame:
    """(file, row, vector): little-endian float32 rows of a fixed width, from one file or a folder of them.

    Files are read through Spark, one task for each, so a large matrix is kept in several files; row counts from 0 in each.
    A file whose size is no whole number of rows, or that holds a number that is not finite, is an error.
    """
    if width < 1:
        raise ValueError("a row has at least one number")
    files = _files(spark, path)
    wrong = [r["path"] for r in files.where(F.col("length") % (4 * width) != 0).select("path").take(5)]
    if wrong:
        raise ValueError(f"no rows of {width} numbers: {wrong}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                values = np.frombuffer(data.as_buffer(), "<f4")
                if not np.isfinite(values).all():
                    raise ValueError(f"{name} holds a number that is not finite")
                rows = len(values) // width
                for at in range(0, rows, BATCH_ROWS):
                    n = min(BATCH_ROWS, rows - at)
                    part = pa.array(values[at * width : (at + n) * width])
                    vectors = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), part)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(np.arange(at, at + n)), vectors], names=["file", "row", "vector"])

    return files.select("path", "content").mapInArrow(run, "file string, row long, vector array<float>")


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, id, line) of text files, ids from 0 in each."""
    lines = F.split(F.decode("content", "UTF-8"), "\n")
    each = _files(spark, path).select(F.col("path").alias("file"), F.posexplode(lines).alias("id", "line"))
    # the piece behind the last line feed is no line
    return each.withColumn("line", F.regexp_replace("line", "\r$", "")).where("line <> ''")


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(piece, id): a piece on each line, numbered from 0. A piece that comes twice is an error."""
    rows = _numbered_lines(spark, path).select(F.col("line").alias("piece"), F.col("id").cast("long").alias("id"))
    twice = [r["piece"] for r in rows.groupBy("piece").count().where("count > 1").take(5)]
    if twice:
        raise ValueError(f"{path}: pieces that come twice: {twice}")
    return rows


def read_pairs(spark: SparkSession, path: str, *values: str) -> DataFrame:
    """(word, the values named): tab-separated lines with exactly these fields, each word once; anything else is an error."""
    fields = F.split("line", "\t", -1)
    rows = _numbered_lines(spark, path).withColumn("f", fields)
    wrong = [f"{r['file']}:{r['id'] + 1}" for r in rows.where((F.size("f") != len(values) + 1) | F.exists("f", lambda x: x == "")).take(5)]
    if wrong:
        raise ValueError(f"lines without {len(values) + 1} fields: {wrong}")
    out = rows.select(F.get("f", 0).alias("word"), *[F.get("f", i + 1).alias(v) for i, v in enumerate(values)])
    twice = [r["word"] for r in out.groupBy("word").count().where("count > 1").take(5)]
    if twice:
        raise ValueError(f"{path}: words that come twice: {twice}")
    return out
