"""Normalisation over streams: a stateless projection, and counts of diagnostics by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocalis.functions.text import tokens
from vocalis.kernel.frontend import Options
from vocalis.operators.dictionary import lookup_tokens
from vocalis.udf import normalize


def normalize_stream(texts: DataFrame, text: str = "text", options: Options = Options()) -> DataFrame:
    """Works for batch and streaming frames alike; append mode, no state."""
    return texts.withColumn("_r", normalize(F.col(text), options)).select(*texts.columns, F.col("_r.normalized_text").alias("normalized"), F.col("_r.warnings").alias("warnings"))


def warning_counts(texts: DataFrame, ts: str, window: str = "5 minutes", late: str = "10 minutes", text: str = "text", options: Options = Options()) -> DataFrame:
    """(window, code, n): a watermark bounds the state; late rows beyond it are dropped."""
    each = normalize_stream(texts.withWatermark(ts, late), text, options).select(F.col(ts).alias("ts"), F.explode("warnings").alias("w"))
    return each.groupBy(F.window("ts", window), F.col("w.code").alias("code")).agg(F.count("*").alias("n"))


def distinct_warnings(texts: DataFrame, ts: str, *key: str, late: str = "10 minutes", text: str = "text", options: Options = Options()) -> DataFrame:
    """(key, ts, code, offset, length): each diagnostic of a text once, however often the text is sent within the watermark.

    The state is one row for each diagnostic seen within the watermark; rows later than it are dropped. Texts
    without a diagnostic do not move the watermark, as Spark filters them before it.
    """
    each = normalize_stream(texts.withWatermark(ts, late), text, options).select(*key, ts, F.explode("warnings").alias("w"))
    return each.select(*key, ts, "w.code", "w.offset", "w.length").dropDuplicatesWithinWatermark([*key, "code", "offset", "length"])


def read_tokens(texts: DataFrame, entries: DataFrame, *key: str, text: str = "text") -> DataFrame:
    """(key, token, pronunciation, entry) of the tokens that a dictionary has: a join of the stream with a table at rest,
    without state."""
    words = texts.select(*key, F.explode(tokens(F.col(text))).alias("token"))
    return lookup_tokens(words, entries).where("entry is not null").select(*key, "token", "pronunciation", "entry")
