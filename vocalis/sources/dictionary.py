"""Strict pronunciation dictionaries and their frames."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from vocalis.kernel.frontend import Entry
from vocalis.kernel.text import folded

_PATTERN, _SPOKEN = ("pattern", "token", "phrase"), ("pronunciation", "replacement")
_MATCH = {"exact_token": "exact", "case_sensitive": "exact", "case_insensitive": "folded", "phrase": "phrase"}
_FIELDS = {*_PATTERN, *_SPOKEN, "match", "stressed_vowel"}
SCHEMA = "ord int, pattern string, pronunciation string, match string, stressed_vowel int"


def _object(pairs: list) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise ValueError("an object repeats a key")
    return out


def _no_constant(name: str):
    raise ValueError(f"{name} is no JSON value")


def _check_text(value) -> None:
    if isinstance(value, str):
        value.encode("utf-8")  # a lone surrogate has no encoding
    elif isinstance(value, list):
        for v in value:
            _check_text(v)
    elif isinstance(value, dict):
        for k, v in value.items():
            _check_text(k)
            _check_text(v)


def strict_json(data: bytes):
    """JSON without repeated keys, constants beyond JSON, lone surrogates or anything after the value."""
    value = json.loads(data.decode("utf-8"), object_pairs_hook=_object, parse_constant=_no_constant)
    _check_text(value)
    return value


def _one(item: dict, names: tuple[str, ...]) -> tuple[str, str]:
    found = [n for n in names if n in item]
    if len(found) != 1 or not isinstance(item[found[0]], str) or not item[found[0]]:
        raise ValueError(f"an entry needs one text of {names}")
    return found[0], item[found[0]]


def entry_of(item) -> Entry:
    if not isinstance(item, dict) or set(item) - _FIELDS:
        raise ValueError("an entry is an object of known fields")
    name, pattern = _one(item, _PATTERN)
    _, spoken = _one(item, _SPOKEN)
    match = item.get("match", "phrase" if name == "phrase" else "exact_token")
    if match not in _MATCH or (name == "phrase" and match != "phrase"):
        raise ValueError(f"unknown match {match!r}")
    vowel = item.get("stressed_vowel")
    if vowel is not None and (isinstance(vowel, bool) or not isinstance(vowel, int) or vowel < 0):
        raise ValueError("stressed_vowel is a number from 0")
    return Entry(pattern, spoken, _MATCH[match], vowel)


def add(entries: tuple[Entry, ...], more: list[Entry]) -> tuple[Entry, ...]:
    """All of more or, if one is a duplicate of its kind, none."""
    key = lambda e: (e.match, folded(e.pattern) if e.match == "folded" else e.pattern)
    seen = {key(e) for e in entries}
    for e in more:
        if key(e) in seen:
            raise ValueError(f"{e.pattern!r} is there already")
        seen.add(key(e))
    return (*entries, *more)


def parse(data: bytes) -> tuple[Entry, ...]:
    value = strict_json(data)
    if not isinstance(value, list):
        raise ValueError("a dictionary is an array of entries")
    return add((), [entry_of(x) for x in value])


def load(spark: SparkSession, path: str) -> tuple[Entry, ...]:
    """Entries of a dictionary file, read through Spark."""
    rows = spark.read.format("binaryFile").load(path).select("content").collect()
    if len(rows) != 1:
        raise ValueError(f"{path} is no single file")
    return parse(bytes(rows[0]["content"]))


def frame(spark: SparkSession, entries: tuple[Entry, ...]) -> DataFrame:
    return spark.createDataFrame([(i, e.pattern, e.pronunciation, e.match, e.stressed_vowel) for i, e in enumerate(entries)], SCHEMA)
