"""The kernel as Arrow functions: whole batches between the JVM and Python, one struct column out."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocalis.functions.text import abbreviations, clean_spacing, technical_pattern
from vocalis.kernel.frontend import Options, process, process_bytes

RESULT = (
    "original_text string, normalized_text string, pronunciation_text string, "
    "words array<struct<surface: string, pronunciation: string, source_offset: int, dictionary_replacement: int, stressed_vowel: int, from_dictionary: boolean, from_automatic_rewrite: boolean>>, "
    "dictionary_replacements array<struct<input: string, output: string, offset: int>>, "
    "automatic_rewrites array<struct<input: string, output: string, offset: int, reason: string, automatic: boolean>>, "
    "stress_decisions array<struct<word: string, stressed_vowel: int, from_dictionary: boolean, reason: string>>, "
    "warnings array<struct<code: string, message: string, offset: int, length: int>>"
)
_LISTS = {
    "words": (("surface", pa.string()), ("pronunciation", pa.string()), ("source_offset", pa.int32()), ("dictionary_replacement", pa.int32()), ("stressed_vowel", pa.int32()), ("from_dictionary", pa.bool_()), ("from_automatic_rewrite", pa.bool_())),
    "replacements": (("input", pa.string()), ("output", pa.string()), ("offset", pa.int32())),
    "rewrites": (("input", pa.string()), ("output", pa.string()), ("offset", pa.int32()), ("reason", pa.string()), ("automatic", pa.bool_())),
    "decisions": (("word", pa.string()), ("stressed_vowel", pa.int32()), ("from_dictionary", pa.bool_()), ("reason", pa.string())),
    "warnings": (("code", pa.string()), ("message", pa.string()), ("offset", pa.int32()), ("length", pa.int32())),
}
_NAMES = ("original_text", "normalized_text", "pronunciation_text", "words", "dictionary_replacements", "automatic_rewrites", "stress_decisions", "warnings")


def _lists(rows: list, fields: tuple) -> pa.Array:
    """A column of lists of structs, built column by column."""
    flat = [x for r in rows if r is not None for x in r]
    ends, at = [0], 0
    for r in rows:
        at += len(r) if r is not None else 0
        ends.append(at)
    cols = [pa.array(c, t) for c, (_, t) in zip(zip(*flat) if flat else [[]] * len(fields), fields, strict=True)]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(cols, names=[n for n, _ in fields]))


_TEXTS = {"original_text": "original", "normalized_text": "normalized", "pronunciation_text": "pronunciation"}
_OF = dict(zip(_NAMES[3:], _LISTS, strict=True))


def _type(field: str) -> str:
    """The DDL type of a field of the result; n_ and a list's name is its length."""
    if field.startswith("n_") and field[2:] in _OF:
        return "int"
    return next(t for name, t in (p.split(" ", 1) for p in _split(RESULT)) if name == field)


def _take(result, field: str):
    if field in _TEXTS:
        return getattr(result, _TEXTS[field])
    return getattr(result, _OF[field]) if field in _OF else len(getattr(result, _OF[field[2:]]))


def _column(values: list, field: str) -> pa.Array:
    return _lists(values, _LISTS[_OF[field]]) if field in _OF else pa.array(values, pa.string() if field in _TEXTS else pa.int32())


def normalize(text: Column, options: Options = Options(), fields: tuple[str, ...] = _NAMES) -> Column:
    """The result as one struct; null for a null text. The column may be binary: bytes that are not UTF-8 give an empty
    result with one diagnostic.

    fields: what of the result is wanted, n_words and the like for the length of a list. Spark cannot prune what a Python
    function gives, and words are many times their text in memory, so each text's result is dropped but for these.
    """
    types = [f"{f}: {_type(f)}" for f in fields]

    @F.arrow_udf(f"struct<{', '.join(types)}>")
    def run(texts: pa.Array) -> pa.Array:
        one = process_bytes if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else process
        taken: list[list] = [[] for _ in fields]
        for t in texts:
            got = one(t.as_py(), options, "words" not in fields) if t.is_valid else None
            for values, field in zip(taken, fields, strict=True):
                values.append(None if got is None else _take(got, field))
        return pa.StructArray.from_arrays([_column(v, f) for v, f in zip(taken, fields, strict=True)], names=list(fields), mask=texts.is_null())

    return run(text)


def _split(ddl: str) -> list[str]:
    """The fields of a DDL list, cut at commas outside brackets."""
    out, depth, last = [], 0, 0
    for i, c in enumerate(ddl):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(ddl[last:i].strip())
            last = i + 1
    return [*out, ddl[last:].strip()]


def _kernel_text(options: Options):
    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([process(t, options, True).normalized if t is not None else None for t in texts.to_pylist()], pa.string())

    return run


def normalize_text(text: Column, options: Options = Options()) -> Column:
    """The normalized text only. Texts without a digit never leave the JVM's expressions with their content: there the
    result is spacing cleanup and, for Russian, two abbreviations outside of addresses."""
    if not options.normalize or not options.cleanup:
        return _kernel_text(options)(text)
    special = text.rlike("[0-9]") | (text.rlike("т\\.[дп]\\.") & text.rlike("https?://|@"))
    russian = F.lit(options.language == "russian") if options.language != "auto" else text.rlike("[\\u0400-\\u052F]")
    plain = clean_spacing(F.when(russian, abbreviations(clean_spacing(text))).otherwise(clean_spacing(text)))
    return F.coalesce(_kernel_text(options)(F.when(special, text)), plain)


def normalize_frame(df: DataFrame, text: str = "text", options: Options = Options()) -> DataFrame:
    """df with the full result's columns beside its own."""
    return df.withColumn("_r", normalize(F.col(text), options)).select(*df.columns, "_r.*")


def has_technical(text: Column) -> Column:
    return text.rlike("|".join(f"(?:{technical_pattern(c)})" for c in ("url", "email", "ipv4", "version", "http", "model")))


@F.udtf(returnType="begin int, end int, surface string, kept boolean")
class NumericCandidates:
    """Table function: the numbers of a text that stay as they are, as byte ranges."""

    def eval(self, text: str, language: str):
        if text:
            data = text.encode()
            for code, _, a, n in process(text, Options(language=language)).warnings:
                if code == "unresolved_number":
                    yield a, a + n, data[a : a + n].decode(), True


@F.udtf(returnType="pos int, begin int, end int, token string")
class TokenSpans:
    """Table function: the word tokens of a text with byte offsets."""

    def eval(self, text: str):
        from vocalis.kernel.text import Origin, tokens

        if text:
            at = Origin(text).start
            for i, (a, b) in enumerate(tokens(text)):
                yield i, at[a], at[b], text[a:b]


def register(spark) -> None:
    """SQL names of the table functions."""
    spark.udtf.register("numeric_candidates", NumericCandidates)
    spark.udtf.register("token_spans", TokenSpans)
