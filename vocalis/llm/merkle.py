"""Operator 8: document fingerprints as Merkle trees. DataFrame functions only.

Lines are paragraphs. A paragraph's hash is taken from its whole line, a section's from its paragraphs' hashes, the
root's from its sections'. Cuts keep every character, so equal roots mean equal texts. A section ends after a paragraph
whose hash says so, so an edit moves few borders. Below a paragraph its pieces (clauses, cut after 64 code points) are
listed by short hashes, which only locate edits. The fingerprint writes the tree out; likeness and the edited branches
are read from two fingerprints by descending from the root into those branches that differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vocalis.llm.common import need, written

#: A clause with its punctuation, or 64 code points of a longer one.
PIECE = "(?s).{1,63}?(?:[.!?,;:|](?=\\x20)|\\z)|.{64}"
#: Hex digits of a section's or paragraph's hash; roots have 64, pieces 16.
DIGITS = 32
#: Rows of a range of neighbouring ids, more beyond a billion rows, as ranges are a million at most (which bounds what is
#: broadcast of them to 40 MB); quantiles asked for; tasks that ranges are dealt to, at most.
BUCKET_ROWS, RANGES, QUANTILES, TASKS = 1_000, 1_000_000, 1_000, 100_000


def _sha(x: Column) -> Column:
    return F.left(F.sha2(x, 256), F.lit(DIGITS))


def sections(text: Column) -> Column:
    """The sections of a text that isn't null: section=paragraph:piece.piece,paragraph:piece ..."""

    def paragraph(line: Column) -> Column:
        pieces = F.transform(F.regexp_extract_all(line, F.lit(PIECE), F.lit(0)), lambda s: F.lpad(F.hex(F.xxhash64(s)), 16, "0"))
        return F.concat(_sha(line), F.lit(":"), F.array_join(pieces, "."))

    def section(body: Column) -> Column:
        return F.concat(_sha(F.array_join(_hashes(F.split(body, ",")), "")), F.lit("="), body)

    lines = F.transform(F.split(text, "\n", -1), paragraph)
    ends = F.transform(lines, lambda p: F.concat(p, F.when(F.substring(p, DIGITS, 1).isin("0", "8"), "|").otherwise(",")))
    body = F.regexp_replace(F.array_join(ends, ""), "[|,]\\z", "")
    return F.transform(F.split(body, "\\|", -1), section)


def fingerprint(found: Column) -> Column:
    """root/section;section;... of an array of sections, best a column of its own, as it is used twice."""
    return F.concat(F.sha2(F.array_join(_hashes(found), ""), 256), F.lit("/"), F.array_join(found, ";"))


def _hashes(nodes: Column) -> Column:
    return F.transform(nodes, lambda n: F.left(n, F.lit(DIGITS)))


def root(fp: Column) -> Column:
    return F.substring_index(fp, "/", 1)


def _sections(fp: Column) -> Column:
    return F.split(F.substring_index(fp, "/", -1), ";")


def _paragraphs(section: Column) -> Column:
    return F.split(F.substring(section, DIGITS + 2, 2**31 - 1), ",")


def _pieces(paragraph: Column) -> Column:
    """One empty piece for an empty line."""
    return F.split(F.substring(paragraph, DIGITS + 2, 2**31 - 1), "\\.")


def _numbered(df: DataFrame, keys: str) -> DataFrame:
    """df with an array of keys changed to keys with the number of their occurrence, so that sets of them are multisets.

    Runs of the sorted keys, whose columns are kept apart so that no lambda sorts again.
    """
    s, at = f"{keys}_s", f"{keys}_at"
    out = df.withColumn(s, F.array_sort(keys))
    out = out.withColumn(at, F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (F.get(F.col(s), i - 1) != x), i)), lambda i: i.isNotNull()))
    run = lambda i, k: F.transform(F.sequence(F.lit(1), F.coalesce(F.get(F.col(at), k + 1), F.size(s)) - i), lambda n: F.concat(F.get(F.col(s), i), F.lit("#"), n))
    return out.withColumn(keys, F.flatten(F.transform(at, run))).drop(s, at)


def size(fp: Column) -> Column:
    """Pieces of a fingerprint's text, one at least for each paragraph."""
    return F.length(F.translate(F.substring_index(fp, "/", -1), "0123456789ABCDEFabcdef=:;", "")) + F.size(_sections(fp))


def likeness(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """df with name: how much two fingerprints share, 0 to 1; 1 exactly where roots are equal. Their columns' names must
    not begin with _x or _y.

    Of differing roots the differing sections are opened, of these the differing paragraphs, and of these the pieces
    that differ are counted, each level as a multiset; an empty paragraph counts as a piece. One less their share.
    """
    same = root(F.col(a)) == root(F.col(b))
    none = F.array().cast("array<string>")
    out = df.withColumns({"_x": F.when(same, none).otherwise(_sections(F.col(a))), "_y": F.when(same, none).otherwise(_sections(F.col(b)))})
    for children in (_paragraphs, _pieces, None):
        out = _numbered(_numbered(out, "_x"), "_y")
        out = out.withColumns({"_x": F.array_except("_x", "_y"), "_y": F.array_except("_y", "_x")})
        if children:
            opened = lambda c: F.flatten(F.transform(c, lambda n: children(F.substring_index(n, "#", 1))))  # noqa: E731, B023
            out = out.withColumns({"_x": opened("_x"), "_y": opened("_y")})
    share = (F.size("_x") + F.size("_y")) / (size(F.col(a)) + size(F.col(b)))
    return out.withColumn(name, F.when(same, 1.0).otherwise(1.0 - F.greatest(share, F.lit(1e-9)))).drop("_x", "_y")


def _lacking(df: DataFrame, items: str, keys: str) -> DataFrame:
    """df with those items left whose first DIGITS characters are no key. Both are sorted into one array; of each run of
    equal beginnings a key comes first."""
    s, at = f"{items}_s", f"{items}_at"
    head = lambda x: F.left(x, F.lit(DIGITS))
    both = F.concat(F.transform(keys, lambda k: F.concat(k, F.lit(" "))), F.transform(items, lambda x: F.concat(head(x), F.lit("~"), F.substring(x, DIGITS + 1, 2**31 - 1))))
    out = df.withColumn(s, F.array_sort(both))
    out = out.withColumn(at, F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (head(F.get(F.col(s), i - 1)) != head(x)), i)), lambda i: i.isNotNull()))
    run = lambda i, k: F.when(F.get(F.col(s), i).endswith(" "), F.array().cast("array<string>")).otherwise(F.slice(F.col(s), i + 1, F.coalesce(F.get(F.col(at), k + 1), F.size(s)) - i))
    return out.withColumn(items, F.transform(F.flatten(F.transform(at, run)), lambda x: F.concat(head(x), F.substring(x, DIGITS + 2, 2**31 - 1)))).drop(s, at)


def branches(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """df with name: numbers (from 0) of the paragraphs of a that b lacks: those of its differing sections that are in
    none of b's differing sections. No column's name may begin with _x, _y or _k."""

    def items(fp: Column) -> Column:
        each = F.flatten(F.transform(_sections(fp), lambda s: F.transform(_hashes(_paragraphs(s)), lambda p: F.concat(F.left(s, F.lit(DIGITS)), p))))
        return F.transform(each, lambda x, i: F.concat(x, i.cast("string")))

    beyond = lambda c: F.transform(c, lambda x: F.substring(x, DIGITS + 1, 2**31 - 1))
    out = df.withColumns({"_x": items(F.col(a)), "_y": items(F.col(b)), "_kx": _hashes(_sections(F.col(a))), "_ky": _hashes(_sections(F.col(b)))})
    out = _lacking(_lacking(out, "_x", "_ky"), "_y", "_kx")
    out = out.withColumns({"_x": beyond("_x"), "_ky": _hashes(beyond("_y"))})
    out = _lacking(out, "_x", "_ky")
    return out.withColumn(name, F.array_sort(F.transform(beyond("_x"), lambda i: i.cast("int")))).drop("_x", "_y", "_kx", "_ky")


def _bucketed(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, t) with bucket and part: ranges of (doc_id, t) in order, of about BUCKET_ROWS rows.

    bucket counts the quantiles of doc_id below the row's id. An id that holds several quantiles, or null, has a bucket
    of its own, cut by t (a hash, so evenly); between two quantiles that stand for many buckets, ids are cut evenly.
    """
    n, absent = docs.agg(F.count("*").alias("n"), F.count_if(F.col("doc_id").isNull()).alias("absent")).first()
    k = n // max(BUCKET_ROWS, n // RANGES)
    top = min(k, QUANTILES)
    got = docs.agg(F.percentile_approx("doc_id", [i / (top + 1) for i in range(1, top + 1)], 10 * QUANTILES).alias("q")).first()["q"] if top else None
    got = got or []
    heavy = {b: got.count(b) for b in set(got) if got.count(b) > 1}
    bounds = sorted({*got, *(max(b - 1, -(2**63)) for b in heavy)})
    wide = -(-k // top) if top else 1
    bucket = F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in bounds]), lambda b: b < F.col("doc_id"))) if bounds else F.lit(0)
    by_hash = lambda parts: ((F.shiftright("t", 40) + 2**23) * parts / 2**24).cast("int")
    part = F.lit(0)
    if bounds and wide > 1:
        low, high = F.get(F.array(*[F.lit(b).cast("double") for b in bounds]), F.col("bucket") - 1), F.get(F.array(*[F.lit(b).cast("double") for b in bounds]), F.col("bucket"))
        part = F.coalesce(F.least(F.lit(wide - 1), ((F.col("doc_id") - low - 1) * wide / (high - low)).cast("int")), F.lit(0))
    if heavy:
        times = F.create_map(*[F.lit(v) for b, m in heavy.items() for v in (b, m * wide)])
        part = F.when(F.col("doc_id").isin(*heavy), by_hash(F.try_element_at(times, F.col("doc_id")))).otherwise(part)
    part = F.when(F.col("doc_id").isNull(), by_hash(F.lit(absent * (k + 1) // max(1, n) + 1))).otherwise(part)
    return docs.withColumn("bucket", F.when(F.col("doc_id").isNull(), -1).otherwise(bucket).cast("int")).withColumn("part", part.cast("int"))


def with_next(docs: DataFrame) -> DataFrame:
    """docs (doc_id an integer, text not null) with next_text: of the next row by descending doc_id; after the last, the
    first. Null ids come last, equal ids by descending xxhash64 of the text, then by descending text.

    Rows are dealt into ranges of neighbours (_bucketed), each sorted for itself, and the successor of a range (the top
    row of the next) is added at its end, so texts are never sorted in one task. The ranges' top ids are all that is
    ordered at once.
    """
    rows = _bucketed(docs.withColumn("t", F.xxhash64("text")))
    key = F.struct("doc_id", "t")
    tops = written(rows.groupBy("bucket", "part").agg(F.max(key).alias("top")), "range-tops")
    n_ranges = max(1, tops.count())
    down = W.orderBy(F.desc("bucket"), F.desc("part"))
    below = tops.select(F.struct("bucket", "part").alias("above"), F.lead(F.struct("bucket", "part", "top")).over(down).alias("n"), F.first(F.struct("bucket", "part", "top")).over(down).alias("first"))
    heads = below.select("above", F.inline(F.array(F.coalesce("n", "first")))).select("above", "bucket", "part", F.col("top.doc_id").alias("top_id"), F.col("top.t").alias("top_t"))
    first = rows.join(F.broadcast(heads), ["bucket", "part"]).where(F.col("doc_id").eqNullSafe(F.col("top_id")) & (F.col("t") == F.col("top_t")))
    first = first.groupBy("above", "doc_id", "t").agg(F.max("text").alias("text")).select("doc_id", "text", "t", "above.bucket", "above.part", F.lit(1).alias("extra"))
    both = rows.withColumn("extra", F.lit(0)).unionByName(first, allowMissingColumns=True)
    both = both.repartition(min(n_ranges, TASKS), "bucket", "part")
    order = W.partitionBy("bucket", "part").orderBy("extra", F.col("doc_id").desc_nulls_last(), F.desc("t"), F.desc("text"))
    return both.withColumn("next_text", F.lead("text").over(order)).where("extra = 0").drop("bucket", "part", "extra", "t")


def edited(text: Column, after: Column) -> Column:
    """text whose last half (rounded down) is replaced by as many first code points of after, or all of them."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(after, F.lit(1), half))


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, edited_lines (numbers from 0 of the lines that the edited text lacks, by differing branches).

    docs: doc_id (integer), text; extra columns are ignored. A null text is an empty one, which has one empty line. A
    table of one row is its own successor; one without rows gives none. Rows that share a doc_id stand in one order
    (with_next); copies of one row follow each other and share a range, however many they are.
    """
    need(docs, "doc_id", "text")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    after = with_next(slim).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    cut = after.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), sections(F.col("text")).alias("own"), sections(F.col("edited")).alias("changed"), sections(F.col("next_text")).alias("following"))
    made = cut.select("doc_id", "n_chars", "edited_sha256", fingerprint(F.col("own")).alias("fingerprint"), fingerprint(F.col("changed")).alias("edited_fingerprint"), fingerprint(F.col("following")).alias("next_fingerprint"))
    near = likeness(likeness(made, "fingerprint", "edited_fingerprint", "near_edited"), "fingerprint", "next_fingerprint", "near_next")
    return branches(near, "fingerprint", "edited_fingerprint", "edited_lines").drop("next_fingerprint")
