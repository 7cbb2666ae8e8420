"""Lexemes around numbers, and how far a number's surface goes on: the admission grammar as rows, windows and a matrix.

A text is cut into islands (numbers with the words beside them) and the rest. Only distinct islands go on, as one row for
each lexeme. Two neighbours are linked by what the connector matrix says of their kinds; a surface is a run of links, so
where it ends comes from one window over the rows, however long the chain is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vocalis.functions.text import clean_spacing, detect_language, dominant_language
from vocalis.kernel.text import CYRILLIC, LATIN, MARKS

LETTERS = f"{LATIN}{CYRILLIC}{MARKS}_"
_S = " \\t\\n\\r\\x0B\\f\\u00A0\\u202F"
_COLD = f"[^{_S}0-9]++(?![^{_S}])"
_HOT = f"[^{_S}]*?[0-9][^{_S}]*+"
#: Words with digits, up to four others between two of them, and up to two on both sides; spaces at the end of the text.
ISLAND = f"(?<![^{_S}])(?:{_COLD}[{_S}]++){{0,2}}+{_HOT}(?:(?:[{_S}]++{_COLD}){{0,4}}+[{_S}]++{_HOT})*+(?:[{_S}]++{_COLD}){{0,2}}+(?:[{_S}]++\\z)?+"
#: Lexemes, each with the space before it. Neither looks around nor repeats what it took, so every engine reads it alike.
NUMERAL = "[0-9]{1,3}(?: [0-9]{3})+(?:[.,:][0-9]+)*|[0-9]+(?:[.,:][0-9]+)*"
TECHNICAL = (
    "https?://[^ \\n]+",
    "(?:[A-Za-z][A-Za-z0-9.,_%+\\-\u0080-￿]*|[A-Za-z0-9._%+-]+)@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}",
    "[vV][0-9]+(?:\\.[0-9]+)+",
    "HTTP/[0-9]+(?:\\.[0-9]+)?",
    "(?:RTX|CUDA|GPU|API) [0-9]+(?:\\.[0-9]+)?",
    "#[0-9]+",
    "[A-Za-z][A-Za-z0-9+._$#-]*[-+$][A-Za-z0-9._$#-]+",
    "C\\+\\+",
    "C#",
)
#: Abbreviations that own their point.
POINTED = "руб\\.|г\\."
LEXER = f" ?(?:{'|'.join(TECHNICAL)}|{NUMERAL}|{POINTED}|[{LETTERS}]+|[^ ])"
ADDRESS = "^[0-9]{1,3}(\\.[0-9]{1,3}){3}$"
#: Kinds of lexemes: number, word, technical, hash (# with a number), end, others; and connectors: point, compound, sign.
KINDS = {"n": "^[0-9]", "p": "^[.,:]$", "c": "^[/#$%=*]$", "s": "^[-+‐-―−]$", "h": "^#[0-9]", "e": "^\\n", "w": f"^(?:[{LETTERS}]+|{POINTED})$", "t": "^..|^[A-Za-z]"}
#: The connector matrix: the connectors over which a surface of a kind goes on even where spaces stand around them and a
#: number follows. Plain numbers; typed ones (with a unit or currency); money, whose own sign begins another amount; and
#: counted ones (after a word that asks for a case, or with a mark on their digits). Glued connectors bind all kinds.
MATRIX = {"plain": "", "typed": "/#$%=*", "money": "/#%=*", "counted": "/#$%=*+-‐‑‒–—―−"}
LEXICAL = ("n", "w", "t", "h")


#: A gap and its island, from where the last island ended. ISLAND alone would try each word of a gap; this runs to the
#: next digit and steps back by two words, or begins with the first word if there are fewer.
NEXT = f"\\G(?=[^0-9]*+[0-9])([^0-9]*(?<![^{_S}])(?=(?:{_COLD}[{_S}]++){{2}}{_HOT})|[{_S}]*+)({ISLAND})"
#: Stands around islands while a text is cut.
BORDER = "\x01"


def _cut(df: DataFrame, text: str, language: str) -> DataFrame:
    """df with _language and _cut: gap, island, gap, ..., gap.

    Spark compiles a pattern it splits by for each row, but keeps one it replaces by, so islands get borders in one pass
    and the split is by a letter. Texts that hold that letter are cut by the pattern itself.
    """
    tongue = {"auto": detect_language, "segment": dominant_language}.get(language, lambda _: F.lit(language))(F.col(text))
    marked = F.split(F.regexp_replace(text, NEXT, f"$1{BORDER}$2{BORDER}"), BORDER, -1)
    found, gaps = F.regexp_extract_all(text, F.lit(ISLAND), F.lit(0)), F.split(text, ISLAND, -1)
    slow = F.flatten(F.transform(gaps, lambda g, i: F.when(i < F.size(found), F.array(g, F.get(found, i))).otherwise(F.array(g))))
    return df.withColumns({"_language": tongue, "_cut": F.when(F.contains(text, F.lit(BORDER)), slow).otherwise(marked)})


def pieces(df: DataFrame, text: str = "text", language: str = "auto") -> DataFrame:
    """df with _language, and _gaps, _islands and _clean (an island with its spacing cleaned; a line feed tells that the text
    ends there). gap, island, gap, ..., gap make up the text, so places in a piece are places in the text."""
    every = lambda since: F.filter("_cut", lambda x, i: i % 2 == since)
    found = _cut(df, text, language).withColumns({"_islands": every(1), "_gaps": every(0)}).drop("_cut")
    last = F.when(F.element_at("_gaps", -1) == "", F.size("_islands")).otherwise(0)
    return found.withColumn("_clean", F.transform("_islands", lambda x, i: F.concat(clean_spacing(x), F.when(i + 1 == last, "\n").otherwise(""))))


def parts(df: DataFrame, keep: list[str], text: str = "text", language: str = "auto") -> DataFrame:
    """The same as rows: the columns kept, _language, _row (of a text), _pos, gap, island, clean, and tail, what stands behind
    the last island (else null).

    Pieces are exploded as they are cut, and islands are cleaned as rows: Spark would push a filter made of whole
    expressions below an explode of cleaned ones, and cut each text again for every island. An outer explode has none.
    """
    cut = _cut(df, text, language).select(*keep, "_language", F.monotonically_increasing_id().alias("_row"), "_cut")
    count = F.floor(F.size("_cut") / 2).cast("int")  # of islands
    at = F.when(count > 0, F.sequence(F.lit(0), count - 1))
    each = cut.select(*keep, "_language", "_row", "_cut", F.explode_outer(at).alias("_at"))
    pos = F.coalesce("_at", F.lit(0))
    tail = F.when(F.size("_cut") <= 2 * pos + 3, F.element_at("_cut", -1))
    gap = F.when(F.col("_at").isNull(), "").otherwise(F.get("_cut", 2 * pos))
    placed = each.select(*keep, "_language", "_row", pos.alias("_pos"), gap.alias("gap"), F.get("_cut", 2 * F.col("_at") + 1).alias("island"), tail.alias("tail"))
    return placed.withColumn("clean", F.concat(clean_spacing(F.col("island")), F.when(F.col("tail") == "", "\n").otherwise("")))


def island_id(language: Column, island: Column) -> Column:
    """128 bits of a cryptographic hash: half of what rows weigh while they are shuffled was its full hexadecimal form."""
    return F.unhex(F.substring(F.sha2(F.concat(F.substring(language, 1, 1), island), 256), 1, 32))


def lexemes(islands: DataFrame) -> DataFrame:
    """(id, language, island) -> id, language, pos, kind, lex, gap (a space stands before it), begin, end (code points)."""
    raw = islands.select("id", "language", F.posexplode(F.regexp_extract_all("island", F.lit(LEXER), F.lit(0))).alias("pos", "raw"))
    gap = F.startswith("raw", F.lit(" "))
    split = raw.select("id", "language", "pos", F.when(gap, F.substring("raw", F.lit(2), F.length("raw"))).otherwise(F.col("raw")).alias("lex"), gap.alias("gap"), F.length("raw").alias("_size"))
    kind = F.lit("o")
    for name, pattern in reversed(KINDS.items()):
        kind = F.when(F.col("lex").rlike(pattern), name).otherwise(kind)
    kind = F.when(F.col("lex").rlike(ADDRESS), "t").otherwise(kind)
    end = F.sum("_size").over(W.partitionBy("id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    return split.select("id", "language", "pos", kind.alias("kind"), "lex", "gap", (end - F.length("lex")).alias("begin"), end.alias("end"))


def linked(lex: DataFrame) -> DataFrame:
    """Lexemes with plain_end, typed_end, money_end and counted_end: the pos where a surface that reaches this lexeme ends.

    A surface goes on over what is glued to it: words, numbers, and connectors that something glued follows; connectors
    with nothing behind are given back. One that the matrix lets stand apart needs a number after it (or a glued word),
    and several points before it do not stop it.
    """
    order = W.partitionBy("id").orderBy("pos")
    back = W.partitionBy("id").orderBy(F.desc("pos"))
    ahead = {f"{c}{n}": F.lead(c, n).over(order) for n in (1, 2) for c in ("kind", "gap", "lex")}
    gaps = F.sum(F.col("gap").cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0))
    rows = lex.withColumns({**ahead, "_last": F.lag("lex").over(order), "_gaps": gaps})
    connector = lambda c: F.coalesce(F.col(c).isin("p", "c", "s"), F.lit(False))
    # a connector that a number follows, or a glued word
    bears = connector("kind") & ((F.col("kind1") == "n") | ((F.col("kind1") == "w") & ~F.col("gap1")))
    here = F.struct("kind", "lex", "_gaps", F.coalesce(bears, F.lit(False)).alias("bears"))
    # the next lexeme that is no connector, and the next that is no point
    past = lambda *skip: F.last(F.when(~F.col("kind").isin(*skip), here), ignorenulls=True).over(back.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumns({"_lexical": past("p", "c", "s"), "_beyond": past("p")})
    glued = ~F.col("gap1") & (F.col("kind1").isin(*LEXICAL) | (connector("kind1") & F.col("_lexical.kind").isin(*LEXICAL) & (F.col("_lexical._gaps") == F.col("_gaps"))))
    number_next = (F.col("kind2") == "n") | ((F.col("kind2") == "w") & ~F.col("gap2"))
    points = F.when(F.col("kind") == "p", F.endswith("_last", F.lit(".")) | (F.col("kind1") == "p")).otherwise(F.endswith("lex", F.lit(".")) | (F.col("kind2") == "p"))
    near = F.col("_beyond._gaps") <= F.col("_gaps") + F.when(points, 1).otherwise(0)
    links = {}
    for name, signs in MATRIX.items():
        link = glued
        if signs:
            spaced = lambda c: F.col(c).isin(*signs)  # noqa: B023, E731
            first = spaced("lex1") & ~connector("kind") & number_next
            second = spaced("lex") & (F.col("kind1") == "n")
            hashed = (F.col("kind1") == "h") & ~F.col("kind").isin("o", "e")
            over_points = ((F.col("kind1") == "p") & ~F.col("gap1") | (F.col("kind") == "p")) & spaced("_beyond.lex") & near & F.col("_beyond.bears")
            link = glued | first | second | hashed | over_points
        links[name] = F.coalesce(link & ~F.col("kind").isin("e"), F.lit(False))
    to_here = back.rowsBetween(W.unboundedPreceding, 0)
    ends = {f"{name}_end": F.last(F.when(~link, F.col("pos")), ignorenulls=True).over(to_here) for name, link in links.items()}
    return rows.withColumns(ends).drop("_lexical", "_beyond", "_last", "_gaps", *ahead)
