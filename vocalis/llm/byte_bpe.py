"""Operator 11: byte-level BPE encoding and decoding by DuckDB recursive queries, one database in each task.

Texts are cut by the vocabulary's pattern. A task's new words become token-position rows, one for each byte; a recursive
query joins neighbours to the merge table and contracts each word's leftmost pair of least rank, all words at once, until
no pair of a word merges. Words are remembered up to a bound, so most of a text costs a lookup. Decoding joins ids to the
vocabulary's bytes and puts them together by an ordered aggregation. Texts stay in their partition: nothing is shuffled.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterator
from itertools import chain, islice
from operator import itemgetter

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocalis.llm.common import fresh, need, small_batches, tidy

#: Words remembered in each of two generations (about 100 MB each), bytes of text cut together, and pieces or ids handled
#: by one query.
MEMORY_WORDS, GROUP_BYTES, BLOCK = 500_000, 8 << 20, 1_000_000
#: Words of more bytes contract equal pairs together, which keeps the rounds of a long run few.
LONG = 64

#: A pair of tokens as one number.
PAIR = "(1::BIGINT << 32)"

_O = "WINDOW o AS (PARTITION BY w ORDER BY pos)"
#: A round spreads each word into rows of a token, the one after it and their place (from 0), joins them to the merge
#: table and contracts the word's leftmost pair of least rank; a word is done when none of its pairs is there. Words that
#: are tokens themselves never get here, so two tokens are always left.
ENCODE = f"""
WITH RECURSIVE t AS (
  SELECT w, list(tok ORDER BY pos) AS toks, 0::BIGINT AS best FROM pieces GROUP BY w
  UNION ALL
  SELECT w, CASE WHEN best IS NULL THEN toks ELSE toks[:best % {LONG}] || [(best // {LONG})::INT] || toks[best % {LONG} + 3:] END, best FROM (
    SELECT w, any_value(toks) AS toks, min(m * {LONG} + z[1]) AS best
    FROM (SELECT w, toks, unnest(list_zip(range(len(toks) - 1), toks[:-2], toks[2:])) AS z FROM t WHERE best IS NOT NULL) LEFT JOIN merges ON pair = z[2] * {PAIR} + z[3] GROUP BY w))
SELECT w, toks FROM t WHERE best IS NULL
"""
#: The same for long words. Where no pair with the new token can rank below that token itself (it is steady), the next
#: pairs of the same rank come next anyway, every other one of a run of overlapping ones, and are contracted at once.
ENCODE_LONG = f"""
WITH RECURSIVE t AS (
  SELECT w, pos, tok, false AS done FROM pieces
  UNION ALL
  SELECT w, pos, CASE WHEN take THEN m ELSE tok END, least IS NULL FROM (
    SELECT *, lag(take, 1, false) OVER o AS gone FROM (
      SELECT *, hit AND (i - miss) % 2 = 1 AND (steady OR earlier = 0) AS take FROM (
        SELECT *, count(*) FILTER (hit) OVER before AS earlier, coalesce(max(i) FILTER (NOT hit) OVER before, 0) AS miss FROM (
          SELECT *, coalesce(m = least, false) AS hit FROM (
            SELECT r.*, m, steady, min(m) OVER (PARTITION BY w) AS least FROM
              (SELECT w, pos, tok, lead(tok) OVER o AS following, row_number() OVER o AS i FROM t WHERE NOT done {_O}) r LEFT JOIN merges ON pair = tok * {PAIR} + following))
        WINDOW before AS (PARTITION BY w ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))) {_O}) WHERE NOT gone)
SELECT w, list(tok ORDER BY pos) AS toks FROM t WHERE done GROUP BY w
"""
DECODE = "SELECT r, unhex(string_agg(v.hex, '' ORDER BY pos)) AS data, count(v.id) = count(*) AS known FROM ids LEFT JOIN vocabulary v USING (id) GROUP BY r"


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks, of a file with a base64 token and a rank on each line."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class Codec:
    """Encodes and decodes with one vocabulary, through one DuckDB database in memory."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.cut = regex.compile(pattern)
        self.single = [ranks.get(bytes([b])) for b in range(256)]
        if None in self.single:
            raise ValueError("a byte-level vocabulary has a token for each byte")
        self.memory: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "1GB", "temp_directory": ""})
        split = [(a, b, m) for token, m in ranks.items() for i in range(1, len(token)) if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None]
        a, b, m = np.array(split, np.int32).reshape(-1, 3).T
        # a token that some pair with it ranks below is not steady
        low = np.concatenate((a[m < a], b[m < b]))
        parts = pa.table({"pair": (a.astype(np.int64) << 32) + b, "m": m.astype(np.int64), "steady": ~np.isin(m, low)})  # noqa: F841
        names = pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "hex": [t.hex() for t in ranks]})  # noqa: F841
        self.db.execute("CREATE TABLE merges AS FROM parts")
        self.db.execute("CREATE TABLE vocabulary AS FROM names")

    def _learn(self, words: list[str]) -> None:
        """Remembers the ids of new words, packed. A word that is a token is that token, as no pairs could be better."""
        rest: tuple[dict[str, bytes], dict[str, bytes]] = {}, {}
        for word in words:
            data = word.encode()
            whole = self.ranks.get(data)
            if whole is not None:
                self.memory[word] = array("i", [whole]).tobytes()
            else:
                rest[len(data) > LONG][word] = data
        for known, query in zip(rest, (ENCODE, ENCODE_LONG), strict=True):
            if known:
                self.memory |= zip(known, self._contracted(list(known.values()), query), strict=True)

    def _contracted(self, words: list[bytes], query: str) -> list[bytes]:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        pieces = pa.table({  # noqa: F841
            "w": np.repeat(np.arange(len(words), dtype=np.int32), sizes),
            "pos": np.arange(ends[-1]) - np.repeat(ends - sizes, sizes),
            "tok": np.array(self.single, np.int32)[np.frombuffer(b"".join(words), np.uint8)],
        })
        got = self.db.sql(query).to_arrow_table()
        toks = got.column("toks").combine_chunks()
        flat, at = toks.flatten().to_numpy(zero_copy_only=False).astype(np.int32), toks.offsets.to_numpy()
        at = at - at[0]
        out = [b""] * len(words)
        for k, w in enumerate(got.column("w").to_pylist()):
            out[w] = flat[at[k] : at[k + 1]].tobytes()
        return out

    def _remember(self, words: set[str]) -> None:
        """Learns words that neither generation knows. A full generation becomes the older one, from which words that are
        met again come back, so frequent words are never learned twice."""
        if len(self.memory) > MEMORY_WORDS:
            self.memory, self.older = {}, self.memory
        words = words.difference(self.memory)
        known = {w for w in words if w in self.older}
        self.memory |= {w: self.older[w] for w in known}
        self._learn(list(words - known))

    def _ids(self, words: list[str]) -> bytes:
        return b"".join(itemgetter(*words)(self.memory)) if len(words) > 1 else b"".join(map(self.memory.__getitem__, words))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; a null text has none. Small texts are cut together, a long one block by block."""
        out: list[np.ndarray] = []
        at = 0
        while at < len(texts):
            size, end = len(texts[at] or ""), at + 1
            while end < len(texts) and size + len(texts[end] or "") <= GROUP_BYTES:
                size += len(texts[end] or "")
                end += 1
            if end == at + 1:
                found = (m[0] for m in self.cut.finditer(texts[at] or ""))
                parts = []
                while block := list(islice(found, BLOCK)):
                    self._remember(set(block))
                    parts.append(self._ids(block))
                out.append(np.frombuffer(b"".join(parts), np.int32))
            else:
                cut = [self.cut.findall(t) if t else [] for t in texts[at:end]]
                self._remember(set().union(*cut))
                out += [np.frombuffer(self._ids(words), np.int32) for words in cut]
            at = end
        return out

    def decode(self, rows: list[np.ndarray | None]) -> list[bytes | None]:
        """The bytes of each row of ids; null for a null row and for one with an id that the vocabulary lacks."""
        out: list[list[bytes] | None] = [None if r is None else [] for r in rows]
        blocks = [(k, r[i : i + BLOCK]) for k, r in enumerate(rows) if r is not None for i in range(0, len(r), BLOCK)]
        at = 0
        while at < len(blocks):
            size, end = len(blocks[at][1]), at + 1
            while end < len(blocks) and size + len(blocks[end][1]) <= BLOCK:
                size += len(blocks[end][1])
                end += 1
            sizes = [len(b) for _, b in blocks[at:end]]
            ids = pa.table({"r": np.repeat(np.arange(at, end, dtype=np.int32), sizes), "pos": np.arange(size, dtype=np.int32), "id": np.concatenate([b for _, b in blocks[at:end]])})  # noqa: F841
            for r, data, known in sorted(self.db.sql(DECODE).fetchall()):
                k = blocks[r][0]
                if not known:
                    out[k] = None
                elif out[k] is not None:
                    out[k].append(data)
            at = end
        return [None if o is None else b"".join(o) for o in out]


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec for each vocabulary in a worker."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(read_ranks(path), pattern)
    return _codecs[path, pattern]


def _added(df: DataFrame, source: Column, keep: list[str], made: dict[str, str], take: Callable[[pa.Array], list[pa.Array]]) -> DataFrame:
    """The columns kept, and new ones made of a source column, some batches at a time."""
    if clash := {n.lower() for n in made} & {k.lower() for k in keep}:
        raise ValueError(f"columns {sorted(clash)} are there already")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in chain(batches, [None]):
            if held and (batch is None or sum(b.nbytes for b in held) >= GROUP_BYTES):
                every = pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else held[0]
                yield pa.RecordBatch.from_arrays([*every.columns[1:], *take(every.column(0))], names=[*keep, *made])
                held = []
            if batch is not None and batch.num_rows:
                held.append(batch)

    small_batches(df.sparkSession)
    shape = df.select(*keep, *[F.lit(None).cast(kind).alias(n) for n, kind in made.items()]).schema
    return df.select(source.alias(fresh(df, "source")[0]), *keep).mapInArrow(tidy(run), shape)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*rows, np.zeros(0, np.int32)]), pa.int32()))


def encode(df: DataFrame, path: str, pattern: str, keep: list[str], text: str = "text", ids: str = "ids", data: str | None = None) -> DataFrame:
    """The columns kept, and ids (array<int>): each text's tokens, without special ones.

    A null or empty text has no ids. Long texts and words are encoded whole. data: the name of a further column (binary)
    for what the ids decode to, in the same task. A name that a kept column has already is an error; other columns, and
    rows that are repeated, do not matter. No rows give none.
    """
    need(df, text, *keep)

    def take(texts: pa.Array) -> list[pa.Array]:
        coder = codec(path, pattern)
        rows = coder.encode(texts.to_pylist())
        return [_lists(rows), *([pa.array(coder.decode(rows), pa.binary())] if data else [])]

    return _added(df, F.col(text), keep, {ids: "array<int>", **({data: "binary"} if data else {})}, take)


def decode(df: DataFrame, path: str, pattern: str, keep: list[str], ids: str = "ids", data: str = "decoded") -> DataFrame:
    """The columns kept, and data (binary): the bytes of each row's ids, which need not be whole characters.

    No ids give no bytes. Null ids, a null among them and an id that the vocabulary lacks give null.
    """
    need(df, ids, *keep)

    def take(lists: pa.Array) -> list[pa.Array]:
        rows = [None if (r := lists[k].values) is None or r.null_count else r.to_numpy() for k in range(len(lists))]
        return [pa.array(codec(path, pattern).decode(rows), pa.binary())]

    return _added(df, F.col(ids).cast("array<int>"), keep, {data: "binary"}, take)
