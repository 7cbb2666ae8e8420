"""Operator 5: exact Jaccard join of shingle sets as a metric-space join.

Jaccard distance is a metric; r is the distance of a link. PIVOTS sets are drawn by hash, of those within 2r of each
other one stays, and each set's distance to all of them is counted exactly. A set whose nearest pivot is within 2r
belongs to that pivot's Voronoi region. Boundary sets are replicated: a set also enters every region whose pivot is
within 3r of it and no more than 2r further than its nearest, which by the triangle inequality is every region in which a
member may be linked to it. So all links of a region's members are inside of the region.

Almost all distances of a corpus are 1, so sets that no pivot covers are the rest; a third of all sets that are alike is
covered, as a draw meets it. The rest is cut by shingles: under any order of all shingles, two linked sets share one of
the first floor(n/5)+1 of each (at 0.8). The order is frequent shingles last, then by hash; a region is then the list of
sets that have a shingle among their first, and the least set of a list is its pivot.

Inside of a region sets within r of the pivot are linked to it and need no comparison with each other; of the others'
pairs only those whose distances to the pivot differ by r at most can be links (triangle inequality). Regions are joined
recursively: as only components are asked for, sets outside of a region's largest component are drawn as further pivots,
a growing number each turn, and meet the region's sets of other components within the window, until each region is of one
component or has no such set left. Equal sets are one class throughout. Every link is decided on whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalis.llm.common import clean, discard, mark, need, release, small_batches, tidy, written
from vocalis.llm.components import components
from vocalis.llm.shingles import WIDTH, Bloom, mixed, set_id, shingle_sets

#: Sets drawn as pivots of the Voronoi regions, and the most shingles one may have: 8 MB together.
PIVOTS, PIVOT_SHINGLES = 256, 4096
#: Shingles counted this often are frequent, of rising levels; lists of rarer ones are never longer than the first.
FREQUENT = (16, 128, 1024, 8192)
#: Share of the hash range that is counted; shingles above it rank after all others.
COUNTED = 0.5
BLOOM_BITS = 1 << 24
#: Shingles or list entries in one task's group.
GROUP = 900_000
#: Up to so many sets outside a region's largest component are drawn at once; of more, some each turn.
SMALL = 48
#: Pairs that are broadcast, 3 MB at most.
BROADCAST_PAIRS = 100_000
#: Sets of a region that meet the drawn ones in one task.
CHUNK = 4096
#: Bits of a set's parity sketch.
SKETCH_BITS = 2048
_TOP = np.uint64(int(COUNTED * 2**64))
_ENTRY = np.dtype([("h", "<u8"), ("s", "<i8"), ("n", "<i4")])


def _group_of(hashes: np.ndarray, groups: int) -> np.ndarray:
    return ((mixed(hashes) >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)).astype(np.int64)


def _split(groups: np.ndarray, data: np.ndarray) -> Iterator[tuple[int, bytes]]:
    order = np.argsort(groups, kind="stable")
    groups, data = groups[order], data[order]
    cuts = [*np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1]))), len(groups)] if len(groups) else []
    for a, b in zip(cuts, cuts[1:]):
        yield int(groups[a]), data[a:b].tobytes()


def _read(groups: int, width: int, share: float):
    """One row a document (its size and set id), and counts of the hashes in the lower range, packed by group. Sets in
    the drawn share of all hashes come along in group -1, once a task."""

    def out(ids, sizes, sets, packed: list[tuple[int, bytes]], kind: pa.DataType) -> pa.RecordBatch:
        n, m = len(sizes), len(packed)
        return pa.RecordBatch.from_arrays([pa.array([*ids, *[None] * m], kind), pa.array([*sizes, *[None] * m], pa.int32()), pa.array([*sets, *[None] * m], pa.int64()), pa.array([*[None] * n, *[g for g, _ in packed]], pa.int64()), pa.array([*[None] * n, *[p for _, p in packed]], pa.binary())], names=["doc_id", "n", "s", "g", "counts"])

    top = np.uint64(min(int(share * 2**64), 2**64 - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size, kind = 0, None
        sent: set[int] = set()

        def flush() -> list[tuple[int, bytes]]:
            if not held:
                return []
            h, c = np.unique(np.concatenate(held), return_counts=True)
            entry = np.zeros(len(h), np.dtype([("h", "<u4"), ("c", "u1")]))
            entry["h"], entry["c"] = (h >> np.uint64(8)).astype(np.uint32), np.minimum(c, 255)
            held.clear()
            return list(_split(_group_of(h, groups), entry))

        for batch in batches:
            kind = batch.schema.field(0).type
            sizes, sets, drawn = [], [], []
            for grams in shingle_sets(batch.column(1).to_pylist(), width):
                sizes.append(len(grams))
                sets.append(set_id(grams) if len(grams) else None)
                if 0 < len(grams) <= PIVOT_SHINGLES and sets[-1] not in sent and mixed(np.array([sets[-1]]).view(np.uint64))[0] <= top:
                    sent.add(sets[-1])
                    drawn.append((-1, grams.tobytes()))
                low = grams[: np.searchsorted(grams, _TOP)]
                held.append(low)
                size += len(low)
            more = []
            if size >= 1_000_000:
                more, size = flush(), 0
            yield out(batch.column(0).to_pylist(), sizes, sets, more + drawn, kind)
        if held:
            yield out([], [], [], flush(), kind)

    return tidy(run)


def _frequent(bits: int):
    def run(table: pa.Table) -> pa.Table:
        got = np.concatenate([np.frombuffer(x, np.dtype([("h", "<u4"), ("c", "u1")])) for x in table.column("counts").to_pylist()])
        order = np.argsort(got["h"], kind="stable")
        h, c = got["h"][order], got["c"][order].astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        total = np.add.reduceat(c, first)
        out = []
        for level, least in enumerate(FREQUENT):
            # the group's number and 32 of the hash's bits stand for the hash
            keys = h[first][total >= least].astype(np.uint64) | (np.uint64(table.column("g")[0].as_py()) << np.uint64(32))
            word, mask = Bloom.masks(keys, bits)
            out.append(pa.table({"word": pa.array(word + level * (bits // 64), pa.int64()), "mask": pa.array(mask, pa.int64())}))
        return pa.concat_tables(out)

    return run


def _filter(rows: DataFrame, bits: int, levels: int = 1) -> np.ndarray:
    """(word, mask) rows or-ed into filters, one a level: at most levels * bits / 64 rows reach the driver."""
    got = rows.groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    words = np.zeros(levels * bits // 64, np.int64)
    words[got.column("word").to_numpy()] = got.column("mask").to_numpy()
    return words.view(np.uint64).reshape(levels, -1)


class Cells:
    """Voronoi regions of pivots: which of them a set enters, by its exact distances to all pivots."""

    def __init__(self, drawn: list[bytes], threshold: int):
        """Of the drawn sets those stay as pivots that are beyond 2r of every one before."""
        self.radius = 1 - threshold / 100 + 1e-9
        self.ids: list[int] = []
        self.sizes = np.zeros(0, np.int64)
        kept: list[np.ndarray] = []
        for grams in sorted({x: None for x in drawn}):
            x = np.frombuffer(grams, np.uint64)
            same = np.array([len(np.intersect1d(x, k, assume_unique=True)) for k in kept], np.int64)
            if not len(kept) or (1 - same / (len(x) + self.sizes - same)).min() > 2 * self.radius:
                kept.append(x)
                self.sizes = np.append(self.sizes, len(x))
                self.ids.append(set_id(x))
        every = np.concatenate(kept) if kept else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(kept)), self.sizes)
        order = np.argsort(every, kind="stable")
        self.shingles, first = np.unique(every[order], return_index=True)
        self.owner, self.first = owner[order], np.append(first, len(every))

    def enter(self, grams: np.ndarray) -> tuple[bool, np.ndarray, np.ndarray]:
        """Whether a pivot covers a set, the regions that it enters, and what it shares with their pivots."""
        none = np.zeros(0, np.int64)
        if not len(self.shingles):
            return False, none, none
        at = np.searchsorted(self.shingles, grams)
        at = at[self.shingles[np.minimum(at, len(self.shingles) - 1)] == grams]
        if not len(at):
            return False, none, none
        reach = self.first[at + 1] - self.first[at]
        flat = np.repeat(self.first[at], reach) + np.arange(reach.sum()) - np.repeat(np.cumsum(reach) - reach, reach)
        same = np.bincount(self.owner[flat], minlength=len(self.sizes))
        far = 1 - same / (len(grams) + self.sizes - same)
        nearest = far.min()
        into = np.flatnonzero(far <= min(nearest + 2 * self.radius, 3 * self.radius))
        return bool(nearest <= 2 * self.radius), into, same[into]


def _lists(shared, cells, groups: int, list_groups: int, width: int, threshold: int):
    """Of sets that no pivot covers the first shingles, packed by group; those that rank as frequent go to groups of their
    own kind. The regions that sets enter go to groups of a third kind: h is the region and what is shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blooms = [Bloom(words) for words in shared.value]
        voronoi = cells.value
        held: list[np.ndarray] = []
        which: list[np.ndarray] = []
        seen: set[int] = set()
        size = 0

        def flush() -> pa.RecordBatch:
            entry, kind = np.concatenate(held), np.concatenate(which)
            held.clear()
            which.clear()
            g = _group_of(entry["h"], list_groups)
            often, inside = kind == 1, kind == 2
            g[often] = list_groups + _group_of(entry["h"][often] ^ entry["s"][often].view(np.uint64), list_groups)
            g[inside] = 2 * list_groups + _group_of(entry["s"][inside].view(np.uint64), list_groups)
            rows = list(_split(g, entry))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["g", "entries"])

        def hold(h: np.ndarray, s: int, n: int, kind: np.ndarray) -> int:
            entry = np.empty(len(h), _ENTRY)
            entry["h"], entry["s"], entry["n"] = h, s, n
            held.append(entry)
            which.append(kind)
            return len(h)

        for batch in batches:
            for grams in shingle_sets(batch.column(0).to_pylist(), width):
                n = len(grams)
                if not n or (s := set_id(grams)) in seen:
                    continue
                if len(seen) < 200_000:
                    seen.add(s)
                covered, into, same = voronoi.enter(grams)
                if len(into):
                    size += hold(into.astype(np.uint64) << np.uint64(32) | same.astype(np.uint64), s, n, np.full(len(into), 2))
                if covered:
                    continue
                low = grams[: np.searchsorted(grams, _TOP)]
                keys = ((low >> np.uint64(8)) & np.uint64(0xFFFFFFFF)) | (_group_of(low, groups).astype(np.uint64) << np.uint64(32))
                rank = np.full(n, len(blooms) + 1)
                rank[: len(low)] = sum(b.has(keys).astype(np.int64) for b in blooms)
                take = n - -(-threshold * n // 100) + 1
                order = np.argsort(rank, kind="stable")[:take]
                size += hold(grams[order], s, n, (rank[order] > 0).astype(np.int64))
            if size >= 500_000:
                yield flush()
                size = 0
        if held:
            yield flush()

    return tidy(run)


def _candidates(list_groups: int, threshold: int):
    """Of a group's lists: pairs with the pivot (kind 0), the other pairs (kind 1); of frequent ones the entries (kind 2);
    of the third kind of groups the entered regions (kind 3)."""

    def rows(kind: int, h, a, b, na, nb) -> list:
        return [np.full(len(a), kind, np.int64), h, a, b, na, nb]

    def run(table: pa.Table) -> pa.Table:
        got = np.unique(np.concatenate([np.frombuffer(x, _ENTRY) for x in table.column("entries").to_pylist()]))
        parts = []
        if table.column("g")[0].as_py() >= list_groups:
            parts.append(rows(3 if table.column("g")[0].as_py() >= 2 * list_groups else 2, got["h"].view(np.int64), got["s"], got["s"], got["n"], got["n"]))
        else:
            first = np.flatnonzero(np.concatenate(([True], got["h"][1:] != got["h"][:-1])))
            long = np.diff(np.append(first, len(got)))
            for m in np.unique(long[long > 1]).tolist():
                at = first[long == m]
                for i in range(m):
                    for j in range(i + 1, m):
                        x, y = got[at + i], got[at + j]
                        fits = 100 * np.minimum(x["n"], y["n"]).astype(np.int64) >= threshold * np.maximum(x["n"], y["n"]).astype(np.int64)
                        x, y = x[fits], y[fits]
                        parts.append(rows(0 if i == 0 else 1, np.zeros(len(x), np.int64), x["s"], y["s"], x["n"], y["n"]))
        cols = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 6
        if parts and table.column("g")[0].as_py() < list_groups:
            _, keep = np.unique(np.rec.fromarrays([cols[2], cols[3], cols[0]]), return_index=True)
            cols = [c[keep] for c in cols]
        out = pa.table({k: pa.array(c.astype(np.int64), pa.int64()) for k, c in zip(("kind", "h", "a", "b", "na", "nb"), cols, strict=True)})
        release()
        return out

    return run


def _mark(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, mask = Bloom.masks(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), bits)
            yield pa.RecordBatch.from_arrays([pa.array(word, pa.int64()), pa.array(mask, pa.int64())], names=["word", "mask"])

    return run


def _sets(shared, width: int):
    """The whole sets of those classes that the filter lets pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = Bloom(shared.value[0])
        seen: set[int] = set()
        for batch in batches:
            ids, sets, bits = [], [], []
            for grams in shingle_sets(batch.column(0).to_pylist(), width):
                if len(grams) and (s := set_id(grams)) not in seen and bloom.has(np.array([s], np.int64).view(np.uint64))[0]:
                    if len(seen) < 200_000:
                        seen.add(s)
                    ids.append(s)
                    sets.append(grams.tobytes())
                    bits.append(sketch(grams))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary()), pa.array(bits, pa.binary())], names=["s", "grams", "bits"])

    return tidy(run)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = (batch.column(k) for k in ("ga", "gb"))
        same = [len(np.intersect1d(np.frombuffer(p.as_py(), np.uint64), np.frombuffer(q.as_py(), np.uint64), assume_unique=True)) for p, q in zip(x, y, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), batch.column("na"), batch.column("nb"), pa.array(same, pa.int64())], names=["a", "b", "na", "nb", "same"])


def sketch(grams: np.ndarray) -> bytes:
    """Bit k is the parity of the number of shingles that hash to k: two sketches differ in no more bits than the sets
    differ in shingles."""
    odd = np.bincount((mixed(grams) % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def _near_enough(least: int):
    """Pairs whose sketches leave a Jaccard of least per cent possible: sets that similar differ in at most
    (100 - least) / (100 + least) of their joint size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for k in ("ba", "bb"))
            apart = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
            size = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
            yield batch.select(["a", "b", "na", "nb"]).filter(pa.array(apart * (100 + least) <= size * (100 - least)))

    return run


def _measured(pairs: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """Those distinct pairs (a, b, na, nb) that may have a Jaccard of least per cent, with same: the intersection's size.

    Sketches decide for most pairs. Whole sets are shipped for the rest: where those are few enough (checked), the pairs
    go to the sets, else both meet in a shuffle.
    """
    one, two = sets.select(F.col("s").alias("b"), F.col("bits").alias("bb")), sets.select(F.col("s").alias("a"), F.col("bits").alias("ba"))
    asked = written(pairs.join(one, "b").join(two, "a").select("a", "b", "na", "nb", "ba", "bb").mapInArrow(_near_enough(least), "a long, b long, na long, nb long"), "asked")
    few = asked.count() <= BROADCAST_PAIRS
    one, two = sets.select(F.col("s").alias("b"), F.col("grams").alias("gb")), sets.select(F.col("s").alias("a"), F.col("grams").alias("ga"))
    if few:
        two = two.join(F.broadcast(asked.select("a").distinct()), "a", "left_semi")
    return one.join(F.broadcast(asked) if few else asked, "b").join(two, "a").select("a", "b", "na", "nb", "ga", "gb").mapInArrow(_shared, "a long, b long, na long, nb long, same long")


def _few(table: DataFrame) -> DataFrame:
    """A written table, for broadcast if it has at most BROADCAST_PAIRS rows."""
    return F.broadcast(table) if table.count() <= BROADCAST_PAIRS else table


_SIMILAR = "100 * same >= {} * (na + nb - same)"


def _meeting(named: DataFrame, labels: DataFrame) -> DataFrame:
    """The sets of each region in chunks of bounded size, with their components now; drawn sets go to every chunk."""
    now = named.join(labels, named.s == labels.v, "left").withColumn("c", F.coalesce("label", "s")).drop("v", "label")
    own = now.withColumns({"chunk": F.expr("cast(pmod(xxhash64(s, 9), chunks) as int)"), "q": F.lit(False)})
    sent = now.where("drawn").withColumns({"chunk": F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)), "q": F.lit(True)})
    return own.unionByName(sent).select("h", "chunk", "q", "s", "n", "far", "c", "bits")


def _meet(threshold: int, outer: int, best: bool):
    """Pairs of a drawn set and another of the chunk in another component that sizes, the pivot's triangle window and
    sketches leave possible. best: each component only goes to its nearest drawn set."""
    radius, beyond = 1 - threshold / 100 + 1e-9, 1 - outer / 100

    def run(table: pa.Table) -> pa.Table:
        q = table.column("q").to_numpy()
        s, n, c = (table.column(k).to_numpy() for k in ("s", "n", "c"))
        n = n.astype(np.int64)
        far = table.column("far").to_numpy()
        bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint64).reshape(len(s), -1)
        own = np.flatnonzero(~q)
        # a distance that was not measured is beyond the outer radius
        low, high = np.where(np.isnan(far), beyond, far), np.where(np.isnan(far), 1.0, far)
        out: list[tuple] = []
        met: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for i in np.flatnonzero(q):
            near = own[(c[own] != c[i]) & (100 * np.minimum(n[own], n[i]) >= threshold * np.maximum(n[own], n[i])) & (low[own] <= high[i] + radius) & (low[i] <= high[own] + radius)]
            apart = np.bitwise_count(bits[near] ^ bits[i]).sum(axis=1, dtype=np.int64)
            fit = apart * (100 + threshold) <= (n[near] + n[i]) * (100 - threshold)
            met.append((np.full(fit.sum(), i), near[fit], apart[fit]))
        if met:
            x, y, apart = (np.concatenate(v) for v in zip(*met))
            if best and len(y):
                order = np.argsort(apart, kind="stable")
                first = order[np.unique(c[y[order]], return_index=True)[1]]
                x, y = x[first], y[first]
            out = [(s[i], s[j], n[i], n[j]) if s[i] < s[j] else (s[j], s[i], n[j], n[i]) for i, j in zip(x, y)]
        cols = list(zip(*set(out))) if out else [[]] * 4
        return pa.table({k: pa.array(np.array(v, np.int64)) for k, v in zip(("a", "b", "na", "nb"), cols, strict=True)})

    return run


def _across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Those pairs whose ends aren't connected yet."""
    la, lb = labels.select(F.col("v").alias("a"), F.col("label").alias("la")), labels.select(F.col("v").alias("b"), F.col("label").alias("lb"))
    return pairs.join(la, "a", "left").join(lb, "b", "left").where("coalesce(la, a) <> coalesce(lb, b)").drop("la", "lb")


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (v, label) after links (a, b): components of the labels that links connect, not of all vertices anew."""
    la, lb = labels.select(F.col("v").alias("a"), F.col("label").alias("la")), labels.select(F.col("v").alias("b"), F.col("label").alias("lb"))
    ends = links.join(la, "a", "left").join(lb, "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    joined = components(ends.where("a <> b"))
    over = _few(joined.select(F.col("v").alias("label"), F.col("label").alias("over")))
    old = labels.join(over, "label", "left").select("v", F.coalesce("over", "label").alias("label"))
    return written(old.unionByName(joined.join(labels.select("v"), "v", "left_anti")), "merged")


def similar_groups(docs: DataFrame, threshold: int = 80, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_shingles long, component_id): component_id is the least doc_id reachable over links.

    docs: doc_id, text; extra columns are ignored. threshold: per cent, over 50. Rows of equal doc_id are linked only by
    their texts. Null texts and texts without words have no shingles and no links: component_id is doc_id. A null doc_id
    counts only where a component has no other; no rows give none. 64-bit hashes stand for shingles and sets.
    """
    need(docs, "doc_id", "text")
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    since = mark()
    kind = docs.schema["doc_id"].dataType.simpleString()
    text = docs.select("text")
    octets, count = docs.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    expected = (octets or 0) // 5
    groups = max(8, int(expected * COUNTED / GROUP) + 1)
    list_groups = max(8, int(expected * (100 - threshold) / 100 / (GROUP // 3)) + 1)

    read = written(docs.select("doc_id", "text").mapInArrow(_read(groups, width, PIVOTS / max(1, count)), f"doc_id {kind}, n int, s long, g long, counts binary"), "shingle-counts")
    known = written(read.where("g is null").select("doc_id", "n", "s"), "set-ids")
    drawn = [r["counts"] for r in read.where("g = -1").select("counts").distinct().orderBy(F.xxhash64("counts")).limit(PIVOTS).collect()]
    voronoi = Cells(drawn, threshold)
    counted = read.where("g >= 0").select("g", "counts").repartition(groups, "g")
    often = _filter(counted.groupBy("g").applyInArrow(_frequent(BLOOM_BITS), "word long, mask long"), BLOOM_BITS, len(FREQUENT))
    discard(read)

    entries = text.mapInArrow(_lists(spark.sparkContext.broadcast(often), spark.sparkContext.broadcast(voronoi), groups, list_groups, width, threshold), "g long, entries binary").repartition(3 * list_groups, "g")
    found = written(entries.groupBy("g").applyInArrow(_candidates(list_groups, threshold), "kind long, h long, a long, b long, na long, nb long"), "candidates")
    pivot = found.where("kind = 0").select("a", "b", "na", "nb")
    rest = found.where("kind = 1").select("a", "b", "na", "nb").distinct()
    regions = found.where("kind = 2").select("h", F.col("a").alias("s"), F.col("na").alias("n"))
    peopled = regions.groupBy("h").agg(F.count("*").alias("m"), F.min_by("n", "s").alias("na"), F.min("s").alias("a")).where("m > 1").drop("m")
    heads = _few(written(peopled, "heads"))
    regions = written(regions.join(heads, "h"), "regions")

    # the Voronoi regions, numbered below zero; their pivots are members at distance 0
    pivots = spark.range(len(voronoi.ids)).select(F.col("id").alias("p"), F.get(F.array(*[F.lit(v) for v in voronoi.ids]), F.col("id").cast("int")).alias("a"), F.get(F.array(*[F.lit(int(v)) for v in voronoi.sizes]), F.col("id").cast("int")).cast("long").alias("na")) if voronoi.ids else spark.range(0).selectExpr("id p", "id a", "id na")
    cells = found.where("kind = 3").select(F.shiftright("h", 32).alias("p"), F.col("a").alias("b"), F.col("na").alias("nb"), F.col("h").bitwiseAND(2**32 - 1).alias("same"))
    cells = written(cells.join(F.broadcast(pivots), "p").where("a <> b").select(F.expr("-1 - p").alias("h"), "a", "b", "na", "nb", "same"), "cells")
    edge = _SIMILAR.format(threshold)
    unsure = _few(written(cells.where(f"not ({edge})").select("h").distinct(), "unsure-cells"))

    wanted = pivot.select(F.col("a").alias("s")).union(pivot.select("b")).union(rest.select("a")).union(rest.select("b")).union(regions.select("s"))
    wanted = written(wanted.union(cells.join(unsure, "h").select("b")).distinct(), "wanted")
    bloom = _filter(wanted.mapInArrow(_mark(BLOOM_BITS), "word long, mask long"), BLOOM_BITS)
    sets = written(text.mapInArrow(_sets(spark.sparkContext.broadcast(bloom), width), "s long, grams binary, bits binary").join(wanted, "s").groupBy("s").agg(F.first("grams").alias("grams"), F.first("bits").alias("bits")), "sets")

    outer = max(0, 2 * threshold - 100)  # beyond twice the radius nothing in the pivot's ball can be linked

    # every list's pivot against its other sets; lists of rarer shingles have theirs in pivot
    spokes = regions.where("s <> a").select("h", "a", "na", F.col("s").alias("b"), F.col("n").alias("nb"))
    asked = spokes.where(f"100 * least(na, nb) >= {outer} * greatest(na, nb)").select("a", "b", "na", "nb").union(pivot)
    got = written(_measured(asked.distinct(), sets, outer), "measured")
    # a set is within r of one pivot at most, as pivots are beyond 2r of each other
    least = cells.where(edge).groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label"))
    stars = cells.where(edge).select("a", "b").join(_few(written(least, "stars")), "a").select(F.col("b").alias("v"), "label")
    labels = _merged(written(stars.unionByName(least.select(F.col("a").alias("v"), "label")), "labels"), got.where(edge).select("a", "b"))
    distance = "1 - same / (na + nb - same) far"
    far = got.selectExpr("a", "b", distance)
    listed = spokes.join(far, ["a", "b"], "left").select("h", F.col("b").alias("s"), F.col("nb").alias("n"), "far")
    members = written(listed.unionByName(cells.join(unsure, "h").selectExpr("h", "b s", "nb n", distance)), "members")

    turn = 1
    while True:
        named = members.join(labels, members.s == labels.v, "left").select("h", "s", "n", "far", F.coalesce("label", "s").alias("c"))
        parts = named.groupBy("h", "c").agg(F.count("*").alias("k")).groupBy("h").agg(F.max_by("c", F.struct("k", "c")).alias("main"), F.count("*").alias("parts"), F.sum("k").alias("m"), F.max("k").alias("top"))
        split = written(parts.where("parts > 1").selectExpr("h", "main", "m", "m - top minor"), "split-regions")
        if turn > 1 and not split.limit(1).count():
            break
        split = _few(split)
        drawn_of = f"c <> main and (minor <= {SMALL} or pmod(xxhash64(s, {turn}), minor) < {16**turn})"
        named = named.join(split, "h").join(sets.select("s", "bits"), "s").withColumn("drawn", F.expr(drawn_of))
        named = written(named.withColumn("chunks", F.expr(f"cast((m + {CHUNK} - 1) div {CHUNK} as int)")).drop("c"), "named")
        discard(members)
        for best in (True, False):  # first what may merge components, then all that is left between them
            met = _meeting(named, labels).groupBy("h", "chunk").applyInArrow(_meet(threshold, outer, best), "a long, b long, na long, nb long")
            pairs = met.union(_across(rest, labels)) if turn == 1 and best else met
            more = written(_measured(pairs.distinct(), sets, threshold).where(edge).select("a", "b"), "more-links")
            if more.limit(1).count():
                labels = _merged(labels, more)
        members = written(named.where("not drawn").select("h", "s", "n", "far"), "members")
        discard(named)
        turn += 1

    classes = known.where("s is not null").groupBy("s").agg(F.min("doc_id").alias("least"))
    named = classes.join(labels, classes.s == labels.v, "left").select("s", "least", F.coalesce("label", "s").alias("label"))
    named = written(named, "classes")
    clean(since, known, named)
    roots = named.groupBy("label").agg(F.min("least").alias("component_id"))
    final = named.join(roots, "label").select("s", "component_id")
    return known.join(final, "s", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("s").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
