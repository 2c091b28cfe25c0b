"""Near-duplicate groups by an LSH forest over MinHash signatures, confirmed on whole shingle sets.

A signature has TREES * DEPTH 16-bit MinHash values. Each tree sorts all distinct shingle sets by its own DEPTH values; documents
close in that order share a long prefix, and the nearer neighbours share a longer one, so that there is no fixed bucket. The depth is the
same everywhere (DEPTH values); what it cannot tell apart in a crowded region is closed as said below. Every set is held against its WINDOW successors in each order if they share
MIN_DEPTH values. Two sets of resemblance 0.8 share three values in a given order with probability 0.51, so 24 orders
miss a link with probability 3e-8 where no crowd stands between them.

Candidates then pass two filters (sizes in proportion; low bits of all values agree in at least MIN_AGREE of 192 places, six
standard deviations below what resemblance 0.8 gives) before they are confirmed on the sets themselves. Sets equal in every
shingle are one node throughout. Confirmation runs in two steps: first the direct neighbours of two orders, which joins up most
groups; then every candidate whose ends are still in different groups. A dense group of n sets so costs about 2n comparisons
and not n squared, and no candidate that could join two groups is left out.

Where more than WINDOW + 1 sets share MIN_DEPTH values of an order, neighbours alone may miss links, however deep the order goes: pages
made from one template share most values with each other, and a pair that is nearer than the rest does not stand out. Such a crowd, if its
sets are still in different groups, is closed exactly by prefix filtering: a set's shingles are ordered from rare to frequent (by counts in a
table of SLOTS places, so that the order is the same everywhere and its size is fixed), and two sets of sizes x >= y with resemblance t must
share one of the first x - ceil(t x) + 1 of the one and the first y - ceil(2 t y / (1 + t)) + 1 of the other. What template pages have in common
is frequent and stays out of these, so their crowd costs rows in proportion to its size. A pair then has to pass a bound that loses nothing:
each set has a bitmap of PARITY bits, each the parity of the shingles hashed to it, and no two sets differ in fewer shingles than their
bitmaps differ in bits. Links are looked for between groups only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, byte_slices, materialise, mix64, text_or_empty
from .graph import components, hot_degree, spread_join

TREES, DEPTH = 24, 8
MIN_DEPTH, WINDOW, MIN_AGREE = 3, 8, 148
FIRST_TREES, SLOTS, PARITY, BLOCK = 2, 1 << 18, 1024, 1024
_VALUES = TREES * DEPTH
_RNG = np.random.default_rng(0xF0357)
_FLIP = _RNG.integers(0, 2**32, _VALUES, dtype=np.uint32)
_TIMES = _RNG.integers(0, 2**31, _VALUES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of one document; of all its words together if they are fewer than k."""
    n = len(words)
    if not n:
        return words
    width = min(k, n)
    total = words[: n - width + 1].copy()
    for j in range(1, width):
        total = mix64(total) + words[j : n - width + 1 + j]
    return np.unique(mix64(total + np.uint64(width)))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The 16-bit MinHash values of a nonempty set, as big-endian bytes sort."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(_VALUES, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(x), 1024):
        np.minimum(least, ((x[at : at + 1024, None] ^ _FLIP) * _TIMES).min(axis=0), out=least)
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(">u2")


def _signatures(shingle_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in byte_slices(batch["text"]):
                words = Words(data, offsets, lower=True)
                size, one, two, sigs, bits = [], [], [], [], []
                for lo, hi in words:
                    s = shingle_hashes(words.hash[lo:hi], shingle_words)
                    size.append(len(s))
                    one.append(mix64(s).sum(dtype=np.uint64))
                    two.append(mix64(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64))
                    values = signature(s) if len(s) else None
                    sigs.append(None if values is None else values.tobytes())
                    bits.append(None if values is None else np.packbits((values & 1).astype(np.uint8)).tobytes())
                keys = [pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (one, two)]
                ids = batch["doc_id"].slice(at, len(size)).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([ids, pa.array(size, pa.int64()), *keys, pa.array(sigs, pa.binary()), pa.array(bits, pa.binary())], ["doc_id", "n", "k1", "k2", "sig", "bits"])

    return run


def _sets(shingle_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in byte_slices(batch["text"]):
                words = Words(data, offsets, lower=True)
                sets = [shingle_hashes(words.hash[lo:hi], shingle_words).view(np.int64) for lo, hi in words]
                ends = np.cumsum([0, *map(len, sets)])
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(at, len(sets)).cast(pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets)))], ["doc_id", "shingles"])

    return run


_ENTRY = "tree int, key binary, rep long, n long, bits binary"
_FOUND = "a long, b long, first boolean, border int, " + _ENTRY


class _Rows:
    """Entries of one sorted order as arrays."""

    def __init__(self, tree, key, rep, n, bits):
        self.tree, self.key, self.rep, self.n, self.bits = tree, key, rep, n, bits
        self.prefix = key[:, :MIN_DEPTH]

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> _Rows:
        wide = lambda name, kind, width: np.frombuffer(b"".join(batch[name].to_pylist()), dtype=kind).reshape(-1, width)
        return cls(batch["tree"].to_numpy(), wide("key", np.uint16, DEPTH), batch["rep"].to_numpy(), batch["n"].to_numpy(), wide("bits", np.uint64, _VALUES // 64))

    def slice(self, part: slice | np.ndarray) -> _Rows:
        return _Rows(self.tree[part], self.key[part], self.rep[part], self.n[part], self.bits[part])

    def __add__(self, other: _Rows) -> _Rows:
        return _Rows(*(np.concatenate([getattr(self, x), getattr(other, x)]) for x in ("tree", "key", "rep", "n", "bits")))

    def pairs(self, percent: int, start: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Candidates (a, b, first) among rows at most WINDOW apart of which the later is at or after start."""
        out = [], [], []
        for lag in range(1, WINDOW + 1):
            j = np.arange(max(start, lag), len(self.rep))
            if not len(j):
                continue
            i = j - lag
            j, i = (x[(self.tree[i] == self.tree[j]) & (self.prefix[i] == self.prefix[j]).all(axis=1)] for x in (j, i))
            agree = _VALUES - np.bitwise_count(self.bits[i] ^ self.bits[j]).sum(axis=1, dtype=np.int64)
            low, high = np.minimum(self.n[i], self.n[j]), np.maximum(self.n[i], self.n[j])
            good = (agree >= MIN_AGREE) & (100 * low >= percent * high) & (self.rep[i] != self.rep[j])
            i, j = i[good], j[good]
            out[0].append(np.minimum(self.rep[i], self.rep[j]))
            out[1].append(np.maximum(self.rep[i], self.rep[j]))
            out[2].append((self.tree[i] < FIRST_TREES) & (lag == 1))
        return tuple(np.concatenate(x) if x else np.zeros(0, kind) for x, kind in zip(out, (np.int64, np.int64, bool), strict=True))

    def crowded(self) -> _Rows:
        """Rows in runs of more than WINDOW + 1 with an equal prefix."""
        i = np.arange(max(0, len(self.rep) - WINDOW - 1))
        i = i[(self.tree[i] == self.tree[i + WINDOW + 1]) & (self.prefix[i] == self.prefix[i + WINDOW + 1]).all(axis=1)]
        depth = np.zeros(len(self.rep) + 1, dtype=np.int32)
        np.add.at(depth, i, 1)
        np.add.at(depth, np.minimum(i + WINDOW + 2, len(self.rep)), -1)
        return self.slice(np.flatnonzero(np.cumsum(depth)[:-1]))

    def out(self, border: int | None) -> pa.RecordBatch:
        n = len(self.rep)
        none = [pa.nulls(n, kind) for kind in (pa.int64(), pa.int64(), pa.bool_())]
        keys, bits = (pa.array([x.tobytes() for x in rows], pa.binary()) for rows in (self.key, self.bits))
        return pa.RecordBatch.from_arrays([*none, pa.array([border] * n, pa.int32()), pa.array(self.tree, pa.int32()), keys, pa.array(self.rep), pa.array(self.n), bits], names=_names(_FOUND))


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(",")]


def _found(a: np.ndarray, b: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
    n = len(a)
    none = [pa.nulls(n, kind) for kind in (pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(first), *none], names=_names(_FOUND))


def _neighbours(percent: int):
    """Candidates within a sorted partition; its first and last rows go out too, to meet those of the partitions beside it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, tail = TaskContext.get().partitionId(), None
        for batch in batches:
            if not len(batch):
                continue
            rows = _Rows.of(batch)
            if tail is None:
                yield rows.slice(slice(0, WINDOW + 1)).out(part - 1)
            both = rows if tail is None else tail + rows
            yield _found(*both.pairs(percent, len(both.rep) - len(rows.rep)))
            yield both.crowded().out(None)
            tail = both.slice(slice(max(0, len(both.rep) - WINDOW - 1), None))
        if tail is not None:
            yield tail.out(part)

    return run


def candidates(sets: DataFrame, percent: int, orders: int) -> tuple[DataFrame, DataFrame]:
    """Candidate links (a, b, first) between the sets (rep, n, sig, bits) by sorted neighbourhood in each tree's order, and the crowds (tree, prefix, rep) in them."""
    entries = sets.select(F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"), "rep", "n", "sig", "bits")
    width = 2 * DEPTH
    entries = entries.select("tree", F.substring("sig", F.col("tree") * width + 1, F.lit(width)).alias("key"), "rep", "n", "bits")
    ordered = entries.repartitionByRange(orders, "tree", "key", "rep").sortWithinPartitions("tree", "key", "rep")
    found = materialise(ordered.mapInArrow(_neighbours(percent), _FOUND))
    across = found.where("border is not null").groupBy("border").applyInArrow(_across_sorted(percent), _FOUND)
    both = materialise(found.where("border is null").union(across))
    pairs = both.where("a is not null").groupBy("a", "b").agg(F.max("first").alias("first"))
    return materialise(pairs), both.where("rep is not null").select("tree", F.substring("key", 1, 2 * MIN_DEPTH).alias("prefix"), "rep")


def _across_sorted(percent: int):
    def run(table: pa.Table) -> pa.Table:
        """The ends of two adjoining partitions, 2 * (WINDOW + 1) rows at most."""
        order = sorted(range(len(table)), key=lambda i: (table["tree"][i].as_py(), table["key"][i].as_py(), table["rep"][i].as_py()))
        rows = _Rows.of(table.take(order).combine_chunks().to_batches()[0])
        return pa.Table.from_batches([_found(*rows.pairs(percent)), rows.crowded().out(None)])

    return run


def _confirm(pairs: DataFrame, shingles: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets resemble each other enough: percent * union <= 100 * intersection."""
    left = pairs.join(shingles.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a")
    both = left.join(shingles.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    sized = both.select("a", "b", common.alias("i"), (F.size("sa") + F.size("sb")).alias("s"))
    return sized.where(100 * F.col("i") >= percent * (F.col("s") - F.col("i"))).select("a", "b")


def _slot(shingles: np.ndarray) -> np.ndarray:
    return (shingles.view(np.uint64) % np.uint64(SLOTS)).astype(np.int64)


def _slot_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(SLOTS, dtype=np.int64)
    for batch in batches:
        counts += np.bincount(_slot(batch["shingles"].flatten().to_numpy()), minlength=SLOTS)
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], ["slot", "n"])


_BITS = [f"b{i}" for i in range(_VALUES // 64)]
_PARITY = [f"p{i}" for i in range(PARITY // 64)]


def _prefixes(counts: np.ndarray, percent: int):
    """A row for each of a set's rarest shingles that a partner may have to share, with the set's bitmap; `index` if it counts as the smaller set's too."""
    ceil = lambda a, b: -(-a // b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = batch["shingles"].flatten().to_numpy(), np.cumsum([0, *batch["shingles"].value_lengths().to_pylist()])
            rows, tokens, index = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
            parity = np.zeros((len(batch), PARITY // 64), dtype=np.int64)
            for i, (lo, hi) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                s, n = flat[lo:hi], hi - lo
                probe = n - ceil(percent * n, 100) + 1
                tokens.append(s[np.lexsort((s, counts[_slot(s)]))[:probe]])
                index.append(np.arange(len(tokens[-1])) < n - ceil(2 * percent * n, 100 + percent) + 1)
                rows.append(np.full(len(tokens[-1]), i))
                odd = np.bincount((s.view(np.uint64) >> np.uint64(40)).astype(np.int64) % PARITY, minlength=PARITY) & 1
                parity[i] = np.packbits(odd.astype(np.uint8)).view(np.int64)
            rows = np.concatenate(rows)
            kept = (batch[c].take(pa.array(rows)) for c in ("rep", "n", *_BITS))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), pa.array(np.concatenate(index)), *kept, *(pa.array(c) for c in parity[rows].T)], ["token", "index", "rep", "n", *_BITS, *_PARITY])

    return run


def _open_sets(crowd: DataFrame, groups: DataFrame) -> DataFrame:
    """The sets (rep) in runs of crowd(tree, prefix, rep) whose sets are in more than one group."""
    placed = materialise(crowd.join(groups.withColumnRenamed("node", "rep"), "rep", "left").select("tree", "prefix", "rep", F.coalesce("component", "rep").alias("g")))
    runs = placed.groupBy("tree", "prefix").agg(F.count("*").alias("degree"), F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo < hi").select("tree", "prefix", "degree")
    return spread_join(placed, runs, ["tree", "prefix"], hot_degree(placed.count())).select("rep").distinct()


def _differing(columns: list[str]) -> Column:
    return sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}_y"))) for c in columns[1:]), F.bit_count(F.col(columns[0]).bitwiseXOR(F.col(f"{columns[0]}_y"))))


def _pairs_of_groups(tokens: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of sets in different groups that share a token as prefix filtering asks and pass the bounds of their bitmaps and signatures.

    A token of f sets is split in f / BLOCK blocks of probing sets, each of which meets all of its indexed ones, so that no task holds its pairs.
    """
    placed = tokens.join(groups.withColumnRenamed("node", "rep"), "rep", "left").withColumn("g", F.coalesce("component", "rep")).drop("component")
    placed = materialise(placed)
    shared = placed.groupBy("token").agg(F.count("*").alias("degree"), F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo < hi")
    shared = shared.select("token", "degree", F.ceil(F.col("degree") / BLOCK).cast("int").alias("blocks"))
    met = materialise(spread_join(placed, shared, ["token"], hot_degree(placed.count())).drop("degree"))
    x = met.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).drop("blocks", "index")
    y = met.where("index").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks", "index")
    y = y.select("token", "block", *(F.col(c).alias(f"{c}_y") for c in ("rep", "n", "g", *_BITS, *_PARITY)))
    smaller = (F.col("n_y") < F.col("n")) | ((F.col("n_y") == F.col("n")) & (F.col("rep_y") < F.col("rep")))
    both, apart = F.col("n") + F.col("n_y"), _differing(_PARITY)
    near = (F.col("g") != F.col("g_y")) & smaller & (100 * F.col("n_y") >= percent * F.col("n")) & (100 * (both - apart) >= percent * (both + apart)) & (_differing(_BITS) <= _VALUES - MIN_AGREE)
    return x.join(y, ["token", "block"]).where(near).select(F.least("rep", "rep_y").alias("a"), F.greatest("rep", "rep_y").alias("b")).distinct()


def _edges(groups: DataFrame) -> DataFrame:
    return groups.select(F.col("node").alias("a"), F.col("component").alias("b"))


def close_crowds(docs: DataFrame, sets: DataFrame, crowd: DataFrame, groups: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """groups (node, component) with all links between sets of one crowd (tree, prefix, rep); sets have (rep, n, bits)."""
    open_ = materialise(_open_sets(crowd, groups))
    if open_.isEmpty():
        return groups
    shingles = docs.join(open_.select(F.col("rep").alias("doc_id")).hint("merge"), "doc_id", "left_semi").mapInArrow(_sets(shingle_words), "doc_id long, shingles array<long>").distinct()
    word = lambda i: F.conv(F.hex(F.substring("bits", 8 * i + 1, 8)), 16, -10).cast("long").alias(f"b{i}")
    shingles = materialise(shingles)
    whole = sets.select("rep", "n", *map(word, range(_VALUES // 64))).join(shingles.withColumnRenamed("doc_id", "rep"), "rep").where(F.size("shingles") == F.col("n"))
    whole = materialise(whole)
    slots = whole.mapInArrow(_slot_counts, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # SLOTS rows at most
    counts = np.zeros(SLOTS, dtype=np.int64)
    counts[slots["slot"].to_numpy()] = slots["n"].to_numpy()
    longs = ", ".join(f"{c} long" for c in ("rep", "n", *_BITS, *_PARITY))
    tokens = materialise(whole.mapInArrow(_prefixes(counts, percent), f"token long, index boolean, {longs}"))
    pairs = materialise(_pairs_of_groups(tokens, groups, percent))
    return groups if pairs.isEmpty() else components(_edges(groups).union(_confirm(pairs, shingles, percent)))


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """Groups of documents linked by shingle sets of resemblance percent / 100 or more.

    docs needs doc_id and text; other columns are ignored. Words are lower-cased (A-Z) runs of anything but ASCII white space.
    Returns a row per input row: doc_id, n_shingles, component_id (smallest doc_id reachable), kept (doc_id = component_id).
    Texts that are null or have no word have no shingles, are linked with nothing and are kept. Rows with the same doc_id
    are one document with several texts. A row without doc_id takes its group's component_id (null if it has none). An empty table gives an empty one.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    base = materialise(docs.mapInArrow(_signatures(shingle_words), "doc_id long, n long, k1 long, k2 long, sig binary, bits binary"))
    sets = materialise(base.where("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("bits").alias("bits")))
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    usable = sets.where("rep is not null")
    orders = max(1, min(shuffles, usable.count() * TREES // (64 * WINDOW)))
    pairs, crowd = candidates(usable, percent, orders)
    involved = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    shingles = materialise(docs.join(involved.hint("merge"), "doc_id", "left_semi").mapInArrow(_sets(shingle_words), "doc_id long, shingles array<long>").distinct())
    links = materialise(_confirm(pairs.where("first"), shingles, percent))
    groups = components(links)
    label = lambda x: groups.select(F.col("node").alias(x), F.col("component").alias(f"{x}_group"))
    apart = pairs.where("not first").join(label("a"), "a", "left").join(label("b"), "b", "left")
    apart = apart.where(F.coalesce("a_group", "a") != F.coalesce("b_group", "b")).select("a", "b")
    more = _confirm(apart, shingles, percent)
    groups = close_crowds(docs, usable, crowd, components(_edges(groups).union(more)), shingle_words, percent)
    labelled = sets.join(groups, sets.rep == groups.node, "left").select("k1", "k2", F.coalesce("component", "rep").alias("c"))
    rows = base.select("doc_id", "n", "k1", "k2").join(labelled, ["k1", "k2"], "left")
    component = F.when(F.col("n") > 0, F.coalesce("c", "doc_id")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row for each group of near duplicates: that of the smallest doc_id (rows without doc_id come last, then a hash of the row decides).

    Each row is told by a hash of its columns, so rows that share a doc_id or have none are grouped by their own texts. Texts that are null or have no word are all kept.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.select(F.struct(*columns).alias("row"), F.xxhash64(*columns).alias("_key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    groups = near_duplicates(keyed.select(F.col("_key").alias("doc_id"), "text"), shingle_words, percent).select(F.col("doc_id").alias("_key"), "component_id").distinct()
    owners = keyed.select("_key", "doc_id").distinct()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_key")).alias("first")
    kept = materialise(groups.join(owners, "_key").groupBy("component_id").agg(first).select("first._key"))
    # equal rows share a key and one stays, but rows without words have a place each
    place = F.when(~text_or_empty().rlike(r"[^\x20\x09-\x0D]"), F.monotonically_increasing_id())
    return keyed.select("row", "_key", place.alias("_place")).join(kept, "_key", "left_semi").dropDuplicates(["_key", "_place"]).select("row.*")
