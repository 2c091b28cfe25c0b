"""Removal of repeated byte strings by blockwise suffix sorting with a difference cover.

A byte goes if a string of `length` bytes that covers it starts anywhere else too. Such strings are prefixes of suffixes, so suffixes that agree on
their first `length` bytes have to meet. They are dealt to suffix buckets, and one bucket is sorted at a time:

1. A suffix's bucket is named by the least hash of an eight-plus-eight byte gram among its first `length` bytes, its anchor. Equal prefixes have
   equal anchors, and neighbouring suffixes of a text mostly share theirs, so they travel as one piece of text of their common bucket.
2. Buckets that hold one piece only are done. Pieces alike from end to end are counted by their hash; of each different one, one copy is sorted.
3. A task puts the pieces of some buckets one after another and ranks the suffixes at a difference cover's positions, by their first PERIOD bytes and
   then by doubling. It then sorts block after block of suffixes: by PERIOD bytes first; ties are merged by comparing the cover ranks at the first
   distance at which both suffixes are in the cover, so no tie is ever compared byte by byte, however long it is. Neighbours in that order
   that agree on `length` bytes are repeats.
4. A bucket of more than HOT different pieces is divided by content before it is sorted: into the runs of suffixes with a common core, told apart
   by counts, and where that does not settle a run, into single suffixes.

Each text is known by doc_id and a hash of its bytes; texts given more than once are wholly repeats. Memory in a task is bound by its slice of
texts or by the pieces of one block of buckets (a bucket has HOT pieces at most, of twice `length` bytes).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, materialise, mix64
from .graph import hot_degree, spread_join
from .substring_dedup import window_starts

GRAM = 16
#: Different pieces of a bucket that are sorted together; bytes of pieces that a task sorts together; suffixes in a block.
HOT, TOGETHER, BLOCK = 512, 1 << 21, 1 << 18
#: Suffix starts in a run that a hot bucket is divided into.
RUN = 16
PERIOD = 64
_SLICE = 1 << 21
_C1, _C2 = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)
#: Half of a hash, beside which a place in a slice has room.
_HIGH = np.uint64(0xFFFFFFFF00000000)
_PIECE = "bucket long, piece long, n long, at long, print long, start int, stop int"
_TEXT_PIECE = _PIECE + ", mixed int, bytes binary"


def difference_cover(period: int) -> np.ndarray:
    """Residues of which some two differ by each number below the period: taken one by one, always the one that adds most differences."""
    cover, seen = [0], {0}
    gains = lambda c: {d for x in cover for d in ((x - c) % period, (c - x) % period)} - seen
    while len(seen) < period:
        best = max(range(period), key=lambda c: (len(gains(c)), -c))
        seen |= gains(best)
        cover.append(best)
    return np.array(sorted(cover))


COVER = difference_cover(PERIOD)
_IN_COVER = np.isin(np.arange(PERIOD), COVER)
#: For two residues, the least distance at which both are in the cover.
_SHIFT = np.array([[next(d for d in range(PERIOD) if _IN_COVER[(a + d) % PERIOD] and _IN_COVER[(b + d) % PERIOD]) for b in range(PERIOD)] for a in range(PERIOD)])


def _digest(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def anchors(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix start, the place of its anchor and the anchor's hash. The leftmost of equal hashes counts."""
    eight = np.ndarray(len(data) - 7, dtype="<u8", buffer=np.ascontiguousarray(data), strides=(1,))
    gram = mix64(eight[: len(data) - GRAM + 1] * _C1 + eight[GRAM - 8 :] * _C2)
    least = (gram & _HIGH) | np.arange(len(gram), dtype=np.uint64)
    width, reach = 1, length - GRAM + 1
    while 2 * width <= reach:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < reach:
        least = np.minimum(least[: len(least) - (reach - width)], least[reach - width :])
    place = (least[starts] & ~_HIGH).astype(np.int64)
    return place, gram[place].view(np.int64)


def pieces(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Pieces of a slice of documents: document, first and last suffix start (places in data), place and hash of their anchor."""
    starts = window_starts(offsets, length)
    if not len(starts):
        return (np.zeros(0, np.int64),) * 5
    place, hashed = anchors(data, starts, length)
    lead = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    last = np.append(lead[1:], len(starts)) - 1
    return np.searchsorted(offsets, starts[lead], side="right") - 1, starts[lead], starts[last], place[lead], hashed[lead]


def _piece_rows(length: int):
    """A row for each piece: its bucket, the hash of its bytes, and its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, prints = batch["id"].to_numpy(), batch["print"].to_numpy()
            for at, data, offsets in byte_slices(batch["text"], _SLICE):
                doc, start, stop, _, hashed = pieces(data, offsets, length)
                raw = data.tobytes()
                name = np.array([_digest(raw[a : b + length]) for a, b in zip(start.tolist(), stop.tolist(), strict=True)], dtype=np.int64)
                start, stop, doc = start - offsets[doc], stop - offsets[doc], doc + at
                columns = [hashed, name, np.ones(len(doc), np.int64), ids[doc], prints[doc], start.astype(np.int32), stop.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["bucket", "piece", "n", "at", "print", "start", "stop"])

    return run


def _cut_pieces(length: int):
    """Texts with their list of wanted pieces to a row a piece, with its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            texts, lists = batch["text"].cast(pa.large_binary()), batch["wanted"]
            for r in range(len(batch)):
                raw, wanted = texts[r].as_buffer().to_pybytes(), lists[r].values
                start, stop = wanted.field("start").to_pylist(), wanted.field("stop").to_pylist()
                same = [pa.array([batch[c][r].as_py()] * len(wanted), pa.int64()) for c in ("id", "print")]
                cut = pa.array([raw[a : b + length] for a, b in zip(start, stop, strict=True)], pa.binary())
                fields = {c: wanted.field(c) for c in ("bucket", "piece", "n", "start", "stop", "mixed")}
                columns = [fields["bucket"], fields["piece"], fields["n"], *same, fields["start"], fields["stop"], fields["mixed"], cut]
                held.append(pa.RecordBatch.from_arrays(columns, ["bucket", "piece", "n", "at", "print", "start", "stop", "mixed", "bytes"]))
                size += cut.nbytes
                if size > TOGETHER:
                    yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                    held, size = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return run


def cover_ranks(data: np.ndarray, depth: int) -> np.ndarray:
    """For each place in the cover, the rank of the `depth` bytes or more that begin there, equal ones alike; -1 for other places. Bytes past the end count as 0."""
    n = len(data)
    rank = np.full(n + 1, -1, dtype=np.int64)
    at = np.flatnonzero(_IN_COVER[np.arange(n) % PERIOD])
    words = _words(_eights(data), at, PERIOD)
    order = np.lexsort(words[::-1])
    fresh = np.append(False, np.logical_or.reduce([w[order][1:] != w[order][:-1] for w in words]))
    rank[at[order]] = np.cumsum(fresh)
    known = PERIOD
    while known < depth:
        ahead = rank[np.minimum(at + known, n)]  # of the same residue, so in the cover too
        code = rank[at] * (n + 2) + ahead + 1
        rank[at] = np.unique(code, return_inverse=True)[1]
        known *= 2
    return rank


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as a number that sorts as they do; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(PERIOD + 8, np.uint8)])
    return np.ndarray(len(padded) - 7, dtype=">u8", buffer=padded, strides=(1,))


def _words(eights: np.ndarray, at: np.ndarray, n: int) -> list[np.ndarray]:
    return [eights[at + k].astype(np.uint64) for k in range(0, n, 8)]


def _merge_ties(at: np.ndarray, group: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Suffixes `at`, sorted by group, in their order by cover ranks within each group: all groups are merged side by side, doubling the width.

    Ranks end at a depth, and the distance at which two suffixes are compared differs from pair to pair, so that of three suffixes alike beyond that depth
    two may be in order and not equal to the third. Such suffixes come side by side in any order, but none may be lost: only the left run's
    suffixes are searched for, their places made to rise, and the right run's take what is free.
    """
    at = at.copy()
    lead = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    size = np.diff(np.append(lead, len(at)))
    base, size = np.repeat(lead, size), np.repeat(size, size)
    place = np.arange(len(at)) - base

    def below(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        shift = _SHIFT[i % PERIOD, j % PERIOD]
        return rank[i + shift] < rank[j + shift]

    width = 1
    while width < size.max(initial=0):
        active = np.flatnonzero(size > width)
        run = place[active] // width
        left = active[run % 2 == 0]
        b, s, p = base[left], size[left], place[left]
        run = p // width
        other = np.minimum((run + 1) * width, s)
        lo, hi = np.zeros(len(p), np.int64), np.minimum(other + width, s) - other
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) // 2
            goes_up = below(at[b[open_] + other[open_] + mid], at[left[open_]])
            lo[open_] = np.where(goes_up, mid + 1, lo[open_])
            hi[open_] = np.where(goes_up, hi[open_], mid)
        first = b + run * width
        rising = np.cumsum(np.append(False, first[1:] != first[:-1])) * (width + 1)
        to = left + np.maximum.accumulate(rising + lo) - rising
        free = np.zeros(len(at), dtype=bool)
        free[active] = True
        free[to] = False
        merged = at.copy()
        merged[to] = at[left]
        merged[free] = at[active[place[active] // width % 2 == 1]]
        at, width = merged, 2 * width
    return at


def repeated_suffixes(data: np.ndarray, at: np.ndarray, bucket: np.ndarray, length: int) -> np.ndarray:
    """Which of the suffixes `at` (with their buckets, in order of bucket) share their first `length` bytes with another of their bucket."""
    rank, eights = cover_ranks(data, length + PERIOD), _eights(data)
    repeated = np.zeros(len(at), dtype=bool)
    first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    bounds = np.append(first, len(at))
    b = 0
    while b < len(first):  # whole buckets, BLOCK suffixes or one bucket at a time
        e = max(b + 1, int(np.searchsorted(bounds, bounds[b] + BLOCK, side="right")) - 1)
        lo, hi = bounds[b], bounds[e]
        b = e
        own = at[lo:hi]
        keys = [bucket[lo:hi].view(np.uint64), *_words(eights, own, PERIOD)]
        order = np.lexsort(keys[::-1])
        new = np.append(True, np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys]))
        group = np.cumsum(new)
        size = np.bincount(group)[group]
        tied = np.flatnonzero(size > 1)
        group, index = group[tied], order[tied]
        before = own[index]
        sorted_ = _merge_ties(before, group, rank)
        by_place = np.argsort(before)  # no place comes twice
        index = index[by_place[np.searchsorted(before[by_place], sorted_)]]
        i = np.flatnonzero(group[1:] == group[:-1])
        a, c = sorted_[i], sorted_[i + 1]
        shift = _SHIFT[a % PERIOD, c % PERIOD]
        alike = rank[a + shift] == rank[c + shift]  # then equal on more than `length` bytes
        open_ = np.flatnonzero(~alike)
        step = PERIOD
        while len(open_) and step < length:  # exact test of the rest
            k = min(step, length - 8)
            same = eights[a[open_] + k] == eights[c[open_] + k]
            open_, step = open_[same], step + 8
        alike[open_] = True
        hit = index[np.concatenate([i[alike], i[alike] + 1])]
        repeated[lo + hit] = True
    return repeated


def _ranges(key: list[np.ndarray], first: np.ndarray, flags: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """Runs of flagged starts of pieces as rows of their key columns, start and stop."""
    owner = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(flags)) - np.repeat(np.cumsum(counts) - counts, counts)
    i = np.flatnonzero(flags)
    fresh = np.append(True, (i[1:] != i[:-1] + 1) | (owner[i[1:]] != owner[i[:-1]])) if len(i) else np.zeros(0, bool)
    lead = np.flatnonzero(fresh)
    last = np.append(lead[1:], len(i)) - 1 if len(i) else lead
    o = owner[i[lead]]
    return [*(k[o] for k in key), (first[o] + place[i[lead]]).astype(np.int32), (first[o] + place[i[last]]).astype(np.int32)]


def _sort_buckets(length: int):
    """Pieces that come bucket by bucket to the ranges (at, print, start, stop) of their suffixes that repeat. Pieces counted twice are settled before."""

    def solve(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        raw = rows["bytes"].chunk(0)
        ends = np.cumsum([0, *(len(x.as_buffer()) for x in raw)])
        data = np.frombuffer(b"".join(x.as_buffer() for x in raw), dtype=np.uint8)
        start, stop = rows["start"].to_numpy().astype(np.int64), rows["stop"].to_numpy().astype(np.int64)
        counts = stop - start + 1
        at = np.arange(counts.sum()) + np.repeat(ends[:-1] - (np.cumsum(counts) - counts), counts)
        flags = repeated_suffixes(data, at, np.repeat(rows["bucket"].to_numpy(), counts), length)
        flags &= np.repeat(rows["n"].to_numpy() == 1, counts)
        columns = _ranges([rows["at"].to_numpy(), rows["print"].to_numpy()], start, flags, counts)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["at", "print", "start", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            bucket, piece = batch["bucket"].to_numpy(), batch["piece"].to_numpy()
            lead = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])).tolist()
            for a, e in zip(lead, [*lead[1:], len(bucket)], strict=True):
                goes_on = held and held[-1]["bucket"][-1].as_py() == bucket[a]
                if size > TOGETHER and not goes_on:
                    yield solve(pa.Table.from_batches(held))
                    held, size = [], 0
                # a text given twice brings its pieces twice
                fresh = np.append(True, piece[a + 1 : e] != piece[a : e - 1])
                if goes_on and held[-1]["piece"][-1].as_py() == piece[a]:
                    fresh[0] = False
                part = batch.slice(a, e - a).filter(pa.array(fresh))
                if part.num_rows:
                    held.append(part)
                    size += part["bytes"].nbytes
        if held:
            yield solve(pa.Table.from_batches(held))

    return run


_RUNS = "core long, run long, n long, bucket long, piece long, lo int, hi int"
_SINGLES = "h1 long, h2 long, n long, bucket long, piece long, lo int"


def _runs_of(length: int):
    """Runs of a piece's suffix starts by their distance to the anchor: the hash of the bytes that all suffixes of such a run have, and that of the run's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for bucket, piece, n, start, stop, raw in zip(*(batch[c].to_pylist() for c in ("bucket", "piece", "n", "start", "stop", "bytes")), strict=True):
                place, _ = anchors(np.frombuffer(raw, np.uint8), np.zeros(1, np.int64), length)
                anchor, last = int(place[0]), stop - start
                for block in range((anchor - last) // RUN, anchor // RUN + 1):
                    lo, hi = max(0, anchor - block * RUN - RUN + 1), min(last, anchor - block * RUN)
                    core = raw[anchor - block * RUN : anchor - block * RUN - RUN + 1 + length]
                    head = (anchor - lo).to_bytes(8, "little") + (hi - lo).to_bytes(8, "little")
                    rows.append((_digest(block.to_bytes(8, "little") + core), _digest(head + raw[lo : hi + length]), n, bucket, piece, lo, hi))
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            kinds = [pa.int64()] * 5 + [pa.int32()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["core", "run", "n", "bucket", "piece", "lo", "hi"])

    return run


def _singles_of(length: int):
    """The single suffixes of pieces' runs, by 128 bits of their first bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for bucket, piece, n, runs, raw in zip(*(batch[c].to_pylist() for c in ("bucket", "piece", "n", "runs", "bytes")), strict=True):
                for x in (x for r in runs for x in range(r["lo"], r["hi"] + 1)):
                    both = hashlib.blake2b(raw[x : x + length], digest_size=16).digest()
                    rows.append((int.from_bytes(both[:8], "little", signed=True), int.from_bytes(both[8:], "little", signed=True), n, bucket, piece, x))
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 5 + [pa.int32()], strict=True)], ["h1", "h2", "n", "bucket", "piece", "lo"])

    return run


def _divide(cut: DataFrame, length: int) -> DataFrame:
    """Ranges of the suffixes that repeat in hot buckets' pieces. Only counts by hash are shuffled, added up in each task first."""
    key = ["bucket", "piece"]
    cut = cut.dropDuplicates(key)
    runs = materialise(cut.select(*key, "n", "start", "stop", "bytes").mapInArrow(_runs_of(length), _RUNS))
    counts = runs.groupBy("core", "run").agg(F.sum("n").alias("total"), F.count("*").alias("degree"))
    mixed = runs.groupBy("core").agg(F.min("run").alias("a"), F.max("run").alias("b"), F.count("*").alias("degree")).where("a <> b").select("core", "degree")
    limit = hot_degree(runs.count())
    whole = spread_join(runs, counts.where("total > 1"), ["core", "run"], limit).where("n = 1").select(*key, "lo", "hi")
    open_ = spread_join(runs, mixed, ["core"], limit).groupBy(*key).agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))
    singles = materialise(cut.select(*key, "n", "bytes").join(open_, key).mapInArrow(_singles_of(length), _SINGLES))
    twice = singles.groupBy("h1", "h2").agg(F.sum("n").alias("total"), F.count("*").alias("degree")).where("total > 1").select("h1", "h2", "degree")
    single = spread_join(singles, twice, ["h1", "h2"], hot_degree(singles.count())).where("n = 1").select(*key, "lo", F.col("lo").alias("hi"))
    found = whole.unionByName(single).join(cut.select(*key, "at", "print", F.col("start").alias("_s")), key)
    return found.select("at", "print", (F.col("_s") + F.col("lo")).alias("start"), (F.col("_s") + F.col("hi")).alias("stop"))


def repeats(texts: DataFrame, length: int) -> DataFrame:
    """texts(id, print, text) of `length` bytes or more to ranges (id, print, start, stop) of the starts of strings of `length` bytes that start elsewhere too. A range may come more than once."""
    rows = materialise(texts.mapInArrow(_piece_rows(length), _PIECE))
    # buckets with more than one piece
    buckets = rows.groupBy("bucket").agg(F.count("*").alias("degree"), F.min("piece").alias("_a"), F.max("piece").alias("_b")).where("degree > 1")
    shared = spread_join(rows, buckets.select("bucket", "degree", F.expr("_a <> _b").alias("mixed")), ["bucket"], hot_degree(rows.count()))
    shared = materialise(shared.drop("degree"))
    place = ["at", "print", "start", "stop"]
    plain = shared.where("not mixed").select(*place)
    several = shared.where("mixed")
    # different pieces of a bucket, each with its first place
    kinds = several.groupBy("bucket", "piece").agg(F.sum("n").alias("n"), F.min(F.struct(*place)).alias("p"), F.count("*").alias("degree"))
    kinds = materialise(kinds)
    whole = spread_join(several.drop("n", "mixed"), kinds.where("n > 1").select("bucket", "piece", "degree"), ["bucket", "piece"], hot_degree(several.count())).select(*place)
    sizes = kinds.groupBy("bucket").agg(F.count("*").alias("kinds"))
    hot = sizes.where(F.col("kinds") > HOT).select("bucket", F.lit(1).alias("mixed"), F.col("kinds").alias("degree"))
    total = kinds.count()
    bounded = hot_degree(total)
    marked = kinds.drop("degree").join(F.broadcast(hot.where(F.col("degree") > bounded).select("bucket", F.col("mixed").alias("_hub"))), "bucket", "left")
    marked = marked.join(hot.where(F.col("degree") <= bounded).select("bucket", "mixed"), "bucket", "left").withColumn("mixed", F.coalesce("_hub", "mixed", F.lit(0)))
    wanted = marked.select(F.col("p.at").alias("id"), F.col("p.print").alias("print"), F.struct("bucket", "piece", "n", "p.start", "p.stop", "mixed").alias("w"))
    wanted = wanted.groupBy("id", "print").agg(F.collect_list("w").alias("wanted"))
    cut = materialise(texts.join(wanted, ["id", "print"]).mapInArrow(_cut_pieces(length), _TEXT_PIECE))
    sorted_ = cut.where("mixed = 0").repartition("bucket").sortWithinPartitions("bucket", "piece").mapInArrow(_sort_buckets(length), "at long, print long, start int, stop int")
    divided = cut.where("mixed = 1")
    found = plain.unionByName(whole).unionByName(sorted_)
    if not divided.isEmpty():
        found = found.unionByName(_divide(divided, length))
    return found.withColumnRenamed("at", "id")


def _cut_texts(length: int):
    """Texts without the bytes that their ranges cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lists = batch["text"].cast(pa.large_binary()), batch["ranges"]
            sizes, removed, spans, kept = [], [], [], []
            for r in range(len(batch)):
                raw = texts[r].as_buffer().to_pybytes() if texts[r].is_valid else b""
                values = lists[r].values
                gone, runs, parts, reach = 0, 0, [], 0
                if values is not None and len(values):
                    start, stop = values.field("start").to_numpy(), values.field("stop").to_numpy()
                    order = np.argsort(start, kind="stable")
                    for a, b in zip(start[order].tolist(), (stop[order] + length).tolist(), strict=True):
                        if not runs or a > reach:
                            parts.append(raw[reach:a])
                            runs, gone, reach = runs + 1, gone + b - a, b
                        elif b > reach:
                            gone, reach = gone + b - reach, b
                parts.append(raw[reach:])
                sizes.append(len(raw))
                removed.append(gone)
                spans.append(runs)
                kept.append(b"".join(parts))
            columns = [batch["row"], *(pa.array(x, pa.int64()) for x in (sizes, removed, spans)), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["row", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def remove_repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """Each document (its columns as the struct `row`, but for the text) with n_bytes, n_removed, n_spans (maximal removed runs) and kept, the bytes that are left.

    docs has (doc_id, text) and any other columns. Texts are UTF-8 bytes, null is empty; what is left need not be whole characters. Repeats count
    from anywhere, the same document included, and are judged on the texts as they came. A document given twice, or two of one text, lose all of
    it if it has `length` bytes. Rows without doc_id are documents too. An empty table gives an empty one.
    """
    if length < 2 * PERIOD or length <= GRAM + RUN:
        raise ValueError(f"length has to be {2 * PERIOD} at least")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    known = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row"), text.alias("text"))
    keyed = known.select("row", "text", F.coalesce(F.col("row.doc_id").cast("long"), F.lit(-(2**63))).alias("id"), F.xxhash64("text").alias("print"), F.hash("text").alias("check"))
    long_ = keyed.where(F.octet_length("text") >= length)
    names = materialise(long_.select("id", "print", "check", F.octet_length("text").alias("size")))
    copies = names.groupBy("print", "check").agg(F.count("*").alias("degree")).where("degree > 1")
    copied = spread_join(names, copies, ["print", "check"], hot_degree(names.count()))
    copied = copied.select("id", "print", F.lit(0).alias("start"), (F.col("size") - length).cast("int").alias("stop"))
    found = repeats(long_.select("id", "print", "text"), length).unionByName(copied)
    ranges = found.groupBy("id", "print").agg(F.collect_set(F.struct("start", "stop")).alias("ranges"))
    joined = long_.join(ranges, ["id", "print"], "left").select("row", "text", "ranges")
    short = keyed.where(F.octet_length("text") < length).select("row", "text", F.lit(None).cast(joined.schema["ranges"].dataType).alias("ranges"))
    schema = joined.select("row").schema
    for c in ("n_bytes", "n_removed", "n_spans"):
        schema = schema.add(c, "long")
    return joined.union(short).mapInArrow(_cut_texts(length), schema.add("kept", "binary"))
